"""Histograms, ensembles, rankings, errors and scans over ordered rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.operators.tables import numbered


def histogram(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """(by, label, n, p): counts and their shares within ``by``."""
    n = df.groupBy(*by, label).agg(F.count("*").alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def inverse_weights(hist: DataFrame, by: list[str]) -> DataFrame:
    """Mean share of the labels over a label's own share."""
    return hist.withColumn("weight", F.try_divide(F.avg("p").over(Window.partitionBy(*by)), F.col("p")))


def joint_histogram(df: DataFrame, row: str, col: str) -> DataFrame:
    n = df.groupBy(row, col).agg(F.count("*").alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(row)))


def mean_by_separation(df: DataFrame, value: str, by: list[str], low: float, high: float, cap: int) -> DataFrame:
    kept = df.where(F.col(value).between(low, high))
    return kept.groupBy(*by, F.least(F.abs(F.col("i") - F.col("j")), F.lit(cap)).alias("sep")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def rebin(hist: DataFrame, keys: list[str], fine: list[float], coarse: list[float], bin_col: str = "bin", value: str = "p") -> DataFrame:
    """Mass of fine bins spread over coarse ones by overlap (an interval join of two edge tables of fixed size)."""
    spark = hist.sparkSession
    over = [
        (k, m, (min(b, d) - max(a, c)) / (b - a))
        for k, (a, b) in enumerate(zip(fine, fine[1:], strict=False)) for m, (c, d) in enumerate(zip(coarse, coarse[1:], strict=False)) if min(b, d) > max(a, c)
    ]
    table = spark.createDataFrame(over, f"{bin_col} int, coarse int, share double")
    return hist.join(F.broadcast(table), bin_col).groupBy(*keys, F.col("coarse").alias(bin_col)).agg(F.sum(F.col(value) * F.col("share")).alias(value))


def ensemble(df: DataFrame, cell: list[str], bin_col: str, value: str = "p", geometric: bool = False) -> DataFrame:
    """Mean over models of each cell's distribution; the geometric one is renormalised."""
    mean = F.exp(F.avg(F.log(F.greatest(F.col(value), F.lit(1e-12))))) if geometric else F.avg(value)
    out = df.groupBy(*cell, bin_col).agg(mean.alias(value))
    return out.withColumn(value, F.col(value) / F.sum(value).over(Window.partitionBy(*cell))) if geometric else out


def bias_corrected(df: DataFrame, by: list[str], p: str, ref: str, weight: str) -> DataFrame:
    """p * ref / (weight * ref), both normalised within ``by``."""
    w = Window.partitionBy(*by)
    new = F.col(weight) * F.col(ref)
    x = F.col(p) * F.col(ref) / (new / F.sum(new).over(w))
    return df.withColumn("raw", x).withColumn("corrected", F.col("raw") / F.sum("raw").over(w)).drop("raw")


def blend(p: Column, hit: Column, weight: float) -> Column:
    """(p + w [hit]) / (1 + w)."""
    return (p + weight * hit.cast("double")) / (1 + weight)


def confusion(df: DataFrame, by: list[str], truth: Column, guess: Column, eps: float = 1e-6) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 and mcc by group; truth and guess are booleans."""
    c = df.groupBy(*by).agg(F.count_if(truth & guess).alias("tp"), F.count_if(~truth & guess).alias("fp"), F.count_if(truth & ~guess).alias("fn"), F.count_if(~truth & ~guess).alias("tn"))
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    return c.withColumns({
        "precision": tp / (tp + fp + eps), "recall": tp / (tp + fn + eps), "f1": 2 * tp / (2 * tp + fp + fn + eps),
        "mcc": (tp * tn - fp * fn) / (F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) + eps),
    })


def top_precision(df: DataFrame, by: list[str], score: str, truth: str, ties: list[str], size: Column, ratio: float, cap_by_truth: bool = True) -> DataFrame:
    """precision, recall and f1 of the k best rows by group, k = min(int(size * ratio), true rows, rows), one at least."""
    w = Window.partitionBy(*by)
    r = df.withColumns({
        "rn": F.row_number().over(w.orderBy(F.desc(score), *ties)), "n_true": F.sum(F.col(truth).cast("int")).over(w), "n_all": F.count("*").over(w), "size": size,
    })
    k = F.least(F.floor(F.col("size") * ratio), F.col("n_all"))
    k = F.greatest(F.lit(1), F.least(k, F.col("n_true")) if cap_by_truth else k)
    top = r.withColumn("k", k).where("rn <= k").groupBy(*by).agg(F.max("k").cast("long").alias("k"), F.sum(F.col(truth).cast("int")).alias("hits"), F.max("n_true").alias("n_true"))
    p, q = F.col("hits") / F.col("k"), F.col("hits") / F.greatest("n_true", F.lit(1))
    return top.withColumns({"precision": p, "recall": q, "f1": F.when(p + q > 0, 2 * p * q / (p + q)).otherwise(0.0)})


def top_mean(df: DataFrame, by: list[str], score: str, ties: list[str], k: int) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), *ties))
    return df.withColumn("rn", rn).where(F.col("rn") <= k).groupBy(*by).agg(F.count("*").alias("k"), F.avg(score).alias("mean"), F.sum(score).alias("total"))


def kth_smallest(df: DataFrame, by: list[str], value: str, k: int) -> DataFrame:
    """Exact k-th smallest value, the largest where there are fewer."""
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(value))
    return df.withColumn("rn", rn).where(F.col("rn") <= k).groupBy(*by).agg(F.max(value).alias("threshold"))


def best_and_top_share(df: DataFrame, by: list[str], value: str, ties: list[str], share: int = 10) -> DataFrame:
    """Best value, and the mean of the best n div ``share`` rows (one at least)."""
    w = Window.partitionBy(*by)
    r = df.withColumn("rn", F.row_number().over(w.orderBy(F.desc(value), *ties))).withColumn("k", F.greatest(F.lit(1), F.floor(F.count("*").over(w) / share)))
    return r.where("rn <= k").groupBy(*by).agg(F.max(value).alias("best"), F.avg(value).alias("top_mean"))


def first_per_group(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """Order-dependent greedy choice in one pass: the best row of each group."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("rn = 1").drop("rn")


def islands(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of equal values: (by, run, value, length, first and last of the first order column)."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    runs = df.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*by, "run").agg(F.first(value).alias(value), F.count("*").alias("length"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def renumbered(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """A number that grows by one whenever the value changes, from 0."""
    w = Window.partitionBy(*by).orderBy(*order)
    step = F.coalesce((F.col(value) != F.lag(value).over(w)).cast("int"), F.lit(0))
    return df.withColumn("step", step).withColumn("number", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("step")


def beside_missing(df: DataFrame, by: list[str], order: list[str], missing: Column) -> DataFrame:
    """Adds invalid: the row or one of its neighbours is missing."""
    w = Window.partitionBy(*by).orderBy(*order)
    m = df.withColumn("m", missing)
    return m.withColumn("invalid", F.col("m") | F.coalesce(F.lag("m").over(w), F.lit(False)) | F.coalesce(F.lead("m").over(w), F.lit(False))).drop("m")


def trimmed(df: DataFrame, by: list[str], order: str, outer: Column) -> DataFrame:
    """Rows between the first and the last that are not ``outer``."""
    span = df.where(~outer).groupBy(*by).agg(F.min(order).alias("lo"), F.max(order).alias("hi"))
    return df.join(span, by).where(F.col(order).between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def packed_batches(df: DataFrame, key: str, size: str, bound: float, group: str | None = None) -> DataFrame:
    """Batches in order of size, largest first; a batch holds max(1, bound / size^2 of its head) rows.

    Rows are grouped by the power of two of their size where no ``group`` is given, so that sizes in a batch are alike.
    Batches of rows of one size are all of one length, so the scan is sequential only over a group's sizes and how many
    rows each has; a row's batch follows from its place among the rows of its size."""
    g = F.col(group) if group else F.floor(F.log2(F.greatest(F.col(size), F.lit(1)).cast("double"))).cast("long")
    src = df.select(g.alias("grp"), F.col(key).cast("long").alias("key"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size"))
    src = src.withColumns({"__down": -F.col("size"), "__none": F.col("key").isNull()})
    src = numbered(src, ["grp", "__down", "__none", "key"], "__n").drop("__down", "__none")
    sizes = src.groupBy("grp", "size").agg(F.count("*").alias("rows"), F.min("__n").alias("__first"))

    def scan(p: pd.DataFrame) -> pd.DataFrame:
        """Of each size: the batch its first rows belong to, how many of them that still takes, and the rows of a batch it begins."""
        p = p.sort_values("size", ascending=False)
        out, at, left = [], -1, 0
        for s, n in zip(p["size"].tolist(), p["rows"].tolist(), strict=True):
            room = max(1, int(bound / max(1, s * s)))
            out.append((at, left, room))
            begun = -(-max(0, n - left) // room)
            at, left = at + begun, left + begun * room - n
        return p.drop(columns="rows").assign(**{c: [o[k] for o in out] for k, c in enumerate(("__at", "__left", "__room"))})

    kind = dict(src.dtypes)["grp"]
    heads = sizes.groupBy("grp").applyInPandas(scan, f"grp {kind}, size long, __first long, __at long, __left long, __room long")
    heads = heads.select(F.col("grp").alias("__grp"), F.col("size").alias("__size"), "__first", "__at", "__left", "__room")
    past = F.col("__n") - F.col("__first") - F.col("__left")
    batch = F.col("__at") + F.when(past < 0, 0).otherwise(1 + F.floor(past / F.col("__room"))).cast("long")
    joined = src.join(heads, F.col("grp").eqNullSafe(F.col("__grp")) & (F.col("size") == F.col("__size")))
    return joined.select("grp", "key", "size", batch.alias("batch"))


def padded_positions(df: DataFrame, batch: str, length: str) -> DataFrame:
    """Right-aligned positions of a batch: (all columns, pos, mask), mask 0 where padded."""
    m = df.withColumn("longest", F.max(length).over(Window.partitionBy(batch)))
    pos = m.select("*", F.explode(F.sequence(F.lit(0), F.col("longest") - 1)).alias("pos"))
    return pos.withColumn("mask", (F.col("pos") >= F.col("longest") - F.col(length)).cast("int"))


def smoothed(df: DataFrame, key: str, x: str, y: str, window: int = 5) -> DataFrame:
    """Cubic through noise: a local least-squares cubic of ``window`` points and its slope at each x, by group."""

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        p = p.sort_values("x")
        xs, ys = p["x"].to_numpy(), p["y"].to_numpy()
        value, slope = [], []
        for i in range(len(xs)):
            lo = max(0, min(i - window // 2, len(xs) - window))
            own = slice(lo, lo + window)
            degree = min(3, len(set(xs[own].tolist())) - 1)
            c = np.polynomial.polynomial.polyfit(xs[own] - xs[i], ys[own], degree)
            value.append(float(c[0]))
            slope.append(float(c[1]) if degree else 0.0)
        return pd.DataFrame({"key": p["key"], "x": xs, "value": value, "slope": slope})

    src = df.select(F.col(key).cast("string").alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return src.groupBy("key").applyInPandas(fit, "key string, x double, value double, slope double")


def superposed(df: DataFrame, by: str) -> DataFrame:
    """(by, rmsd, gdt, tm) of two models after optimal superposition; columns x y z and u v w."""

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        a, b = p[["x", "y", "z"]].to_numpy(float), p[["u", "v", "w"]].to_numpy(float)
        a, b = a - a.mean(0), b - b.mean(0)
        left, _, right = np.linalg.svd(a.T @ b)
        turn = left @ np.diag([1, 1, np.sign(np.linalg.det(left @ right))]) @ right
        d = np.linalg.norm(a @ turn - b, axis=1)
        scale = max(0.5, 1.24 * max(len(d) - 15, 0) ** (1 / 3) - 1.8)
        gdt = float(np.mean([(d <= s).mean() for s in (1, 2, 4, 8)]))
        return pd.DataFrame({by: [p[by].iloc[0]], "rmsd": [float(np.sqrt((d**2).mean()))], "gdt": [gdt], "tm": [float((1 / (1 + (d / scale) ** 2)).mean())]})

    kind = dict(df.dtypes)[by]
    return df.groupBy(by).applyInPandas(fit, f"{by} {kind}, rmsd double, gdt double, tm double")

