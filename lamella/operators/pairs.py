"""Pairs (i, j) within a group: all-pairs joins, masks, gathers, matrix algebra in long form."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions in a block of pairs, and how many of them are held against a whole block at a time.
BLOCK, STRIP = 2048, 64


def self_pairs(df: DataFrame, group: str, pos: str, columns: list[str], least: int = 1) -> DataFrame:
    """(group, i, j, a_*, b_*) for positions with j - i >= ``least``; the group is an equi key of the join."""
    a = df.select(group, F.col(pos).alias("i"), *[F.col(c).alias(f"a_{c}") for c in columns])
    b = df.select(group, F.col(pos).alias("j"), *[F.col(c).alias(f"b_{c}") for c in columns])
    return a.join(b, group).where(F.col("j") - F.col("i") >= least)


def _matrix(vectors: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(rows as doubles, the length of each): short ones are padded; length -1 where the vector or a component is null."""
    flat = vectors.combine_chunks()
    n = np.array([-1 if v is None else v for v in pc.list_value_length(flat).to_pylist()], np.int64)
    out = np.zeros((len(n), max(0, n.max(initial=0))))
    if n.max(initial=0) > 0:
        values = pc.list_flatten(flat)
        row = np.repeat(np.arange(len(n)), np.maximum(n, 0))
        at = np.arange(len(row)) - np.repeat(np.cumsum(np.maximum(n, 0)) - np.maximum(n, 0), np.maximum(n, 0))
        out[row, at] = values.cast("double").to_numpy(zero_copy_only=False)
        n[row[values.is_null().to_numpy(zero_copy_only=False)]] = -1
    return out, n


def _strips(i: np.ndarray, x: np.ndarray, n: np.ndarray, j: np.ndarray, y: np.ndarray, m: np.ndarray, decimals: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(which of ``i``, distances times 10^decimals rounded half up, separations j - i); NaN where vectors have no distance."""
    columns = np.ascontiguousarray(y.T)
    for at in range(0, len(i), STRIP):
        own = slice(at, at + STRIP)
        total = np.zeros((len(i[own]), len(j)))
        gap = np.empty_like(total)
        for k, c in enumerate(columns):  # in array order, as a sum over one pair would be
            np.subtract(x[own, k, None], c, out=gap)
            np.multiply(gap, gap, out=gap)
            total += gap
        d = np.sqrt(total, out=total) * 10.0**decimals
        whole = np.floor(d)
        d = whole + (d - whole >= 0.5)
        d[(n[own, None] != m) | (n[own, None] < 0)] = np.nan
        yield own, d, j - i[own, None]


def by_blocks(df: DataFrame, group: str, pos: str, vector: str, decimals: int, reduce: Callable, schema: str) -> DataFrame:
    """What ``reduce`` makes of the distances of all pairs of a group, block by block, without a row for each pair.

    Positions are cut into blocks of BLOCK; every pair of blocks is one task's group, so a row is sent once for each block
    of its group. ``reduce(group, i, j, strips)`` gets positions of two blocks (or twice of one) and, strip by strip,
    which of ``i``, the rounded distances times 10^decimals and the separations; it returns the columns of ``schema``."""
    own = df.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(pos).cast("long").alias("pos"), F.col(vector).alias("v"), F.floor((F.col(pos) - 1) / BLOCK).cast("int").alias("block"))
    last = own.groupBy("g").agg(F.max("block").alias("last"))
    sent = own.join(last, "g").withColumn("with", F.explode(F.sequence(F.lit(0), "last"))).select("g", "pos", "v", "block", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"))
    fields = [f.split() for f in schema.split(", ")]

    def run(t: pa.Table) -> pa.Table:
        x, n = _matrix(t["v"])
        at, block = t["pos"].to_numpy(), t["block"].to_numpy()
        a, b = block == t["low"][0].as_py(), block == t["high"][0].as_py()
        columns = reduce(t["g"][0], at[a], at[b], _strips(at[a], x[a], n[a], at[b], x[b], n[b], decimals))
        return pa.table(dict(zip([f[0] for f in fields], columns, strict=True)))

    return sent.groupBy("g", "low", "high").applyInArrow(run, schema)


def contacts(df: DataFrame, group: str, pos: str, vector: str, below: float, least: int, decimals: int = 5) -> DataFrame:
    """(group, pos, contacts): vectors of the group with a rounded distance below ``below`` and a separation of ``least`` or more."""
    kind, bound = dict(df.dtypes)[group], round(below * 10**decimals, 6)

    def count(g: pa.Scalar, i: np.ndarray, j: np.ndarray, strips: Iterator) -> list[pa.Array]:
        of_i, of_j = np.zeros(len(i), np.int64), np.zeros(len(j), np.int64)
        for own, d, gap in strips:
            near = (d < bound) & (gap >= least)
            of_i[own] = near.sum(1)
            of_j += near.sum(0)
        at, n = np.concatenate([i, j]), np.concatenate([of_i, of_j])
        return [pa.array([g.as_py()] * int((n > 0).sum()), g.type), pa.array(at[n > 0]), pa.array(n[n > 0])]

    done = by_blocks(df, group, pos, vector, decimals, count, f"g {kind}, pos long, n long")
    return done.groupBy(F.col("g").alias(group), "pos").agg(F.sum("n").alias("contacts"))


def separations(df: DataFrame, group: str, pos: str, vector: str, low: float, high: float, cap: int, decimals: int = 5) -> DataFrame:
    """(sep, n, mean): rounded distances between ``low`` and ``high`` averaged over all groups by the separation, at most ``cap``.

    Sums are of whole numbers of the last decimal, so their order changes nothing."""
    first, last = round(low * 10**decimals, 6), round(high * 10**decimals, 6)

    def add(g: pa.Scalar, i: np.ndarray, j: np.ndarray, strips: Iterator) -> list[pa.Array]:
        n, total = np.zeros(cap + 1, np.int64), np.zeros(cap + 1, np.int64)
        for _, d, gap in strips:
            kept = (d >= first) & (d <= last) & (gap >= 1)
            sep, whole = np.minimum(gap[kept], cap), d[kept].astype(np.int64)
            n += np.bincount(sep, minlength=cap + 1)
            total += _sums(sep, whole, cap + 1)
        return [pa.array(np.arange(cap + 1)[n > 0]), pa.array(n[n > 0]), pa.array(total[n > 0])]

    done = by_blocks(df, group, pos, vector, decimals, add, "sep long, n long, total long")
    mean = F.sum(F.col("total").cast("decimal(38,0)")).cast("double") / 10.0**decimals / F.sum("n")
    return done.groupBy("sep").agg(F.sum("n").alias("n"), mean.alias("mean"))


def _sums(place: np.ndarray, value: np.ndarray, size: int) -> np.ndarray:
    """Whole sums by place; the halves of a value stay exact in doubles."""
    high, low = np.divmod(value, 1 << 20)
    return (np.bincount(place, high, size).astype(np.int64) << 20) + np.bincount(place, low, size).astype(np.int64)


def in_band(df: DataFrame, least: int, most: int | None = None) -> DataFrame:
    gap = F.abs(F.col("j") - F.col("i"))
    return df.where(gap >= least) if most is None else df.where(gap.between(least, most))


def mirror(df: DataFrame) -> DataFrame:
    """Each pair in both orders."""
    other = df.withColumns({"i": F.col("j"), "j": F.col("i")})
    return df.unionByName(other.where("i <> j"))


def symmetrised(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean over both orders of a pair."""
    return df.groupBy(*keys, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.avg(value).alias(value))


def apc(df: DataFrame, keys: list[str], value: str, variant: str = "all") -> DataFrame:
    """Average-product correction x_ij - x_i. x_.j / x_..; ``variant``: all cells, or offdiag: means without
    the diagonal, which is not returned, less the smallest corrected value."""
    cells = df if variant == "all" else df.where("i <> j")
    row, col, all_ = Window.partitionBy(*keys, "i"), Window.partitionBy(*keys, "j"), Window.partitionBy(*keys)
    out = cells.withColumn("apc", F.col(value) - F.avg(value).over(row) * F.avg(value).over(col) / F.avg(value).over(all_))
    return out if variant == "all" else out.withColumn("apc", F.col("apc") - F.min("apc").over(all_))


def block_norms(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Frobenius norm of each block about its mean, and its largest row and column norms (row a, column b)."""
    mean = F.avg(value).over(Window.partitionBy(*keys))
    c = df.withColumn("sq", F.pow(F.col(value) - mean, F.lit(2)))
    rows = c.groupBy(*keys, "a").agg(F.sum("sq").alias("s")).groupBy(*keys).agg(F.sqrt(F.sum("s")).alias("frobenius"), F.sqrt(F.max("s")).alias("row_norm"))
    cols = c.groupBy(*keys, "b").agg(F.sum("sq").alias("s")).groupBy(*keys).agg(F.sqrt(F.max("s")).alias("col_norm"))
    return rows.join(cols, keys)


def zscore(df: DataFrame, value: str, by: list[str], sample: bool = False, eps: float = 0.0) -> DataFrame:
    w = Window.partitionBy(*by)
    sd = (F.stddev_samp if sample else F.stddev_pop)(value).over(w)
    return df.withColumn("z", F.when(sd > eps, (F.col(value) - F.avg(value).over(w)) / sd).otherwise(0.0))


def minmax(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn("scaled", F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(0.0))


def gather(df: DataFrame, mapping: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs carried through a position mapping (from, to) at both ends."""
    m1 = mapping.select(*keys, F.col("from").alias("i"), F.col("to").alias("new_i"))
    m2 = mapping.select(*keys, F.col("from").alias("j"), F.col("to").alias("new_j"))
    return df.join(m1, [*keys, "i"]).join(m2, [*keys, "j"]).drop("i", "j").withColumnsRenamed({"new_i": "i", "new_j": "j"})


def overlay(base: DataFrame, patch: DataFrame, value: str, offset: int = 0, add: bool = False) -> DataFrame:
    """Base values replaced by, or increased by, a sub-matrix that is shifted by ``offset``."""
    p = patch.select((F.col("i") + offset).alias("i"), (F.col("j") + offset).alias("j"), F.col(value).alias("patch"))
    new = F.col(value) + F.coalesce("patch", F.lit(0)) if add else F.coalesce("patch", value)
    return base.join(p, ["i", "j"], "left").withColumn(value, new).drop("patch")


def lookup_pairs(matrix: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matrix values at the wanted pairs, wanted pairs that the matrix lacks)."""
    return wanted.join(matrix, ["i", "j"]), wanted.join(matrix, ["i", "j"], "left_anti")


def clashes(df: DataFrame, distance: Column, cutoff: float) -> DataFrame:
    return df.withColumn("d", distance).where((F.col("i") != F.col("j")) & (F.col("d") < cutoff))


def largest_difference(a: DataFrame, b: DataFrame, value: str, tolerance: float) -> DataFrame:
    """One row: largest difference, where it is, cells that differ by more than the tolerance, cells of one side only."""
    x, y = a.select("i", "j", F.col(value).alias("x")), b.select("i", "j", F.col(value).alias("y"))
    d = x.join(y, ["i", "j"], "full").withColumn("d", F.abs(F.col("x") - F.col("y")))
    return d.agg(F.max("d").alias("most"), F.max_by(F.struct("i", "j"), "d").alias("at"), F.count_if(F.col("d") > tolerance).alias("beyond"), F.count_if(F.col("d").isNull()).alias("unmatched"))


def top_pairs(df: DataFrame, value: str, n: int, least: int) -> DataFrame:
    return in_band(df, least).orderBy(F.desc(value), "i", "j").limit(n)


def fill_distances(df: DataFrame, value: str = "d", self_value: float = 1e-4, next_value: float = 3.8) -> DataFrame:
    """The diagonal, and missing distances of neighbours."""
    gap = F.abs(F.col("i") - F.col("j"))
    return df.withColumn(value, F.when(gap == 0, self_value).when((gap == 1) & F.col(value).isNull(), next_value).otherwise(F.col(value)))
