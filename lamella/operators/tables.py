"""Joins by key, set operations, checks and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.storage import stored


def checked_join(a: DataFrame, b: DataFrame, on: list[str], same: str) -> tuple[DataFrame, DataFrame]:
    """(rows that agree in ``same``, rows that do not)."""
    j = a.join(b.withColumnRenamed(same, "__other"), on)
    ok = F.col(same).eqNullSafe(F.col("__other"))
    return j.where(ok).drop("__other"), j.where(~ok).withColumnRenamed("__other", f"other_{same}")


def semi(df: DataFrame, names: DataFrame, on: str) -> DataFrame:
    return df.join(names.select(on), on, "left_semi")


def anti(df: DataFrame, names: DataFrame, on: str) -> DataFrame:
    return df.join(names.select(on), on, "left_anti")


def zipped(a: DataFrame, b: DataFrame, order_a: list[str], order_b: list[str]) -> DataFrame:
    """Rows of equal number side by side. Numbers come from ranks within range partitions and their offsets,
    so that no task holds all rows."""
    return numbered(a, order_a, "n").join(numbered(b, order_b, "n"), "n")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds the row number from 1 in the total order."""
    # Written once: each run of a range partitioning samples its bounds anew.
    ranged = stored(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "numbered")
    local = ranged.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    sizes = sorted((r["__p"], r["n"]) for r in local.groupBy("__p").agg(F.count("*").alias("n")).collect())  # one row for each partition
    before, total = [], 0
    for p, n in sizes:
        before.append((p, total))
        total += n
    if not before:
        return df.withColumn(name, F.lit(0).cast("long"))
    offsets = F.broadcast(df.sparkSession.createDataFrame(before, "__p int, __before long"))
    return local.join(offsets, "__p").withColumn(name, F.col("__r") + F.col("__before")).drop("__p", "__r", "__before")


def updated(a: DataFrame, b: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Union by key; where both sides have a key, the right side's values stand."""
    x = a.select(*on, *[F.col(c).alias(f"__a_{c}") for c in columns])
    y = b.select(*on, *[F.col(c).alias(f"__b_{c}") for c in columns], F.lit(True).alias("__b"))
    return x.join(y, on, "full").select(*on, *[F.when(F.col("__b"), F.col(f"__b_{c}")).otherwise(F.col(f"__a_{c}")).alias(c) for c in columns])


def shorter_than(df: DataFrame, length: Column, most: int) -> tuple[DataFrame, Column]:
    """(rows kept, aggregate that counts the excluded ones)."""
    return df.where(length < most), F.count_if(length >= most)


def missing(required: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    return required.join(present, on, "left_anti")


def ragged(df: DataFrame, line: str, separator: str = r"\s+") -> DataFrame:
    """Smallest and largest number of columns, and whether they agree."""
    n = F.size(F.split(F.trim(line), separator))
    return df.agg(F.min(n).alias("low"), F.max(n).alias("high")).withColumn("even", F.col("low") == F.col("high"))


def finite_share(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """Counts of values that are null, not finite, or out of range."""
    v = F.col(value)
    bad = F.isnan(v) | v.isin(float("inf"), float("-inf"))
    return df.agg(F.count("*").alias("n"), F.count_if(v.isNull()).alias("nulls"), F.count_if(bad).alias("not_finite"), F.count_if(~bad & ~v.between(low, high)).alias("out_of_range"))


def frequent(df: DataFrame, key: str, least: int) -> DataFrame:
    """Rows whose key occurs ``least`` times or more."""
    return df.join(df.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select(key), key, "left_semi")


def draw(key: Column, seed: int) -> Column:
    """A number in (0, 1) from a key's hash: the same row draws the same number on every run."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 1) / F.lit(float((1 << 48) + 1))


def bernoulli(df: DataFrame, key: str, ratio: float, seed: int = 0, first: Column | None = None) -> DataFrame:
    """About ``ratio`` of the rows, the share itself off by up to 5 % as the seed has it; ``first`` rows stay."""
    jitter = 1 + 0.1 * (((seed * 2654435761) % 1000) / 1000 - 0.5)
    keep = draw(F.col(key), seed) < ratio * jitter
    return df.where(keep | first) if first is not None else df.where(keep)


def exactly(df: DataFrame, key: str, n: int, seed: int = 0, first: Column | None = None) -> DataFrame:
    """n rows without replacement, ``first`` rows among them, in key order."""
    order = F.when(first, -1.0).otherwise(draw(F.col(key), seed)) if first is not None else draw(F.col(key), seed)
    return df.withColumn("__u", order).orderBy("__u", key).limit(n).drop("__u").orderBy(key)


def weighted(df: DataFrame, key: str, weight: str, n: int, seed: int = 0) -> DataFrame:
    """n distinct rows with chances in proportion to weight (exponential keys)."""
    e = -F.log(draw(F.col(key), seed)) / F.col(weight)
    return df.where(F.col(weight) > 0).withColumn("__e", e).orderBy("__e", key).limit(n).drop("__e")


def one_per_group(df: DataFrame, group: str, key: str, weight: str, seed: int = 0) -> DataFrame:
    e = -F.log(draw(F.col(key), seed)) / F.col(weight)
    rn = F.row_number().over(Window.partitionBy(group).orderBy(e, key))
    return df.where(F.col(weight) > 0).withColumn("__rn", rn).where("__rn = 1").drop("__rn")


def with_replacement(df: DataFrame, key: str, weight: str, n: int, batch: int, seed: int = 0) -> DataFrame:
    """n draws in proportion to weight, in batches of ``batch``. The weights are few rows (one for each group to draw from)."""
    spark = df.sparkSession
    w = Window.orderBy(key)
    upto = df.withColumn("__to", F.sum(weight).over(w)).withColumn("__from", F.col("__to") - F.col(weight))
    total = df.agg(F.sum(weight)).first()[0] or 0.0
    draws = spark.range(n).select(F.col("id").alias("draw")).withColumn("__u", draw(F.col("draw"), seed) * F.lit(float(total)))
    hit = draws.join(F.broadcast(upto), (F.col("__u") > F.col("__from")) & (F.col("__u") <= F.col("__to")))
    return hit.withColumn("batch", F.floor(F.col("draw") / batch)).drop("__u", "__from", "__to")


def crops(df: DataFrame, key: str, length: str, size: int, seed: int = 0) -> DataFrame:
    """Adds start and stop of a stretch of at most ``size`` positions, drawn at random."""
    room = F.greatest(F.col(length) - size, F.lit(0))
    start = F.floor(draw(F.col(key), seed) * (room + 1)).cast("long")
    return df.withColumn("start", F.least(start, room)).withColumn("stop", F.least(F.col("start") + size, F.col(length)))


def split_evenly(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """Adds part: rows shuffled by hash and dealt out in turn, sizes that differ by one at most."""
    return numbered(df.withColumn("__u", draw(F.col(key), seed)), ["__u", key], "__n").withColumn("part", F.pmod(F.col("__n") - 1, F.lit(n))).drop("__u", "__n")


def from_density(df: DataFrame, key: str, energy: str, anchor: str, seed: int = 0) -> DataFrame:
    """One anchor for each key, chances in proportion to exp(-energy), by the cumulative sum and one draw."""
    by = Window.partitionBy(key)
    p = F.exp(-F.col(energy))
    c = df.withColumn("__c", F.sum(p).over(by.orderBy(anchor).rowsBetween(Window.unboundedPreceding, 0)) / F.sum(p).over(by))
    u = draw(F.col(key), seed)
    return c.where(F.col("__c") >= u - 1e-12).withColumn("__rn", F.row_number().over(by.orderBy(anchor))).where("__rn = 1").drop("__c", "__rn")
