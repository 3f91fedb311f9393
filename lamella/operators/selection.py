"""Selections in tiers, blocked similarity, and scores of models against others."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.operators.graphs import components
from lamella.storage import discard, release, stored

#: Parts of the elements that are counted one after the other; classes in a block of comparisons.
SLICES, BLOCK = 2, 512


def greedy_tiers(df: DataFrame, by: list[str], evalue: str, order: list[str], member: str, cluster: str | None, tiers: Sequence[float], most: int, few: int, barred: Column | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """Adds tier and place. Of each group, rows within the narrowest tier that has any, in ``order``, the first of each cluster
    (of each member where it has none); at most ``most`` of them in the first tier, ``few`` in a wider one.

    A pass in order that skips what shares a cluster with a row taken before takes the first row of each cluster, so
    the choice needs no loop. ``barred`` rows are never taken, and none whose member ``allowed`` (a column of that name) lacks."""
    tier = F.lit(None).cast("int")
    for i, t in reversed(list(enumerate(tiers))):
        tier = F.when(F.col(evalue) <= t, i).otherwise(tier)
    live = df if allowed is None else df.join(allowed.select(member).distinct(), member, "left_semi")
    live = live.withColumn("tier", tier).where(F.col("tier").isNotNull())
    if barred is not None:
        live = live.where(~F.coalesce(barred, F.lit(False)))
    within = live.withColumn("__narrow", F.min("tier").over(Window.partitionBy(*by))).withColumn("tier", F.col("__narrow"))
    narrow = within.where(F.col(evalue) <= F.element_at(F.array(*[F.lit(float(t)) for t in tiers]), F.col("__narrow") + 1)).drop("__narrow")
    own = F.col(member).cast("string") if cluster is None else F.coalesce(F.concat(F.lit("c"), F.col(cluster).cast("string")), F.concat(F.lit("m"), F.col(member).cast("string")))
    first = narrow.withColumn("__own", own).withColumn("__k", F.row_number().over(Window.partitionBy(*by, "__own").orderBy(*order))).where("__k = 1").drop("__k", "__own")
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return first.withColumn("place", place).where(F.col("place") < F.when(F.col("tier") == 0, most).otherwise(few))


def _alike(percent: int) -> Callable[[pa.Table], pa.Table]:
    """(class, more): rows of other classes that are alike, of the pairs between two blocks or within one."""

    def run(t: pa.Table) -> pa.Table:
        sets = t["set"].combine_chunks()
        codes = np.unique(pc.list_flatten(sets).to_numpy(zero_copy_only=False), return_inverse=True)[1]
        n = pc.list_value_length(sets).to_numpy(zero_copy_only=False).astype(np.int64)
        start, members = np.cumsum(n) - n, t["members"].to_numpy()
        block = t["block"].to_numpy()
        low, high = block == t["low"][0].as_py(), block == t["high"][0].as_py()
        within = bool((low & high).any())
        left, right = np.flatnonzero(low), np.flatnonzero(high)
        own = codes[np.repeat(high, n)]
        bounds = np.cumsum(n[high]) - n[high]
        mark, more = np.zeros(codes.max(initial=0) + 1, bool), np.zeros(len(n), np.int64)
        for r in left.tolist():
            mine = codes[start[r] : start[r] + n[r]]
            mark[mine] = True
            common = np.add.reduceat(mark[own], bounds, dtype=np.int64)
            mark[mine] = False
            like = (100 * common >= percent * (n[r] + n[right] - common)) & (right != r)
            more[r] += members[right[like]].sum()
            if not within:
                more[right[like]] += members[r]
        return pa.table({"class": t["class"].filter(pa.array(more > 0)), "more": more[more > 0]})

    return run


def blocked_neighbours(df: DataFrame, key: str, elements: str, percent: int) -> DataFrame:
    """(key, n): rows whose set ``elements`` (an array) is like the row's own, itself included: 100 * common >= percent * union.

    Elements other than longs are told apart by 64-bit hashes, and so are sets. Equal sets are one class and count by their size.
    Sets that are alike share an element among the rarest n - ceil(percent n / 100) + 1 of each. Classes that such elements connect are a
    cluster; within a cluster all classes are compared, in blocks of BLOCK whose sizes allow it. Sets are made from ``df`` anew
    in each pass, and elements are counted slice by slice, so that no pass writes them all. Empty sets are like none but themselves."""
    spark, kind = df.sparkSession, dict(df.dtypes)[elements]
    given = F.coalesce(F.col(elements), F.array().cast(kind))
    hashed = given if kind == "array<bigint>" else F.transform(given, lambda e: F.xxhash64(e))
    # A generator after each step, or Spark would put the step in place of every use of it.
    rows = df.select(F.col(key).alias("key"), F.explode(F.array(F.sort_array(F.array_distinct(hashed)))).alias("set"))
    rows = rows.select("key", "set", F.size("set").alias("n"), F.explode(F.array(F.xxhash64("set", F.size("set")))).alias("class"))
    full = rows.where("n > 0")
    keys = stored(rows.select("key", F.when(F.col("n") > 0, F.col("class")).alias("class"), "n"), "rows")

    shared = []
    for k in range(SLICES):
        one = full.select("class", "n", F.explode(F.filter("set", lambda e: F.pmod(e, F.lit(SLICES)) == k)).alias("e"))
        counted = one.repartition("e").distinct().withColumn("f", F.count("*").over(Window.partitionBy("e")))
        shared.append(stored(counted.where("f > 1"), "shared"))
        release(spark)
    met = shared[0]
    for s in shared[1:]:
        met = met.unionAll(s)
    # Elements of one class come first in the order and meet nothing: of the others each class needs the rarest ``spare`` + 1 less those.
    order = met.groupBy("class", "n").agg(F.sort_array(F.collect_list(F.struct("f", "e"))).alias("order"))
    spare = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100).cast("int")
    need = order.withColumn("take", spare + 1 - (F.col("n") - F.size("order"))).where("take > 0")
    block = stored(need.select("class", F.explode(F.slice("order", F.lit(1), F.col("take"))).alias("x")).select("class", F.col("x.e").alias("e")), "blocks")
    for s in shared:
        discard(s)
    release(spark)

    first = block.groupBy("e").agg(F.min("class").alias("a"), F.max("class").alias("z")).where("a < z").select("e", "a")
    cluster = stored(components(block.join(first, "e").select("a", F.col("class").alias("b"))).select(F.col("node").alias("class"), "root"), "clusters")
    members = keys.where("class is not null").groupBy("class", "n").agg(F.count("*").alias("members"))
    place = F.row_number().over(Window.partitionBy("root").orderBy("n", "class")) - 1
    placed = members.join(cluster, "class").withColumn("block", F.floor(place / BLOCK).cast("int"))
    placed = stored(placed.withColumn("blocks", F.max("block").over(Window.partitionBy("root")) + 1), "placed")
    # Clusters of one block are packed together: they share no element that makes them alike.
    packs = max(1, placed.count() // BLOCK)
    spans = placed.where("blocks > 1").groupBy("root", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    other = spans.select("root", F.col("block").alias("high"), F.col("least").alias("from"))
    tasks = spans.join(other, "root").where((F.col("block") <= F.col("high")) & (100 * F.col("most") >= percent * F.col("from"))).select("root", F.col("block").alias("low"), "high")
    sent = placed.where("blocks > 1").select("root", "block").distinct().join(tasks, "root").where((F.col("block") == F.col("low")) | (F.col("block") == F.col("high")))
    sets = full.select("class", "set").join(placed, "class").groupBy("class", "root", "block", "blocks", "members").agg(F.first("set").alias("set"))
    sets = stored(sets, "sets")
    release(spark)
    zero = F.lit(0)
    small = sets.where("blocks = 1").select(F.pmod(F.xxhash64("root"), F.lit(packs)).alias("root"), zero.alias("low"), zero.alias("high"), F.lit(False).alias("large"), "block", "class", "members", "set")
    large = sets.where("blocks > 1").join(sent, ["root", "block"]).select("root", "low", "high", F.lit(True).alias("large"), "block", "class", "members", "set")
    more = small.unionAll(large).groupBy("root", "low", "high", "large").applyInArrow(_alike(percent), "class long, more long").groupBy("class").agg(F.sum("more").alias("more"))
    n = members.join(stored(more, "more"), "class", "left").select("class", (F.col("members") + F.coalesce("more", F.lit(0))).alias("n"))
    return keys.select("key", "class").join(n, "class", "left").select(F.col("key").alias(key), F.coalesce("n", F.lit(1)).cast("long").alias("n"))


def consensus_error(df: DataFrame, by: list[str], sets: str, weight: str, position: str, distance: str, scores: Sequence[str]) -> DataFrame:
    """(by, position, error, scores): squared distances and scores averaged over the models of each set by weight, then over the
    sets; error is the root of the mean square."""
    square = F.col(distance) * F.col(distance)
    mean = lambda v: F.sum(v * F.col(weight)) / F.sum(weight)
    one = df.groupBy(*by, sets, position).agg(mean(square).alias("__sq"), *[mean(F.col(s)).alias(s) for s in scores])
    return one.groupBy(*by, position).agg(F.sqrt(F.avg("__sq")).alias("error"), *[F.avg(s).alias(s) for s in scores])


def total_potential(df: DataFrame, by: list[str], terms: Sequence[Column]) -> DataFrame:
    """(by, score, n): the sum of all terms, those that are null left out, and how many were not."""
    score = F.sum(sum((F.coalesce(t, F.lit(0.0)) for t in terms), F.lit(0.0)))
    return df.groupBy(*by).agg(score.alias("score"), F.sum(sum((t.isNotNull().cast("int") for t in terms), F.lit(0))).alias("n"))


def per_residue(scores: Sequence[Column], weights: Sequence[Column], residues: Column) -> Column:
    """Array of the sum and the single unweighted scores, each over the number of residues."""
    one = [F.try_divide(F.try_divide(s, w), residues) for s, w in zip(scores, weights, strict=True)]
    return F.array(sum(one[1:], one[0]), *one)


def per_restraint(models: DataFrame, restraints: DataFrame, by: list[str], energy: str) -> DataFrame:
    """Models with mean_energy, their energy over the number of restraints of their group, lowest first."""
    n = restraints.groupBy(*by).agg(F.count("*").alias("__n"))
    out = models.join(n, by).withColumn("mean_energy", F.col(energy) / F.col("__n")).drop("__n")
    return out.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("mean_energy")) - 1)


def alignment_features(joined: DataFrame, template: DataFrame, keys: list[str], columns: Sequence[str], length: Column) -> DataFrame:
    """(keys, j, matched, same, share, columns) for every matched query position of alignments from ``positional_join``:
    the template's columns at position i, null where it has none, whether the letters agree, and the matched share of the query."""
    m = joined.where("i is not null and j is not null")
    share = F.count("*").over(Window.partitionBy(*keys)) / length
    return m.join(template.select(*keys, "i", *columns), [*keys, "i"], "left").select(*keys, "j", F.lit(1).alias("matched"), (F.col("a") == F.col("b")).cast("int").alias("same"), share.alias("share"), *columns)


def consistent_models(models: DataFrame, label: str, kinds: Sequence[str]) -> DataFrame:
    """(label, models, consistent): whether all models of a label agree in ``kinds``."""
    same = [F.count_distinct(F.coalesce(F.col(k).cast("string"), F.lit("<null>"))) == 1 for k in kinds]
    all_same = same[0]
    for s in same[1:]:
        all_same = all_same & s
    return models.groupBy(label).agg(F.count("*").alias("models"), all_same.alias("consistent"))
