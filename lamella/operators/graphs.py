"""Connected components of edge lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.storage import discard, release
from lamella.storage import stored as _stored


def stored(df: DataFrame, name: str) -> DataFrame:
    out = _stored(df, name)
    release(df.sparkSession)
    return out


#: Up to so many edges (16 bytes each) one task finds the components; beyond, rounds of joins do.
ONE_TASK_EDGES = 1_000_000


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    edges = pa.Table.from_batches(got)
    nodes, ends = np.unique(np.concatenate([edges["a"].to_numpy(), edges["b"].to_numpy()]), return_inverse=True)
    a, b = ends[: edges.num_rows], ends[edges.num_rows :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for end in (a, b, root[a], root[b]):
            np.minimum.at(new, end, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "root"])


def components(edges: DataFrame, left: str = "a", right: str = "b", one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """Connected components of an edge list: (node, root), root the smallest node that links reach.

    A list of at most ``one_task`` edges is read by one task. In a longer one every round lets each
    node hang on the smallest node that it or its neighbours know (large star, then small star) and
    writes the edges to the shared folder; only sums that tell whether a round changed
    anything reach the driver.
    """
    one = edges.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b")).where("a < b").distinct()
    edges = stored(one, "edges")
    if edges.count() <= one_task:
        return edges.coalesce(1).mapInArrow(_in_one_task, "node long, root long")
    sums = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a")))
    state = edges.agg(sums).first()[0]
    while True:
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b")
        large = stored(large.distinct(), "edges")
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b")
        small = small.select(F.col("m").alias("a"), F.col("b")).unionAll(small.where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b")))
        small = stored(small.distinct(), "edges")
        before, state = state, small.agg(sums).first()[0]
        discard(edges)
        discard(large)
        edges = small
        if before == state:
            break
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionAll(edges.select(F.col("a").alias("node"), F.col("a").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
