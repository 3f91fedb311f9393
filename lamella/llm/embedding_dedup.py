"""Embedding near-dedup by iterative quantisation.

Fit: on a bounded sample of the vectors (``sample`` of the smallest id hashes) a rotation of
the principal components is learned that makes the signs balanced binary codes. Retrieve:
every vector's code is cut into substrings, one hash table each; vectors of a label
that agree in a substring are candidates, so pairs within Hamming distance 7 of 64 all are.
The rule is the same for tables of every size, so a link does not depend on how many other
vectors there are. Rerank: the cosine of each candidate pair, in double precision, from the original vectors.

Equal vectors of a label form a class first. Tables' buckets are cut into blocks of bounded
size; a pair counts in the first table that finds it, so its counts add up without listing
pairs, and each block gives only the links that join components.

Edge cases: a null label or a vector that is null, empty, zero or holds null or non-finite components
links with nothing; labels that are no whole numbers stand for themselves by a 64-bit hash of their text; vectors of other lengths are other labels; rows of equal id are vectors of
their own; component_id ignores null ids; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import batch, components, stored

SAMPLE, ROUNDS, BLOCK = 20_000, 50, 1024
#: Bits of a substring.
BITS = 8


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Each row as doubles; None where no cosine is defined."""
    out: list[np.ndarray | None] = []
    sizes = column.value_lengths().to_pylist()
    flat = column.flatten()
    hollow = flat.null_count > 0
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    at = 0
    for n in sizes:
        v = values[at : at + n] if n else None
        if n and hollow and flat.slice(at, n).null_count:
            v = None
        at += n or 0
        if v is not None and (not np.isfinite(v).all() or not v.any()):
            v = None
        out.append(v)
    return out


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max()  # first by the largest component: squares neither overflow nor vanish
    return v / np.sqrt(np.einsum("...i,...i", v, v))


def fit_rotation(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): signs of (x - mean) @ projection are the code."""
    mean = x.mean(0)
    _, _, axes = np.linalg.svd(np.cov(x - mean, rowvar=False) if len(x) > 1 else np.eye(x.shape[1]))
    space = axes[:bits].T
    low = (x - mean) @ space
    turn, _ = np.linalg.qr(np.random.default_rng(0).standard_normal((low.shape[1], low.shape[1])))
    for _ in range(ROUNDS):
        left, _, right = np.linalg.svd(np.where(low @ turn >= 0, 1.0, -1.0).T @ low)
        turn = (left @ right).T
    return mean, space @ turn


_CODED = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("sig1", pa.int64()), ("sig2", pa.int64()), ("dims", pa.int32()), ("code", pa.int64()), ("vector", pa.binary())])
_CODED_DDL = "vec_id long, label long, sig1 long, sig2 long, dims int, code long, vector binary"


def _encode(box) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, space = box.value
        for b in batches:
            labels = b.column(1)
            vectors = _vectors(b.column(2))
            kind = np.float32 if pa.types.is_float32(b.column(2).type.value_type) else np.float64
            sig1, sig2, dims, codes, raws = [], [], [], [], []
            for v, known in zip(vectors, labels.is_valid().to_pylist(), strict=True):
                if v is None or not known:
                    for x in (sig1, sig2, dims, codes, raws):
                        x.append(None)
                    continue
                raw = (v + 0.0).astype(kind).tobytes()
                digest = hashlib.blake2b(raw, digest_size=16).digest()
                low = np.zeros(len(mean))
                low[: min(len(v), len(mean))] = unit(v)[: len(mean)]
                bits = np.zeros(64, np.uint8)
                bits[: space.shape[1]] = (low - mean) @ space >= 0
                sig1.append(int.from_bytes(digest[:8], "little", signed=True))
                sig2.append(int.from_bytes(digest[8:], "little", signed=True))
                dims.append(len(v))
                codes.append(int(np.packbits(bits).view(">u8")[0].astype(np.uint64).view(np.int64)))
                raws.append(raw)
            yield batch(_CODED, b.column(0), labels.cast(pa.int64()), sig1, sig2, dims, codes, pa.array(raws, pa.binary()))

    return run


_SLOTS = pa.schema([("label", pa.int64()), ("dims", pa.int32()), ("tab", pa.int32()), ("slot", pa.int64()), ("node", pa.int64()), ("copies", pa.int64()), ("code", pa.int64()), ("vector", pa.binary())])
_SLOTS_DDL = "label long, dims int, tab int, slot long, node long, copies long, code long, vector binary"


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each class in its bucket of every table."""
    for b in batches:
        code = b.column(4).to_numpy(zero_copy_only=False).view(np.uint64)
        for t in range(64 // BITS):
            part = ((code >> np.uint64(BITS * t)) & np.uint64((1 << BITS) - 1)).astype(np.int64)
            yield batch(_SLOTS, b.column(0), b.column(1), np.full(len(code), t, np.int32), part, b.column(2), b.column(3), b.column(4), b.column(5))


_PART = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])


def _rerank(threshold: float) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        empty = pa.table([pa.array([], t.type) for t in _PART], schema=_PART)
        if table.num_rows < 2:
            return empty
        node, copies = table["node"].to_numpy(), table["copies"].to_numpy()
        code = table["code"].to_numpy().view(np.uint64)
        tab, dims = table["tab"][0].as_py(), table["dims"][0].as_py()
        side = table["side"].to_numpy()
        raw = b"".join(table["vector"].to_pylist())
        kind = np.float32 if len(raw) == 4 * dims * len(node) else np.float64
        x = np.frombuffer(raw, kind).astype(np.float64).reshape(len(node), dims)
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        links = np.zeros(len(node), np.int64)
        root = np.arange(len(node))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        joined = []
        left = np.flatnonzero(side != 2) if (side == 2).any() else np.arange(len(node))
        right = np.flatnonzero(side != 1) if (side == 2).any() else np.arange(len(node))
        twins = (side == 2).any()
        mask = np.uint64((1 << BITS) - 1)
        for at in np.array_split(left, max(1, len(left) // 256)):
            hit = x[at] @ x[right].T >= threshold
            if twins:
                hit &= node[at][:, None] != node[right][None, :]
            else:
                hit &= node[at][:, None] < node[right][None, :]
            i, j = np.nonzero(hit)
            if not len(i):
                continue
            a, b = at[i], right[j]
            differ = code[a] ^ code[b]
            first = np.ones(len(a), bool)
            for t in range(tab):
                first &= ((differ >> np.uint64(BITS * t)) & mask) != 0
            a, b = a[first], b[first]
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            for p, q in zip(a.tolist(), b.tolist(), strict=True):
                p, q = find(p), find(q)
                if p != q:
                    root[max(p, q)] = min(p, q)
                    joined.append((p, q))
        some = np.flatnonzero(links)
        nodes = np.concatenate([node[some], node[[p for p, _ in joined]]]) if joined else node[some]
        return pa.table([pa.array(nodes), pa.array(np.concatenate([links[some], np.zeros(len(joined), np.int64)])), pa.array([None] * len(some) + [int(node[q]) for _, q in joined], pa.int64())], schema=_PART)

    return run


def embedding_dedup(vectors: DataFrame, threshold: float = 0.93, sample: int = SAMPLE, probe_from: int = 4_000_000, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector. ``probe_from`` changes nothing any more: tables of every size are searched alike."""
    spark = vectors.sparkSession
    whole = dict(vectors.dtypes)[label_col] in ("tinyint", "smallint", "int", "bigint", "boolean")
    label = F.col(label_col).cast("long") if whole else F.when(F.col(label_col).isNotNull(), F.xxhash64(F.col(label_col).cast("string")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.col(vector_col).alias("vector"))
    fit_on = rows.where("vector is not null and label is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vector").toArrow()
    known = [unit(v) for c in fit_on["vector"].chunks for v in _vectors(c) if v is not None]
    if known:
        size = max(set(map(len, known)), key=lambda n: sum(len(v) == n for v in known))
        mean, space = fit_rotation(np.stack([v for v in known if len(v) == size]), min(64, size))
    else:
        mean, space = np.zeros(1), np.ones((1, 1))
    box = spark.sparkContext.broadcast((mean, space))
    coded = stored(rows.mapInArrow(_encode(box), _CODED_DDL), "codes")

    same = ["label", "dims", "sig1", "sig2"]
    # The node number of a class is a hash of what makes it one; vec_ids may be null or repeat.
    node = F.xxhash64(*same)
    classes = coded.where("code is not null").groupBy(*same, "code", "vector").agg(F.count("*").alias("copies")).withColumn("node", node)
    slots = classes.select("label", "dims", "node", "copies", "code", "vector").mapInArrow(_slots, _SLOTS_DDL)
    bucket = ["label", "dims", "tab", "slot"]
    large = slots.groupBy(*bucket).agg(F.count("*").alias("n")).where(F.col("n") > block).select(*bucket, F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    cut = slots.join(large, bucket, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("mine", F.pmod(F.hash("node"), F.col("blocks")))
    # Block i of a bucket meets block j once: as side 1 of (i, j), or side 2 of (j, i); side 0 is a block with itself.
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("mine", k).alias("i"), F.greatest("mine", k).alias("j"), F.when(k == F.col("mine"), 0).when(k > F.col("mine"), 1).otherwise(2).alias("side")))
    meet = cut.select(*bucket, "node", "copies", "code", "vector", F.explode(pair).alias("pair")).select(*bucket, "node", "copies", "code", "vector", "pair.*")
    found = stored(meet.groupBy(*bucket, "i", "j").applyInArrow(_rerank(threshold), "node long, links long, other long"), "links")

    roots = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    members = coded.withColumn("node", F.when(F.col("code").isNotNull(), node))
    per_class = members.where("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.min("vec_id").alias("low"))
    state = per_class.join(links, "node", "left").join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("node", "low", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    lowest = state.groupBy("root").agg(F.min("low").alias("component_id"))
    final = state.join(lowest, "root").select("node", "n_links", "component_id")
    alone = members.where("node is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    done = members.where("node is not null").join(final, "node").select("vec_id", "n_links", "component_id").unionAll(alone)
    return done.select(F.col("vec_id").alias(id_col), "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
