"""Suffix-array dedup over bytes.

A sparse suffix array: the suffixes that can have a twin are those whose leading
token, the anchor of their first ``length`` bytes, occurs elsewhere in another
context; all others are settled by counts (see ``repeats``). Splitters sampled
by Spark range-partition these suffixes by leading token (and by owner, so that
a very common token spreads over several buckets), once for all steps. Each bucket sorts its suffixes
with a multikey quicksort over 8-byte keys and compares neighbours. Suffixes of
the first and the last token of a bucket may have twins in another bucket; they
are compared across boundaries, first in slices by the bytes that a slice has in
common, then in finer slices, then one by one by their fingerprints.

Edge cases: null and empty texts have no bytes and keep none; texts shorter than
``length`` bytes lose nothing; rows equal in id and text each count as a document;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm import windows as W
from lamella.llm.common import batch, buffer, keyed, parts, stored
from lamella.llm.repeats import KEY, Unit, cut, open_runs, runs_of, sort_out

_PIECES = "anchor long, key_id long, key_h long, first int, n int, copies long, context binary"
_EDGES = pa.schema([("window", pa.int64()), ("key_id", pa.int64()), ("key_h", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("copies", pa.int64())])
_SLICES_DDL = "core long, bucket int, key_id long, key_h long, first int, n int, copies long, far int, context binary"
_SLICE_ROWS = pa.schema([("core", pa.int64()), ("bucket", pa.int32()), ("key_id", pa.int64()), ("key_h", pa.int64()), ("first", pa.int32()), ("n", pa.int32()), ("copies", pa.int64()), ("far", pa.int32()), ("context", pa.binary())])
#: Suffixes of a slice, and of the finer slices of those that met.
SLICE, FINE = 64, 16
_SUFFIXES_AT_ONCE = 1 << 18


def _pieces(length: int) -> Callable:
    """The bytes that the windows of each undecided run cover."""
    schema = pa.schema([("anchor", pa.int64()), ("key_id", pa.int64()), ("key_h", pa.int64()), ("first", pa.int32()), ("n", pa.int32()), ("copies", pa.int64()), ("context", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = b.column(4)
            counts = runs.value_lengths().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(counts)), counts)
            flat = runs.flatten()
            anchor, first, n, copies = (flat.field(i) for i in range(4))
            data, offsets = buffer(b.column(2))
            raw, start = memoryview(data), offsets[doc] + first.to_numpy(zero_copy_only=False)
            end = start + n.to_numpy(zero_copy_only=False) + length - 1
            context = pa.array([bytes(raw[s:e]) for s, e in zip(start.tolist(), end.tolist(), strict=True)], pa.binary())
            yield batch(schema, anchor, b.column(0).take(pa.array(doc)), b.column(1).take(pa.array(doc)), first, n, copies, context)

    return run


def multikey_sort(keys: np.ndarray, group: np.ndarray, at: np.ndarray, depth: int, step: int = 8) -> np.ndarray:
    """Multikey quicksort of the suffixes at ``at``: ``keys[p]`` holds ``step`` bytes from p on.

    Sorts by group and leading key, then only what is tied by the next key, ``depth`` keys deep.
    Returns for each suffix a rank; equal ranks are suffixes equal to that depth. Suffixes that
    nothing ties any more get rank -1: their order needs no more comparison.
    """
    rank = np.full(len(at), -1, np.int64)
    live = np.arange(len(at))
    label = group
    for level in range(depth):
        key = keys[at[live] + level * step].astype(np.uint64, copy=False)
        order = np.lexsort((key, label))
        live, key, label = live[order], key[order], label[order]
        new = np.ones(len(live), bool)
        new[1:] = (key[1:] != key[:-1]) | (label[1:] != label[:-1])
        label = np.cumsum(new)
        tied = ~new
        tied[:-1] |= ~new[1:]
        live, label = live[tied], label[tied]
        if not len(live):
            return rank
    rank[live] = label
    return rank


def _expand(data: np.ndarray, offsets: np.ndarray, n: np.ndarray):
    """(piece of each suffix, its place in data)."""
    piece = np.repeat(np.arange(len(n)), n)
    inner = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
    return piece, offsets[:-1][piece] + inner, inner


def _bucket(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray] | None:
    """The bucket and the order of its rows by token."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return None
    table = pa.Table.from_batches(got).combine_chunks()
    return table, np.argsort(table["anchor"].to_numpy(), kind="stable")


def _token_places(data: np.ndarray, offsets: np.ndarray, anchor: np.ndarray, gram: int) -> np.ndarray:
    """The leftmost place of its token in each piece."""
    prefix, anchor = W.Prefix(W.byte_values(data)), anchor.view(np.uint64)
    of = np.repeat(np.arange(len(anchor)), np.diff(offsets))[: len(data) - gram + 1]
    match = np.flatnonzero(prefix.every(gram) == anchor[of])
    match = match[match + gram <= offsets[of[match] + 1]]
    return match[np.searchsorted(match, offsets[:-1])]


def _portions(data: np.ndarray, offsets: np.ndarray, n: np.ndarray, anchor: np.ndarray, gram: int):
    """(piece, place, number in its piece) of all suffixes, in portions such that equal suffixes share one.

    Equal suffixes stand equally far before their token, so many pieces of one token
    are taken a range of distances at a time.
    """
    if n.sum() <= 2 * _SUFFIXES_AT_ONCE or anchor[0] != anchor[-1]:
        yield _expand(data, offsets, n)
        return
    far = np.zeros(len(n), np.int64)
    for lo in range(0, len(n), 2000):
        own = offsets[lo : lo + 2001]
        far[lo : lo + 2000] = _token_places(data[own[0] : own[-1]], own - own[0], anchor[lo : lo + 2000], gram) - (own[:-1] - own[0])
    step = max(1, _SUFFIXES_AT_ONCE // len(n))
    for d in range(int((far - n).min()) + 1, int(far.max()) + 1, step):
        begin, stop = np.maximum(far - d - step + 1, 0), np.minimum(far - d + 1, n)
        some = np.flatnonzero(stop > begin)
        piece, place, inner = _expand(data, np.append(offsets[some] + begin[some], 0), (stop - begin)[some])
        yield some[piece], place, inner + begin[some][piece]


def _inside(length: int, gram: int) -> Callable:
    """Windows that repeat within the bucket: rows of _SLICE_ROWS without a core, one for each stretch of ``n`` windows."""
    depth = -(-length // 8)

    def run(table: pa.Table, order: np.ndarray) -> Iterator[pa.RecordBatch]:
        anchor, n = table["anchor"].to_numpy()[order], table["n"].to_numpy().astype(np.int64)[order]
        new = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        total = np.concatenate([[0], np.cumsum(n)])
        edges = [*new.tolist(), len(anchor)]
        lo = 0
        while lo < len(edges) - 1:
            hi = lo + 1
            while hi < len(edges) - 1 and total[edges[hi + 1]] - total[edges[lo]] <= _SUFFIXES_AT_ONCE:
                hi += 1
            rows = order[edges[lo] : edges[hi]]
            lo = hi
            if len(rows) < 2:
                continue
            part = table.take(pa.array(rows)).combine_chunks()
            data, offsets = buffer(part["context"])
            own, copies, first = part["n"].to_numpy().astype(np.int64), part["copies"].to_numpy(), part["first"].to_numpy()
            group = part["anchor"].to_numpy()
            # The eight bytes from each place on as one number, read where they stand.
            keys = np.ndarray(len(data), ">u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
            for piece, at, inner in _portions(data, offsets, own, group, gram):
                if length % 8:  # the last key overlaps the one before it, so that all keys together cover exactly ``length`` bytes
                    rank = multikey_sort(keys, group[piece], at, depth - 1)
                    tied = np.flatnonzero(rank >= 0)
                    last = multikey_sort(keys, rank[tied], at[tied] + length - 8, 1)
                    rank = np.full(len(at), -1, np.int64)
                    rank[tied] = last
                else:
                    rank = multikey_sort(keys, group[piece], at, depth)
                hit = np.flatnonzero((rank >= 0) & (copies[piece] == 1))
                if len(hit):
                    new = np.append(True, (piece[hit][1:] != piece[hit][:-1]) | (hit[1:] != hit[:-1] + 1))
                    begin, end = hit[new], hit[np.append(new[1:], True)]
                    own_row, none = piece[begin], [None] * len(begin)
                    at_first = (first[own_row] + inner[begin]).astype(np.int32)
                    yield batch(_SLICE_ROWS, none, none, part["key_id"].to_numpy()[own_row], part["key_h"].to_numpy()[own_row], at_first, (end - begin + 1).astype(np.int32), copies[own_row], none, none)

    return run


def _sliced(width: int, length: int, data: np.ndarray, offsets: np.ndarray, far: np.ndarray, n: np.ndarray, prefix: W.Prefix, own: np.ndarray, bucket: np.ndarray, key_id: np.ndarray, key_h: np.ndarray, first: np.ndarray, copies: np.ndarray) -> pa.RecordBatch:
    """Suffixes in slices of ``width`` by their distance from the token; ``far``: distance of a row's first suffix (that of its last is n - 1 less)."""
    token = offsets[:-1] + far
    low, high = (far - n + 1) // width, far // width
    many = high - low + 1
    piece = np.repeat(np.arange(len(n)), many)
    k = low[piece] + np.arange(len(piece)) - np.repeat(np.cumsum(many) - many, many)
    core = token[piece] - width * k
    begin = np.maximum(core - width + 1, offsets[:-1][piece])
    stop = np.minimum(core, offsets[:-1][piece] + n[piece] - 1)  # the slice's last suffix in this row
    mark = W.mix(prefix.stretch(core, core + length + 1 - width) ^ own[piece] ^ W.mix(k.astype(np.uint64)))
    raw = memoryview(data)
    context = pa.array([bytes(raw[s:e]) for s, e in zip(begin.tolist(), (stop + length).tolist(), strict=True)], pa.binary())
    at = (first[piece] + (begin - offsets[:-1][piece])).astype(np.int32)
    return batch(_SLICE_ROWS, mark.view(np.int64), bucket[piece], key_id[piece], key_h[piece], at, (stop - begin + 1).astype(np.int32), copies[piece], (token[piece] - begin).astype(np.int32), context)


def _edge_slices(length: int, gram: int) -> Callable:
    """Suffixes of the first and the last token of a bucket, in slices of SLICE by their distance from the token.

    All suffixes of a slice share its core, the ``length + 1 - SLICE`` bytes that each of them covers;
    equal suffixes lie in slices of equal core. ``context``: the bytes that the slice's suffixes cover.
    """

    def run(table: pa.Table, order: np.ndarray) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        anchor, bucket = table["anchor"].to_numpy(), TaskContext.get().partitionId()
        edge = order[np.isin(anchor[order], anchor[order[[0, -1]]])]
        for at in np.array_split(edge, len(edge) // 2000 + 1):
            part = table.take(pa.array(at)).combine_chunks()
            data, offsets = buffer(part["context"])
            n, own = part["n"].to_numpy().astype(np.int64), part["anchor"].to_numpy().view(np.uint64)
            prefix = W.Prefix(W.byte_values(data))
            token = _token_places(data, offsets, own, gram)
            key_id, key_h, first, copies = (part[c].to_numpy() for c in ("key_id", "key_h", "first", "copies"))
            yield _sliced(SLICE, length, data, offsets, token - offsets[:-1], n, prefix, own, np.full(len(n), bucket, np.int32), key_id, key_h, first, copies)

    return run


def _settle_buckets(length: int, gram: int) -> Callable:
    """What repeats within a bucket, and the slices at its edges: both of one run, as each run may place the splitters elsewhere."""
    inside, edges = _inside(length, gram), _edge_slices(length, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _bucket(batches)
        if got is not None:
            yield from inside(*got)
            yield from edges(*got)

    return run


def _finer_slices(length: int) -> Callable:
    """Slices of SLICE cut into slices of FINE, whose cores are longer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                b = whole.slice(lo, 2000)
                data, offsets = buffer(b.column(8))
                core, bucket, key_id, key_h, first, n, copies, far = (b.column(i).to_numpy(zero_copy_only=False) for i in range(8))
                yield _sliced(FINE, length, data, offsets, far.astype(np.int64), n.astype(np.int64), W.Prefix(W.byte_values(data)), core.view(np.uint64), bucket, key_id, key_h, first, copies)

    return run


def _open_slices(length: int) -> Callable:
    """Suffixes of slices whose core stands in several buckets: equal ones of this batch are settled as spans
    (window null), and of each different suffix one row remains to compare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                b = whole.slice(lo, 4096)
                data, offsets = buffer(b.column(6))
                n, copies = b.column(4).to_numpy(zero_copy_only=False).astype(np.int64), b.column(5).to_numpy(zero_copy_only=False)
                piece, where, inner = _expand(data, offsets, n)
                window = W.mix(W.Prefix(W.byte_values(data)).stretch(where, where + length) ^ b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)[piece])
                _, one, of = np.unique(window, return_index=True, return_inverse=True)
                seen = np.bincount(of, copies[piece]).astype(np.int64)
                first = b.column(3).to_numpy(zero_copy_only=False)[piece] + inner.astype(np.int32)
                ids, hs = b.column(1).to_numpy(zero_copy_only=False)[piece], b.column(2).to_numpy(zero_copy_only=False)[piece]
                sure = np.flatnonzero((seen[of] > 1) & (copies[piece] == 1))
                if len(sure):
                    new = np.append(True, (piece[sure][1:] != piece[sure][:-1]) | (sure[1:] != sure[:-1] + 1))
                    begin, end = sure[new], sure[np.append(new[1:], True)]
                    yield batch(_EDGES, pa.nulls(len(begin), pa.int64()), ids[begin], hs[begin], first[begin], first[end] + length, np.zeros(len(begin), np.int64))
                yield batch(_EDGES, window[one].view(np.int64), ids[one], hs[one], first[one], first[one] + length, seen)

    return run


#: A bucket holds about so many bytes of undecided runs, however many there are in all: a task loads one bucket.
BUCKET_UNITS = 8 << 20


def suffix_dedup(docs: DataFrame, length: int = 200, gram: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept): ``spans`` holds start and end byte of each maximal
    removed run in turn, ``kept`` the other bytes."""
    if not 8 <= gram <= length - SLICE:
        raise ValueError("gram must be between 8 and length - 64")
    unit = Unit(False, length, gram)
    rows = keyed(docs, id_col, text_col)
    spans, classes = sort_out(runs_of(rows, unit), unit)
    pieces = stored(open_runs(classes, rows, _pieces(length), _PIECES), "pieces")
    units = pieces.agg(F.sum(F.col("n") + (length - 1)).cast("long")).first()[0] or 0
    buckets = pieces.repartitionByRange(max(parts(docs.sparkSession), -(-units // BUCKET_UNITS)), "anchor", F.hash("key_id", "key_h", "first"))
    # Written once: a second run would sample other splitters, and twins on either side of a moved one would never meet.
    settled = stored(buckets.mapInArrow(_settle_buckets(length, gram), _SLICES_DDL), "buckets")
    inside = settled.where("core is null").select(*KEY, "first", (F.col("first") + F.col("n") + (length - 1)).alias("last"))
    slices = settled.where("core is not null")

    def met(table: DataFrame) -> DataFrame:
        """The slices whose core stands in several buckets."""
        both = table.groupBy("core").agg(F.min("bucket").alias("low"), F.max("bucket").alias("high")).where("low < high").select("core")
        return table.join(both, "core")

    finer = stored(met(slices).select(*_SLICE_ROWS.names).mapInArrow(_finer_slices(length), _SLICES_DDL), "slices")
    edge = met(finer).select("core", *KEY, "first", "n", "copies", "context").mapInArrow(_open_slices(length), "window long, key_id long, key_h long, first int, last int, copies long")
    edge = stored(edge, "edges")
    agreed = edge.where("window is not null").groupBy("window").agg(F.sum("copies").alias("seen")).where("seen > 1").select("window")
    across = edge.where("copies = 1").join(agreed, "window").select(*KEY, "first", "last").unionAll(edge.where("window is null").select(*KEY, "first", "last"))
    done = cut(rows, spans.unionAll(inside).unionAll(across), unit)
    return done.select(F.col("row_id").alias(id_col), F.col("n_units").alias("n_bytes"), "n_removed", "spans", "kept")
