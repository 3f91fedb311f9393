"""Benchmark decontamination by a prefix-filtered set join over item-sized windows.

A window is ``window`` consecutive words of an item (the whole item where it is
shorter). Its tokens are its word shingles, ordered by rarity in the corpus;
full containment makes the rarest one a necessary token, so a document is joined
to a window only through that token. The length and positional bounds say where
the window would have to lie; there its words are compared one by one.

The benchmark is cut into slices of at most ``slice_chars`` characters, each slice
indexed and broadcast on its own, and the tasks that mark words load one slice at a time. The tasks that
count hold 8 bytes for each distinct shingle of the whole benchmark, and the driver all its slices while it
orders their tokens (some 60 bytes for each of its words): a benchmark is bounded by the driver's memory, documents are not.

Edge cases: null and blank texts have no words and are not contaminated; an item
without words is no window; an item with a null id still marks words and is listed
as "null"; items of one id are listed once; an empty benchmark hits nothing; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm import windows as W
from lamella.llm.common import batch, chunks, filtered, keyed

#: Everything but 0-9, a-z and bytes above 0x7F separates words; A-Z is lower-cased first.
SEPARATOR = np.ones(256, bool)
SEPARATOR[128:] = SEPARATOR[48:58] = SEPARATOR[97:123] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_FILTER_BITS = 22


def words(data: np.ndarray, offsets: np.ndarray):
    """(hash of each word, first word of each document)."""
    low = LOWER[data]
    starts, ends = W.word_bounds(low, offsets, SEPARATOR)
    return W.word_values(low, starts, ends), np.searchsorted(starts, offsets)


@dataclass
class Index:
    """Windows of one slice of the benchmark. ``tokens``: the sorted hashes of necessary tokens by
    shingle size; ``own``: for each the stretch of ``by_token``, window numbers; ``offset``: where in the window the token lies."""

    length: np.ndarray
    values: np.ndarray
    items: np.ndarray
    item_from: np.ndarray
    names: list[str]
    shingle: int
    tokens: dict[int, np.ndarray] | None = None
    own: dict[int, np.ndarray] | None = None
    by_token: dict[int, np.ndarray] | None = None
    offset: np.ndarray | None = None

    def shingles(self) -> dict[int, np.ndarray]:
        """Hashes of all shingles of every window, by shingle size: (window, position)."""
        out = {}
        for size in {min(self.shingle, int(n)) for n in np.unique(self.length)}:
            rows = np.flatnonzero(np.minimum(self.length, self.shingle) == size)
            out[size] = (rows, np.stack([_hash(self.values[rows, p : p + size]) for p in range(self.values.shape[1] - size + 1)], 1))
        return out


def _hash(rows: np.ndarray) -> np.ndarray:
    """The hash Prefix gives a stretch of these values."""
    flat = np.ascontiguousarray(rows).ravel()
    at = np.arange(rows.shape[0]) * rows.shape[1]
    return W.Prefix(flat).stretch(at, at + rows.shape[1])


def build_index(items: list[tuple[str, str]], window: int, shingle: int) -> Index:
    texts = pa.array([t for _, t in items], pa.large_string())
    rows: list[tuple] = []
    for row, stop, data, offsets in chunks(texts, 1 << 24):
        values, bounds = words(data, offsets)
        for i in range(row, stop):
            own = values[bounds[i - row] : bounds[i - row + 1]]
            size = min(window, len(own))
            if size:
                rows += [(i, size, own[p : p + size]) for p in range(len(own) - size + 1)]
    seen: dict[bytes, int] = {}
    owners: list[set] = []
    kept = []
    for i, size, value in rows:
        key = value.tobytes()
        if key not in seen:
            seen[key] = len(kept)
            kept.append(value)
            owners.append(set())
        owners[seen[key]].add(items[i][0])
    names = sorted({x for o in owners for x in o})
    number = {x: i for i, x in enumerate(names)}
    table = np.zeros((len(kept), window), np.uint64)
    for i, v in enumerate(kept):
        table[i, : len(v)] = v
    flat = [number[x] for o in owners for x in sorted(o)]
    return Index(np.array([len(v) for v in kept], np.int64), table, np.array(flat, np.int64), np.concatenate([[0], np.cumsum([len(o) for o in owners])]).astype(np.int64), names, shingle)


def _sieve(tokens: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << _FILTER_BITS, bool)
    out[(tokens >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
    return out


def _found(grams: np.ndarray, tokens: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, token number) of every gram that is a token."""
    at = np.flatnonzero(sieve[(grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
    where = np.searchsorted(tokens, grams[at])
    where[where == len(tokens)] = 0
    ok = tokens[where] == grams[at]
    return at[ok], where[ok]


def _stretches(prefix: W.Prefix, n: int, size: int) -> np.ndarray:
    at = np.arange(max(0, n - size + 1))
    return prefix.stretch(at, at + size)


def _count(boxes: list) -> Callable:
    """How often each shingle of the benchmark occurs in the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("slice", pa.int32()), ("size", pa.int32()), ("token", pa.int64()), ("n", pa.int64())])
        totals = {}
        tables = [{s: np.unique(h) for s, (_, h) in box.value.shingles().items()} for box in boxes]
        sieves = [{s: _sieve(t) for s, t in table.items()} for table in tables]
        for b in batches:
            for _, _, data, offsets in chunks(b.column(0)):
                values, _ = words(data, offsets)
                if not len(values):
                    continue
                prefix, grams = W.Prefix(values), {}
                for i, table in enumerate(tables):
                    for size, tokens in table.items():
                        if size not in grams:
                            grams[size] = _stretches(prefix, len(values), size)
                        _, where = _found(grams[size], tokens, sieves[i][size])
                        totals[i, size] = totals.get((i, size), 0) + np.bincount(where, minlength=len(tokens))
        for (i, size), n in totals.items():
            hit = np.flatnonzero(n)
            yield batch(schema, np.full(len(hit), i, np.int32), np.full(len(hit), size, np.int32), tables[i][size][hit].view(np.int64), n[hit])

    return run


def order_by_rarity(index: Index, count: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
    """Choose the necessary token of every window: its rarest shingle, the leftmost among equals.
    A window with a shingle that the corpus lacks cannot occur and joins nothing."""
    index.offset = np.zeros(len(index.length), np.int64)
    index.tokens, index.own, index.by_token = {}, {}, {}
    for size, (rows, hashes) in index.shingles().items():
        known, often = count.get(size, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
        freq = np.zeros(hashes.shape, np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            freq = np.where(known[at] == hashes, often[at], 0)
        inside = np.arange(hashes.shape[1])[None, :] <= (index.length[rows] - size)[:, None]
        freq = np.where(inside, freq, np.iinfo(np.int64).max)
        best = freq.argmin(1)
        possible = freq[np.arange(len(rows)), best] > 0
        index.offset[rows] = best
        token, live = hashes[np.arange(len(rows)), best][possible], rows[possible]
        order = np.argsort(token, kind="stable")
        tokens, first = np.unique(token[order], return_index=True)
        index.tokens[size], index.own[size], index.by_token[size] = tokens, np.append(first, len(order)), live[order]


def _occurrences(index: Index, sieves: dict, values: np.ndarray, bounds: np.ndarray):
    """(document, first word, window) of every occurrence."""
    prefix = W.Prefix(values)
    docs, starts, found = [], [], []
    for size, tokens in index.tokens.items():
        if not len(tokens) or len(values) < size:
            continue
        at, token = _found(_stretches(prefix, len(values), size), tokens, sieves[size])
        if not len(at):
            continue
        own = index.own[size]
        many = own[token + 1] - own[token]
        each = np.repeat(np.arange(len(at)), many)
        window = index.by_token[size][np.repeat(own[token], many) + np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)]
        start = at[each] - index.offset[window]
        doc = np.searchsorted(bounds, at[each], side="right") - 1
        ok = (start >= bounds[doc]) & (start + index.length[window] <= bounds[doc + 1])
        start, window, doc = start[ok], window[ok], doc[ok]
        same = np.ones(len(start), bool)
        for p in range(index.values.shape[1]):
            same &= (p >= index.length[window]) | (values[np.minimum(start + p, len(values) - 1)] == index.values[window, p])
        docs.append(doc[same])
        starts.append(start[same])
        found.append(window[same])
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(docs), join(starts), join(found)


OUT = pa.schema([("row_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.int32()))])


class Marker:
    """Finds occurrences in texts, one slice of the benchmark after the other; the only slice of a small one stays loaded."""

    def __init__(self, boxes: list):
        self.boxes, self.kept = boxes, None

    def slices(self) -> Iterator[tuple[Index, dict]]:
        if self.kept:
            yield self.kept
            return
        for box in self.boxes:
            index = box.load_from_path(box._path) if getattr(box, "_path", None) else box.value
            found = index, {s: _sieve(t) for s, t in index.tokens.items()}
            if len(self.boxes) == 1:
                self.kept = found
            yield found

    def mark(self, texts: pa.Array) -> Iterator[tuple]:
        """(first row, row after the last, bounds, mask of hit words, item names of each document)."""
        pieces = [(row, stop, *words(data, offsets)) for row, stop, data, offsets in chunks(texts)]
        items = [[set() for _ in range(stop - row)] for row, stop, _, _ in pieces]
        depth = [np.zeros(len(values) + 1, np.int32) for _, _, values, _ in pieces]
        for index, sieves in self.slices():
            for i, (_, _, values, bounds) in enumerate(pieces):
                doc, start, window = _occurrences(index, sieves, values, bounds)
                np.add.at(depth[i], start, 1)
                np.add.at(depth[i], start + index.length[window], -1)
                for d, w in set(zip(doc.tolist(), window.tolist(), strict=True)):
                    items[i][d].update(index.names[x] for x in index.items[index.item_from[w] : index.item_from[w + 1]])
        for i, (row, stop, _, bounds) in enumerate(pieces):
            yield row, stop, bounds, np.cumsum(depth[i])[:-1] > 0, items[i]


def _hits(bounds: np.ndarray, hit: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(hit)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _mark(boxes: list) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marker = Marker(boxes)
        for b in batches:
            for row, stop, bounds, hit, items in marker.mark(b.column(1)):
                n_hit = _hits(bounds, hit)
                spans = [[] for _ in range(stop - row)]
                for d in np.flatnonzero(n_hit):
                    mask = hit[bounds[d] : bounds[d + 1]].view(np.int8)
                    spans[d] = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]]))).astype(np.int32)
                yield batch(OUT, b.column(0).slice(row, stop - row), np.diff(bounds), n_hit, [sorted(x) for x in items], pa.array(spans, pa.list_(pa.int32())))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, shingle: int = 3, share: float = 0.05, slice_chars: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans, contaminated): words inside occurrences of benchmark windows,
    the items they come from (as sorted strings), the hit stretches, and whether hits reach ``share`` of all words."""
    rows = keyed(docs, id_col, text_col).select("row_id", "text")
    ready = join_order(rows, benchmark, window, shingle, slice_chars, text_col, item_col)
    done = rows.mapInArrow(_mark(ready), "row_id long, n_words long, n_hit long, items array<string>, spans array<int>")
    return done.select(F.col("row_id").alias(id_col), "n_words", "n_hit", "items", "spans", ((F.col("n_hit") > 0) & (F.col("n_hit") >= F.lit(share) * F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, shingle: int = 3, share: float = 0.05, slice_chars: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns as they are."""
    rows = keyed(docs, id_col, text_col).select("row_id", "text")
    ready = join_order(rows, benchmark, window, shingle, slice_chars, text_col, item_col)

    def keep() -> Callable:
        marker = Marker(ready)

        def decide(texts: pa.Array) -> np.ndarray:
            out = np.ones(len(texts), bool)
            for row, stop, bounds, hit, _ in marker.mark(texts):
                n_hit = _hits(bounds, hit)
                out[row:stop] = ~((n_hit > 0) & (n_hit >= share * np.diff(bounds)))
            return out

        return decide

    return filtered(docs, text_col, keep)


def join_order(rows: DataFrame, benchmark: DataFrame, window: int, shingle: int, slice_chars: int, text_col: str, item_col: str) -> list:
    """The slices' indexes as broadcasts, with tokens in the order of their rarity in all of ``rows``."""
    spark = rows.sparkSession
    named = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    chars = named.agg(F.sum(F.length("text") + 16)).first()[0] or 0
    n = -(-chars // slice_chars) or 1
    indexes = []
    for i in range(n):
        part = named.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i) if n > 1 else named
        indexes.append(build_index(sorted((r.item, r.text) for r in part.toLocalIterator()), window, shingle))
    boxes = [spark.sparkContext.broadcast(x) for x in indexes]
    counted = rows.select("text").mapInArrow(_count(boxes), "slice int, size int, token long, n long").groupBy("slice", "size", "token").agg(F.sum("n").alias("n"))
    counts: dict[int, dict[int, list]] = {}
    for r in counted.toLocalIterator():  # at most the shingles of the benchmark
        counts.setdefault(r["slice"], {}).setdefault(r["size"], []).append((r["token"] % (1 << 64), r["n"]))
    ready = []
    for i, index in enumerate(indexes):
        order = {}
        for size, pairs in counts.get(i, {}).items():
            pairs.sort()
            order[size] = (np.array([x for x, _ in pairs], np.uint64), np.array([x for _, x in pairs], np.int64))
        order_by_rarity(index, order)
        ready.append(spark.sparkContext.broadcast(index))
    return ready
