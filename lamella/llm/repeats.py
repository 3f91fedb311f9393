"""Repeated windows of a corpus, down to the undecided rest that op1 and op7 settle each in its own way.

1. ``runs_of``: one row for each run of windows that share a winnowed anchor.
2. ``sort_out``: an anchor that occurs once settles its run (nothing repeats); runs
   equal as a whole settle each other (everything repeats). One row for each
   class of equal runs remains where several classes share an anchor.
3. ``open_runs``: those rows with the words or bytes they stand for.
4. ``cut``: removes the units covered by repeated windows.

All counts are aggregations with map-side combining; look-ups deal the rows of a
frequent anchor or class over many tasks; no group is ever gathered in one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm import windows as W
from lamella.llm.common import batch, chunks, spread_join, stored

KEY = ["key_id", "key_h"]


@dataclass(frozen=True)
class Unit:
    """words: runs of bytes but the separators; otherwise every byte is a unit."""

    words: bool
    length: int
    gram: int

    def read(self, data: np.ndarray, offsets: np.ndarray):
        """(values, bounds by unit, start byte and end byte of each unit)."""
        if not self.words:
            return W.byte_values(data), offsets, None, None
        starts, ends = W.word_bounds(data, offsets)
        return W.word_values(data, starts, ends), np.searchsorted(starts, offsets), starts, ends


RUNS = pa.schema([("anchor", pa.int64()), ("hull", pa.int64()), ("key_id", pa.int64()), ("key_h", pa.int64()), ("first", pa.int32()), ("n", pa.int32())])


def _runs(unit: Unit) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hs = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            for row, stop, data, offsets in chunks(b.column(2)):
                values, bounds, _, _ = unit.read(data, offsets)
                doc, first, n, anchor, hull = W.runs(values, bounds, unit.length, unit.gram)
                if len(doc):
                    yield batch(RUNS, anchor.view(np.int64), hull.view(np.int64), ids[row:stop][doc], hs[row:stop][doc], first.astype(np.int32), n.astype(np.int32))

    return run


def runs_of(docs: DataFrame, unit: Unit) -> DataFrame:
    return docs.select(*KEY, "text").mapInArrow(_runs(unit), "anchor long, hull long, key_id long, key_h long, first int, n int")


def sort_out(runs: DataFrame, unit: Unit) -> tuple[DataFrame, DataFrame]:
    """(spans that certainly repeat: key, first, last unit exclusive; classes of undecided runs:
    anchor, hull, n, copies, key and first of the smallest member)."""
    span = [*KEY, "first", (F.col("first") + F.col("n") + (unit.length - 1)).alias("last")]
    anchors = runs.groupBy("anchor").agg(F.count("*").alias("seen"), F.min("hull").alias("low"), F.max("hull").alias("high")).where("seen > 1")
    shared = spread_join(runs, anchors.select("anchor", "seen", (F.col("low") == F.col("high")).alias("even")), ["anchor"], "seen", [*KEY, "first"])
    # Written once: three branches read it, and what it cost to shuffle can go.
    shared = stored(shared.select(F.when(~F.col("even"), F.col("anchor")).alias("anchor"), F.when(~F.col("even"), F.col("hull")).alias("hull"), *KEY, "first", "n"), "runs")
    uneven = shared.where("anchor is not null")
    classes = uneven.groupBy("anchor", "hull").agg(F.count("*").alias("copies"), F.min(F.struct("key_id", "key_h", "first", "n")).alias("at")).select("anchor", "hull", "copies", "at.*")
    again = spread_join(uneven, classes.where("copies > 1").select("anchor", "hull", "copies"), ["anchor", "hull"], "copies", [*KEY, "first"]).select(*span)
    return shared.where("anchor is null").select(*span).unionAll(again), classes


def open_runs(classes: DataFrame, docs: DataFrame, each: Callable, schema: str) -> DataFrame:
    """Hand every document that holds the first member of an undecided class to ``each``
    with its runs: rows (key_id, key_h, text, row_id, runs: [(anchor, first, n, copies)]). The documents'
    columns are those of ``cut``, so that one exchange can serve both."""
    own = classes.groupBy(*KEY).agg(F.collect_list(F.struct("anchor", "first", "n", "copies")).alias("runs"))
    return docs.join(own, KEY).select(*KEY, "text", "row_id", "runs").mapInArrow(each, schema)


CUT = pa.schema([("row_id", pa.int64()), ("n_units", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.int32())), ("kept", pa.binary())])


def _cut(unit: Unit) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = b.column(2)
            flat = spans.flatten().to_numpy(zero_copy_only=False)
            lengths = np.fromiter((0 if x is None else x for x in spans.value_lengths().to_pylist()), np.int64, len(spans))
            ends = np.concatenate([[0], np.cumsum(lengths)])
            for row, stop, data, offsets in chunks(b.column(1)):
                _, bounds, starts, finish = unit.read(data, offsets) if unit.words else (None, offsets, None, None)
                own = flat[ends[row] : ends[stop]]
                doc = np.repeat(np.arange(stop - row), lengths[row:stop])
                depth = np.zeros(int(bounds[-1]) + 1, np.int32)
                np.add.at(depth, bounds[doc] + (own >> 32), 1)
                np.add.at(depth, bounds[doc] + (own & 0xFFFFFFFF), -1)
                gone = np.cumsum(depth)[:-1] > 0
                out_n, out_gone, out_spans, out_kept = [], [], [], []
                raw = data.tobytes()
                for d in range(stop - row):
                    lo, hi = int(bounds[d]), int(bounds[d + 1])
                    mask = gone[lo:hi]
                    out_n.append(hi - lo)
                    total = int(mask.sum()) if hi > lo else 0
                    out_gone.append(total)
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))) if total else np.zeros(0, np.int64)
                    out_spans.append(edge.astype(np.int32))
                    if unit.words:
                        if total:
                            keep = np.flatnonzero(~mask) + lo
                            out_kept.append(b" ".join([raw[s:e] for s, e in zip(starts[keep].tolist(), finish[keep].tolist(), strict=True)]))
                        else:
                            out_kept.append(b" ".join(raw[offsets[d] : offsets[d + 1]].split()))
                    else:
                        out_kept.append(data[lo:hi][~mask].tobytes() if total else raw[lo:hi])
                yield batch(CUT, b.column(0).slice(row, stop - row), out_n, out_gone, pa.array(out_spans, pa.list_(pa.int32())), pa.array(out_kept, pa.binary()))

    return run


def cut(docs: DataFrame, spans: DataFrame, unit: Unit) -> DataFrame:
    """(row_id, n_units, n_removed, spans: start, end, start, end, ..., kept): one row for each document."""
    packed = F.shiftleft(F.col("first").cast("long"), 32).bitwiseOR(F.col("last").cast("long"))
    own = spans.groupBy(*KEY).agg(F.collect_set(packed).alias("spans"))
    return docs.join(own, KEY, "left").select("row_id", "text", "spans", *KEY).mapInArrow(_cut(unit), "row_id long, n_units long, n_removed long, spans array<int>, kept binary")
