"""Substring dedup by seed and extend, over words.

Seeds are winnowed anchors: any window of ``length`` words holds one, and equal
windows hold equal anchors at equal offsets. Documents meet on anchors. A match
is extended both ways at once: first over the whole hull of windows that an
anchor owns, then, where hulls that share an anchor differ, window by window up
to the first and last one that agree. Overlapping matches join into maximal
repeats, which by construction have at least ``length`` words.

Edge cases: a null or blank text has no words and keeps the empty text; a text of
fewer than ``length`` words loses nothing; rows equal in id and text each count as
a document; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm import windows as W
from lamella.llm.common import batch, chunks, keyed
from lamella.llm.repeats import KEY, Unit, cut, open_runs, runs_of, sort_out

OPEN = pa.schema([("window", pa.int64()), ("key_id", pa.int64()), ("key_h", pa.int64()), ("first", pa.int32()), ("copies", pa.int64())])


def _windows(unit: Unit) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hs, runs = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), b.column(4)
            ends = np.concatenate([[0], np.cumsum(runs.value_lengths().to_numpy(zero_copy_only=False))])
            flat = runs.flatten()
            anchor, first, n, copies = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            for row, stop, data, offsets in chunks(b.column(2)):
                values, bounds, _, _ = unit.read(data, offsets)
                prefix = W.Prefix(values)
                own = slice(int(ends[row]), int(ends[stop]))
                doc = np.repeat(np.arange(stop - row), np.diff(ends[row : stop + 1]))
                count = n[own].astype(np.int64)
                each = np.repeat(np.arange(len(doc)), count)
                start = first[own].astype(np.int64)[each] + (np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count))
                at = bounds[doc][each] + start
                window = W.mix(prefix.stretch(at, at + unit.length) ^ anchor[own].view(np.uint64)[each])
                yield batch(OPEN, window.view(np.int64), ids[row:stop][doc][each], hs[row:stop][doc][each], start.astype(np.int32), copies[own][each])

    return run


def substring_dedup(docs: DataFrame, length: int = 35, gram: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept): ``spans`` holds start and end word of each
    maximal repeat in turn, ``kept`` the other words joined by one space (UTF-8 bytes)."""
    if not 0 < gram <= length:
        raise ValueError("gram must be between 1 and length")
    unit = Unit(True, length, gram)
    rows = keyed(docs, id_col, text_col)
    spans, classes = sort_out(runs_of(rows, unit), unit)
    opened = open_runs(classes, rows, _windows(unit), "window long, key_id long, key_h long, first int, copies long")
    agreed = opened.groupBy("window").agg(F.sum("copies").alias("seen")).where("seen > 1").select("window")
    extended = opened.where("copies = 1").join(agreed, "window").select(*KEY, "first", (F.col("first") + length).alias("last"))
    done = cut(rows, spans.unionAll(extended), unit)
    return done.select(F.col("row_id").alias(id_col), F.col("n_units").alias("n_words"), "n_removed", "spans", "kept")
