"""Secret scan: fixed patterns, and sliding-window Shannon entropy over candidate strings.

A candidate is a stretch of ``window`` or more characters that encodings use. Its
character class (hex digits, or letters with digits) sets the entropy that every
window of ``window`` characters must reach; counts are updated by one character
in and one out, so a candidate costs one step for each character. Windows that
reach it join into one span. Candidates that an allow-list pattern matches as a
whole are suppressed, and so are spans that lie in what fixed patterns report already;
a span that reaches beyond that is reported whole.

Edge cases: null and empty texts have no spans; repeated rows are scanned each;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm import windows as W
from lamella.llm.common import batch, chunks, keyed

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}"
#: Letters alone are words, digits alone are numbers; then UUIDs, dates, paths of words, and rulers.
ALLOWED = (
    r"[A-Za-z]+", r"[0-9]+", r"[A-Za-z]*[+/_=-]*", r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}.*", r"/?([A-Za-z]+[/_=-])+[A-Za-z]*", r"(.)\1+",
)


def _table(pattern: str) -> np.ndarray:
    """True for the bytes that are not in the class."""
    inside = re.compile(pattern.encode())
    return np.array([not inside.fullmatch(bytes([i])) for i in range(256)])


_NOT_HEX, _NOT_CANDIDATE = _table("[0-9a-f]"), _table("[A-Za-z0-9+/_=-]")
_IS_HEX = re.compile(r"[0-9a-fA-F]+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, kinds by number."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(out)


def entropy_spans(value: str, window: int, hex_bits: float, mixed_bits: float) -> list[tuple[int, int]]:
    """Stretches of ``value`` whose windows all reach the entropy of its class."""
    bits = hex_bits if _IS_HEX.fullmatch(value) else mixed_bits
    weight = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    limit = window * (math.log2(window) - bits) + 1e-9  # the entropy is log2(window) - sum(c log2 c) / window
    counts: dict[str, int] = {}
    total = 0.0
    spans: list[tuple[int, int]] = []
    for i, new in enumerate(value):
        c = counts.get(new, 0)
        counts[new] = c + 1
        total += weight[c + 1] - weight[c]
        if i >= window:
            old = value[i - window]
            c = counts[old]
            counts[old] = c - 1
            total += weight[c - 1] - weight[c]
        if i >= window - 1 and total <= limit:
            if spans and spans[-1][1] >= i - window + 1:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((i - window + 1, i + 1))
    return spans


def covered(start: int, end: int, spans: list[tuple[int, int, int]]) -> bool:
    """Whether ``spans``, sorted, hold every character from start to end."""
    for s, _, e in spans:
        if s <= start < e:
            start = e
    return start >= end


OUT = pa.schema([("row_id", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))])


def _scan(window: int, hex_bits: float, mixed_bits: float, allowed: tuple[str, ...]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        candidate, allow = re.compile(CANDIDATE % window), re.compile("|".join(f"(?:{x})" for x in allowed)) if allowed else None
        for b in batches:
            for row, stop, data, offsets in chunks(b.column(1)):
                raw = data.tobytes()
                flags = []
                for table, least in ((_NOT_HEX, 24), (_NOT_CANDIDATE, window)):
                    start, end = W.word_bounds(data, offsets, table)
                    flag = np.zeros(stop - row, bool)
                    flag[np.searchsorted(offsets, start[end - start >= least], side="right") - 1] = True
                    flags.append(flag)
                sign = np.flatnonzero((data == 58) | (data == 61))
                signed = np.zeros(stop - row, bool)
                signed[np.searchsorted(offsets, sign, side="right") - 1] = True
                out = [[] for _ in range(stop - row)]
                for d in np.flatnonzero(flags[0] | flags[1] | signed):
                    text = raw[offsets[d] : offsets[d + 1]].decode()
                    found = base_spans(text)
                    if flags[1][d]:
                        taken = list(found)
                        for m in candidate.finditer(text):
                            if allow and allow.fullmatch(m[0]):
                                continue
                            for s, e in entropy_spans(m[0], window, hex_bits, mixed_bits):
                                s, e = s + m.start(), e + m.start()
                                if not covered(s, e, taken):
                                    found.append((s, 3, e))
                    out[d] = [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(found)]
                yield batch(OUT, b.column(0).slice(row, stop - row), pa.array(out, OUT.field(1).type))

    return run


def secret_scan(docs: DataFrame, window: int = 20, hex_bits: float = 3.0, mixed_bits: float = 3.6, allowed: tuple[str, ...] = ALLOWED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): spans by start, each with kind, start and end in code points, end exclusive."""
    rows = keyed(docs, id_col, text_col).select("row_id", "text")
    done = rows.mapInArrow(_scan(window, hex_bits, mixed_bits, allowed), "row_id long, spans array<struct<kind:string,start:int,end:int>>")
    return done.select(F.col("row_id").alias(id_col), "spans")
