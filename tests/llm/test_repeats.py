import hashlib
from collections import Counter

import numpy as np
import pytest

from lamella.llm import suffix_dedup as SD
from lamella.llm import windows as W
from lamella.llm.substring_dedup import substring_dedup
from lamella.llm.suffix_dedup import suffix_dedup
from tests.llm.corpus import frame, texts


def brute(rows, split, join, length):
    seen = Counter()
    units = [split(t) for _, t in rows]
    for u in units:
        for i in range(len(u) - length + 1):
            seen[u[i : i + length]] += 1
    out = []
    for (doc, _), u in zip(rows, units, strict=True):
        gone = [False] * len(u)
        for i in range(len(u) - length + 1):
            if seen[u[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = [x for x, g in zip(u, gone, strict=True) if not g]
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(u), sum(gone), spans, hashlib.sha256(join(kept)).hexdigest()))
    return Counter(out)


def result(df):
    return Counter((r[0], r[1], r[2], len(r["spans"]) // 2, hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in df.collect())


@pytest.mark.parametrize("length,gram", [(35, 12), (6, 3), (5, 5)])
def test_words(spark, length, gram):
    rows = texts()
    want = brute(rows, lambda t: tuple((t or "").encode().split()), b" ".join, length)
    assert result(substring_dedup(frame(spark, rows), length, gram)) == want


@pytest.mark.parametrize("length,gram", [(200, 24), (101, 9)])
def test_bytes(spark, length, gram):
    rows = texts(2)
    want = brute(rows, lambda t: (t or "").encode(), bytes, length)
    assert result(suffix_dedup(frame(spark, rows), length, gram)) == want


def test_suffixes_across_bucket_boundaries(spark):
    shared = "".join(f"{i:03d}" for i in range(80))
    rows = [(i, f"{'head%05d' % i * 30}{shared}{'tail%05d' % i * 30}") for i in range(120)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = result(suffix_dedup(frame(spark, rows), 200, 24))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == brute(rows, lambda t: t.encode(), bytes, 200)


def test_frequent_token_over_many_buckets(spark):
    """Thousands of undecided runs in each partition hold one token, so that buckets end within it; pairs of them repeat."""
    rng, gram, length = np.random.default_rng(6), 24, 200
    many = rng.integers(97, 123, 400_000).astype(np.uint8)
    lowest = int(np.argmin(W.Prefix(W.byte_values(many)).every(gram)))
    token = many[lowest : lowest + gram].tobytes().decode()

    def letters(n):
        return rng.integers(97, 123, n).astype(np.uint8).tobytes().decode()

    rows = []
    for i in range(0, 7000, 2):
        shared = letters(90) + token + letters(100)
        rows += [(i + k, letters(100) + shared + letters(100)) for k in (0, 1)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = result(suffix_dedup(frame(spark, rows), length, gram))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == brute(rows, lambda t: t.encode(), bytes, length)


def test_portions_of_a_frequent_token(monkeypatch):
    rng, gram, length = np.random.default_rng(1), 24, 200
    token = rng.integers(97, 123, gram).astype(np.uint8)
    anchor = W.Prefix(W.byte_values(token)).every(gram)
    pieces, n, far = [], rng.integers(1, 170, 2500), []
    for k in n.tolist():
        piece = rng.integers(97, 123, k + length - 1).astype(np.uint8)
        far.append(int(rng.integers(k - 1, length - gram + 1)))
        piece[far[-1] : far[-1] + gram] = token
        pieces.append(piece)
    data, offsets = np.concatenate(pieces), np.cumsum([0, *map(len, pieces)])
    monkeypatch.setattr(SD, "_SUFFIXES_AT_ONCE", 20_000)
    got = list(SD._portions(data, offsets, n, np.repeat(anchor, len(n)).view(np.int64), gram))
    assert len(got) > 5 and max(len(piece) for piece, _, _ in got) <= 20_000
    piece, place, inner = (np.concatenate([x[i] for x in got]) for i in range(3))
    order = np.lexsort((inner, piece))
    assert all((a[order] == b).all() for a, b in zip((piece, place, inner), SD._expand(data, offsets, n), strict=True))
    portion = {}
    for i, (of, _, at) in enumerate(got):
        for d in np.unique(np.array(far)[of] - at).tolist():
            assert portion.setdefault(d, i) == i  # one distance, one portion


@pytest.mark.parametrize("bits", [8, 10])
def test_units_beyond_the_packed_positions(monkeypatch, bits):
    """Windows are the same, with the same anchors, however few positions fit; equal hashes stand on both sides of the seams."""
    rng, gram, length = np.random.default_rng(2), 5, 40
    text = np.concatenate([rng.integers(97, 123, 3000), np.full(900, 97), np.tile(rng.integers(97, 123, 30), 60), rng.integers(97, 123, 1000)]).astype(np.uint8)
    values, bounds = W.byte_values(text), np.array([0, 5000, 5000, len(text)])
    monkeypatch.setattr(W, "_POS_BITS", bits)
    doc, first, n, anchor, hull = W.runs(values, bounds, length, gram)
    rank, at = W.Prefix(values).every(gram), []
    for d, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        for i in range(lo, hi - length + 1):
            place = min(range(i, i + length - gram + 1), key=lambda j: (int(rank[j]) >> bits, j))
            if at and at[-1][0] == d and at[-1][3] == place:
                at[-1][2] += 1
            else:
                at.append([d, i - lo, 1, place])
    assert [list(x) for x in zip(doc.tolist(), first.tolist(), n.tolist(), anchor.tolist(), strict=True)] == [[d, f, k, rank[p]] for d, f, k, p in at]
    whole = {}
    for x in range(len(doc)):
        covered = text[bounds[doc[x]] + first[x] :][: n[x] + length - 1].tobytes()
        assert whole.setdefault((int(anchor[x]), covered), int(hull[x])) == hull[x]


@pytest.mark.parametrize("op,unit", [(substring_dedup, " "), (suffix_dedup, "")])
def test_text_longer_than_a_position(spark, op, unit):
    """A text longer than a position holds (2**24 bytes, or words of one letter) is cut as any other."""
    passage = unit.join(f"{i:04d}" for i in range(80))
    filler = np.random.default_rng(3).integers(97, 123, 1 << 24).astype(np.uint8).tobytes().decode()
    long = " ".join(filler) if unit else filler
    rows = [(1, f"{long}{unit}{passage}"), (2, f"first{unit}{passage}{unit}last")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        got = {r[0]: (r[1], r[2], list(r["spans"])) for r in op(spark.createDataFrame(rows, "doc_id long, text string")).drop("kept").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    size = 80 if unit else 320
    at = 1 if unit else 5
    assert got == {1: ((1 << 24) + size, size, [1 << 24, (1 << 24) + size]), 2: (size + (2 if unit else 9), size, [at, at + size])}


#: Pairs of texts that share a 32-bit murmur hash.
COLLIDE = [(31345, 466873), (189514, 431030)]


def test_ids_that_say_nothing(spark):
    """Rows without an id, or of one id, are told apart by their texts; spans of one are not cut from the other."""
    def text(n):
        return f"a{n} b{n} c{n} d{n}"

    rows = [(None, text(n)) for n in COLLIDE[0]] + [(7, text(n)) for n in COLLIDE[1]]
    rows += [(100 + i, f"x {text(a)} y") for i, (a, _) in enumerate(COLLIDE)]
    assert result(substring_dedup(frame(spark, rows), 3, 2)) == brute(rows, lambda t: tuple(t.encode().split()), b" ".join, 3)


@pytest.mark.parametrize("op", [substring_dedup, suffix_dedup])
def test_empty_table_and_clashing_columns(spark, op):
    assert op(frame(spark, texts()).limit(0)).count() == 0
    clash = spark.createDataFrame([(1, "a b", 2, 3)], "doc_id long, text string, key_id int, spans int")
    assert op(clash).count() == 1
