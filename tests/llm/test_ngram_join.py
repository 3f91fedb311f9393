import random
import re
import sys
from functools import partial

import numpy as np
import pytest

import corpus_pipeline
from lamella.llm import ngram_join as ngram
from lamella.llm.ngram_join import OrderedSet, join_block, keep_one, ngram_join
from tests.llm.corpus import frame, texts, words


def sets(text, size=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute(rows, percent=90):
    s = [sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[find(i)] = min(low.get(find(i), doc), doc)
    return sorted(((doc, len(s[i]), low.get(find(i))) for i, (doc, _) in enumerate(rows)), key=repr)


def near_copies():
    """Chains and clouds around the threshold, over sizes that cross the bands."""
    rng = random.Random(9)
    rows, at = [], 1000
    for n in (12, 13, 22, 31, 60, 64, 110, 250):
        base = words(rng, n)
        for k in range(14):
            text = list(base)
            for _ in range(rng.randint(0, max(1, n // 50))):
                text[rng.randrange(len(text))] = words(rng, 1)[0]
            if k % 4 == 0:
                text += words(rng, max(1, n // 20))
            if k % 5 == 0:
                text = text[max(1, n // 25) :]
            if k % 7 == 6:
                base = text
            rows.append((at, " ".join(text).upper() if k % 3 == 0 else " ".join(text)))
            at += 1
    return rows


@pytest.mark.parametrize("block", [1000, 4])
def test_against_brute_force(spark, block):
    rows = texts(10) + near_copies()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join(frame(spark, rows), block=block).collect()), key=repr)
    assert got == brute(rows)


def test_five_words_at_080(spark):
    rows = near_copies()
    got = ngram_join(frame(spark, rows), size=3, percent=80)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=repr) == brute(rows, 80)


def two_words_apart():
    """Pairs of 100 words that differ in two inner words: 86 of 106 shingles of five words, 92 of 104 of three."""
    rng, rows = random.Random(21), []
    for i in range(6):
        base = words(rng, 100)
        other = [*base[:30], "changed", *base[31:70], "again", *base[71:]]
        rows += [(5000 + 2 * i, " ".join(base)), (5001 + 2 * i, " ".join(other))]
    return rows


def test_shingles_of_five_words(spark, monkeypatch):
    rows = texts(10) + near_copies() + two_words_apart()
    got = ngram_join(frame(spark, rows), size=5, percent=80)
    monkeypatch.setattr(sys.modules[__name__], "sets", partial(sets, size=5))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=repr) == brute(rows, 80)


def test_frequent_elements(spark, monkeypatch):
    """Elements that are ranked last instead of being counted change no component."""
    rows = texts(10) + near_copies() + two_words_apart()
    data = " ".join(t for _, t in rows[::3] if t).encode()
    every, _ = ngram.shingle_sets(np.frombuffer(data, np.uint8), np.array([0, len(data)]), 5)
    monkeypatch.setattr(ngram, "_frequent", lambda own: every)
    got = ngram_join(frame(spark, rows), size=5, percent=80)
    monkeypatch.setattr(sys.modules[__name__], "sets", partial(sets, size=5))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=repr) == brute(rows, 80)


@pytest.mark.parametrize("percent", [80, 90, 100])
def test_shares_leave_more_than_the_spare(percent):
    for n, share in ngram.shares(percent)[1:]:
        rng = np.random.default_rng(n)
        assert rng.binomial(n, share, 100_000).min() > n * (100 - percent) // 100


def test_stage_drops_what_five_words_show(spark):
    rows = two_words_apart()
    kept = corpus_pipeline.near_duplicates(spark, frame(spark, rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, _ in rows[::2]]


def test_one_of_each_text_without_an_id_stays(spark):
    """Two texts of one 32-bit murmur hash are no copies."""
    both = [" ".join(f"{c}{n}" for c in "abcd") for n in (31345, 466873)]
    kept = keep_one(frame(spark, [(None, t) for t in both + both]))
    assert sorted(r.text for r in kept.collect()) == sorted(both)
    got = ngram_join(frame(spark, [(5, t) for t in both] + [(1, both[0]), (2, both[1])]))
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == [(1, 1), (2, 2), (5, 1), (5, 2)]


def test_empty(spark):
    assert ngram_join(frame(spark, texts()).limit(0)).count() == 0
    assert {r.component_id for r in ngram_join(frame(spark, [(4, ""), (5, None), (6, "one")])).collect()} == {4, 5, 6}


def clouds(seed, groups, each, n):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        base = rng.integers(0, 1 << 64, n, np.uint64)
        for _ in range(each):
            some = base.copy()
            at = rng.choice(n, rng.integers(0, max(2, n // 8)), replace=False)
            some[at] = rng.integers(0, 1 << 64, len(at), np.uint64)
            out.append(np.unique(some[: n - rng.integers(0, max(1, n // 12))]))
    return [OrderedSet(i, x) for i, x in enumerate({x.tobytes(): x for x in out}.values())]  # classes are different sets


def pairs(sets, percent):
    s = [set(x.values.tolist()) for x in sets]
    return {(i, j) for i in range(len(s)) for j in range(i) if 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j])}


def roots(n, links):
    root = list(range(n))
    for a, b in links:
        root = [root[a] if x == root[b] else x for x in root]
    return [root.index(x) for x in root]


@pytest.mark.parametrize("n", [2, 5, 40, 300])
def test_tree_finds_every_component(n):
    sets = clouds(n, 4, 12, n)
    links, every = join_block(sets, 90), pairs(sets, 90)
    assert {(max(x), min(x)) for x in links} <= every
    assert roots(len(sets), links) == roots(len(sets), every)
    known = {s.sig: s.sig % 3 if s.sig < 12 else s.sig for s in sets}
    probes, targets = set(range(0, len(sets), 2)), set(range(len(sets) // 3))
    links = join_block(sets, 90, known, probes, targets)
    given = [(a, b) for a in known for b in known if known[a] == known[b]]
    met = [x for x in every if x[0] in probes and x[1] in targets or x[1] in probes and x[0] in targets]
    assert roots(len(sets), given + links) == roots(len(sets), given + met)
