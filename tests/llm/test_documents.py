"""Line dedup, mixing, the quality classifier, and the pipeline over planted documents."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lamella.llm.line_dedup import line_dedup
from lamella.llm import features
from lamella.llm.mixing import MARGINS, mix, raked_cells, sample
from lamella.llm.quality import fit, keep_good, quality_scores
from tests.llm.corpus import SCHEMA, frame, texts, words


def line_rows():
    rng = random.Random(2)
    common = [" ".join(words(rng, 5)) for _ in range(12)]
    rows = []
    for i in range(120):
        lines = [" ".join(words(rng, 4)) for _ in range(3)] + [c + rng.choice(["", " ", "\t"]) for k, c in enumerate(common) if rng.random() < (k + 1) / 14]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines) + rng.choice(["", "\n", "\n\n"]), "en", None if i % 17 == 0 else f"s{i % 9}", 0))
    return rows + [(500, None, "en", "s1", 0), (501, "", "en", "s2", 0), (502, common[0], "en", "s1", 0), (502, common[0], "en", "s1", 0), (None, "\n\n", None, None, None)]


@pytest.mark.parametrize("sites", [1, 2, 5, 8])
def test_line_dedup(spark, sites):
    rows = line_rows()
    ends = " \t\r\x0b\x0c"
    spread = defaultdict(set)
    for _, t, _, s, _ in rows:
        for x in (t or "").split("\n"):
            if x.strip(ends) and s is not None:
                spread[x.strip(ends)].add(s)
    gone = {x for x, s in spread.items() if len(s) >= sites and (sites > 1 or len(s) >= 1)}
    want = Counter()
    for i, t, _, _, _ in rows:
        lines = (t or "").split("\n") if t else []
        kept = [x for x in lines if x.strip(ends) not in gone]
        want[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    got = Counter((r.doc_id, r.n_lines, r.n_removed, r.kept) for r in line_dedup(spark.createDataFrame(rows, SCHEMA), sites=sites).collect())
    assert got == want
    assert line_dedup(spark.createDataFrame(rows, SCHEMA).limit(0)).count() == 0


def numpy_rake(cells, want):
    w = {k: v for k, v in cells.items()}
    for _ in range(400):
        for m in range(3):
            sums = Counter()
            for k, x in w.items():
                sums[k[m]] += x
            w = {k: x * want[m][k[m]] / sums[k[m]] for k, x in w.items()}
    return w


def test_raking_meets_its_margins(spark):
    rng = random.Random(3)
    cells = {(s, c, t): rng.randint(1, 900) for s in "abc" for c in "xy" for t in "pq"}
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "source string, lang string, topic string, tokens long")
    given = {"source": {"a": 0.5, "b": 0.2}}
    got = {(r.source, r.lang, r.topic): r for r in raked_cells(df, budget=0.1, temper=0.5, given=given).collect()}
    total = Counter()
    for k, v in cells.items():
        for m in range(3):
            total[m, k[m]] += v
    want = [{"a": 0.5, "b": 0.2, "c": 0.3}, {}, {}]
    for m in (1, 2):
        root = {v: total[m, v] ** 0.5 for _, v in [k for k in total if k[0] == m]}
        want[m] = {v: x / sum(root.values()) for v, x in root.items()}
    fit = numpy_rake(cells, want)
    assert all(abs(got[k].w - fit[k] / sum(fit.values())) < 1e-7 for k in cells)
    for i, m in enumerate(MARGINS):
        for v, share in want[i].items():
            assert abs(sum(r.w for r in got.values() if r[m] == v) - share) < 1e-7
    assert abs(sum(r.p * r.tokens for r in got.values()) - 0.1 * sum(cells.values())) < 1e-6


def test_mix(spark):
    rows = [(i, "word " * (1 + i % 7) + ("|" if i % 3 else "="), "en" if i % 4 else None, f"s{i % 5}", 0) for i in range(2000)] + [(None, None, None, None, None), (3, "", "en", "s1", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mix(docs, budget=0.4).cache()
    assert got.count() == len(rows) and set(SCHEMA.replace(",", "").split()[::2]) <= set(got.columns)
    kept = got.where("mix_kept").agg(F.sum("mix_tokens")).first()[0] / got.agg(F.sum("mix_tokens")).first()[0]
    assert 0.35 < kept < 0.45
    assert got.where("(mix_u < mix_p) <> mix_kept or mix_p < 0 or mix_p > 1").count() == 0
    assert mix(docs.limit(0)).count() == 0


def labelled(n=240):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        w = words(rng, rng.randint(30, 200))
        good = i % 4 != 0
        rows.append((i, " ".join(w) if good else (" ".join(x.upper() + "!!" for x in w) if i % 8 else " ".join(w[:3] * 30)), "en", f"s{i % 3}", 0))
        labels.append((i, int(good), 0))
    return rows, labels + [(7, None, 0), (None, 1, 0), (9, 0, 0), (9, 1, 0)]


def test_quality(spark):
    rows, labels = labelled()
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0), (None, "a b", "en", "s", 0), (5, rows[5][1], "en", "s", 0)]
    docs, lab = spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality_scores(docs, lab).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 240 and r.doc_id != 9]
    assert len(held) > 20 and np.mean([r.predicted == int(r.doc_id % 4 != 0) for r in held]) > 0.95
    assert quality_scores(docs.limit(0), lab).count() == 0
    assert {r.score for r in quality_scores(docs, lab.limit(0)).collect()} == {0.5}
    assert {r.score for r in quality_scores(docs, lab.where("quality = 1 and doc_id <> 9")).collect()} == {1.0}
    kept = Counter(r.doc_id for r in keep_good(docs, lab).collect())
    assert kept == Counter(r.doc_id for r in got if r.predicted)


def test_pipeline(spark, tmp_path):
    rng = random.Random(12)
    rows, labels = labelled(200)
    copy, item = rows[5][1].split(), words(rng, 30)
    rows += [(1000, rows[6][1], "en", "s1", 0), (1001, " ".join([*copy, "tail"]) if len(copy) > 100 else rows[5][1], "en", "s1", 0), (1002, " ".join(words(rng, 20) + item), "en", "s2", 0), (1003, " ".join(words(rng, 80)), "de", "s2", 0), (1004, None, None, None, None), (1004, None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    ids = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids[name] = Counter(r.doc_id for r in docs.collect())
    bad = {i for i in range(200) if i % 4 == 0}
    assert len(bad & set(ids["quality"])) <= 2 and set(ids["quality"]) >= set(range(200)) - bad
    assert {1000, 1001}.isdisjoint(ids["near_duplicates"]) and set(ids["quality"]) - set(ids["near_duplicates"]) <= {1000, 1001} | bad
    assert ids["near_duplicates"][1004] == ids["quality"][1004]
    assert set(ids["near_duplicates"]) - set(ids["decontamination"]) == {1002}
    assert set(ids["mixture"]) <= set(ids["decontamination"]) and len(ids["mixture"]) > 50
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in out) == ids["mixture"]


def test_extra_columns(spark):
    clash = frame(spark, texts()).select("*", F.lit(1).alias("key_id"), F.lit(2).alias("sig"), F.lit(3).alias("row"))
    lab = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    from lamella.llm.ngram_join import keep_one

    assert keep_one(clash).columns == clash.columns and keep_good(clash, lab).columns == clash.columns
    assert keep_one(clash.limit(0)).count() == 0


def test_what_capped_cells_leave_is_spread_to_the_end(spark):
    """Each round brings one more of 14 cells to 1, as each has a tenth of the share of the one before."""
    df = spark.createDataFrame([(f"s{i}", "x", "p", 1000) for i in range(14)], "source string, lang string, topic string, tokens long")
    got = raked_cells(df, budget=0.9, given={"source": {f"s{i}": 0.9 * 0.1**i for i in range(14)}}).collect()
    assert abs(sum(r.p * r.tokens for r in got) - 0.9 * 14000) < 1e-6


def test_raking_that_does_not_converge_is_reported(spark):
    cells = [("a", "x", "p", 10), ("a", "y", "p", 10), ("b", "y", "p", 10)]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    given = {"source": {"a": 0.2, "b": 0.8}, "lang": {"x": 0.8, "y": 0.2}}
    with pytest.warns(UserWarning, match="not converged"):
        raked_cells(df, given=given, most_rounds=20)


def test_mix_with_columns_of_its_names(spark):
    rows = [(i, "word " * (i % 7), "en", f"s{i % 3}", 0.5, i, "x") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, mix_p double, mix_tokens long, tokens string")
    plain = docs.drop("mix_p", "mix_tokens", "tokens")
    want = {r.doc_id: (r.mix_p, r.mix_tokens, r.mix_kept) for r in mix(plain).collect()}
    got = mix(docs)
    assert sorted(got.columns) == sorted([*plain.columns, "tokens", *[f"mix_{x}" for x in ("source", "lang", "topic", "tokens", "p", "u", "kept")]])
    assert {r.doc_id: (r.mix_p, r.mix_tokens, r.mix_kept) for r in got.collect()} == want
    kept = sample(docs)
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == [r for r in rows if want[r[0]][2]]


def test_votes_of_neighbours(spark):
    """Scores against one plain pass over all labelled vectors."""
    rows, labels = labelled(200)
    rows += [(5, "another text of an id that trains", "en", "s", 0)]
    docs, lab = spark.createDataFrame(rows, SCHEMA).repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = fit(docs, lab)
    data = [r[1].encode() for r in rows]
    terms = features.terms(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    want = []
    for v in model.project(terms):
        close = sorted(((float(v @ x), i) for i, x in enumerate(model.vectors)), reverse=True)[: model.neighbours]
        weight = [max(c, 1e-3) ** model.power * model.votes[i] for c, i in close]
        want.append(sum(w * model.labels[i] for w, (_, i) in zip(weight, close, strict=True)) / sum(weight))
    got = sorted((r.doc_id, r.score) for r in quality_scores(docs, lab).collect())
    np.testing.assert_allclose([x for _, x in got], [x for _, x in sorted(zip([r[0] for r in rows], want, strict=True))], rtol=1e-4, atol=1e-6)
    assert len(model.labels) == len({r[0] for r in rows} & {i for i, q, _ in labels if i not in (9, None)} - {i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0})
