import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lamella import plans
from lamella.functions import numbers as N
from lamella.functions import sequences as S
from lamella.operators import aligned as A
from lamella.operators import measures as M
from lamella.operators import pairs as P
from lamella.operators import tables as T


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_sequences(spark):
    v = lambda c: value(spark, c)
    assert [sum(x) for x in v(S.one_hot(F.lit("AYX")))] == [1, 1, 0]
    assert v(S.ordinal(F.lit("AC-Z"), other=21)) == [0, 1, 20, 21]
    assert v(S.decode(S.ordinal(F.lit("ACD")), S.LETTERS)) == "ACD"
    assert v(S.drop_insertions(F.lit("ACdeF-"))) == "ACF-" and v(S.clean(F.lit("AB-J"))) == "AX-X"
    assert v(S.mask_end_gaps(F.lit("--A-C-"))) == "..A-C." and v(S.mask_end_gaps(F.lit("--"))) == ".."
    assert v(S.plain(F.lit("a.-c"))) == "AC" and v(S.pad(F.lit("AC"), F.lit(2), F.lit(5))) == "--AC-"
    assert v(S.terminal_tag(F.lit("MHHHHACD"))) == [0, 1, 1, 1, 1, 0, 0, 0] and v(S.terminal_tag(F.lit("ACDEFGHHHH")))[-4:] == [1] * 4
    assert v(S.three_classes(F.lit("GHBETSL"))) == "HHEELLL" and v(S.three_classes(F.lit("GB"), S.SS8_SCORER)) == "LL"
    assert v(S.fold_classes(F.array(*map(F.lit, (0.25, 0.5, 0.25))), [[0, 2], [1]])) == [0.5, 0.5]
    assert v(S.most_likely(F.array(*map(F.lit, (0.2, 0.4, 0.4))))) == 1
    assert v(S.grams(F.lit("ABCD"))) == ["ABC", "BCD"] and v(S.grams(F.lit("AB"))) == []
    assert v(S.matches(F.lit("AC-X"), F.lit("AD-X"))) == 1 and v(S.mismatches(F.lit("AC-X"), F.lit("ADEF"))) == 1
    assert [v(S.chain_name(F.lit(i))) for i in (0, 26, 61, 62, 63)] == ["A", "a", "9", "AA", "AB"]


def test_digitise_against_numpy(spark):
    edges = [0.0, 1.0, 2.5, 2.6, 9.0]
    xs = [-1.0, 0.0, 0.5, 1.0, 2.5, 2.55, 2.6, 8.99, 9.0, 20.0]
    df = spark.createDataFrame([(x,) for x in xs] + [(None,), (math.nan,)], "x double")
    got = [r.k for r in df.select(N.digitise(F.col("x"), edges).alias("k")).collect()]
    assert got == [int(k) - 1 for k in np.digitize(xs, edges)] + [None, None]
    assert [r.k for r in df.limit(2).select(N.digitise(F.col("x"), edges, "last").alias("k")).collect()][0] == 4
    assert [r.k for r in df.limit(2).select(N.digitise(F.col("x"), edges, "extra").alias("k")).collect()][0] == 5


def test_numbers(spark):
    v = lambda c: value(spark, c)
    assert [v(N.band(F.lit(k))) for k in (30, -24, 12, 7, 2)] == [0, 0, 1, 2, -1]
    assert v(N.wrap_degrees(F.lit(190.0))) == -170 and v(N.wrap_degrees(F.lit(-180.0))) == 180
    assert v(N.circular_gap(F.lit(math.radians(179)), F.lit(math.radians(-179)))) == pytest.approx(math.radians(2))
    assert v(N.power_scaled(F.lit(0.23))) == pytest.approx(0.5) and v(N.gyration(F.lit(250), floor=True)) < v(N.gyration(F.lit(250)))
    assert v(N.distance_of_error(N.error_of_distance(F.lit(3.0)))) == pytest.approx(3.0)
    assert v(N.rotated(F.array(*map(F.lit, (1, 2, 3))))) == [3, 1, 2] and v(N.half_shifted(F.array(*map(F.lit, (1.0, 3.0))))) == [2.0, 2.0]
    assert v(N.outer_product(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(4)))) == [3, 4, 6, 8]
    s = v(N.spread([1.0, 3.0], F.array(F.lit(0.5), F.lit(0.5))))
    assert (s.mean, s.std, s.below, s.above) == (2.0, 1.0, 1.0, 1.0)
    assert sum(v(N.centred_potential(F.array(F.lit(0.2), F.lit(0.8)), F.array(F.lit(0.5), F.lit(0.5))))) == pytest.approx(0)
    p = lambda *x: [F.lit(float(k)) for k in x]
    assert v(N.dihedral(p(1, 0, 0), p(0, 0, 0), p(0, 1, 0), p(0, 1, 1))) == pytest.approx(-math.pi / 2)
    assert v(N.angle(p(1, 0, 0), p(0, 0, 0), p(0, 1, 0))) == pytest.approx(math.pi / 2)
    assert v(N.is_number(F.lit("1e3"))) and not v(N.is_number(F.lit("x")))


@pytest.fixture(scope="module")
def msa(spark):
    rows = ["AC-DEF", "AC-DEF", "AC-DXF", "-CAD-F", "GGGGGG"]
    return spark.createDataFrame([("m", i, s) for i, s in enumerate(rows)], "name string, seq_no int, seq string"), rows


@pytest.mark.parametrize("mode", "abcde")
def test_neighbour_weights(msa, mode):
    df, rows = msa

    def near(a, b):
        full, other = len(a.replace("-", "")), len(b.replace("-", ""))
        same, equal = sum(x == y != "-" for x, y in zip(a, b, strict=True)), sum(x == y for x, y in zip(a, b, strict=True))
        return {"a": same > 0.62 * full, "b": len(a) - equal < int(0.38 * len(a) + 1e-9), "c": equal > math.ceil(0.62 * len(a)), "d": same > 0.62 * min(full, other), "e": same >= int(full * 0.62 + 0.5)}[mode]

    want = {i: sum(i == j or near(a, b) for j, b in enumerate(rows)) for i, a in enumerate(rows)}
    got = A.neighbour_weights(df, mode)
    assert {r.seq_no: r.n for r in got.collect()} == want
    assert A.effective_number(got).first().meff == pytest.approx(sum(1 / n for n in want.values()))


def test_frequencies_and_information(spark, msa):
    res = A.residues(msa[0]).withColumn("w", F.lit(1.0))
    freq = A.column_frequencies(res, S.LETTERS)
    assert all(abs(r.s - 1) < 1e-9 for r in freq.groupBy("pos").agg(F.sum("p").alias("s")).collect())
    pairs = A.pair_frequencies(res, box=(0, 2, 1, 5))
    mi = {(r.i, r.j): r.mi for r in A.mutual_information(pairs).collect()}
    assert all(x >= -1e-12 for x in mi.values()) and max(j for _, j in mi) == 5
    full = spark.createDataFrame([(i, j, float((i + 1) * (j + 2))) for i in range(4) for j in range(4)], "i int, j int, v double")
    assert all(abs(r.apc) < 1e-9 for r in P.apc(full, [], "v").collect())
    assert min(r.apc for r in P.apc(full, [], "v", "offdiag").collect()) == 0


def test_positional_join(spark):
    ali = spark.createDataFrame([(1, "--AC-DE-", "MFAC-D-G")], "k int, t_seq string, q_seq string")
    j = A.positional_join(ali, ["k"])
    got = [(r.i, r.j) for r in j.orderBy("col").collect()]
    assert got == [(None, 0), (None, 1), (0, 2), (1, 3), (None, None), (2, 4), (3, None), (None, 5)]
    assert A.gap_openings(j, ["k"], "i").first().openings == 1
    subst = spark.createDataFrame([("A", "A", 4.0), ("C", "C", 9.0)], "aa1 string, aa2 string, score double")
    assert tuple(A.score_alignment(j, subst, ["k"]).first())[1:] == (3, 13.0)
    two = spark.createDataFrame([("HEAGAWGHEE", "PAWHEAE"), ("", "A"), ("ABC", "ABC")], "a string, b string")
    assert [r.score for r in A.local_scores(two, "a", "b").collect()][1:] == [0, 6]
    assert spark.createDataFrame([("xxABCyyDEF", "ABCDEF")], "w string, s string").select(A.split_contained("w", "s").alias("m")).first().m == 3


def test_histograms_keep_mass(spark):
    h = spark.createDataFrame([("a", k, 0.1) for k in range(10)], "g string, bin int, p double")
    out = M.rebin(h, ["g"], [float(k) for k in range(11)], [0.0, 2.5, 7.0, 10.0])
    assert {r.bin: round(r.p, 9) for r in out.collect()} == {0: 0.25, 1: 0.45, 2: 0.3}
    e = spark.createDataFrame([(m, k, p) for m, v in (("x", (0.2, 0.8)), ("y", (0.8, 0.2))) for k, p in enumerate(v)], "m string, bin int, p double").withColumn("i", F.lit(1))
    assert [round(r.p, 9) for r in M.ensemble(e, ["i"], "bin", geometric=True).collect()] == [0.5, 0.5]


def test_ranking_and_runs(spark):
    rows = [(1, i, s, t) for i, (s, t) in enumerate([(0.9, True), (0.9, False), (0.5, True), (0.1, False)])]
    df = spark.createDataFrame(rows, "g int, i int, s double, t boolean")
    r = M.top_precision(df, ["g"], "s", "t", ["i"], F.lit(8), 0.5).first()
    assert (r.k, r.hits, r.n_true) == (2, 1, 2)
    assert M.top_precision(df, ["g"], "s", "t", ["i"], F.lit(8), 0.5, cap_by_truth=False).first().k == 4
    c = M.confusion(df, ["g"], F.col("t"), F.col("s") > 0.4).first()
    assert (c.tp, c.fp, c.fn, c.tn) == (2, 1, 0, 1) and -1 <= c.mcc <= 1
    ss = spark.createDataFrame([(1, i, c) for i, c in enumerate("HHHLLEEEEHL")], "g int, pos int, ss string")
    assert [(x.ss, x.first, x.last) for x in M.islands(ss, ["g"], ["pos"], "ss").orderBy("first").collect()] == [("H", 0, 2), ("L", 3, 4), ("E", 5, 8), ("H", 9, 9), ("L", 10, 10)]
    assert [x.number for x in M.renumbered(ss, ["g"], ["pos"], "ss").orderBy("pos").collect()] == [0, 0, 0, 1, 1, 2, 2, 2, 2, 3, 4]
    b = M.packed_batches(spark.createDataFrame([(k, s) for k, s in enumerate([5, 5, 4, 4, 4])], "k int, s int"), "k", "s", 50.0).collect()
    assert {r.key: r.batch for r in b} == {0: 0, 1: 0, 2: 1, 3: 1, 4: 1}


def test_superposition_and_smoothing(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(30, 3)) * 10
    turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    turn *= np.sign(np.linalg.det(turn))
    b = a @ turn + 5
    df = spark.createDataFrame([(1, *map(float, x), *map(float, y)) for x, y in zip(a, b, strict=True)], "m int, x double, y double, z double, u double, v double, w double")
    r = M.superposed(df, "m").first()
    assert r.rmsd < 1e-6 and r.gdt == 1 and r.tm == pytest.approx(1)
    cubic = spark.createDataFrame([("k", float(x), float(x**3)) for x in range(8)], "k string, x double, y double")
    assert all(abs(s.value - s.x**3) < 1e-6 and abs(s.slope - 3 * s.x**2) < 1e-5 for s in M.smoothed(cubic, "k", "x", "y").collect())


def test_tables_and_samples(spark):
    df = spark.range(1000).withColumn("w", (F.col("id") % 10).cast("double"))
    assert [r.n for r in T.numbered(df.select("id"), ["id"], "n").orderBy("id").collect()] == list(range(1, 1001))
    s = T.exactly(df, "id", 50, 3, F.col("id") == 0).collect()
    assert len(s) == 50 and s[0].id == 0 and [r.id for r in s] == sorted(r.id for r in s)
    assert 350 < T.bernoulli(df, "id", 0.4, 1).count() < 450
    w = T.weighted(df, "id", "w", 100, 5).collect()
    assert len({r.id for r in w}) == 100 and sum(r.w for r in w) / 100 > 5 and min(r.w for r in w) > 0
    assert {r.part: r["count"] for r in T.split_evenly(df, "id", 3).groupBy("part").count().collect()} == {0: 334, 1: 333, 2: 333}
    assert T.with_replacement(df.limit(20), "id", "w", 64, 16).groupBy("batch").count().count() == 4
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, None)], "k int, v string")
    assert {r.k: r.v for r in T.updated(a, b, ["k"], ["v"]).collect()} == {1: "x", 2: "z", 3: None}
    good, bad = T.checked_join(a, b, ["k"], "v")
    assert good.count() == 0 and bad.count() == 1
    assert T.ragged(spark.createDataFrame([("1 2",), (" 3  4 ",), ("5",)], "l string"), F.col("l")).first().even is False
    c = T.crops(spark.createDataFrame([(1, 100), (2, 5)], "k int, n int"), "k", "n", 10).collect()
    assert [r.stop - r.start for r in c] == [10, 5]
    d = P.largest_difference(spark.createDataFrame([(0, 1, 2.0)], "i int, j int, v double"), spark.createDataFrame([(0, 1, 2.5), (1, 1, 0.0)], "i int, j int, v double"), "v", 0.1).first()
    assert d.most == 0.5 and tuple(d["at"]) == (0, 1) and d.unmatched == 1


def test_numbers_of_many_rows(spark):
    """More rows than a range partitioning samples, over more partitions than one task reads."""
    rows = spark.range(0, 600_000, 1, 24).select(F.xxhash64("id").alias("x"))
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        got = T.numbered(rows, ["x"], "n")
        assert tuple(got.agg(F.count_distinct("n"), F.min("n"), F.max("n")).first()) == (600_000, 1, 600_000)
        assert got.select("n", F.row_number().over(Window.orderBy("x")).alias("m")).where("n <> m").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_batches_of_many_rows(spark):
    """A group of more than 100 000 rows against the plain scan: frequent sizes, ties, rows without key or size."""
    rows = spark.range(0, 130_000, 1, 7).select(F.when(F.col("id") > 3, F.col("id")).alias("k"), F.when(F.col("id") % 5 > 0, 64 + F.pmod(F.xxhash64("id"), F.lit(60))).otherwise(F.when(F.col("id") % 3 > 0, 70)).alias("s"))
    got = sorted(tuple(r) for r in M.packed_batches(rows, "k", "s", 1e5).na.fill(-1, ["key"]).collect())
    want, at, left, last = [], -1, 0, None
    for g, s, k in sorted(((math.floor(math.log2(max(1, r.s or 0))), -(r.s or 0), math.inf if r.k is None else r.k) for r in rows.collect())):
        if g != last:
            at, left, last = -1, 0, g
        if left == 0:
            at, left = at + 1, max(1, math.floor(1e5 / max(1, s * s)))
        left -= 1
        want.append((g, -1 if k == math.inf else k, -s, at))
    assert got == sorted(want) and max(sum(r[0] == g for r in got) for g in (0, 6)) > 100_000


def test_contained(spark):
    """Every place of every part against plain search: short parts, parts at the ends, repeated rows, nulls."""
    words = "aa bb cc dd ee ff gg".split()
    text = [" ".join(words[(i * k + k) % 7] for k in range(i % 19)) + ("  x" if i % 5 == 0 else "") for i in range(60)] + [None, "", "zaa bb cc dd eez"]
    whole = [(i % 50 if i % 11 else None, t) for i, t in enumerate(text)]
    part = [(k, p) for k, p in enumerate([text[17][3:30], text[18], "bb", "aa bb cc dd ee", None, "bb", text[40], "no such words in any text", "x"])]
    w, p = spark.createDataFrame(whole, "id int, text string"), spark.createDataFrame(part, "k int, sub string")
    got = sorted((r.id, r.text, r.k, r["at"]) for r in A.contained(w, p, "id", "text", "sub").na.fill(-1, ["id"]).collect())
    want = sorted((-1 if i is None else i, t, k, t.find(s) + 1) for i, t in whole for k, s in part if t is not None and s is not None and s in t)
    assert got == want and len(got) > 50


def test_pairs_by_blocks(spark, monkeypatch):
    """Contacts and mean distances by separation without a row for each pair, over several blocks, against rows for all pairs."""
    monkeypatch.setattr(P, "BLOCK", 7)
    rng = np.random.default_rng(3)
    rows = [(g, k + 1, rng.normal(size=5).round(3).tolist()) for g, n in ((0, 30), (1, 7), (2, 1), (3, 22)) for k in range(n)]
    rows[3], rows[9], rows[12], rows[15] = (0, 4, None), (0, 10, [math.nan, 0.0, 0.0, 0.0, 0.0]), (0, 13, [0.1, None, 0.0, 0.0, 0.0]), (0, 16, [])
    df = spark.createDataFrame([*rows, (None, 1, [0.0] * 5)], "g int, pos int, v array<double>")
    d = N.distance(F.col("a_v"), F.col("b_v"))
    plain = P.self_pairs(df, "g", "pos", ["v"]).withColumn("d", F.round(d, 5))
    near = P.mirror(P.in_band(plain, 4).where("d < 2.5").select("g", "i", "j"))
    want = sorted(tuple(r) for r in near.groupBy("g", F.col("i").alias("pos")).agg(F.count("*")).collect())
    made = P.contacts(df, "g", "pos", "v", 2.5, 4)
    assert sorted(tuple(r) for r in made.collect()) == want and len(want) > 40
    want = {r.sep: (r.n, r["mean"]) for r in M.mean_by_separation(plain, "d", [], 0.5, 3.5, 9).collect()}
    means = P.separations(df, "g", "pos", "v", 0.5, 3.5, 9)
    got = {r.sep: (r.n, r["mean"]) for r in means.collect()}
    assert {k: n for k, (n, _) in got.items()} == {k: n for k, (n, _) in want.items()} and all(abs(m - want[k][1]) < 1e-9 for k, (_, m) in got.items())


def test_pairs_plan_without_pairs(spark):
    """The two queries join nothing by the label alone: such a join makes a row for each pair."""
    for name in ("contact_number", "sep_mean_distance"):
        plan = plans.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapGroupsInArrow" in plan and "a_embedding" not in plan
