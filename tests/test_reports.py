"""Readers of report files over small texts of each format."""

import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella import plans
from lamella.functions import labels as L
from lamella.functions import profiles as Q
from lamella.operators import aligned as A
from lamella.operators import selection as Z
from lamella.sources import readers
from lamella.sources import reports as R
from lamella.storage import shared_folder


def put(folder, name, text):
    path = folder / name
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


RANKS = """Query Name = q1
Query Sequence = MKVLAAGG
Query Length = 8

No Template Pvalue Score a b c
1 t1A 1e-5 50 1 2 3 4 5 6 7 8 4
2 t2B 1e-3 40 1 2 3 4 5 6 7 8 2

No 1
>t1A
x

y
T t1A 3 MK-LA 6 90
m
S q1 1 MKVLA 5 8
T sse_real x
z
T t1A 7 GG 8 90
m
S q1 6 GG 7 8
No 2
>t2B
T t2B 1 AA 2 70
S q1 4 LA 5 8
"""


def test_rank_files(spark, tmp_path):
    table, ali = R.rank_files(spark, put(tmp_path, "q1.rank", RANKS))
    assert [(r.query, r.rank, r.template, r.pvalue, r.identity) for r in table.orderBy("rank").collect()] == [("q1", 1, "t1A", 1e-5, 0.5), ("q1", 2, "t2B", 1e-3, 0.25)]
    got = [(r.rank, r.template, r.t_start, r.t_end, r.t_seq, r.q_start, r.q_end, r.q_seq) for r in ali.orderBy("rank").collect()]
    assert got == [(1, "t1A", 3, 8, "MK-LAGG", 1, 7, "MKVLAGG"), (2, "t2B", 1, 2, "AA", 4, 5, "LA")]


def test_strands(spark, tmp_path):
    def row(no, aa, ss, *fields):
        line = f"{no:5d}".ljust(19) + aa + "   " + ss
        return line.ljust(38) + " ".join(map(str, fields))

    rest = [0.5] * 14
    text = "\n".join(["h0", "x/1abcA.sst", "h2", " Sequence length 3", "h4", "h5", "h6", row(1, "M", "E", 3, 0, -60.5, 140, *rest), row(2, "K", " ", 0, 0, 999.9, 1, *rest), row(3, "V", "E", 1, 0, 5, 6, *rest)])
    good, errors = R.strands(spark, put(tmp_path, "a.sst", text + "\n"))
    got = [(r.pos, r.aa, r.ss, r.partner1, r.partner2, r.phi) for r in good.orderBy("pos").collect()]
    assert got == [(0, "M", "E", 2, None, -60.5), (1, "K", "L", None, None, 999.9), (2, "V", "E", 0, None, 5.0)] and errors.count() == 0
    _, errors = R.strands(spark, put(tmp_path, "b.sst", text.rsplit("\n", 1)[0]))
    assert [r.reason for r in errors.collect()] == ["too few lines"]
    aligned = spark.createDataFrame([("a", "MGKV", "M-KV")], "name string, seqres string, dssp string")
    assert sorted((r.pos, r.full) for r in R.lift_positions(good, aligned).collect()) == [(0, 0), (1, 2), (2, 3)]


def test_restraints(spark, tmp_path):
    usual = "assign (resid 1 and name CA) (resid 4 and name CA) 5.5 1.0 0.5\n"
    other = "assign (resid 2 and name HA) (resid 3 and name CB) 5.5 1.0 0.5\n"
    got = R.distance_restraints(spark, put(tmp_path, "c.tbl", usual + other))
    assert sorted((r.pair, r.i, r.j, r.dist, r.lower, r.upper) for r in got.collect()) == [("CaCa", 0, 3, 5.5, 1.0, 0.5), ("CaCa", 3, 0, 5.5, 1.0, 0.5)]
    record = ["m_EC52C.pdb", *[f"a b {k}" for k in range(5)], *[f"0.{k} x 0.{k + 1} y" for k in range(5)]]
    s = R.restraint_scores(spark, put(tmp_path, "noe.txt", "\n".join([*record, *record[:4]]))).collect()
    assert len(s) == 1 and (s[0].flagged, s[0].noe) == (True, 2.0) and abs(s[0].tm - 0.2) < 1e-9 and abs(s[0].gdt - 0.3) < 1e-9


def test_cluster_report_and_angles(spark, tmp_path):
    text = "x\nNumber of clusters: 2\ny\n include used structure \na\nb\nc\n1 14 a 2.0 b c d\n2 1 a 0.5 b c d\n3 9 a 1 b c d\n"
    assert [(r.cluster, r.size, r.density) for r in R.cluster_report(spark, put(tmp_path, "rst.dat", text)).orderBy("cluster").collect()] == [(1, 14, 7.0), (2, 1, 0.0)]
    cst = "AtomPair x\nDihedral N 3 CA 3 C 3 N 4 AMBER 1.5 2 0.7\nDihedral C 2 N 3 CA 3 C 3 AMBER 0.5 1 0.2\nDihedral C 2 N 3 CB 3 C 3 AMBER 0.5 1 0.2\n"
    got = R.dihedral_terms(spark, put(tmp_path, "x.cst", cst))
    assert sorted((r.kind, r.pos, r.x0, r.n, r.k) for r in got.collect()) == [("phi", 2, 0.5, 1.0, 0.2), ("psi", 2, 1.5, 2.0, 0.7)]


def test_model_scores(spark, tmp_path):
    scores = R.model_scores(spark, put(tmp_path, "q.ds", "a b c .1 .2 .3 .4 .5 m1\na b c .1 .9 .3 .8 .5 m2\nshort line\n"))
    ranks = R.ranked_models(spark, put(tmp_path, "q.mc", "\n".join(["h"] * 9 + ["1 2 3 4 5 6 m1", "1 2 3 4 5 6 m2"])))
    r = R.first_and_best(ranks, scores).first()
    assert r.first == [0.1, 0.2, 0.3, 0.4, 0.5] and r.best == [0.1, 0.9, 0.3, 0.8, 0.5]


def packed(v):
    if isinstance(v, dict):
        return bytes([0x80 | len(v)]) + b"".join(packed(k) + packed(x) for k, x in v.items())
    if isinstance(v, str):
        return bytes([0xA0 | len(v)]) + v.encode()
    if isinstance(v, int):
        return bytes([v]) if v < 128 else b"\xcd" + struct.pack(">H", v)
    if isinstance(v, float):
        return b"\xcb" + struct.pack(">d", v)
    return b"\xdc" + struct.pack(">H", len(v)) + b"".join(map(packed, v))


def test_couplings(spark, tmp_path):
    x = [i / 10 for i in range(441)]
    doc = {"format": "ccm-1", "ncol": 300, "x_pair": {"0/1": {"i": 0, "j": 1, "x": x}, "2/1": {"i": 2, "j": 1, "x": x}}}
    assert R.unpacked(packed(doc)) == doc
    got = R.couplings(spark, put(tmp_path, "p.braw", packed(doc))).collect()
    assert [(r.name, r.length, r.i, r.j, r.x) for r in got] == [("p", 300, 0, 1, x)]
    with pytest.raises(ValueError, match="is not read"):
        R.unpacked(b"\xc1")


def test_bundle(spark, tmp_path):
    msa = spark.createDataFrame([("a", 0, "AC"), ("a", 1, "A-"), ("b", 0, "G")], "name string, seq_no int, seq string")
    R.write_bundle(msa, msa.select("name", "seq_no", F.lit(0.5).alias("weight")), str(tmp_path / "m"))
    got = R.read_bundle(spark, str(tmp_path / "m")).where("name = 'a'")
    assert sorted((r.seq_no, r.seq, r.w) for r in got.collect()) == [(0, "AC", 0.5), (1, "A-", 0.5)]


def test_label_language(spark):
    df = spark.createDataFrame([("CbCb_Discrete14C",), ("PhiPsi_Normal2d4",), ("x_Other",), ("bare",)], "r string")
    got = [r.x for r in df.select(L.response(F.col("r"), {"14C": 14}).alias("x")).collect()]
    assert tuple(got[0]) == ("CbCb", "Discrete14C", "14C", 1, 14) and tuple(got[1]) == ("PhiPsi", "Normal2d4", "2d4", 2, 4) and got[2:] == [None, None]
    assert L.label_names("CbCb+allap", ["CbCb"], {"AllAP": ["CaCa", "NO"]}) == ["CbCb", "CaCa", "NO"]
    with pytest.raises(ValueError, match="no label Zz"):
        L.label_names("Zz", ["CbCb"], {})
    one = spark.range(1).select(L.coupling_switches(F.lit(9)).alias("s"), L.layers(F.lit("3,5t7 12")).alias("l")).first()
    assert one.s.asDict() == {"fnorm": True, "sum": False, "raw": False, "mutual_information": True, "covariance": False} and one.l == [3, 5, 6, 7, 12]
    d = spark.createDataFrame([(1, [1.0, 2.0], 3.0, 4.0)], "id int, a array<double>, b double, c double")
    assert L.features(d, ["id"], {"seq": True, "no": False, "num": True}, {"seq": ["a"], "no": ["gone"], "num": ["b", "c"]}).first().x == [1.0, 2.0, 3.0, 4.0]
    with pytest.raises(ValueError, match="gone"):
        L.features(d, ["id"], {"no": True}, {"no": ["gone"]})
    y = {r.response: r.label for r in L.labels(d.select("id", "b", "c"), ["id"], {"b": [0, 2, 5]}, ["c"]).collect()}
    assert y["b"] == 1.0 and abs(y["c"] - 1.3862943611) < 1e-9


def greedy(rows, tiers, most, few):
    """The selection row by row, as its definition has it."""
    for t, limit in enumerate(tiers):
        taken, seen = [], set()
        for e, member, cluster in rows:
            own = cluster if cluster is not None else ("m", member)
            if e <= limit and own not in seen and len(taken) < (most if t == 0 else few):
                seen.add(own)
                taken.append(member)
        if taken:
            return taken
    return []


def test_greedy_tiers(spark):
    rng = random.Random(1)
    groups = {g: sorted((round(rng.random() * (1 if g % 3 else 0.1), 6), i, rng.choice([None, *range(4)])) for i in range(rng.randint(1, 25))) for g in range(30)}
    df = spark.createDataFrame([(g, *r) for g, rows in groups.items() for r in rows], "g int, e double, m int, c int")
    tiers = [0.01, 0.1, 0.5]
    got = {}
    for r in Z.greedy_tiers(df, ["g"], "e", ["e", "m"], "m", "c", tiers, 5, 3).orderBy("g", "place").collect():
        got.setdefault(r.g, []).append(r.m)
    assert got == {g: x for g, rows in groups.items() if (x := greedy(rows, tiers, 5, 3))}
    allowed = spark.createDataFrame([(1,), (2,)], "m int")
    assert {r.m for r in Z.greedy_tiers(df, ["g"], "e", ["e"], "m", None, [2.0], 9, 9, F.col("m") == 2, allowed).collect()} == {1}


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_blocked_neighbours(spark, percent):
    rng = random.Random(percent)
    base = [[f"w{rng.randrange(60)}" for _ in range(rng.randint(0, 20))] for _ in range(25)]
    rows = [(i, base[rng.randrange(25)] + [f"w{rng.randrange(60)}" for _ in range(rng.choice([0, 0, 1, 2]))]) for i in range(150)] + [(900, []), (901, None)]
    got = {r.k: r.n for r in Z.blocked_neighbours(spark.createDataFrame(rows, "k int, s array<string>"), "k", "s", percent).collect()}
    sets = {i: set(s or []) for i, s in rows}
    want = {i: max(1, sum(100 * len(a & b) >= percent * len(a | b) for b in sets.values() if a and b)) for i, a in sets.items()}
    assert got == want


def test_blocked_neighbours_in_blocks(spark, monkeypatch):
    """Clusters of many blocks: a large group of near copies, sets of very different sizes, exact copies, keys without value."""
    monkeypatch.setattr(Z, "BLOCK", 8)
    rng = random.Random(5)
    core = [f"c{k}" for k in range(30)]
    rows = [(i, [w for w in core if rng.random() < 0.85] + [f"x{i}"] * (i % 2)) for i in range(90)]
    rows += [(200 + i, [f"c{k % 30}" for k in range(i % 30 + 1)] + [f"y{k}" for k in range(i)]) for i in range(60)] + [(400 + i, core) for i in range(20)] + [(None, core), (901, ["c1", None]), (902, [None, "c1"])]
    got = sorted((r.k is None, r.k or 0, r.n) for r in Z.blocked_neighbours(spark.createDataFrame(rows, "k int, s array<string>"), "k", "s", 60).collect())
    sets = [(k, set(s)) for k, s in rows]
    want = sorted((k is None, k or 0, sum(100 * len(a & b) >= 60 * len(a | b) for _, b in sets)) for k, a in sets)
    assert got == want


def test_blocked_similarity_moves_no_text(spark):
    """What is written holds elements as longs; the words of a shingle are never written."""
    before = set(os.listdir(folder)) if os.path.isdir(folder := shared_folder(spark).removeprefix("file://") + "/lamella") else set()
    plans.queries()["blocked_similarity"](spark, "/root/testdata/sf0.001").collect()
    new = [f"{folder}/{x}" for x in set(os.listdir(folder)) - before]
    assert new and all("string" not in kind for x in new if os.path.isdir(x) for _, kind in spark.read.parquet(x).dtypes)


def test_model_totals(spark):
    d = spark.createDataFrame([("t", "l1", 1.0, 0, 3.0, 0.5), ("t", "l1", 3.0, 0, 1.0, 0.1), ("t", "l2", 1.0, 0, 2.0, 0.3)], "t string, l string, w double, p int, d double, s double")
    r = Z.consensus_error(d, ["t"], "l", "w", "p", "d", ["s"]).first()
    assert abs(r.error - (((9 + 3) / 4 + 4) / 2) ** 0.5) < 1e-9 and abs(r.s - (0.2 + 0.3) / 2) < 1e-9
    x = spark.createDataFrame([("a", 1.0, None), ("a", 2.0, 3.0)], "k string, u double, v double")
    assert tuple(Z.total_potential(x, ["k"], [F.col("u"), F.col("v")]).first()) == ("a", 6.0, 3)
    assert x.select(Z.per_residue([F.col("u"), F.lit(4.0)], [F.lit(2.0), F.lit(1.0)], F.lit(2)).alias("y")).first().y == [2.25, 0.25, 2.0]
    m = spark.createDataFrame([("q", "m1", 8.0), ("q", "m2", 4.0)], "q string, m string, e double")
    rs = spark.createDataFrame([("q", 1), ("q", 2)], "q string, i int")
    assert [(r.m, r.mean_energy) for r in Z.per_restraint(m, rs, ["q"], "e").orderBy("place").collect()] == [("m2", 2.0), ("m1", 4.0)]
    c = spark.createDataFrame([("CbCb", "a", 1), ("CbCb", "a", 2), ("NO", "b", 1)], "label string, kind string, bins int")
    assert {r.label: r.consistent for r in Z.consistent_models(c, "label", ["kind", "bins"]).collect()} == {"CbCb": False, "NO": True}


def test_alignment_features(spark):
    ali = spark.createDataFrame([("t", "AC-D", "GCKD")], "t string, t_seq string, q_seq string")
    tpl = spark.createDataFrame([("t", 0, 0.5), ("t", 1, 0.25)], "t string, i int, acc double")
    got = Z.alignment_features(A.positional_join(ali, ["t"]), tpl, ["t"], ["acc"], F.lit(4))
    assert [(r.j, r.same, r.share, r.acc) for r in got.orderBy("j").collect()] == [(0, 0, 0.75, 0.5), (1, 1, 0.75, 0.25), (3, 1, 0.75, None)]


def test_profile_transform(spark, tmp_path):
    rng = np.random.default_rng(4)
    emission, null = rng.integers(500, 9000, (2, 20)), rng.integers(2000, 6000, 20)
    moves = [[0, 3000, "*", 500, 1500, 700, 800, 4000, 2000, "*"], [10, 20, 30, 40, 50, 60, 70, 1000, 1000, 1000]]
    rows = "".join(f"A {k + 1} {' '.join(map(str, emission[k]))} {k + 1}\n{' '.join(map(str, moves[k]))}\n\n" for k in range(2))
    text = f"NAME x\n#\nNULL {' '.join(map(str, null))}\nHMM A C\n M->M\n 0 *\n{rows}A 3 {'* ' * 20}3\n{' '.join(map(str, moves[1]))}\n\n//\n"
    table = rng.random((20, 20)) + 0.1
    got = Q.transformed(readers.profiles(spark, put(tmp_path, "x.hhm", text)), table.tolist()).orderBy("pos").collect()
    for k in range(2):
        p = 2.0 ** (-emission[k] / 1000)
        p /= p.sum()
        g = (p @ table) * 2.0 ** (-null / 1000)
        g /= g.sum()
        n = [4.0, 1.0][k]
        f = ((n - 1) * p + 10 * g) / (n + 9)
        np.testing.assert_allclose(got[k].frequency, f)
        np.testing.assert_allclose(got[k].score, np.log2(f) + null / 1000)
    assert abs(got[0].smoothed[0] - (4 * 1 + 0.06) / 4.1) < 1e-12 and abs(got[0].smoothed[2] - 0.02 / 4.1) < 1e-12 and got[0].transition[9] == 99.999
    assert abs(sum(got[2].frequency) - 1) < 1e-9


def test_hits_in_full(spark, tmp_path):
    text = """Query         q1 text
Match_columns 9
Neff          6.5

No 1
>t1 some protein
Probab=99.5  E-value=1e-9  Score=50.1  Aligned_cols=4  Identities=50%  Similarity=0.9  Sum_probs=3.9

Q q1   3 AC-D  5 (9)
Q Consensus 3 ac~d 5 (9)
T t1   1 ACGD  4 (8)

Q q1   6 EF  7 (9)
T t1   5 E-  5 (8)

No 2
>t2
Q q1   3 AC  4 (9)

No 3
>t3
Probab=9  E-value=1  Score=5  Aligned_cols=4  Identities=5%  Similarity=0.9  Sum_probs=3
Q q1   3 AC  4 (9)
"""
    path = put(tmp_path, "x.hhr", text)
    r = readers.hits(spark, path).collect()
    assert len(r) == 1 and (r[0].query, r[0].query_length, r[0].neff, r[0].description, r[0].q_seq, r[0].t_seq) == ("q1", 9, 6.5, "some protein", "AC-DEF", "ACGDE-")
    assert (r[0].q_start, r[0].q_end, r[0].t_start, r[0].t_end, r[0].t_length) == (3, 7, 1, 5, 8)
    assert sorted((x["rank"], x.reason) for x in readers.broken_hits(spark, path).collect()) == [(1, "no scores"), (2, "rows of different length")]


def test_target_sections(spark, tmp_path):
    path = put(tmp_path, "x.tpl", "Version = 1\nSequence = AC=D\n//////////// Features\nNum Res SS\n1 A H 0.5\n2 C E x\n")
    assert sorted((r.key, r.value) for r in readers.header_values(spark, path).collect()) == [("Sequence", "AC=D"), ("Version", "1")]
    got = readers.section_rows(spark, path, "Features", 3, 1)
    assert [(r.pos, r.words, r.v) for r in got.orderBy("pos").collect()] == [(0, ["1", "A", "H"], [0.5]), (1, ["2", "C", "E"], [None])]
