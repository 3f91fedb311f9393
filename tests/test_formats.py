import struct

import numpy as np
from pyspark.sql import functions as F

from lamella.sources import readers as R
from lamella.sources import writers as K
from lamella.streaming import streams


def put(folder, name, text):
    path = folder / name
    path.write_bytes(text) if isinstance(text, bytes) else path.write_text(text)
    return str(path)


def text_of(spark, path):
    return [r.value for r in spark.read.text(path).collect()]


def test_sequence_files(spark, tmp_path):
    a3m = put(tmp_path, "x.a3m", ">ss_pred\nHHH\n>q one\nAC-\nDE\n>h\nACd-E\n\n")
    got = [(r.seq_no, r.header, r.seq) for r in R.multi_fasta(spark, a3m).orderBy("seq_no").collect()]
    assert got == [(0, "q one", "AC-DE"), (1, "h", "ACd-E")]
    rows, check = R.a2m(spark, put(tmp_path, "m.a2m", "AC-\nACD\n"))
    assert rows.count() == 2 and check.first().even
    assert not R.a2m(spark, put(tmp_path, "n.a2m", "AC\nACD\n"))[1].first().even
    pair = put(tmp_path, "p.fasta", ">q\nA-C\n>t\nAGC\n")
    assert tuple(R.pair_alignment(spark, pair, "q").first())[1:] == ("t", "q", "AGC", "A-C")
    four = put(tmp_path, "f.txt", ">t1\nAC\n>q\nA-\n\n>t2\nGC\n>q\nGC\n")
    assert [(r.template, r.q_seq) for r in R.alignments(spark, four).orderBy("block").collect()] == [("t1", "A-"), ("t2", "GC")]
    K.write_fasta(R.multi_fasta(spark, a3m), str(tmp_path / "out"))
    assert text_of(spark, str(tmp_path / "out")) == [">q one", "AC-DE", ">h", "ACd-E"]


def test_matrices_and_contacts(spark, tmp_path):
    m = R.matrix(spark, put(tmp_path, "m.mat", "1 2\n3 4.5\n"))
    assert {(r.i, r.j): r.v for r in m.collect()} == {(0, 0): 1, (0, 1): 2, (1, 0): 3, (1, 1): 4.5}
    K.write_matrix(m, str(tmp_path / "mat"))
    assert text_of(spark, str(tmp_path / "mat")) == ["1.000000 2.000000", "3.000000 4.500000"]
    s = R.sparse_pairs(spark, put(tmp_path, "s.txt", "1 3 0.5 0.25\n2 2 1 1\n"))
    assert {(r.i, r.j): r.v for r in s.collect()} == {(0, 2): [0.5, 0.25], (2, 0): [0.5, 0.25], (1, 1): [1.0, 1.0]}
    pairs = spark.createDataFrame([(0, 7, 0.91234), (0, 3, 0.99), (1, 9, 0.95)], "i int, j int, p double")
    K.write_contacts(pairs, str(tmp_path / "rr"), "T1")
    out = text_of(spark, str(tmp_path / "rr"))
    assert out == ["PFRMAT RR", "TARGET T1", "RMODE 2", "MODEL 1", "2 10 0.950", "1 8 0.912", "END"]
    good, bad = R.contacts(spark, put(tmp_path, "c.rr", "\n".join(out + ["9 2 0.5", "1 9 1.5"])))
    assert good.count() == 2 and bad.count() == 2
    raw = struct.pack("<i", 2) + np.zeros(42, "<f4").tobytes() + np.arange(4 * 441, dtype="<f4").tobytes()
    mi = {(r.i, r.j): r.v[0] for r in R.raw_mutual_information(spark, put(tmp_path, "z.mi", raw)).collect()}
    assert mi == {(0, 0): 0.0, (0, 1): 441.0, (1, 0): 882.0, (1, 1): 1323.0}


def test_structures_and_profiles(spark, tmp_path):
    line = "ATOM  {:5d}  {:<3s} {:>3s} {:1s}{:4d}    {:8.3f}{:8.3f}{:8.3f}{:6.2f}{:6.2f}"
    rows = [line.format(1, "CA", "ALA", "A", 1, 1, 2, 3, 1, 9.5), line.format(2, "CA", "MSE", "A", 2, 1, 2, 4, 1, 8), "ENDMDL", line.format(3, "CA", "GLY", "A", 3, 0, 0, 0, 1, 1)]
    atoms = R.atoms(spark, put(tmp_path, "p.pdb", "\n".join(rows)))
    assert [(r.atom, r.pos, r.z, r.bfactor) for r in atoms.orderBy("pos").collect()] == [("CA", 1, 3.0, 9.5), ("CA", 2, 4.0, 8.0)]
    assert R.chain_sequences(atoms).first().seq == "AX"
    hmm = "NAME x\n#\nNULL " + "1 " * 20 + "\nHMM A\n  M->M\n  0 *\n" + "A 1 " + "1000 " * 19 + "* 1\n" + "0 * * * * * * 1000 2000 3000\n\n//\n"
    r = R.profiles(spark, put(tmp_path, "x.hhm", hmm)).first()
    assert r.aa == "A" and r.emission[0] == 0.5 and r.emission[19] == 0 and r.transition[-1] == 3
    hhr = "Query         q1\n\nNo 1\n>t1 text\nProbab=99.5  E-value=1e-9  Score=50.1  Aligned_cols=4  Identities=50%  Similarity=0.9  Sum_probs=3.9\n\nQ q1   3 AC-D  5 (9)\nT t1   1 ACGD  4 (8)\n"
    h = R.hits(spark, put(tmp_path, "x.hhr", hhr)).first()
    assert (h.query, h.template, h.evalue, h.q_seq, h.t_seq, h.q_start, h.identity) == ("q1", "t1", 1e-9, "AC-D", "ACGD", 3, 0.5)
    sec = R.sections(spark, put(tmp_path, "x.tgt", "Version = 1\n//////////// Original PSM\n1 2\n3 4\n//////////// SS3\n.1 .2\n"))
    assert [(r.section, r.no, r.line) for r in sec.orderBy("section", "no").collect()] == [("", 0, "Version = 1"), ("Original PSM", 0, "1 2"), ("Original PSM", 1, "3 4"), ("SS3", 0, ".1 .2")]
    assert R.key_values(spark, put(tmp_path, "k.spec", "# c\na = 1=2\n\nb=x\n")).count() == 2
    assert {(r.cluster, r.member) for r in R.clusters(spark, put(tmp_path, "c.txt", "a b\nc\n")).collect()} == {(0, "a"), (0, "b"), (1, "c")}
    assert R.listing(spark, str(tmp_path), "*.pdb").count() == 1


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(0, 1, 1.0), (0, 2, float("nan"))], "i int, j int, v double")
    assert K.write_constraints(df, str(tmp_path / "c"), "v") == 1 and text_of(spark, str(tmp_path / "c")) == ["AtomPair 1 2 1.00000"]
    assert {r.chunk: r["count"] for r in K.chunked(spark.range(7), ["id"], 3).groupBy("chunk").count().collect()} == {0: 3, 1: 3, 2: 1}
    h = K.helix_restraints(spark.createDataFrame([(1, 4)], "first int, last int"))
    assert {(r.i, r.j) for r in h.collect()} == {(1, 3), (1, 4), (2, 4)}
    a = spark.createDataFrame([("t", "q", "AC", "GC", "MGCK", 2)], "template string, query string, t_seq string, q_seq string, q_full string, q_from int")
    K.write_alignments(a, str(tmp_path / "a"))
    assert text_of(spark, str(tmp_path / "a" / "template=t")) == [">t", "-AC-", ">q", "MGCK"]


def test_streams(spark, tmp_path):
    e = spark.createDataFrame([(i, i % 3, "view", i) for i in range(30)], "event_id long, user_id long, event_type string, s long").select("event_id", "user_id", "event_type", F.timestamp_seconds(F.col("s") * 600).alias("ts"))
    folder = str(tmp_path / "in")
    e.repartition(3).write.parquet(folder)
    seen = []
    take = lambda batch, _: seen.append(batch.count())
    stream = streams.file_stream(spark, folder, e.schema)
    streams.feed(stream, take, str(tmp_path / "ck")).awaitTermination()
    streams.feed(streams.file_stream(spark, folder, e.schema), take, str(tmp_path / "ck")).awaitTermination()
    assert sum(seen) == 30 and len(seen) == 3
    q = streams.tumbling_counts(streams.file_stream(spark, folder, e.schema, 10)).writeStream.format("memory").queryName("tumble").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert all(r.n == 6 for r in spark.table("tumble").collect())
