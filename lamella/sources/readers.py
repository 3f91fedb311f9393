"""Readers of text and binary formats. Each file is one row of Spark's text or binary source; records come out of it
by column functions where the format allows, by Arrow-batched parsers where sections follow one another."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _name() -> Column:
    return F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of whole files; ``path`` may be a glob."""
    return spark.read.text(path, wholetext=True).select(_name().alias("name"), F.col("value").alias("text"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(name, no from 0, line) without empty lines at the end."""
    rows = F.split(F.regexp_replace("text", r"\r?\n$", ""), r"\r?\n")
    return files(spark, path).select("name", F.posexplode(rows).alias("no", "line"))


def listing(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """Names and sizes of the files that a pattern matches."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length", F.regexp_extract("path", r"([^/]+)$", 1).alias("file"))


def multi_fasta(spark: SparkSession, path: str, skip: str = "^(ss_pred|ss_conf|ss_dssp)") -> DataFrame:
    """(name, seq_no, header, seq) of FASTA and A3M files; bodies of several lines are joined, structure rows skipped."""
    records = F.filter(F.split(F.concat(F.lit("\n"), "text"), r"\n>"), lambda r: F.trim(r) != "")
    one = files(spark, path).select("name", F.posexplode(records).alias("seq_no", "r"))
    header = F.trim(F.regexp_extract("r", r"^([^\r\n]*)", 1))
    out = one.select("name", "seq_no", header.alias("header"), F.regexp_replace(F.regexp_replace("r", r"^[^\n]*\n?", ""), r"\s", "").alias("seq"))
    kept = out.where(~F.col("header").rlike(skip))
    return kept.withColumn("seq_no", F.row_number().over(Window.partitionBy("name").orderBy("seq_no")) - 1)


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, header, seq) of the first record of each file."""
    return multi_fasta(spark, path).where("seq_no = 0").drop("seq_no")


def a2m(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows: name, seq_no, seq; check: name, whether all rows are equally long)."""
    rows = lines(spark, path).where(F.trim("line") != "").select("name", F.col("no").alias("seq_no"), F.trim("line").alias("seq"))
    return rows, rows.groupBy("name").agg((F.min(F.length("seq")) == F.max(F.length("seq"))).alias("even"))


def pair_alignment(spark: SparkSession, path: str, query: str | None = None) -> DataFrame:
    """(name, template, query, t_seq, q_seq): the first record is the template unless it has the query's name."""
    r = multi_fasta(spark, path, skip="^$").groupBy("name").agg(F.max_by("header", F.when(F.col("seq_no") == 0, 1).otherwise(0)).alias("h1"), F.max_by("seq", F.when(F.col("seq_no") == 0, 1).otherwise(0)).alias("s1"), F.max_by("header", F.when(F.col("seq_no") == 1, 1).otherwise(0)).alias("h2"), F.max_by("seq", F.when(F.col("seq_no") == 1, 1).otherwise(0)).alias("s2"))
    swap = F.lit(False) if query is None else F.col("h1") == query
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    return r.select("name", pick("h1", "h2").alias("template"), pick("h2", "h1").alias("query"), pick("s1", "s2").alias("t_seq"), pick("s2", "s1").alias("q_seq"))


def blocks(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(name, block, lines) of files with ``size`` lines for each record."""
    li = lines(spark, path).where(F.trim("line") != "")
    n = li.withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("no")) - 1)
    return n.groupBy("name", F.floor(F.col("k") / size).alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]).alias("lines"))


def alignments(spark: SparkSession, path: str) -> DataFrame:
    """Four lines for each alignment: >template, sequence, >query, sequence."""
    at = lambda i: F.trim(F.element_at("lines", i))
    return blocks(spark, path, 4).select("name", "block", F.ltrim(at(1), F.lit(">")).alias("template"), at(2).alias("t_seq"), F.ltrim(at(3), F.lit(">")).alias("query"), at(4).alias("q_seq"))


def table_rows(spark: SparkSession, path: str, skip: int = 0) -> DataFrame:
    """(name, no, fields) of white-space separated rows after ``skip`` header lines."""
    return lines(spark, path).where((F.col("no") >= skip) & (F.trim("line") != "")).select("name", (F.col("no") - skip).alias("no"), F.split(F.trim("line"), r"\s+").alias("fields"))


def probabilities(spark: SparkSession, path: str, skip: int, first: int = 4) -> DataFrame:
    """(name, pos, p): columns from ``first`` (from 1) on; rows with values that are no numbers are marked."""
    p = F.transform(F.slice("fields", F.lit(first), F.size("fields") - (first - 1)), lambda x: x.try_cast("double"))
    return table_rows(spark, path, skip).select("name", F.col("no").alias("pos"), p.alias("p"), F.exists(p, lambda x: x.isNull() | F.isnan(x)).alias("bad"))


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """(name, i, j, v) of a dense matrix."""
    return table_rows(spark, path).select("name", F.col("no").alias("i"), F.posexplode("fields").alias("j", "v")).withColumn("v", F.col("v").try_cast("double"))


def sparse_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(name, i, j, v) from lines "i j v1 v2 ..." with numbers from 1, in both orders, from 0."""
    f = table_rows(spark, path).select("name", (F.get("fields", 0).try_cast("int") - 1).alias("i"), (F.get("fields", 1).try_cast("int") - 1).alias("j"), F.transform(F.slice("fields", F.lit(3), F.size("fields") - 2), lambda x: x.try_cast("double")).alias("v"))
    return f.unionByName(f.where("i <> j").withColumns({"i": F.col("j"), "j": F.col("i")}))


def contacts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(name, i, j, p, bins) of CASP RR files with numbers from 1; and the pair lines that break the format's rules."""
    f = table_rows(spark, path).where(F.get("fields", 0).rlike("^[0-9]+$")).select("name", F.get("fields", 0).try_cast("int").alias("i"), F.get("fields", 1).try_cast("int").alias("j"), F.get("fields", 2).try_cast("double").alias("p"), F.transform(F.slice("fields", F.lit(4), F.greatest(F.size("fields") - 3, F.lit(0))), lambda x: x.try_cast("double")).alias("bins"))
    ok = F.coalesce((F.col("i") < F.col("j")) & F.col("p").between(0, 1) & ~F.exists("bins", lambda x: x.isNull()), F.lit(False))
    return f.where(ok), f.where(~ok)


def atoms(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of PDB files up to the end of the first model: fixed columns; bfactor holds quality in model files."""
    li = lines(spark, path)
    w = Window.partitionBy("name").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    own = li.withColumn("ended", F.max(F.col("line").startswith("ENDMDL").cast("int")).over(w)).where("ended = 0 and line like 'ATOM%'")
    cut = lambda a, n, kind: F.trim(F.substring("line", a, n)).try_cast(kind)
    return own.select(
        "name", cut(7, 5, "int").alias("serial"), cut(13, 4, "string").alias("atom"), cut(18, 3, "string").alias("resname"), cut(22, 1, "string").alias("chain"), cut(23, 4, "int").alias("pos"), cut(27, 1, "string").alias("icode"),
        cut(31, 8, "double").alias("x"), cut(39, 8, "double").alias("y"), cut(47, 8, "double").alias("z"), cut(61, 6, "double").alias("bfactor"),
    )


#: Three-letter residue names in the order of functions.sequences.THREE_LETTER_ORDER.
RESIDUE_NAMES = "ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL".split()


def chain_sequences(atom_rows: DataFrame) -> DataFrame:
    """(name, chain, seq): one letter for each residue, X where its name is not standard."""
    from lamella.functions.sequences import THREE_LETTER_ORDER

    names = F.array(*[F.lit(x) for x in RESIDUE_NAMES])
    letter = F.when(F.array_contains(names, F.col("resname")), F.substring(F.lit(THREE_LETTER_ORDER), F.array_position(names, F.col("resname")).cast("int"), F.lit(1))).otherwise("X")
    res = atom_rows.select("name", "chain", "pos", "icode", letter.alias("aa")).dropDuplicates(["name", "chain", "pos", "icode"])
    return res.groupBy("name", "chain").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "icode", "aa"))), lambda x: x["aa"]), "").alias("seq"))


def seqres(spark: SparkSession, path: str) -> DataFrame:
    """(name, chain, residues) from SEQRES records."""
    li = lines(spark, path).where(F.col("line").startswith("SEQRES")).select("name", "no", F.substring("line", 12, 1).alias("chain"), F.split(F.trim(F.substring("line", 20, 60)), r"\s+").alias("r"))
    return li.groupBy("name", "chain").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("no", "r"))), lambda x: x["r"])).alias("residues"))


def secondary_structure(spark: SparkSession, path: str) -> DataFrame:
    """(name, chain, pos, aa, ss8, acc, phi, psi) of DSSP files: the rows after the header line that starts with '  #'."""
    li = lines(spark, path)
    w = Window.partitionBy("name").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    own = li.withColumn("on", F.max(F.col("line").startswith("  #").cast("int")).over(w)).where("on = 1")
    cut = lambda a, n, kind: F.trim(F.substring("line", a, n)).try_cast(kind)
    ss = F.substring("line", 17, 1)
    return own.select("name", cut(12, 1, "string").alias("chain"), cut(6, 5, "int").alias("pos"), cut(14, 1, "string").alias("aa"), F.when(ss == " ", "L").otherwise(ss).alias("ss8"), cut(35, 4, "int").alias("acc"), cut(104, 6, "double").alias("phi"), cut(110, 6, "double").alias("psi")).where("pos is not null")


def key_values(spark: SparkSession, path: str) -> DataFrame:
    """(name, key, value) of "key = value" lines; comments and blank lines are skipped."""
    li = lines(spark, path).where(F.col("line").rlike(r"^[^#=]+=")).select("name", F.trim(F.split("line", "=", 2)[0]).alias("key"), F.trim(F.split("line", "=", 2)[1]).alias("value"))
    return li


def clusters(spark: SparkSession, path: str) -> DataFrame:
    """(name, cluster from 0, member): one line for each cluster."""
    return table_rows(spark, path).select("name", F.col("no").alias("cluster"), F.explode("fields").alias("member"))


def metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def angles(spark: SparkSession, path: str) -> DataFrame:
    """(name, pos, phi, psi) in radians, from rows of 3 columns (no, phi, psi) or 10 (angles in columns 8 and 9)."""
    f = table_rows(spark, path)
    at = lambda k: F.radians(F.get("fields", k).try_cast("double"))
    wide = F.size("fields") == 10
    return f.where(F.size("fields").isin(3, 10)).select("name", F.col("no").alias("pos"), F.when(wide, at(7)).otherwise(at(1)).alias("phi"), F.when(wide, at(8)).otherwise(at(2)).alias("psi"))


def raw_mutual_information(spark: SparkSession, path: str) -> DataFrame:
    """(name, i, j, v): a dump of int32 L, L x 21 floats, then L x L blocks of 441 floats."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for p in batches:
            for name, content in zip(p["name"], p["content"], strict=True):
                (n,) = struct.unpack_from("<i", content)
                x = np.frombuffer(content, "<f4", n * n * 441, 4 + n * 21 * 4).reshape(n * n, 441)
                i, j = np.divmod(np.arange(n * n), n)
                yield pd.DataFrame({"name": name, "i": i, "j": j, "v": list(x.astype(float))})

    raw = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("name"), "content")
    return raw.mapInPandas(parse, "name string, i long, j long, v array<double>")


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """(name, pos, aa, emission[20], transition[10], background[20]) of HHM files: probabilities are 2 ** (-x / 1000), * is 0; the last three
    transitions are effective numbers; background holds the numbers of the NULL line."""

    def number(x: str) -> float:
        return 0.0 if x == "*" else 2.0 ** (-float(x) / 1000)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = []
            for name, text in zip(p["name"], p["text"], strict=True):
                body = text.split("\n#\n", 1)[-1].splitlines()
                null = next((x.split()[1:21] for x in body if x.startswith("NULL")), [])
                background = [99999.0 if x == "*" else float(x) for x in null]
                at = next((k for k, x in enumerate(body) if x.startswith("HMM ")), len(body)) + 3
                while at + 1 < len(body) and not body[at].startswith("//"):
                    f, t = body[at].split(), body[at + 1].split()
                    if len(f) >= 22 and len(t) >= 10:
                        effective = [99.999 if x == "*" else float(x) / 1000 for x in t[7:10]]
                        rows.append((name, int(f[1]) - 1, f[0], [number(x) for x in f[2:22]], [number(x) for x in t[:7]] + effective, background))
                    at += 3
            yield pd.DataFrame(rows, columns=["name", "pos", "aa", "emission", "transition", "background"])

    return files(spark, path).mapInPandas(parse, "name string, pos long, aa string, emission array<double>, transition array<double>, background array<double>")


def sections(spark: SparkSession, path: str, rule: str = r"^/{4,}\s*") -> DataFrame:
    """(name, section, no, line) of sectioned text (targets, templates): a rule line names the section that follows;
    lines before the first one are the section ''."""
    li = lines(spark, path)
    w = Window.partitionBy("name").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    title = F.when(F.col("line").rlike(rule), F.trim(F.regexp_replace("line", rule, "")))
    s = li.withColumn("title", title).withColumn("section", F.coalesce(F.last("title", ignorenulls=True).over(w), F.lit("")))
    return s.where("title is null").select("name", "section", (F.row_number().over(Window.partitionBy("name", "section").orderBy("no")) - 1).alias("no"), "line")


def header_values(spark: SparkSession, path: str) -> DataFrame:
    """(name, key, value) of the lines "key = value" before the first section of targets and templates."""
    own = sections(spark, path).where((F.col("section") == "") & F.col("line").contains("="))
    return own.select("name", F.trim(F.substring_index("line", "=", 1)).alias("key"), F.trim(F.regexp_replace("line", r"^[^=]*=", "")).alias("value"))


def section_rows(spark: SparkSession, path: str, section: str, text: int = 0, skip: int = 0) -> DataFrame:
    """(name, pos, words, v): the rows of a section after ``skip`` header lines; the first ``text`` fields are words, the others numbers (null where they are none)."""
    own = sections(spark, path).where((F.col("section") == section) & (F.col("no") >= skip) & (F.trim("line") != ""))
    f = F.split(F.trim("line"), r"\s+")
    return own.select("name", (F.col("no") - skip).alias("pos"), F.slice(f, 1, text).alias("words") if text else F.array().cast("array<string>").alias("words"), F.transform(F.slice(f, F.lit(text + 1), F.greatest(F.size(f) - text, F.lit(0))), lambda x: x.try_cast("double")).alias("v"))


_HIT = "name string, query string, query_length long, neff double, rank long, template string, description string, probability double, evalue double, score double, aligned_cols long, identity double, similarity double, sum_probs double, q_seq string, t_seq string, q_start int, q_end int, t_start int, t_end int, t_length int"


def _hit_blocks(spark: SparkSession, path: str) -> DataFrame:
    import re

    score = re.compile(r"Probab=(\S+)\s+E-value=(\S+)\s+Score=(\S+)\s+Aligned_cols=(\d+)\s+Identities=(\d+)%\s+Similarity=(\S+)\s+Sum_probs=(\S+)")
    names = [x.split()[0] for x in _HIT.split(", ")] + ["reason"]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = []
            for name, text in zip(p["name"], p["text"], strict=True):
                head, *found = re.split(r"(?m)^No \d+\s*$", text)
                of = lambda tag: (re.search(rf"(?m)^{tag}\s+(\S+)", head) or [None, None])[1]  # noqa: B023, E731
                length, neff = of("Match_columns"), of("Neff")
                for k, block in enumerate(found):
                    m, title = score.search(block), re.search(r"(?m)^>(\S+)[ \t]*(.*)$", block)
                    sides = {"Q": ["", None, None, None], "T": ["", None, None, None]}
                    for side, tag, start, seq, end, whole in re.findall(r"(?m)^([QT])\s+(\S+)\s+(\d+)\s+(\S+)\s+(\d+)(?:\s+\((\d+)\))?", block):
                        if tag in ("Consensus", "ss_pred", "ss_dssp", "ss_conf"):
                            continue
                        own = sides[side]
                        own[0] += seq
                        own[1], own[2], own[3] = own[1] or int(start), int(end), int(whole) if whole else own[3]
                    (q_seq, q_start, q_end, q_whole), (t_seq, t_start, t_end, t_whole) = sides["Q"], sides["T"]
                    reason = None if m and title and q_seq and len(q_seq) == len(t_seq) else "no template" if not title else "no scores" if not m else "rows of different length"
                    v = [float(x) for x in m.groups()] if m else [None] * 7
                    rows.append((name, of("Query"), int(length) if length else q_whole, float(neff) if neff else None, k, title[1] if title else None, title[2] if title else None, v[0], v[1], v[2], None if v[3] is None else int(v[3]), None if v[4] is None else v[4] / 100, v[5], v[6], q_seq, t_seq, q_start, q_end, t_start, t_end, t_whole, reason))
            yield pd.DataFrame(rows, columns=names).astype(object).where(lambda d: d.notna(), None)

    return files(spark, path).mapInPandas(parse, f"{_HIT}, reason string")


def hits(spark: SparkSession, path: str) -> DataFrame:
    """One row for each hit of search-result (HHR) files: scores, both aligned sequences with their ends, lengths and the query's effective number."""
    return _hit_blocks(spark, path).where("reason is null").drop("reason")


def broken_hits(spark: SparkSession, path: str) -> DataFrame:
    """(name, rank, reason) of the hits that ``hits`` leaves out."""
    return _hit_blocks(spark, path).where("reason is not null").select("name", "rank", "reason")


def embedding_table(spark: SparkSession, path: str) -> DataFrame:
    """(gram, v) of a word-embedding table."""
    return table_rows(spark, path).select(F.get("fields", 0).alias("gram"), F.transform(F.slice("fields", F.lit(2), F.size("fields") - 1), lambda x: x.try_cast("double")).alias("v"))
