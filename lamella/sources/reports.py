"""Readers of report files: threading ranks, strand tables, restraints, cluster reports, model scores, couplings.

Lines are rows with their number; what a line means follows from its words and from its place, by column functions.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamella.sources.readers import lines


def _words(li: DataFrame) -> DataFrame:
    """Lines with their words ``f``."""
    return li.withColumn("f", F.filter(F.split(F.trim("line"), r"\s+"), lambda x: x != ""))


def _at(i: int, kind: str = "string") -> Column:
    word = F.get("f", i) if i >= 0 else F.try_element_at("f", F.lit(i))
    return word if kind == "string" else word.try_cast(kind)


def rank_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Threading ranks. (table: name, query, length, rank, template, pvalue, identical, identity;
    alignments: name, rank, template, t_start, t_end, t_seq, q_start, q_end, q_seq).

    The table's rows have 13 words and follow the header "No Template Pvalue ..."; identity is the last word over
    the query's length. An alignment starts with "No <rank>" and ">template"; in each of its blocks the sequence line of T
    comes first, that of S second: side, name, start, letters, end, whole length."""
    li = _words(lines(spark, path))
    head = li.groupBy("name").agg(*[F.max(F.when((_at(0) == "Query") & (_at(1) == what), _at(3))).alias(as_) for what, as_ in (("Name", "query"), ("Length", "length"))], F.min(F.when((_at(0) == "No") & (_at(1) == "Template") & (_at(2) == "Pvalue"), F.col("no"))).alias("top"))
    after = li.join(head, "name").where("no > top")
    # The table ends with the first line of other than 13 words.
    end = after.where(F.size("f") != 13).groupBy("name").agg(F.min("no").alias("end"))
    rows = after.join(end, "name", "left").where("end is null or no < end")
    length = F.col("length").cast("long")
    table = rows.select("name", "query", length.alias("length"), _at(0, "int").alias("rank"), _at(1).alias("template"), _at(2, "double").alias("pvalue"), _at(-1, "double").alias("identical"), (_at(-1, "double") / length).alias("identity"))
    block = Window.partitionBy("name").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    start = (F.size("f") == 2) & (_at(0) == "No") & _at(1, "int").isNotNull()
    body = after.withColumn("rank", F.last(F.when(start, _at(1, "int")), ignorenulls=True).over(block)).where("rank is not null")
    title = body.where(F.col("line").startswith(">")).groupBy("name", "rank").agg(F.min_by(F.trim(F.substring("line", 2, 1 << 20)), "no").alias("template"))
    seq = body.where((F.size("f") == 6) & _at(2, "int").isNotNull() & _at(4, "int").isNotNull() & _at(3).rlike("^[A-Za-z-]+$") & _at(0).isin("T", "S", "Q"))
    side = F.when(_at(0) == "T", "t").otherwise("q")
    seq = seq.select("name", "rank", "no", side.alias("side"), _at(2, "int").alias("from"), _at(3).alias("letters"), _at(4, "int").alias("to"))
    both = seq.groupBy("name", "rank", "side").agg(F.min("from").alias("start"), F.max("to").alias("end"), F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("no", "letters"))), lambda x: x["letters"])).alias("seq"))
    one = lambda s: both.where(F.col("side") == s).select("name", "rank", *[F.col(c).alias(f"{s}_{c}") for c in ("start", "end", "seq")])
    return table, title.join(one("t"), ["name", "rank"]).join(one("q"), ["name", "rank"])


def strands(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Strand tables. (residues: name, pos, aa, ss, partner1, partner2, phi, psi, bonds;
    errors: name, reason). Positions are from 0, absent partners null.

    Line 4 holds the length, residues follow from line 8 on: number, letter in column 20, class in column 24 (blank: L),
    and 18 fields from column 39 on, of which the first four are partners, phi and psi; ``bonds`` are the others."""
    li = lines(spark, path)
    size = li.where("no = 3").select("name", F.regexp_extract("line", r"(\d+)\s*$", 1).try_cast("int").alias("size"), F.col("line").startswith(" Sequence").alias("ok"))
    body = li.join(size, "name").where("no >= 7 and no < 7 + size").withColumn("f", F.filter(F.split(F.trim(F.substring("line", 39, 1 << 20)), r"\s+"), lambda x: x != ""))
    partner = lambda i: F.when(_at(i, "int") > 0, _at(i, "int") - 1)
    letter = F.trim(F.substring("line", 24, 1))
    good = body.where("ok").where(F.size("f") == 18).select(
        "name", (F.trim(F.substring("line", 1, 5)).try_cast("int") - 1).alias("pos"), F.substring("line", 20, 1).alias("aa"), F.when(letter == "", "L").otherwise(letter).alias("ss"),
        partner(0).alias("partner1"), partner(1).alias("partner2"), _at(2, "double").alias("phi"), _at(3, "double").alias("psi"), F.slice("f", 5, 14).alias("bonds"),
    )
    bad = body.groupBy("name").agg(F.max("size").alias("size"), F.count("*").alias("n"), F.count_if(F.size("f") != 18).alias("wrong"))
    errors = size.where("size is null or not ok").select("name", F.lit("no length").alias("reason")).unionAll(bad.where("n < size").select("name", F.lit("too few lines"))).unionAll(bad.where("wrong > 0").select("name", F.lit("a line without 18 fields")))
    return good, errors


def lift_positions(residues: DataFrame, aligned: DataFrame, whole: str = "seqres", seen: str = "dssp") -> DataFrame:
    """Positions of ``residues`` in the whole sequence: ``aligned`` (name, whole, seen) has a gap in ``seen`` for each residue without coordinates.
    (all columns, full); a name whose letters differ is left out."""
    a = aligned.select("name", F.posexplode(F.split(F.col(seen), "")).alias("full", "letter"), F.regexp_replace(seen, "-", "").alias("letters")).where("letter not in ('-', '')")
    own = Window.partitionBy("name").orderBy("full")
    a = a.withColumn("pos", F.row_number().over(own) - 1)
    same = residues.groupBy("name").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("pos", "aa"))), lambda x: x["aa"])).alias("letters"))
    return residues.join(a.join(same, ["name", "letters"]).select("name", "pos", "full"), ["name", "pos"])


def distance_restraints(spark: SparkSession, path: str) -> DataFrame:
    """(name, pair, i, j, dist, lower, upper) of "assign" lines, positions from 0, in both orders. Pairs are named by the first two letters
    of their atoms; others than CaCa, CbCb, NO, CgCg and CaCg are left out."""
    f = _words(lines(spark, path)).where(F.size("f") >= 14)
    atom = lambda i: F.upper(F.substring(F.regexp_replace(_at(i), r"\)?$", ""), 1, 2))
    key = F.concat_ws("-", atom(5), atom(10))
    # The kinds of pairs that models are built with.
    kinds = {"CA-CA": "CaCa", "CB-CB": "CbCb", "N-O": "NO", "CG-CG": "CgCg", "CA-CG": "CaCg"}
    named = F.coalesce(*[F.when(key == k, F.lit(v)) for k, v in kinds.items()])
    one = f.select("name", named.alias("pair"), (_at(2, "int") - 1).alias("i"), (_at(7, "int") - 1).alias("j"), _at(11, "double").alias("dist"), _at(12, "double").alias("lower"), _at(13, "double").alias("upper")).where("pair is not null and i is not null and j is not null")
    return one.unionByName(one.where("i <> j").withColumns({"i": F.col("j"), "j": F.col("i")}))


def restraint_scores(spark: SparkSession, path: str, models: int = 5, flag: str = "EC52C") -> DataFrame:
    """(name, record, model, flagged, noe, gdt, tm) of files of fixed records: a model's name, ``models`` lines of restraint energies
    (third word) and ``models`` lines of scores (first word TM, third GDT), each averaged."""
    size = 2 * models + 1
    f = _words(lines(spark, path)).withColumns({"record": F.floor(F.col("no") / size), "k": F.col("no") % size})
    energy, score = F.col("k").between(1, models), F.col("k") > models
    out = f.groupBy("name", "record").agg(F.max(F.when(F.col("k") == 0, F.trim("line"))).alias("model"), F.avg(F.when(energy, _at(2, "double"))).alias("noe"), F.avg(F.when(score, _at(2, "double"))).alias("gdt"), F.avg(F.when(score, _at(0, "double"))).alias("tm"), F.count("*").alias("n"))
    return out.where(F.col("n") == size).select("name", "record", "model", F.col("model").contains(flag).alias("flagged"), "noe", "gdt", "tm")


def cluster_report(spark: SparkSession, path: str) -> DataFrame:
    """(name, cluster, size, radius, density) of clustering reports: "Number of clusters: n" somewhere, then, from the fourth line after
    the one with "include used structure" on, n lines of seven words. Density is size / radius, 0 for a single member."""
    li = lines(spark, path)
    many = li.where(F.col("line").contains("Number of clusters:")).groupBy("name").agg(F.min_by(F.regexp_extract("line", r":\s*(\d+)", 1).try_cast("int"), "no").alias("many"), F.min("no").alias("after"))
    start = li.join(many, "name").where((F.col("no") > F.col("after")) & F.col("line").contains("include used structure")).groupBy("name").agg(F.min("no").alias("start"))
    body = _words(li.join(many, "name").join(start, "name").where("no >= start + 4 and no < start + 4 + many")).where(F.size("f") == 7)
    size, radius = _at(1, "int"), _at(3, "double")
    return body.select("name", _at(0, "int").alias("cluster"), size.alias("size"), radius.alias("radius"), F.when(size <= 1, 0.0).otherwise(F.try_divide(size.cast("double"), radius)).alias("density"))


def dihedral_terms(spark: SparkSession, path: str) -> DataFrame:
    """(name, pos from 0, kind phi or psi, x0, n, k) of the periodic dihedral constraints among other lines."""
    f = _words(lines(spark, path).where(F.col("line").contains("AMBER") & F.col("line").contains("Dihedral"))).where((F.size("f") == 13) & (_at(0) == "Dihedral"))
    atoms = F.concat_ws("-", _at(1), _at(3), _at(5), _at(7))
    kind = F.when(atoms == "N-CA-C-N", "psi").when(atoms == "C-N-CA-C", "phi")
    return f.select("name", (_at(4, "int") - 1).alias("pos"), kind.alias("kind"), _at(-3, "double").alias("x0"), _at(-2, "double").alias("n"), _at(-1, "double").alias("k")).where("kind is not null")


def model_scores(spark: SparkSession, path: str) -> DataFrame:
    """(name, model, scores[5]) of score tables: the model is the last word, its scores the fourth to eighth."""
    f = _words(lines(spark, path)).where(F.size("f") >= 9)
    return f.select("name", _at(-1).alias("model"), F.transform(F.slice("f", 4, 5), lambda x: x.try_cast("double")).alias("scores")).where(~F.exists("scores", lambda x: x.isNull()))


def ranked_models(spark: SparkSession, path: str, skip: int = 9, top: int = 5) -> DataFrame:
    """(name, rank from 0, model): the seventh word of the ``top`` lines after the first ``skip``."""
    return _words(lines(spark, path)).where((F.col("no") >= skip) & (F.col("no") < skip + top)).select("name", (F.col("no") - skip).alias("rank"), _at(6).alias("model")).where("model is not null")


def first_and_best(ranks: DataFrame, scores: DataFrame) -> DataFrame:
    """(name, first[], best[]): the scores of the model ranked first, and of the one with the largest mean of the second and fourth score."""
    j = ranks.join(scores.select("model", "scores"), "model")
    value = (F.col("scores")[1] + F.col("scores")[3]) / 2
    return j.groupBy("name").agg(F.min_by("scores", "rank").alias("first"), F.max_by("scores", F.struct(value, -F.col("rank"))).alias("best"))


def unpacked(data: bytes):
    """The value of a msgpack document (nil, booleans, integers, floats, strings, binaries, arrays, maps)."""
    place = 0

    def take(form: str):
        nonlocal place
        value = struct.unpack_from(">" + form, data, place)
        place += struct.calcsize(">" + form)
        return value[0]

    def text(n: int, decode: bool = True):
        nonlocal place
        place += n
        part = data[place - n : place]
        return part.decode() if decode else part

    def value():
        b = take("B")
        if b < 0x80 or b >= 0xE0:
            return b if b < 0x80 else b - 256
        if b < 0x90:
            return {value(): value() for _ in range(b & 15)}
        if b < 0xA0:
            return [value() for _ in range(b & 15)]
        if b < 0xC0:
            return text(b & 31)
        if b in (0xC0, 0xC2, 0xC3):
            return {0xC0: None, 0xC2: False, 0xC3: True}[b]
        if 0xC4 <= b <= 0xC6:
            return text(take("BHI"[b - 0xC4]), False)
        if 0xCA <= b <= 0xD3:
            return take("fdBHIQbhiq"[b - 0xCA])
        if 0xD9 <= b <= 0xDB:
            return text(take("BHI"[b - 0xD9]))
        if b in (0xDC, 0xDD):
            return [value() for _ in range(take("HI"[b - 0xDC]))]
        if b in (0xDE, 0xDF):
            return {value(): value() for _ in range(take("HI"[b - 0xDE]))}
        raise ValueError(f"byte {b:#x} is not read here")

    return value()


def couplings(spark: SparkSession, path: str) -> DataFrame:
    """(name, length, i, j, x[441]) of msgpack couplings: blocks of i < j under x_pair."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for name, content in zip(p["name"], p["content"], strict=True):
                w = unpacked(bytes(content))
                rows = [(name, int(w["ncol"]), int(v["i"]), int(v["j"]), [float(x) for x in v["x"]]) for v in w["x_pair"].values() if v["i"] < v["j"]]
                yield pd.DataFrame(rows, columns=["name", "length", "i", "j", "x"])

    raw = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("name"), "content")
    return raw.mapInPandas(parse, "name string, length long, i long, j long, x array<double>")


def write_bundle(msa: DataFrame, weights: DataFrame, path: str, name: str = "name") -> None:
    """An alignment with its weights as one table by alignment: read_bundle prunes to the wanted ones."""
    msa.join(weights.select(name, "seq_no", F.col("weight").alias("w")), [name, "seq_no"]).write.mode("overwrite").partitionBy(name).parquet(path)


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
