"""Writers of text formats. Lines are made by column functions and written by Spark's text sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def write_lines(df: DataFrame, line: Column, order: list[Column], path: str) -> None:
    """One ordered text output; its part files in name order hold the lines in order."""
    df.select(line.alias("value"), *[o.alias(f"o{i}") for i, o in enumerate(order)]).orderBy(*[f"o{i}" for i in range(len(order))]).select("value").write.text(path)


def write_fasta(df: DataFrame, path: str, header: str = "header", seq: str = "seq", order: str = "seq_no") -> None:
    write_lines(df, F.concat(F.lit(">"), header, F.lit("\n"), seq), [F.col(order)], path)


def contact_rows(df: DataFrame, value: str = "p", power: float = 1.0, least: int = 6, most: int = 40_000, sure: int = 30_000, low: float = 0.01) -> DataFrame:
    """Pairs of the upper triangle that a contact file lists: best first, ``most`` at most, and after ``sure`` none below ``low``."""
    kept = df.where(F.col("j") - F.col("i") >= least).withColumn(value, F.pow(value, F.lit(power)))
    top = kept.orderBy(F.desc(value), "i", "j").limit(most)  # TakeOrderedAndProject: ``most`` rows at most go on
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(value), "i", "j"))).where((F.col("rank") <= sure) | (F.col(value) >= low))


def write_contacts(df: DataFrame, path: str, target: str, value: str = "p", bins: str | None = None, **limits) -> None:
    """CASP RR: header, pair lines with numbers from 1 and three decimals, END."""
    rows = contact_rows(df, value, **limits)
    text = F.format_string("%d %d %.3f", F.col("i") + 1, F.col("j") + 1, F.col(value))
    if bins:
        text = F.concat_ws(" ", text, F.concat_ws(" ", F.transform(bins, lambda x: F.format_string("%.3f", x))))
    spark = df.sparkSession
    edge = spark.createDataFrame([(0, "PFRMAT RR"), (1, f"TARGET {target}"), (2, "RMODE 2"), (3, "MODEL 1"), (1 << 40, "END")], "at long, value string")
    body = rows.select((F.col("rank").cast("long") + 10).alias("at"), text.alias("value"))
    edge.unionByName(body).orderBy("at").select("value").write.text(path)


def write_bounds(df: DataFrame, path: str) -> None:
    """i j lower upper, numbers from 1."""
    write_lines(df, F.format_string("%d %d %.4f %.4f", F.col("i") + 1, F.col("j") + 1, "lower", "upper"), [F.col("i"), F.col("j")], path)


def write_constraints(df: DataFrame, path: str, value: str, most_bad: int = 100) -> int:
    """Finite rows only; fails where more than ``most_bad`` are not. Returns the number dropped."""
    bad = F.col(value).isNull() | F.isnan(value) | F.col(value).isin(float("inf"), float("-inf"))
    dropped = df.where(bad).count()
    if dropped > most_bad:
        raise ValueError(f"{dropped} constraints are not finite")
    write_lines(df.where(~bad), F.format_string("AtomPair %d %d %.5f", F.col("i") + 1, F.col("j") + 1, F.col(value)), [F.col("i"), F.col("j")], path)
    return dropped


def write_alignments(df: DataFrame, path: str) -> None:
    """One folder for each template: four lines, the query padded to its whole length (columns q_full, q_from)."""
    head = F.substring("q_full", F.lit(1), F.col("q_from") - 1)
    tail = F.expr("substring(q_full, q_from + length(replace(q_seq, '-', '')))")
    gaps = lambda c: F.regexp_replace(c, ".", "-")
    text = F.concat_ws("\n", F.concat(F.lit(">"), "template"), F.concat(gaps(head), "t_seq", gaps(tail)), F.concat(F.lit(">"), "query"), F.concat(head, "q_seq", tail))
    df.select("template", text.alias("value")).write.partitionBy("template").text(path)


def write_matrix(df: DataFrame, path: str, value: str = "v") -> None:
    """Dense rows in order of i; each row is one group of L values."""
    row = F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("j", F.col(value).alias("v")))), lambda x: F.format_string("%.6f", x["v"])))
    write_lines(df.groupBy("i").agg(row.alias("row")), F.col("row"), [F.col("i")], path)


def chunked(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """Adds chunk: rows in order, ``size`` to a chunk."""
    from lamella.operators.tables import numbered

    return numbered(df, order, "__n").withColumn("chunk", F.floor((F.col("__n") - 1) / size)).drop("__n")


def write_chunks(df: DataFrame, order: list[str], size: int, path: str, line: Column) -> None:
    chunked(df, order, size).select("chunk", line.alias("value")).write.partitionBy("chunk").text(path)


def write_probabilities(df: DataFrame, path: str, value: str = "p") -> None:
    """Upper triangle, values times 100."""
    text = F.concat_ws(" ", F.col("i").cast("string"), F.col("j").cast("string"), F.concat_ws(" ", F.transform(value, lambda x: F.format_string("%.2f", x * 100))))
    write_lines(df.where("i < j"), text, [F.col("i"), F.col("j")], path)


def helix_restraints(runs: DataFrame) -> DataFrame:
    """(i, j, distance) of backbone pairs i, i + k (k 2 to 4) of helices (columns first, last). The ideal distances."""
    ideal = F.create_map(F.lit(2), F.lit(5.5), F.lit(3), F.lit(5.2), F.lit(4), F.lit(6.2))
    pos = runs.select("last", F.explode(F.sequence("first", "last")).alias("i"))
    return pos.select("last", "i", F.explode(F.array(F.lit(2), F.lit(3), F.lit(4))).alias("k")).where("i + k <= last").select("i", (F.col("i") + F.col("k")).alias("j"), ideal[F.col("k")].alias("distance"))


def angle_restraints(df: DataFrame) -> DataFrame:
    """One text line for each residue's phi and psi (degrees, with their spread)."""
    return df.select(F.explode(F.array(*[F.format_string(f"Dihedral {n} %d %.2f %.2f", F.col("pos") + 1, F.col(n), F.col(f"{n}_sd")) for n in ("phi", "psi")])).alias("line"))
