"""Line dedup by distinct-site spread.

The sites of every line are counted with HyperLogLog sketches of the sites, one for each line hash,
merged by aggregation. A line whose estimate lies within ``margin`` of the threshold gets
an exact distinct count; the others are decided by the sketch. Lines on ``sites`` or more
sites are boilerplate and leave every document.

Only lines that occur more than once and with more than one site can reach a threshold above 1;
a plain aggregation finds them, and sketches are made for these alone.

Edge cases: a null text is empty; an empty text has no lines; blank lines are kept and never
counted; a null site is no site; lines are compared without white space at their ends;
rows of equal id are documents of their own; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import LONG_MIN, spread_join

#: ASCII white space, which Spark and other engines trim alike.
_ENDS = " \t\r\x0b\x0c"


def _line_hash(line: Column) -> Column:
    return F.xxhash64(line)


def spread_lines(lines: DataFrame, sites: int, margin: float, lg_k: int, by: list[str]) -> DataFrame:
    """(line, n: its rows) of the line hashes on ``sites`` or more sites, of a table (line: long, site: string, by: what tells rows apart)."""
    several = lines.groupBy("line").agg(F.count("*").alias("n"), F.min("site").alias("low"), F.max("site").alias("high"))
    several = several.where((F.col("n") >= sites) & ((F.col("low") != F.col("high")) | F.lit(sites <= 1)) & F.col("low").isNotNull()).select("line", "n", F.col("n").alias("rows"))
    live = spread_join(lines.where("site is not null"), several, ["line"], "n", by)
    sketched = live.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("about"), F.max("rows").alias("n"))
    sure = sketched.where(F.col("about") > sites * (1 + margin)).select("line", "n")
    unsure = sketched.where((F.col("about") <= sites * (1 + margin)) & (F.col("about") >= sites * (1 - margin))).select("line", "n")
    # The rows of a line and site meet again in the distinct step, which combines before it shuffles.
    pairs = spread_join(live.select("line", "site", "rows", *by), unsure, ["line"], "n", by).select("line", "site", "rows").distinct()
    exact = pairs.groupBy("line").agg(F.count("*").alias("sites"), F.max("rows").alias("n")).where(F.col("sites") >= sites).select("line", "n")
    return sure.unionAll(exact)


def line_dedup(docs: DataFrame, sites: int = 5, margin: float = 0.25, lg_k: int = 12, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """(doc_id, n_lines, n_removed, kept): ``kept`` is the text without its boilerplate lines."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    row = F.col(id_col).cast("long")
    rows = docs.select(F.coalesce(row, F.lit(LONG_MIN)).alias("key_id"), F.hash(text, row.isNull(), F.col(site_col).cast("string")).alias("key_h"), row.alias("row_id"), text.alias("text"), F.col(site_col).cast("string").alias("site"))
    split = F.split("text", "\n")
    pieces = rows.select("key_id", "key_h", "site", F.explode(split).alias("piece")).select("key_id", "key_h", "site", F.btrim("piece", F.lit(_ENDS)).alias("piece")).where("piece <> ''")
    lines = pieces.select("key_id", "key_h", "site", _line_hash(F.col("piece")).alias("line"))
    boilerplate = spread_lines(lines, sites, margin, lg_k, ["key_id", "key_h"])
    gone = spread_join(lines.select("key_id", "key_h", "line"), boilerplate, ["line"], "n", ["key_id", "key_h"]).groupBy("key_id", "key_h").agg(F.collect_set("line").alias("gone"))
    done = rows.join(gone, ["key_id", "key_h"], "left")
    keep = F.filter(split, lambda x: ~F.array_contains("gone", _line_hash(F.btrim(x, F.lit(_ENDS)))) | (F.btrim(x, F.lit(_ENDS)) == ""))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.concat_ws("\n", keep))
    n = F.when(F.col("text") == "", 0).otherwise(F.size(split))
    left = F.when(F.col("gone").isNull(), n).otherwise(F.size(keep))
    return done.select(F.col("row_id").alias(id_col), n.cast("long").alias("n_lines"), (n - left).cast("long").alias("n_removed"), kept.alias("kept"))
