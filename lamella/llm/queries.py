"""The queries of this subpackage: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm import token_output
from lamella.llm.decontaminate import decontaminate
from lamella.llm.embedding_dedup import embedding_dedup
from lamella.llm.line_dedup import line_dedup
from lamella.llm.mixing import mix
from lamella.llm.ngram_join import ngram_join
from lamella.llm.quality import quality_scores
from lamella.llm.secrets import KINDS, secret_scan
from lamella.llm.substring_dedup import substring_dedup
from lamella.llm.suffix_dedup import suffix_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha(c: str) -> Column:
    return F.sha2(F.col(c).cast("binary"), 256)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), length=35).select("doc_id", "n_words", "n_removed", _sha("kept").alias("kept_sha256"))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_output.write_tokens(table(spark, sf_dir, "documents"), token_output.new_container(spark), public_tokenizers.path("byte_bpe_50k.json"))
    return token_output.read_summaries(spark, out).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"), size=3, percent=90)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"), sites=5).select("doc_id", "n_lines", "n_removed", _sha("kept").alias("kept_sha256"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    def listed(spans: Column) -> Column:
        return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))

    def n(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = listed(F.filter("spans", lambda x: x["kind"] != "entropy"))
    return secret_scan(table(spark, sf_dir, "documents")).select("doc_id", *[n(k) for k in KINDS[:3]], F.sha2(base, 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), length=200).select("doc_id", "n_bytes", "n_removed", (F.size("spans") / 2).cast("long").alias("n_spans"), _sha("kept").alias("kept_sha256"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = mix(table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("tokens"), F.round("mix_p", 6).alias("p"), F.col("mix_kept").alias("kept"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return done.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_token_output, op3_ngram_join, op4_line_dedup, op5_secret_scan, op6_embedding_dedup, op7_suffix_dedup, op8_mixing, op9_decontaminate, op10_quality)}


_OP1 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 33)) AS i, ws FROM w),
h AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 34), ' ')) AS h FROM g),
r AS (SELECT doc_id, i FROM h QUALIFY count(*) OVER (PARTITION BY h) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM r, range(0, 35) t(k)),
one AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM one ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)"""

_OP4 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, source FROM documents),
s AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM d),
l AS (SELECT doc_id, source, unnest(ls) AS raw, generate_subscripts(ls, 1) AS p FROM s),
t AS (SELECT doc_id, source, raw, p, trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM l),
b AS (SELECT line FROM t WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 5),
k AS (SELECT doc_id, count(*) AS n, string_agg(raw, chr(10) ORDER BY p) AS kept FROM t ANTI JOIN b USING (line) GROUP BY doc_id)
SELECT s.doc_id, (CASE WHEN text = '' THEN 0 ELSE len(ls) END)::BIGINT AS n_lines, (CASE WHEN text = '' THEN 0 ELSE len(ls) - coalesce(n, 0) END)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM s LEFT JOIN k USING (doc_id)"""

_OP9 = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
ig AS (SELECT item_id, ws, least(13, len(ws)) AS n, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM iw WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS key FROM ig),
size AS (SELECT DISTINCT n FROM win),
dg AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM dw, size WHERE len(ws) >= n),
hit AS (SELECT doc_id, i, win.n, item_id FROM dg JOIN win ON dg.n = win.n AND array_to_string(list_slice(ws, i, i + dg.n - 1), ' ') = win.key),
word AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, len(ws)::BIGINT AS n_words, coalesce(word.n, 0)::BIGINT AS n_hit, coalesce(item.n, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(word.n, 0) > 0 AND 20 * coalesce(word.n, 0) >= len(ws) AS contaminated
FROM dw LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id)"""


def _op8(rounds: int = 20, capping: int = 8) -> str:
    """Raking and capping as a chain of table expressions."""
    steps = [
        """d AS (SELECT doc_id, coalesce(source, '<null>') AS source, coalesce(lang, '<null>') AS lang, coalesce(text, '') AS text FROM documents)""",
        """e AS (SELECT doc_id, source, lang, CASE WHEN contains(text, '|') THEN 'table' WHEN contains(text, '=') THEN 'code' WHEN regexp_matches(text, '[0-9]') THEN 'figures' ELSE 'prose' END AS topic,
  CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM d)""",
        """c AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM e GROUP BY ALL)""",
    ]
    at = "c"
    for m in ("source", "lang", "topic"):
        steps.append(f"m_{m} AS (SELECT {m}, CASE WHEN sum(tokens) > 0 THEN pow(sum(tokens), 0.7) ELSE 0 END AS t FROM c GROUP BY {m})")
        steps.append(f"s_{m} AS (SELECT {m}, t / sum(t) OVER () AS t_{m} FROM m_{m})")
    steps.append("r0 AS (SELECT c.*, t_source, t_lang, t_topic, tokens / sum(tokens) OVER () AS w FROM c JOIN s_source USING (source) JOIN s_lang USING (lang) JOIN s_topic USING (topic))")
    at, k = "r0", 0
    for _ in range(rounds):
        for m in ("source", "lang", "topic"):
            k += 1
            steps.append(f"r{k} AS MATERIALIZED (SELECT source, lang, topic, tokens, t_source, t_lang, t_topic, CASE WHEN sum(w) OVER (PARTITION BY {m}) > 0 THEN w * t_{m} / sum(w) OVER (PARTITION BY {m}) ELSE 0 END AS w FROM {at})")
            at = f"r{k}"
    steps.append(f"p0 AS (SELECT source, lang, topic, tokens, 0.5 * sum(tokens) OVER () AS want, CASE WHEN tokens > 0 THEN least(1.0, 0.5 * sum(tokens) OVER () * w / tokens) ELSE 0 END AS p FROM {at})")
    for i in range(capping):
        steps.append(f"q{i} AS (SELECT *, sum(CASE WHEN p >= 1 THEN tokens ELSE 0 END) OVER () AS taken, sum(CASE WHEN p >= 1 THEN 0 ELSE p * tokens END) OVER () AS free FROM p{i})")
        steps.append(f"p{i + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, want, CASE WHEN p >= 1 THEN 1.0 ELSE least(1.0, greatest(0.0, p * CASE WHEN free > 0 THEN (want - taken) / free ELSE 1 END)) END AS p FROM q{i})")
    steps.append(f"f AS (SELECT source, lang, topic, CASE WHEN tokens = 0 THEN 0.5 ELSE p END AS p FROM p{capping})")
    return "WITH " + ",\n".join(steps) + "\nSELECT doc_id, e.topic, e.tokens, round(p, 6) AS p, CAST('0x' || substr(md5('17:' || doc_id), 1, 8) AS BIGINT) / 4294967296.0 < p AS kept FROM e JOIN f USING (source, lang, topic)"


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": _OP1, "op4_line_dedup": _OP4, "op8_mixing": _op8(), "op9_decontaminate": _OP9}
