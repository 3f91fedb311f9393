"""Sequence operators over the texts of documents, benchmark items and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lamella.functions import numbers as N
from lamella.functions import sequences as S
from lamella.operators import aligned as A
from lamella.operators import measures as M
from lamella.operators import selection as Z
from lamella.plans.registry import query, table


def _items(spark, sf_dir):
    """Benchmark items as sequences of one alignment."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.lit("b").alias("name"), F.col("item_id").alias("seq_no"), F.upper(F.regexp_replace("text", "[^A-Za-z]", "-")).alias("seq"))


_RES = """WITH s AS (SELECT item_id, upper(regexp_replace(text, '[^A-Za-z]', '-', 'g')) AS seq FROM benchmark),
r AS (SELECT item_id, unnest(range(0, length(seq))) AS pos, seq FROM s), x AS (SELECT item_id, pos, seq[pos + 1] AS aa FROM r)
"""
_AB = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@query(_RES + f""", t AS (SELECT pos, count(*) AS total FROM x WHERE aa <> '-' GROUP BY pos), a AS (SELECT unnest(string_split('{" ".join(_AB)}', ' ')) AS aa),
c AS (SELECT pos, aa, count(*) AS n FROM x GROUP BY pos, aa)
SELECT t.pos::INT AS pos, a.aa, round((1 + coalesce(n, 0)) / (26 + total), 6) AS p FROM t CROSS JOIN a LEFT JOIN c ON c.pos = t.pos AND c.aa = a.aa""")
def column_freq(spark, sf_dir):
    res = A.residues(_items(spark, sf_dir)).withColumn("w", F.lit(1.0))
    return A.column_frequencies(res, _AB).select("pos", "aa", F.round("p", 6).alias("p"))


@query(_RES + """, f AS (SELECT pos, aa, count(*) / sum(count(*)) OVER (PARTITION BY pos) AS p FROM x GROUP BY pos, aa)
SELECT pos::INT AS pos, round(-sum(p * ln(p)) / ln(21), 6) AS entropy FROM f GROUP BY pos""")
def column_entropy(spark, sf_dir):
    f = M.histogram(A.residues(_items(spark, sf_dir)), ["name", "pos"], "aa")
    return A.column_entropy(f).select("pos", F.round(F.col("entropy") + 0.0, 6).alias("entropy"))


_PAIRS = _RES.rstrip() + """, y AS (SELECT * FROM x WHERE pos < 16),
c AS (SELECT p.pos AS i, q.pos AS j, p.aa AS a, q.aa AS b, count(*) AS n FROM y p JOIN y q ON p.item_id = q.item_id AND p.pos < q.pos GROUP BY ALL),
f AS (SELECT *, n / sum(n) OVER (PARTITION BY i, j) AS pab, sum(n) OVER (PARTITION BY i, j, a) / sum(n) OVER (PARTITION BY i, j) AS pa, sum(n) OVER (PARTITION BY i, j, b) / sum(n) OVER (PARTITION BY i, j) AS pb FROM c)
"""


def _pair_table(spark, sf_dir):
    res = A.residues(_items(spark, sf_dir)).withColumn("w", F.lit(1.0))
    return A.pair_frequencies(res, box=(0, 15, 0, 15))


@query(_PAIRS + "SELECT i::INT AS i, j::INT AS j, a, b, round(pab - pa * pb, 6) + 0.0 AS cov FROM f")
def pair_covariance(spark, sf_dir):
    return _pair_table(spark, sf_dir).select("i", "j", "a", "b", (F.round("cov", 6) + 0.0).alias("cov"))


@query(_PAIRS + "SELECT i::INT AS i, j::INT AS j, round(sum(pab * ln(pab / (pa * pb))), 6) AS mi FROM f GROUP BY i, j")
def pair_mi(spark, sf_dir):
    return A.mutual_information(_pair_table(spark, sf_dir)).select("i", "j", F.round("mi", 6).alias("mi"))


def _weights(mode: str, condition: str):
    sql = f"""WITH s AS (SELECT item_id, substr(upper(regexp_replace(text, '[^A-Za-z]', '-', 'g')), 1, 24 + item_id % 2) AS seq FROM benchmark),
l AS (SELECT *, length(seq) AS len, length(replace(seq, '-', '')) AS fl, string_split(seq, '') AS cs FROM s),
p AS (SELECT a.item_id, b.item_id AS other, a.len, a.fl, b.fl AS other_fl, len(list_filter(range(1, a.len + 1), lambda i: a.cs[i] = b.cs[i])) AS eq, len(list_filter(range(1, a.len + 1), lambda i: a.cs[i] = b.cs[i] AND a.cs[i] <> '-')) AS same FROM l a JOIN l b ON a.len = b.len)
SELECT item_id AS seq_no, count(*) FILTER (item_id = other OR {condition}) AS n, round(1.0 / count(*) FILTER (item_id = other OR {condition}), 6) AS weight FROM p GROUP BY item_id"""

    def run(spark, sf_dir):
        # The first letters of every item, so that most have others of their length.
        cut = _items(spark, sf_dir).withColumn("seq", F.expr("substring(seq, 1, 24 + cast(seq_no % 2 as int))"))
        return A.neighbour_weights(cut, mode, 0.12).select("seq_no", "n", F.round("weight", 6).alias("weight"))

    run.__name__ = f"seq_weights_{mode}"
    return query(sql)(run)


seq_weights_a = _weights("a", "same > 0.12 * fl")
seq_weights_b = _weights("b", "len - eq < floor(0.88 * len + 1e-9)")
seq_weights_c = _weights("c", "eq > ceil(0.12 * len)")
seq_weights_d = _weights("d", "same > 0.12 * least(fl, other_fl)")
seq_weights_e = _weights("e", "same >= floor(0.12 * fl + 0.5)")


@query(_RES + "SELECT aa, count(*) AS n FROM x WHERE aa BETWEEN 'A' AND 'Z' GROUP BY aa")
def onehot_counts(spark, sf_dir):
    r = _items(spark, sf_dir).select(F.explode(S.one_hot(F.col("seq"), _AB)).alias("v")).select(F.posexplode("v").alias("k", "hit")).where("hit = 1")
    return r.groupBy(F.substring(F.lit(_AB), F.col("k") + 1, F.lit(1)).alias("aa")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id, length(replace(t, '-', ''))::INT AS ungapped, length(regexp_replace(t, '[a-z]', '', 'g'))::INT AS columns, length(replace(replace(t, '.', ''), '-', ''))::INT AS plain,
  (length(regexp_replace(t, '[^ACDEFGHIKLMNPQRSTVWY-]', 'X', 'g')) - length(replace(regexp_replace(t, '[^ACDEFGHIKLMNPQRSTVWY-]', 'X', 'g'), 'X', '')))::INT AS unknown FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def ungapped_length(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    x = S.clean(F.col("t"))
    return d.select("doc_id", S.ungapped_length(F.col("t")).alias("ungapped"), F.length(S.drop_insertions(F.col("t"))).alias("columns"), F.length(F.translate("t", ".-", "")).alias("plain"), (F.length(x) - F.length(F.regexp_replace(x, "X", ""))).alias("unknown"))


@query("SELECT doc_id, md5(translate(coalesce(text, ''), 'aeiou', 'VVVVV')) AS classes FROM documents")
def translate_classes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(S.three_classes(F.coalesce("text", F.lit("")), ("aeiou", "VVVVV"))).alias("classes"))


@query("""SELECT conv_id, turn, round(least(1.0, turn / 50.0), 6) AS location, round(cbrt(turn), 5) AS root, round(log10(greatest(1, turn)), 6) AS lg, round(1 / (1 + turn), 6) AS inverse, round(1 / sqrt(1.0 + turn), 6) AS inverse_root FROM conversations""")
def pos_features(spark, sf_dir):
    t = F.col("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(N.location(t), 6).alias("location"), F.round(N.cube_root(t), 5).alias("root"), F.round(N.log_feature(t), 6).alias("lg"), F.round(N.inverse(t), 6).alias("inverse"), F.round(N.inverse_root(t), 6).alias("inverse_root"))


@query("SELECT conv_id, turn, CASE WHEN role <> 'user' THEN sum((role <> 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - 1 END::BIGINT AS idx FROM conversations")
def alignment_index(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    own = F.col("role") != "user"
    return c.select("conv_id", "turn", F.when(own, F.sum(own.cast("int")).over(w) - 1).alias("idx"))


@query(_RES.rstrip() + """, g AS (SELECT item_id, seq, unnest(range(1, length(seq) + 1)) AS i FROM s), w AS (SELECT item_id, CASE WHEN i > 1 AND i < length(seq) THEN substr(seq, i - 1, 3) ELSE 'UNK' END AS gram FROM g),
t AS (SELECT gram, count(*) AS n FROM w WHERE gram <> 'UNK' GROUP BY gram HAVING count(*) >= 5)
SELECT item_id AS seq_no, count(t.gram) AS known, count(*) - count(t.gram) AS unknown, coalesce(sum(t.n), 0)::BIGINT AS total FROM w LEFT JOIN t USING (gram) GROUP BY item_id""")
def trigram_lookup(spark, sf_dir):
    """Each position's gram, the middle letter its own, looked up in a table of the frequent ones; ends and others are unknown."""
    grams = _items(spark, sf_dir).select("seq_no", F.explode(F.concat(F.array(F.lit("UNK")), S.grams(F.col("seq"), 3), F.array(F.lit("UNK")))).alias("gram"))
    known = grams.where("gram <> 'UNK'").groupBy("gram").agg(F.count("*").alias("n")).where("n >= 5")
    return grams.join(known, "gram", "left").groupBy("seq_no").agg(F.count("n").alias("known"), F.count_if(F.col("n").isNull()).alias("unknown"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


_WORDS = "list_filter(string_split(coalesce(text, ''), ' '), lambda w: w <> '')"


@query(f"""WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents), s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 2, 1)), lambda i: array_to_string(list_slice(ws, i, i + 3), ' '))) AS e FROM w),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), p AS (SELECT a.doc_id, b.doc_id AS other, count(*) AS common FROM s a JOIN s b USING (e) GROUP BY ALL),
k AS (SELECT p.doc_id, count(*) AS n FROM p JOIN z a ON a.doc_id = p.doc_id JOIN z b ON b.doc_id = p.other WHERE 100 * common >= 60 * (a.n + b.n - common) GROUP BY p.doc_id)
SELECT w.doc_id, coalesce(k.n, 1) AS n FROM w LEFT JOIN k USING (doc_id)""")
def blocked_similarity(spark, sf_dir):
    words = F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda w: w != "")
    # A generator between the two, or the words would be split anew for every stretch of them.
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(words)).alias("ws"))
    parts = F.when(F.size("ws") < 4, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size("ws") - 4), lambda i: F.xxhash64(*[F.get("ws", i + k) for k in range(4)])))
    return Z.blocked_neighbours(d.select("doc_id", parts.alias("parts")), "doc_id", "parts", 60)


@query("""SELECT pq, quality, count(*) AS n FROM (SELECT (n_chars > 1000)::INT AS pq, quality FROM documents JOIN labels USING (doc_id)) GROUP BY ALL""")
def label_confusion(spark, sf_dir):
    j = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 1000).cast("int").alias("pq")).join(table(spark, sf_dir, "labels"), "doc_id")
    return j.groupBy("pq", "quality").agg(F.count("*").alias("n"))


@query("""SELECT lang, round(sum(-ln(CASE WHEN quality = 1 THEN s ELSE 1 - s END) * w) / sum(w), 6) AS logloss FROM (SELECT lang, quality, 0.05 + 0.9 * (doc_id % 100) / 100.0 AS s, 1.0 + toxic AS w FROM documents JOIN labels USING (doc_id)) GROUP BY lang""")
def label_logloss(spark, sf_dir):
    j = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    s, w = 0.05 + 0.9 * F.pmod("doc_id", F.lit(100)) / 100.0, 1.0 + F.col("toxic")
    loss = -F.log(F.when(F.col("quality") == 1, s).otherwise(1 - s))
    return j.groupBy("lang").agg(F.round(F.sum(loss * w) / F.sum(w), 6).alias("logloss"))


@query("SELECT doc_id, item_id FROM documents JOIN benchmark ON contains(documents.text, benchmark.text)")
def substring_join(spark, sf_dir):
    d, b = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("part"))
    return A.contained(d, b, "doc_id", "text", "part").select("doc_id", "item_id")


@query("SELECT item_id AS seq_no FROM (SELECT item_id, upper(regexp_replace(text, '[^A-Za-z]', '-', 'g')) AS seq FROM benchmark) WHERE item_id = 0 OR 1 - length(replace(seq, '-', '')) / length(seq) <= 0.2")
def self_filter(spark, sf_dir):
    return A.self_filter(_items(spark, sf_dir), 0.2, 1.1).select("seq_no")


@query("""WITH RECURSIVE s0 AS (SELECT floor(log2(greatest(n_chars, 1)))::BIGINT AS grp, doc_id AS key, coalesce(n_chars, 0) AS size FROM documents),
s AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY size DESC, key) AS rn FROM s0),
r AS (SELECT grp, key, size, rn, 0::BIGINT AS batch, greatest(1, floor(4e7 / greatest(1, size * size)))::BIGINT - 1 AS room FROM s WHERE rn = 1
  UNION ALL SELECT s.grp, s.key, s.size, s.rn, CASE WHEN room = 0 THEN batch + 1 ELSE batch END, CASE WHEN room = 0 THEN greatest(1, floor(4e7 / greatest(1, s.size * s.size)))::BIGINT ELSE room END - 1 FROM r JOIN s ON s.grp = r.grp AND s.rn = r.rn + 1)
SELECT grp, key, size, batch FROM r""")
def batch_pack(spark, sf_dir):
    return M.packed_batches(table(spark, sf_dir, "documents"), "doc_id", "n_chars", 4e7)


@query()
def spline_smooth(spark, sf_dir):
    """Mean price by quantity within each return flag, smoothed."""
    x = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_quantity").agg(F.avg("l_extendedprice").alias("price"))
    return M.smoothed(x, "l_returnflag", "l_quantity", "price")


@query()
def local_align(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    nxt = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("next"))
    return A.local_scores(b.join(nxt, "item_id"), "text", "next").select("item_id", "score")
