"""Statistics, joins, rankings and set operations over the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lamella.functions import numbers as N
from lamella.operators import measures as M
from lamella.operators import pairs as P
from lamella.operators import selection as Z
from lamella.operators import tables as T
from lamella.plans.registry import query, table

_CELLS = "WITH x AS (SELECT l_suppkey % 10 AS i, l_partkey % 10 AS j, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)\n"


def _cells(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.pmod("l_suppkey", F.lit(10)).alias("i"), F.pmod("l_partkey", F.lit(10)).alias("j")).agg(F.sum("l_quantity").alias("v"))


@query(_CELLS + "SELECT i, j, round(v - avg(v) OVER (PARTITION BY i) * avg(v) OVER (PARTITION BY j) / avg(v) OVER (), 4) AS apc FROM x")
def apc_matrix(spark, sf_dir):
    return P.apc(_cells(spark, sf_dir), [], "v").select("i", "j", F.round("apc", 4).alias("apc"))


@query("""WITH x AS (SELECT l_returnflag AS g, l_suppkey % 5 AS a, l_partkey % 5 AS b, sum(l_quantity) AS v FROM lineitem GROUP BY ALL),
s AS (SELECT *, pow(v - avg(v) OVER (PARTITION BY g), 2) AS sq FROM x), r AS (SELECT g, a, sum(sq) AS s FROM s GROUP BY g, a), c AS (SELECT g, b, sum(sq) AS s FROM s GROUP BY g, b)
SELECT g, round((SELECT sqrt(sum(r.s)) FROM r WHERE r.g = t.g), 4) AS frobenius, round((SELECT sqrt(max(r.s)) FROM r WHERE r.g = t.g), 4) AS row_norm, round((SELECT sqrt(max(c.s)) FROM c WHERE c.g = t.g), 4) AS col_norm FROM (SELECT DISTINCT g FROM x) t""")
def block_norms(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("g"), F.pmod("l_suppkey", F.lit(5)).alias("a"), F.pmod("l_partkey", F.lit(5)).alias("b")).agg(F.sum("l_quantity").alias("v"))
    return P.block_norms(x, ["g"], "v").select("g", *[F.round(c, 4).alias(c) for c in ("frobenius", "row_norm", "col_norm")])


@query("SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER w) / stddev_pop(o_totalprice) OVER w, 5) AS z FROM orders WINDOW w AS (PARTITION BY o_orderpriority)")
def zscore_table(spark, sf_dir):
    return P.zscore(table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderpriority"]).select("o_orderkey", F.round("z", 5).alias("z"))


@query("SELECT l_orderkey, l_linenumber, round((l_extendedprice - avg(l_extendedprice) OVER w) / stddev_samp(l_extendedprice) OVER w, 4) + 0.0 AS z FROM lineitem WINDOW w AS (PARTITION BY floor(l_quantity / 10))")
def zscore_band(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("band", F.floor(F.col("l_quantity") / 10))
    return P.zscore(li, "l_extendedprice", ["band"], sample=True).select("l_orderkey", "l_linenumber", (F.round("z", 4) + 0.0).alias("z"))


@query("""SELECT p_partkey, round(CASE WHEN max(p_retailprice) OVER w > min(p_retailprice) OVER w THEN (p_retailprice - min(p_retailprice) OVER w) / (max(p_retailprice) OVER w - min(p_retailprice) OVER w) ELSE 0 END, 6) AS scaled FROM part WINDOW w AS (PARTITION BY p_brand)""")
def minmax_scale(spark, sf_dir):
    return P.minmax(table(spark, sf_dir, "part"), "p_retailprice", ["p_brand"]).select("p_partkey", F.round("scaled", 6).alias("scaled"))


PRICE_EDGES = [1000.0, 5000.0, 10000.0, 30000.0, 70000.0]


@query("SELECT bin, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM (SELECT *, (len(list_filter([1000.0, 5000.0, 10000.0, 30000.0, 70000.0], lambda e: e <= l_extendedprice)) - 1)::INT AS bin FROM lineitem) GROUP BY bin")
def price_digitize(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("bin", N.digitise(F.col("l_extendedprice"), PRICE_EDGES).cast("int"))
    return li.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("""WITH h AS (SELECT l_returnflag, floor(l_quantity / 5)::INT AS bin, count(*) AS p FROM lineitem GROUP BY ALL),
c AS (SELECT * FROM (VALUES (0, 0, 12), (1, 12, 33), (2, 33, 55)) v(coarse, lo, hi))
SELECT l_returnflag, coarse AS bin, round(sum(p * (least(bin * 5 + 5, hi) - greatest(bin * 5, lo)) / 5.0), 4) AS p FROM h JOIN c ON least(bin * 5 + 5, hi) > greatest(bin * 5, lo) GROUP BY ALL""")
def rebin_hist(spark, sf_dir):
    h = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.floor(F.col("l_quantity") / 5).cast("int").alias("bin")).agg(F.count("*").cast("double").alias("p"))
    return M.rebin(h, ["l_returnflag"], [5.0 * i for i in range(12)], [0.0, 12.0, 33.0, 55.0]).select("l_returnflag", "bin", F.round("p", 4).alias("p"))


@query("SELECT q, d, n, round(n / sum(n) OVER (PARTITION BY q), 6) AS p FROM (SELECT floor(l_quantity / 10)::INT AS q, round(l_discount * 100)::INT AS d, count(*) AS n FROM lineitem GROUP BY ALL)")
def hist_joint(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_quantity") / 10).cast("int").alias("q"), F.round(F.col("l_discount") * 100).cast("int").alias("d"))
    return M.joint_histogram(li, "q", "d").select("q", "d", "n", F.round("p", 6).alias("p"))


@query("""WITH h AS (SELECT l_shipmode, l_returnflag, n, n / sum(n) OVER (PARTITION BY l_shipmode) AS p FROM (SELECT l_linestatus AS l_shipmode, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL)),
w AS (SELECT *, avg(p) OVER (PARTITION BY l_shipmode) / p AS weight FROM h)
SELECT l_linestatus, round(sum(l_quantity * weight), 2) AS weighted FROM lineitem JOIN w ON w.l_shipmode = l_linestatus AND w.l_returnflag = lineitem.l_returnflag GROUP BY l_linestatus""")
def inverse_freq_weights(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    w = M.inverse_weights(M.histogram(li, ["l_linestatus"], "l_returnflag"), ["l_linestatus"]).select("l_linestatus", "l_returnflag", "weight")
    return li.join(w, ["l_linestatus", "l_returnflag"]).groupBy("l_linestatus").agg(F.round(F.sum(F.col("l_quantity") * F.col("weight")), 2).alias("weighted"))


_MODELS = """WITH m AS (SELECT l_returnflag || l_linestatus AS model, floor(l_quantity / 10)::INT AS i, round(l_discount * 100)::INT AS bin, count(*) AS n FROM lineitem GROUP BY ALL),
p AS (SELECT model, i, bin, n / sum(n) OVER (PARTITION BY model, i) AS p FROM m)
"""


def _models(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("model"), F.floor(F.col("l_quantity") / 10).cast("int").alias("i"), F.round(F.col("l_discount") * 100).cast("int").alias("bin"))
    return M.histogram(m, ["model", "i"], "bin")


@query(_MODELS + "SELECT i, bin, round(avg(p), 6) AS p FROM p GROUP BY i, bin")
def ensemble_amean(spark, sf_dir):
    return M.ensemble(_models(spark, sf_dir), ["i"], "bin").select("i", "bin", F.round("p", 6).alias("p"))


@query(_MODELS + "SELECT i, bin, round(g / sum(g) OVER (PARTITION BY i), 6) AS p FROM (SELECT i, bin, exp(avg(ln(greatest(p, 1e-12)))) AS g FROM p GROUP BY i, bin)")
def ensemble_gmean(spark, sf_dir):
    return M.ensemble(_models(spark, sf_dir), ["i"], "bin", geometric=True).select("i", "bin", F.round("p", 6).alias("p"))


@query(_MODELS + """, r AS (SELECT i, bin, sum(n) / sum(sum(n)) OVER (PARTITION BY i) AS ref FROM m GROUP BY i, bin), j AS (SELECT model, i, bin, p, ref, (1.0 + bin) AS w FROM p JOIN r USING (i, bin)),
x AS (SELECT *, p * ref / (w * ref / sum(w * ref) OVER (PARTITION BY model, i)) AS raw FROM j) SELECT model, i, bin, round(raw / sum(raw) OVER (PARTITION BY model, i), 6) AS p FROM x""")
def bias_correct(spark, sf_dir):
    m = _models(spark, sf_dir)
    ref = m.groupBy("i", "bin").agg(F.sum("n").alias("s")).withColumn("ref", F.col("s") / F.sum("s").over(Window.partitionBy("i"))).select("i", "bin", "ref")
    j = m.join(ref, ["i", "bin"]).withColumn("w", 1.0 + F.col("bin"))
    return M.bias_corrected(j, ["model", "i"], "p", "ref", "w").select("model", "i", "bin", F.round("corrected", 6).alias("p"))


@query(_CELLS + "SELECT least(i, j) AS i, greatest(i, j) AS j, round(avg(v), 4) AS v FROM x GROUP BY least(i, j), greatest(i, j)")
def symmetrize(spark, sf_dir):
    return P.symmetrised(_cells(spark, sf_dir), [], "v").select("i", "j", F.round("v", 4).alias("v"))


@query("""WITH h AS (SELECT o_orderpriority, count(*) / (SELECT count(*) FROM orders) AS p FROM orders GROUP BY o_orderpriority)
SELECT o_orderstatus, h.o_orderpriority, round(sum((p + 0.5 * (orders.o_orderpriority = h.o_orderpriority)::INT) / 1.5), 4) AS blended FROM orders CROSS JOIN h GROUP BY ALL""")
def blend_onehot(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    n = o.groupBy("o_orderstatus", F.col("o_orderpriority").alias("own")).agg(F.count("*").alias("n"))
    h = o.groupBy("o_orderpriority").agg(F.count("*").alias("c")).withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy()))
    # Counts by status and priority, against priorities: a few rows each.
    x = n.join(F.broadcast(h), F.lit(True))
    return x.groupBy("o_orderstatus", "o_orderpriority").agg(F.round(F.sum(F.col("n") * M.blend(F.col("p"), F.col("own") == F.col("o_orderpriority"), 0.5)), 4).alias("blended"))


@query("""WITH g AS (SELECT c_mktsegment, c_custkey, avg((o_orderstatus = 'F')::INT) AS r, sum((o_orderstatus = 'F')::INT) AS e, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
SELECT c_mktsegment, round(avg(r), 6) AS macro, round(sum(e) / sum(n), 6) AS micro FROM g GROUP BY c_mktsegment""")
def macro_micro(spark, sf_dir):
    j = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    late = (F.col("o_orderstatus") == "F").cast("int")
    g = j.groupBy("c_mktsegment", "c_custkey").agg(F.avg(late).alias("r"), F.sum(late).alias("e"), F.count("*").alias("n"))
    return g.groupBy("c_mktsegment").agg(F.round(F.avg("r"), 6).alias("macro"), F.round(F.sum("e") / F.sum("n"), 6).alias("micro"))


@query("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS quantity_price, round(corr(l_discount, l_tax), 6) AS discount_tax FROM lineitem GROUP BY l_returnflag")
def corr_matrix(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("quantity_price"), F.round(F.corr("l_discount", "l_tax"), 6).alias("discount_tax"))


@query("SELECT l_suppkey, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS mean FROM lineitem GROUP BY l_suppkey")
def weighted_mean(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity"), 6).alias("mean"))


@query("""WITH h AS (SELECT l_returnflag AS g, floor(l_quantity / 10) * 10 + 5 AS x, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL), m AS (SELECT g, sum(x * n) / sum(n) AS m FROM h GROUP BY g)
SELECT h.g, round(any_value(m), 5) AS mean, round(sqrt(sum(n * pow(x - m, 2)) / sum(n)), 5) AS std, round(sqrt(sum(n * pow(x - m, 2)) FILTER (x <= m) / sum(n) FILTER (x <= m)), 5) AS below, round(sqrt(sum(n * pow(x - m, 2)) FILTER (x > m) / sum(n) FILTER (x > m)), 5) AS above FROM h JOIN m ON h.g = m.g GROUP BY h.g""")
def dist_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("b", F.floor(F.col("l_quantity") / 10).cast("int"))
    counts = li.groupBy(F.col("l_returnflag").alias("g")).agg(*[F.count_if(F.col("b") == k).cast("double").alias(f"c{k}") for k in range(6)])
    s = counts.select("g", N.spread([10.0 * k + 5 for k in range(6)], F.array(*[F.col(f"c{k}") for k in range(6)])).alias("s"))
    return s.select("g", *[F.round(f"s.{c}", 5).alias(c) for c in ("mean", "std", "below", "above")])


@query("SELECT l_partkey, round(sum(abs(l_extendedprice / l_quantity - p_retailprice)) / (count(*) + 1e-5), 4) AS violation FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_partkey")
def violation_mean(spark, sf_dir):
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    off = F.abs(F.col("l_extendedprice") / F.col("l_quantity") - F.col("p_retailprice"))
    return j.groupBy("l_partkey").agg(F.round(F.sum(off) / (F.count("*") + 1e-5), 4).alias("violation"))


@query("SELECT l_suppkey, round(max(l_extendedprice), 2) AS best, round(avg(l_extendedprice), 4) AS top_mean FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn, greatest(1, count(*) OVER (PARTITION BY l_suppkey) // 10) AS k FROM lineitem) WHERE rn <= k GROUP BY l_suppkey")
def best_and_top10(spark, sf_dir):
    done = M.best_and_top_share(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", ["l_orderkey", "l_linenumber"])
    return done.select("l_suppkey", F.round("best", 2).alias("best"), F.round("top_mean", 4).alias("top_mean"))


@query("SELECT o_orderpriority, max(o_totalprice) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS rn FROM orders) WHERE rn <= 25 GROUP BY o_orderpriority")
def kth_threshold(spark, sf_dir):
    return M.kth_smallest(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", 25)


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def rank_best(spark, sf_dir):
    return M.first_per_group(table(spark, sf_dir, "orders"), "o_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS rn, min(ln(o_totalprice)) OVER (PARTITION BY o_orderpriority) AS b FROM orders WHERE o_totalprice <= 100000) WHERE rn <= 20 AND ln(o_totalprice) - 10 <= b")
def tolerant_topk(spark, sf_dir):
    w = Window.partitionBy("o_orderpriority")
    o = table(spark, sf_dir, "orders").where("o_totalprice <= 100000").withColumn("rn", F.row_number().over(w.orderBy("o_totalprice", "o_orderkey"))).withColumn("b", F.min(F.log("o_totalprice")).over(w))
    return o.where((F.col("rn") <= 20) & (F.log("o_totalprice") - 10 <= F.col("b"))).select("o_orderkey", "o_orderpriority")


@query("""WITH t AS (SELECT *, CASE WHEN p_retailprice <= 905 THEN 0 WHEN p_retailprice <= 950 THEN 1 WHEN p_retailprice <= 5000 THEN 2 END AS own FROM part WHERE NOT (p_retailprice < 905 AND p_size > 40)),
n AS (SELECT *, min(own) OVER (PARTITION BY p_brand) AS tier FROM t WHERE own IS NOT NULL),
c AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice, p_partkey) AS k FROM n WHERE p_retailprice <= CASE tier WHEN 0 THEN 905 WHEN 1 THEN 950 ELSE 5000 END),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) - 1 AS place FROM c WHERE k = 1)
SELECT p_brand, p_partkey, tier, place::INT AS place FROM r WHERE place < CASE WHEN tier = 0 THEN 4 ELSE 3 END""")
def greedy_novel(spark, sf_dir):
    barred = (F.col("p_retailprice") < 905) & (F.col("p_size") > 40)
    done = Z.greedy_tiers(table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice", ["p_retailprice", "p_partkey"], "p_partkey", "p_type", [905.0, 950.0, 5000.0], 4, 3, barred)
    return done.select("p_brand", "p_partkey", "tier", "place")


@query("""WITH m AS (SELECT l_returnflag, l_linestatus, l_linenumber, sum(100 * l_discount * l_discount * l_quantity) / sum(l_quantity) AS sq, sum(l_tax * l_quantity) / sum(l_quantity) AS tax FROM lineitem GROUP BY ALL)
SELECT l_returnflag, l_linenumber, round(sqrt(avg(sq)), 6) AS error, round(avg(tax), 6) AS tax FROM m GROUP BY ALL""")
def consensus_error(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("d", F.col("l_discount") * 10)
    done = Z.consensus_error(li, ["l_returnflag"], "l_linestatus", "l_quantity", "l_linenumber", "d", ["l_tax"])
    return done.select("l_returnflag", "l_linenumber", F.round("error", 6).alias("error"), F.round("l_tax", 6).alias("tax"))


@query("""SELECT l_returnflag, round(sum(coalesce(CASE WHEN l_quantity > 10 THEN 0.5 * l_tax * (1 - cos(l_discount * 20 - 1)) END, 0) + coalesce(CASE WHEN l_quantity < 40 THEN 0.5 * 2 * (1 - cos(3 * (l_tax - 0.02))) END, 0)), 4) AS score,
  sum((l_quantity > 10)::INT + (l_quantity < 40)::INT)::BIGINT AS n FROM lineitem GROUP BY l_returnflag""")
def potential_total(spark, sf_dir):
    phi = F.when(F.col("l_quantity") > 10, N.periodic_score(F.col("l_discount") * 20, F.lit(1.0), F.col("l_tax"), F.lit(1.0)))
    psi = F.when(F.col("l_quantity") < 40, N.periodic_score(F.col("l_tax"), F.lit(0.02), F.lit(2.0), F.lit(3.0)))
    return Z.total_potential(table(spark, sf_dir, "lineitem"), ["l_returnflag"], [phi, psi]).select("l_returnflag", F.round("score", 4).alias("score"), "n")


@query("SELECT s_suppkey, round(s_acctbal / n, 6) AS mean_energy FROM supplier JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY ALL) ON c_nationkey = s_nationkey")
def energy_per_restraint(spark, sf_dir):
    models = table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "k")
    return Z.per_restraint(models, table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), ["k"], "s_acctbal").select("s_suppkey", F.round("mean_energy", 6).alias("mean_energy"))


@query("SELECT c_mktsegment, count(*) AS models, count(DISTINCT c_nationkey % 1) = 1 AND count(DISTINCT c_nationkey // 30) = 1 AS consistent FROM customer GROUP BY c_mktsegment")
def model_consistency(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_mktsegment", F.pmod("c_nationkey", F.lit(1)).alias("a"), F.floor(F.col("c_nationkey") / 30).alias("b"))
    return Z.consistent_models(c, "c_mktsegment", ["a", "b"])


@query("SELECT o_orderpriority, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderpriority")
def merge_join(spark, sf_dir):
    j = table(spark, sf_dir, "orders").hint("merge").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("SELECT n, c_custkey, s_suppkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS n FROM customer) JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS n FROM supplier) USING (n)")
def positional_zip(spark, sf_dir):
    return T.zipped(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "supplier").select("s_suppkey"), ["c_custkey"], ["s_suppkey"]).select("n", "c_custkey", "s_suppkey")


@query("SELECT key, round(avg(p_retailprice), 4) AS mean FROM (SELECT unnest([p_brand, p_type]) AS key, p_retailprice FROM part) GROUP BY key")
def category_mean(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.explode(F.array("p_brand", "p_type")).alias("key"), "p_retailprice")
    return p.groupBy("key").agg(F.round(F.avg("p_retailprice"), 4).alias("mean"))


@query(_CELLS + "SELECT i, j, round(CASE WHEN abs(i - j) <= 2 THEN -1 ELSE v END, 2) AS v FROM x")
def band_mask(spark, sf_dir):
    return _cells(spark, sf_dir).select("i", "j", F.round(F.when(F.abs(F.col("i") - F.col("j")) <= 2, -1.0).otherwise(F.col("v")), 2).alias("v"))


@query("SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS labelled FROM documents")
def semi_anti(spark, sf_dir):
    d, known = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    return T.semi(d, known, "doc_id").withColumn("labelled", F.lit(True)).unionAll(T.anti(d, known, "doc_id").withColumn("labelled", F.lit(False)))


@query(_CELLS + "SELECT x.i, x.j, round(coalesce(y.v, x.v), 2) AS v FROM x LEFT JOIN x y ON y.i + 5 = x.i AND y.j + 5 = x.j")
def overlay_replace(spark, sf_dir):
    x = _cells(spark, sf_dir)
    return P.overlay(x, x, "v", 5).select("i", "j", F.round("v", 2).alias("v"))


@query("SELECT r_name, count(*) AS n, round(sum(coalesce(s, 0)), 4) AS score FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey LEFT JOIN (VALUES ('BUILDING', 1.5), ('MACHINERY', -0.5)) t(seg, s) ON seg = c_mktsegment GROUP BY r_name")
def lookup_score(spark, sf_dir):
    s = spark.createDataFrame([("BUILDING", 1.5), ("MACHINERY", -0.5)], "c_mktsegment string, s double")
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.join(F.broadcast(s), "c_mktsegment", "left").groupBy("r_name").agg(F.count("*").alias("n"), F.round(F.sum(F.coalesce("s", F.lit(0.0))), 4).alias("score"))


@query("""SELECT 'both' AS kind, n FROM (SELECT c_nationkey AS n FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'customer', n FROM (SELECT c_nationkey AS n FROM customer EXCEPT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'any', n FROM (SELECT c_nationkey AS n FROM customer UNION SELECT s_nationkey FROM supplier)""")
def set_ops(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n"))
    kind = lambda k, d: d.select(F.lit(k).alias("kind"), "n")
    return kind("both", c.intersect(s)).unionAll(kind("customer", c.subtract(s))).unionAll(kind("any", c.union(s).distinct()))


@query("SELECT coalesce(s_nationkey, c_nationkey) AS key, round(coalesce(s, c), 2) AS balance FROM (SELECT c_nationkey, sum(c_acctbal) AS c FROM customer GROUP BY ALL) FULL JOIN (SELECT s_nationkey, sum(s_acctbal) AS s FROM supplier GROUP BY ALL) ON s_nationkey = c_nationkey")
def right_biased_union(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("key")).agg(F.sum("c_acctbal").alias("balance"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("key")).agg(F.sum("s_acctbal").alias("balance"))
    return T.updated(c, s, ["key"], ["balance"]).select("key", F.round("balance", 2).alias("balance"))


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY -ln((('0x' || substr(md5('0:' || o_orderkey), 1, 12))::BIGINT + 1) / 281474976710657.0::DOUBLE) / o_totalprice, o_orderkey) AS rn FROM orders WHERE o_totalprice > 0) WHERE rn = 1""")
def sample_hash(spark, sf_dir):
    return T.one_per_group(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_totalprice").select("o_custkey", "o_orderkey")


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_quantity), 4) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def tpch_q1(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.to_timestamp(F.lit("1998-09-02")))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.count("*").alias("n"))


@query("""SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate, o_orderpriority FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15' GROUP BY l_orderkey, o_orderdate, o_orderpriority ORDER BY revenue DESC, l_orderkey LIMIT 10""")
def tpch_q3(spark, sf_dir):
    day = F.to_timestamp(F.lit("1998-03-15"))
    c, o = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'"), table(spark, sf_dir, "orders").where(F.col("o_orderdate") < day)
    li = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") > day)
    j = c.join(o, F.col("c_custkey") == F.col("o_custkey")).join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")
    return j.groupBy("l_orderkey", "o_orderdate", "o_orderpriority").agg(revenue).orderBy(F.desc("revenue"), "l_orderkey").limit(10)


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey JOIN nation ON n_nationkey = s_nationkey GROUP BY n_name""")
def tpch_q5(spark, sf_dir):
    c, o, li = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    j = c.join(o, F.col("c_custkey") == F.col("o_custkey")).join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    j = j.join(s, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("s_nationkey") == F.col("c_nationkey"))).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_sales(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
