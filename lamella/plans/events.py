"""Ordered scans and time windows over events."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from lamella.functions import numbers as N
from lamella.operators import measures as M
from lamella.plans.registry import query, table

_ORDER = ["ts", "event_id"]


@query("""WITH m AS (SELECT *, event_type = 'error' AS m FROM events)
SELECT event_id, m OR coalesce(lag(m) OVER w, false) OR coalesce(lead(m) OVER w, false) AS invalid FROM m WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def neighbor_invalidate(spark, sf_dir):
    return M.beside_missing(table(spark, sf_dir, "events"), ["user_id"], _ORDER, F.col("event_type") == "error").select("event_id", "invalid")


@query("""WITH g AS (SELECT user_id, event_type = 'error' AND coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), '') <> 'error' AS o FROM events) SELECT user_id, count(*) FILTER (o) AS openings FROM g GROUP BY user_id""")
def gap_openings(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(*_ORDER)
    o = (F.col("event_type") == "error") & (F.coalesce(F.lag("event_type").over(w), F.lit("")) != "error")
    return table(spark, sf_dir, "events").select("user_id", o.alias("o")).groupBy("user_id").agg(F.count_if("o").alias("openings"))


@query("""WITH s AS (SELECT *, (event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1)::INT AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM s) SELECT user_id, run::BIGINT AS run, any_value(event_type) AS event_type, count(*) AS length FROM r GROUP BY user_id, run""")
def runs_islands(spark, sf_dir):
    return M.islands(table(spark, sf_dir, "events"), ["user_id"], _ORDER, "event_type").select("user_id", "run", "event_type", "length")


@query("""WITH s AS (SELECT *, coalesce((event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id))::INT, 0) AS n FROM events)
SELECT event_id, (sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS number FROM s""")
def renumber(spark, sf_dir):
    return M.renumbered(table(spark, sf_dir, "events"), ["user_id"], _ORDER, "event_type").select("event_id", "number")


@query("""WITH b AS (SELECT user_id, min(ts) AS lo, max(ts) AS hi FROM events WHERE event_type <> 'error' GROUP BY user_id) SELECT event_id FROM events JOIN b USING (user_id) WHERE ts BETWEEN lo AND hi""")
def trim_runs(spark, sf_dir):
    return M.trimmed(table(spark, sf_dir, "events"), ["user_id"], "ts", F.col("event_type") == "error").select("event_id")


@query("""SELECT event_type, round(avg(least(abs(a - pi()), 2 * pi() - abs(a - pi()))), 6) AS error FROM (SELECT event_type, 2 * pi() * hour(ts) / 24 AS a FROM events) GROUP BY event_type""")
def circular_error(spark, sf_dir):
    a = 2 * math.pi * F.hour("ts") / 24
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg(N.circular_gap(a, F.lit(math.pi))), 6).alias("error"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def events_tumbling(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast(e.schema["ts"].dataType).alias("start"), "event_type", "n")


@query("""WITH g AS (SELECT *, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE)::INT, 0) AS n FROM events),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def events_session(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("start")).select("user_id", "start", "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def events_dedup(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_type").dropDuplicates()


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_price FROM events QUALIFY event_type = 'error'""")
def asof_price(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("event_type") == "purchase", F.col("value")), ignorenulls=True).over(w)
    return table(spark, sf_dir, "events").withColumn("last_price", last).where("event_type = 'error'").select("event_id", "last_price")


@query("SELECT event_type, (sum((props::JSON ->> '$.k')::BIGINT))::BIGINT AS k FROM events GROUP BY event_type")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))
