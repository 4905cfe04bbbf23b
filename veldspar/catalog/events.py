"""Queries over the event table, and relational ones over the star schema, which are extensions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veldspar.catalog.registry import query, rounded
from veldspar.operators import senses
from veldspar.session import table
from veldspar.streaming import events as S


@query("WITH o AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS n FROM events) SELECT event_id, (n // 500)::BIGINT AS run FROM o WHERE n % 500 = 0")
def trigger_points(spark, root):
    return S.trigger_points(table(spark, root, "events"), 500)


@query("SELECT event_id FROM events WHERE epoch(TIMESTAMP '2024-01-15 00:00:00') - epoch(date_trunc('second', ts)) <= 24 * 3600 AND ts <= TIMESTAMP '2024-01-15 00:00:00'")
def ttl_prune(spark, root):
    now = F.to_timestamp(F.lit("2024-01-15 00:00:00"))
    rows = table(spark, root, "events").withColumn("created_at", F.col("ts")).withColumn("ttl_hours", F.lit(24))
    return senses.alive(rows, now).where(F.col("ts") <= now).select("event_id")


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, epoch_us(time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR) AS end_us, event_type, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM events GROUP BY ALL")
def event_windows(spark, root):
    out = S.windowed(table(spark, root, "events"), "1 hour")
    return out.select(F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), F.unix_micros(F.col("end").cast("timestamp")).alias("end_us"), "event_type", "n", rounded("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE >= ts THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS end_us, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, root):
    out = S.sessions(table(spark, root, "events"))
    return out.select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), F.unix_micros(F.col("end").cast("timestamp")).alias("end_us"), "n")


@query("SELECT event_type AS type, count(*) AS n, round(avg(value), 6) + 0.0 AS mean, round(quantile_cont(value, 0.95), 6) + 0.0 AS p95 FROM events GROUP BY event_type")
def stage_timings(spark, root):
    out = S.stage_timings(table(spark, root, "events"))
    return out.select("type", "n", rounded("mean").alias("mean"), rounded("p95").alias("p95"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) + 0.0 AS sum_qty, round(avg(l_discount), 6) + 0.0 AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark, root):
    rows = table(spark, root, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(rounded(F.sum("l_quantity"), 2).alias("sum_qty"), rounded(F.avg("l_discount")).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("SELECT n_name, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) + 0.0 AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (n_name, o_orderstatus)")
def order_cube(spark, root):
    """Join, and cube; nulls are the subtotals."""
    rows = table(spark, root, "orders").join(table(spark, root, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, root, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.cube("n_name", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("o_totalprice"), 2).alias("total"))


@query("WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS rank FROM orders) SELECT * FROM r WHERE rank <= 3")
def top_orders(spark, root):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, root, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.row_number().over(w).alias("rank")).where("rank <= 3")
