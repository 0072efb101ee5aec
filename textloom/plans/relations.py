"""Queries on plain tables: ordered joins, roll-ups, percentiles, change feeds, and the breadth of relational SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import metrics, passages
from ..sources.scratch import folder
from ..streaming import incremental
from .catalog import query


@query("SELECT e.event_id, o.day FROM events e ASOF LEFT JOIN (SELECT DISTINCT o_custkey, o_orderdate + INTERVAL 26 YEAR AS since, o_orderdate::DATE AS day FROM orders) o ON e.user_id = o.o_custkey AND e.ts >= o.since")
def asof_latest_order(spark, t):
    points = t("events").select("event_id", F.col("user_id").alias("k"), F.col("ts").cast("timestamp").alias("at"))
    since = F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 26 YEAR")
    # 28 and 29 February come to one start, so the day cannot be made from it again; it is carried, the later one of both.
    ranges = t("orders").select(F.col("o_custkey").alias("k"), since.alias("first"), F.col("o_orderdate").cast("date").alias("day")).distinct()
    return passages.containing(points, ranges, "at", "first", "k", carry=("day",)).select("event_id", "day")


@query("SELECT a.l_orderkey, a.l_linenumber AS a, b.l_linenumber AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.l_shipdate < b.l_shipdate + INTERVAL 5 DAY AND b.l_shipdate < a.l_shipdate + INTERVAL 5 DAY")
def interval_overlap(spark, t):
    day = F.datediff("l_shipdate", F.lit("1990-01-01"))
    li = t("lineitem").select("l_orderkey", "l_linenumber", day.alias("start"), (day + 5).alias("end"))
    met = passages.overlapping(li.withColumnRenamed("l_linenumber", "s_id"), li.withColumnRenamed("l_linenumber", "u_id"), "l_orderkey")
    return met.where("s_id < u_id").select("l_orderkey", F.col("s_id").alias("a"), F.col("u_id").alias("b"))


@query("WITH s AS (SELECT l_returnflag, l_quantity AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) SELECT l_returnflag, v AS percentile FROM s WHERE i = least(floor(n * 0.95), n - 1)")
def percentile_nearest(spark, t):
    return metrics.nearest_percentile(t("lineitem"), "l_quantity", 0.95, "l_returnflag")


@query("SELECT l_returnflag, quantile_cont(l_extendedprice, 0.5) AS mid FROM lineitem GROUP BY l_returnflag")
def median_midpoint(spark, t):
    return t("lineitem").groupBy("l_returnflag").agg(F.percentile("l_extendedprice", 0.5).alias("mid"))


@query("SELECT coalesce(grp, 'total') AS grp, count(*)::BIGINT AS n, round(sum(l_extendedprice), 2) AS price FROM (SELECT regexp_replace(l_returnflag, '[AR]', 'AR') AS grp, l_extendedprice FROM lineitem) GROUP BY ROLLUP (grp)")
def report_rollup(spark, t):
    return metrics.report(t("lineitem"), F.regexp_replace("l_returnflag", "[AR]", "AR"), F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("SELECT o_orderpriority, sum((o_totalprice > 150000)::INT)::BIGINT AS high, sum((o_orderstatus = 'F')::INT)::BIGINT AS done FROM orders GROUP BY o_orderpriority")
def conditional_counts(spark, t):
    return metrics.majority_split(t("orders"), "o_orderpriority", ("high", F.col("o_totalprice") > 150000), ("done", F.col("o_orderstatus") == "F"))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def latest_wins(spark, t):
    return incremental.latest(t("events").select("user_id", "event_id", "event_type"), "user_id", "event_id").select("user_id", "event_type", "event_id")


@query("SELECT event_id, user_id FROM (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type")
def changed_only(spark, t):
    rows = t("events").select("event_id", "user_id", "event_type")
    return incremental.changed(rows, "user_id", "event_id", F.col("event_type")).select("event_id", "user_id")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id, count(*)::BIGINT AS seen FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'click'")
def stream_upserts(spark, t):
    """The final state of a stream of events in micro-batches, followed by a keyed table."""
    source = folder(spark)
    rows = t("events").select("user_id", "event_id", "event_type")
    rows.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    place = folder(spark)
    kept = incremental.Upserts(spark, f"{place}/table", "user_id", "event_id")
    kept.follow(stream, f"{place}/checkpoint-{uuid.uuid4().hex[:6]}").awaitTermination()
    seen = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("seen"))
    return kept.current().where("event_type <> 'click'").join(seen, "user_id").select("user_id", "event_type", "event_id", "seen")


@query("WITH p AS (SELECT DISTINCT event_type AS term, user_id FROM events) SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term")
def stream_incremental_df(spark, t):
    """Document frequencies kept by signed counts: the new state of each user against the old one."""
    half = t("events").agg(F.max("event_id")).first()[0] // 2
    pairs = t("events").select("user_id", F.col("event_type").alias("term"), "event_id")
    first, second = (pairs.where(c).select("user_id", "term").distinct() for c in (F.col("event_id") <= half, F.col("event_id") > half))
    came = first.select("term", F.lit(1).alias("sign")).unionByName(second.join(first, ["user_id", "term"], "left_anti").select("term", F.lit(1).alias("sign")))
    return incremental.term_counts(came)


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark, t):
    out = incremental.tumbling(t("events"), "ts", "1 day", None, "event_type")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("SELECT window_start, count(*)::BIGINT AS n FROM (SELECT unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS window_start FROM events) GROUP BY window_start")
def sliding_windows(spark, t):
    rows = t("events").select(F.col("ts").cast("timestamp").alias("ts"))
    out = rows.groupBy(F.window("ts", "24 hours", "12 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n")


@query("WITH m AS (SELECT user_id, ts, (lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*)::BIGINT AS n FROM s GROUP BY user_id, g")
def session_windows(spark, t):
    out = incremental.sessions(t("events"), "ts", "6 hours", "user_id")
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def stream_windows(spark, t):
    """The same windows from a stream with a watermark, run until its input is used up."""
    source, place = folder(spark), folder(spark)
    t("events").select("ts", "value").repartition(2).write.parquet(source)
    stream = spark.readStream.schema("ts timestamp_ntz, value double").option("maxFilesPerTrigger", 1).parquet(source)
    counted = incremental.tumbling(stream, "ts", "1 day", "40 days")
    counting = counted.writeStream.outputMode("complete").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{place}/v{n}")).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    counting.awaitTermination()
    last = max(b["batchId"] for b in counting.recentProgress)  # complete mode: the latest batch has every window
    out = spark.read.parquet(f"{place}/v{last}")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", F.round("total", 6).alias("total"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*)::BIGINT AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark, t):
    li = t("lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA' GROUP BY n_name")
def region_revenue(spark, t):
    asia = t("nation").join(t("region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(asia, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def semi_join(spark, t):
    return t("customer").join(t("orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join(spark, t):
    return t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey, count(o_orderkey)::BIGINT AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000 GROUP BY c_custkey")
def left_join_counts(spark, t):
    return t("customer").join(t("orders").where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("SELECT o_orderkey, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(4) OVER w AS quarter, round(percent_rank() OVER w, 6) AS pr, lag(o_orderkey) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)")
def window_ranking(spark, t):
    w = Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    return t("orders").select("o_orderkey", F.rank().over(w).alias("rk"), F.dense_rank().over(w).alias("dr"), F.ntile(4).over(w).alias("quarter"), F.round(F.percent_rank().over(w), 6).alias("pr"), F.lag("o_orderkey").over(w).alias("before"))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS 2 PRECEDING), 2) AS last3, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS around FROM orders")
def window_frames(spark, t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return t("orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("last3"), F.max("o_totalprice").over(w.rowsBetween(-1, 1)).alias("around"))


@query("SELECT c_mktsegment, n_regionkey, count(*)::BIGINT AS n, grouping(c_mktsegment)::INT AS g FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY GROUPING SETS ((c_mktsegment, n_regionkey), (n_regionkey), ())")
def grouping_sets(spark, t):
    rows = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c, r = F.col("c_mktsegment"), F.col("n_regionkey")
    return rows.groupingSets([[c, r], [r], []], c, r).agg(F.count(F.lit(1)).alias("n"), F.grouping("c_mktsegment").cast("int").alias("g"))


@query("SELECT o_orderstatus, o_orderpriority, count(*)::BIGINT AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_counts(spark, t):
    return t("orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus, count(*) FILTER (WHERE o_orderpriority LIKE '1%')::BIGINT AS urgent, count(*) FILTER (WHERE o_orderpriority LIKE '5%')::BIGINT AS low FROM orders GROUP BY o_orderstatus")
def pivoted(spark, t):
    out = t("orders").withColumn("p", F.substring("o_orderpriority", 1, 1)).groupBy("o_orderstatus").pivot("p", ["1", "5"]).agg(F.count(F.lit(1)))
    return out.select("o_orderstatus", F.coalesce("1", F.lit(0)).alias("urgent"), F.coalesce("5", F.lit(0)).alias("low"))


@query("(SELECT o_custkey AS k FROM orders WHERE o_totalprice > 250000 INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0) EXCEPT SELECT c_custkey FROM customer WHERE c_nationkey < 5")
def set_operations(spark, t):
    a = t("orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("k"))
    b = t("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return a.intersect(b).subtract(t("customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("k")))


@query("SELECT event_type, (props::JSON ->> '$.k')::INT % 10 AS k, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def json_props(spark, t):
    return t("events").select("event_type", (F.get_json_object("props", "$.k").cast("int") % 10).alias("k")).groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"))
