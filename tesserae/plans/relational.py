"""Queries of the relational operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import relational
from .common import table_query

cents = lambda c: F.sum(F.round(F.col(c) * 100).cast("long"))

table_query(
    "join_hash", lambda t: t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("n"), cents("o_totalprice").alias("total")),
    "SELECT c_mktsegment, count(*) AS n, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
)
table_query(
    "join_broadcast", lambda t: t("supplier").join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n")),
    "SELECT r_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
)
table_query(
    "join_theta", lambda t: t("part").where("p_size <= 3").alias("a").join(F.broadcast(t("region")), F.col("p_size") > F.col("r_regionkey")).select("p_partkey", "r_regionkey"),
    "SELECT p_partkey, r_regionkey FROM part JOIN region ON p_size > r_regionkey WHERE p_size <= 3",
)
_spans = lambda t: t("supplier").select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 5.0).alias("high"))
table_query(
    "join_interval", lambda t: relational.interval_join(t("customer").select("c_custkey", "c_acctbal"), _spans(t), "c_acctbal", "low", "high", 5.0).select("c_custkey", "s_suppkey"),
    "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_acctbal >= s_acctbal AND c_acctbal < s_acctbal + 5.0::DOUBLE",
)
_buys = lambda t: t("events").where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("buy"))
table_query(
    "join_asof", lambda t: relational.asof_join(t("events").where("event_type = 'click'").select("event_id", "user_id", "ts"), _buys(t), "user_id", "ts", ["buy"]).select("event_id", F.coalesce("buy", F.lit(-1)).alias("buy")),
    """SELECT c.event_id, coalesce(max_by(p.event_id, (p.ts, p.event_id)), -1) AS buy FROM (SELECT * FROM events WHERE event_type = 'click') c
       LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON p.user_id = c.user_id AND p.ts <= c.ts GROUP BY c.event_id""",
)
table_query(
    "join_semi", lambda t: t("customer").join(t("orders").where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey"),
    "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)",
)
table_query(
    "join_anti", lambda t: t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey"),
    "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
)
table_query(
    "aggregate_hash", lambda t: t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(cents("l_quantity").alias("quantity"), cents("l_extendedprice").alias("price"), F.count("*").alias("n")),
    "SELECT l_returnflag, l_linestatus, sum(round(l_quantity * 100)::BIGINT)::BIGINT AS quantity, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS price, count(*) AS n FROM lineitem GROUP BY ALL",
)
table_query("distinct", lambda t: t("lineitem").select("l_returnflag", "l_linestatus", F.month("l_shipdate").alias("m")).distinct(), "SELECT DISTINCT l_returnflag, l_linestatus, month(l_shipdate)::INT AS m FROM lineitem")
table_query(
    "aggregate_histogram_quantile", lambda t: relational.histogram_quantile(t("lineitem"), ["l_returnflag"], "l_extendedprice", 0.95, 0.0, 131072.0),
    """SELECT l_returnflag, (min(bin) FILTER (below >= ceil(total * 0.95::DOUBLE)) + 0.5) * 32 AS quantile FROM (
         SELECT *, sum(n) OVER (PARTITION BY l_returnflag ORDER BY bin ROWS UNBOUNDED PRECEDING) AS below, sum(n) OVER (PARTITION BY l_returnflag) AS total FROM (
           SELECT l_returnflag, least(4095, greatest(0, floor(l_extendedprice / 32)))::INT AS bin, count(*) AS n FROM lineitem GROUP BY ALL)) GROUP BY l_returnflag""",
)
_sums = lambda: [F.count("*").alias("n"), F.sum("l_linenumber").alias("lines")]
table_query(
    "aggregate_rollup", lambda t: t("lineitem").rollup("l_returnflag", "l_linestatus").agg(*_sums(), F.grouping_id().cast("long").alias("level")),
    "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_linenumber)::BIGINT AS lines, grouping(l_returnflag, l_linestatus)::BIGINT AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
)
table_query(
    "aggregate_cube", lambda t: t("lineitem").cube("l_returnflag", "l_linestatus").agg(*_sums(), F.grouping_id().cast("long").alias("level")),
    "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_linenumber)::BIGINT AS lines, grouping(l_returnflag, l_linestatus)::BIGINT AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
)
table_query(
    "aggregate_grouping_sets", lambda t: t("orders").groupingSets([[F.col("o_orderstatus")], [F.col("o_orderpriority")], []], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")),
    "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
)
table_query(
    "window_ranking", lambda t: t("orders").select("o_orderkey", *[f.over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).alias(n) for n, f in (("k", F.row_number()), ("r", F.rank()), ("d", F.dense_rank()), ("before", F.lag("o_orderkey", 1, -1)))]),
    """SELECT o_orderkey, (row_number() OVER w)::INT AS k, (rank() OVER w)::INT AS r, (dense_rank() OVER w)::INT AS d, lag(o_orderkey, 1, -1) OVER w AS before FROM orders
       WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)""",
)
table_query(
    "window_frames", lambda t: t("events").select("event_id", F.sum("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 2)).alias("near"), F.coalesce(F.max("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)).alias("before")),
    """SELECT event_id, (sum(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))::BIGINT AS near,
         coalesce(max(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS before FROM events""",
)
table_query("sort_limit", lambda t: t("orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey"), "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
table_query(
    "top_by_group", lambda t: relational.top_by(t("orders"), ["o_orderpriority"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_orderpriority", "o_orderkey"),
    "SELECT o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 3",
)
_buyers, _big = lambda t: t("orders").select(F.col("o_custkey").alias("k")), lambda t: t("customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("k"))
for _name, _make, _sql in (
    ("union", lambda a, b: a.union(b).distinct(), "UNION"), ("union_all", lambda a, b: a.union(b), "UNION ALL"), ("intersect", lambda a, b: a.intersect(b), "INTERSECT"),
    ("except", lambda a, b: b.subtract(a), None), ("except_all", lambda a, b: a.exceptAll(b), "EXCEPT ALL"),
):
    _a, _b = "SELECT o_custkey AS k FROM orders", "SELECT c_custkey AS k FROM customer WHERE c_acctbal > 5000"
    table_query(f"set_{_name}", lambda t, make=_make: make(_buyers(t), _big(t)), f"{_a} {_sql} {_b}" if _sql else f"{_b} EXCEPT {_a}")
table_query(
    "functions_string", lambda t: t("part").select("p_partkey", F.upper("p_name").alias("u"), F.substring("p_name", 2, 4).alias("s"), F.lpad(F.col("p_size").cast("string"), 4, "0").alias("p"), F.regexp_replace("p_type", "[aeiou]", "_").alias("x"), F.concat_ws("-", "p_brand", "p_type").alias("c"), F.length("p_name").alias("n")),
    "SELECT p_partkey, upper(p_name) AS u, substring(p_name, 2, 4) AS s, lpad(p_size::VARCHAR, 4, '0') AS p, regexp_replace(p_type, '[aeiou]', '_', 'g') AS x, concat_ws('-', p_brand, p_type) AS c, length(p_name)::INT AS n FROM part",
)
table_query(
    "functions_date", lambda t: t("orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q"), F.dayofmonth("o_orderdate").alias("d"), F.date_format("o_orderdate", "yyyy-MM").alias("ym"), F.datediff(F.lit("2000-01-01").cast("date"), F.col("o_orderdate").cast("date")).alias("left")),
    "SELECT o_orderkey, year(o_orderdate)::INT AS y, quarter(o_orderdate)::INT AS q, day(o_orderdate)::INT AS d, strftime(o_orderdate, '%Y-%m') AS ym, date_diff('day', o_orderdate::DATE, DATE '2000-01-01')::INT AS left FROM orders".replace("AS left", 'AS "left"'),
)
table_query(
    "functions_array", lambda t: t("embeddings").select("vec_id", F.size("embedding").alias("n"), F.size(F.filter("embedding", lambda v: v > 0)).alias("up"), F.array_position(F.transform("embedding", lambda v: v == F.array_max("embedding")), True).cast("long").alias("at")),
    "SELECT vec_id, len(embedding)::INT AS n, len(list_filter(embedding, lambda v: v > 0))::INT AS up, list_position(embedding, list_max(embedding))::BIGINT AS at FROM embeddings",
)
table_query(
    "stream_tumbling", lambda t: t("events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("began"), "event_type", "n"),
    "SELECT time_bucket(INTERVAL '1 hour', ts) AS began, event_type, count(*) AS n FROM events GROUP BY ALL",
)
table_query(
    "stream_sliding", lambda t: t("events").groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("began"), "n"),
    "SELECT began, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '1 hour', ts), time_bucket(INTERVAL '1 hour', ts) - INTERVAL '1 hour']) AS began FROM events) GROUP BY began",
)
table_query(
    "stream_sessions", lambda t: t("events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("began"), "n"),
    """SELECT user_id, min(ts) AS began, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
         SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""",
)
