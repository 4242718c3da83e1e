"""Log queries: orders and line items as response logs, suppliers as checkers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import logs
from .payouts import LANE_SQL, lane
from .registry import query

LOGS_SQL = "logs as (select date_trunc('month', o_orderdate) epoch, o_custkey uid, o_orderpriority search_type, o_orderstatus as query, l_suppkey checker, cast(l_extendedprice as double) reward, l_orderkey, l_linenumber from orders join lineitem on l_orderkey = o_orderkey)"


def log_rows(t):
    o = t.orders.select("o_orderkey", F.date_trunc("month", F.col("o_orderdate").cast("timestamp")).alias("epoch"), F.col("o_custkey").alias("uid"), F.col("o_orderpriority").alias("search_type"), F.col("o_orderstatus").alias("query"))
    l = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("checker"), F.col("l_extendedprice").cast("double").alias("reward"))
    return o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).drop("o_orderkey")


@query("agg11_log_groups", f"with {LOGS_SQL} select epoch, uid, search_type, query, count(*) checkers, min(reward) reward_min, max(reward) reward_max, round(avg(reward) + 1e-7, 4) reward_avg, list(checker order by checker, reward) checker_list from logs group by all")
def groups(t):
    return logs.group_logs(log_rows(t), "reward", "checker").withColumn("reward_avg", F.round(F.col("reward_avg") + 1e-7, 4))


TOP_SQL = "top as (select distinct epoch, uid, search_type, query from logs order by epoch desc nulls last, uid nulls last, search_type nulls last, query nulls last limit 20)"


@query("agg14_srt3_top_groups", f"with {LOGS_SQL}, {TOP_SQL} select l_orderkey, l_linenumber, uid from logs semi join top using (epoch, uid, search_type, query)")
def top_groups(t):
    rows = log_rows(t)
    return logs.members(rows, logs.top_groups(rows)).select("l_orderkey", "l_linenumber", "uid")


@query("srt4_top_rows", "select o_orderkey, o_custkey from orders order by o_orderdate, o_orderkey limit 500")
def top_rows(t):
    return logs.top_rows(t.orders, F.asc("o_orderdate"), F.asc("o_orderkey")).select("o_orderkey", "o_custkey")


@query("fil16_optional", "select o_orderkey from orders where o_orderstatus = 'O' and o_orderpriority in ('1-URGENT', '5-LOW')")
def optional(t):
    return logs.optional_filters(t.orders, o_orderstatus="O", o_orderpriority=["1-URGENT", "5-LOW"], o_custkey=None).select("o_orderkey")


@query("fil17_containing", "select c_custkey from customer where c_mktsegment ilike '%build%'")
def containing(t):
    return logs.containing(t.customer, "c_mktsegment", " Build ").select("c_custkey")


@query("agg12_lists", "select o_custkey, min(o_orderdate) first_seen, list(o_orderkey order by o_orderdate, o_orderkey) as values from orders group by 1")
def lists(t):
    return logs.lists_by_key(t.orders, "o_custkey", "o_orderdate", "o_orderkey")


@query("agg13_pivot", f"with e as (select user_id, {LANE_SQL} lane, round(avg(value) + 1e-7, 4) v from events where event_type <> 'error' group by all) select user_id, coalesce(max(v) filter (lane = 'ai_search:fast'), 1e0) ai_search_fast, coalesce(max(v) filter (lane = 'ai_search:deep'), 1e0) ai_search_deep, coalesce(max(v) filter (lane = 'x_search'), 1e0) x_search from e group by 1")
def pivot(t):
    e = t.events.where("event_type <> 'error'").select("user_id", lane().alias("lane"), "value").groupBy("user_id", "lane").agg(F.round(F.avg("value") + 1e-7, 4).alias("v"))
    return logs.pivot_lanes(e, "user_id", "lane", "v", ["ai_search:fast", "ai_search:deep", "x_search"], 1.0)


@query("join16_merge_checkers", "with r as (select distinct l_partkey, l_suppkey, s_name from lineitem join supplier on s_suppkey = l_suppkey) select l_partkey, arg_min(s_name, l_suppkey) s_name, count(*) n, list(l_suppkey order by l_suppkey::varchar) checkers from r group by 1")
def merged(t):
    r = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("l_partkey", "l_suppkey", "s_name").distinct()
    out = logs.merge_checkers(r, "l_partkey", "l_suppkey", "l_suppkey", "l_suppkey", "s_name")
    return out.select("l_partkey", "s_name", "n", F.map_values("states").alias("checkers"))


@query("join11_lookup", "select s_suppkey, n_name, r_name from supplier left join nation on n_nationkey = s_nationkey left join region on r_regionkey = n_regionkey")
def lookup(t):
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("s_suppkey", "n_name", "r_name")


@query("srt1_null_order", "select c_custkey, case when c_acctbal > 0 then c_nationkey end k from customer order by k desc nulls last, c_custkey")
def null_order(t):
    k = F.when(F.col("c_acctbal") > 0, F.col("c_nationkey"))
    return t.customer.select("c_custkey", k.alias("k")).orderBy(F.desc_nulls_last("k"), "c_custkey")


@query("win13_rate_window", "select event_id, count(*) over (partition by user_id order by ts range between interval 3600 second preceding and current row) n from events")
def rate(t):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("s").rangeBetween(-3600 * 10**6, 0)
    return t.events.withColumn("s", F.unix_micros(F.col("ts").cast("timestamp"))).select("event_id", F.count("*").over(w).alias("n"))


@query("fil18_redacted", "select c_custkey, '0.0.0.0' ip, null port, c_name as name from customer")
def redacted(t):
    from ..functions.arrays import masked

    node = masked(F.struct(F.col("c_custkey").cast("string").alias("ip"), F.lit(80).alias("port"), F.col("c_name").alias("name")), {"ip": F.lit("0.0.0.0"), "port": F.lit(None).cast("int")})
    return t.customer.select("c_custkey", node.alias("n")).select("c_custkey", "n.ip", "n.port", "n.name")


@query("fil20_json_safe", "select event_id, case when event_type = 'error' then null else value end v, props from events")
def json_safe(t):
    made = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value"))
    return t.events.select("event_id", F.when(F.isnan(made), None).otherwise(made).alias("v"), "props")
