"""Provider state and sampling over driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import logs, sampling, state
from .payouts import LANE_SQL, lane
from .registry import query

HASH_SQL = "(((((cast({key} as bigint)) * 48271 + {seed} + 11) % 2147483647 * 69621 + 7) % 2147483647))"


def hash_sql(key: str, seed: int = 0) -> str:
    return HASH_SQL.format(key=key, seed=seed)


def states(t):
    """A row for each customer and nation-made lane, as provider state."""
    return t.customer.select(
        F.col("c_custkey").alias("uid"), F.lit("x_search").alias("lane"), F.col("c_mktsegment").alias("hotkey"), (1 + F.col("c_custkey") % 90).cast("int").alias("verified"), (1 + F.col("c_nationkey") * 5).cast("int").alias("declared"),
        F.when(F.col("c_custkey") % 4 == 0, 7).cast("int").alias("pending_declared"), (F.col("c_custkey") % 10 / 10).alias("quality_avg"), F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("updated_at"),
        F.when(F.col("c_custkey") % 3 == 0, F.to_timestamp(F.lit("2024-01-01 00:00:00"))).alias("unreachable_since"), F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("last_decay_at"),
    )


STATE_SQL = """s as (select c_custkey uid, 'x_search' lane, c_mktsegment hotkey, cast(1 + c_custkey % 90 as integer) verified, cast(1 + c_nationkey * 5 as integer) declared,
  case when c_custkey % 4 = 0 then 7 end pending_declared, (c_custkey % 10) / 1e1 quality_avg, timestamp '2024-01-01' updated_at, case when c_custkey % 3 = 0 then timestamp '2024-01-01' end unreachable_since, timestamp '2024-01-01' last_decay_at from customer)"""


@query(
    "stm1_upsert",
    f"""with {STATE_SQL}, n as (select c_custkey uid, 'x_search' lane, case when c_custkey % 5 = 0 then 'NEW' else c_mktsegment end hotkey, cast(3 + c_nationkey * 5 - c_custkey % 2 * 2 as integer) declared from customer where c_acctbal > 0 or c_mktsegment = 'BUILDING'),
    j as (select s.*, n.uid nu, n.hotkey nh, n.declared nd, n.uid is not null and s.hotkey is distinct from n.hotkey fresh from s left join n using (uid))
    select uid, lane, coalesce(nh, hotkey) hotkey, case when fresh then 1 else verified end verified, case when fresh then nd else declared end declared,
    case when fresh then null when nu is not null then case when declared <> nd then nd end else pending_declared end pending_declared, case when fresh then 0 else quality_avg end quality_avg,
    case when nu is not null then timestamp '2024-02-01' else updated_at end updated_at from j""",
)
def upsert(t):
    c = t.customer.where("c_acctbal > 0 or c_mktsegment = 'BUILDING'")
    seen = c.select(F.col("c_custkey").alias("uid"), F.lit("x_search").alias("lane"), F.when(F.col("c_custkey") % 5 == 0, "NEW").otherwise(F.col("c_mktsegment")).alias("hotkey"), (3 + F.col("c_nationkey") * 5 - F.col("c_custkey") % 2 * 2).cast("int").alias("declared"))
    return state.upsert(states(t), seen, F.to_timestamp(F.lit("2024-02-01 00:00:00")))


@query("stm2_promote", f"with {STATE_SQL} select uid, coalesce(pending_declared, declared) declared from s")
def promote(t):
    return state.promote(states(t)).select("uid", "declared")


@query("stm3_last_write", "select user_id, event_type, arg_max(value, (ts, event_id)) as value from events group by 1, 2")
def last_write(t):
    return state.last_write(t.events, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "value")


@query("stm4_update_by_key", f"with {STATE_SQL}, n as (select user_id uid, round(avg(value) / 1e2, 6) q from events group by 1) select uid, coalesce(q, quality_avg) quality_avg from s left join n using (uid)")
def update(t):
    new = t.events.groupBy(F.col("user_id").alias("uid")).agg(F.round(F.avg("value") / 100, 6).alias("quality_avg"))
    return state.update_by_key(states(t), new, ["uid"], "quality_avg").select("uid", "quality_avg")


@query("stm5_purge", "select event_id from events where ts >= timestamp '2024-01-28' - interval 3 day")
def purge(t):
    return state.purge(t.events.withColumn("at", F.col("ts").cast("timestamp")), "at", F.to_timestamp(F.lit("2024-01-28 00:00:00"))).select("event_id")


@query("stm6_lane_fan_out", "select c_custkey uid, 'ai_search:' || m lane from customer, (select unnest(['fast', 'balanced', 'deep']) m) where not (m = 'deep' and c_acctbal < 0)")
def fan_out(t):
    rows = t.customer.select(F.col("c_custkey").alias("uid"), F.lit("ai_search").alias("lane"))
    there = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("uid"), F.lit("ai_search:deep").alias("lane"))
    return state.fan_out_lanes(rows, "lane", there, "uid", ["fast", "balanced", "deep"])


@query(
    "stm7_call_islands",
    """with m as (select *, sum(case when event_type = 'error' then 0 else 1 end) over (partition by user_id order by ts, event_id rows unbounded preceding) g from events), l as (select *, max(g) over (partition by user_id) last from m)
    select user_id, min(ts) since, count(*) failures, g = last still_out from l where event_type = 'error' group by user_id, g, last""",
)
def islands(t):
    return state.call_islands(t.events.withColumn("ts", F.col("ts").cast("timestamp")), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error")


@query(
    "stm9_decay_ticks",
    f"""with recursive {STATE_SQL}, d(uid, n, k, v) as (select uid, case when unreachable_since is null then 0 else 3 end, 0, verified from s union all select uid, n, k + 1, greatest(1, cast(trunc(v * 9e-1) as integer)) from d where k < n)
    select uid, v verified, timestamp '2024-01-01' + interval (n * 300) second last_decay_at from d where k = n""",
)
def decay(t):
    return state.decay(states(t), F.to_timestamp(F.lit("2024-01-01 00:19:59"))).select("uid", "verified", "last_decay_at")


@query(
    "stm10_ramp",
    f"""with {STATE_SQL}, h as (select distinct user_id uid from events where event_type = 'purchase')
    select s.uid, cast(case when h.uid is null then verified when quality_avg >= 6e-1 then least(verified + greatest(1, cast(trunc(declared * 1e-1) as integer)), declared, 100) else greatest(1, verified - greatest(1, cast(trunc(declared * 1e-1) as integer))) end as integer) verified from s left join h on s.uid = h.uid""",
)
def ramp(t):
    return state.ramp(states(t), t.events.where("event_type = 'purchase'").select(F.col("user_id").alias("uid")), F.lit(0.6)).select("uid", "verified")


@query("stm18_reset_replaced", f"with {STATE_SQL} select uid, case when uid % 6 = 0 then 0 else quality_avg end quality_avg from s")
def resync(t):
    now = t.customer.select(F.col("c_custkey").alias("uid"), F.when(F.col("c_custkey") % 6 == 0, "other").otherwise(F.col("c_mktsegment")).alias("hotkey"))
    return state.reset_replaced(states(t), now, "quality_avg").select("uid", "quality_avg")


@query(
    "win8_largest_remainder",
    """with c as (select user_id, count(*) n from events group by 1), q as (select *, n * 1e2 / (select sum(n) from c) x from c), f as (select *, floor(x) fl, x - floor(x) rest from q), r as (select *, row_number() over (order by rest desc, user_id) rk from f)
    select user_id, n, cast(fl + case when rest > 0 and rk <= 100 - (select sum(fl) from f) then 1 else 0 end as bigint) slots from r""",
)
def remainder(t):
    return sampling.largest_remainder(t.events.groupBy("user_id").agg(F.count("*").alias("n")), "user_id", "n", 100)


@query(
    "win10_stratified_sample",
    f"""with s as (select user_id, event_type, count(*) k from events group by all), a as (select *, sum(k) over (partition by user_id) n from s), q as (select *, least(n, greatest(3, cast(round_even(n * 2e-1, 0) as bigint))) quota from a),
    e as (select *, quota * k / n::double x from q), f as (select *, floor(x) take, row_number() over (partition by user_id order by x - floor(x) desc, event_type) rk from e),
    g as (select user_id, event_type, take + case when rk <= quota - sum(take) over (partition by user_id) then 1 else 0 end take from f),
    r as (select event_id, user_id, event_type, row_number() over (partition by user_id, event_type order by {hash_sql("event_id")}, event_id) rn from events)
    select event_id, user_id, event_type from r join g using (user_id, event_type) where rn <= take""",
)
def stratified(t):
    return sampling.bucket_sample(t.events, "user_id", "event_type", "event_id").select("event_id", "user_id", "event_type")


@query("win11_batches", "select event_id, (row_number() over (partition by user_id order by event_id) - 1) // greatest(1, cast(ceil(count(*) over (partition by user_id) * 5e-1) as bigint)) batch from events")
def batched(t):
    return sampling.batches(t.events, "user_id", "event_id").select("event_id", "batch")


@query("win12_round_robin", f"select doc_id, lang, turn from (select doc_id, lang, row_number() over (partition by lang order by {hash_sql('doc_id')}, doc_id) turn from documents) where turn <= 60 order by turn, lang limit 60")
def robin(t):
    return sampling.round_robin(t.documents.select("doc_id", "lang"), "lang", "doc_id", 60).select("doc_id", "lang", F.col("turn").cast("long").alias("turn"))


@query("win7_top_half", "with c as (select c_custkey, c_acctbal, row_number() over (order by c_acctbal desc, c_custkey) r, count(*) over () n from customer) select c_custkey, c_acctbal from c where r <= greatest(2, n // 2)")
def top_half(t):
    return sampling.top_half(t.customer.select("c_custkey", "c_acctbal"), "c_custkey", "c_acctbal")


@query(
    "srt10_route_pick",
    f"""with u as (select user_id, avg(value) / 1e2 q, count(*) v from events group by 1), c as (select s_suppkey, u.*, -ln(({hash_sql("s_suppkey * 1000003 + user_id")} + 1) / 2147483648e0) / (power(greatest(q, 1e-1), 3e0) * power(greatest(v, 1), 2e0)) s from supplier, u)
    select s_suppkey, user_id from (select *, row_number() over (partition by s_suppkey order by round(s, 12), user_id) r from c) where r = 1""",
)
def route(t):
    u = t.events.groupBy("user_id").agg((F.avg("value") / 100).alias("q"), F.count("*").alias("v"))
    return sampling.route_pick_each(t.supplier.select("s_suppkey"), u, "s_suppkey", "user_id", "q", "v")


@query("srt9_uniform_sample", f"select l_orderkey, l_linenumber from (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by {hash_sql('l_linenumber')}, l_linenumber) r from lineitem) where r <= 2")
def uniform(t):
    return sampling.uniform_sample(t.lineitem.select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber", 2)


@query(
    "srt8_cited_sample",
    f"""with a as (select l_orderkey, l_linenumber, l_returnflag = 'N' cited, {hash_sql("l_linenumber")} h from lineitem), b as (select *, row_number() over (partition by l_orderkey, cited order by h, l_linenumber) k from a),
    c as (select *, row_number() over (partition by l_orderkey order by (k <= case when cited then 2 else 1 end) desc, h, l_linenumber) r from b) select l_orderkey, l_linenumber, cited from c where r <= 3""",
)
def cited(t):
    return sampling.cited_sample(t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "N").alias("cited")), "l_orderkey", "l_linenumber", "cited")


@query("join15_cyclic", "with p as (select p_partkey, row_number() over (order by p_partkey) - 1 k from part), q as (select o_orderkey, row_number() over (order by o_orderkey) - 1 k from orders) select o_orderkey, p_partkey from q join p on p.k = q.k % (select count(*) from part)")
def cyclic(t):
    return sampling.cyclic_join(t.orders.select("o_orderkey"), t.part.select("p_partkey"), "o_orderkey", "p_partkey").select("o_orderkey", "p_partkey")


@query("join14_cross", f"with u as (select user_id, count(*) n from events group by 1), l as (select distinct {LANE_SQL} lane from events) select user_id, lane, cast(k as integer) k from u, l, range(1, 4) t(k)")
def crossed(t):
    lanes = t.events.select(lane().alias("lane")).distinct()
    return t.events.select("user_id").distinct().crossJoin(F.broadcast(lanes)).select("user_id", "lane", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k"))


@query("arr6_expanded", "select n_nationkey, list_concat(list_resize(cast([] as varchar[]), n_nationkey % 3, 'a'), ['b', 'b']) as xs from nation")
def expanded(t):
    return t.nation.select("n_nationkey", arrays.expand(F.array(F.lit("a"), F.lit("b")), F.array((F.col("n_nationkey") % 3).cast("int"), F.lit(2))).alias("xs"))


@query("agg20_ramped", f"with {STATE_SQL} select hotkey, max(verified) >= 2 ramped from s group by 1")
def ramped(t):
    return states(t).groupBy("hotkey").agg((F.max("verified") >= 2).alias("ramped"))


@query("src1_point_lookup", f"with {STATE_SQL} select coalesce(max(verified), 1) verified from s where uid = 7 and lane = 'x_search'")
def lookup(t):
    return states(t).where("uid = 7 and lane = 'x_search'").agg(F.coalesce(F.max("verified"), F.lit(1)).alias("verified"))


@query("src3_in_list", f"with {STATE_SQL} select uid, lane, verified, declared from s where uid in (1, 5, 9, 77)")
def in_list(t):
    wanted = t.customer.sparkSession.createDataFrame([(1,), (5,), (9,), (77,)], "uid long")
    return states(t).join(F.broadcast(wanted), "uid", "left_semi").select("uid", "lane", "verified", "declared")


@query("src4_unreachable", f"with {STATE_SQL} select uid from s where unreachable_since is not null")
def unreachable(t):
    return states(t).where(F.col("unreachable_since").isNotNull()).select("uid")


@query("src5_recent", "select event_id from events where ts > timestamp '2024-01-20' - interval 4 hour and ts <= timestamp '2024-01-20'")
def recent(t):
    now = F.to_timestamp(F.lit("2024-01-20 00:00:00"))
    ts = F.col("ts").cast("timestamp")
    return t.events.where((ts > now - F.expr("interval 4 hours")) & (ts <= now)).select("event_id")


@query("src6_ordered_range", "select event_id, user_id from events where user_id = 5 and ts >= timestamp '2024-01-28' - interval 72 hour order by ts")
def ordered_range(t):
    ts = F.col("ts").cast("timestamp")
    return t.events.where((F.col("user_id") == 5) & (ts >= F.to_timestamp(F.lit("2024-01-28 00:00:00")) - F.expr("interval 72 hours"))).orderBy("ts").select("event_id", "user_id")


@query(
    "src8_strided_sample",
    """with d as (select *, row_number() over (order by doc_id) - 1 i, greatest(1, count(*) over () // 5000) stride from documents), e as (select distinct trim(text) q from d where i >= 1 % stride and (i - 1 % stride) % stride = 0 and trim(text) <> '')
    select 'h' || left(sha1(q), 15) id, length(q) n from e""",
)
def strided(t):
    return sampling.strided(t.documents, "doc_id", "text", 5000, 1).select("id", F.length("text").alias("n"))


@query("join12_roster_defaults", f"with {STATE_SQL} select u.c_custkey uid, coalesce(verified, 1) verified, coalesce(quality_avg, 0) quality_avg from customer u left join (select * from s where hotkey <> 'BUILDING') s on s.uid = u.c_custkey")
def roster(t):
    some = states(t).where("hotkey <> 'BUILDING'").select("uid", "verified", "quality_avg")
    return logs.with_defaults(t.customer.select(F.col("c_custkey").alias("uid")), some, ["uid"], {"verified": 1, "quality_avg": 0.0})
