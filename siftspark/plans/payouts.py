"""Scores to payouts over the events table: user = provider, event type = lane, value = seconds or quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions import numeric
from ..operators import scoring
from .registry import Tables, query

LANE_SQL = "case event_type when 'view' then 'ai_search:fast' when 'click' then 'ai_search:balanced' when 'purchase' then 'ai_search:deep' else 'x_search' end"


def lane():
    return F.when(F.col("event_type") == "view", "ai_search:fast").when(F.col("event_type") == "click", "ai_search:balanced").when(F.col("event_type") == "purchase", "ai_search:deep").otherwise("x_search")


def scored(t: Tables):
    """Events as scored responses; the failed ones left out."""
    q = F.least(F.lit(1.0), F.col("value") / 100)
    return t.events.where("event_type <> 'error'").select(
        F.col("event_id"), F.date_trunc("week", F.col("ts").cast("timestamp")).alias("epoch"), F.col("user_id").alias("uid"), lane().alias("lane"), q.alias("gate_score"), q.alias("weight_score"),
        F.when(F.col("event_id") % 3 == 0, "organic").otherwise("synthetic").alias("kind"), (F.col("event_id") % 5 != 0).alias("is_deep"), F.when(F.col("event_id") % 4 == 0, F.lit(0.9)).alias("cheap"),
    )


SCORED_SQL = f"""
scored as (select event_id, date_trunc('week', ts) epoch, user_id uid, {LANE_SQL} lane, least(1e0, value / 1e2) q, case when event_id % 3 = 0 then 15e0 else 5e0 end w,
  event_id % 5 <> 0 is_deep, case when event_id % 4 = 0 then 9e-1 end cheap from events where event_type <> 'error'),
lanes as (select epoch, lane, uid, coalesce(sum(q * w) filter (is_deep) / sum(w) filter (is_deep), 0) * coalesce(avg(cheap), 1e0) q, count(*) volume, count(*) filter (is_deep) samples from scored group by all)"""


@query("agg1_lane_means", f"with {SCORED_SQL} select epoch, lane, uid, round(q + 1e-9, 6) q_gate, round(q + 1e-9, 6) q_weight, volume, samples from lanes")
def lane_means(t):
    out = scoring.lane_means(scored(t), ["epoch", "lane", "uid"])
    return out.select("epoch", "lane", "uid", F.round(F.col("q_gate") + 1e-9, 6).alias("q_gate"), F.round(F.col("q_weight") + 1e-9, 6).alias("q_weight"), "volume", "samples")


@query(
    "agg2_pool_payout",
    f"""with {SCORED_SQL}, g as (select *, least(1e0, greatest(0e0, (q - ((case when lane = 'x_search' then 6e-1 else 5e-1 end) - 5e-2)) / 5e-2)) gate from lanes where samples >= 3),
    w as (select *, gate * power(q, 3e0) * power(volume, 2e0) raw from g where gate > 0),
    s as (select epoch, uid, (case lane when 'ai_search:fast' then 54e-2 when 'x_search' then 1e-1 else 18e-2 end) * raw / sum(raw) over (partition by epoch, lane) pay from w)
    select epoch, uid, round(sum(pay), 8) score from s group by epoch, uid""",
)
def pool_payout(t):
    return scoring.pool_payouts(scoring.lane_means(scored(t), ["epoch", "lane", "uid"])).withColumn("score", F.round("score", 8))


@query("agg3_scatter_mean", "select user_id, round(coalesce(avg(value) filter (event_type = 'purchase'), 0), 6) mean_score from events group by 1")
def scatter(t):
    return scoring.scatter_mean(t.events.where("event_type = 'purchase'"), t.events.select("user_id").distinct(), "user_id", "value").withColumn("mean_score", F.round("mean_score", 6))


def daily(t):
    return t.events.select("user_id", F.to_date("ts").alias("day"), (F.col("value") / 100).alias("q")).groupBy("user_id", "day").agg(F.avg("q").alias("q"))


@query(
    "win4_dense_ema",
    """with d as (select user_id, ts::date as dd, avg(value / 1e2) q from events group by all), days as (select dd, row_number() over (order by dd desc) - 1 k from (select distinct dd from d))
    select user_id, round(sum(coalesce(q, 0) * power(5e-1, k + 1)) + 1e-9, 6) ema, count(*) steps from (select distinct user_id from d) u cross join days left join d using (user_id, dd) group by user_id""",
)
def dense_ema(t):
    return scoring.ema(scoring.dense_spine(daily(t), "user_id", "day", "q"), ["user_id"], "day", "q").withColumn("ema", F.round(F.col("ema") + 1e-9, 6))


@query(
    "win5_lane_ema",
    f"""with d as (select user_id, {LANE_SQL} lane, ts::date as dd, avg(value / 1e2) q from events where event_type <> 'error' group by all), k as (select *, row_number() over (partition by user_id, lane order by dd desc) - 1 k from d),
    g as (select user_id, lane, round(sum(q * power(5e-1, k + 1)) + 1e-9, 6) ema, count(*) steps from k group by user_id, lane) select *, ema >= (case when lane = 'x_search' then 6e-1 else 5e-1 end) passed from g""",
)
def lane_ema(t):
    d = t.events.where("event_type <> 'error'").select("user_id", lane().alias("lane"), F.to_date("ts").alias("day"), (F.col("value") / 100).alias("q")).groupBy("user_id", "lane", "day").agg(F.avg("q").alias("q"))
    out = scoring.ema(d, ["user_id", "lane"], "day", "q").withColumn("ema", F.round(F.col("ema") + 1e-9, 6))
    return out.withColumn("passed", F.col("ema") >= F.when(F.col("lane") == "x_search", CONFIG.threshold["x_search"]).otherwise(CONFIG.threshold["ai_search"]))


@query(
    "win2_win3_burned_weights",
    """with m as (select user_id, avg(value) s from events where event_type = 'purchase' group by 1), l as (select user_id, s / (select sum(abs(s)) from m) w from m), x as (select sum(w) a, sum(w) filter (user_id = 1) m1 from l)
    select user_id, round(case when m1 is null or a - m1 <= 0 then w when user_id = 1 then a * 5e-1 else w / (a - m1) * a * 5e-1 end, 8) weight from l, x""",
)
def burned(t):
    mean = t.events.where("event_type = 'purchase'").groupBy("user_id").agg(F.avg("value").alias("s"))
    return scoring.burn(scoring.l1_weights(mean, "s"), "user_id", 1).select("user_id", F.round("weight", 8).alias("weight"))


@query(
    "agg4_reward_summary",
    """with r as (select user_id, case when event_type = 'error' then 0e0 else least(1e0, value / 1e2) end r from events) select user_id, count(*) n, count(*) filter (r > 0) nonzero, round(avg(r), 6) mean, round(min(r), 6) least, round(max(r), 6) most, bool_and(r in (0, 1)) as "binary" from r group by 1""",
)
def rewards(t):
    r = F.when(F.col("event_type") == "error", 0.0).otherwise(F.least(F.lit(1.0), F.col("value") / 100))
    out = scoring.reward_summary(t.events.withColumn("r", r), "user_id", "r")
    return out.select("user_id", "n", "nonzero", *(F.round(c, 6).alias(c) for c in ("mean", "least", "most")), "binary")


@query(
    "agg5_penalty_summary",
    """with p as (select user_id, case when event_type = 'error' then greatest(0e0, 1 - value / 1e2) else 0e0 end p from events) select user_id, count(*) filter (p > 0) triggered, count(*) total, round(max(p) + 1e-9, 6) most, round(avg(p) + 1e-9, 6) mean from p group by 1 having count(*) filter (p > 0) > 0""",
)
def penalties(t):
    p = F.when(F.col("event_type") == "error", F.greatest(F.lit(0.0), 1 - F.col("value") / 100)).otherwise(0.0)
    out = scoring.penalty_summary(t.events.withColumn("p", p), "user_id", "p")
    return out.select("user_id", "triggered", "total", F.round(F.col("most") + 1e-9, 6).alias("most"), F.round(F.col("mean") + 1e-9, 6).alias("mean"))


MODE_SQL = "case event_type when 'view' then 'fast' when 'click' then 'balanced' when 'purchase' then 'deep' end"


def timed(t):
    mode = F.when(F.col("event_type") == "view", "fast").when(F.col("event_type") == "click", "balanced").when(F.col("event_type") == "purchase", "deep")
    return t.events.select("event_id", mode.alias("mode"), (F.col("value") / 3).alias("secs"))


@query(
    "mth1_performance_curve",
    f"""with e as (select event_id, {MODE_SQL} as md, value / 3 s from events), b as (select *, case md when 'fast' then 5e0 when 'balanced' then 15e0 when 'deep' then 30e0 else 0e0 end b from e),
    z as (select *, case when b <= 0 then 1e0 else least(1e0, 3e-1 * b) end low, case when b <= 0 then 3e0 else 6e-1 * b end f, case when b <= 0 then 8e0 else b + least(5e0, 5e-1 * b) end z from b),
    p as (select *, case when s < low or s >= z then 0e0 when s <= f then 1e0 else (z - s) / (z - f) end p, case md when 'fast' then 4e-1 when 'deep' then 85e-2 else 5e-1 end fl from z)
    select event_id, md as "mode", round(p, 6) perf, round(fl + (1 - fl) * p, 6) factor from p""",
)
def curve(t):
    b = numeric.scoring_budget("mode", F.lit(None))
    return timed(t).withColumn("p", numeric.performance("secs", b)).select("event_id", "mode", F.round("p", 6).alias("perf"), F.round(numeric.performance_factor("p", F.lit("ai_search"), "mode"), 6).alias("factor"))


@query(
    "mth7_timeout_ramp",
    "select event_id, round(case when value / 3 <= 20 then 0e0 else least(ceil(value / 3 - 20) / 1e1, 1e0) end, 6) penalty from events",
)
def timeouts(t):
    return timed(t).select("event_id", F.round(numeric.timeout_penalty("secs", F.lit(20.0), F.lit(30.0)), 6).alias("penalty"))


@query("scr5_least_time", f"select event_id, case when value / 3 < (case ({MODE_SQL}) when 'fast' then 1e0 when 'balanced' then 1e0 when 'deep' then 1e0 else 1e0 end) then 1e0 else 0e0 end penalty from events")
def least_time(t):
    return timed(t).select("event_id", F.when(F.col("secs") < numeric.least_time(numeric.scoring_budget("mode", F.lit(None))), 1.0).otherwise(0.0).alias("penalty"))


@query("mth5_gate_ramp", "select event_id, round(least(1e0, greatest(0e0, (value / 1e2 - 45e-2) / 5e-2)), 6) gate from events")
def gates(t):
    return t.events.select("event_id", F.round(numeric.gate(F.col("value") / 100, F.lit(0.5)), 6).alias("gate"))


@query(
    "mth8_capacity_step",
    "select event_id, cast(case when event_type <> 'error' then least(event_id % 100 + 1 + greatest(1, cast(trunc(greatest(user_id, 1) * 1e-1) as bigint)), greatest(user_id, 1), 100) else greatest(1, event_id % 100 + 1 - greatest(1, cast(trunc(greatest(user_id, 1) * 1e-1) as bigint))) end as integer) verified from events",
)
def steps(t):
    return t.events.select("event_id", numeric.next_verified((F.col("event_id") % 100 + 1).cast("int"), F.col("user_id").cast("int"), F.col("event_type") != "error").alias("verified"))


@query(
    "mth9_integer_decay",
    "with recursive d(event_id, n, v) as (select event_id, event_id % 5, cast(1 + user_id % 100 as integer) from events union all select event_id, n - 1, greatest(1, cast(trunc(v * 9e-1) as integer)) from d where n > 0) select event_id, v from d where n = 0",
)
def decays(t):
    return t.events.select("event_id", numeric.decayed((1 + F.col("user_id") % 100).cast("int"), F.col("event_id") % 5).alias("v"))


@query("mth10_routing_weight", "select event_id, round(power(greatest(value / 1e2, 1e-1), 3e0) * power(greatest(user_id, 1), 2e0) + 1e-7, 4) weight from events")
def routing(t):
    return t.events.select("event_id", F.round(numeric.routing_weight(F.col("value") / 100, F.col("user_id")) + 1e-7, 4).alias("weight"))


@query(
    "agg6_agg7_scr19_final_scores",
    """with r as (select event_id, least(1e0, value / 1e2) c, (user_id % 10) / 1e1 s, event_id % 6 = 0 o, case when event_id % 7 = 0 then 5e-1 else 0e0 end p1, (event_id % 4) / 1e1 p2, (event_id % 3) / 2e0 perf from events),
    x as (select *, (case when o then c else 6e-1 * c + 4e-1 * s end) * (1 - p1) * (1 - p2) r from r)
    select event_id, round(r * perf + 1e-9, 6) weight_score, round(case when c < 3e-1 or (not o and s < 3e-1) then 0 else r end + 1e-9, 6) gate_score from x""",
)
def finals(t):
    c, s, o = F.least(F.lit(1.0), F.col("value") / 100), (F.col("user_id") % 10) / 10, F.col("event_id") % 6 == 0
    left = scoring.penalty_product(F.when(F.col("event_id") % 7 == 0, 0.5).otherwise(0.0), (F.col("event_id") % 4) / 10)
    w, g = scoring.final_scores(c, s, o, (F.col("event_id") % 3) / 2, left, F.lit(True))
    return t.events.select("event_id", F.round(w + 1e-9, 6).alias("weight_score"), F.round(g + 1e-9, 6).alias("gate_score"))


@query("stm11_hourly_windows", "select date_trunc('hour', ts) as hour, count(*) n, round(sum(value), 4) total from events group by 1")
def hourly(t):
    w = t.events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("w.start").alias("hour"), "n", "total")
