"""Streaming jobs over events and conversations, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import framing, jobs
from .registry import ORACLE, QUERIES, query


def stream_query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


@stream_query(
    "stm12_hourly_stream",
    """with w as (select max(ts) filter (event_id % 10 between 1 and 8) - interval 2 hour w1, max(ts) - interval 2 hour w2 from events), e as (select date_trunc('hour', ts) as hour, event_id, value from events)
    select hour, count(*) n, round(sum(value), 4) total from e, w where (event_id % 10 > 0 or hour + interval 1 hour > w1) and hour + interval 1 hour <= w2 group by hour""",
)
def hourly(spark, folder):
    """A tenth of the events arrives two batches after most others: too late for nearly every hour.
    A batch drops what the batch before it began too late for."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    stream = jobs.arriving([events.where("event_id % 10 between 1 and 8"), events.where("event_id % 10 = 9"), events.where("event_id % 10 = 0")])
    return jobs.run_available(jobs.hourly(stream, "ts", "value")).withColumn("total", F.round("total", 4))


@stream_query("stm16_fold_stream", "select conv_id, coalesce(string_agg(text, '' order by turn) filter (role = 'user'), '') appended, arg_max(text, turn) filter (role <> 'user') replaced from conversations group by 1")
def fold(spark, folder):
    return jobs.run_available(jobs.fold(jobs.read_files(spark, folder, "conversations"), "conv_id", "turn", "role", "text"), "complete")


@stream_query(
    "stm7_reachability_stream",
    """with l as (select user_id uid, ts as "at", event_type = 'error' f, coalesce(lag(event_type = 'error') over (partition by user_id order by ts, event_id), false) p from events) select uid, "at", case when f then 'down' else 'up' end as change from l where f <> p""",
)
def reachability(spark, folder):
    return jobs.run_available(jobs.reachability(jobs.read_files(spark, folder, "events"), "user_id", "ts", "event_id", F.col("event_type") == "error"))


@query("win13_rate_limit")
def rate_limit(t):
    return jobs.rate_limit_batch(t.events, "user_id", "ts", "event_id", limit=3, seconds=86400.0)


@query("src24_sse", r"select conv_id, turn, regexp_replace('data: ' || replace(text, chr(10), chr(10) || 'data: '), 'data: (\n|$)', 'data:  \1', 'g') || chr(10) || chr(10) e from conversations")
def sse(t):
    return t.conversations.select("conv_id", "turn", framing.sse(F.col("text")).alias("e"))


@query("arr10_framing", "select conv_id as stream, row_number() over (partition by conv_id order by turn) - 1 seq, role from conversations")
def unframed(t):
    made = t.conversations.withColumn("j", F.to_json(F.struct("role", "text")))
    halves = made.select("conv_id", F.posexplode(F.array(F.substring("j", 1, 7), F.substring("j", 8, 10**9))).alias("k", "c"), "turn")
    out = framing.unframe(halves.withColumn("o", F.col("turn") * 2 + F.col("k")), "conv_id", "o", "c")
    return out.select("stream", "seq", F.get_json_object("object", "$.role").alias("role"))
