"""The hourly job, and what decides whether it runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions.numeric import routing_weight
from . import scoring, state
from .ranking import global_row_number
from .sampling import portable_hash, unit


def eligible(start: Column, now: Column, n_uids: Column, window_minutes: int = 55, least_minutes: int = 15) -> Column:
    """Whether an hour is still worth dispatching: enough of its window is left, and there is somebody."""
    left = window_minutes * 60 - (F.unix_timestamp(now) - F.unix_timestamp(start))
    return (left >= least_minutes * 60) & (n_uids > 0)


def run_epoch(scored: DataFrame, snapshot: DataFrame, averages: DataFrame, threshold: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One epoch: payouts of the scored responses, the capacity snapshot after it, and each
    provider's moving average. ``averages``: uid, ema."""
    lanes = scoring.lane_means(scored, ["epoch", "lane", "uid"])
    paid = scoring.pool_payouts(lanes)
    after = state.ramp(snapshot, lanes.where("volume > 0").select("uid").distinct(), threshold)
    both = averages.join(paid.groupBy("uid").agg(F.sum("score").alias("score_")), "uid", "full")
    ema = both.select("uid", (F.coalesce("ema", F.lit(0.0)) * (1 - CONFIG.ema) + F.coalesce("score_", F.lit(0.0)) * CONFIG.ema).alias("ema"))
    return paid, after, ema


def final_weights(averages: DataFrame, target) -> DataFrame:
    """(uid, weight): shares of all averages, the target's burnt; nothing while all are 0."""
    some = averages.where("ema > 0").select("uid", "ema")
    return scoring.burn(scoring.l1_weights(some, "ema"), "uid", target).select("uid", "weight")


def fan_out_failures(calls: DataFrame, modes: list[str]) -> DataFrame:
    """A failed call of a mode counts for its lane, one without a mode for all lanes of the type."""
    lanes = F.when(F.col("mode").isNotNull(), F.array("mode")).otherwise(F.array(*map(F.lit, modes)))
    return calls.select("uid", "search_type", F.explode(lanes).alias("mode"))


def routing_snapshot(snapshot: DataFrame) -> DataFrame:
    """Routing weights of each lane; 0 for the unreachable. In a lane that nobody has moved past 1
    every reachable one weighs the same."""
    ramped = F.max("verified").over(Window.partitionBy("lane")) >= 2
    weight = F.when(F.col("unreachable_since").isNotNull(), 0.0).when(ramped, routing_weight("quality_avg", "verified")).otherwise(1.0)
    return snapshot.select("uid", "lane", weight.alias("weight"))


def random_remainder(weights: DataFrame, key: str, weight: str, slots: int, seed: int = 0) -> DataFrame:
    """``slots`` by weight: whole parts, the rest drawn without replacement in proportion to the
    remainders; the sum is always ``slots``."""
    total = weights.agg(F.sum(weight).alias("all_"))
    exact = F.col(weight) * F.lit(float(slots)) / F.col("all_")
    w = weights.crossJoin(F.broadcast(total)).withColumn("whole_", F.floor(exact + 1e-9)).withColumn("rest_", F.greatest(exact - F.col("whole_"), F.lit(0.0)))
    left = w.agg((F.lit(slots) - F.sum("whole_")).alias("left_"))
    draw = -F.log(unit(F.col(key), seed)) / F.when(F.col("rest_") > 1e-9, F.col("rest_"))
    place = global_row_number(w.withColumn("draw_", F.coalesce(F.round(draw, 9), F.lit(float("inf")))), "draw_", "rank_", key)
    ranked = place.withColumn("rank_", F.col("rank_") + 1).crossJoin(F.broadcast(left))
    return ranked.select(key, weight, (F.col("whole_") + F.when(F.col("rank_") <= F.col("left_"), 1).otherwise(0)).cast("long").alias("slots"))


def weighted_combos(rows: DataFrame, key: str, first: DataFrame, second: DataFrame, seed: int = 0) -> DataFrame:
    """Each row gets a value of both lists: they are expanded by their slots and shuffled apart.
    The lists: value, slots; each adds up to the number of rows."""

    def shuffled(values: DataFrame, name: str, salt: int) -> DataFrame:
        wide = values.select("value", F.explode(F.sequence(F.lit(1), F.col("slots").cast("int"))).alias("n_")).withColumn("mark_", portable_hash(F.xxhash64("value", "n_").bitwiseAND(F.lit(2**31 - 1)), seed + salt))
        return global_row_number(wide, "mark_", "k_", "value", "n_").select(F.col("value").alias(name), "k_")

    numbered = global_row_number(rows, key, "k_")
    return numbered.join(shuffled(first, "first", 1), "k_").join(shuffled(second, "second", 2), "k_").drop("k_")


def mode_combos(rows: DataFrame, key: str, mode: str, seed: int = 0) -> DataFrame:
    """A tool and a result type for each call of one mode: tools by the mode's weights, types by
    theirs, each list dealt to the last row by random remainders and shuffled apart."""
    n = rows.count()
    if not n:
        return rows.select("*", F.lit(None).cast("string").alias("tool"), F.lit(None).cast("string").alias("result_type"))

    def dealt(weights: dict[str, float], salt: int) -> DataFrame:
        table = rows.sparkSession.createDataFrame([(v, float(w)) for v, w in weights.items()], "value string, weight double")
        return random_remainder(table, "value", "weight", n, seed + salt)

    made = weighted_combos(rows, key, dealt(CONFIG.mode_tools[mode], 1), dealt(CONFIG.result_types, 2), seed)
    return made.withColumnsRenamed({"first": "tool", "second": "result_type"})


def merge_by_tool(parts: DataFrame, response: str, tool: str, order: str, tools: list[str]) -> DataFrame:
    """Links of each requested tool over all parts, in order; [] where a tool gave none; the first
    summary that isn't empty. Columns: links, summary."""
    known = parts.where(F.col(tool).isin(tools))
    lists = [F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col(tool) == t, F.struct(order, "links")))), lambda s: s["links"])).alias(t) for t in tools]
    return known.groupBy(response).agg(*lists, F.min_by("summary", F.when(F.coalesce("summary", F.lit("")) != "", F.col(order))).alias("summary"))
