"""From scored responses to payouts: weighted means, pools, moving averages, weights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG, Config
from ..functions.arrays import lane_type
from ..functions.numeric import gate, nan_to_zero


def lane_means(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: weighted means of the gate and weight scores over deep rows (synthetic 5, organic
    15), both times the mean cheap penalty (1 where there is none); volume counts all rows.

    Columns: kind, is_deep, gate_score, weight_score, cheap (null unless a cheap row).
    """
    w = F.when(F.col("kind") == "synthetic", CONFIG.synthetic_weight).otherwise(CONFIG.organic_weight)
    deep = F.when(F.col("is_deep"), w)
    mean = lambda c: F.coalesce(F.try_divide(F.sum(deep * nan_to_zero(c)), F.sum(deep)), F.lit(0.0))
    cheap = F.coalesce(F.avg("cheap"), F.lit(1.0))
    return scored.groupBy(*keys).agg(
        (mean("gate_score") * cheap).alias("q_gate"), (mean("weight_score") * cheap).alias("q_weight"), F.count("*").alias("volume"), F.count_if("is_deep").alias("samples")
    )


def pool_payouts(lanes: DataFrame, epoch: str = "epoch", uid: str = "uid", lane: str = "lane", config: Config = CONFIG) -> DataFrame:
    """(epoch, uid, score): each lane's share, split by gate x quality^3 x volume^2.

    A pool that nobody passes pays nothing and its share isn't handed on.
    """
    share, threshold = (F.create_map(*(F.lit(v) for p in d.items() for v in p)) for d in (config.pool_share, config.threshold))
    passed = lanes.where((F.col("volume") > 0) & (F.col("samples") >= config.least_samples)).withColumn("gate", gate("q_gate", F.try_element_at(threshold, lane_type(lane)))).where("gate > 0")
    raw = passed.withColumn("raw", F.col("gate") * F.power("q_weight", F.lit(config.quality_power)) * F.power("volume", F.lit(config.volume_power)))
    pay = raw.withColumn("pay", F.try_element_at(share, F.col(lane)) * F.try_divide(F.col("raw"), F.sum("raw").over(Window.partitionBy(epoch, lane))))
    return pay.groupBy(epoch, uid).agg(F.coalesce(F.sum("pay"), F.lit(0.0)).alias("score"))


def scatter_mean(scores: DataFrame, roster: DataFrame, uid: str, score: str) -> DataFrame:
    """The roster with each one's mean score; 0 for those without."""
    mean = scores.groupBy(uid).agg(F.avg(score).alias("mean_score"))
    return roster.join(mean, uid, "left").withColumn("mean_score", F.coalesce("mean_score", F.lit(0.0)))


def ema(series: DataFrame, key: list[str], order: str, value: str, alpha: float = CONFIG.ema) -> DataFrame:
    """The last moving average of each key's values in order, from 0. A row is one step; for a
    dense average give a row for every step."""
    steps = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value])
    return series.groupBy(*key).agg(F.aggregate(steps, F.lit(0.0), lambda a, x: a * (1 - alpha) + nan_to_zero(x) * alpha).alias("ema"), F.count("*").alias("steps"))


def dense_spine(series: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """A row for every key and step; 0 where the series has none."""
    grid = series.select(key).distinct().crossJoin(F.broadcast(series.select(order).distinct()))
    return grid.join(series.groupBy(key, order).agg(F.avg(value).alias(value)), [key, order], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def l1_weights(scores: DataFrame, score: str) -> DataFrame:
    """``weight``: the score by the sum of all absolute scores; 0 if that is 0."""
    total = scores.agg(F.sum(F.abs(F.col(score))).alias("l1_total"))
    return scores.crossJoin(F.broadcast(total)).withColumn("weight", F.when(F.col("l1_total") > 0, F.col(score) / F.col("l1_total")).otherwise(0.0)).drop("l1_total")


def burn(weights: DataFrame, uid: str, target, share: float = CONFIG.burn_share) -> DataFrame:
    """The target gets ``share`` of the whole, the others the rest in their proportions. Nothing
    changes if the target is missing, is 0, or is all there is."""
    is_target = F.col(uid) == F.lit(target)
    sums = weights.agg(F.sum("weight").alias("all_"), F.sum(F.when(is_target, F.col("weight"))).alias("mine_"))
    out = weights.crossJoin(F.broadcast(sums))
    apply = F.col("mine_").isNotNull() & (F.lit(target) != 0) & (F.col("all_") - F.col("mine_") > 0)
    new = F.when(is_target, F.col("all_") * share).otherwise(F.col("weight") / (F.col("all_") - F.col("mine_")) * F.col("all_") * (1 - share))
    return out.withColumn("weight", F.when(apply, new).otherwise(F.col("weight"))).drop("all_", "mine_")


def reward_summary(rewards: DataFrame, uid: str, reward: str) -> DataFrame:
    r = F.col(reward)
    return rewards.groupBy(uid).agg(
        F.count("*").alias("n"), F.count_if(r > 0).alias("nonzero"), F.avg(r).alias("mean"), F.min(r).alias("least"), F.max(r).alias("most"),
        F.bool_and(r.isin(0.0, 1.0)).alias("binary"),
    )


def penalty_summary(penalties: DataFrame, uid: str, penalty: str) -> DataFrame:
    p = F.col(penalty)
    found = penalties.groupBy(uid).agg(F.count_if(p > 0).alias("triggered"), F.count("*").alias("total"), F.max(p).alias("most"), F.avg(p).alias("mean"))
    return found.where("triggered > 0")


def penalty_product(*penalties: Column, most: float = 1.0) -> Column:
    """What is left after all penalties, each between 0 and the most."""
    left = [F.lit(1.0) - F.greatest(F.lit(0.0), F.least(nan_to_zero(p), F.lit(most))) for p in penalties]
    return reduce(lambda a, b: a * b, left, F.lit(1.0))


def component_reward(content: Column, summary: Column, only_links: Column) -> Column:
    return F.when(only_links, nan_to_zero(content)).otherwise(nan_to_zero(content) * CONFIG.content_weight + nan_to_zero(summary) * CONFIG.summary_weight)


def final_scores(content: Column, summary: Column, only_links: Column, perf: Column, product: Column, floors: Column) -> tuple[Column, Column]:
    """(weight, gate): the reward times what the penalties leave, the weight also times the
    performance; where floors apply, a component below its floor takes the gate to 0."""
    reward = component_reward(content, summary, only_links) * product
    low = (nan_to_zero(content) < CONFIG.component_floor) | (~only_links & (nan_to_zero(summary) < CONFIG.component_floor))
    return reward * perf, F.when(floors & low, 0.0).otherwise(reward)
