"""Provider state: snapshot in, snapshot out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions.dates import ticks
from ..functions.numeric import decayed, next_verified


def upsert(state: DataFrame, seen: DataFrame, now: Column) -> DataFrame:
    """State after a listing: a changed identity starts anew, a changed declaration is staged for
    the next hour, rows that aren't listed stay as they are. Keys: uid, lane."""
    s, n = state.alias("s"), seen.alias("n")
    both = s.join(n, (F.col("s.uid") == F.col("n.uid")) & (F.col("s.lane") == F.col("n.lane")), "full")
    anew = F.col("s.uid").isNull() | (F.col("n.uid").isNotNull() & ~F.col("s.hotkey").eqNullSafe(F.col("n.hotkey")))
    listed = F.col("n.uid").isNotNull()
    staged = F.when(F.col("s.declared") != F.col("n.declared"), F.col("n.declared"))
    return both.select(
        F.coalesce("n.uid", "s.uid").alias("uid"), F.coalesce("n.lane", "s.lane").alias("lane"), F.coalesce("n.hotkey", "s.hotkey").alias("hotkey"),
        F.when(anew, 1).otherwise(F.col("s.verified")).alias("verified"), F.when(anew, F.col("n.declared")).otherwise(F.col("s.declared")).alias("declared"),
        F.when(anew, F.lit(None)).when(listed, staged).otherwise(F.col("s.pending_declared")).alias("pending_declared"),
        F.when(anew, 0.0).otherwise(F.col("s.quality_avg")).alias("quality_avg"), F.when(listed, now).otherwise(F.col("s.updated_at")).alias("updated_at"),
    )


def promote(state: DataFrame) -> DataFrame:
    """At the hour what was staged is declared."""
    return state.withColumn("declared", F.coalesce("pending_declared", "declared")).withColumn("pending_declared", F.lit(None).cast("int"))


def last_write(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last of the rows of each key."""
    return rows.withColumn("rank_", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("rank_ = 1").drop("rank_")


def update_by_key(state: DataFrame, new: DataFrame, key: list[str], column: str) -> DataFrame:
    """New values of a column; rows that aren't there aren't added."""
    return state.join(new.select(*key, F.col(column).alias("new_")), key, "left").withColumn(column, F.coalesce("new_", column)).drop("new_")


def purge(windows: DataFrame, at: str, now: Column, days: int = 3) -> DataFrame:
    return windows.where(F.col(at) >= now - F.make_interval(days=F.lit(days)))


def fan_out_lanes(rows: DataFrame, lane: str, existing: DataFrame, key: str, modes: list[str]) -> DataFrame:
    """A row of the whole type as one of each mode, unless there is one already."""
    wide = rows.withColumn(lane, F.explode(F.array(*(F.concat(F.col(lane), F.lit(f":{m}")) for m in modes))))
    return wide.join(existing.select(key, lane), [key, lane], "left_anti")


def call_islands(calls: DataFrame, key: list[str], order: list[str], failed: Column) -> DataFrame:
    """Runs of failed calls: since when, how many in a row, and whether the key is out at the end.

    The first failure of a run marks the key unreachable; a success clears it.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    marked = calls.withColumn("failed_", failed).withColumn("island_", F.sum(F.when(F.col("failed_"), 0).otherwise(1)).over(w))
    last = F.max("island_").over(Window.partitionBy(*key))
    runs = marked.withColumn("last_", last).where("failed_").groupBy(*key, "island_", "last_").agg(F.min(order[0]).alias("since"), F.count("*").alias("failures"))
    return runs.withColumn("still_out", F.col("island_") == F.col("last_")).drop("island_", "last_")


def decay(state: DataFrame, now: Column, seconds: int = CONFIG.tick_seconds) -> DataFrame:
    """Unreachable rows lose capacity by whole ticks; the clock moves by whole ticks alone."""
    n = F.when(F.col("unreachable_since").isNotNull(), F.greatest(ticks("last_decay_at", now, seconds), F.lit(0))).otherwise(0)
    return state.withColumn("ticks_", n).withColumn("verified", decayed("verified", F.col("ticks_"))).withColumn("last_decay_at", F.col("last_decay_at") + F.make_interval(secs=F.col("ticks_") * seconds)).drop("ticks_")


def ramp(state: DataFrame, touched: DataFrame, threshold: Column) -> DataFrame:
    """All lanes of the touched uids move by their own averages; the others stay."""
    hit = state.join(touched.select("uid").distinct().withColumn("hit_", F.lit(True)), "uid", "left")
    moved = next_verified("verified", "declared", F.col("quality_avg") >= threshold)
    return hit.withColumn("verified", F.when(F.col("hit_"), moved).otherwise(F.col("verified"))).drop("hit_")


def reset_replaced(state: DataFrame, identities: DataFrame, value: str) -> DataFrame:
    """A uid whose identity changed, or is new, starts at 0. Columns: uid, hotkey."""
    joined = identities.join(state.select("uid", F.col("hotkey").alias("was_"), value), "uid", "left")
    return joined.withColumn(value, F.when(F.col("was_").eqNullSafe(F.col("hotkey")), F.coalesce(value, F.lit(0.0))).otherwise(0.0)).drop("was_")
