"""Queries over stored logs: optional filters, groups, top groups, pivots, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions.text import blank_to_null


def optional_filters(df: DataFrame, **wanted) -> DataFrame:
    """Rows equal to every value that is given; a list means any of its values."""
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name) == F.lit(value))
    return df


def containing(df: DataFrame, column: str, text: str | None) -> DataFrame:
    """Rows whose column contains the text in any case; blank text filters nothing."""
    text = (text or "").strip().lower()
    return df.where(F.contains(F.lower(column), F.lit(text))) if text else df


GROUP = ("epoch", "uid", "search_type", "query")


def top_groups(logs: DataFrame, n: int = CONFIG.log_groups, key=GROUP) -> DataFrame:
    """The first groups: latest epoch, then uid, type and query; nulls last."""
    order = [F.col(key[0]).desc_nulls_last(), *(F.col(k).asc_nulls_last() for k in key[1:])]
    return logs.select(*key).distinct().orderBy(*order).limit(n)


def members(logs: DataFrame, groups: DataFrame, key=GROUP) -> DataFrame:
    on = None
    g = groups.select(*(F.col(k).alias(f"g_{k}") for k in key))
    for k in key:
        same = logs[k].eqNullSafe(g[f"g_{k}"])
        on = same if on is None else on & same
    return logs.join(F.broadcast(g), on, "left_semi")  # at most a page of groups


def group_logs(logs: DataFrame, reward: str, checker: str, key=GROUP) -> DataFrame:
    """A row for each group: how many checkers saw it, their rewards' range, and them in order."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(checker).isNull().alias("last_"), F.col(checker), F.col(reward))))
    return logs.groupBy(*key).agg(
        F.count("*").alias("checkers"), F.min(reward).alias("reward_min"), F.max(reward).alias("reward_max"), F.avg(reward).alias("reward_avg"),
        F.transform(listed, lambda s: s[checker]).alias("checker_list"),
    )


def top_rows(df: DataFrame, *order: Column, n: int = CONFIG.log_rows) -> DataFrame:
    return df.orderBy(*order).limit(n)


def lists_by_key(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Keys with their values in order; keys in order of their first row."""
    return df.groupBy(key).agg(F.min(order).alias("first_seen"), F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value]).alias("values"))


def pivot_lanes(state: DataFrame, key: str, lane: str, value: str, lanes: list[str], default) -> DataFrame:
    """A row for each key, a column for each lane; what is missing gets the default."""
    wide = state.groupBy(key).pivot(lane, lanes).agg(F.first(value))
    return wide.select(key, *(F.coalesce(F.col(f"`{x}`"), F.lit(default)).alias(x.replace(":", "_")) for x in lanes))


def merge_checkers(rows: DataFrame, key: str, checker: str, order: str, value: str, identity: str) -> DataFrame:
    """Providers over all checkers: identity by the first that knows them, and a map of states."""
    return rows.groupBy(key).agg(
        F.min_by(identity, order).alias(identity), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(checker).cast("string"), F.col(value))))).alias("states"), F.count("*").alias("n")
    )


def first_wins(df: DataFrame, key: list[str], *order: Column | str) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("rank_", F.row_number().over(w)).where("rank_ = 1").drop("rank_")


def richest_wins(df: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """The longest text of each key, the first of equally long ones."""
    return first_wins(df, [key], F.length(text).desc(), F.col(order))


def with_defaults(roster: DataFrame, state: DataFrame, on: list[str], defaults: dict) -> DataFrame:
    out = roster.join(state, on, "left")
    for name, value in defaults.items():
        out = out.withColumn(name, F.coalesce(name, F.lit(value)))
    return out


def nonblank(df: DataFrame, column: str) -> DataFrame:
    return df.where(blank_to_null(column).isNotNull())
