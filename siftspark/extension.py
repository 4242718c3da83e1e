"""Plug-ins: rewards, penalties, tools and judges of one's own, by name."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.numeric import clamp, nan_to_zero
from .operators.scoring import penalty_product

REWARDS: dict[str, Callable[[DataFrame], DataFrame]] = {}
CHEAP: dict[str, Callable[[], Column]] = {}
DEEP: dict[str, Callable[[DataFrame], DataFrame]] = {}
TOOLS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register(kind: dict, name: str):
    """Adds a function to one of the registries."""

    if name in kind:
        raise ValueError(f"{name} is there already")

    def add(f):
        kind[name] = f
        return f

    return add


def with_rewards(responses: DataFrame, names: list[str], key: str = "response_id") -> DataFrame:
    """A column for each reward; 0 for a response without, or with NaN."""
    for name in names:
        reward = REWARDS[name](responses).select(key, F.col("reward").alias(name))
        responses = responses.join(reward, key, "left").withColumn(name, clamp(nan_to_zero(name)))
    return responses


def with_penalties(responses: DataFrame, cheap: list[str], deep: list[str], key: str = "response_id") -> DataFrame:
    """``cheap`` and ``product``: what the cheap penalties alone leave, and all of them."""
    for name in deep:
        responses = responses.join(DEEP[name](responses).select(key, F.col("penalty").alias(name)), key, "left")
    own = [CHEAP[n]() for n in cheap]
    return responses.withColumn("cheap", penalty_product(*own)).withColumn("product", penalty_product(*own, *(F.col(n) for n in deep)))


def run_tools(queries: DataFrame, names: list[str]) -> DataFrame:
    """All known tools' rows for the queries; unknown ones give none."""
    found = [TOOLS[n](queries).withColumn("tool", F.lit(n)) for n in names if n in TOOLS]
    if not found:
        raise ValueError("no known tool")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def judge(prompts: DataFrame, ask: Callable[[list[str]], list[str]], column: str = "prompt") -> DataFrame:
    """``answer``: what a batch function says to each prompt; '' where it fails or there is no prompt."""
    def answers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts_ in batches:
            some = prompts_.notna() & (prompts_.str.strip() != "")
            out = pd.Series("", index=prompts_.index)
            if some.any():
                try:
                    out[some] = ask(prompts_[some].tolist())
                except Exception:  # an outside service; no answer scores 0
                    pass
            yield out.fillna("")

    return prompts.withColumn("answer", F.pandas_udf(answers, "string")(F.col(column)))
