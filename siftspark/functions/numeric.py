"""Curves, ramps and clamps. Each takes and returns Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CONFIG
from .text import _c


def clamp(x, low=0.0, high=1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), _c(x)))


def nan_to_zero(x) -> Column:
    return F.nanvl(F.coalesce(_c(x), F.lit(0.0)), F.lit(0.0))


def least_time(budget) -> Column:
    b = _c(budget)
    return F.when(b.isNull() | (b <= 0), 1.0).otherwise(F.least(F.lit(1.0), b * 0.3))


def scoring_budget(mode, limit) -> Column:
    known = F.create_map(*(F.lit(v) for p in CONFIG.budget.items() for v in p))
    return F.coalesce(F.try_element_at(known, F.coalesce(_c(mode), F.lit(""))), _c(limit).cast("double"), F.lit(0.0))


def performance(t, budget) -> Column:
    """1 up to 0.6 of the budget, then linear to 0 at the budget and a grace; 0 below the least
    believable time. Without a budget: 1, 3 and 8 seconds."""
    t, b = _c(t), _c(budget)
    none = b.isNull() | (b <= 0)
    full = F.when(none, 3.0).otherwise(b * 0.6)
    zero = F.when(none, 8.0).otherwise(b + F.least(F.lit(5.0), b * 0.5))
    return F.when(t.isNull() | (t < least_time(b)) | (t >= zero), 0.0).when(t <= full, 1.0).otherwise((zero - t) / (zero - full))


def performance_factor(p, search_type, mode) -> Column:
    floors = F.create_map(*(F.lit(v) for q in CONFIG.perf_floor.items() for v in q))
    f = F.coalesce(F.try_element_at(floors, F.coalesce(_c(mode), F.lit(""))), F.when(_c(search_type) == "x_search", CONFIG.perf_floor_x).otherwise(CONFIG.perf_floor_ai))
    return f + (F.lit(1.0) - f) * _c(p)


def gate(quality, threshold) -> Column:
    return clamp((_c(quality) - (_c(threshold) - CONFIG.ramp_width)) / CONFIG.ramp_width)


def timeout_penalty(t, limit, response_timeout, most=1.0) -> Column:
    """Grows by whole seconds beyond the limit, up to the most; full where a time is missing."""
    t, limit, r = _c(t), _c(limit), _c(response_timeout)
    window = F.when(r > limit, r - limit).otherwise(5.0)
    return F.when(t.isNull() | limit.isNull(), most).when(t <= limit, 0.0).otherwise(F.least(F.ceil(t - limit) * F.lit(most) / window, F.lit(most)))


def next_verified(current, declared, passed) -> Column:
    """Capacity one step up on a pass, one down on a fail; a step is a tenth of what is declared."""
    declared = F.greatest(_c(declared), F.lit(1))
    step = F.greatest(F.lit(1), (declared * F.lit(CONFIG.capacity_step)).cast("int"))
    return F.when(_c(passed), F.least(_c(current) + step, declared, F.lit(CONFIG.capacity_cap))).otherwise(F.greatest(F.lit(1), _c(current) - step)).cast("int")


def decayed(value, ticks) -> Column:
    """The value times 0.9, truncated to whole numbers at each tick, 1 at least."""
    steps = F.when(_c(ticks) > 0, F.sequence(F.lit(1), _c(ticks).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, _c(value).cast("int"), lambda a, _: F.greatest(F.lit(1), (a * F.lit(CONFIG.decay)).cast("int")))


def routing_weight(quality, verified) -> Column:
    return F.power(F.greatest(_c(quality), F.lit(0.1)), F.lit(3.0)) * F.power(F.greatest(_c(verified), F.lit(1)), F.lit(2.0))


def token_overage(counts) -> Column:
    """0.01 for each token beyond two of a chunk, summed, 1 at most; 1 without chunks."""
    over = F.aggregate(F.transform(_c(counts), lambda n: F.greatest(n - 2, F.lit(0)).cast("double") * 0.01), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.coalesce(F.size(_c(counts)), F.lit(0)) <= 0, 1.0).otherwise(F.least(F.lit(1.0), over))


def within_slack(a, b) -> Column:
    """Two counts agree: both missing, or apart by at most 0.6 of the second and 10."""
    a, b = _c(a), _c(b)
    slack = F.greatest((b * F.lit(CONFIG.numeric_slack)).cast("int"), F.lit(CONFIG.least_slack))
    return F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).otherwise(F.abs(a - b) <= slack)


def request_limit(mode) -> Column:
    """Seconds that a request may take: its mode's budget, 15 at least."""
    return F.greatest(scoring_budget(mode, F.lit(15)), F.lit(15.0))
