"""Row numbers over a whole table without gathering it in one partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGE_ROWS = 500_000  # rows that a range aims at


def global_row_number(df: DataFrame, order: str, name: str, *ties: str) -> DataFrame:
    """``name``: the row's place from 0 by a numeric column, then by the others; without them ties
    are in any order.

    About equal ranges of the column, as many as the rows ask for, found by approximate quantiles,
    are numbered apart, each from the number of rows in the ranges before; nulls come first. A
    value that ends a range, as any does that fills one, is numbered by hashed parts if its ties
    may be in any order.
    """
    ranges = max(1, -(-df.count() // RANGE_ROWS))
    ranged = df.withColumn("order_", F.col(order))
    cuts = []
    if ranges > 1:
        cuts = ranged.agg(F.array_distinct(F.percentile_approx("order_", [k / ranges for k in range(1, ranges)], max(1000, 10 * ranges))).alias("c")).first().c or []
    ends = F.array(*map(F.lit, cuts))
    place = F.when(F.col("order_").isNull(), -1).otherwise(F.size(F.filter(ends, lambda c: c < F.col("order_")))) if cuts else F.lit(0)
    last = F.coalesce(F.col("order_").isin(cuts), F.lit(False)) if cuts else F.lit(False)  # the greatest value of its range
    part = F.lit(0) if ties else F.when(last, F.pmod(F.xxhash64(*df.columns), F.lit(64))).otherwise(0).cast("int")
    ranged = ranged.withColumn("key_", F.struct(place.alias("a"), last.alias("b"), part.alias("c")))
    sizes = ranged.groupBy("key_").agg(F.count("*").alias("size_"))
    before = sizes.select("key_", (F.sum("size_").over(Window.orderBy("key_")) - F.col("size_")).alias("before_"))  # a row for each range
    inside = F.row_number().over(Window.partitionBy("key_").orderBy(F.asc_nulls_first("order_"), *ties)) - 1
    return ranged.join(F.broadcast(before), "key_").withColumn(name, F.col("before_") + inside).select(*df.columns, name)
