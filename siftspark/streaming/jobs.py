"""Structured Streaming: hourly windows, response folds, reachability and rate limits.

Every job takes a streaming DataFrame and returns one; run_available runs it over all that is
there and gives the result as a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import CONFIG
from ..session import shared_folder


def read_files(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as a stream, whether it is one file or a folder of files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")  # a stream's path is a folder or a pattern


def arriving(parts: list[DataFrame]) -> DataFrame:
    """Tables as a stream in which each arrives after the one before, in a batch of its own."""
    spark = parts[0].sparkSession
    folder = shared_folder(spark, "arriving")
    for k, part in enumerate(parts):
        part.write.parquet(f"{folder}/{k}")
        one = spark.read.schema(part.schema).parquet(f"{folder}/{k}").coalesce(1)  # a batch is a file
        one.write.mode("append").parquet(f"{folder}/all")
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/all")


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream gives for what is there now: appended rows, or the last complete or
    updated state. Output and progress are in the cluster's shared folder."""
    spark = stream.sparkSession
    folder = shared_folder(spark, "stream")
    setting, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(setting)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/{'all' if mode == 'complete' else f'batch={number}'}")  # a repeated batch replaces itself

    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{folder}/out/{'all' if mode == 'complete' else 'batch=-1'}")
    try:
        spark.conf.set(setting, provider)
        stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out/all" if mode == "complete" else f"{folder}/out/*")


def hourly(stream: DataFrame, at: str, value: str, late: str = "2 hours") -> DataFrame:
    """Count and sum of each hour that can't change any more: rows that come after their hour has
    ended by more than ``late`` are dropped, and hours that may still get rows are withheld."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    w = timed.groupBy(F.window(at, "1 hour").alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("w.start").alias("hour"), "n", "total")


def fold(stream: DataFrame, key: str, order: str, kind: str, content: str) -> DataFrame:
    """Of each response what is appended in order, and what the last message replaced."""
    append = F.col(kind) == "user"
    parts = F.transform(F.array_sort(F.collect_list(F.when(append, F.struct(order, content)))), lambda s: s[content])
    return stream.groupBy(key).agg(F.array_join(parts, "").alias("appended"), F.max_by(content, F.when(~append, F.col(order))).alias("replaced"))


class _Reachability(StatefulProcessor):
    """Consecutive failures, and since when; rows out at each change between up and down."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("run", "failures long, since timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        failures, since = self.state.get() if self.state.exists() else (0, None)
        out = []
        for at, _, failed in sorted((r for f in rows for r in zip(f["at"], f["seq"], f["failed"])), key=lambda r: (r[0], r[1])):
            if failed:
                failures += 1
                if failures == 1:
                    since = at
                    out.append((key[0], at, "down"))
            elif failures:
                out.append((key[0], at, "up"))
                failures, since = 0, None
        self.state.update((failures, since))
        yield pd.DataFrame(out, columns=["uid", "at", "change"])

    def close(self) -> None:
        pass


def reachability(stream: DataFrame, uid: str, at: str, order: str, failed) -> DataFrame:
    """(uid, at, change): when a provider goes down with a failed call, and comes up again."""
    calls = stream.select(F.col(uid).cast("long").alias("uid"), F.col(at).cast("timestamp").alias("at"), F.col(order).cast("long").alias("seq"), failed.alias("failed"))
    return calls.groupBy("uid").transformWithStateInPandas(_Reachability(), "uid long, at timestamp, change string", "append", "none")


def limiter(limit: int, seconds: float) -> Callable[[list[float], list[float]], tuple[list[bool], list[float]]]:
    """Admits a request if fewer than ``limit`` were admitted in the seconds before; refused ones
    don't count. Takes times in order and those still open, and returns the decisions and the open ones."""

    def run(times: list[float], open_: list[float]) -> tuple[list[bool], list[float]]:
        kept, out = list(open_), []
        for t in times:
            while kept and kept[0] <= t - seconds:
                kept.pop(0)
            out.append(len(kept) < limit)
            if out[-1]:
                kept.append(t)
        return out, kept

    return run


class _RateLimit(StatefulProcessor):
    def __init__(self, limit: int, seconds: float):
        self.run = limiter(limit, seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("open", "times array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        requests = sorted((r for f in rows for r in zip(f["at"], f["seq"])), key=lambda r: (r[0], r[1]))
        admitted, kept = self.run([r[0] for r in requests], list(self.state.get()[0]) if self.state.exists() else [])
        self.state.update((kept,))
        yield pd.DataFrame({"uid": [key[0]] * len(requests), "seq": [r[1] for r in requests], "admitted": admitted})

    def close(self) -> None:
        pass


def rate_limit(stream: DataFrame, uid: str, at: str, order: str, limit: int = CONFIG.rate_limit, seconds: float = CONFIG.rate_seconds) -> DataFrame:
    """(uid, seq, admitted) of every request."""
    calls = stream.select(F.col(uid).cast("long").alias("uid"), (F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("at"), F.col(order).cast("long").alias("seq"))
    return calls.groupBy("uid").transformWithStateInPandas(_RateLimit(limit, seconds), "uid long, seq long, admitted boolean", "append", "none")


def rate_limit_batch(calls: DataFrame, uid: str, at: str, order: str, limit: int = CONFIG.rate_limit, seconds: float = CONFIG.rate_seconds) -> DataFrame:
    """The same over a table."""
    run = limiter(limit, seconds)
    rows = calls.select(F.col(uid).cast("long").alias("uid"), (F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("at"), F.col(order).cast("long").alias("seq"))

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "seq"])
        return pd.DataFrame({"uid": pdf["uid"], "seq": pdf["seq"], "admitted": run(pdf["at"].tolist(), [])[0]})

    return rows.groupBy("uid").applyInPandas(decide, "uid long, seq long, admitted boolean")
