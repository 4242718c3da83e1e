"""Sharding by histogram sort: exact byte counts below probed keys, then one exchange."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, durable, fresh

SHARD_BYTES = 16 << 20  # text bytes aimed at in a shard
TOLERANCE = 0.0  # allowed error of a splitter, as a share of a shard; 0 finds the exact key
PROBES = 48  # candidate keys in each open interval and round, fewer where many intervals are open
ALL_PROBES = 1 << 18  # candidate keys in a round, at most two an interval beyond
MAX_PARTS = 1 << 16  # partitions of the exchange; more shards than that share partitions


def _below(probes: list[bytes]):
    """Per partition: bytes and keys strictly between neighbouring probes, and at each probe."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rows = np.zeros(2 * len(probes) + 1, np.int64), np.zeros(2 * len(probes) + 1, np.int64)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            at = np.fromiter(((2 * k + 1) if k < len(probes) and probes[k] == x else 2 * k for x in keys for k in (bisect_left(probes, x),)), np.int64, len(keys))
            size += np.bincount(at, batch.column(1).to_numpy(), len(size)).astype(np.int64)
            rows += np.bincount(at, minlength=len(rows))
        some = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(size[some]), pa.array(rows[some])], ["at", "size", "n"])

    return count


def _sample(intervals: list[tuple[bytes | None, bytes | None]], n: int):
    """Per partition: in each open interval the n keys of least hash, out of all that lie in it."""
    lows = [a or b"" for a, _ in intervals]  # no key is empty

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[dict[bytes, int]] = [{} for _ in intervals]
        for batch in batches:
            for x, h in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                k = bisect_left(lows, x) - 1
                if k >= 0 and (intervals[k][1] is None or x < intervals[k][1]):
                    found[k][x] = h
                    if len(found[k]) > 4 * n:
                        found[k] = dict(sorted(found[k].items(), key=lambda p: p[1])[:n])
        for k, mine in enumerate(found):
            least = sorted(mine.items(), key=lambda p: p[1])[:n]
            if least:
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(least), pa.int32()), pa.array([h for _, h in least], pa.int64()), pa.array([x for x, _ in least], pa.binary())], ["k", "h", "key"])

    return pick


def find_splitters(keys: DataFrame, shards: int, total: int, tolerance: float = TOLERANCE, probes: int = PROBES, ends: list[int] | None = None) -> tuple[list[bytes], list[int]]:
    """The keys that end the shards, all but the last, and the bytes up to and with each: of (key
    binary, size long, h long) the i-th is the least key up to which the sizes add to at least
    i/shards of the total, or one whose sum is within the tolerance of it. ``ends``: only these i."""
    targets = [-(-i * total // shards) for i in (range(1, shards) if ends is None else ends)]
    sums = [0] * len(targets)
    slack = int(tolerance * total / shards)
    # of each target: the keys that bound it, both exclusive, and the bytes up to and with the lower
    low: list[bytes | None] = [None] * len(targets)
    high: list[bytes | None] = [None] * len(targets)
    base = [0] * len(targets)
    done: list[bytes | None] = [None] * len(targets)
    while open_ := [i for i, d in enumerate(done) if d is None]:
        spans = sorted({(low[i], high[i]) for i in open_}, key=lambda s: s[0] or b"")
        probes = min(probes, max(2, ALL_PROBES // len(spans)))
        picked = (
            keys.mapInArrow(_sample(spans, probes), "k int, h long, key binary").groupBy("k")
            .agg(F.slice(F.array_sort(F.collect_set(F.struct("h", "key"))), 1, probes).alias("s")).collect()
        )
        candidates = sorted({bytes(x.key) for row in picked for x in row.s})
        counted = keys.mapInArrow(_below(candidates), "at int, size long, n long").groupBy("at").agg(F.sum("size").alias("size")).collect()
        size = np.zeros(2 * len(candidates) + 1, np.int64)
        for row in counted:
            size[row["at"]] = row["size"]
        upto = np.cumsum(size)  # up to and with each bucket
        for i in open_:
            a = bisect_left(candidates, low[i]) if low[i] is not None else 0
            b = bisect_left(candidates, high[i]) if high[i] is not None else len(candidates)
            for k in range(a, b):
                if upto[2 * k + 1] >= targets[i] or abs(int(upto[2 * k + 1]) - targets[i]) <= slack:
                    if upto[2 * k] < targets[i] or abs(int(upto[2 * k + 1]) - targets[i]) <= slack:
                        done[i], sums[i] = candidates[k], int(upto[2 * k + 1])  # the target falls on this very key
                    else:
                        high[i] = candidates[k]
                    break
                low[i], base[i] = candidates[k], int(upto[2 * k + 1])
    return [d for d in done if d is not None], sums


def _place(splitters: list[bytes]):
    def place(keys: pa.Array) -> pa.Array:
        return pa.array([bisect_left(splitters, x) for x in keys.to_pylist()], pa.int32())

    return place


def _number(bases: list[int], shards: int, total: int):
    """The shard of each row of partitions sorted by key, from the bytes of all keys below its own."""

    def number(rows: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        last, below, mine = None, 0, 0  # the key before, bytes below it, bytes of it so far
        for part, key, size in rows:
            out = []
            for p, k, n in zip(part.to_pylist(), key.to_pylist(), size.to_pylist()):
                if last is None or last[0] != p:
                    below, mine = bases[p], 0
                elif last[1] != k:
                    below, mine = below + mine, 0
                last, mine = (p, k), mine + n
                out.append(min(shards - 1, below * shards // total))
            yield pa.array(out, pa.int32())

    return number


def histogram_sort(docs: DataFrame, key_cols: tuple[str, ...] = ("source", "doc_id"), text_col: str = "text", shard_bytes: int = SHARD_BYTES, tolerance: float = TOLERANCE, shard_name: str = "shard", max_parts: int = MAX_PARTS) -> DataFrame:
    """All rows of ``docs`` in shards of about ``shard_bytes`` of text, with the shard's number.

    Shards are ranges of the key columns' order (nulls first, strings by bytes, integers by
    value), each one partition sorted by them; rows with equal keys share a shard. There are
    ceil(total bytes / shard_bytes) shards, some of them empty where one key outweighs a shard.
    Null and empty texts have no bytes; an empty table stays so. The shard column is called
    ``shard``, lengthened by underscores if there is one. Counting reads a narrow table of keys
    and sizes that is written once; the documents themselves move once. Of more shards than
    ``max_parts`` splitters are sought between partitions of several shards only, and a running sum
    numbers the shards within each. Key columns may be strings, integers or what casts to strings.
    """
    name, key = fresh(docs, shard_name), fresh(docs, "sort_key")
    types = dict(docs.dtypes)
    parts = []
    for c in key_cols:
        if types[c] in ("tinyint", "smallint", "int", "bigint"):
            # sign bit flipped, big end first: byte order is then the order of the values
            flipped = col(c).cast("long").bitwiseXOR(F.lit(-(2**63)).cast("long"))
            part = F.unhex(F.lpad(F.hex(flipped), 16, "0"))
        else:  # zero bytes escaped, and an end below all escapes: a string sorts before its continuations
            part = F.concat(F.replace(col(c).cast("string"), F.lit("\0"), F.lit("\0\1")).cast("binary"), F.unhex(F.lit("0000")))
        parts.append(F.when(col(c).isNull(), F.unhex(F.lit("00"))).otherwise(F.concat(F.unhex(F.lit("01")), part)))
    keyed = docs.withColumn(key, F.concat(*parts))
    sizes = durable(keyed.select(col(key).alias("key"), F.coalesce(F.octet_length(col(text_col).cast("string")), F.lit(0)).cast("long").alias("size"), F.xxhash64(col(key)).alias("h")))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    if shards <= max_parts:
        splitters, _ = find_splitters(sizes, shards, total, tolerance)
        placed = keyed.withColumn(name, F.arrow_udf(_place(splitters), "int")(col(key)))
        return placed.repartitionById(shards, col(name)).sortWithinPartitions(col(key)).drop(key)
    ends = [j * shards // max_parts for j in range(1, max_parts)]
    splitters, sums = find_splitters(sizes, shards, total, tolerance, ends=ends)
    part, size = fresh(keyed, "part"), fresh(keyed, "size")
    placed = keyed.withColumn(part, F.arrow_udf(_place(splitters), "int")(col(key))).withColumn(size, F.coalesce(F.octet_length(col(text_col).cast("string")), F.lit(0)).cast("long"))
    moved = placed.repartitionById(max_parts, col(part)).sortWithinPartitions(col(key))
    return moved.withColumn(name, F.arrow_udf(_number([0, *sums], shards, total), "int")(col(part), col(key), col(size))).drop(key, part, size)


def sharded_documents(spark, sf_dir: str) -> DataFrame:
    """op3_histogram_sort over the whole documents table."""
    return histogram_sort(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SHARDS_SQL = f"""
WITH sized AS (SELECT *, coalesce(strlen(text), 0) AS size FROM documents),
below AS (SELECT *, sum(size) OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                  - sum(size) OVER (PARTITION BY source, doc_id) AS before, sum(size) OVER () AS total FROM sized),
shards AS (SELECT *, greatest(1, CAST(ceil(total / {SHARD_BYTES}.0) AS BIGINT)) AS n FROM below)
SELECT doc_id, text, lang, source, n_chars, CAST(CASE WHEN total = 0 THEN 0 ELSE least(n - 1, before * n // total) END AS INTEGER) AS shard FROM shards
"""
