"""Exact deduplication by an exchange of Golomb-coded fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FILTER_BYTES, col, durable, fresh, membership, shuffle_partitions, whole_id


def golomb_encode(values: np.ndarray) -> tuple[int, bytes]:
    """Sorted uint64 values as Golomb codes of their gaps, with a power of two as divisor:
    the divisor's exponent, and the unary quotients followed by the packed remainders."""
    gaps = np.diff(values, prepend=np.uint64(0))
    k = max(0, int(np.floor(np.log2(max(float(values[-1]) / len(values), 1.0)))))
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(quotient.sum()) + len(values), np.uint8)
    unary[np.cumsum(quotient + 1) - 1] = 1
    shifts = np.arange(k, dtype=np.uint64)
    rest = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8) if k else np.zeros(0, np.uint8)
    head = np.packbits(unary).tobytes()
    return k, len(head).to_bytes(4, "little") + head + np.packbits(rest.ravel()).tobytes()


def golomb_decode(k: int, n: int, blob: bytes) -> np.ndarray:
    """The n sorted values of golomb_encode."""
    size = int.from_bytes(blob[:4], "little")
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, size, 4)))[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        bits = np.unpackbits(np.frombuffer(blob, np.uint8, offset=4 + size), count=n * k).reshape(n, k)
        gaps += (bits.astype(np.uint64) << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


def _send(owner_bits: int):
    shift = np.uint64(64 - owner_bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) for b in batches if b.num_rows]
        if not parts:
            return
        prints = np.sort(np.concatenate(parts))
        owner = (prints >> shift).astype(np.int64)
        cuts = np.flatnonzero(np.r_[True, np.diff(owner) > 0])
        rows = []
        for a, b in zip(cuts, np.r_[cuts[1:], len(prints)]):
            k, blob = golomb_encode(prints[a:b] - (np.uint64(owner[a]) << shift))
            rows.append((int(owner[a]), int(b - a), k, blob))
        o, n, k, blob = zip(*rows)
        pid = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(o, pa.int32()), pa.array([pid] * len(o), pa.int32()), pa.array(n, pa.int32()), pa.array(k, pa.int32()), pa.array(blob, pa.binary())], ["owner", "pid", "n", "k", "blob"])

    return send


def _mark(table: pa.Table) -> pa.Table:
    """An owner's answer: to each sender a bitmap of which of its prints occur again anywhere."""
    n = table.column("n").to_pylist()
    prints = np.concatenate([golomb_decode(k, m, x) for k, m, x in zip(table.column("k").to_pylist(), n, table.column("blob").to_pylist())])
    _, back, times = np.unique(prints, return_inverse=True, return_counts=True)
    twice = times[back] > 1
    maps = [np.packbits(x).tobytes() for x in np.split(twice, np.cumsum(n)[:-1])]
    return pa.table({"owner": table.column("owner"), "pid": table.column("pid"), "bitmap": pa.array(maps, pa.binary())})


def _recall(owner_bits: int):
    shift = np.uint64(64 - owner_bits)

    def recall(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for owner, n, k, blob, bitmap in zip(*(c.to_pylist() for c in b.columns)):
                marked = np.unpackbits(np.frombuffer(bitmap, np.uint8), count=n).astype(bool)
                if marked.any():
                    prints = np.unique(golomb_decode(k, n, blob)[marked]) + (np.uint64(owner) << shift)
                    yield pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64))], ["print"])

    return recall


def repeated_prints(prints: DataFrame) -> DataFrame:
    """(print) of every 64-bit value that occurs at least twice in the one column of ``prints``.

    Each partition sends every owner (a range of the hash space) its sorted values as Golomb
    codes; owners return bitmaps of those seen again; senders read them off their own lists. The
    sent lists are written out, so that a lost executor can't renumber the senders.
    """
    owner_bits = max(1, int(np.ceil(np.log2(shuffle_partitions(prints.sparkSession)))))
    sent = durable(prints.mapInArrow(_send(owner_bits), "owner int, pid int, n int, k int, blob binary"))
    marks = sent.groupBy("owner").applyInArrow(_mark, "owner int, pid int, bitmap binary")
    return sent.join(marks, ["owner", "pid"]).select("owner", "n", "k", "blob", "bitmap").mapInArrow(_recall(owner_bits), "print long").distinct()


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(doc_id, keep_id) of every document whose text, byte for byte, is also that of one with a
    smaller id; keep_id is the smallest.

    Null texts equal nothing, empty texts equal each other, null ids aren't in the result, nor ids
    that aren't whole numbers; rows that repeat an id with one text count as one document, and an
    empty table gives none. Only texts that pass a filter of the fingerprints that occur again are
    shuffled, each once a partition however often it is there, and they are compared in full;
    other columns are ignored.
    """
    narrow = docs.select(whole_id(docs, id_col).alias("doc_id"), col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    printed = narrow.withColumn("print", F.xxhash64("text"))
    ids = durable(printed.select("doc_id", "print"))
    test = membership(durable(repeated_prints(ids.select("print"))), filter_bytes)
    suspects = printed.where(test(F.col("print")))
    kept = suspects.groupBy("print", "text").agg(F.min("doc_id").alias("keep_id"))
    kept = durable(kept.groupBy("print").agg(F.count("*").alias("texts"), F.min("keep_id").alias("keep_id")))
    found = ids.where(test(F.col("print"))).join(kept.where("texts = 1").select("print", "keep_id"), "print").select("doc_id", "keep_id")
    if kept.where("texts > 1").count():  # one fingerprint of several texts: nearly never
        same = Window.partitionBy("print", "text")
        several = suspects.join(kept.where("texts > 1").select("print"), "print", "left_semi").withColumn("keep_id", F.min("doc_id").over(same))
        found = found.unionAll(several.select("doc_id", "keep_id"))
    return found.where("doc_id <> keep_id").distinct()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """``docs`` with one row for each text: that of the smallest id (ids that are null or no whole
    numbers last, then the other columns' hash, maps by their sorted entries; variants aren't
    compared). Rows with a null text all stay, of empty texts one does; columns as they came,
    whatever their names. Only rows that pass a filter of the fingerprints that occur again are
    shuffled, one a partition of each text."""
    print_, maybe = fresh(docs, "print"), fresh(docs, "maybe")
    printed = docs.withColumn(print_, F.when(col(text_col).isNotNull(), F.xxhash64(col(text_col).cast("string"))))
    again = durable(repeated_prints(printed.select(col(print_)).where(col(print_).isNotNull())))
    marked = printed.withColumn(maybe, membership(again, filter_bytes)(col(print_)))
    suspects, others = marked.where(col(maybe)), marked.where(~col(maybe))
    rank = fresh(suspects, "rank")
    rest = [F.to_json(F.array_sort(F.map_entries(col(f.name)))) if isinstance(f.dataType, T.MapType) else col(f.name) for f in docs.schema.fields if f.name != text_col and (isinstance(f.dataType, T.MapType) or "map<" not in f.dataType.simpleString()) and "variant" not in f.dataType.simpleString()]
    order = [whole_id(docs, id_col).asc_nulls_last(), F.xxhash64(*rest)]
    first = suspects.withColumn(rank, F.row_number().over(Window.partitionBy(col(print_), col(text_col)).orderBy(*order))).where(col(rank) == 1)
    names = [col(c) for c in docs.columns]
    return first.select(*names).unionAll(others.select(*names))


def exact_copies(spark, sf_dir: str) -> DataFrame:
    """op8_exact_dedup over the whole documents table."""
    return copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))


EXACT_SQL = """
SELECT DISTINCT doc_id, keep_id
FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)
WHERE doc_id <> keep_id
"""
