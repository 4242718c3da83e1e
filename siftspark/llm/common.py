"""Helpers shared by the training-data operators: names, checkpoints, Arrow text handling."""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Callable, Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 << 20  # ids up to this size are broadcast; beyond, both sides shuffle
FILTER_BYTES = 64 << 20  # of a broadcast Bloom filter, at most; a larger one lets less through to the shuffle
SAMPLE_BYTES = 16 << 20  # text of each class that a model is fitted on; texts over an eighth of it aren't trained on
SLICE_BYTES = 6 << 20  # text handled at once in a Python worker; bounds its memory, not the work


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (Spark compares without case)."""
    taken = {c.lower() for c in df.columns}
    return next(n for k in count() if (n := name + "_" * k).lower() not in taken)


def col(name: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_folder(spark: SparkSession) -> str:
    """The folder of the session's ``spark.checkpoint.dir``; only on one machine (tests) may that
    be unset, and then it is a temporary one, set for the session."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (context.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp("sift"))
    return context.getCheckpointDir()


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a written folder that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the cluster's checkpoint folder, its lineage cut. Spark deletes the files
    once nothing refers to them, if spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def whole_id(df: DataFrame, name: str) -> Column:
    """An id column as a whole number; what isn't one, such as a string of letters, is null."""
    kind = df.schema[name].dataType.simpleString() if name in df.columns else ""
    return col(name).cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else col(name).cast("string").try_cast("long")


def _positions(bits: int):
    def positions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64((1 << bits) - 1)
        return mix(x) & mask, mix(x ^ np.uint64(0x9E3779B97F4A7C15)) & mask

    return positions


def _filter_bits(bits: int, part_bits: int):
    positions = _positions(bits)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.concatenate(positions(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(part_bits)).astype(np.int32)), pa.array((at & np.uint64((1 << part_bits) - 1)).astype(np.int64))], ["part", "at"])

    def build(table: pa.Table) -> pa.Table:
        bit = np.zeros(1 << part_bits, np.uint8)
        bit[table.column("at").to_numpy()] = 1
        return pa.table({"part": table.column("part")[:1], "bits": pa.array([np.packbits(bit, bitorder="little").tobytes()], pa.binary())})

    return spread, build


def membership(values: DataFrame, filter_bytes: int = FILTER_BYTES) -> Callable[[Column], Column]:
    """A test of long columns: false where a value surely isn't in the one column of ``values``.

    A Bloom filter of about 16 bits a value and of ``filter_bytes`` at most, built in tasks and
    broadcast. What it lets through besides, 1 in 70 below that size and more beyond, costs its
    shuffle only: callers compare it in full. Nulls are in nothing.
    """
    spark = values.sparkSession
    bits = int(min(max(12, np.ceil(np.log2(16 * max(values.count(), 1)))), max(12, np.floor(np.log2(8 * filter_bytes)))))
    part_bits = min(bits, 22)
    spread, build = _filter_bits(bits, part_bits)
    found = values.mapInArrow(spread, "part int, at long").groupBy("part").applyInArrow(build, "part int, bits binary")
    whole = np.zeros((1 << bits - part_bits, 1 << part_bits >> 3), np.uint8)
    for row in found.toLocalIterator():
        whole[row.part] = np.frombuffer(row.bits, np.uint8)
    shared, positions = spark.sparkContext.broadcast(whole.ravel()), _positions(bits)

    def test(x: pa.Array) -> pa.Array:
        table = shared.value
        v = pc.fill_null(x, 0).to_numpy(zero_copy_only=False).view(np.uint64)
        in_all = np.ones(len(v), bool)
        for at in positions(v):
            in_all &= (table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)
        return pa.array(in_all & x.is_valid().to_numpy(zero_copy_only=False))

    return F.arrow_udf(test, "boolean")


def without_ids(docs: DataFrame, id_col: str, gone: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """The rows of ``docs`` whose id isn't in the one column of ``gone``; null ids stay, and ids
    that aren't whole numbers; repeated rows stay or go together.

    Few ids are broadcast. Of many, only rows that may be among them are shuffled, and compared.
    """
    drop, key = fresh(docs, "drop_id"), whole_id(docs, id_col)
    gone = durable(gone.toDF(drop))
    if gone.count() * 8 <= broadcast_bytes:
        return docs.join(F.broadcast(gone), key == col(drop), "left_anti")
    test, maybe = membership(gone, filter_bytes), fresh(docs, "maybe_gone")
    marked = docs.withColumn(maybe, test(key))
    rest = marked.where(col(maybe)).join(gone, key == col(drop), "left_anti")
    return marked.where(~col(maybe)).drop(maybe).unionAll(rest.drop(maybe))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array without nulls (null reads as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "")


def offsets(a: pa.Array) -> np.ndarray:
    """The value offsets of a string or list array, as int64, starting at the array's own offset."""
    return np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64) if len(a) else np.zeros(1, np.int64)


def text_bytes(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all strings, end to end, and the offsets into them."""
    off = offsets(a)
    data = a.buffers()[2] if len(a) else None
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(batches: Iterable[pa.RecordBatch], text: int | str) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of about SLICE_BYTES of text; a longer single row stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // SLICE_BYTES
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(a, b - a)


def words(text: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words (runs of letters and digits) of each text: codes, text offsets into them, vocabulary."""
    text = strings(text)
    if lower:
        text = pc.utf8_lower(text)
    text = pc.replace_substring_regex(text, r"[^\pL\pN\pM]+", " ")
    parts = pc.ascii_split_whitespace(pc.ascii_trim(text, " "))
    flat = parts.flatten()
    ends = np.r_[0, np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))].astype(np.int64) if len(parts) else np.zeros(1, np.int64)
    if len(flat) and pc.any(pc.equal(flat, "")).as_py():  # a text without words splits into one empty string
        real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        ends = np.r_[0, np.cumsum(real)][ends]
        flat = flat.filter(pa.array(real))
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), ends, coded.dictionary


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, element by element."""
    x = x.astype(np.uint64, copy=True)
    for shift, by in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(by)
    return x ^ (x >> np.uint64(33))


def hash_strings(a: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string: a polynomial over its bytes, then mixed."""
    raw, off = text_bytes(a)
    start, length = off[:-1], np.diff(off)
    out = length.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    if len(raw):
        at = np.arange(len(raw)) - np.repeat(start, length)
        powers = np.full(int(length.max()) + 1, 0x9E3779B97F4A7C15, np.uint64)
        powers = np.multiply.accumulate(powers)
        some = length > 0
        out[some] ^= np.add.reduceat((raw.astype(np.uint64) + np.uint64(1)) * powers[at], start[some])
    return mix(out)


def chain(*hashes: np.ndarray) -> np.ndarray:
    """An ordered hash of several hashes."""
    out = np.zeros(len(hashes[0]), np.uint64)
    for h in hashes:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h)
    return out


def bounded(sample: DataFrame, size: int) -> DataFrame:
    """Of (o, i, t, y), few rows with one for each i and y, the first of each class y whose texts,
    none of them over an eighth of it, add up to ``size`` bytes."""
    sample = durable(sample.where(F.octet_length("t") <= size // 8))
    upto = F.sum(F.octet_length("t")).over(Window.partitionBy("y").orderBy("o", "i").rowsBetween(Window.unboundedPreceding, 0))
    chosen = sample.select("i", "y", upto.alias("upto")).where(F.col("upto") <= size).select("i", "y")  # as many rows as the sample at most
    return sample.join(F.broadcast(chosen), ["i", "y"])


def fitted(sample: DataFrame, fit: Callable[..., dict], *columns: str) -> Broadcast:
    """A model fitted in one task on a bounded sample, sent to the driver and on to all executors.

    ``sample`` has the named columns and "o", "i" to order its rows by, so that the model depends
    on nothing else; ``fit`` takes the columns as Arrow arrays, those of no row included. The
    sample itself never comes to the driver.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("o", "ascending"), ("i", "ascending")])
        return pa.table({"model": pa.array([pickle.dumps(fit(*(table.column(c).combine_chunks() for c in columns)))], pa.binary())})

    row = sample.withColumn("g", F.lit(0)).groupBy("g").applyInArrow(run, "model binary").first()
    if row is None:
        kinds = [pa.string() if sample.schema[c].dataType.simpleString() == "string" else pa.int32() for c in columns]
        model = fit(*(pa.array([], k) for k in kinds))
    else:
        model = pickle.loads(row.model)
    return sample.sparkSession.sparkContext.broadcast(model)
