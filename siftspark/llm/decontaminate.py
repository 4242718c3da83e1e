"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chain, col, hash_strings, slices, strings, whole_id, without_ids, words

SEED = 3  # words in a seed; an item with fewer is its own seed
MATCH, MISMATCH, GAP = 2, -1, -1
SHARE = 0.5  # of an item's full score from which a document counts as contaminated
INDEX_BYTES = 64 << 20  # benchmark text indexed and broadcast at once; more takes further passes


def build_index(ids: list[int], texts: list[str]) -> dict:
    """Hashed words of some benchmark items, and their n-grams with the items that hold them."""
    codes, ends, vocabulary = words(pa.array(texts, pa.string()))
    hashed = hash_strings(vocabulary)
    items = [hashed[codes[a:b]] for a, b in zip(ends[:-1], ends[1:])]
    keys = [np.unique(grams(w, min(SEED, len(w)))) for w in items]
    owner = np.repeat(np.arange(len(items)), [len(k) for k in keys])
    key = np.concatenate([*keys, np.zeros(0, np.uint64)])
    order = np.argsort(key, kind="stable")
    return {"ids": np.array(ids, np.int64), "items": items, "words": np.unique(hashed), "sizes": sorted({min(SEED, len(w)) for w in items} - {0}), "key": key[order], "owner": owner[order].astype(np.int64)}


def grams(w: np.ndarray, n: int) -> np.ndarray:
    return chain(*(w[i : len(w) - n + 1 + i] for i in range(n))) if 0 < n <= len(w) else np.zeros(0, np.uint64)


def _hits(index: dict, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of the texts, offsets into them, and the (text, key) of each distinct seed hit."""
    codes, ends, vocabulary = words(text)
    w = hash_strings(vocabulary)
    known = np.isin(w, index["words"])[codes]
    w = w[codes]
    doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    docs, keys = [], []
    for n in index["sizes"]:
        if len(w) < n:
            continue
        m = len(w) - n + 1
        whole = doc[:m] == doc[n - 1 :]
        for i in range(n):
            whole &= known[i : m + i]
        at = np.flatnonzero(whole)
        key = chain(*(w[at + i] for i in range(n)))
        place = np.minimum(np.searchsorted(index["key"], key), max(len(index["key"]) - 1, 0))
        hit = index["key"][place] == key if len(index["key"]) else np.zeros(len(key), bool)
        docs.append(doc[at[hit]]), keys.append(key[hit])
    found = np.unique(np.rec.fromarrays([np.concatenate(docs or [np.zeros(0, np.int64)]), np.concatenate(keys or [np.zeros(0, np.uint64)])], names="d,k"))
    return w, ends, found["d"], found["k"]


def local_score(text: np.ndarray, item: np.ndarray) -> int:
    """The best Smith-Waterman score of a local alignment of two word sequences."""
    slope = np.arange(len(text) + 1, dtype=np.int32) * -GAP
    row = np.zeros(len(text) + 1, np.int32)
    best = 0
    for word in item:
        step = np.where(text == word, MATCH, MISMATCH).astype(np.int32)
        new = np.maximum(row + GAP, 0)
        np.maximum(new[1:], row[:-1] + step, out=new[1:])
        row = np.maximum.accumulate(new + slope) - slope  # gaps in the item, resolved in one sweep
        best = max(best, int(row.max()))
    return best


def stretches(text: np.ndarray, item: np.ndarray, least: float) -> list[np.ndarray]:
    """The parts of a text outside which no local alignment reaches ``least``.

    Each word of the text in an alignment adds MATCH at most if the item has it, and takes at
    least 1 off else. Where that sum falls to a new low, what came before adds nothing.
    """
    item = np.unique(item)
    place = np.minimum(np.searchsorted(item, text), len(item) - 1)
    total = np.cumsum(np.where(item[place] == text, MATCH, max(MISMATCH, GAP)))
    over = total - np.minimum.accumulate(np.minimum(total, 0))
    start = np.r_[0, np.flatnonzero(over == 0) + 1]
    start = start[start < len(text)]
    best = np.maximum.reduceat(over, start) if len(start) else start
    end = np.r_[start[1:], len(text)]
    return [text[a:b] for a, b in zip(start[best >= least], end[best >= least])]


def _align(shared, share: float):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        scored: dict[tuple[int, bytes], int] = {}  # equal stretches, as copies have, are aligned once
        for batch in slices(batches, 1):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            w, ends, docs, keys = _hits(index, batch.column(1))
            a, b = np.searchsorted(index["key"], keys), np.searchsorted(index["key"], keys, "right")
            n = b - a
            owner = index["owner"][np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            pairs = np.unique(np.repeat(docs, n) * np.int64(len(index["items"])) + owner)
            rows = []
            for d, i in zip(pairs // len(index["items"]), pairs % len(index["items"])):
                item = index["items"][i]
                least = (share if len(item) >= SEED else 1) * MATCH * len(item)
                score = 0
                for part in stretches(w[ends[d] : ends[d + 1]], item, least):
                    key = int(i), part.tobytes()
                    if key not in scored:
                        if len(scored) > 10_000:
                            scored.clear()
                        scored[key] = local_score(part, item)
                    score = max(score, scored[key])
                if score >= least:
                    rows.append((ids[d], index["ids"][i], score, score / (MATCH * len(item))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.float64()))], ["doc_id", "item_id", "score", "share"])

    return align


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", share: float = SHARE, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(doc_id, item_id, score, share) of every document that holds a benchmark item, perhaps
    edited: some n-gram in common, and a local alignment of all the document's words with
    the item's that reaches ``share`` of the score of the whole item. Items of fewer than SEED
    words must occur whole.

    No n-gram is too frequent to count. The benchmark is indexed in parts of ``index_bytes``, one
    pass over the documents for each. Ids that are null or no whole numbers, null texts and texts or
    items without words give nothing; rows that repeat an id give their best score; items that
    repeat an id count apart and give their best; other columns are ignored.
    """
    spark = docs.sparkSession
    narrow = docs.select(whole_id(docs, id_col).alias("doc_id"), col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    items = benchmark.select(whole_id(benchmark, item_col).alias("i"), col(item_text_col).cast("string").alias("t")).where("i is not null and t is not null")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0]
    out = None
    for part in range(max(1, -(-(size or 0) // index_bytes))):
        rows = items.where(F.pmod(F.xxhash64("i"), F.lit(max(1, -(-(size or 0) // index_bytes)))) == part).toArrow()
        index = build_index(rows.column("i").to_pylist(), strings(rows.column("t")).to_pylist())
        found = narrow.mapInArrow(_align(spark.sparkContext.broadcast(index), share), "doc_id long, item_id long, score int, share double")
        out = found if out is None else out.unionAll(found)
    return out.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("share").alias("share"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """``docs`` without those that hold a benchmark item; columns as they came, whatever their
    names. Rows with a null id, an id that is no whole number, a null or an empty text all stay;
    rows that repeat an id stay or go together."""
    return without_ids(docs, id_col, leaks(docs, benchmark, id_col, **how).select("doc_id").distinct())


def benchmark_leaks(spark, sf_dir: str) -> DataFrame:
    """op4_benchmark_decontamination over the whole documents and benchmark tables."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
