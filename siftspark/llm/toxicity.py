"""Toxicity by class-conditional Kneser-Ney word models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SAMPLE_BYTES, bounded, chain, col, fitted, hash_strings, slices, strings, whole_id, words

TRAIN_ROWS = 5000  # labelled documents of each class that the models are fitted on, by least id hash
OWN_DISCOUNT = 1.5  # of the contexts that a class itself has for a word
PAIR_DISCOUNTS = (0.75, 1.5, 3.0, 8.0, 24.0, np.inf)  # of a class's own counts of word pairs; held-out texts choose one
SHARED = 0.98  # of the toxic model, the least share left to backoff
START = np.uint64(1)  # stands before the first word of a text


def _bigrams(w: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each word, and the hash of both."""
    before = np.r_[START, w[:-1]] if len(w) else w
    first = ends[:-1][np.diff(ends) > 0]
    before[first] = START
    return before, chain(before, w)


def fit(texts: pa.Array, toxic: np.ndarray) -> dict:
    """The two classes' models over one vocabulary, and the margin that parts held-out texts.

    A fifth of the texts is held out for the discount of pairs and the margin; the models are then
    fitted on all.
    """
    texts, toxic = strings(texts), np.asarray(toxic, bool)
    held = np.arange(len(texts)) % 5 == 4
    threshold, discount = 0.0 if toxic.any() and not toxic.all() else float("inf"), PAIR_DISCOUNTS[0]
    if (toxic & held).any() and (~toxic & held).any() and (toxic & ~held).any() and (~toxic & ~held).any():
        y, least = toxic[held], None
        rest, counted = texts.filter(pa.array(held)), _counts(texts.filter(pa.array(~held)), toxic[~held])
        for d in PAIR_DISCOUNTS:
            a, b, n = score(_model(*counted, d), rest)
            margin = np.where(n > 0, a - b, -np.inf)
            cuts = np.unique(margin[np.isfinite(margin)])
            cuts = np.r_[cuts[:1] - 1, (cuts[1:] + cuts[:-1]) / 2, cuts[-1:] + 1]
            if not len(cuts):
                continue
            # fewest errors, a clean text rejected counting three times; of equal cuts the middle one
            errors = np.searchsorted(np.sort(margin[y]), cuts) + 3 * ((~y).sum() - np.searchsorted(np.sort(margin[~y]), cuts))
            best = np.flatnonzero(errors == errors.min())
            # of equally many errors the discount whose margin tells the classes apart in most pairs of texts
            apart = np.searchsorted(np.sort(margin[~y]), margin[y]).sum()
            if least is None or (errors.min(), -apart) < least:
                least = (errors.min(), -apart)
                threshold, discount = float(cuts[best[len(best) // 2]]), d
        del counted
    return _fit(texts, toxic, discount) | {"threshold": threshold}


def _fit(texts: pa.Array, toxic: np.ndarray, discount: float = PAIR_DISCOUNTS[0]) -> dict:
    return _model(*_counts(texts, toxic), discount)


def _counts(texts: pa.Array, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The vocabulary, the pairs of its words, and of each class the documents that hold a pair."""
    parts, lengths = [], []
    for batch in slices([pa.record_batch({"t": texts})], 0):
        codes, ends, terms = words(batch.column(0))
        parts.append(hash_strings(terms)[codes])
        lengths.append(np.diff(ends))
    w, lengths = np.concatenate(parts or [np.zeros(0, np.uint64)]), np.concatenate(lengths or [np.zeros(0, np.int64)])
    del parts
    vocabulary, word = np.unique(w, return_inverse=True)
    del w
    size = len(vocabulary)
    ends = np.r_[0, np.cumsum(lengths)]
    pair = np.r_[size, word[:-1]] if len(word) else word  # the word before, or the start
    pair[ends[:-1][lengths > 0]] = size
    pair = pair * np.int64(max(size, 1)) + word
    del word
    once: tuple[list, list] = ([], [])
    for a, b, y in zip(ends[:-1], ends[1:], toxic):
        once[bool(y)].append(np.unique(pair[a:b]))
    del pair
    seen = [np.unique(np.concatenate(x or [np.zeros(0, np.int64)]), return_counts=True) for x in once]
    del once
    pairs = np.union1d(seen[0][0], seen[1][0])
    own = [np.zeros(len(pairs)) for _ in seen]
    for c, (key, n) in zip(own, seen):
        c[np.searchsorted(pairs, key)] = n
    return vocabulary, pairs, own


def _model(vocabulary: np.ndarray, pairs: np.ndarray, own: list[np.ndarray], discount: float) -> dict:
    """Tables of log probabilities. For class y, word w, and the word h before it:

    P_y(w|h) = (1 - s(h)) * discounted count of hw in y / all of h in y + s(h) * P_y(w)
    s(h) = the spare mass of h in the class that has more of it, 1 where a class lacks h
    P_ordinary(w) = discounted contexts of w / all contexts + spare mass * S(w)
    P_toxic(w) = (1 - b) * discounted contexts of w / all discounted + b * P_ordinary(w)
    S(w) = the number of classes that have w, one for the unseen word, over all of these

    Counts are of documents that hold a pair, contexts of a word the pairs it ends, each once a
    document, so that one long or repetitive text weighs little. Pairs are each class's own. S is
    shared by the classes, and the toxic model backs off to the ordinary one: a word that is rare
    in both, or frequent in both, weighs nearly alike, and what the sample of the smaller class
    happens to lack costs no more than log b.
    """
    size = len(vocabulary)
    head, word = pairs // max(size, 1), pairs % max(size, 1)
    contexts = [np.bincount(word, c, minlength=size) for c in own]
    shared = np.r_[(contexts[0] > 0) * 1.0 + (contexts[1] > 0), 1.0]
    shared /= shared.sum()
    kept = [np.r_[np.maximum(c - OWN_DISCOUNT, 0), 0.0] for c in contexts]
    total = [max(c.sum(), 1.0) for c in contexts]
    ordinary = kept[0] / total[0] + (1 - kept[0].sum() / total[0]) * shared
    back = max(SHARED, 1 - kept[1].sum() / total[1])
    toxic_ = (1 - back) * kept[1] / kept[1].sum() + back * ordinary if kept[1].any() else ordinary
    follow = [np.bincount(head, c, minlength=size + 1) for c in own]
    beyond = [np.maximum(c - discount, 0) for c in own]
    mass = [np.bincount(head, c, minlength=size + 1) for c in beyond]
    spare = np.maximum(*(1 - m / np.maximum(f, 1) for m, f in zip(mass, follow)))
    some = np.flatnonzero(((beyond[0] > 0) | (beyond[1] > 0)) & (spare[head] < 1))  # the others are what backoff gives
    head, word = head[some], word[some]
    high = [(1 - spare[head]) * c[some] / np.maximum(m[head], 1e-300) for c, m in zip(beyond, mass)]
    key = chain(np.r_[vocabulary, START][head], vocabulary[word])
    order = np.argsort(key)
    return {
        "vocabulary": vocabulary, "pairs": key[order], "spare": np.log(np.r_[spare, 1.0]),
        "classes": [{"pair": np.log(h + spare[head] * low[word])[order], "low": np.log(low)} for h, low in zip(high, (ordinary, toxic_))],
    }


def _find(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places in a sorted table, -1 where absent."""
    if not len(table):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return np.where(table[at] == x, at, -1)


def score(model: dict, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean log-likelihood per word in the toxic and in the ordinary model, and the words' number."""
    codes, ends, vocabulary = words(text)
    hashed = hash_strings(vocabulary)
    n = np.diff(ends)
    if not len(codes):
        return np.zeros(len(n)), np.zeros(len(n)), n
    before, pair = _bigrams(hashed[codes], ends)
    word = _find(model["vocabulary"], hashed)
    starts = ends[:-1][n > 0]
    heads = word[np.r_[0, codes[:-1]]]
    heads[starts] = len(model["vocabulary"])
    known = (word >= 0)[codes] & (heads >= 0)
    place = np.full(len(codes), -1)
    place[known] = _find(model["pairs"], pair[known])
    out = []
    for c in model["classes"]:
        each = c["low"][word][codes] + model["spare"][heads]  # -1 is the unseen word
        hit = place >= 0
        each[hit] = c["pair"][place[hit]]
        out.append(np.add.reduceat(each, starts) / n[n > 0])
    full = [np.zeros(len(n)), np.zeros(len(n))]
    for f, x in zip(full, out):
        f[n > 0] = x
    return full[1], full[0], n


def _apply(shared):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, 1):
            a, b, n = score(model, batch.column(1))
            null = lambda x: pa.array(x, mask=n == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), null(a), null(b), null(a - b), pa.array((n > 0) & (a - b >= model["threshold"]))], ["doc_id", "toxic_ll", "ordinary_ll", "margin", "is_toxic"])

    return apply


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(o, i, t, y): texts and 0/1 labels of at most ``rows`` labelled documents of each class, those
    of least id hash, with SAMPLE_BYTES of text a class at most.

    Null or contradictory labels are left out; of rows that repeat an id one is taken.
    """
    marked = labels.select(whole_id(labels, id_col).alias("i"), col(label).cast("int").alias("y")).where("i is not null and y in (0, 1)")
    marked = marked.groupBy("i").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z")
    rank = F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("i"), "i"))
    chosen = F.broadcast(marked.withColumn("rank", rank).where(F.col("rank") <= rows).select("i", "y"))
    texts = docs.select(whole_id(docs, id_col).alias("i"), col(text_col).cast("string").alias("t")).where("t is not null").join(chosen, "i")
    return bounded(texts.groupBy("i", "y").agg(F.min("t").alias("t")).withColumn("o", F.xxhash64("i")), SAMPLE_BYTES)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, toxic_ll, ordinary_ll, margin, is_toxic) of every row.

    The likelihoods are logs per word; a text is toxic when their difference reaches the margin
    learned from held-out labelled texts. Null, empty and wordless texts have null scores and
    aren't toxic; without labels of both classes nothing is known, and nothing is toxic. Texts
    are read whole. Repeated rows are scored each, an empty table gives none; ids that aren't whole
    numbers read as null; other columns are ignored.
    """
    shared = fitted(sample(docs, labels, "toxic", train_rows, id_col, text_col), fit, "t", "y")
    narrow = docs.select(whole_id(docs, id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(_apply(shared), "doc_id long, toxic_ll double, ordinary_ll double, margin double, is_toxic boolean")


def toxic_documents(spark, sf_dir: str) -> DataFrame:
    """op1_toxicity over the whole documents table."""
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
