"""Quality by attention-based multiple-instance learning over a document's passages."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import col, fitted, slices, strings, text_bytes, whole_id
from .toxicity import sample

TRAIN_ROWS = 2000  # labelled documents of each class that the model is fitted on, by least id hash
PASSAGE = 512  # bytes; a text's last passage may be shorter
PAIRS = 256  # buckets of neighbouring byte pairs
HIDDEN, ATTENTION = 24, 12
EPOCHS, RATE, BATCH = 12, 0.01, 64
CHUNK = 4096  # passages whose features are counted at once


def features(text: pa.Array) -> tuple[Iterator[np.ndarray], np.ndarray]:
    """Rows of features of all passages, CHUNK at a time, and the number of passages of each text.

    Features are log frequencies of bytes and of hashed byte pairs, and how evenly both are spread.
    """
    raw, off = text_bytes(strings(text))
    n = -(-np.diff(off) // PASSAGE)

    def rows() -> Iterator[np.ndarray]:
        ends = np.cumsum(n)
        for low in range(0, int(n.sum()), CHUNK):
            at = np.arange(low, min(low + CHUNK, int(ends[-1])))
            doc = np.searchsorted(ends, at, "right")
            start = off[:-1][doc] + (at - (ends - n)[doc]) * PASSAGE
            size = np.minimum(PASSAGE, off[1:][doc] - start)
            part = raw[start[0] : start[-1] + size[-1]]
            of = np.repeat(np.arange(len(at)), size)
            one = np.bincount(of * 256 + part, minlength=len(at) * 256).reshape(len(at), 256)
            pair = (part[:-1].astype(np.int64) * 31 + part[1:] * 7) % PAIRS
            same = of[:-1] == of[1:]
            two = np.bincount(of[:-1][same] * PAIRS + pair[same], minlength=len(at) * PAIRS).reshape(len(at), PAIRS)
            scale = (1000.0 / (size + 64))[:, None]  # a short passage says less
            out = np.empty((len(at), 256 + PAIRS + 2), np.float32)
            out[:, :256] = np.log1p(one * scale)
            out[:, 256:-2] = np.log1p(two * scale)
            out[:, -2] = (one > 0).sum(1) / np.minimum(size, 64)
            out[:, -1] = (two > 0).sum(1) / np.minimum(size, PAIRS)
            yield out

    return rows(), n


def passages(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The features of all passages at once; for a sample."""
    rows, n = features(text)
    return np.concatenate([np.zeros((0, 256 + PAIRS + 2), np.float32), *rows]), n


def _forward(m: dict, rows: Iterable[np.ndarray], start: np.ndarray) -> tuple:
    """Encoded passages, gates, attention, and the logit of each document (all with passages)."""
    h = np.concatenate([np.tanh((x - m["mean"]) / m["dev"] @ m["W"] + m["b"]) for x in rows])
    t, g = np.tanh(h @ m["V"]), 1 / (1 + np.exp(-(h @ m["U"])))
    e = (t * g) @ m["w"]
    n = np.diff(np.r_[start, len(h)])
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, start), n))
    a = e / np.repeat(np.add.reduceat(e, start), n)
    z = np.add.reduceat(a[:, None] * h, start)
    return h, t, g, a, z, z @ m["c"] + m["c0"]


def gradient(m: dict, x: np.ndarray, start: np.ndarray, good: np.ndarray, weight: np.ndarray) -> dict:
    """Of the mean weighted log loss of some documents, by each parameter."""
    h, t, g, a, z, logit = _forward(m, [x], start)
    n = np.diff(np.r_[start, len(x)])
    dl = ((1 / (1 + np.exp(-logit)) - good) * weight / len(start)).astype(h.dtype)
    of = np.repeat(np.arange(len(start)), n)
    dz = dl[:, None] * m["c"]
    da = (dz[of] * h).sum(1)
    de = a * (da - np.add.reduceat(a * da, start)[of])
    dt, dg = de[:, None] * m["w"] * g * (1 - t * t), de[:, None] * m["w"] * t * g * (1 - g)
    dh = (a[:, None] * dz[of] + dt @ m["V"].T + dg @ m["U"].T) * (1 - h * h)
    return {"c": z.T @ dl, "c0": dl.sum(), "w": (t * g).T @ de, "V": h.T @ dt, "U": h.T @ dg, "W": ((x - m["mean"]) / m["dev"]).T @ dh, "b": dh.sum(0)}


def fit(texts: pa.Array, good: np.ndarray, seed: int = 7) -> dict:
    """The encoder, the gated attention and the classifier, trained together from document labels
    alone by Adam on the log loss; a fifth of the documents is held out to set the threshold."""
    rng = np.random.default_rng(seed)
    x, n = passages(texts)
    good = np.asarray(good, float)
    d = x.shape[1]
    m = {"mean": x.mean(0) if len(x) else np.zeros(d, np.float32), "dev": (x.std(0) if len(x) else np.ones(d, np.float32)) + np.float32(0.1), "threshold": 0.5}
    shape = {"W": (d, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, ATTENTION), "U": (HIDDEN, ATTENTION), "w": (ATTENTION,), "c": (HIDDEN,), "c0": ()}
    m |= {k: (rng.normal(size=s) * (s[0] ** -0.5 if s and k not in "b" else 0)).astype(np.float32) for k, s in shape.items()}
    has = np.flatnonzero(n > 0)
    held = has[np.arange(len(has)) % 5 == 4]
    train = np.setdiff1d(has, held)
    if not len(np.unique(good[train])) > 1:
        return m | {"threshold": 0.0}
    weight = np.where(good > 0, 0.5 / max(good[train].mean(), 1e-6), 0.5 / max(1 - good[train].mean(), 1e-6))
    first = np.cumsum(n) - n
    mom = {k: [np.zeros(s, np.float32), np.zeros(s, np.float32)] for k, s in shape.items()}
    step = 0
    for _ in range(EPOCHS):
        for docs in np.array_split(rng.permutation(train), max(1, len(train) // BATCH)):
            rows = np.concatenate([np.arange(first[i], first[i] + n[i]) for i in docs])
            grad = gradient(m, x[rows], np.cumsum(n[docs]) - n[docs], good[docs], weight[docs])
            step += 1
            for k, v in grad.items():
                v = v + 1e-4 * m[k]
                mom[k][0] = 0.9 * mom[k][0] + 0.1 * v
                mom[k][1] = 0.999 * mom[k][1] + 0.001 * v * v
                m[k] = (m[k] - RATE * (mom[k][0] / (1 - 0.9**step)) / (np.sqrt(mom[k][1] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    if len(held):
        p = score(m, texts.take(pa.array(held)))[0]
        y = good[held] > 0
        cuts = np.unique(np.r_[0.5, p])
        errors = np.array([10 * ((p < c) & y).sum() + ((p >= c) & ~y).sum() for c in cuts])  # a good one rejected counts ten times
        low = cuts[errors == errors.min()]
        m["threshold"] = float(min(0.5, low.max()) if low.min() <= 0.5 else low.min())
    return m


def score(m: dict, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's probability of being good, its largest attention, and its number of passages."""
    rows, n = features(text)
    p, most = np.zeros(len(n)), np.zeros(len(n))
    some = n > 0
    if some.any():
        start = (np.cumsum(n) - n)[some]
        *_, a, _, logit = _forward(m, rows, start)
        p[some] = 1 / (1 + np.exp(-np.clip(logit.astype(float), -60, 60)))
        most[some] = np.maximum.reduceat(a, start)
    return p, most, n


def _score(shared):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, 1):
            p, most, n = score(m, batch.column(1))
            null = lambda x: pa.array(x, mask=n == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), null(p), null(most), pa.array(n.astype(np.int32)), pa.array((n > 0) & (p >= m["threshold"]))], ["doc_id", "quality", "top_attention", "passages", "keep"])

    return apply


def _keep(shared, at: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, at):
            p, _, n = score(m, batch.column(at))
            yield batch.filter(pa.array((n > 0) & (p >= m["threshold"])))

    return apply


def _model(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, train_rows: int):
    return fitted(sample(docs, labels, "quality", train_rows, id_col, text_col), fit, "t", "y")


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, quality, top_attention, passages, keep) of every row.

    A text is kept when its probability of being good reaches the threshold set on held-out
    labelled texts. Null and empty texts have null scores and aren't kept; without labels of both
    classes all other texts are. Texts are read whole, repeated rows scored each, an empty table
    gives none; ids that aren't whole numbers read as null; other columns are ignored.
    """
    narrow = docs.select(whole_id(docs, id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(_score(_model(docs, labels, id_col, text_col, train_rows)), "doc_id long, quality double, top_attention double, passages int, keep boolean")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps; columns as they came, whatever their names.
    Null and empty texts go, repeated rows stay or go together, ids matter for training alone."""
    shared = _model(docs, labels, id_col, text_col, train_rows)
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # names may repeat, Arrow's can't
    kept = plain.mapInArrow(_keep(shared, docs.columns.index(text_col)), plain.schema)
    return kept.toDF(*docs.columns)


def document_quality(spark, sf_dir: str) -> DataFrame:
    """op7_quality_classifier over the whole documents table."""
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
