"""Language identification by a byte convolutional network."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SAMPLE_BYTES, bounded, col, fitted, slices, strings, text_bytes, whole_id

TRAIN_ROWS = 1500  # labelled documents of each language that the network is fitted on, by least id hash
WINDOW = 128  # bytes; a text's last window is padded
EMBED = 8  # of each byte
WIDTHS = (2, 3, 4)  # bytes seen by the filters of each group
FILTERS = 16  # of each width
EPOCHS, STEPS, RATE, BATCH = 2, 600, 0.01, 128  # a small sample is gone through until there are so many steps
PAD = 0  # the byte that fills a window; one in a text reads the same


def windows(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes in rows of WINDOW, and the number of rows of each text."""
    raw, off = text_bytes(strings(text))
    n = -(-np.diff(off) // WINDOW)
    out = np.full(int(n.sum()) * WINDOW, PAD, np.uint8)
    to = np.r_[0, np.cumsum(n)] * WINDOW
    for a, b, c in zip(off[:-1].tolist(), off[1:].tolist(), to.tolist()):
        out[c : c + b - a] = raw[a:b]
    return out.reshape(-1, WINDOW), n


def _filters(m: dict) -> np.ndarray:
    """All filters over the widest one's bytes, the narrower padded with zeros."""
    wide = np.zeros((WIDTHS[-1] * EMBED, len(WIDTHS) * FILTERS), np.float32)
    for k, w in enumerate(WIDTHS):
        wide[: w * EMBED, k * FILTERS : (k + 1) * FILTERS] = m[f"W{w}"]
    return wide


def _patches(m: dict, x: np.ndarray) -> np.ndarray:
    """What the filters see at each place of each window: [windows, places, bytes x EMBED]."""
    e = np.zeros((len(x), WINDOW + WIDTHS[-1] - 1, EMBED), np.float32)
    np.take(m["E"], x, axis=0, out=e[:, :WINDOW])
    s = e.strides
    view = np.lib.stride_tricks.as_strided(e, (len(x), WINDOW, WIDTHS[-1] * EMBED), (s[0], s[1], s[2]))
    return view.reshape(-1, WIDTHS[-1] * EMBED)


def forward(m: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class probabilities, pooled maxima, and where they are."""
    c = (_patches(m, x) @ _filters(m)).reshape(len(x), WINDOW, -1)
    at = c.argmax(1) if m.get("train") else None
    pooled = np.maximum(c.max(1) + m["b"], 0)
    z = pooled @ m["O"] + m["o"]
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True), pooled, at


def fit(texts: pa.Array, labels: pa.Array, seed: int = 5) -> dict:
    """The network, trained on all windows of labelled texts by Adam on the log loss."""
    rng = np.random.default_rng(seed)
    names = sorted(set(labels.to_pylist()))
    y = np.array([names.index(v) for v in labels.to_pylist()], np.int64)
    x, n = windows(texts)
    m = {"names": names, "E": rng.normal(size=(256, EMBED)).astype(np.float32) * 0.5, "b": np.zeros(len(WIDTHS) * FILTERS, np.float32)}
    m |= {f"W{w}": (rng.normal(size=(w * EMBED, FILTERS)) * (w * EMBED) ** -0.5).astype(np.float32) for w in WIDTHS}
    m |= {"O": (rng.normal(size=(len(m["b"]), max(len(names), 1))) * 0.1).astype(np.float32), "o": np.zeros(max(len(names), 1), np.float32)}
    if len(names) < 2 or not len(x):
        return m
    y = np.repeat(y, n)
    keys = [k for k in m if k != "names"]
    mom = {k: [np.zeros_like(m[k]), np.zeros_like(m[k])] for k in keys}
    m["train"] = True
    step = 0
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(x)))):
        for i in np.array_split(rng.permutation(len(x)), max(1, len(x) // BATCH)):
            p, pooled, at = forward(m, x[i])
            d = p.copy()
            d[np.arange(len(i)), y[i]] -= 1
            d /= len(i)
            g = {"O": pooled.T @ d, "o": d.sum(0), "E": np.zeros_like(m["E"])}
            dp = (d @ m["O"].T) * (pooled > 0)
            g["b"] = dp.sum(0)
            ends = np.pad(x[i], ((0, 0), (0, WIDTHS[-1] - 1)))
            real = np.pad(np.ones(WINDOW, bool), (0, WIDTHS[-1] - 1))
            for k, w in enumerate(WIDTHS):
                f = slice(k * FILTERS, (k + 1) * FILTERS)
                g[f"W{w}"] = np.zeros_like(m[f"W{w}"])
                for j in range(w):  # only the places of the maxima have a gradient
                    place = at[:, f] + j
                    code = np.take_along_axis(ends, place, 1)
                    dd = dp[:, f] * real[place]
                    part = slice(j * EMBED, (j + 1) * EMBED)
                    g[f"W{w}"][part] = np.einsum("nfe,nf->ef", m["E"][code], dd)
                    np.add.at(g["E"], code.ravel(), (dd[:, :, None] * m[f"W{w}"][part].T[None]).reshape(-1, EMBED))
            step += 1
            for k in keys:
                mom[k][0] = 0.9 * mom[k][0] + 0.1 * g[k]
                mom[k][1] = 0.999 * mom[k][1] + 0.001 * g[k] ** 2
                m[k] = (m[k] - RATE * (mom[k][0] / (1 - 0.9**step)) / (np.sqrt(mom[k][1] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    del m["train"]
    return m


def score(m: dict, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's best class, its mean probability over all windows, and the number of windows."""
    x, n = windows(text)
    best, sure = np.full(len(n), -1), np.zeros(len(n))
    if len(m["names"]) and len(x):
        p = np.concatenate([forward(m, x[k : k + 256])[0] for k in range(0, len(x), 256)])
        some = n > 0
        mean = np.add.reduceat(p.astype(float), (np.cumsum(n) - n)[some]) / n[some][:, None]
        best[some], sure[some] = mean.argmax(1), mean.max(1)
    return best, sure, n


def _apply(shared):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = pa.array([*m["names"], None], pa.string())
        for batch in slices(batches, 1):
            best, sure, n = score(m, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), names.take(pa.array(np.where(best < 0, len(names) - 1, best))), pa.array(sure, mask=best < 0), pa.array(n.astype(np.int32))], ["doc_id", "language", "probability", "windows"])

    return apply


def languages(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, language, probability, windows) of every row of ``docs``.

    ``labelled`` has texts with their languages. Every window of a text is classified; the text's
    language has the greatest mean probability, ties going to the first by name. Null and empty
    texts have null results, and so has every text if nothing is labelled; with a single language
    that is the answer. Rows with null labels or texts aren't trained on. Repeated rows are
    classified each, an empty table gives none; ids that aren't whole numbers read as null; other
    columns are ignored. The network is fitted on ``train_rows`` texts of each language at most, and
    on SAMPLE_BYTES of them, each read whole.
    """
    known = labelled.select(whole_id(labelled, id_col).alias("i"), col(text_col).cast("string").alias("t"), col(label_col).cast("string").alias("y")).where("t is not null and t <> '' and y is not null and i is not null")
    hashed = known.withColumn("o", F.xxhash64("i"))
    chosen = hashed.select("o", "i", "y").withColumn("r", F.row_number().over(Window.partitionBy("y").orderBy("o", "i"))).where(F.col("r") <= train_rows).select("i", "y").distinct()
    sample = bounded(hashed.join(F.broadcast(chosen), ["i", "y"]).groupBy("o", "i", "y").agg(F.min("t").alias("t")), SAMPLE_BYTES)
    narrow = docs.select(whole_id(docs, id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(_apply(fitted(sample.select("o", "i", "t", "y"), fit, "t", "y")), "doc_id long, language string, probability double, windows int")


def document_languages(spark, sf_dir: str) -> DataFrame:
    """op2_language_id over the whole documents table, fitted on its own language column."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return languages(docs, docs)
