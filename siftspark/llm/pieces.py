"""SentencePiece encoding and decoding over a shared-prefix trie of distinct marked words."""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import col, slices, strings, text_bytes, whole_id

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
BPE, UNIGRAM = 2, 1
KNOWN = 400_000  # encoded words that a worker remembers between batches


class Model:
    """The pieces of a SentencePiece file, and the encoding of marked words by them."""

    def __init__(self, data: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(data)
        norm = m.normalizer_spec
        if m.trainer_spec.model_type not in (BPE, UNIGRAM) or norm.precompiled_charsmap or norm.normalization_rule_tsv or norm.remove_extra_whitespaces:
            raise ValueError("only BPE and unigram models with identity normalisation are supported")
        self.merges = m.trainer_spec.model_type == BPE
        self.prefix = norm.add_dummy_prefix
        normal = [(i, p) for i, p in enumerate(m.pieces) if p.type in (1, 4)]
        self.id = {p.piece: i for i, p in normal}
        self.score = [p.score for p in m.pieces]
        self.piece = [p.piece for p in m.pieces]
        self.longest = max(map(len, self.id), default=1)
        self.byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(m.pieces) if p.type == 6}
        self.unknown = next((i for i, p in enumerate(m.pieces) if p.type == 2), 0)
        self.floor = min((p.score for _, p in normal), default=0.0) - 10
        if any(MARK in p[1:] and p.strip(MARK) for p in self.id):
            raise ValueError("a piece crosses from one word into the next")
        self.apart = np.ones((256, 256), bool)  # ASCII neighbours that no piece holds
        self.apart[128:] = self.apart[:, 128:] = False
        for p in self.id:
            for a, b in zip(p, p[1:]):
                if a < "\x80" and b < "\x80":
                    self.apart[ord(a), ord(b)] = False
        raw = [p.piece.replace(MARK, " ").encode() if p.type in (1, 4) else bytes([int(p.piece[1:-1], 16)]) if p.type == 6 else " ⁇ ".encode() if p.type == 2 else b"" for p in m.pieces]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_end = np.cumsum([0, *map(len, raw)])
        self.known: dict[str, list[int]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        if self.merges:  # pieces that merging never makes of their own text can't be in any result
            self.id = {p: i for p, i in self.id.items() if len(p) == 1 or self.merge(p) == [i]}

    def merge(self, s: str) -> list[int]:
        """Plain merging by score, leftmost first; characters without a piece as -1 - code point."""
        parts = list(s)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.id.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if best is None:
                return [self.id.get(p, -1 - ord(p[0])) for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fit(self, a: int, b: int) -> bool:
        """Whether merging the text of two pieces gives back just these two."""
        known = self.fits.get((a, b))
        if known is None:
            known = self.fits[a, b] = self.merge(self.piece[a] + self.piece[b]) == [a, b]
        return known

    def encode_words(self, units: list[str]) -> list[list[int]]:
        """Ids of each distinct marked word. The words are walked in sorted order, which is depth
        first through their trie: what was computed for the prefix shared with the word before
        stays on the stack.

        Unigram models: the stack holds the best score of every prefix and its last piece
        (Viterbi). BPE models: the last piece of the prefix's merging, which is the one piece
        that fits the last piece of the remaining prefix.
        """
        out: list = [None] * len(units)
        last, start, best = [0], [0], [0.0]
        before = ""
        find, score, fits, longest = self.id.get, self.score, self.fits, self.longest
        for k in sorted(range(len(units)), key=units.__getitem__):
            s = units[k]
            shared = len(commonprefix((before, s)))
            del last[shared + 1 :], start[shared + 1 :], best[shared + 1 :]
            before = s
            for i in range(shared + 1, len(s) + 1):
                if self.merges:
                    for j in range(max(0, i - longest), i):
                        t = find(s[j:i])
                        if t is not None:
                            a = last[j]
                            if j == 0 or a < 0:
                                break
                            fit = fits.get((a, t))
                            if fit or fit is None and self.fit(a, t):
                                break
                    else:
                        j, t = i - 1, find(s[i - 1], -1 - ord(s[i - 1]))
                    value = 0.0
                else:
                    value, j, t = -np.inf, i - 1, -1 - ord(s[i - 1])
                    for b in range(max(0, i - longest), i):
                        c = find(s[b:i])
                        v = best[b] + (score[c] if c is not None else self.floor)
                        if (c is not None or b == i - 1) and v > value:
                            value, j, t = v, b, c if c is not None else -1 - ord(s[i - 1])
                last.append(t), start.append(j), best.append(value)
            ids, i = [], len(s)
            while i > 0:
                t = last[i]
                if t >= 0:
                    ids.append(t)
                elif self.byte:
                    ids += [self.byte[x] for x in reversed(chr(-1 - t).encode())]
                else:
                    ids.append(self.unknown)
                i = start[i]
            out[k] = ids[::-1]
        return out

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the offsets of the texts in them."""
        text = pc.replace_substring(strings(text), " ", MARK)
        if self.prefix:
            text = pc.if_else(pc.equal(text, ""), "", pc.binary_join_element_wise(MARK, text, ""))
        raw, off = text_bytes(text)
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        # marked words: a run of marks with what follows, cut also where no piece can cross
        mark = np.zeros(len(raw) + 3, bool)
        mark[: len(raw) - 2] = (raw[:-2] == 0xE2) & (raw[1:-1] == 0x96) & (raw[2:] == 0x81)
        begin = mark[: len(raw)].copy()
        begin[3:] &= ~mark[: len(raw) - 3]
        begin[1:] |= self.apart[raw[:-1], raw[1:]]
        begin[off[:-1][np.diff(off) > 0]] = True
        at = np.flatnonzero(begin)
        units = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.r_[at, len(raw)].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw)))
        coded = units.dictionary_encode()
        units = coded.dictionary.to_pylist()
        new = [u for u in units if u not in self.known]
        if len(self.known) + len(new) > KNOWN:
            self.known, new = {}, units
        self.known.update(zip(new, self.encode_words(new)))
        ids = [self.known[u] for u in units]
        n = np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter((i for x in ids for i in x), np.int32, int(n.sum()))
        code = coded.indices.to_numpy(zero_copy_only=False)
        count = n[code]
        done = np.r_[0, np.cumsum(count)]
        where = np.repeat((np.cumsum(n) - n)[code] - done[:-1], count) + np.arange(done[-1])
        return flat[where], done[np.searchsorted(at, off)]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of id sequences given end to end. Bytes that aren't UTF-8 read as U+FFFD, ids
        outside the model as the unknown piece."""
        ids = np.where((ids < 0) | (ids >= len(self.piece)), self.unknown, ids)
        size = np.diff(self.raw_end)[ids]
        done = np.r_[0, np.cumsum(size)]
        raw = self.raw[np.repeat(self.raw_end[:-1][ids] - done[:-1], size) + np.arange(done[-1])]
        off = done[ends]
        if self.prefix and len(raw):  # the mark put before each text
            some = off[:-1][np.diff(off) > 0]
            some = some[raw[some] == 32]
            keep = np.ones(len(raw), bool)
            keep[some] = False
            off = np.r_[0, np.cumsum(keep)][off]
            raw = raw[keep]
        plain = pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])
        try:
            return plain.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([x.decode("utf-8", "replace") for x in plain.to_pylist()], pa.string())


def _ragged(ids: np.ndarray, ends: np.ndarray, null: np.ndarray) -> pa.Array:
    off = pa.array(ends.astype(np.int32), mask=np.r_[null, False]) if null.any() else pa.array(ends.astype(np.int32))
    return pa.ListArray.from_arrays(off, pa.array(ids, pa.int32()))


def _encode(shared):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value)
        for batch in slices(batches, 1):
            text = batch.column(1)
            null = text.is_null().to_numpy(zero_copy_only=False)
            ids, ends = model.encode(text)
            back = pc.equal(model.decode(ids, ends), strings(text))
            count = pa.array(np.diff(ends).astype(np.int32), mask=null)
            yield pa.RecordBatch.from_arrays([batch.column(0), _ragged(ids, ends, null), count, pc.if_else(pa.array(null), pa.scalar(None, pa.bool_()), back)], ["doc_id", "ids", "n_tokens", "round_trip"])

    return apply


def _decode(shared):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value)
        for batch in batches:
            lists = batch.column(1)
            null = lists.is_null().to_numpy(zero_copy_only=False)
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ids = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            text = model.decode(ids, np.r_[0, np.cumsum(n)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.if_else(pa.array(null), pa.scalar(None, pa.string()), text)], ["doc_id", "text"])

    return apply


def encode(docs: DataFrame, model_path: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip) of every row; round_trip tells whether decoding the ids
    gives the text again (it does unless the text itself holds the mark U+2581).

    Null texts have null results, empty ones no ids. Texts are read whole; repeated rows are
    encoded each, an empty table gives none; ids that aren't whole numbers read as null; other
    columns are ignored. The model file is read on the driver.
    """
    with open(model_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    narrow = docs.select(whole_id(docs, id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(_encode(shared), "doc_id long, ids array<int>, n_tokens int, round_trip boolean")


def decode(tokens: DataFrame, model_path: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of every row's ids; null ids give a null text, no ids an empty one. Null
    elements and ids outside the model read as the unknown piece, " ⁇ ". Repeated rows are decoded
    each, an empty table gives none; other columns are ignored."""
    with open(model_path, "rb") as f:
        shared = tokens.sparkSession.sparkContext.broadcast(f.read())
    narrow = tokens.select(whole_id(tokens, id_col).alias("doc_id"), col(ids_col).cast("array<int>").alias("ids"))
    return narrow.mapInArrow(_decode(shared), "doc_id long, text string")


def document_pieces(spark, sf_dir: str) -> DataFrame:
    """op5_sentencepiece over the whole documents table."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
