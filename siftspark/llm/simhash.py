"""SimHash near-duplicates by a binary trie self-join."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chain, col, durable, hash_strings, mix, slices, whole_id, without_ids, words

BUDGET = 11  # differing bits allowed between two word signatures
CONFIRM = (18, 38)  # differing bits allowed between the same texts' word-pair signatures (64 bits) and word-triple ones (128)
TURNS = 4  # quarters of a signature; a trie is joined for each rotation
QUARTER = 64 // TURNS
BUCKET = 1 << 18  # signatures that one side of a join task aims at; layout only, never the result
SIGS = ("sig", "pair", "triple0", "triple1")
CHUNK = 1 << 19  # node pairs held at once
LEAF = 32  # signatures a node that the walk ends with, about; below, all are compared
BLOCK = 1 << 16  # signature pairs compared at once


def _majority(bits: np.ndarray, weight: np.ndarray | None, start: np.ndarray) -> np.ndarray:
    """The packed sign of the weighted sum of +-1 rows in each run. Weights are whole numbers and
    sums stay exact, so the order of adding can't matter."""
    total = np.empty((len(start), 64))
    ends = np.r_[start[1:], len(bits)]
    step = 0
    while step < len(start):  # about 64 K rows at once
        stop = max(step + 1, int(np.searchsorted(ends, start[step] + 65536, "right")))
        a, b = int(start[step]), int(ends[stop - 1])
        w = np.ones(b - a) if weight is None else weight[a:b]
        kind = np.float32 if w.sum() < 1 << 24 else np.float64
        ones, w = np.unpackbits(bits[a:b].view(np.uint8)).reshape(-1, 64).astype(kind), w.astype(kind)
        for k, (x, y) in enumerate(zip((start[step:stop] - a).tolist(), (ends[step:stop] - a).tolist()), step):
            total[k] = 2.0 * (w[x:y] @ ones[x:y]) - w[x:y].sum(dtype=np.float64)
        step = stop
    return np.packbits(total > 0, axis=1).view("<u8")[:, 0]


def _grams(h: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of n words (of all its words if fewer), and where texts start."""
    lengths = np.diff(ends)
    start, lengths = ends[:-1][lengths > 0], lengths[lengths > 0]
    many = np.maximum(lengths - n + 1, 1)
    done = np.cumsum(many) - many
    at = np.repeat(start - done, many) + np.arange(int(many.sum()))
    last = np.repeat(start + lengths, many)
    parts = [h[np.minimum(at + k, len(h) - 1)] * (at + k < last) for k in range(n)]
    return chain(*parts), done


def signatures(text: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Whether each text has words, and of those that do the signature of the words (weight 16 sqrt
    of the count, rounded), and, to confirm with, that of word pairs and two of word triples."""
    codes, ends, vocabulary = words(text)
    lengths = np.diff(ends)
    some = lengths > 0
    if not len(codes):
        return some, [np.zeros(0, np.uint64)] * 4
    hashed = hash_strings(vocabulary)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    size = np.int64(len(hashed))
    key, n = np.unique(doc * size + codes, return_counts=True)
    start = np.flatnonzero(np.r_[True, np.diff(key // size) > 0])
    out = [_majority(hashed[key % size], np.rint(16 * np.sqrt(n)), start)]
    h = hashed[codes]
    for n_words, seeds in ((2, (0,)), (3, (0, 0x9E3779B97F4A7C15))):
        grams, start = _grams(h, ends, n_words)
        out += [_majority(mix(grams ^ np.uint64(seed)) if seed else grams, None, start) for seed in seeds]
    return some, out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1):
        some, found = signatures(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(some)), *(pa.array(x.view(np.int64)) for x in found)], ["doc_id", *SIGS])


def sign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sig, pair, triple0, triple1) of every document that has an id and at least one word."""
    narrow = docs.select(whole_id(docs, id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))
    return narrow.where("doc_id is not null and text is not null").mapInArrow(_sign, "doc_id long, " + ", ".join(f"{x} long" for x in SIGS))


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return x if not by else (x << np.uint64(by)) | (x >> np.uint64(64 - by))


class _Trie:
    """Sorted signatures as a binary trie: the nodes of each depth and their children."""

    def __init__(self, s: np.ndarray, depth: int):
        self.s, self.start, self.child = s, [], []
        for d in range(depth + 1):
            p = s >> np.uint64(64 - d) if d else np.zeros(len(s), np.uint64)
            self.start.append(np.r_[np.flatnonzero(np.r_[True, p[1:] != p[:-1]]), len(s)])
        for d in range(depth):
            parents, nodes = self.start[d][:-1], self.start[d + 1][:-1]
            first = np.searchsorted(nodes, parents)
            two = np.diff(np.r_[first, len(nodes)]) == 2
            one = (s[parents] >> np.uint64(63 - d)) & np.uint64(1) == 1  # the bit of the first child
            self.child.append((np.where(one, -1, first), np.where(one, first, np.where(two, first + 1, -1))))


def trie_pairs(a: np.ndarray, b: np.ndarray, same: bool, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of two sorted signature arrays within ``budget`` bits, by walking both tries.

    Nodes of equal depth are paired, differing bits add up on the way down, and a pair of nodes
    goes once its bits exceed what its depth allows: with the signature in TURNS quarters, of any
    two within the budget some rotation has at most j/TURNS of the budget in its first j quarters,
    for every j, so the joins of all rotations together lose no pair.
    """
    if not len(a) or not len(b):
        return
    fixed = min(64 - int(x[0] ^ x[-1]).bit_length() for x in (a, b))  # first bits that a whole side shares
    depth = int(min(QUARTER, fixed + max(0, np.ceil(np.log2(max(len(a), len(b)) / LEAF)))))
    ta = _Trie(a, depth)
    tb = ta if same else _Trie(b, depth)
    allowed = [budget * -(-d // QUARTER) // TURNS for d in range(depth + 1)]
    root = np.zeros(1, np.int64)
    stack = [(0, root, root, np.zeros(1, np.int8))]
    while stack:
        d, x, y, bits = stack.pop()
        if len(x) > CHUNK:
            stack += [(d, x[k : k + CHUNK], y[k : k + CHUNK], bits[k : k + CHUNK]) for k in range(0, len(x), CHUNK)]
            continue
        if d == depth:
            yield from _leaves(ta, tb, d, x, y, same, budget)
            continue
        found = []
        for i, j in ((0, 0), (0, 1), (1, 0), (1, 1)):
            u, v = ta.child[d][i][x], tb.child[d][j][y]
            ok = (u >= 0) & (v >= 0)
            if i != j:
                ok &= bits < allowed[d + 1]
            else:
                ok &= bits <= allowed[d + 1]
            if same and i > j:
                ok &= x != y  # the mirror of (0, 1)
            found.append((u[ok], v[ok], bits[ok] + np.int8(i != j)))
        u, v, n = map(np.concatenate, zip(*found))
        if len(u):
            stack.append((d + 1, u, v, n))


def _leaves(ta: _Trie, tb: _Trie, d: int, x: np.ndarray, y: np.ndarray, same: bool, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Whole signatures compared below the last node pairs: those of a node with those of all nodes
    it is paired with, as one dense table."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    sa, sb = ta.start[d], tb.start[d]
    nb = sb[y + 1] - sb[y]
    done = np.r_[0, np.cumsum(nb)]
    cut = np.flatnonzero(np.diff(x, prepend=-1))
    xor, bits = np.empty(BLOCK, np.uint64), np.empty(BLOCK, np.uint8)
    left, right, held = [], [], 0
    for p, q in zip(cut.tolist(), [*cut[1:].tolist(), len(x)]):
        for k in range(p, q, 4096):  # some partners at once
            e = min(k + 4096, q)
            for at in range(int(done[k]), int(done[e]), BLOCK):
                upto = min(at + BLOCK, int(done[e]))
                first, last = (k, e) if upto - at == done[e] - done[k] else (int(np.searchsorted(done, at, "right")) - 1, int(np.searchsorted(done, upto)))
                n = np.minimum(done[first + 1 : last + 1], upto) - np.maximum(done[first:last], at)
                j = np.repeat(sb[y[first:last]] + np.maximum(at - done[first:last], 0) - (np.cumsum(n) - n), n) + np.arange(upto - at)
                whole = tb.s[j]
                step = BLOCK // len(j)
                for row in range(int(sa[x[p]]), int(sa[x[p] + 1]), step):
                    rows = ta.s[row : min(row + step, int(sa[x[p] + 1]))]
                    size = len(rows) * len(j)
                    np.bitwise_xor(rows[:, None], whole, out=xor[:size].reshape(len(rows), -1))
                    found = np.flatnonzero(np.bitwise_count(xor[:size], out=bits[:size]) <= budget)
                    if len(found):
                        i, jj = row + found // len(j), j[found % len(j)]
                        if same:
                            ok = i < jj
                            i, jj = i[ok], jj[ok]
                        left.append(i), right.append(jj)
                        held += len(i)
                        if held > CHUNK:
                            yield np.concatenate(left), np.concatenate(right)
                            left, right, held = [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right)


class _Forest:
    """Components over 0..n-1, by hooking to the least label and compressing."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            la, lb = self.label[a], self.label[b]
            open_ = la != lb
            if not open_.any():
                return
            a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
            np.minimum.at(self.label, np.maximum(la, lb), np.minimum(la, lb))
            while (next_ := self.label[self.label]).tobytes() != self.label.tobytes():
                self.label = next_


_NODE = np.dtype([*((x, "<u8") for x in SIGS), ("id", "<i8")])


def _pack(table: pa.Table) -> pa.Table:
    nodes = np.empty(table.num_rows, _NODE)
    for name in _NODE.names:
        nodes[name] = table.column(name).to_numpy().view(_NODE[name])
    nodes = nodes[np.argsort(nodes["sig"], kind="stable")]
    return pa.table({"turn": table.column("turn")[:1], "bucket": table.column("bucket")[:1], "nodes": pa.array([nodes.tobytes()], pa.binary())})


def _join(budget: int, confirm: tuple[int, int], forest: bool):
    def join(table: pa.Table) -> pa.Table:
        side = [np.frombuffer(x, _NODE) for x in table.column("nodes").to_pylist()]
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        of = table.column("bucket").to_pylist()
        none = np.zeros(0, _NODE)  # a bucket may hold no signature
        a = side[of.index(low)] if low in of else none
        b = a if low == high else side[of.index(high)] if high in of else none
        ids = a["id"] if low == high else np.r_[a["id"], b["id"]]
        group = _Forest(len(ids))
        left, right = [], []
        sa, sb = np.ascontiguousarray(a["sig"]), np.ascontiguousarray(b["sig"])
        for i, j in trie_pairs(sa, sb, low == high, budget):
            apart = lambda x: np.bitwise_count(a[x][i] ^ b[x][j]).astype(np.int64)  # noqa: E731, B023
            ok = (apart("pair") <= confirm[0]) & (apart("triple0") + apart("triple1") <= confirm[1])
            i, j = i[ok], j[ok]
            if forest:
                group.link(i, j if low == high else j + len(a))
            else:
                left.append(np.minimum(a["id"][i], b["id"][j])), right.append(np.maximum(a["id"][i], b["id"][j]))
        if forest:
            moved = np.flatnonzero(group.label != np.arange(len(ids)))
            one, two = ids[moved], ids[group.label[moved]]
            left, right = [np.minimum(one, two)], [np.maximum(one, two)]
        return pa.table({"a": pa.array(np.concatenate(left or [np.zeros(0, np.int64)])), "b": pa.array(np.concatenate(right or [np.zeros(0, np.int64)]))})

    return join


def _edges(nodes: DataFrame, budget: int, confirm: tuple[int, int], forest: bool) -> DataFrame:
    """(a, b) ids of nodes within both budgets: all pairs, or a spanning forest of each task's."""
    n = nodes.count()
    bits = int(min(QUARTER, max(3, np.ceil(np.log2(max(n / BUCKET, 1))))))
    first = budget // TURNS
    masks = [sum(1 << i for i in c) for k in range(min(first, bits) + 1) for c in combinations(range(bits), k)]
    sig = "shiftleft(sig, {0}) | shiftrightunsigned(sig, 64 - {0})"
    turned = nodes.select(
        "id", *SIGS[1:], F.explode(F.array(*[F.struct(F.lit(t).alias("turn"), (F.expr(sig.format(t * QUARTER)) if t else F.col("sig")).alias("sig")) for t in range(TURNS)])).alias("t")
    ).select("id", *SIGS[1:], "t.turn", "t.sig")
    packed = (
        turned.withColumn("bucket", F.shiftrightunsigned("sig", 64 - bits).cast("int"))
        .groupBy("turn", "bucket").applyInArrow(_pack, "turn int, bucket int, nodes binary")
    )
    met = packed.select("*", F.explode(F.array(*map(F.lit, masks))).alias("mask")).select(
        "turn", "bucket", "nodes", F.least(F.col("bucket"), F.col("bucket").bitwiseXOR(F.col("mask"))).alias("low"),
        F.greatest(F.col("bucket"), F.col("bucket").bitwiseXOR(F.col("mask"))).alias("high"),
    )
    return met.groupBy("turn", "low", "high").applyInArrow(_join(budget, confirm, forest), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id on an edge: root is the least id of its connected component.

    Alternating large-star and small-star rounds, each written out, until nothing changes.
    """
    edges = durable(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("x"), F.col("a").alias("y")).union(low.select("m", "b"))
        edges = durable(small.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.groupBy("b").agg(F.min("a").alias("root")).select(F.col("b").alias("id"), "root")
        seen = now


def near_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET, confirm: tuple[int, int] = CONFIRM) -> DataFrame:
    """Every pair (doc_a < doc_b, bits) of documents whose word signatures differ in at most
    ``budget`` bits, and their word-pair and word-triple signatures in at most ``confirm``.

    Null ids, ids that aren't whole numbers, null texts and texts without words meet nobody. Rows that repeat an id count as one
    document; if their texts differ, each text is compared. Other columns are ignored.
    """
    signed = durable(sign(docs, id_col, text_col).distinct())
    nodes = durable(signed.groupBy(*SIGS).agg(F.min("doc_id").alias("id")))
    members = signed.join(nodes, [*SIGS]).select("id", "doc_id", "sig")
    one, two = (members.select(F.col("id").alias(x), F.col("doc_id").alias(f"d{x}"), F.col("sig").alias(f"s{x}")) for x in ("a", "b"))
    pairs = _edges(nodes, budget, confirm, False).union(nodes.select(F.col("id").alias("a"), F.col("id").alias("b"))).distinct()
    found = pairs.join(one, "a").join(two, "b").where("da <> db")
    return found.groupBy(F.least("da", "db").alias("doc_a"), F.greatest("da", "db").alias("doc_b")).agg(F.min(F.bit_count(F.col("sa").bitwiseXOR(F.col("sb")))).cast("int").alias("bits"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET, confirm: tuple[int, int] = CONFIRM) -> DataFrame:
    """(doc_id, keep_id) of every document that is a near copy of another, but the one kept.

    Groups are the connected components of near_pairs; the least id of a group stays and is the
    keep_id of the others. Null ids, ids that aren't whole numbers, null texts, texts without words and documents without near
    copies aren't in the result; rows that repeat an id count as one document; an empty table
    gives none. Texts of any length are read whole. Other columns are ignored.
    """
    signed = durable(sign(docs, id_col, text_col))
    nodes = durable(signed.groupBy(*SIGS).agg(F.min("doc_id").alias("id")))
    same = signed.join(nodes, [*SIGS]).where("doc_id <> id").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    roots = components(_edges(nodes, budget, confirm, True).union(same))
    return roots.where("id <> root").select(F.col("id").alias("doc_id"), F.col("root").alias("keep_id"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET, confirm: tuple[int, int] = CONFIRM) -> DataFrame:
    """``docs``, of each near-copy group only the rows of its least id; columns as they came,
    whatever their names. Rows with a null id, an id that is no whole number, a null text or a
    text without words all stay; rows that repeat an id stay or go together."""
    return without_ids(docs, id_col, near_groups(docs, id_col, text_col, budget, confirm).select("doc_id"))


def simhash_groups(spark, sf_dir: str) -> DataFrame:
    """op10_simhash_near_dedup over the whole documents table."""
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
