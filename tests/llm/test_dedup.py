from time import thread_time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from siftspark.llm import exact, simhash
from siftspark.llm.common import without_ids

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, print string, keep_id string, drop_id string, sig long, rank int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "p", "k", "d", 1, 2) for i, t in rows], SCHEMA)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**62), min_size=1, max_size=200))
def test_golomb_round_trip(values):
    v = np.sort(np.array(values, np.uint64))
    k, blob = exact.golomb_encode(v)
    assert (exact.golomb_decode(k, len(v), blob) == v).all()


ROWS = [(1, "a"), (2, "a"), (2, "a"), (3, None), (4, None), (5, ""), (6, ""), (None, "a"), (7, "b"), (8, "x" * 200_000), (9, "x" * 200_000), (10, "x" * 199_999 + "y")]


@pytest.mark.parametrize("limit", [1, 1 << 20])  # a filter that lets much through, or little
def test_exact_copies_and_dedup(spark, limit):
    docs = table(spark, ROWS)
    found = sorted(tuple(r) for r in exact.copies(docs, filter_bytes=limit).collect())
    assert found == [(2, 1), (6, 5), (9, 8)]
    kept = exact.exact_dedup(docs, filter_bytes=limit)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect())) == [1, 3, 4, 5, 7, 8, 10]


def test_exact_on_nothing(spark):
    empty = table(spark, ROWS).where("false")
    assert exact.copies(empty).count() == 0 and exact.exact_dedup(empty).count() == 0


def test_exact_against_sql(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    mine = {tuple(r) for r in exact.copies(docs).collect()}
    sql = duckdb.sql(exact.EXACT_SQL.replace("FROM documents", f"FROM '{DATA}/documents.parquet'")).fetchall()
    assert mine == set(sql) and mine


def planted(n=1500, seed=3):
    rng = np.random.default_rng(seed)
    s = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
    near = s[: n // 3].copy()
    for i in range(len(near)):
        for b in rng.choice(64, rng.integers(1, simhash.BUDGET + 2), replace=False):
            near[i] ^= np.uint64(1) << np.uint64(b)
    return np.unique(np.r_[s, near])


@pytest.mark.parametrize("budget", [3, 8, simhash.BUDGET])
def test_trie_join_is_exact(budget):
    s = planted()
    want = {(k, k + 1 + int(j)) for k in range(len(s)) for j in np.flatnonzero(np.bitwise_count(s[k] ^ s[k + 1 :]) <= budget)}
    got = set()
    for turn in range(simhash.TURNS):
        x = simhash._turn(s, turn * simhash.QUARTER)
        order = np.argsort(x)
        for i, j in simhash.trie_pairs(x[order], x[order], True, budget):
            got |= {(min(a, b), max(a, b)) for a, b in zip(order[i].tolist(), order[j].tolist())}
    assert got == want and want


@pytest.mark.parametrize("leaf, block", [(4, 50), (64, 1000), (1 << 20, 1 << 16)])
def test_trie_join_of_crowded_and_unlike_sides(monkeypatch, leaf, block):
    """Nodes of very different sizes, compared in many and in few tables."""
    monkeypatch.setattr(simhash, "LEAF", leaf), monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(7)
    crowd = np.packbits(rng.random((500, 64)) < np.r_[np.full(40, 0.97), np.full(24, 0.5)], axis=1).view(">u8")[:, 0].astype(np.uint64)
    s = np.unique(np.r_[planted(400), crowd])
    for a, b in ((s, s), (s[::3], s), (s, s[5:6]), (crowd[:1], crowd[:1])):
        want = {(int(a[i]), int(b[j])) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a[i] ^ b) <= simhash.BUDGET) if a is not b or i < j}
        got = set()
        for turn in range(simhash.TURNS):
            x, y = (np.sort(simhash._turn(z, turn * simhash.QUARTER)) for z in (a, b))
            for i, j in simhash.trie_pairs(x, y, a is b):
                back = (simhash._turn(z, 64 - turn * simhash.QUARTER) if turn else z for z in (x[i], y[j]))
                got |= {(min(p), max(p)) if a is b else p for p in zip(*(z.tolist() for z in back))}
        assert got == want


def test_trie_join_costs_a_small_part_of_all_comparisons():
    """Signatures as uneven as those of texts of one language: the walk takes less than a fifth of comparing all."""
    bit = np.random.default_rng(5).permutation(np.linspace(0.2, 0.8, 64))
    s = np.unique(np.packbits(np.random.default_rng(6).random((100_000, 64)) < bit, axis=1).view(">u8")[:, 0].astype(np.uint64))
    began = thread_time()
    for _ in simhash.trie_pairs(s, s, True):
        pass
    walked, some = thread_time() - began, 400
    began = thread_time()
    for k in range(0, some, 10):
        np.flatnonzero(np.bitwise_count(s[k : k + 10, None] ^ s) <= simhash.BUDGET)
    assert walked < 0.2 * (thread_time() - began) * len(s) / some / 2


def brute(texts, budget=simhash.BUDGET, confirm=simhash.CONFIRM):
    """All pairs within both budgets, and the least id of each component."""
    ids = sorted(texts)
    some, (a, b, c, d) = simhash.signatures(pa.array([texts[i] for i in ids], pa.string()))
    ids = [i for i, s in zip(ids, some) if s]
    apart = lambda x, k, m: int(x[k] ^ x[m]).bit_count()
    pairs = {
        (ids[k], ids[m]) for k in range(len(ids)) for m in range(k + 1, len(ids))
        if apart(a, k, m) <= budget and apart(b, k, m) <= confirm[0] and apart(c, k, m) + apart(d, k, m) <= confirm[1]
    }
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, y in pairs:
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)
    return pairs, {i: find(i) for i in ids}


def test_near_groups_and_pairs_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    pairs, root = brute({r.doc_id: r.text for r in docs.collect()})
    assert {(r.doc_a, r.doc_b) for r in simhash.near_pairs(docs).collect()} == pairs and pairs
    assert {(r.doc_id, r.keep_id) for r in simhash.near_groups(docs).collect()} == {(i, r) for i, r in root.items() if i != r}


def test_signatures_against_plain_sums():
    texts = ["one", "one two", "a b a c", "x y z x y z w", None, "!", "long " * 3000]
    some, (words_, pairs, first, second) = simhash.signatures(pa.array(texts, pa.string()))
    from siftspark.llm.common import chain, hash_strings, mix

    def sign(hashes, weights):
        total = sum(w * (np.unpackbits(np.array([x], np.uint64).view(np.uint8)).astype(float) * 2 - 1) for x, w in zip(hashes, weights))
        return np.packbits(total > 0).view("<u8")[0]

    at = 0
    for text in texts:
        w = (text or "").replace("!", "").split()
        if not w:
            continue
        h = hash_strings(pa.array(w))
        distinct = sorted(set(w))
        assert words_[at] == sign([hash_strings(pa.array([x]))[0] for x in distinct], [round(16 * w.count(x) ** 0.5) for x in distinct])
        for n, seeds, got in ((2, [0], [pairs]), (3, [0, 0x9E3779B97F4A7C15], [first, second])):
            runs = [[*h[k : k + n]] for k in range(max(1, len(w) - n + 1))]
            grams = [chain(*(np.array([x], np.uint64) for x in (r + [0] * n)[:n]))[0] for r in runs]
            for seed, g in zip(seeds, got):
                assert g[at] == sign([mix(np.array([x ^ np.uint64(seed)]))[0] if seed else x for x in grams], [1] * len(grams))
        at += 1
    assert at == int(some.sum()) == 5


def test_near_copies_of_edited_texts(spark):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{k}" for k in range(4000)]
    rows, k = [], 0
    for _ in range(60):
        base = rng.choice(vocabulary, 250)
        for _ in range(3):
            text = base.copy()
            text[rng.choice(250, 6, replace=False)] = rng.choice(vocabulary, 6)
            rows.append((k, " ".join(text)))
            k += 1
    kept = {r.doc_id for r in simhash.near_dedup(table(spark, rows)).collect()}
    groups = [sum(3 * g + c in kept for c in range(3)) for g in range(60)]
    assert all(groups) and sum(g == 1 for g in groups) >= 54


def test_near_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "!!"), (4, "one word"), (5, "one word"), (5, "one word"), (None, "one word"), (6, "long " * 100_000), (7, "long " * 100_000 + "er")]
    docs = table(spark, rows)
    assert {(r.doc_id, r.keep_id) for r in simhash.near_groups(docs).collect()} == {(5, 4), (7, 6)}
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 6]
    assert simhash.near_groups(docs.where("false")).count() == 0 and simhash.near_pairs(docs.where("false")).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 99), (7, 7)], "a long, b long")
    assert {(r.id, r.root) for r in simhash.components(edges).collect()} == {(k, 0) for k in range(1, 41)} | {(100, 99)}


def test_filter_misses_nothing_and_lets_little_through(spark):
    from siftspark.llm.common import membership

    values = spark.range(0, 40_000, 2).toDF("v")
    for limit, most in ((1 << 20, 0.05), (2_000, 1.0)):
        test = membership(values, limit)
        got = spark.range(40_001).select("id", test(F.when(F.col("id") < 40_000, F.col("id"))).alias("in")).groupBy(F.col("id") % 2).agg(F.avg(F.col("in").cast("int"))).collect()
        share = {r[0]: r[1] for r in got}
        assert share[0] == pytest.approx(20_000 / 20_001) and share[1] <= most


def test_one_fingerprint_of_several_texts(spark, monkeypatch):
    """With a fingerprint that tells nothing apart, texts are still compared in full."""
    monkeypatch.setattr(exact.F, "xxhash64", lambda *c: F.lit(7).cast("long") if len(c) == 1 else F.hash(*c).cast("long"))
    docs = table(spark, ROWS)
    assert sorted(tuple(r) for r in exact.copies(docs).collect()) == [(2, 1), (6, 5), (9, 8)]
    assert sorted(r.doc_id for r in exact.exact_dedup(docs).collect()) == [1, 3, 4, 5, 7, 8, 10]


def test_unsuspected_texts_are_not_shuffled(spark):
    """No exchange holds texts but behind the filter, and nothing is joined by text."""
    docs = table(spark, [(k, f"text {k % 70}") for k in range(100)])
    for out in (exact.exact_dedup(docs), without_ids(docs, "doc_id", docs.select("doc_id").limit(9), 0)):
        rows = out.collect()
        assert len(rows) == len({r.text for r in rows}) or len(rows) == 91
        tree = out._jdf.queryExecution().optimizedPlan().toString()
        assert "pythonUDF" in tree or "test(" in tree
        plan = out._jdf.queryExecution().sparkPlan().toString()
        union = plan.split("\n- ")
        assert "SortMergeJoin" not in plan.split("Union")[0] and union


def test_maps_break_ties_the_same_way_however_rows_lie(spark):
    rows = [(1, "same", {"a": k, "b": 2}) for k in range(6)]
    got = set()
    for order in (rows, rows[::-1]):
        frame = spark.createDataFrame(order, "doc_id long, text string, m map<string,int>").repartition(3)
        got.add(str([r.m for r in exact.exact_dedup(frame).collect()]))
    assert len(got) == 1
