import random
import re
import time
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftspark.llm import decontaminate, pieces, shards, urls

DATA = "/root/testdata/sf0.001"
WORDS = [f"term{k}" for k in range(2000)]


def smith_waterman(a, b):
    """The plain quadratic recurrence."""
    m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            m[i][j] = max(0, m[i - 1][j - 1] + (decontaminate.MATCH if a[i - 1] == b[j - 1] else decontaminate.MISMATCH), m[i - 1][j] + decontaminate.GAP, m[i][j - 1] + decontaminate.GAP)
    return max(map(max, m))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=25), st.lists(st.integers(0, 4), max_size=12))
def test_alignment_against_plain_recurrence(text, item):
    assert decontaminate.local_score(np.array(text, np.uint64), np.array(item, np.uint64)) == smith_waterman(text, item)


def leak_case(seed=2):
    rng = np.random.default_rng(seed)
    items = {k: list(rng.choice(WORDS, int(rng.integers(8, 40)))) for k in range(25)} | {90: ["term1"], 91: ["term2", "term3"], 92: []}
    docs = {}
    for d in range(120):
        w = list(rng.choice(WORDS, 150))
        if d % 3 == 0:
            item = list(items[int(rng.integers(25))])
            for _ in range(d % 4):  # an edit, an insertion, a deletion
                item[int(rng.integers(len(item)))] = "edited"
            if d % 2:
                item.insert(len(item) // 2, "more")
            w[50:50] = item
        docs[d] = w
    return docs, items


def test_leaks_against_brute_force(spark):
    docs, items = leak_case()
    frame = spark.createDataFrame([(d, " ".join(w), "x") for d, w in docs.items()], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(i, " ".join(w), "x") for i, w in items.items()], "item_id long, text string, doc_id string")
    want = {}
    for d, w in docs.items():
        for i, item in items.items():
            if item:
                s = smith_waterman(w, item)
                if s >= (decontaminate.SHARE if len(item) >= decontaminate.SEED else 1) * decontaminate.MATCH * len(item):
                    want[d, i] = s
    for size in (1 << 20, 300):  # one pass, and several
        got = {(r.doc_id, r.item_id): r.score for r in decontaminate.leaks(frame, bench, index_bytes=size).collect()}
        assert set(got) <= set(want) and all(want[k] == v for k, v in got.items())
        assert len(got) >= 0.9 * len(want)
    assert {k for k in want if k[0] % 4 == 0} <= set(got)  # unedited ones are all found
    kept = decontaminate.drop_leaks(frame, bench)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == set(docs) - {d for d, _ in got}


def test_leak_edges(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta"
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (None, item), (4, "pad " * 100_000 + item), (5, item), (5, item), (6, "pad")] + [(10 + k, "shared " + item) for k in range(300)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (None, item)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(d, 1) for d in [4, 5, *range(10, 310)]}
    assert decontaminate.leaks(docs, bench.where("false")).count() == 0 and decontaminate.leaks(docs.where("false"), bench).count() == 0


def test_many_half_copies_beside_a_whole_one(spark):
    item = [f"word{k}" for k in range(20)]
    rows = [(0, " ".join(item))] + [(k, " ".join([f"pad{k}", *item[:12], f"end{k}"])) for k in range(1, 31)] + [(99, " ".join(item[:9]))]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert {r.doc_id: r.score for r in decontaminate.leaks(docs, bench).collect()} == {0: 40} | dict.fromkeys(range(1, 31), 24)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=40), st.lists(st.integers(0, 4), min_size=1, max_size=12), st.integers(1, 20))
def test_stretches_hold_every_alignment(text, item, least):
    text, item = np.array(text, np.uint64), np.array(item, np.uint64)
    best = decontaminate.local_score(text, item)
    got = max([0, *(decontaminate.local_score(x, item) for x in decontaminate.stretches(text, item, least))])
    assert got == best if best >= least else got < least


def test_verbatim_items_are_all_found(spark):
    docs, bench = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    texts, items = {r.doc_id: r.text for r in docs.collect()}, {r.item_id: r.text for r in bench.collect()}
    want = {(d, i) for d, t in texts.items() for i, x in items.items() if x in t}
    assert want <= {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()} and want


def models():
    from sentencepiece import sentencepiece_model_pb2 as pb

    data = open(pieces.MODEL, "rb").read()
    m = pb.ModelProto()
    m.ParseFromString(data)
    m.trainer_spec.model_type = pieces.UNIGRAM
    return data, m.SerializeToString()


TEXTS = ["", None, " ", "  a", "a   b  ", "Hello   reporter\n\n x", "é 漢字 𝔘\t", "tab\tand\r\nline", "1234.5678 x=y*(z)", "\0 nul"] + ["".join(random.Random(k).choice("ab e\n the ing  é漢.,!") for _ in range(k % 50)) for k in range(400)]


def test_bpe_ids_are_the_librarys():
    import sentencepiece

    data, _ = models()
    texts = TEXTS + [r[0] for r in duckdb.sql(f"select text from '{DATA}/documents.parquet'").fetchall()]
    ids, ends = pieces.Model(data).encode(pa.array(texts, pa.string()))
    want = sentencepiece.SentencePieceProcessor(model_proto=data).encode([t or "" for t in texts])
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == want
    assert pieces.Model(data).decode(ids, ends).to_pylist() == [t or "" for t in texts]


def test_unigram_is_viterbi():
    """Against a plain dynamic program, and the library up to ties of equal score."""
    import sentencepiece

    _, data = models()
    model, library = pieces.Model(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    units = sorted({w for t in TEXTS if t for w in re.findall(r"\S+", t)} | set(WORDS[:200]))
    for word, ids in zip(units, model.encode_words(units)):
        best = [0.0]
        for i in range(1, len(word) + 1):
            best.append(max(best[j] + (model.score[model.id[word[j:i]]] if word[j:i] in model.id else model.floor) for j in range(i) if word[j:i] in model.id or j == i - 1))
        unknown = [i for i in ids if i in model.byte.values()]
        if not unknown:
            assert sum(model.score[i] for i in ids) == best[-1]
        assert bytes(b for i in ids for b in model.raw[model.raw_end[i] : model.raw_end[i + 1]]).decode() == word
    mine, ends = model.encode(pa.array(WORDS[:50]))
    for k, theirs in enumerate(library.encode(WORDS[:50])):
        assert sum(model.score[i] for i in mine[ends[k] : ends[k + 1]]) == pytest.approx(sum(model.score[i] for i in theirs))


def test_pieces_query_and_decode(spark):
    rows = [(k, t, [k], "x") for k, t in enumerate(TEXTS[:60])] + [(99, "word " * 60_000, None, "x"), (None, "Hello", None, "x"), (3, "  a", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, n_tokens string")
    out = pieces.encode(docs)
    assert out.count() == len(rows) and out.where("not round_trip").count() == 0
    assert [(r.ids, r.n_tokens, r.round_trip) for r in out.where("doc_id = 1").collect()] == [(None, None, None)]
    assert [(r.ids, r.n_tokens) for r in out.where("doc_id = 0").collect()] == [([], 0)]
    back = {(r.doc_id, r.text) for r in pieces.decode(out).collect()}
    assert back == {(i, t) for i, t, _, _ in rows}
    assert pieces.encode(docs.where("false")).count() == 0


def brute_shards(rows, n_bytes):
    """Shard of each row by sorting all of them on one machine."""
    key = lambda r: ((r[1] is not None, (r[1] or "").encode()), (r[0] is not None, r[0] or 0))
    size = lambda r: len((r[2] or "").encode())
    total = sum(map(size, rows))
    n = max(1, -(-total // n_bytes))
    out = {}
    for r in rows:
        below = sum(size(x) for x in rows if key(x) < key(r))
        out[key(r)] = min(n - 1, below * n // total) if total else 0
    return out, n, key


@pytest.mark.parametrize("n_bytes", [50, 400, 10**9])
def test_histogram_sort_against_sorting(spark, n_bytes):
    rng = random.Random(4)
    rows = [(rng.randint(-50, 50), rng.choice(["a", "a\0", "ab", "hot", "hot", "hot", "é", "", None]), "t" * rng.randint(0, 30)) for _ in range(300)]
    rows += [(None, "a", "xx"), (1, None, None), (2, "hot", ""), (7, "hot", "long" * 500)] + [rows[0]] * 3
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, source string, text string, shard string")
    out = shards.histogram_sort(docs, shard_bytes=n_bytes)
    want, n, key = brute_shards(rows, n_bytes)
    got = [(r.doc_id, r.source, r.text, r["shard_"]) for r in out.collect()]
    assert Counter(r[:3] for r in got) == Counter(rows) and all(want[key(r)] == r[3] for r in got)
    few = shards.histogram_sort(docs, shard_bytes=n_bytes, max_parts=5)
    assert Counter(tuple(r) for r in few.collect()) == Counter(tuple(r) for r in out.collect()) and few.rdd.getNumPartitions() <= max(5, 1)
    parts = out.rdd.glom().map(lambda p: [(r.doc_id, r.source, r.text, r["shard_"]) for r in p]).collect()
    assert len(parts) == n
    for k, p in enumerate(parts):
        assert all(r[3] == k for r in p) and [key(r) for r in p] == sorted(key(r) for r in p)


def test_histogram_sort_tolerance_and_nothing(spark):
    docs = spark.createDataFrame([(k, "s", "x" * (k % 7)) for k in range(2000)], "doc_id long, source string, text string")
    sizes = [r[0] for r in shards.histogram_sort(docs, shard_bytes=300, tolerance=0.1).groupBy("shard").agg({"doc_id": "count"}).select("count(doc_id)").collect()]
    assert sum(sizes) == 2000 and max(sizes) < 2 * 2000 / (sum(k % 7 for k in range(2000)) / 300)
    assert shards.histogram_sort(docs.where("false")).count() == 0


def test_histogram_sort_against_sql(spark):
    got = {(r.doc_id, r.shard) for r in shards.histogram_sort(spark.read.parquet(f"{DATA}/documents.parquet"), shard_bytes=20_000).collect()}
    sql = shards.SHARDS_SQL.replace("FROM documents", f"FROM '{DATA}/documents.parquet'").replace(f"{shards.SHARD_BYTES}.0", "20000.0")
    assert got == set(duckdb.sql(f"select doc_id, shard from ({sql})").fetchall()) and len({s for _, s in got}) > 10


def brute_segment(name, cost, total):
    best = None
    for mask in range(1 << max(len(name) - 1, 0)):
        cuts = [0, *(i + 1 for i in range(len(name) - 1) if mask >> i & 1), len(name)]
        parts = [name[a:b] for a, b in zip(cuts, cuts[1:])]
        value = sum(cost[p] if p in cost else np.log(total) + (len(p) - 1) * np.log(10) for p in parts)
        if best is None or value < best - 1e-9:
            best = value
    return best


def test_segmentation_against_all_splits():
    cost, total = {w: np.log(10_000) - np.log(n) for w, n in {"cheap": 50, "pills": 9, "ill": 80, "che": 3, "ap": 4, "s": 20, "a": 300}.items()}, 10_000.0
    rng = random.Random(1)
    for name in ["cheappills", "xcheaps", "pillsq", "a"] + ["".join(rng.choice("chepils") for _ in range(rng.randint(1, 11))) for _ in range(60)]:
        parts = urls.segment(name, cost, total)
        assert "".join(parts) == name
        assert sum(cost.get(p, np.log(total) + (len(p) - 1) * np.log(10)) for p in parts) == pytest.approx(brute_segment(name, cost, total))
    assert urls.segment("cheappills", cost, total) == ["cheap", "pills"]


def test_url_filter_against_plain_bayes(spark):
    good = [f"http://www.garden{a}.org/en/{k}" for k, a in enumerate(["roses", "tools", "roses", "plans"] * 10)]
    bad = [f"https://casino{a}.com/play/{k}?x=1" for k, a in enumerate(["win", "gold"] * 5)]
    rows = list(enumerate(good + bad)) + [(900, None), (901, " "), (902, "not a url"), (903, "http://wingold.com/play/9"), (None, good[0]), (0, good[0])]
    pages = spark.createDataFrame([(i, u, "x") for i, u in rows], "page_id long, url string, text string")
    corpus = spark.createDataFrame([("garden roses tools plans win gold play " * 20,), (None,), ("",)], "text string")
    out = [r.asDict() for r in urls.filter_urls(pages, corpus).collect()]
    assert len(out) == len(rows)
    split = urls.Splitter(*urls.dictionary(corpus))
    counts, n = {True: Counter(), False: Counter()}, Counter()
    for _, u in rows:
        if u and u.strip():
            h, p = split.tokens(u)
            seeded = not set(urls.SEEDS).isdisjoint(h + p)
            counts[seeded].update([f"h:{w}" for w in h] + [f"p:{w}" for w in p])
            n[seeded] += 1
    vocabulary = set(counts[True]) | set(counts[False])
    total = {k: sum(c.values()) + len(vocabulary) + 1 for k, c in counts.items()}
    by_id = {r["page_id"]: r for r in out}
    for i, u in rows:
        if i is None or i in (900, 901):
            continue
        h, p = split.tokens(u)
        want = np.log(n[True] / n[False]) + sum(np.log((counts[True][t] + 1) / total[True]) - np.log((counts[False][t] + 1) / total[False]) for t in [f"h:{w}" for w in h] + [f"p:{w}" for w in p])
        assert by_id[i]["log_odds"] == pytest.approx(want) and by_id[i]["blocked"] == (want > 0)
    assert by_id[900]["log_odds"] is None and by_id[901]["log_odds"] is None and not by_id[900]["blocked"]
    assert by_id[903]["blocked"] and all(by_id[k]["blocked"] == (k >= 40) for k in range(50))
    assert by_id[45]["host_words"] == "casino gold com"
    assert urls.filter_urls(pages.where("false"), corpus).count() == 0
    assert urls.filter_urls(pages, corpus.where("false")).count() == len(rows)


def test_rare_words_and_tokens_count_at_any_size(spark):
    corpus = spark.createDataFrame([("pad " * 100_000,)] * 21 + [("quagga zebroid",)], "text string")  # a word in two million
    urls_ = [(0, "http://quaggazebroid.org/")] + [(k, "http://pad.org/casino") for k in range(1, 4)]
    pages = spark.createDataFrame(urls_, "page_id long, url string")
    got = {r.page_id: r.host_words for r in urls.filter_urls(pages, corpus).collect()}
    assert got[0] == "quagga zebroid org" and got[1] == "pad org"


def test_long_names_and_long_words(spark):
    word = "floccinaucinihilipilification"  # beyond PREFIX
    rng = random.Random(9)
    huge = "".join(rng.choice("abcdefgh") for _ in range(100_000))
    rows = [(0, f"http://{word}pills.org/"), (1, f"http://x.org/{huge}"), (2, "http://x.org/" + "a1" * 20_000), (3, f"http://{word[:-1]}.org/")]
    corpus = spark.createDataFrame([(f"{word} {word} org x ab cde",)], "text string")
    began = time.perf_counter()
    got = {r.page_id: r for r in urls.filter_urls(spark.createDataFrame(rows, "page_id string, url string"), corpus).collect()}
    assert time.perf_counter() - began < 60
    assert got[0].host_words == f"{word} pills org" and got[0].blocked
    assert got[1].path_words.replace(" ", "") == huge and " ab " in got[1].path_words and len(got[2].path_words.split()) == 40_000
    assert word not in got[3].host_words


def test_segment_is_linear_in_unknown_letters():
    began = time.perf_counter()
    assert "".join(urls.segment("zq" * 50_000, {"qz": 3.0, "z": 9.0}, 1e6)) == "zq" * 50_000
    assert time.perf_counter() - began < 5


def test_decoding_nulls_and_foreign_ids(spark):
    model = pieces.Model(open(pieces.MODEL, "rb").read())
    a = model.encode(pa.array(["hello"]))[0].tolist()
    rows = [(1, [*a, -1]), (2, [10**6, *a]), (3, [*a, None, *a]), (4, []), (5, None), (6, [None])]
    got = {r.doc_id: r.text for r in pieces.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>")).collect()}
    assert got[1].startswith("hello") and got[1].endswith("⁇ ") and "⁇" in got[2] and got[2].endswith("hello") and got[3].count("hello") == 2
    assert got[4] == "" and got[5] is None and "⁇" in got[6]
