import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from siftspark.llm import language, quality, toxicity

WORDS = [f"wort{k}" for k in range(300)]
EDGE = [(None, "a b"), (1, None), (2, ""), (3, "..."), (4, "plain words " * 30_000), (4, "plain words " * 30_000)]


def corpus(n=400, bad_share=0.3, seed=0):
    rng = np.random.default_rng(seed)
    texts, y = [], []
    for k in range(n):
        w = list(rng.choice(WORDS, 60))
        bad = rng.random() < bad_share
        if bad:
            for _ in range(4):
                w.insert(int(rng.integers(60)), str(rng.choice(["vile", "nasty", "foul"])))
        texts.append(" ".join(w))
        y.append(int(bad))
    return texts, y


def test_toxicity_on_held_out_texts():
    texts, y = corpus()
    model = toxicity.fit(pa.array(texts), np.array(y))
    more, z = corpus(seed=1)
    a, b, n = toxicity.score(model, pa.array(more))
    assert (((a - b) >= model["threshold"]) == np.array(z, bool)).mean() > 0.97 and (n >= 60).all()


def phrases(n=1000, seed=0):
    """Toxic texts say "left hook" and "right turn", the others "left turn" and "right hook"."""
    rng = np.random.default_rng(seed)
    texts, y = [], rng.random(n) < 0.4
    for bad in y:
        w = list(rng.choice(WORDS, 40))
        for a, b in (("left", "hook"), ("right", "turn")) if bad else (("left", "turn"), ("right", "hook")):
            at = int(rng.integers(40))
            w[at:at] = [a, b]
        texts.append(" ".join(w))
    return texts, y.astype(int)


def test_toxicity_of_pairs_of_ordinary_words():
    texts, y = phrases()
    model = toxicity.fit(pa.array(texts), y)
    more, z = phrases(seed=1)
    a, b, _ = toxicity.score(model, pa.array(more))
    assert (((a - b) >= model["threshold"]) == z.astype(bool)).mean() > 0.97


def test_toxicity_pairs_are_a_distribution():
    texts, y = phrases(200)
    for discount in toxicity.PAIR_DISCOUNTS:
        model = toxicity._fit(pa.array(texts), y, discount)
        hashed = np.r_[model["vocabulary"], np.uint64(0)]
        for k in range(0, len(model["vocabulary"]), 40):
            at = toxicity._find(model["pairs"], toxicity.chain(np.repeat(hashed[k], len(hashed)), hashed))
            for c in model["classes"]:
                p = np.where(at >= 0, np.r_[c["pair"], 0.0][at], c["low"] + model["spare"][k])
                assert np.exp(p).sum() == pytest.approx(1)


def test_toxicity_model_is_a_distribution():
    """Probabilities of all words after any history, the unseen one included, add to one."""
    texts, y = corpus(60)
    model = toxicity._fit(pa.array(texts), np.array(y))
    for c in model["classes"]:
        assert np.exp(c["low"]).sum() == pytest.approx(1)


def test_toxicity_score_against_plain_loop():
    texts, y = corpus(80)
    model = toxicity._fit(pa.array(texts), np.array(y))
    from siftspark.llm.common import chain, hash_strings

    vocabulary = {int(h): k for k, h in enumerate(model["vocabulary"])}
    pairs = {int(h): k for k, h in enumerate(model["pairs"])}
    more = [*corpus(5, seed=9)[0], "quite unseen vile words vile", "", None]
    a, b, _ = toxicity.score(model, pa.array(more, pa.string()))
    for text, got in zip(more, zip(b, a)):
        w = hash_strings(pa.array((text or "").split(), pa.string()))
        for c, g in zip(model["classes"], got):
            total, before = 0.0, toxicity.START
            for k, x in enumerate(w):
                key = int(chain(np.array([before], np.uint64), np.array([x]))[0])
                i = vocabulary.get(int(x), len(vocabulary))
                h = len(vocabulary) if k == 0 else vocabulary.get(int(before), len(vocabulary) + 1)
                if i < len(vocabulary) and h <= len(vocabulary) and key in pairs:
                    total += c["pair"][pairs[key]]
                else:
                    total += c["low"][i] + model["spare"][h]
                before = x
            assert g == pytest.approx(total / max(len(w), 1))


def frames(spark, rows, labels, label):
    docs = spark.createDataFrame([(i, t, "x", 1.0, 2) for i, t in rows], "doc_id long, text string, margin string, quality double, i int")
    return docs, spark.createDataFrame(labels, f"doc_id long, {label} int, text string")


def test_toxicity_query_edges(spark):
    texts, y = corpus(120)
    rows = [(100 + k, t) for k, t in enumerate(texts)] + EDGE
    labels = [(100 + k, v, "clash") for k, v in enumerate(y)] + [(100, 1 - y[0], "contradicts"), (None, 1, ""), (5, None, ""), (101, y[1], "again")]
    docs, lab = frames(spark, rows, labels, "toxic")
    out = {(r.doc_id, r.toxic_ll is None, r.is_toxic) for r in toxicity.toxicity(docs, lab).collect() if r.doc_id is None or r.doc_id < 100}
    assert out == {(None, False, False), (1, True, False), (2, True, False), (3, True, False), (4, False, False)}
    assert toxicity.toxicity(docs, lab).count() == len(rows)
    assert toxicity.toxicity(docs, lab.where("false")).where("is_toxic").count() == 0
    assert toxicity.toxicity(docs.where("false"), lab).count() == 0


def junk(n=300, seed=0):
    rng = np.random.default_rng(seed)
    texts, y = [], []
    for _ in range(n):
        w = " ".join(rng.choice(WORDS, int(rng.integers(20, 400))))
        good = rng.random() < 0.8
        if not good:
            w = [w.upper().replace(" ", "!! "), w.replace(" ", " | "), "### ".join(w.split()), " ".join([w.split()[0]] * 200)][int(rng.integers(4))]
        texts.append(w)
        y.append(int(good))
    return texts, y


def test_quality_on_held_out_texts():
    texts, y = junk(900)
    model = quality.fit(pa.array(texts), np.array(y))
    more, z = junk(seed=1)
    p, most, n = quality.score(model, pa.array(more))
    kept = p >= model["threshold"]
    z = np.array(z, bool)
    assert kept[z].mean() > 0.98 and (~kept[~z]).mean() > 0.9
    assert ((most > 0) & (most <= 1 + 1e-6)).all() and (n == [-(-len(t.encode()) // quality.PASSAGE) for t in more]).all()


def test_quality_gradient_lowers_loss_and_long_texts_are_read_whole():
    texts, y = junk(200)
    model = quality.fit(pa.array(texts), np.array(y))
    clean = " ".join(WORDS * 40)
    bad = clean[: len(clean) // 2] + " " + (clean[len(clean) // 2 :]).upper().replace(" ", "!! ")
    p, _, _ = quality.score(model, pa.array([clean, bad]))
    assert p[0] > p[1]  # the second half counts


def test_quality_edges(spark):
    texts, y = junk(120)
    rows = [(100 + k, t) for k, t in enumerate(texts)] + EDGE
    docs, lab = frames(spark, rows, [(100 + k, v, "clash") for k, v in enumerate(y)], "quality")
    out = {(r.doc_id, r.quality is None) for r in quality.quality(docs, lab).collect() if r.doc_id is None or r.doc_id < 100}
    assert out == {(None, False), (1, True), (2, True), (3, False), (4, False)}
    kept = quality.keep_good(docs, lab)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.quality(docs, lab).where("keep").collect()}
    everything = quality.keep_good(docs, lab.where("false"))
    assert everything.count() == docs.where("text is not null and text <> ''").count()
    assert quality.quality(docs.where("false"), lab).count() == 0


SYLLABLES = {"aa": ["ba", "ko", "ri", "ta", "mu"], "bb": ["sch", "tz", "ung", "ö", "ber"], "cc": ["ción", "ñe", "la", "do", "ez"]}


def speech(n=120, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        lang = list(SYLLABLES)[k % 3]
        rows.append((k, " ".join("".join(rng.choice(SYLLABLES[lang], int(rng.integers(1, 4)))) for _ in range(50)), lang))
    return rows


def test_language_on_held_out_texts():
    rows = speech()
    model = language.fit(pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows]))
    more = speech(seed=1)
    best, sure, n = language.score(model, pa.array([r[1] for r in more]))
    assert np.mean([model["names"][b] == r[2] for b, r in zip(best, more)]) > 0.97 and (sure > 1 / 3).all() and (n > 1).all()


def test_language_forward_against_plain_convolution():
    rows = speech(12)
    model = language.fit(pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows]))
    x, _ = language.windows(pa.array([rows[0][1]]))
    p, pooled, _ = language.forward(model, x[:1])
    e = np.vstack([model["E"][x[0]], np.zeros((max(language.WIDTHS), language.EMBED))])
    want = []
    for w in language.WIDTHS:
        for f in range(language.FILTERS):
            want.append(max(float((e[k : k + w].ravel() * model[f"W{w}"][:, f]).sum()) for k in range(language.WINDOW)))
    assert np.allclose(pooled[0], np.maximum(np.array(want) + model["b"], 0), atol=1e-3)
    assert p.sum() == pytest.approx(1, abs=1e-4)


def test_language_edges(spark):
    rows = [(k, t, v, "x") for k, t, v in speech(60)]
    odd = [(900, None, "aa", "x"), (901, "", "bb", "x"), (902, "koba " * 50_000, None, "x"), (None, "ñela ciónez " * 20, None, "x"), (5, rows[5][1], rows[5][2], "x")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, language string")
    out = {r.doc_id: r.language for r in language.languages(docs, docs).where("doc_id is null or doc_id >= 900").collect()}
    assert out == {900: None, 901: None, 902: "aa", None: "cc"}
    assert language.languages(docs, docs).count() == len(rows) + len(odd)
    assert language.languages(docs, docs.where("false")).where("language is not null").count() == 0
    assert language.languages(docs.where("false"), docs).count() == 0


def test_quality_gradient_is_the_losss():
    """Against differences of the loss, in double precision."""
    texts, y = junk(24)
    x, n = quality.passages(pa.array(texts))
    model = {k: np.asarray(v, float) for k, v in quality.fit(pa.array(texts), np.array(y)).items()}
    x, y, weight = x.astype(float), np.array(y, float), np.linspace(0.5, 2, 24)
    start = np.cumsum(n) - n

    def loss(m):
        z = quality._forward(m, [x], start)[-1]
        return float(np.mean(weight * (np.log1p(np.exp(z)) - y * z)))

    rng = np.random.default_rng(3)
    for name, g in quality.gradient(model, x, start, y, weight).items():
        for _ in range(4):
            at = tuple(int(rng.integers(s)) for s in np.shape(model[name]))
            moved = []
            for by in (1e-5, -1e-5):
                m = model | {name: model[name].copy()}
                m[name][at] += by
                moved.append(loss(m))
            assert np.asarray(g)[at] == pytest.approx((moved[0] - moved[1]) / 2e-5, rel=1e-3, abs=1e-7), name


def test_quality_score_against_plain_loop():
    """Features, attention and the weighted sum by loops over passages, at any size of the pieces."""
    texts, y = junk(60)
    model = quality.fit(pa.array(texts), np.array(y))
    some = texts[:6] + ["", "x", "ä" * 300, " ".join(texts)]
    want = []
    for t in some:
        raw, logits, hidden = t.encode(), [], []
        for k in range(0, len(raw), quality.PASSAGE):
            b = raw[k : k + quality.PASSAGE]
            one, two = np.zeros(256), np.zeros(quality.PAIRS)
            for i, v in enumerate(b):
                one[v] += 1
                if i:
                    two[(b[i - 1] * 31 + v * 7) % quality.PAIRS] += 1
            scale = 1000 / (len(b) + 64)
            x = np.r_[np.log1p(one * scale), np.log1p(two * scale), (one > 0).sum() / min(len(b), 64), (two > 0).sum() / min(len(b), quality.PAIRS)]
            h = np.tanh((x - model["mean"]) / model["dev"] @ model["W"] + model["b"])
            hidden.append(h)
            logits.append((np.tanh(h @ model["V"]) / (1 + np.exp(-(h @ model["U"])))) @ model["w"])
        if hidden:
            a = np.exp(logits) / np.exp(logits).sum()
            want.append((1 / (1 + np.exp(-(a @ np.array(hidden) @ model["c"] + model["c0"]))), a.max(), len(a)))
        else:
            want.append((0, 0, 0))
    for chunk in (1, 3, 4096):
        quality.CHUNK, before = chunk, quality.CHUNK
        got = list(zip(*quality.score(model, pa.array(some))))
        quality.CHUNK = before
        assert np.allclose(got, want, atol=1e-3)


def test_toxicity_fit_against_plain_counts():
    """The tables of both classes from dictionaries of counts."""
    texts, y = corpus(80)
    y = np.array(y, bool)
    discount = 0.75
    model = toxicity._fit(pa.array(texts), y, discount)
    docs = [re.findall(r"[\w]+", t.lower()) for t in texts]
    pairs = [Counter(), Counter()]
    for w, c in zip(docs, y):
        pairs[int(c)].update(set(zip([None, *w[:-1]], w)))
    vocabulary = sorted({w for d in docs for w in d})
    contexts = [Counter(), Counter()]
    for c in (0, 1):
        for (_, w), n in pairs[c].items():
            contexts[c][w] += n
    have = {w: (contexts[0][w] > 0) + (contexts[1][w] > 0) for w in vocabulary}
    share = lambda w: have.get(w, 1) / (sum(have.values()) + 1)
    keep = [{w: max(contexts[c][w] - toxicity.OWN_DISCOUNT, 0) for w in vocabulary} for c in (0, 1)]
    total = [sum(contexts[c].values()) for c in (0, 1)]
    ordinary = lambda w: keep[0].get(w, 0) / total[0] + (1 - sum(keep[0].values()) / total[0]) * share(w)
    back = max(toxicity.SHARED, 1 - sum(keep[1].values()) / total[1])
    toxic = lambda w: (1 - back) * keep[1].get(w, 0) / sum(keep[1].values()) + back * ordinary(w)
    follow, mass = [Counter(), Counter()], [Counter(), Counter()]
    for c in (0, 1):
        for (h, _), n in pairs[c].items():
            follow[c][h] += n
            mass[c][h] += max(n - discount, 0)
    spare = lambda h: max(1 - mass[c][h] / max(follow[c][h], 1) for c in (0, 1))

    def plain(h, w, c):
        low = (ordinary, toxic)[c](w)
        if h is not None and h not in have:
            return low
        s = spare(h)
        own = max(pairs[c][h, w] - discount, 0)
        return (1 - s) * own / mass[c][h] + s * low if own and s < 1 else s * low

    some = [*texts[:10], "never seen words", texts[0] + " unseen " + texts[1]]
    a, b, n = toxicity.score(model, pa.array(some))
    differ = 0
    for k, t in enumerate(some):
        w = re.findall(r"[\w]+", t.lower())
        for got, c in ((a[k], 1), (b[k], 0)):
            assert got == pytest.approx(np.mean([np.log(plain(h, x, c)) for h, x in zip([None, *w[:-1]], w)]), abs=1e-9)
        differ += any(pairs[0][p] != pairs[1][p] for p in zip(w, w[1:]))
    assert differ and len(n) == len(some)


def test_samples_are_bounded_in_bytes(spark):
    from siftspark.llm.common import bounded

    rows = [(k, k, "x" * (10 + k % 3), k % 2) for k in range(50)] + [(99, 99, "y" * 500, 0)]
    frame = spark.createDataFrame(rows, "o long, i long, t string, y int")
    got = bounded(frame, 200).collect()
    for y in (0, 1):
        mine = sorted((r for r in got if r.y == y), key=lambda r: r.o)
        assert 150 < sum(len(r.t) for r in mine) <= 200 and [r.i for r in mine] == sorted(k for k, _, _, v in rows if v == y)[: len(mine)]


def test_ids_that_are_not_numbers_read_as_null(spark):
    texts, y = corpus(60)
    docs = spark.createDataFrame([(f"{k}" if k % 2 else f"id-{k}", t, "aa") for k, t in enumerate(texts)], "doc_id string, text string, lang string")
    labels = spark.createDataFrame([(str(k), v, v) for k, v in enumerate(y)], "doc_id string, toxic int, quality int")
    for out in (toxicity.toxicity(docs, labels), quality.quality(docs, labels), language.languages(docs, docs)):
        assert Counter(r.doc_id is None for r in out.collect()) == {True: 30, False: 30}
