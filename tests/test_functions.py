import pytest
from pyspark.sql import functions as F

from siftspark.functions import arrays, dates, numeric, text
from siftspark.operators import evidence, scoring


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "url, key",
    [
        ("https://www.Site.com/Path/?utm_source=x&b=2&a=1#top", "https://site.com/path?a=1&b=2"),
        ("https://site.com/watch?v=AAA", "https://site.com/watch?v=AAA"),
        ("https://site.com/x?fbclid=1", "https://site.com/x"),
        ("https://site.com/x?id=", "https://site.com/x?id="),
        ("", ""),
        (None, ""),
    ],
)
def test_source_key(spark, url, key):
    assert value(spark, text.source_key(F.lit(url))) == key


@pytest.mark.parametrize("u, ok", [("https://x.com/user_1/status/12", True), ("https://X.com/user/status/12", True), ("https://x.com/mytwitter/status/1", False), ("https://x.com/sixteencharacter/status/1", False), ("http://y.com/a/status/1", False), (None, False)])
def test_valid_post(spark, u, ok):
    assert value(spark, text.valid_post_url(F.lit(u))) is ok


@pytest.mark.parametrize("t, score, label", [("Verdict: HIGH", 3.0, "HIGH"), ("verdict - Medium", 1.5, "LOW"), ("Verdict: HIGH then Verdict: FAIL", 0.0, "LOW"), ("it is HIGH", 3.0, "LOW"), ("", 0.0, "LOW"), (None, 0.0, "LOW")])
def test_verdicts(spark, t, score, label):
    assert value(spark, text.verdict_score(F.lit(t))) == score and value(spark, text.verdict_label(F.lit(t))) == label


@pytest.mark.parametrize("t, n", [("score: 7", 7.0), ("Score 10 of it", 10.0), ("I give 4.", 4.0), ("99", 0.0), ("", 0.0)])
def test_number_score(spark, t, n):
    assert value(spark, text.number_score(F.lit(t))) == n


def test_match_text(spark):
    assert value(spark, text.match_text(F.lit("@a @b Hi &amp; bye https://t.co/x  end"))) == "Hi&byeend"
    assert value(spark, text.clean_text(F.lit("@a  Hi, it's — fine! http://x.y"))) == "Hi, its fine"


@pytest.mark.parametrize(
    "s, iso",
    [("Mon Jan 01 00:00:05 +0000 2024", "2024-01-01T00:00:05.000Z"), ("Fri Jan 01 02:00:00 +0200 2024", "2024-01-01T00:00:00.000Z"), ("2024-01-01T00:00:00Z", "2024-01-01T00:00:00.000Z"), ("2024-01-01_10:11:12_UTC", "2024-01-01T10:11:12.000Z"), ("2024-01-01", "2024-01-01T00:00:00.000Z"), ("nonsense", None), (None, None)],
)
def test_post_time(spark, s, iso):
    assert value(spark, dates.iso_millis(dates.post_time(F.lit(s)))) == iso


def test_local_post_time_keeps_the_clock(spark):
    assert value(spark, dates.iso_millis(dates.local_post_time(F.lit("Fri Jan 01 02:00:00 +0200 2024")))) == "2024-01-01T02:00:00.000Z"


def test_date_bounds(spark):
    at = lambda s: F.to_timestamp(F.lit(s))
    day, none = "2024-01-02 00:00:00", F.lit(None).cast("timestamp")
    assert value(spark, dates.in_range(at(day), none, none)) is True
    assert value(spark, dates.in_range(none, none, none)) is False
    assert value(spark, dates.in_range(at(day), at(day), at(day))) is True
    assert value(spark, dates.blocked_date(none, at(day), none)) is False
    assert value(spark, dates.blocked_date(at(day), none, at("2024-01-01 00:00:00"))) is True


@pytest.mark.parametrize("verified, declared, passed, new", [(1, 100, True, 11), (95, 100, True, 100), (95, 500, True, 100), (1, 5, True, 2), (50, 100, False, 40), (5, 100, False, 1)])
def test_capacity_steps(spark, verified, declared, passed, new):
    assert value(spark, numeric.next_verified(F.lit(verified), F.lit(declared), F.lit(passed))) == new


@pytest.mark.parametrize("start, ticks, end", [(100, 3, 72), (100, 0, 100), (1, 9, 1)])
def test_decay(spark, start, ticks, end):
    assert value(spark, numeric.decayed(F.lit(start), F.lit(ticks))) == end


@pytest.mark.parametrize("t, budget, p", [(0.5, 5.0, 0.0), (1.0, 5.0, 1.0), (3.0, 5.0, 1.0), (7.5, 5.0, 0.0), (5.25, 5.0, 0.5), (3.0, None, 1.0), (8.0, None, 0.0), (None, 5.0, 0.0), (20.0, 15.0, 0.0)])
def test_performance(spark, t, budget, p):
    assert value(spark, numeric.performance(F.lit(t).cast("double"), F.lit(budget).cast("double"))) == pytest.approx(p)


@pytest.mark.parametrize("a, b, ok", [(None, None, True), (None, 1, False), (100, 110, True), (100, 200, True), (100, 300, False), (0, 10, True), (0, 11, False)])
def test_slack(spark, a, b, ok):
    assert value(spark, numeric.within_slack(F.lit(a).cast("int"), F.lit(b).cast("int"))) is ok


def test_token_overage(spark):
    assert value(spark, numeric.token_overage(F.array(F.lit(2), F.lit(5)))) == pytest.approx(0.03)
    assert value(spark, numeric.token_overage(F.array().cast("array<int>"))) == 1.0
    assert value(spark, numeric.token_overage(F.array(F.lit(500)))) == 1.0


def test_highlights_in_order(spark):
    body = F.lit("One two, three FOUR one")
    a = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    for given, ok in ((a("one two", "four"), True), (a("four", "three"), False), (a("one", "one"), True), (a("one", "one", "one"), False), (a(), False), (a("one", " "), False)):
        assert value(spark, arrays.in_order(given, body)) is ok
    assert value(spark, arrays.in_order(a("x"), F.lit(None).cast("string"))) is False


def test_arrays(spark):
    keys = F.array(F.lit("a"), F.lit("b"), F.lit("a"))
    assert value(spark, arrays.last_index(keys, F.lit("a"))) == 3 and value(spark, arrays.last_index(keys, F.lit("z"))) is None
    assert value(spark, arrays.repeated(F.array(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("a")))) is False
    assert value(spark, arrays.size0(F.lit(None).cast("array<int>"))) == 0


def test_domains(spark):
    host = text.url_host(F.lit("https://User@News.Example.org:80/x"))
    assert value(spark, host) == "news.example.org"
    assert value(spark, evidence.in_domains(host, F.array(F.lit("example.org")))) is True
    assert value(spark, evidence.in_domains(F.lit("badexample.org"), F.array(F.lit("example.org")))) is False
    assert value(spark, evidence.domain_violation(F.lit("no url"), F.array(F.lit("a.com")), F.array().cast("array<string>"))) is True


def test_final_scores(spark):
    w, g = scoring.final_scores(F.lit(0.9), F.lit(0.2), F.lit(False), F.lit(0.5), scoring.penalty_product(F.lit(0.5), F.lit(float("nan")), F.lit(-1.0)), F.lit(True))
    assert value(spark, w) == pytest.approx((0.54 + 0.08) * 0.5 * 0.5) and value(spark, g) == 0.0


def test_unpaid_pools_stay_unpaid(spark):
    lanes = spark.createDataFrame([(1, 1, "ai_search:fast", 0.9, 0.9, 10, 5), (1, 2, "ai_search:fast", 0.9, 0.9, 10, 2), (1, 2, "x_search", 0.1, 0.9, 9, 9)], "epoch int, uid int, lane string, q_gate double, q_weight double, volume long, samples long")
    assert {(r.uid, r.score) for r in scoring.pool_payouts(lanes).collect()} == {(1, 0.54)}


def test_burn_cases(spark):
    w = spark.createDataFrame([(1, 2.0), (2, 6.0), (3, 2.0)], "uid long, weight double")
    assert {r.uid: r.weight for r in scoring.burn(w, "uid", 1).collect()} == {1: 5.0, 2: 3.75, 3: 1.25}
    for target in (9, 0):
        assert {r.uid: r.weight for r in scoring.burn(w, "uid", target).collect()} == {1: 2.0, 2: 6.0, 3: 2.0}


def test_operator_parser(spark):
    o = evidence.parse_operators(F.lit("Cats from:Bob min_faves:12 min_retweets:x since:2024-01-01 filter:images"))
    got = {k: value(spark, v) for k, v in o.items()}
    assert got["from"] == "bob" and got["min_faves"] == 12 and got["min_retweets"] is None and got["since"] == "2024-01-01" and got["has_images"] and not got["has_videos"]


def test_tokenizer_count(spark):
    tokenizers = pytest.importorskip("tokenizers")
    from siftspark.functions import documents

    path = "/opt/tokenizers/byte_bpe_50k.json"
    texts = ["Hello there", "", None, "<|endoftext|> é 漢字"]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", documents.tokenizer_count(F.col("t"), path).alias("n"))
    t = tokenizers.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    assert {r.k: r.n for r in got.collect()} == {k: len(t.encode(x or "", add_special_tokens=False).ids) for k, x in enumerate(texts)}


def test_free_json(spark):
    from siftspark.functions import documents

    assert value(spark, documents.drop_keys(F.lit('{"a": [{"x": 1, "b": 2}]}'), ("x",))) == '{"a":[{"b":2}]}'
    assert value(spark, documents.drop_keys(F.lit("broken {"), ("x",))) == "broken {"
    assert value(spark, documents.first_difference(F.lit('{"a": 1}'), F.lit('{"a": 1, "b": null}'))) is None
    assert value(spark, documents.first_difference(F.lit('{"a": {"b": [1, 2]}}'), F.lit('{"a": {"b": [1, 3]}}'))) == "a.b[1]"
    text_ = "[1](https://www.A.com/p/?utm_x=1) and [y](http://other), [the report](https://a.com/p)"
    assert value(spark, documents.renumber(F.lit(text_), F.array(F.lit("https://a.com/p"), F.lit("z"), F.lit("https://a.com/p")))) == "[3](https://www.A.com/p/?utm_x=1) and [y](http://other), [the report](https://a.com/p)"


def test_vote_mean_without_lambdas(spark):
    votes = spark.createDataFrame([([True, None, False, True],), ([None],), ([],), (None,), ([False],), ([True],)], "v array<boolean>")
    got = votes.select(arrays.vote_mean("v").alias("m"))
    assert [r.m for r in got.collect()] == [2 / 3, 0.0, 0.0, 0.0, 0.0, 1.0]
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_highlights_in_order_fold_a_text_once(spark):
    one = spark.createDataFrame([("One two, three FOUR one", "one two", "four"), (None, "a", "b"), ("a b", None, "b")], "t string, a string, b string")
    got = one.select(arrays.in_order(F.array("a", "b"), "t").alias("v"))
    assert [r.v for r in got.collect()] == [True, False, False]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 2  # of the body, and of each highlight


def test_tokens_are_counted_in_pieces(monkeypatch):
    from types import SimpleNamespace

    from siftspark.functions import documents

    seen = []

    def encode(texts, add_special_tokens):
        seen.append(sum(map(len, texts)))
        return [SimpleNamespace(ids=list(x)) for x in texts]

    monkeypatch.setattr(documents, "PIECE_CHARS", 50)
    texts = ["x" * (k % 9) for k in range(100)] + [None, "y" * 200, ""]
    assert list(documents._token_counts(SimpleNamespace(encode_batch_fast=encode), texts)) == [len(x or "") for x in texts]
    assert list(documents._token_counts(SimpleNamespace(encode_batch_fast=encode), [])) == []
    assert max(seen) < 260 and len(seen) > 5
