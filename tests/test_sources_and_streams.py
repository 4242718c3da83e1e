import json

import pandas as pd
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from siftspark import extension
from siftspark.operators import evidence, logs, ranking, sampling, state
from siftspark.sources import html, stores
from siftspark.streaming import framing, jobs


def test_questions(spark, tmp_path):
    (tmp_path / "questions").mkdir()
    rows = [{"id": "1", "question": "a?"}, {"id": "", "question": "b"}, {"id": "3", "question": "  "}, {"id": "4", "question": "d", "lane": "x"}]
    (tmp_path / "questions" / "f.jsonl").write_text("\n".join([json.dumps(rows[0]), "", "{broken", *map(json.dumps, rows[1:])]))
    got = {(r.id, r.lane) for r in stores.read_questions(spark, str(tmp_path / "questions")).collect()}
    assert got == {("1", "news"), ("4", "x")}


def test_first_available_and_union(spark, tmp_path):
    here = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert stores.first_available([lambda: spark.read.parquet(str(tmp_path / "no")), lambda: here]).count() == 2
    with pytest.raises(AnalysisException):
        stores.first_available([lambda: spark.read.parquet(str(tmp_path / "no"))])
    other = spark.createDataFrame([(2, "c", 1), (3, "d", 1)], "id int, v string, w int")
    assert {(r.id, r.v) for r in stores.union_distinct([here, other], "id").collect()} == {(1, "a"), (2, "b"), (3, "d")}


def test_score_store(spark, tmp_path):
    rows = spark.createDataFrame([("e1", "synthetic", "7:ab", 0.5), ("e2", "organic", "8:cd", 0.7)], "epoch string, kind string, field string, score double")
    stores.append_scores(rows, str(tmp_path / "s"))
    back = stores.read_scores(spark, str(tmp_path / "s"), "e1", "synthetic")
    assert [(r.field, r.score) for r in back.collect()] == [("7:ab", 0.5)]


def test_nul_free_inserts(spark, tmp_path):
    rows = spark.createDataFrame([("a\0b", ["x\0", "y"])], "s string, a array<string>")
    assert stores.insert_rows(rows, str(tmp_path / "i")) == 1 and stores.insert_rows(rows.limit(0), str(tmp_path / "i")) == 0
    assert spark.read.parquet(str(tmp_path / "i")).first()[:] == ("ab", ["x", "y"])


def test_config(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"fast": 7, "deep": 900}')
    assert stores.read_config(spark, str(tmp_path / "c.json"), {"fast": 1, "deep": 2, "x": 3}).first()[:] == (7, 2, 3)
    assert stores.read_config(spark, str(tmp_path / "none.json"), {"fast": 1}).first()[:] == (1,)


def test_expiry_and_probe(spark):
    now = F.to_timestamp(F.lit("2024-01-01 02:00:00"))
    rows = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-01-01 00:00:01",)], "t string").withColumn("t", F.to_timestamp("t"))
    assert stores.unexpired(rows, "t", now, 7200).count() == 1
    assert [r.p for r in spark.createDataFrame([(200,), (404,), (None,)], "s int").select(stores.probe_state(F.col("s")).alias("p")).collect()] == ["online", "unknown", "offline"]


def test_posts_mapping(spark):
    raw = spark.createDataFrame([("1", "t", "u", "c", 1, 2, 3, "", None), ("2", "t", "", "c", 1, 2, 3, "b", None), ("3", "t", "u", "c", 1, 2, 3, "b", True)], "id string, text string, url string, createdAt string, likeCount int, retweetCount int, replyCount int, bannerUrl string, noResults boolean")
    assert [(r.id, r.banner_url) for r in stores.map_posts(raw).collect()] == [("1", None)]


def test_page_parser(spark):
    page = '<html><head><title> A  B </title><meta name="description" content="d"><meta property="og:description" content="o"><meta name="author" content="me"></head><body><nav>menu</nav><script>x<y</script><p>First [1] para .</p><p>Second</body>'
    pages = spark.createDataFrame([(1, "https://en.wikipedia.org/x", page), (2, "http://a.b", page), (3, None, None)], "page_id long, url string, html string")
    got = {r.page_id: r for r in html.parse_pages(pages, "page_id", "url", "html").collect()}
    assert got[1].chosen_description == "First  para" and got[2].chosen_description == "d" and got[3].chosen_description == ""
    assert got[1].title == "A B" and "x<y" not in got[1].visible and "menu" in got[1].visible and got[1].author == "me"


def test_framing(spark):
    assert framing.frames('{"a":1} {"b":"}{"}{"c"') == ([{"a": 1}, {"b": "}{"}], '{"c"')
    chunks = spark.createDataFrame([(1, 1, '"x"}{'), (1, 0, '{"a":'), (1, 2, '"b":2}'), (2, 0, "bad"), (2, 1, '{"a":1}')], "s long, o long, c string")
    assert {(r.stream, r.seq, r.object) for r in framing.unframe(chunks, "s", "o", "c").collect()} == {(1, 0, '{"a": "x"}'), (1, 1, '{"b": 2}')}
    assert spark.range(1).select(framing.sse(F.lit("a\n\nb")).alias("v")).first().v == "data: a\ndata:  \ndata: b\n\n"


def test_limiter():
    run = jobs.limiter(2, 10)
    assert run([0, 1, 2, 10, 10.5, 11.5], [])[0] == [True, True, False, True, False, True]


def test_rate_limit_stream_is_the_batch(spark, tmp_path):
    rows = spark.createDataFrame(pd.DataFrame({"u": [1, 1, 1, 2], "t": pd.to_datetime(["2024-01-01 00:00:00", "2024-01-01 00:00:01", "2024-01-01 00:00:02", "2024-01-01 00:00:00"]), "i": [0, 1, 2, 3]}))
    rows.write.parquet(str(tmp_path / "calls.parquet"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "calls.parquet"))
    got = {tuple(r) for r in jobs.run_available(jobs.rate_limit(stream, "u", "t", "i", 2, 60)).collect()}
    assert got == {tuple(r) for r in jobs.rate_limit_batch(rows, "u", "t", "i", 2, 60).collect()} == {(1, 0, True), (1, 1, True), (1, 2, False), (2, 3, True)}


def test_row_numbers(spark):
    rows = spark.range(5000).select((F.col("id") * 37 % 5000).alias("v"))
    got = ranking.global_row_number(rows, "v", "k")
    assert got.where("v <> k").count() == 0 and got.count() == 5000
    assert ranking.global_row_number(rows.limit(0), "v", "k").count() == 0


def test_samples_fill_their_quota(spark):
    rows = spark.range(100).select(F.col("id"), (F.col("id") % 2).alias("uid"), (F.col("id") % 5).alias("b"))
    got = sampling.bucket_sample(rows, "uid", "b", "id").groupBy("uid").count().collect()
    assert {r["count"] for r in got} == {10}
    slots = sampling.largest_remainder(spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "uid int, n int"), "uid", "n", 100)
    assert {r.uid: r.slots for r in slots.collect()} == {1: 34, 2: 33, 3: 33}


def test_islands_and_ramp(spark):
    calls = spark.createDataFrame([(1, 1, True), (1, 2, True), (1, 3, False), (1, 4, True), (2, 1, False)], "uid int, at int, failed boolean")
    assert {tuple(r) for r in state.call_islands(calls, ["uid"], ["at"], F.col("failed")).collect()} == {(1, 1, 2, False), (1, 4, 1, True)}


def test_matches_and_shortfalls(spark):
    checked = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "r int, k string")
    given = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (2, "a", 2)], "r int, k string, v int")
    assert {(r.r, r.k, r.matched) for r in evidence.match_by_id(checked, given, "r", "k").collect()} >= {(1, "a", True), (1, "b", False), (2, "a", False)}
    worst = evidence.worst_shortfall([(F.lit(True), F.lit(3), F.lit(10)), (F.lit(True), F.lit(10), F.lit(10)), (F.lit(False), F.lit(0), F.lit(10))])
    assert spark.range(1).select(worst.alias("v")).first().v == pytest.approx(0.7)


def test_groups_with_null_keys(spark):
    rows = spark.createDataFrame([(None, 1, "a", "q", 0.5), (None, 1, "a", "q", None), (5, None, "a", "q", 0.1)], "epoch int, uid int, search_type string, query string, reward double").withColumn("checker", F.lit(1))
    got = {(r.epoch, r.checkers, r.reward_avg) for r in logs.group_logs(rows, "reward", "checker").collect()}
    assert got == {(None, 2, 0.5), (5, 1, 0.1)}
    assert logs.members(rows, logs.top_groups(rows, 1)).count() == 1 and logs.members(rows, logs.top_groups(rows)).count() == 3


def test_plug_ins(spark):
    extension.register(extension.REWARDS, "length")(lambda r: r.select("response_id", (F.length("text") / 10).alias("reward")))
    extension.register(extension.CHEAP, "short")(lambda: F.when(F.length("text") < 3, 0.5).otherwise(0.0))
    extension.register(extension.TOOLS, "web")(lambda q: q.select("query", F.lit("u").alias("url")))
    with pytest.raises(ValueError):
        extension.register(extension.CHEAP, "short")
    rows = spark.createDataFrame([(1, "ab"), (2, "abcdefghijklmn")], "response_id int, text string")
    out = {r.response_id: (r.length, r.cheap) for r in extension.with_penalties(extension.with_rewards(rows, ["length"]), ["short"], []).collect()}
    assert out == {1: (0.2, 0.5), 2: (1.0, 1.0)}
    assert extension.run_tools(spark.createDataFrame([("q",)], "query string"), ["web", "no"]).first().tool == "web"
    asked = extension.judge(spark.createDataFrame([("hi",), (None,)], "prompt string"), lambda p: [x.upper() for x in p])
    assert sorted(r.answer for r in asked.collect()) == ["", "HI"]


def test_route_pick_each_builds_no_pairs(spark):
    ids = [*range(0, 400, 3), 10**6, 2**31, 5, 5]
    rows = [(k, *v) for k, v in zip(ids, [(0.5, 3), (None, None), (0.9, 70), (0.01, 1), (0.7, 2000)] * 40)] + [(None, 1.0, 10**6)]
    providers = spark.createDataFrame(rows, "u long, q double, v long")
    requests = spark.createDataFrame([(k,) for k in [*range(300), 7, 10**6 + 3]], "r long")
    pick = lambda p, r=requests: sampling.route_pick_each(r, p, "r", "u", "q", "v", 5)
    pairs = lambda p, r=requests: sampling.route_pick(r.crossJoin(p), "r", "u", "q", "v", 5).select("r", "u")
    assert sorted(map(tuple, pick(providers).collect())) == sorted(map(tuple, pairs(providers).collect()))
    # odd weights, and weights so large that rounded scores are equal
    for odd in ([(1, float("nan"), 1), (4, 0.5, 3), (9, 0.2, 9)], [(8, float("inf"), 1), (4, 0.5, 10**7), (6, 0.5, 3)], [(8, float("nan"), 1), (3, float("nan"), 1)], [(k, 1.0, 10**7 + k % 7 * 10**6) for k in range(500, 0, -1)], [(None, 0.5, 1)]):
        some = spark.createDataFrame(odd, "u long, q double, v long")
        assert sorted(map(tuple, pick(some).collect())) == sorted(map(tuple, pairs(some).collect()))
    nobody = spark.createDataFrame([(None,)], "r long")
    assert [tuple(r) for r in pick(providers, nobody).collect()] == [tuple(r) for r in pairs(providers, nobody).collect()] == [(None, 0)]
    assert pick(providers.limit(0)).count() == 0


def test_route_pick_each_in_parts(spark, monkeypatch):
    providers = spark.range(0, 999).select(F.col("id").alias("u"), ((F.col("id") % 10) / 10).alias("q"), (1 + F.col("id") % 70).alias("v"))
    requests = spark.range(500).withColumnRenamed("id", "r")
    whole = {tuple(r) for r in sampling.route_pick_each(requests, providers, "r", "u", "q", "v").collect()}
    for name, n in (("PART_REQUESTS", 100), ("PART_UIDS", 300)):
        monkeypatch.setattr(sampling, name, n)
    assert whole == {tuple(r) for r in sampling.route_pick_each(requests, providers, "r", "u", "q", "v").collect()} and len(whole) == 500
    assert "Cartesian" not in (plan := sampling.route_pick_each(requests, providers, "r", "u", "q", "v")._jdf.queryExecution().executedPlan().toString()) and "part_" in plan


def test_stream_of_a_table_in_parts(spark, tmp_path):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (2, 0, "user", "d"), (2, 1, "assistant", "e")]
    table = spark.createDataFrame(rows, "k long, turn long, role string, t string")
    table.repartition(3).write.parquet(str(tmp_path / "parts.parquet"))
    table.toPandas().to_parquet(tmp_path / "whole.parquet")
    for name in ("parts", "whole"):
        stream = jobs.read_files(spark, str(tmp_path), name)
        assert {tuple(r) for r in jobs.run_available(jobs.fold(stream, "k", "turn", "role", "t"), "complete").collect()} == {(1, "ac", "b"), (2, "d", "e")}


def test_cited_bodies_meet_posts_only_without_a_link(spark):
    links = spark.createDataFrame([(1, "http://a.b/x", "long body"), (1, "http://a.b/x/", "body"), (1, "http://a.b/y", ""), (1, "https://x.com/u/status/8", ""), (2, "http://a.b/z", "z")], "r long, url string, body string")
    posts = spark.createDataFrame([(1, "7", "seven"), (1, "8", "eight"), (1, "9", ""), (1, None, "none")], "r long, post_id string, body string")
    urls = ["http://a.b/x/", "http://a.b/x", "http://a.b/y", "http://a.b/z", "https://x.com/u/status/7", "https://x.com/u/status/8", "https://x.com/u/status/9"]
    got = evidence.cited_bodies(spark.createDataFrame([(1, u) for u in urls], "r long, url string"), links, posts, "r", "url", "body")
    assert sorted(got.columns) == ["body", "r", "url"]
    assert {(r.url, r.body) for r in got.collect()} == {("http://a.b/x", "long body"), ("https://x.com/u/status/7", "seven"), ("https://x.com/u/status/8", "eight")}
    assert "LeftOuter" not in got._jdf.queryExecution().optimizedPlan().toString()  # bodies without a post id would all be in one task


def test_strided_places_no_texts(spark, monkeypatch):
    placed = []
    number = sampling.global_row_number
    monkeypatch.setattr(sampling, "global_row_number", lambda df, *a: placed.append(df.columns) or number(df, *a))
    rows = spark.range(100).select((F.col("id") - F.col("id") % 2).alias("k"), F.concat(F.lit(" t"), F.col("id").cast("string")).alias("text")).union(spark.createDataFrame([(None, "null"), (None, "null")], "k long, text string"))
    got = [r.text for r in sampling.strided(rows, "k", "text", 10, 1).collect()]
    # places 1, 11, ..., 101 of 102; nulls come first, and either row of a pair may have a place
    assert len(got) == 11 and got.count("null") == 1 and {int(x[1:]) // 2 * 2 for x in got if x != "null"} == {k * 10 + 8 for k in range(10)}
    assert placed and not any("text" in c for c in placed)


def test_pages_are_parsed_in_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(html, "PIECE_BYTES", 1000)
    pages = ["<title>%d</title>" % k + "x" * (k * 40) for k in range(40)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(42)), pa.array(["u"] * 42), pa.array(pages)], ["id", "url", "html"])
    out = list(html._parse(iter([batch, batch.slice(0, 0)])))
    assert len(out) > 10 and max(b.num_rows for b in out) < 20
    assert [x for b in out for x in b.column(2).to_pylist()] == [str(k) for k in range(40)] + ["", ""]
    assert [x for b in out for x in b.column(0).to_pylist()] == list(range(42))
