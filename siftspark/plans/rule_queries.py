"""Queries of sources, rules, votes and plug-ins. Their SQL states the rules by itself, with literal lists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import extension
from ..config import CONFIG
from ..functions import arrays, dates, documents, numeric, text
from ..operators import epoch, evidence, logs, rules, scoring
from ..session import shared_folder
from ..sources import stores
from .capacity import STATE_SQL, hash_sql, states
from .evidence_queries import FOLD, VERDICT_SQL, url_sql, verdicts
from .registry import query

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
ENC = "replace(url_encode({0}), '%20', '+')"
# pages, their URLs with parameters that track and that don't, and the sources' keys
KEY_SQL = rf"""p as (select page_id, html, regexp_replace(url, '#.*$', '') || case when contains(regexp_replace(url, '#.*$', ''), '?') then '&' else '?' end || 'igsh=' || page_id || '&Source=A%20b%2Fc+d&z&MKT_TOK=1&source=' || page_id % 3 || '#x' url from pages),
k as (select page_id, html, url, {url_sql(r"regexp_replace(url, '[?#].*$', '')")} bare, list_sort(list_filter(list_transform(list_filter(string_split(regexp_extract(regexp_replace(url, '#.*$', ''), '\?(.*)$', 1), '&'), lambda x: x <> ''),
  lambda x: {{'k': url_decode(replace(split_part(x, '=', 1), '+', ' ')), 'v': case when contains(x, '=') then url_decode(replace(substr(x, instr(x, '=') + 1), '+', ' ')) else '' end}}),
  lambda x: not starts_with(lower(x.k), 'utm_') and lower(x.k) not in ('fbclid', 'gclid', 'gclsrc', 'dclid', 'gbraid', 'wbraid', 'msclkid', 'yclid', 'twclid', 'igshid', 'igsh', 'mc_cid', 'mc_eid', '_ga', '_gl', 'mkt_tok', 'si', 'feature', 'spm', 'scm'))) ps from p),
keys as (select page_id, html, url, bare || case when len(ps) > 0 then '?' || array_to_string(list_transform(ps, lambda x: {ENC.format("x.k")} || '=' || {ENC.format("x.v")}), '&') else '' end as source_key from k)"""


def tracked(t):
    bare = F.regexp_replace("url", "#.*$", "")
    i = F.col("page_id").cast("string")
    made = F.concat(bare, F.when(F.contains(bare, F.lit("?")), "&").otherwise("?"), F.lit("igsh="), i, F.lit("&Source=A%20b%2Fc+d&z&MKT_TOK=1&source="), (F.col("page_id") % 3).cast("string"), F.lit("#x"))
    return t.pages.withColumn("url", made)


@query("str2_source_key", f"with {KEY_SQL} select page_id, source_key from keys")
def source_key(t):
    return tracked(t).select("page_id", text.source_key("url").alias("source_key"))


@query("agg17_richest_by_key", f"with {KEY_SQL} select page_id, source_key from (select page_id, source_key, row_number() over (partition by source_key order by length(html) desc, page_id) r from keys) where r = 1")
def richest(t):
    p = tracked(t).select("page_id", text.source_key("url").alias("source_key"), "html")
    return logs.richest_wins(p, "source_key", "html", "page_id").select("page_id", "source_key")


@query("agg19_duplicate_sources", f"with {KEY_SQL} select regexp_extract(url, '//([^/?#:]+)', 1) host, count(*) > count(distinct source_key) duplicated from keys group by 1")
def duplicated(t):
    return evidence.duplicates(tracked(t).withColumn("host", text.url_host("url")), "host", "url")


@query("join5_cited_bodies", f"with {KEY_SQL} select source_key, max(length(html)) n from keys group by 1 union all select 'https://x.com/u/status/' || doc_id, length(text) from documents where doc_id % 2 = 0 and length(text) > 0")
def cited_bodies(t):
    links = tracked(t).select(F.lit(1).alias("r"), "url", F.col("html").alias("body"))
    i = F.col("doc_id").cast("string")
    posts = t.documents.where("doc_id % 2 = 0").select(F.lit(1).alias("r"), i.alias("post_id"), F.col("text").alias("body"))
    cited = links.select("r", "url").union(t.documents.select(F.lit(1), F.concat(F.lit("https://x.com/u/status/"), i)))
    return evidence.cited_bodies(cited, links, posts, "r", "url", "body").select(text.source_key("url").alias("source_key"), F.length("body").alias("n"))


@query("join6_renumbered", "select doc_id, '[the report](https://www.Site.org/' || source || '/), [2](https://www.Site.org/' || source || '/?utm_source=n), [1](http://b.com/' || doc_id || '?igsh=1) and [7](ftp://b) ' || text m from documents")
def renumbered(t):
    site = F.concat(F.lit("https://www.Site.org/"), "source", F.lit("/"))
    m = F.concat(F.lit("[the report]("), site, F.lit("), [7]("), site, F.lit("?utm_source=n), [1](http://b.com/"), F.col("doc_id").cast("string"), F.lit("?igsh=1) and [7](ftp://b) "), "text")
    return t.documents.select("doc_id", documents.renumber(m, F.array(F.lit("http://other.com"), F.concat(F.lit("https://site.org/"), "source"))).alias("m"))


MARKS = ["</Score>", "SM_PNK", "sm-rdd", "SM SCS GRN", "<contextual>", "< /Score >"]


@query("fil2_forbidden", "select doc_id, regexp_matches(text || ' ' || list_extract(['</Score>', 'SM_PNK', 'sm-rdd', 'SM SCS GRN', '<contextual>', '< /Score >'], cast(doc_id % 6 + 1 as int)), '(?i)<(?:Question|/Question|Answer|/Answer|Score|/Score)>|SM(?:[-_ ]SCS)?[-_ ]?(?:RDD|PNK|BLE|GRY|GRN)') bad from documents")
def forbidden(t):
    mark = F.element_at(F.array(*map(F.lit, MARKS)), (F.col("doc_id") % 6 + 1).cast("int"))
    return t.documents.select("doc_id", text.forbidden_markup(F.concat("text", F.lit(" "), mark)).alias("bad"))


STARTS = ["", "Access denied. ", "Are you a robot? ", "Something went wrong. Please ", "Now you need to turn on JavaScript ", "javascript is disabled "]


@query("fil11_usable", r"with x as (select doc_id, list_extract(['', 'Access denied. ', 'Are you a robot? ', 'Something went wrong. Please ', 'Now you need to turn on JavaScript ', 'javascript is disabled '], cast(doc_id % 6 + 1 as int)) || text t from documents) select doc_id, length(t) >= 200 and not regexp_matches(t, '(?i)(please enable javascript|enable javascript and refresh|something went wrong\.?\s*(wait a moment|please|try)|you (need to )?(enable|turn on) javascript|access denied|are you a robot)') usable from x")
def usable(t):
    start = F.element_at(F.array(*map(F.lit, STARTS)), (F.col("doc_id") % 6 + 1).cast("int"))
    return t.documents.select("doc_id", text.usable_article(F.concat(start, "text")).alias("usable"))


@query("str14_relevance", "select conv_id, turn, text || case when turn % 3 = 0 then '' when turn % 2 = 0 then chr(10) || chr(10) || 'Quoted tweet (@' || role || '): q' else chr(10) || chr(10) || 'Quoted tweet: q' end r from conversations")
def relevance(t):
    return t.conversations.select("conv_id", "turn", text.relevance_text("text", F.when(F.col("turn") % 2 == 0, F.col("role")), F.when(F.col("turn") % 3 > 0, " q ")).alias("r"))


@query("arr7_highlights", f"select doc_id, item_id from documents d join benchmark b on {FOLD.format('b.text')} <> '' and contains({FOLD.format('d.text')}, {FOLD.format('b.text')})")
def highlights(t):
    return evidence.contained_pairs(t.documents, t.benchmark, "doc_id", "text", "item_id", "text")


def streamed(t):
    """Conversations as streams: a chunk is a turn's text, of a fifth of the streams there is none."""
    n = documents.tokenizer_count(F.col("text"), TOKENIZER)
    return t.conversations.where("conv_id % 5 <> 1").select("conv_id", n.alias("tokens"))


@query("mth11_token_overage")
def overage(t):
    return streamed(t).groupBy("conv_id").agg(F.collect_list("tokens").alias("n")).select("conv_id", F.round(numeric.token_overage("n"), 6).alias("penalty"))


@query("scr8_stream_penalty")
def stream_penalty(t):
    every = t.conversations.select("conv_id").distinct()
    return evidence.streaming_penalty(every, streamed(t), "conv_id", F.col("conv_id") % 5 == 0, "tokens").withColumn("penalty", F.round("penalty", 6))


@query("str32_tokens")
def tokens(t):
    return t.conversations.select("conv_id", "turn", documents.tokenizer_count(F.col("text"), TOKENIZER).alias("n"))


@query("scr11_rule_penalty", "select doc_id, case when doc_id % 3 = 0 or length(text) = 0 or doc_id % 7 = 0 then 0e0 when doc_id % 4 = 0 then 0e0 else 1e0 end penalty from documents")
def rule_penalty(t):
    k = F.col("doc_id")
    answer = F.when(k % 4 == 0, "Score: 10").when(k % 4 == 1, "score 9.5").when(k % 4 == 2, "a 3 of 10").otherwise("no idea")
    return t.documents.select("doc_id", evidence.rule_penalty(F.when(k % 3 > 0, "be brief"), F.when(k % 7 > 0, F.col("text")), text.number_score(answer)).alias("penalty"))


@query(
    "scr16_grounded",
    f"""with {VERDICT_SQL}, g as (select doc_id, v, case when doc_id % 4 = 0 then 0 when doc_id % 4 = 1 then case when doc_id % 3 > 0 then 1 else 0 end when doc_id % 4 = 2 then case when doc_id % 5 > 0 then 1 else 0 end else 0 end n from v join documents using (doc_id))
    select doc_id, cast(n as bigint) bodies, case when n = 0 then 0e0 when v like '%HIGH' then 1e0 when v like '%medium' then 5e-1 else 0e0 end reward from g""",
)
def grounded(t):
    k = F.col("doc_id")
    i = k.cast("string")
    summary = F.when(k % 4 == 0, "").when(k % 4 == 1, F.concat(F.lit("See [1](https://www.X.org/p/"), i, F.lit("?utm_a=1&igsh=2)."))).otherwise("no links in it")
    rows = verdicts(t).select("doc_id", summary.alias("summary"), F.when(k % 4 == 2, F.array(F.concat(F.lit("https://x.com/a/status/"), i))).otherwise(F.array().cast("array<string>")).alias("found"), "v")
    links = t.documents.where("doc_id % 3 > 0").select("doc_id", F.concat(F.lit("https://x.org/p/"), i).alias("url"), F.lit("a body").alias("body"))
    posts = t.documents.where("doc_id % 5 > 0").select("doc_id", i.alias("post_id"), F.lit("a post").alias("body"))
    return evidence.groundedness(rows, links, posts, "doc_id", "summary", "found", "v")


@query("scr9_summary_shape", r"select doc_id, case when regexp_matches(text, '(?m)^#{1,6}\s') or doc_id % 3 = 0 or doc_id % 4 = 1 then 1e0 else 0e0 end penalty from documents")
def summary_shape(t):
    k, i = F.col("doc_id"), F.col("doc_id").cast("string")
    cite = F.when(k % 3 > 0, F.concat(F.lit(" [a](https://www.Site.org/"), i, F.lit("/) [b](http://b.com/"), i, F.lit("?a=1)"))).otherwise("")
    m = F.concat("text", cite)
    own = F.when(k % 4 == 1, F.array(F.concat(F.lit("https://site.org/"), i))).otherwise(F.array(F.concat(F.lit("https://site.org/"), i), F.concat(F.lit("http://b.com/"), i, F.lit("?a=1"))))
    ok = text.good_markdown(m) & (F.size(text.cited_urls(m)) > 0) & (F.size(F.array_except(text.cited_urls(m), own)) == 0)
    return t.documents.select("doc_id", F.when(ok, 0.0).otherwise(1.0).alias("penalty"))


@query("src9_union_fallback", "select k, arg_min(v, o) v from (select c_custkey k, c_name v, 0 o from customer union all select s_suppkey, s_name, 1 from supplier) group by 1")
def union_fallback(t):
    a, b = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v")), t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"))
    spark = a.sparkSession
    pool = stores.Pool(lambda: stores.union_distinct([stores.first_available([lambda: spark.read.parquet(f"{t._folder}/nowhere.parquet"), lambda: a]), b], "k"))
    pool.rows(0.0)
    pool.load = lambda: spark.read.parquet(f"{t._folder}/nowhere.parquet")  # the next refresh fails: what is there stays
    return pool.rows(4 * 3600.0)


@query("src10_src11_score_store", "select user_id uid, count(*) n from events where event_type = 'click' and ts > timestamp '2024-01-10' group by 1")
def score_store(t):
    made = F.concat(F.col("user_id").cast("string"), F.lit(":"), F.col("event_id").cast("string"))
    rows = t.events.select(F.lit("e1").alias("epoch"), F.col("event_type").alias("kind"), made.alias("field"), "value", F.col("ts").cast("timestamp").alias("written"))
    folder = shared_folder(rows.sparkSession, "scores")
    stores.append_scores(rows, folder)
    now = F.to_timestamp(F.lit("2024-01-10 02:00:00"))
    live = stores.unexpired(stores.read_scores(rows.sparkSession, folder, "e1", "click"), "written", now, 7200)
    return live.groupBy(F.split("field", ":")[0].cast("long").alias("uid")).agg(F.count("*").alias("n"))


@query("src12_saved_averages", "select c_custkey uid, case when c_acctbal > 0 then c_acctbal else 0 end::double ema from customer")
def saved(t):
    kept = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("uid"), F.col("c_acctbal").cast("double").alias("ema"))
    folder = stores.versioned(shared_folder(kept.sparkSession, "averages"), "1")
    stores.save_snapshot(kept.withColumn("ema", F.lit(-1.0)), folder)
    stores.save_snapshot(kept, folder)  # the last one counts
    return logs.with_defaults(t.customer.select(F.col("c_custkey").alias("uid")), stores.load_snapshot(kept.sparkSession, folder, kept.schema), ["uid"], {"ema": 0.0})


@query("src13_src14_inserts", "select doc_id, text from documents")
def inserts(t):
    rows = t.documents.select("doc_id", F.concat("text", F.lit("\0")).alias("text"))
    store = shared_folder(rows.sparkSession, "inserts")
    stores.insert_rows(rows.limit(1), stores.versioned(store, "1"))  # a feature: what an older version of the store holds is gone
    stores.insert_rows(rows, stores.versioned(store, "2"))
    return rows.sparkSession.read.parquet(stores.versioned(store, "2"))


@query("src26_udf5_tools", "select doc_id, 'docs' tool, 'en' as query from documents where lang = 'en' and n_chars > 100 union all select page_id, 'pages', 'en' from pages where contains(url, '/en/')")
def tools(t):
    extension.TOOLS.pop("docs", None), extension.TOOLS.pop("pages", None)

    @extension.register(extension.TOOLS, "docs")
    def docs(queries):
        return t.documents.where("n_chars > 100").join(F.broadcast(queries), F.col("lang") == F.col("query")).select("doc_id", "query")

    @extension.register(extension.TOOLS, "pages")
    def pages(queries):
        return t.pages.join(F.broadcast(queries), F.contains("url", F.concat(F.lit("/"), "query", F.lit("/")))).select(F.col("page_id").alias("doc_id"), "query")

    wanted = t.documents.sparkSession.createDataFrame([("en",)], "query string")
    return extension.run_tools(wanted, ["docs", "no such tool", "pages"])


@query("fil1_fil28_success", "select event_id, event_type <> 'error' and (value > 10 or user_id % 2 = 0) ok, event_type <> 'error' and case when user_id % 3 = 0 then value > 10 else user_id % 2 = 0 end streamed from events")
def success(t):
    status = F.when(F.col("event_type") != "error", 200).otherwise(500)
    got = F.when(F.col("value") > 10, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    said = F.when(F.col("user_id") % 2 == 0, "an answer").otherwise("  ")
    kind = F.when(F.col("user_id") % 3 == 0, "ONLY_LINKS").otherwise("LINKS_WITH_FINAL_SUMMARY")
    return t.events.select("event_id", rules.succeeded(status, got, said).alias("ok"), rules.stream_succeeded(kind, status, got, F.lit(None).cast("array<int>"), said).alias("streamed"))


def raw_posts(t):
    """A post of each event as JSON: every tenth lacks something or is broken."""
    k = F.col("event_id") % 10
    field = lambda name, v, missing: F.when(k != missing, F.concat(F.lit(f'"{name}": '), v, F.lit(", "))).otherwise("")
    n = F.col("value").cast("int").cast("string")
    body = F.concat(
        F.lit("{"), field("id", F.concat(F.lit('"'), F.col("event_id").cast("string"), F.lit('"')), 1), field("text", F.when(k == 2, '""').otherwise('"hi"'), 99), field("url", F.lit('"https://x.com/a"'), 3), field("created_at", F.lit('"Mon"'), 4),
        *(field(c, n, m) for c, m in (("reply_count", 99), ("retweet_count", 99), ("like_count", 5), ("quote_count", 99), ("bookmark_count", 99))), field("is_retweet", F.lit("null"), 6),
        F.lit('"is_quote_tweet": false'), F.when(k == 7, "").otherwise("}"),
    )
    web = F.concat(F.lit('{"title": "x", "link": "'), F.when(k == 8, "").otherwise("u"), F.lit('"'), F.when(k == 9, "").otherwise(', "snippet": "s"'), F.when(k == 7, "").otherwise("}"))
    return t.events.select("event_id", "user_id", body.alias("post"), web.alias("web"))


@query("fil9_fil10_schemas", "select event_id, event_id % 10 not in (1, 2, 3, 4, 5, 6, 7) post, event_id % 10 not in (7, 8, 9) web from events")
def schemas(t):
    return raw_posts(t).select("event_id", rules.valid_post("post").alias("post"), rules.valid_result("web").alias("web"))


@query("scr6_schema_penalty", "select user_id, round(avg(bad), 6) penalty from (select user_id, case when event_id % 10 in (1, 2, 3, 4, 5, 6, 7) then 1e0 else 0e0 end bad from events union all select user_id, case when event_id % 10 in (7, 8, 9) then 1e0 else 0e0 end from events) group by 1")
def schema_penalty(t):
    raw = raw_posts(t)
    valid = raw.select("user_id", rules.valid_post("post").alias("ok")).union(raw.select("user_id", rules.valid_result("web")))
    return evidence.share_of(valid, "user_id", ~F.col("ok"), "penalty").withColumn("penalty", F.round("penalty", 6))


@query("fil21_available", f"with {STATE_SQL} select uid from s where uid not in (select c_custkey from customer where c_custkey % 10 = 1)")
def available(t):
    return rules.available(states(t), "uid", t.customer.where("c_custkey % 10 = 1").select(F.col("c_custkey").alias("uid"))).select("uid")


@query("fil22_admission", "select c_custkey, case when c_mktsegment = 'MACHINERY' then 'blocked' when c_custkey % 5 = 0 then 'unregistered' when c_nationkey <> 3 and (c_acctbal < 20 or c_acctbal * 10 < 20000) then 'stake' when c_custkey % 7 = 0 then 'rate' end reason from customer")
def admission(t):
    k = F.col("c_custkey")
    registered = t.customer.where("c_custkey % 5 > 0").select(k.alias("known"), F.col("c_acctbal").cast("double").alias("alpha"), (F.col("c_acctbal") * 10).cast("double").alias("total"))
    rows = t.customer.join(registered, k == F.col("known"), "left")
    return rows.select("c_custkey", rules.refusal("c_mktsegment", ["MACHINERY"], F.col("known").isNotNull(), "alpha", "total", F.col("c_nationkey") != 3, k % 7 == 0).alias("reason"))


KEYS = ["Abcdefgh1234567!", "abcdefgh1234567!", "ABCDEFGH1234567!", "Abcdefghijklmno!", "Abcdefgh12345678", "Abc1!"]


@query("fil23_key_strength", "select c_custkey, c_custkey % 6 = 0 strong from customer")
def strength(t):
    key = F.element_at(F.array(*map(F.lit, KEYS)), (F.col("c_custkey") % 6 + 1).cast("int"))
    return t.customer.select("c_custkey", rules.strong_key(key).alias("strong"))


@query("fil25_differences", "select event_id, case when event_type = 'error' then 'a.b[1]' when user_id % 3 = 0 then 'c' when user_id % 5 = 0 then 'a.b' end path from events")
def differences(t):
    one = F.concat(F.lit('{"a": {"b": ['), F.col("user_id").cast("string"), F.lit(", 2]}}"))
    last, more = F.when(F.col("event_type") == "error", "3").otherwise("2"), F.when((F.col("event_type") != "error") & (F.col("user_id") % 5 == 0) & (F.col("user_id") % 3 > 0), ", 9").otherwise("")
    other = F.concat(F.lit('{"a": {"b": ['), F.col("user_id").cast("string"), F.lit(", "), last, more, F.lit(']}, "c": '), F.when(F.col("user_id") % 3 == 0, "1").otherwise("null"), F.lit("}"))
    return t.events.select("event_id", documents.first_difference(one, other).alias("path"))


@query("win15_weighted_combos", "select unnest(['fast', 'balanced', 'deep']) as mode, count(*) n, true tools, true result_types from customer")
def combos(t):
    """Whether the calls of each mode get its tools and result types in the shares it sets, to the call."""
    out = None
    for mode in ("fast", "balanced", "deep"):
        made = epoch.mode_combos(t.customer.select("c_custkey"), "c_custkey", mode)
        tools_, kinds, n = CONFIG.mode_tools[mode], CONFIG.result_types, F.count("*")
        near = lambda name, shares: sum((F.when(F.abs(F.count_if(F.col(name) == v) - n * w) <= 1, 1).otherwise(0) for v, w in shares.items()), F.lit(0)) == len(shares)
        row = made.agg(n.alias("n"), near("tool", tools_).alias("tools"), near("result_type", kinds).alias("result_types")).withColumn("mode", F.lit(mode))
        out = row if out is None else out.unionAll(row)
    return out


@query(
    "srt12_fresh_cache",
    """with w as (select 'u' || user_id || '/' || event_id % 400 k, max(ts) as "at" from events group by 1), f as (select * from w where "at" > timestamp '2024-01-28' - interval 20 day),
    n as (select count(*) n from f) select k, "at" from f, n qualify n.n < 2000 or row_number() over (order by "at" desc, k) <= n.n - 1000""",
)
def cache(t):
    key = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/"), (F.col("event_id") % 400).cast("string"))
    writes = t.events.select(key.alias("k"), F.col("ts").cast("timestamp").alias("at"))
    return rules.cached(writes, "k", "at", F.to_timestamp(F.lit("2024-01-28 00:00:00")), 20 * 86400)


@query("str28_templates", f"select doc_id, case when {hash_sql('doc_id')} % 100 < 20 then 'from:' || source when {hash_sql('doc_id')} % 100 < 35 then '$' || lang when {hash_sql('doc_id')} % 100 < 50 then '#' || lang else case cast(doc_id % 3 as int) when 0 then 'economy' when 1 then 'sport' else 'science' end end q from documents")
def templates(t):
    from ..operators.sampling import portable_hash

    topic = F.element_at(F.array(F.lit("economy"), F.lit("sport"), F.lit("science")), (F.col("doc_id") % 3 + 1).cast("int"))
    return t.documents.select("doc_id", rules.post_query(portable_hash(F.col("doc_id")) % 100, topic, "source", "lang", "lang").alias("q"))


@query("str33_udf7_prompts", "select doc_id, case when lang = 'en' then 'Write one question on ' || source || ' that a search of the web can answer. Angle: ' || lang || '.' else 'Write one question on ' || source || ' that needs several current sources. Angle: ' || lang || '.' end p, case when doc_id % 2 = 0 then 'Who is ' || source || '?' when lang = 'en' then 'What is the latest on ' || source || '?' else 'What do people say about ' || source || ', and why?' end q from documents")
def prompts(t):
    web = F.col("lang") == "en"
    answer = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("- Who is "), "source", F.lit("?  label: x"))).otherwise(" \n ")
    return t.documents.select("doc_id", rules.question_prompt("source", web, "lang").alias("p"), rules.question_or_fallback(answer, "source", web).alias("q"))


@query("str20_classes", "select page_id, case cast(page_id % 5 as int) when 0 then 'youtube' when 1 then 'youtube' when 2 then 'reddit' else 'default' end c, case when page_id % 5 = 2 then 'https://old.reddit.com/r/x/' || page_id when page_id % 5 = 0 then 'https://www.youtube.com/watch?x=' || page_id || '&v=dQw4w9WgXcQ' when page_id % 5 = 1 then 'https://youtu.be/dQw4w9WgXcQ?t=' || page_id when page_id % 5 = 3 then 'https://notreddit.com/' || page_id else url end u, case when page_id % 5 < 2 then 'dQw4w9WgXcQ' end v from pages")
def classes(t):
    i, k = F.col("page_id").cast("string"), F.col("page_id") % 5
    made = (
        F.when(k == 0, F.concat(F.lit("https://www.youtube.com/watch?x="), i, F.lit("&v=dQw4w9WgXcQ"))).when(k == 1, F.concat(F.lit("https://youtu.be/dQw4w9WgXcQ?t="), i))
        .when(k == 2, F.concat(F.lit("https://www.reddit.com/r/x/"), i)).when(k == 3, F.concat(F.lit("https://notreddit.com/"), i)).otherwise(F.col("url"))
    )
    u = t.pages.select("page_id", made.alias("m"))
    kind = text.url_class("m")
    return u.select("page_id", kind.alias("c"), text.fetch_url("m").alias("u"), F.when(kind == "youtube", text.video_id("m")).alias("v"))


@query("mth2_mth4_budgets", "with b as (select event_id, event_type, case event_type when 'view' then 5e0 when 'click' then 15e0 when 'purchase' then 30e0 else (user_id % 8) / 2e0 end budget, case event_type when 'view' then 15e0 when 'click' then 15e0 when 'purchase' then 30e0 else 15e0 end lim from events) select event_id, round(case when budget <= 0 then 1e0 else least(1e0, 3e-1 * budget) end, 6) low, budget, lim from b")
def budgets(t):
    mode = F.when(F.col("event_type") == "view", "fast").when(F.col("event_type") == "click", "balanced").when(F.col("event_type") == "purchase", "deep")
    b = numeric.scoring_budget(mode, (F.col("user_id") % 8) / 2)
    return t.events.select("event_id", F.round(numeric.least_time(b), 6).alias("low"), b.alias("budget"), numeric.request_limit(mode).alias("lim"))


@query("arr9_last_place", "select o_orderkey, case cast(o_orderkey % 4 as int) when 0 then 3 when 1 then 2 when 2 then 1 end place from orders")
def last_place(t):
    k = F.col("o_orderkey") % 4
    a, keys = F.lit("a"), F.array(F.when(F.col("o_orderkey") % 4 < 3, "a").otherwise("b"), F.when(F.col("o_orderkey") % 4 < 2, "a").otherwise("b"), F.when(k == 0, "a").otherwise("b"))
    return t.orders.select("o_orderkey", arrays.last_index(keys, a).alias("place"))


@query("arr13_headers", "select n_nationkey, n_name as ip, case when n_nationkey % 2 = 0 then n_regionkey::varchar end port, cast(case when n_nationkey % 2 = 0 then 2 else 1 end as int) n from nation")
def headers(t):
    m = rules.headers("head_axon_", {"ip": F.col("n_name"), "port": F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey"))})
    back = rules.from_headers(F.map_concat(m, F.create_map(F.lit("other"), F.lit("z"))), "head_axon_", ["ip", "port"])
    return t.nation.select("n_nationkey", back["ip"].alias("ip"), back["port"].alias("port"), F.size(m).alias("n"))


@query("scr18_applied", "select event_id, case when event_type = 'error' or user_id % 4 = 0 then 0e0 else round(value / 1e2, 6) end reward from events")
def applied(t):
    status = F.when(F.col("event_type") == "error", 500).otherwise(200)
    reward = F.when(F.col("user_id") % 4 == 0, F.lit(float("nan"))).otherwise(F.round(F.col("value") / 100, 6))
    return t.events.select("event_id", rules.applied(reward, status).alias("reward"))


@query(
    "scr20_udf3_penalty_sets",
    """with p as (select event_id, event_type, (event_id % 2) / 4e0 a, (event_id % 3) / 8e0 b, (event_id % 5) / 8e0 c, (event_id % 7) / 16e0 d from events)
    select event_id, round(case when event_type = 'view' then (1 - a) * (1 - b) * (1 - b) * (1 - c) * (1 - d) * (1 - a) * (1 - b) * (1 - c) * (1 - d) else (1 - b) * (1 - b) * (1 - c) * (1 - a) * (1 - b) * (1 - c) * (1 - d) end, 9) kept from p""",
)
def penalty_sets(t):
    k = F.col("event_id")
    a, b, c, d = (k % 2) / 4.0, (k % 3) / 8.0, (k % 5) / 8.0, (k % 7) / 16.0
    given = {"streaming": a, "timeout": b, "least_time": b, "count": c, "structure": d, "duplicates": a, "schema": b, "dates": c, "domains": d, "order": d}
    return t.events.select("event_id", F.round(rules.kept_share(F.when(F.col("event_type") == "view", "ai_search").otherwise("x_search"), given), 9).alias("kept"))


@query("udf6_judged", "select doc_id, case when lang = 'en' then 'Verdict: ' || case when length(source) % 2 = 0 then 'HIGH' else 'LOW' end else '' end answer, case when lang = 'en' and length(source) % 2 = 0 then 3e0 else 0e0 end score from documents")
def judged(t):
    def ask(prompts_: list[str]) -> list[str]:  # stands for an outside service
        return ["Verdict: " + ("HIGH" if len(p) % 2 == 0 else "LOW") for p in prompts_]

    p = t.documents.select("doc_id", F.when(F.col("lang") == "en", F.col("source")).alias("prompt"))
    return extension.judge(p, ask).select("doc_id", "answer", text.verdict_score("answer").alias("score"))


@query("udf1_udf2_plugins", "select event_id response_id, case when event_type = 'error' then 0e0 else least(1e0, value / 5e1) end quality, round(case when value < 1 then 0e0 else 1e0 end, 6) cheap, round(case when value < 1 then 0e0 else 1e0 end * case when event_id % 3 = 0 then 5e-1 else 1e0 end, 6) product from events")
def plugins(t):
    for kind, name in ((extension.REWARDS, "quality"), (extension.CHEAP, "least"), (extension.DEEP, "third")):
        kind.pop(name, None)
    extension.register(extension.REWARDS, "quality")(lambda r: r.where("event_type <> 'error'").select("response_id", (F.col("value") / 50).alias("reward")))
    extension.register(extension.CHEAP, "least")(lambda: F.when(F.col("value") < 1, 1.0).otherwise(0.0))
    extension.register(extension.DEEP, "third")(lambda r: r.where("response_id % 3 = 0").select("response_id", F.lit(0.5).alias("penalty")))
    rows = t.events.withColumnRenamed("event_id", "response_id")
    out = extension.with_penalties(extension.with_rewards(rows, ["quality"]), ["least"], ["third"])
    return out.select("response_id", "quality", F.round("cheap", 6).alias("cheap"), F.round("product", 6).alias("product"))


@query("dt7_local_times", "select event_id, date_trunc('second', ts) utc from events")
def local_times(t):
    """The offset of a post's time is overwritten, not converted: with any offset it is the same clock."""
    ts = F.date_trunc("second", F.col("ts").cast("timestamp"))
    form = F.concat(F.date_format(ts, "EEE MMM dd HH:mm:ss "), F.when(F.col("event_id") % 2 == 0, "+0000").otherwise("+0530"), F.date_format(ts, " yyyy"))
    return t.events.select("event_id", dates.local_post_time(form).alias("utc"))


@query("src7_src21_files", "select doc_id::varchar id, source question, lang as lane, 7 concurrency from documents where source <> ''")
def files(t):
    spark, folder = t.documents.sparkSession, shared_folder(t.documents.sparkSession, "files")
    lines = t.documents.select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("question"), F.col("lang").alias("lane"))).alias("value"))
    broken = spark.createDataFrame([('{"id": "x", "question": ',), ('{"id": "", "question": "q"}',), ("",)], "value string")
    lines.union(broken).write.text(f"{folder}/questions")
    spark.createDataFrame([('{"concurrency": 7, "other": 500}',)], "value string").coalesce(1).write.text(f"{folder}/config")
    conf = stores.read_config(spark, f"{folder}/config", {"concurrency": 3, "other": 5}).where("other = 5").select("concurrency")
    return stores.read_questions(spark, f"{folder}/questions").select("id", "question", "lane").crossJoin(F.broadcast(conf))


@query(
    "fil13_fil14_filter_votes",
    """with p as (select doc_id, text, source, lang, doc_id % 100 likes, doc_id % 7 replies, doc_id % 11 reposts, doc_id % 3 = 0 verified, doc_id % 4 = 0 quote, doc_id % 5 = 0 photo, timestamp '2024-01-01' + to_days(cast(doc_id % 30 as int)) as "at" from documents),
    v as (select *, [case when contains(lower(text), 'the') or contains(lower(source), 'the') then 1e0 else 0e0 end, case when doc_id % 2 = 0 then case when likes >= 50 then 1e0 else 0e0 end end, case when doc_id % 2 = 0 then case when reposts >= 5 then 1e0 else 0e0 end end,
      case when doc_id % 2 = 0 then case when replies >= 3 then 1e0 else 0e0 end end, case when source = 'web' then 1e0 else 0e0 end, case when verified then 1e0 else 0e0 end, case when doc_id % 2 = 1 then case when quote then 1e0 else 0e0 end end, case when lang = 'en' then 1e0 else 0e0 end,
      case when doc_id % 2 = 1 then case when verified then 1e0 else 0e0 end end, case when photo then 1e0 else 0e0 end, case when doc_id % 2 = 1 then case when photo then 0e0 else 0e0 end end, case when "at" >= timestamp '2024-01-08' then 1e0 else 0e0 end, case when "at" <= timestamp '2024-01-20' then 1e0 else 0e0 end] a from p)
    select doc_id, round(list_avg(a), 6) vote from v""",
)
def votes(t):
    k = F.col("doc_id")
    even = k % 2 == 0
    said = F.concat(F.lit("the cats from:web since:2024-01-08 until:2024-01-20 lang:en filter:verified filter:images "), F.when(even, "min_faves:50 min_retweets:5 min_replies:3").otherwise("filter:blue_verified filter:quote filter:videos min_faves:many"))
    o = evidence.parse_operators(said)
    day = lambda c: F.to_timestamp(c)
    flag = lambda c: F.when(c, True)
    query_ = {
        "words": F.lit("the"), "user": o["from"], "min_likes": o["min_faves"], "min_retweets": o["min_retweets"], "min_replies": o["min_replies"], "verified": flag(o["has_verified"]), "blue_verified": flag(o["has_blue_verified"]),
        "is_quote": flag(o["has_quote"]), "is_image": flag(o["has_images"]), "is_video": flag(o["has_videos"]), "start": day(o["since"]), "end": day(o["until"]), "lang": o["lang"],
    }
    post = {
        "text": F.col("text"), "username": F.col("source"), "name": F.lit("A name"), "like_count": k % 100, "retweet_count": k % 11, "reply_count": k % 7, "verified": k % 3 == 0, "is_blue_verified": k % 3 == 0, "is_quote_tweet": k % 4 == 0,
        "media_types": F.when(k % 5 == 0, F.array(F.lit("photo"))), "at": F.to_timestamp(F.lit("2024-01-01")) + F.make_interval(days=(k % 30).cast("int")), "lang": F.col("lang"),
    }
    return t.documents.select("doc_id", F.round(arrays.vote_mean(F.array(*rules.filter_votes(query_, post))), 6).alias("vote"))


def _post(seed):
    """A post made of an order's row; ``seed`` 1 differs from 0 in some fields of some rows."""
    k = F.col("o_orderkey")
    bent = lambda n, v, other: F.when((k % n == 0) & F.lit(bool(seed)), other).otherwise(v)
    s = k.cast("string")
    user = F.struct(
        *(F.concat(F.lit(c), (k % 50).cast("string")).alias(c) for c in rules.USER_EXACT if c not in ("verified", "can_dm", "can_media_tag", "is_blue_verified", "location")), F.lit(True).alias("verified"), F.lit(False).alias("can_dm"), F.lit(True).alias("can_media_tag"),
        bent(13, F.lit(True), F.lit(False)).alias("is_blue_verified"), bent(17, F.lit("here"), F.lit("there")).alias("location"), bent(5, F.lit(100), F.lit(170)).alias("followers_count"), F.lit(3).alias("media_count"), bent(19, F.lit(20), F.lit(None).cast("int")).alias("statuses_count"), F.lit("{}").alias("entities"),
    )
    counts = [bent(3, F.lit(n), F.lit(n + 9)).alias(c) for n, c in enumerate(rules.POST_COUNTS)]
    quote = F.when(k % 2 == 0, F.struct(F.lit("q").alias("text"), *(bent(7, F.lit(n * 100), F.lit(n * 100 + 50 + 100 * n)).alias(c) for n, c in enumerate(rules.POST_COUNTS))))
    return F.struct(
        s.alias("id"), F.concat(F.lit("https://x.com/a/status/"), s).alias("url"), bent(11, F.lit("t"), F.lit("u")).alias("created_at"), (k % 2 == 0).alias("is_quote_tweet"), F.lit(False).alias("is_retweet"), s.alias("conversation_id"), F.lit(None).cast("string").alias("in_reply_to_status_id"),
        bent(23, F.lit("en"), F.lit("de")).alias("lang"), *counts, bent(29, F.concat(F.lit("Some &amp; text http://a.b/c "), s), F.lit("another")).alias("text"), bent(31, F.lit("9"), F.lit("8")).alias("quoted_status_id"), F.lit("e").alias("entities"), bent(37, F.lit("x"), F.lit("y")).alias("extended_entities"),
        F.array(F.struct(F.lit("u").alias("media_url"), bent(41, F.lit("photo"), F.lit("video")).alias("type"))).alias("media"), quote.alias("quote"), user.alias("user"),
    )


@query(
    "join1_scr14_truth_votes",
    """with p as (select o_custkey, o_orderkey k, 1 + 8 + 1 + 6 + 3 + 1 + 14 + 3 + 1 + case when o_orderkey % 2 = 0 then 6 else 0 end n from orders),
    w as (select *, case when k % 11 = 0 then 1 else 0 end + case when k % 23 = 0 then 1 else 0 end + case when k % 29 = 0 then 1 else 0 end + case when k % 31 = 0 then 1 else 0 end + case when k % 37 = 0 then 1 else 0 end + case when k % 41 = 0 then 1 else 0 end
      + case when k % 13 = 0 then 1 else 0 end + case when k % 17 = 0 then 1 else 0 end + case when k % 5 = 0 then 1 else 0 end + case when k % 19 = 0 then 1 else 0 end + case when k % 2 = 0 and k % 7 = 0 then 6 else 0 end wrong from p),
    m as (select o_custkey, k, case when k % 43 = 0 then 0e0 else 1 - wrong / n::double end v from w), c as (select o_custkey, avg(v) a, count(*) n, bool_or(k % 97 = 0) twice from m group by 1)
    select o_custkey, round(case when twice then 0e0 when o_custkey % 9 = 0 then 0e0 else a end, 6) accuracy, n from c""",
)
def truth(t):
    k = F.col("o_orderkey")
    true = t.orders.select("o_custkey", k.cast("string").alias("id"), _post(0).alias("t"), k.alias("k"))
    given = t.orders.where(k % 43 > 0).select("o_custkey", k.cast("string").alias("id"), _post(1).alias("g"))
    given = given.union(t.orders.where(k % 97 == 0).select("o_custkey", k.cast("string"), _post(1))).union(t.orders.where(k % 97 == 0).select("o_custkey", k.cast("string"), _post(1)))
    pairs = evidence.match_by_id(true, given, "o_custkey", "id").where(F.col("g").isNotNull() | ~F.col("matched")).dropDuplicates(["o_custkey", "id"])
    out = rules.content_accuracy(pairs, "o_custkey", rules.content_votes("g", "t"), F.col("matched"), F.col("o_custkey") % 9 == 0)
    return out.withColumn("accuracy", F.round("accuracy", 6))
