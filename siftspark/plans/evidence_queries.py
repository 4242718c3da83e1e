"""Text, URL, date and evidence queries over documents, pages, conversations and orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays, dates, text
from ..operators import evidence, logs
from .registry import query

URL_SQL = r"regexp_replace(regexp_replace(lower(trim({0})), '^(https?://)www\.', '\1'), '/$', '')"


def url_sql(x: str) -> str:
    return URL_SQL.format(x)


@query("str1_source_url", f"select page_id, {url_sql('url')} u from pages")
def source_url(t):
    return t.pages.select("page_id", text.source_url("url").alias("u"))


@query("fil6_fil7_domains", r"with h as (select page_id, regexp_extract(url, '//([^/?#:]+)', 1) h from pages) select page_id, h = 'example.org' or ends_with(h, '.example.org') inside, not (h = 'example.org' or ends_with(h, '.example.org') or ends_with(h, '.example.net')) or starts_with(h, 'm.') and ends_with(h, '.example.net') and h = 'm.therly.example.net' violates from h")
def domains(t):
    include, exclude = F.array(F.lit("https://Example.org/"), F.lit("example.net.")), F.array(F.lit("m.therly.example.net"))
    return t.pages.select("page_id", evidence.in_domains(text.url_host("url"), F.array(F.lit("example.org"))).alias("inside"), evidence.domain_violation("url", include, exclude).alias("violates"))


@query("scr3_domain_penalty", r"select split_part(regexp_extract(url, '//([^/?#:]+)', 1), '.', 1) site, round(avg(case when ends_with(regexp_extract(url, '//([^/?#:]+)', 1), '.example.net') then 0e0 else 1e0 end), 6) penalty from pages group by 1")
def domain_penalty(t):
    bad = evidence.domain_violation("url", F.array(F.lit("example.net")), F.array().cast("array<string>"))
    return evidence.share_of(t.pages.withColumn("site", F.split(text.url_host("url"), r"\.")[0]), "site", bad, "penalty").withColumn("penalty", F.round("penalty", 6))


MD_SQL = "md as (select doc_id, '[' || lang || '](https://www.Site.org/' || source || '/) and [x](http://b.com/' || doc_id || '?a=1) ' || text m, text from documents)"


def markdown(t):
    m = F.concat(F.lit("["), "lang", F.lit("](https://www.Site.org/"), "source", F.lit("/) and [x](http://b.com/"), F.col("doc_id").cast("string"), F.lit("?a=1) "), "text")
    return t.documents.withColumn("m", m)


@query("str3_str5_links", rf"with {MD_SQL} select doc_id, regexp_extract_all(m, '\[([^\]]+)\]\(([^)]+)\)', 2) links, [{url_sql('x')} for x in regexp_extract_all(m, '\[([^\]]+)\]\(([^)]+)\)', 2)] cited from md")
def links(t):
    return markdown(t).select("doc_id", text.markdown_links("m").alias("links"), text.cited_urls("m").alias("cited"))


@query("str4_markdown_shape", r"select doc_id, trim(t) <> '' and not regexp_matches(t, '(?m)^#{1,6}\s') good from (select doc_id, case when n_chars > 1500 then '## ' else '' end || text t from documents)")
def shape(t):
    return t.documents.select("doc_id", text.good_markdown(F.concat(F.when(F.col("n_chars") > 1500, "## ").otherwise(""), "text")).alias("good"))


MATCH_SQL = r"left(regexp_replace(regexp_replace(ltrim(regexp_replace({0}, 'https?://\S+', '', 'g'), ' '), '^(?:@\w+\s+)+', ''), '\s+', '', 'g'), 280)"


@query("str6_match_text", "select doc_id, " + MATCH_SQL.format("'@a @b http://x.y/z ' || text") + " m from documents")
def match(t):
    return t.documents.select("doc_id", text.match_text(F.concat(F.lit("@a @b http://x.y/z "), "text")).alias("m"))


@query("str8_folded", r"select doc_id, regexp_replace(replace(replace(lower(text), 'ß', 'ss'), 'ς', 'σ'), '[^\p{L}\p{N}_]+', '', 'g') f from documents")
def folded(t):
    return t.documents.select("doc_id", text.fold_text("text").alias("f"))


@query("str9_domain", r"select page_id, regexp_extract(url, '//([^/?#:]+)', 1) d from pages")
def bare_domain(t):
    return t.pages.select("page_id", text.domain(F.regexp_replace("url", r"[?#].*$", "")).alias("d"))


@query("str10_str11_web_query", "select page_id, 'news about ' || page_id || ' (site:a.com OR site:b.org) -site:c.net lang:en' q, ['host' || page_id || '.com'] sites, 'find this' rest from pages")
def web(t):
    q = text.web_query(F.concat(F.lit("news about "), F.col("page_id").cast("string")), F.array(F.lit("A.com"), F.lit("https://b.org/x")), F.array(F.lit("c.net")), F.lit("lang:en"))
    made = F.concat(F.lit("find  site:Host"), F.col("page_id").cast("string"), F.lit(".com this"))
    return t.pages.select("page_id", q.alias("q"), text.site_operators(made).alias("sites"), text.without_site_operators(made).alias("rest"))


@query("str12_str13_posts", "select doc_id, case when doc_id % 2 = 0 then doc_id::varchar end id, case when doc_id % 2 = 0 then 'https://x.com/u' || doc_id || '/status/' || doc_id else 'https://x.com/u/status/' || source || '_' || doc_id || '/status/7' end u, doc_id % 2 = 0 valid from documents")
def posts(t):
    i = F.col("doc_id").cast("string")
    made = F.when(F.col("doc_id") % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("https://x.com/u/status/"), "source", F.lit("_"), i, F.lit("/status/7")))
    url = text.post_url(made, F.concat(F.lit("u"), i), i)
    return t.documents.select("doc_id", F.when(F.col("doc_id") % 2 == 0, text.post_id(url)).alias("id"), url.alias("u"), text.valid_post_url(url).alias("valid"))


VERDICT_SQL = "v as (select doc_id, case quality when 1 then 'It fits. Verdict: HIGH' when 0 then case when toxic = 1 then 'so Verdict - medium' else 'I say FAIL' end else 'score: 7.5 of it' end v from documents left join labels using (doc_id))"


def verdicts(t):
    v = F.when(F.col("quality") == 1, "It fits. Verdict: HIGH").when((F.col("quality") == 0) & (F.col("toxic") == 1), "so Verdict - medium").when(F.col("quality") == 0, "I say FAIL").otherwise("score: 7.5 of it")
    return t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left").withColumn("v", v)


@query("str22_str24_verdicts", f"with {VERDICT_SQL} select doc_id, case when v like '%HIGH' then 3e0 when v like '%medium' then 15e-1 else 0e0 end score, case when v like '%HIGH' then 'HIGH' else 'LOW' end label, case when v like 'score%' then 75e-1 else 0e0 end number from v")
def verdict(t):
    return verdicts(t).select("doc_id", text.verdict_score("v").alias("score"), text.verdict_label("v").alias("label"), text.number_score("v").alias("number"))


@query("str15_str31_labels", "select doc_id, case when length(source || '-' || doc_id) <= 10 then source || '-' || doc_id else left(source || '-' || doc_id, 6) || '…' || right(source || '-' || doc_id, 4) end label, 'verdict- x' safe from documents")
def labels(t):
    k = F.concat("source", F.lit("-"), F.col("doc_id").cast("string"))
    return t.documents.select("doc_id", text.short_label(k).alias("label"), text.sanitize_verdicts(F.lit("Verdict : x")).alias("safe"))


@query("str30_request_text", "select doc_id, case lang when 'en' then text when 'fr' then source when 'de' then doc_id::varchar else 'a, b' end r from documents")
def requests(t):
    on = lambda x, v: F.when(F.col("lang") == x, v)
    urls = on("es", F.array(F.lit("a"), F.lit("b")))
    return t.documents.select("doc_id", text.request_text(on("en", F.col("text")), on("fr", F.col("source")), on("de", F.col("doc_id").cast("string")), urls).alias("r"))


@query("str27_questions", "select doc_id, 'Who is ' || source || '?' q from documents")
def questions(t):
    return t.documents.select("doc_id", text.clean_question(F.concat(F.lit('\n  - "Who  is '), "source", F.lit('" intent: x\nmore'))).alias("q"))


@query("agg16_agg18_text_dedup", "select doc_id from (select doc_id, row_number() over (partition by " + MATCH_SQL.format("text") + " order by doc_id) r from documents) where r = 1")
def text_dedup(t):
    return logs.first_wins(t.documents.withColumn("m", text.match_text("text")), ["m"], "doc_id").select("doc_id")


FOLD = r"regexp_replace(replace(replace(lower({0}), 'ß', 'ss'), 'ς', 'σ'), '[^\p{{L}}\p{{N}}_]+', '', 'g')"


@query("arr8_fil12_in_order", f"select doc_id, {FOLD.format('substr(text, 1, 40)')} <> '' and {FOLD.format('substr(text, 41)')} <> '' found, false strange from documents")
def ordered(t):
    a, b = F.substring("text", 1, 40), F.substring("text", 41, 10**9)
    return t.documents.select("doc_id", arrays.in_order(F.array(a, b), "text").alias("found"), arrays.in_order(F.array(F.concat(F.lit("no such"), a), b), "text").alias("strange"))


@query("agg21_role_text", "select conv_id, role, string_agg(text, '' order by turn) t, count(*) n from conversations group by all")
def role_text(t):
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"])
    return t.conversations.groupBy("conv_id", "role").agg(F.array_join(parts, "").alias("t"), F.count("*").alias("n"))


@query("stm15_stream_fold", "select conv_id, string_agg(text, '' order by turn) filter (role = 'user') appended, arg_max(text, turn) filter (role = 'assistant') replaced, arg_max(text, turn) last from conversations group by 1")
def fold(t):
    user, other = F.col("role") == "user", F.col("role") == "assistant"
    parts = F.transform(F.array_sort(F.collect_list(F.when(user, F.struct("turn", "text")))), lambda s: s["text"])
    appended = F.when(F.count_if(user) > 0, F.array_join(parts, ""))
    return t.conversations.groupBy("conv_id").agg(appended.alias("appended"), F.max_by("text", F.when(other, F.col("turn"))).alias("replaced"), F.max_by("text", "turn").alias("last"))


@query("win6_order_check", "select user_id, bool_or(coalesce(p < ts, false)) unordered from (select user_id, ts, lag(ts) over (partition by user_id order by event_id) p from events) group by 1")
def order_check(t):
    return evidence.out_of_order(t.events, "user_id", "event_id", "ts")


@query("scr1_count_penalty", "select o_orderkey, greatest(0e0, 1 - count(l_orderkey) / 5e0) penalty from orders left join lineitem on l_orderkey = o_orderkey group by 1")
def count_penalty(t):
    got = t.orders.select("o_orderkey").join(t.lineitem.select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_orderkey").agg(F.count("l_orderkey").alias("n"))
    return got.select("o_orderkey", evidence.worst_shortfall([(F.lit(True), F.col("n"), F.lit(5)), (F.lit(False), F.lit(0), F.lit(5))]).alias("penalty"))


@query("scr2_date_penalty", "select l_orderkey, round(avg(case when l_shipdate between o_orderdate and o_orderdate + interval 30 day then 0e0 else 1e0 end), 6) penalty from lineitem join orders on o_orderkey = l_orderkey group by 1")
def date_penalty(t):
    rows = t.lineitem.select("l_orderkey", "l_shipdate").join(t.orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("until", F.col("o_orderdate") + F.expr("interval 30 days"))
    return evidence.date_share(rows, "l_orderkey", "l_shipdate", "o_orderdate", "until").withColumn("penalty", F.round("penalty", 6))


@query("scr4_duplicate_penalty", "select source, count(*) > count(distinct nullif(lower(" + MATCH_SQL.format("text") + "), '')) duplicated from documents group by 1")
def duplicate_penalty(t):
    made = t.documents.withColumn("u", F.concat(F.lit("http://x/"), F.col("doc_id").cast("string")))
    return evidence.duplicates(made, "source", "u", "text")


@query("join7_outside_sources", "with o as (select distinct user_id, event_type from events where value > 50) select e.event_id from events e anti join o using (user_id, event_type)")
def outside(t):
    cited = t.events.withColumn("url", F.concat(F.lit("http://"), "event_type"))
    return evidence.outside_sources(cited.select("event_id", "user_id", "url"), cited.where("value > 50"), "user_id", "url").select("event_id")


@query("join8_join9_missing", "select source, count(*) missing from documents anti join labels using (doc_id) group by 1")
def missing(t):
    return evidence.still_missing(t.documents.select("doc_id", "source"), t.labels.select("doc_id"), ["doc_id"]).groupBy("source").agg(F.count("*").alias("missing"))


@query("join13_scr12_link_reward",
    "with j as (select source, d.doc_id, quality, n_chars from documents d join labels l using (doc_id)) select source, round(case when count(*) >= 2 then least(least(1e0, sum(case when n_chars < 300 then 0e0 else quality end) / (count(*) + 2)) * avg(case when n_chars > 1000 then 1e0 else 0e0 end), 1e0) else 0e0 end, 6) reward from j group by 1")
def link_reward(t):
    j = t.documents.select("doc_id", "source", "n_chars").join(t.labels, "doc_id").withColumn("links", F.count("*").over(Window.partitionBy("source")))
    rows = j.select("source", (F.col("quality") * 3.0).alias("s"), (F.col("n_chars") < 300).alias("blocked"), (F.col("n_chars") > 1000).alias("evident"), F.lit(2).alias("missing"), "links")
    return evidence.link_reward(rows, "source", "s", "blocked", "evident", "missing", "links").withColumn("reward", F.round("reward", 6))


@query("scr13_post_reward", "with j as (select source, quality, n_chars from documents join labels using (doc_id)) select source, round(case when count(*) >= 2 then least(1e0, sum(quality * 1e0) / 3 * avg(case when n_chars > 1000 then 1e0 else 0e0 end)) else 0e0 end, 6) reward from j group by 1")
def post_reward(t):
    j = t.documents.select("doc_id", "source", "n_chars").join(t.labels, "doc_id").withColumn("n", F.count("*").over(Window.partitionBy("source")))
    return evidence.post_reward(j.withColumn("s", F.col("quality") * 3.0).withColumn("m", F.col("n_chars") > 1000), "source", "s", "m", "n").withColumn("reward", F.round("reward", 6))


@query("scr15_scr17_routing", "select event_id, case when event_type = 'view' then 7e-1 when event_type = 'click' then 3e-1 else 0e0 end content, case when event_type <> 'view' then 1e0 when value > 50 then 0e0 when user_id > 3 then 1e0 else 0e0 end summary from events")
def routing(t):
    post, web_ = F.col("event_type") == "view", F.col("event_type") == "click"
    return t.events.select("event_id", evidence.routed(post, web_, F.lit(0.7), F.lit(0.3)).alias("content"), evidence.summary_default(post, F.col("user_id") > 3, F.col("value") > 50).alias("summary"))


@query("fil4_dt_dates", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.000Z') iso, date_trunc('minute', ts) m, ts between timestamp '2024-01-10' and timestamp '2024-01-20' inside, cast(floor((epoch(timestamp '2024-02-01') - epoch(date_trunc('second', ts))) / 300) as bigint) ticks from events")
def event_dates(t):
    ts = F.date_trunc("second", F.col("ts").cast("timestamp"))
    text_form = F.date_format(ts, "EEE MMM dd HH:mm:ss xx yyyy")
    parsed = dates.post_time(text_form)
    at = lambda s: F.to_timestamp(F.lit(s))
    return t.events.select("event_id", dates.iso_millis(parsed).alias("iso"), dates.minute(parsed).alias("m"), dates.in_range(F.col("ts").cast("timestamp"), at("2024-01-10 00:00:00"), at("2024-01-20 00:00:00")).alias("inside"), dates.ticks(parsed, at("2024-02-01 00:00:00"), 300).alias("ticks"))


@query("dt4_periods", "select o_orderkey, o_orderdate >= timestamp '1998-01-01' - interval 365 day recent from orders")
def periods(t):
    now = F.to_timestamp(F.lit("1998-01-01 00:00:00"))
    return t.orders.select("o_orderkey", (F.col("o_orderdate").cast("timestamp") >= dates.period_start(F.lit("PAST_YEAR"), now)).alias("recent"))


@query("arr15_lanes", "select event_id, 'ai:' || event_type lane, 'ai' t, event_type m from events")
def lanes(t):
    made = arrays.lane(F.lit("ai"), "event_type")
    return t.events.select("event_id", made.alias("lane"), arrays.lane_type(made).alias("t"), arrays.lane_mode(made).alias("m"))


@query("set1_set2_unions", "select distinct c_nationkey k from customer union select s_nationkey from supplier")
def unions(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("set3_difference", "select n_nationkey from nation where n_nationkey not in (select s_nationkey from supplier)")
def difference(t):
    return t.nation.join(t.supplier, F.col("n_nationkey") == F.col("s_nationkey"), "left_anti").select("n_nationkey")


@query("html_pages")
def html_pages(t):
    from ..sources.html import parse_pages

    return parse_pages(t.pages, "page_id", "url", "html")


@query("join3_sources", rf"select page_id, n from (select page_id, {url_sql('url')} k from pages) join (select {url_sql('url')} k, arg_max(length(html), page_id) n from pages group by 1) using (k)")
def sources(t):
    p = t.pages.select("page_id", F.lit(1).alias("r"), "url", F.length("html").cast("long").alias("n"))
    return evidence.join_sources(p.select("page_id", "r", "url"), p.withColumnRenamed("page_id", "place"), "r", "url", "place", ["n"]).select("page_id", "n")


@query("join2_first_match", "with g as (select user_id, event_type, arg_min(value, event_id) v from events group by all) select e.event_id, g.v from events e left join g using (user_id, event_type)")
def first_match(t):
    given = t.events.select("user_id", "event_type", F.col("event_id").alias("place"), F.col("value").alias("v"))
    return evidence.first_match(t.events.select("event_id", "user_id", "event_type"), given, "user_id", "event_type", "place").select("event_id", "v")


@query("fil24_tolerance", "select event_id, case when event_type = 'error' then false else abs(user_id - value) <= greatest(cast(trunc(value * 6e-1) as integer), 10) end near from events")
def tolerance(t):
    from ..functions.numeric import within_slack

    return t.events.select("event_id", within_slack(F.when(F.col("event_type") != "error", F.col("user_id")), F.col("value")).alias("near"))


@query("fil26_media", "select event_id, event_type <> 'error' same from events")
def media(t):
    kind = "array<struct<media_url:string,type:string>>"
    a = F.array(F.struct(F.lit("u").alias("media_url"), F.lit("photo").alias("type")))
    b = F.array(F.struct(F.lit("u").alias("media_url"), F.when(F.col("event_type") == "error", "video").otherwise("photo").alias("type")))
    return t.events.select("event_id", arrays.same_media(a.cast(kind), b.cast(kind)).alias("same"))


@query("arr1_all_values", "select conv_id, list(text order by turn) as texts from conversations group by 1")
def all_texts(t):
    w = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"])
    by_conv = t.conversations.groupBy("conv_id").agg(w.alias("x"))
    return by_conv.select("conv_id", arrays.all_values(F.create_map(F.lit("all"), "x")).alias("texts"))


@query("str21_joined", "select doc_id, lang || ' ' || source j from documents")
def joined(t):
    return t.documents.select("doc_id", text.joined_fields(F.col("lang"), F.lit("  "), F.lit(None).cast("string"), F.col("source")).alias("j"))


@query("str26_messages", """select doc_id, case when lang = 'en' then '[{"role":"system","content":"judge"},{"role":"user","content":"' || source || '"}]' end m from documents""")
def message(t):
    return t.documents.select("doc_id", text.messages(F.lit("judge"), F.when(F.col("lang") == "en", F.col("source")).otherwise("  ")).alias("m"))


@query("str25_str29_fills", "select doc_id, 'a  b' x, '{\"q\": \"' || source || '\" }' f from documents")
def fills(t):
    return t.documents.select("doc_id", text.without_names(F.lit("a Question b"), ["Question", "Quest"]).alias("x"), text.fix_query(F.concat(F.lit("{'q': '"), "source", F.lit("' has:polls}"))).alias("f"))
