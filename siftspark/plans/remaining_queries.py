"""The other operators, one small query each."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays, dates, documents, numeric, text
from ..operators import epoch, evidence, logs, sampling, scoring
from ..sources import stores
from .capacity import STATE_SQL, hash_sql, states
from .evidence_queries import VERDICT_SQL, markdown, verdicts
from .log_queries import LOGS_SQL, log_rows
from .payouts import SCORED_SQL, scored
from .registry import query


@query("src2_filtered_map", f"with {STATE_SQL} select hotkey, count(*) n, max(declared) declared from s where lane = 'x_search' group by 1")
def filtered_map(t):
    m = states(t).where("lane = 'x_search'").groupBy("hotkey").agg(F.map_from_entries(F.collect_list(F.struct("uid", F.struct("quality_avg", "declared", "verified")))).alias("m"))
    return m.select("hotkey", F.size("m").cast("long").alias("n"), F.array_max(F.transform(F.map_values("m"), lambda s: s["declared"])).alias("declared"))


@query("src15_join17_probes", "select c_custkey uid, case when c_acctbal > 5000 then 'online' when c_acctbal > 0 then 'unknown' else 'offline' end state from customer")
def probes(t):
    status = F.when(F.col("c_acctbal") > 5000, 200).when(F.col("c_acctbal") > 0, 404)
    return t.customer.select(F.col("c_custkey").alias("uid"), stores.probe_state(status).alias("state"))


@query("src16_retry_ladder", "select source, 1 + (n_chars > 500)::int + (n_chars > 1500)::int attempt, count(*) n from documents group by all")
def ladder(t):
    todo, out = t.documents.select("doc_id", "source", "n_chars"), None
    for attempt, limit in ((1, 500), (2, 1500), (3, None)):
        got = todo if limit is None else todo.where(F.col("n_chars") <= limit)
        got = got.withColumn("attempt", F.lit(attempt))
        out = got if out is None else out.unionByName(got)
        todo = evidence.still_missing(todo, got.select("doc_id"), ["doc_id"])
    return out.groupBy("source", "attempt").agg(F.count("*").alias("n"))


@query("src17_fil17_posts", "select event_id::varchar id, null banner_url from events where event_type <> 'error'")
def mapped_posts(t):
    raw = t.events.select(F.col("event_id").cast("string").alias("id"), F.lit("t").alias("text"), F.when(F.col("event_type") != "error", "u").otherwise("").alias("url"), F.lit("d").alias("createdAt"), F.lit(1).alias("likeCount"), F.lit(1).alias("retweetCount"), F.lit(1).alias("replyCount"), F.lit("").alias("bannerUrl"), F.lit(None).cast("boolean").alias("noResults"))
    return stores.map_posts(raw).select("id", "banner_url")


@query("src18_search_filters", "select event_id from events where event_type = 'view' and value >= 20 and user_id in (1, 2, 3)")
def search(t):
    return logs.optional_filters(t.events, event_type="view", user_id=[1, 2, 3], props=None).where("value >= 20").select("event_id")


@query("src20_complete_results", "select page_id, regexp_extract(url, '//([^/?#:]+)', 1) title, '' snippet from pages where url <> ''")
def results(t):
    return t.pages.where("url <> ''").select("page_id", text.url_host("url").alias("title"), F.coalesce(F.lit(None).cast("string"), F.lit("")).alias("snippet")).where("title is not null")


@query("src23_events", """select conv_id, turn, '{"type":"text","content":"' || role || '"}' e from conversations""")
def stream_events(t):
    from ..streaming.framing import event

    return t.conversations.select("conv_id", "turn", event("text", F.col("role")).alias("e"))


@query("src25_by_ids", "select event_id from events semi join (select distinct l_orderkey k from lineitem) on event_id = k")
def by_ids(t):
    urls = t.lineitem.select(F.concat(F.lit("https://x.com/a/status/"), F.col("l_orderkey").cast("string")).alias("u"))
    ids = urls.select(text.post_id("u").cast("long").alias("event_id")).where("event_id is not null").distinct()
    return t.events.join(ids, "event_id", "left_semi").select("event_id")


@query("fil3_set4_tools", "select doc_id, lang in ('en', 'fr') web, lang = 'de' posts from documents")
def tool_sets(t):
    mine = F.array("lang")
    return t.documents.select("doc_id", F.arrays_overlap(mine, F.array(F.lit("en"), F.lit("fr"))).alias("web"), F.array_contains(mine, "de").alias("posts"))


@query("fil5_blocked_dates", "select o_orderkey, o_orderstatus <> 'P' and o_orderdate > timestamp '1997-01-01' blocked from orders")
def blocked(t):
    at = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("timestamp"))
    return t.orders.select("o_orderkey", dates.blocked_date(at, F.lit(None).cast("timestamp"), F.to_timestamp(F.lit("1997-01-01 00:00:00"))).alias("blocked"))


@query("fil8_post_links", "select event_id, event_type <> 'view' ok from events")
def post_links(t):
    user = F.when(F.col("event_type") == "view", "TheAdmin").otherwise("some_user")
    return t.events.select("event_id", text.valid_post_url(F.concat(F.lit("https://x.com/"), user, F.lit("/status/"), F.col("event_id").cast("string"))).alias("ok"))


@query("fil15_lane_gate", f"with {STATE_SQL} select uid, declared > 0 and quality_avg >= 6e-1 open from s")
def lane_gate(t):
    return states(t).select("uid", ((F.col("declared") > 0) & (F.col("quality_avg") >= 0.6)).alias("open"))


@query("fil19_dropped_keys", """select event_id, '{"a":1,"b":{"c":[{"d":' || user_id || '}]}}' j from events""")
def dropped(t):
    j = F.concat(F.lit('{"a": 1, "html": "x", "b": {"html": 2, "c": [{"d": '), F.col("user_id").cast("string"), F.lit(', "html": null}]}}'))
    return t.events.select("event_id", documents.drop_keys(j, ("html",)).alias("j"))


@query("fil27_normal_posts", "select event_id, ['https://x.com/p' || event_id] media, null counts from events")
def normal(t):
    q = F.struct(F.lit("x").alias("text"), F.lit(3).alias("counts"))
    media = F.array(F.concat(F.lit("https://twitter.com/p"), F.col("event_id").cast("string")))
    return t.events.select("event_id", F.transform(media, lambda m: F.replace(m, F.lit("twitter.com"), F.lit("x.com"))).alias("media"), arrays.masked(q, {"counts": F.lit(None).cast("int")}).getField("counts").alias("counts"))


@query("fil29_fil30_rows", "select s_suppkey, case when s_acctbal > 0 then s_name else 'checker-' || s_suppkey end as name, null mode from supplier")
def rows_(t):
    named = F.coalesce(F.when(F.col("s_acctbal") > 0, F.col("s_name")), F.concat(F.lit("checker-"), F.col("s_suppkey").cast("string")))
    return t.supplier.select("s_suppkey", named.alias("name"), F.nullif(F.lit(""), F.lit("")).alias("mode"))


@query("join4_sampled_bodies", f"with r as (select doc_id, source, row_number() over (partition by source order by {hash_sql('doc_id')}, doc_id) k from documents) select source, doc_id, length(text) n from r join documents using (doc_id, source) where k <= 3")
def sampled_bodies(t):
    s = sampling.uniform_sample(t.documents.select("doc_id", "source"), "source", "doc_id", 3)
    return s.join(t.documents.select("doc_id", "text"), "doc_id").select("source", "doc_id", F.length("text").alias("n"))


@query("join10_includes", "select o_orderkey, c_name author, count(l_linenumber) media from orders left join customer on c_custkey = o_custkey left join lineitem on l_orderkey = o_orderkey group by all")
def includes(t):
    media = t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("m"))
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(media, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select("o_orderkey", F.col("c_name").alias("author"), arrays.size0("m").cast("long").alias("media"))


@query("agg8_vote_means", "select event_id, case when event_type = 'view' then case when value > 50 then 1e0 else 5e-1 end when value > 50 then 1e0 else 0e0 end vote from events")
def vote_means(t):
    v = F.array(F.when(F.col("event_type") == "view", True), F.col("value") > 50)
    return t.events.select("event_id", arrays.vote_mean(v).alias("vote"))


@query("agg9_ratios", "select user_id, round(avg(case when event_type = 'error' then 1e0 else 0e0 end), 6) share from events group by 1")
def ratios(t):
    return evidence.share_of(t.events, "user_id", F.col("event_type") == "error").withColumn("share", F.round("share", 6))


@query("agg10_worst_group", "select user_id, greatest(0e0, 1 - count(*) filter (event_type = 'view') / 2e1, 1 - count(*) filter (event_type = 'click') / 1e1) worst from events group by 1")
def worst(t):
    g = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("v"), F.count_if(F.col("event_type") == "click").alias("c"))
    return g.select("user_id", evidence.worst_shortfall([(F.lit(True), F.col("v"), F.lit(20)), (F.lit(True), F.col("c"), F.lit(10))]).alias("worst"))


@query("agg15_ordered_distinct", "select conv_id, list(role order by f) roles from (select conv_id, role, min(turn) f from conversations group by all) group by 1")
def ordered_distinct(t):
    return t.conversations.groupBy("conv_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda s: s["role"])).alias("roles"))


@query("agg22_merged_tools", "select conv_id, coalesce(list(text order by turn) filter (role = 'user'), []) as \"user\", coalesce(list(text order by turn) filter (role = 'tool'), []) tool, arg_min(text, turn) filter (role = 'user' and text <> '') summary from conversations where role in ('user', 'tool') group by 1")
def merged_tools(t):
    p = t.conversations.withColumn("links", F.array("text")).withColumn("summary", F.when(F.col("role") == "user", F.col("text")))
    return epoch.merge_by_tool(p, "conv_id", "role", "turn", ["user", "tool"])


@query("win1_pool_shares", f"with {SCORED_SQL} select epoch, lane, uid, round(volume / sum(volume) over (partition by epoch, lane) + 1e-9, 6) share from lanes")
def pool_shares(t):
    l = scoring.lane_means(scored(t), ["epoch", "lane", "uid"])
    return l.select("epoch", "lane", "uid", F.round(F.col("volume") / F.sum("volume").over(Window.partitionBy("epoch", "lane")) + 1e-9, 6).alias("share"))


@query(
    "win9_random_remainder",
    f"""with c as (select user_id, count(*) n from events group by 1), q as (select *, n * 1e2 / (select sum(n) from c) x from c), f as (select *, floor(x + 1e-9) w, greatest(x - floor(x + 1e-9), 0) r from q),
    d as (select *, row_number() over (order by round(case when r > 1e-9 then -ln(({hash_sql('user_id')} + 1) / 2147483648e0) / r end, 9) nulls last, user_id) k from f)
    select user_id, n, cast(w + case when k <= 100 - (select sum(w) from f) then 1 else 0 end as bigint) slots from d""",
)
def random_remainder(t):
    return epoch.random_remainder(t.events.groupBy("user_id").agg(F.count("*").alias("n")), "user_id", "n", 100)


@query("win14_final_weights", f"with {SCORED_SQL}, m as (select uid, sum(q) ema from lanes group by 1 having sum(q) > 0), l as (select uid, ema / (select sum(ema) from m) w from m), x as (select sum(w) a, sum(w) filter (uid = 2) b from l) select uid, round(case when b is null then w when uid = 2 then a / 2 else w / (a - b) * a / 2 end + 1e-11, 8) weight from l, x")
def final(t):
    m = scoring.lane_means(scored(t), ["epoch", "lane", "uid"]).groupBy("uid").agg(F.sum("q_gate").alias("ema"))
    return epoch.final_weights(m, 2).select("uid", F.round(F.col("weight") + 1e-11, 8).alias("weight"))


@query("srt2_group_order", f"with {LOGS_SQL} select distinct epoch, uid, search_type, query from logs order by epoch desc, uid nulls last, search_type, query")
def group_order(t):
    return log_rows(t).select("epoch", "uid", "search_type", "query").distinct().orderBy(F.desc("epoch"), F.asc_nulls_last("uid"), "search_type", "query")


@query("srt5_srt6_sorted", f"with {STATE_SQL} select uid, quality_avg from s order by quality_avg, uid")
def sorted_(t):
    return states(t).select("uid", "quality_avg").orderBy("quality_avg", "uid")


@query("srt7_numbered", "select conv_id, k as n, text from (select conv_id, text, row_number() over (partition by conv_id order by turn) k from conversations) where k <= 20")
def numbered(t):
    listed = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), 1, 20)
    return t.conversations.groupBy("conv_id").agg(listed.alias("x")).select("conv_id", F.posexplode("x").alias("p", "text")).select("conv_id", (F.col("p") + 1).cast("long").alias("n"), "text")


@query("srt11_lane_sample", f"select doc_id from documents where lang = 'fr' order by {hash_sql('doc_id')}, doc_id limit 10")
def lane_sample(t):
    return t.documents.where("lang = 'fr'").orderBy(sampling.portable_hash(F.col("doc_id")), "doc_id").limit(10).select("doc_id")


@query("set5_membership", "select doc_id, l.doc_id is not null labelled from documents d left join labels l using (doc_id)")
def membership(t):
    return t.documents.select("doc_id").join(t.labels.select("doc_id", F.lit(True).alias("labelled")), "doc_id", "left").withColumn("labelled", F.coalesce("labelled", F.lit(False)))


@query("set6_touched", "select distinct user_id from events where event_type in ('view', 'click')")
def touched(t):
    a, b = (t.events.where(F.col("event_type") == x).select("user_id") for x in ("view", "click"))
    return a.union(b).distinct().orderBy("user_id")


@query("str7_clean", r"select doc_id, trim(regexp_replace(regexp_replace(text, '[^\p{L}\p{M}\p{N}_\s,]', '', 'g'), '\s+', ' ', 'g')) c from documents")
def clean(t):
    return t.documents.select("doc_id", text.clean_text("text").alias("c"))


@query("str23_labels", f"with {VERDICT_SQL} select doc_id, case when v like '%HIGH' then 'HIGH' else 'LOW' end label from v")
def verdict_labels(t):
    return verdicts(t).select("doc_id", text.verdict_label("v").alias("label"))


@query("mth6_clamped", "select event_id, case when event_type = 'error' then 0e0 else least(1e0, value / 5e1) end c from events")
def clamped(t):
    v = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value") / 50)
    return t.events.select("event_id", numeric.clamp(numeric.nan_to_zero(v)).alias("c"))


@query("arr2_arr5_groups", "select n_nationkey, [n_name, 'x'] as links, false video, 2 n from nation")
def link_groups(t):
    groups = F.array(F.array("n_name"), F.array(F.lit("x")))
    media = F.array(F.struct(F.lit("photo").alias("type")))
    return t.nation.select("n_nationkey", F.flatten(groups).alias("links"), F.exists(media, lambda m: F.coalesce(m["type"], F.lit("")) == "video").alias("video"), arrays.size0(F.flatten(groups)).alias("n"))


@query("arr11_arr12_entries", """select n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' e, n_regionkey raw from nation""")
def entries(t):
    m = F.map_from_arrays(F.array(F.lit("x_raw"), F.lit("y")), F.array("n_regionkey", F.lit(0).cast("long")))
    return t.nation.select("n_nationkey", F.to_json(F.struct("n_nationkey", "n_name")).alias("e"), F.map_filter(m, lambda k, v: F.endswith(k, F.lit("_raw")))["x_raw"].alias("raw"))


@query("arr14_manifest", "select n_nationkey, m as mode, case when m = 'fast' then cast(n_nationkey as integer) else 1 end n from nation, (select unnest(['fast', 'balanced', 'deep']) m)")
def manifest(t):
    m = F.create_map(F.lit("fast"), F.col("n_nationkey").cast("int"))
    return t.nation.select("n_nationkey", F.explode(F.array(*map(F.lit, ("fast", "balanced", "deep")))).alias("mode"), m.alias("m")).select("n_nationkey", "mode", F.coalesce(F.try_element_at("m", F.col("mode")), F.lit(1)).alias("n"))


@query("scr7_order_penalty", "select user_id, case when bool_or(coalesce(p < ts, false)) then 1e0 else 0e0 end penalty from (select user_id, ts, lag(ts) over (partition by user_id order by event_id) p from events) group by 1")
def order_penalty(t):
    return evidence.out_of_order(t.events, "user_id", "event_id", "ts").select("user_id", F.when(F.col("unordered"), 1.0).otherwise(0.0).alias("penalty"))


@query("scr10_scr5_timing", "select event_id, round(least(case when value > 50 then least(ceil(value - 50) / 5e0, 1e0) else 0e0 end + case when value < 1 then 1e0 else 0e0 end, 1e0), 6) penalty from events")
def timing(t):
    late = numeric.timeout_penalty("value", F.lit(50.0), F.lit(40.0))
    return t.events.select("event_id", F.round(F.least(late + F.when(F.col("value") < numeric.least_time(F.lit(None).cast("double")), 1.0).otherwise(0.0), F.lit(1.0)), 6).alias("penalty"))


@query("scr21_performance", "select event_id, round(case when event_type = 'error' then 0e0 when value / 10 < 1 or value / 10 >= 8 then 0e0 when value / 10 <= 3 then 1e0 else (8 - value / 10) / 5 end + 1e-9, 6) p from events")
def performances(t):
    secs = F.when(F.col("event_type") != "error", F.col("value") / 10)
    return t.events.select("event_id", F.round(numeric.performance(secs, F.lit(None).cast("double")) + 1e-9, 6).alias("p"))


@query("scr22_links_request", "select conv_id, coalesce(list(text order by turn) filter (role = 'assistant'), []) assistant from conversations where role = 'assistant' group by 1")
def links_request(t):
    p = t.conversations.withColumn("links", F.array("text")).withColumn("summary", F.lit(None).cast("string"))
    return epoch.merge_by_tool(p, "conv_id", "role", "turn", ["assistant"]).select("conv_id", "assistant")


@query("stm8_failure_lanes", "select user_id uid, m as mode, count(*) n from events, (select unnest(['fast', 'deep']) m) where event_type = 'error' and (value > 50 or m = 'fast') group by all")
def failure_lanes(t):
    calls = t.events.where("event_type = 'error'").select(F.col("user_id").alias("uid"), F.lit("ai").alias("search_type"), F.when(F.col("value") <= 50, "fast").alias("mode"))
    return epoch.fan_out_failures(calls, ["fast", "deep"]).groupBy("uid", "mode").agg(F.count("*").alias("n"))


@query("stm13_eligible", "select event_id, epoch(date_trunc('second', ts)) - epoch(date_trunc('hour', ts)) <= 2400 ok from events")
def eligibles(t):
    ts = F.col("ts").cast("timestamp")
    return t.events.select("event_id", epoch.eligible(dates.hour(ts), ts, F.lit(1)).alias("ok"))


@query("stm14_epoch", f"with {SCORED_SQL}, g as (select *, least(1e0, greatest(0e0, (q - ((case when lane = 'x_search' then 6e-1 else 5e-1 end) - 5e-2)) / 5e-2)) gate from lanes where samples >= 3), w as (select *, gate * power(q, 3e0) * power(volume, 2e0) raw from g where gate > 0), s as (select uid, (case lane when 'ai_search:fast' then 54e-2 when 'x_search' then 1e-1 else 18e-2 end) * raw / sum(raw) over (partition by epoch, lane) pay from w), p as (select uid, sum(pay) p from s group by 1) select coalesce(c_custkey, p.uid) uid, round(case when c_custkey is null then 0 else 5e-1 end + coalesce(p, 0) / 2 + 1e-9, 6) ema from customer full join p on p.uid = c_custkey")
def epoch_job(t):
    averages = t.customer.select(F.col("c_custkey").alias("uid"), F.lit(1.0).alias("ema"))
    _, _, ema = epoch.run_epoch(scored(t), states(t), averages, F.lit(0.6))
    return ema.select("uid", F.round(F.col("ema") + 1e-9, 6).alias("ema"))


@query("stm19_routing", f"with {STATE_SQL} select uid, lane, round(case when unreachable_since is not null then 0e0 else power(greatest(quality_avg, 1e-1), 3e0) * power(verified, 2e0) end + 1e-7, 4) weight from s")
def routing(t):
    return epoch.routing_snapshot(states(t)).withColumn("weight", F.round(F.col("weight") + 1e-7, 4))
