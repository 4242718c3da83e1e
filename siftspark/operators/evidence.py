"""Provider results against independently collected evidence: joins, penalties, rewards.

Long form: a row for each response and item, with its place. Keys are column names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions import arrays, dates, text
from ..functions.numeric import clamp, nan_to_zero, within_slack
from .logs import first_wins


def match_by_id(checked: DataFrame, given: DataFrame, response: str, key: str) -> DataFrame:
    """Each checked item with the provider's of the same key; ``matched`` tells whether there is
    one. A provider that repeats a key has no match at all in that response."""
    counts = given.where(F.col(key).isNotNull()).groupBy(response, key).agg(F.count("*").alias("times_"))
    repeated = counts.where("times_ > 1").select(response, F.lit(True).alias("repeated_")).distinct()
    joined = checked.join(given.withColumn("there_", F.lit(True)), [response, key], "left").join(repeated, response, "left")
    return joined.withColumn("matched", F.coalesce("there_", F.lit(False)) & ~F.coalesce("repeated_", F.lit(False))).drop("there_", "repeated_")


def first_match(checked: DataFrame, given: DataFrame, response: str, key: str, place: str) -> DataFrame:
    """Each checked item with the first of the provider's with its key."""
    return checked.join(first_wins(given, [response, key], F.col(place)), [response, key], "left")


def join_sources(fetched: DataFrame, meta: DataFrame, response: str, url: str, place: str, fields: list[str]) -> DataFrame:
    """Fetched pages with the provider's last entry for the same normal URL."""
    last = first_wins(meta.withColumn("key_", text.source_url(url)), [response, "key_"], F.col(place).desc()).select(response, "key_", *fields)
    return fetched.withColumn("key_", text.source_url(url)).join(last, [response, "key_"], "left").drop("key_")


def cited_bodies(cited: DataFrame, links: DataFrame, posts: DataFrame, response: str, url: str, body: str) -> DataFrame:
    """Bodies of cited URLs: by source key among the links, else by post id; without a body dropped.
    Of one key the longest body stays, the first of equally long ones. The URL stays as cited."""
    some = F.col(body) != ""
    l = first_wins(links.where(some).withColumn("key_", text.source_key(url)), [response, "key_"], F.length(body).desc()).select(response, "key_", body)
    p = first_wins(posts.where(some & F.col("post_id").isNotNull()), [response, "post_id"], F.length(body).desc()).select(response, "post_id", body)
    c = cited.withColumn("key_", text.source_key(url))
    linked = first_wins(c, [response, "key_"], F.col(url)).join(l, [response, "key_"])
    # what has a link's body meets no posts, as bodies without a post id would all meet in one task
    rest = c.join(l.select(response, "key_"), [response, "key_"], "left_anti").withColumn("post_id", text.post_id(url)).where("post_id is not null").join(p, [response, "post_id"])
    return linked.unionByName(first_wins(rest, [response, "key_"], F.length(body).desc(), F.col(url)).drop("post_id")).drop("key_")


def outside_sources(cited: DataFrame, sources: DataFrame, response: str, url: str) -> DataFrame:
    """Cited URLs that aren't among the response's own sources."""
    key = text.source_url(url)
    return cited.withColumn("key_", key).join(sources.select(response, key.alias("key_")).distinct(), [response, "key_"], "left_anti").drop("key_")


def still_missing(wanted: DataFrame, fetched: DataFrame, key: list[str]) -> DataFrame:
    """What another attempt has to fetch."""
    return wanted.join(fetched, key, "left_anti")


def share_of(rows: DataFrame, response: str, hit: Column, name: str = "share") -> DataFrame:
    """The part of a response's rows where ``hit`` holds; 0 without rows."""
    return rows.groupBy(response).agg(F.coalesce(F.try_divide(F.count_if(hit).cast("double"), F.count("*")), F.lit(0.0)).alias(name))


def count_shortfall(got: Column, wanted: Column) -> Column:
    return F.when(wanted > 0, F.greatest(F.lit(0.0), 1 - got / wanted)).otherwise(0.0)


def worst_shortfall(pairs: list[tuple[Column, Column, Column]]) -> Column:
    """The largest shortfall of the groups that were asked for: (asked, got, wanted) each."""
    parts = [F.when(asked, count_shortfall(got, wanted)).otherwise(0.0) for asked, got, wanted in pairs]
    return F.greatest(F.lit(0.0), *parts, F.lit(0.0))


def date_share(rows: DataFrame, response: str, ts: str, start: str, end: str) -> DataFrame:
    """The part of dated rows outside the bounds; undated rows don't count, nor unbounded responses."""
    bounded = F.col(start).isNotNull() | F.col(end).isNotNull()
    dated = F.col(ts).isNotNull() & bounded
    return rows.groupBy(response).agg(F.coalesce(F.try_divide(F.count_if(dated & ~dates.in_range(ts, start, end)).cast("double"), F.count_if(dated)), F.lit(0.0)).alias("penalty"))


def in_domains(host: Column, wanted: Column) -> Column:
    """The host is one of the domains or below it; no host is in none."""
    return host.isNotNull() & F.exists(text.domains(wanted), lambda d: (host == d) | F.endswith(host, F.concat(F.lit("."), d)))


def domain_violation(url, include: Column, exclude: Column) -> Column:
    host = text.url_host(url)
    wanted, unwanted = arrays.size0(include) > 0, arrays.size0(exclude) > 0
    return (wanted & ~F.coalesce(in_domains(host, include), F.lit(False))) | (unwanted & F.coalesce(in_domains(host, exclude), F.lit(False)))


def out_of_order(rows: DataFrame, response: str, place: str, ts: str) -> DataFrame:
    """Whether a response's times ever rise, or one is missing; without rows there is none."""
    before = F.lag(ts).over(Window.partitionBy(response).orderBy(place))
    return rows.withColumn("rise_", F.col(ts).isNull() | (before < F.col(ts))).groupBy(response).agg(F.bool_or(F.coalesce("rise_", F.lit(False))).alias("unordered"))


def duplicates(rows: DataFrame, response: str, key: str, body: str | None = None) -> DataFrame:
    """Whether a response repeats a key, or a text once it is normalised; blanks don't count.

    Each response's keys are counted and grouped first, so that a response of any size is no list."""
    keys = [("key", F.nullif(text.source_key(key), F.lit("")))] + ([("text", F.nullif(F.lower(text.match_text(body)), F.lit("")))] if body else [])
    said = rows.select(response, F.explode(F.array(*(F.struct(F.lit(n).alias("kind_"), k.alias("value_")) for n, k in keys))).alias("x_")).select(response, "x_.*")
    times = said.groupBy(response, "kind_", "value_").agg(F.count("*").alias("times_"))
    return times.groupBy(response).agg(F.bool_or(F.col("value_").isNotNull() & (F.col("times_") > 1)).alias("duplicated"))


def streaming_penalty(responses: DataFrame, chunks: DataFrame, response: str, only_links: Column, tokens: str) -> DataFrame:
    """0.01 for each token of a streamed chunk beyond two, 1 at most; 1 for a response without
    chunks, and 0 for one that was asked for links alone. A chunk that is null has no tokens."""
    over = chunks.groupBy(response).agg(F.sum(F.greatest(F.coalesce(tokens, F.lit(0)) - CONFIG.chunk_tokens, F.lit(0))).alias("over_"))
    joined = responses.join(over, response, "left")
    return joined.select(response, F.when(only_links, 0.0).when(F.col("over_").isNull(), 1.0).otherwise(F.least(F.col("over_") * CONFIG.token_penalty, F.lit(1.0))).alias("penalty"))


def rule_penalty(rule: Column, summary: Column, score: Column) -> Column:
    """1 where a summary was to follow a rule and its judge gives less than 10; 0 where there is no
    rule or no summary."""
    there = lambda x: F.coalesce(x, F.lit("")) != ""
    return F.when(there(rule) & there(summary) & (score < 10), 1.0).otherwise(0.0)


def groundedness(responses: DataFrame, links: DataFrame, posts: DataFrame, response: str, summary: str, found: str, answer: str) -> DataFrame:
    """A summary's reward by its judge's verdict on the bodies it cites: HIGH 1, MEDIUM 0.5.

    It cites its links, or, if it has none, what the search ``found`` (an array of URLs). Without
    a summary, without anything cited, or without a body of it the reward is 0. ``links`` and
    ``posts`` as in cited_bodies, with the body in "body".
    """
    own = F.array_distinct(text.markdown_links(F.coalesce(summary, F.lit(""))))
    cited = responses.where(F.coalesce(summary, F.lit("")) != "").select(response, F.explode(F.when(F.size(own) > 0, own).otherwise(F.array_distinct(found))).alias("url"))
    bodies = cited_bodies(cited, links, posts, response, "url", "body").groupBy(response).agg(F.count("*").alias("bodies_"))
    joined = responses.join(bodies, response, "left")
    return joined.select(response, F.coalesce("bodies_", F.lit(0)).cast("long").alias("bodies"), F.when(F.col("bodies_") > 0, clamp(text.verdict_score(answer) / 3)).otherwise(0.0).alias("reward"))


def link_reward(judged: DataFrame, response: str, score: str, blocked: str, evident: str, uncited_missing: str, links: str) -> DataFrame:
    """Web relevance: scores (0..3) of the judged links over their number and the missing uncited
    ones, times the share with evidence; blocked links score 0; two links are needed."""
    total = judged.groupBy(response).agg(
        F.sum(F.when(F.col(blocked), 0.0).otherwise(nan_to_zero(score) / 3)).alias("sum_"), F.count("*").alias("n_"), F.avg(F.col(evident).cast("double")).alias("evidence_"), F.max(uncited_missing).alias("missing_"), F.max(links).alias("links_")
    )
    reward = F.least(clamp(F.col("sum_") / (F.col("n_") + F.col("missing_"))) * F.col("evidence_"), F.lit(1.0))
    return total.select(response, F.when(F.col("links_") >= 2, reward).otherwise(0.0).alias("reward"))


def post_reward(judged: DataFrame, response: str, score: str, matched: str, n: str) -> DataFrame:
    """Post relevance: scores over three at most, times the share that matches; two posts are needed."""
    total = judged.groupBy(response).agg(F.sum(nan_to_zero(score) / 3).alias("sum_"), F.avg(F.col(matched).cast("double")).alias("share_"), F.max(n).alias("n_"))
    return total.select(response, F.when(F.col("n_") >= 2, clamp(F.col("sum_") / CONFIG.sampled_links * F.col("share_"))).otherwise(0.0).alias("reward"))


def truth_votes(pairs: DataFrame, exact: list[str], numeric: list[str], matched: Column) -> Column:
    """The mean of the votes on each field; 0 where nothing matches. Columns a_x and b_x."""
    votes = [F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in exact] + [within_slack(F.col(f"a_{c}"), F.col(f"b_{c}")) for c in numeric]
    return F.when(matched, arrays.vote_mean(F.array(*votes))).otherwise(0.0)


def filter_votes(**votes: tuple[Column, Column]) -> Column:
    """Mean of the conditions whose filter is set: name=(is it set, does it hold)."""
    return arrays.vote_mean(F.array(*(F.when(is_set, holds) for is_set, holds in votes.values())))


OPERATORS = ("from", "min_faves", "min_retweets", "min_replies", "since", "until", "lang")


def parse_operators(query: Column) -> dict[str, Column]:
    """Search operators in a query's text; whole numbers where a number belongs, null else."""
    q = F.lower(F.coalesce(query, F.lit("")))
    out = {o: F.nullif(F.regexp_extract(q, rf"(?:^|\s){o}:(\S*)", 1), F.lit("")) for o in OPERATORS}
    out |= {o: out[o].try_cast("int") for o in OPERATORS if o.startswith("min_")}
    return out | {f"has_{f}": F.contains(q, F.lit(f"filter:{f}")) for f in ("verified", "blue_verified", "quote", "images", "videos")}


def summary_default(only_links: Column, has_links: Column, has_text: Column) -> Column:
    return F.when(~only_links, 1.0).when(has_text, 0.0).when(has_links, 1.0).otherwise(0.0)


def routed(has_posts: Column, has_web: Column, post: Column, web: Column) -> Column:
    return F.when(has_posts, post).when(has_web, web).otherwise(0.0)


def contained_pairs(bodies: DataFrame, highlights: DataFrame, body_id: str, body: str, highlight_id: str, highlight: str) -> DataFrame:
    """(body_id, highlight_id) of every folded body that contains a folded highlight; blank ones
    are in none.

    Bodies are cut into blocks of 16, 4 or 1 letters, and a highlight at least twice as long holds
    a whole block at one of as many offsets: both sides meet by these, and only what meets is
    compared.
    """
    b = bodies.select(F.col(body_id), text.fold_text(body).alias("body_"))
    h = highlights.select(F.col(highlight_id), text.fold_text(highlight).alias("highlight_")).where("highlight_ <> ''")
    h = h.withColumn("block_", F.when(F.length("highlight_") >= 31, 16).when(F.length("highlight_") >= 7, 4).otherwise(1))
    used = [r.block_ for r in h.select("block_").distinct().collect()] or [16]
    cut = lambda q: F.transform(F.array_distinct(F.regexp_extract_all("body_", F.lit(f"(?s).{{{q}}}"), F.lit(0))), lambda x: F.struct(F.lit(q).alias("block_"), x.alias("gram_")))
    cuts = F.flatten(F.array(*(cut(q) for q in used)))
    blocks = b.select(body_id, F.explode(cuts).alias("x_")).select(body_id, "x_.*")
    grams = h.select(highlight_id, "block_", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("block_")), lambda o: F.substring("highlight_", o, F.col("block_"))))).alias("gram_"))
    met = blocks.join(grams, ["block_", "gram_"]).select(body_id, highlight_id).distinct()
    return met.join(h, highlight_id).join(b, body_id).where(F.contains("body_", F.col("highlight_"))).select(body_id, highlight_id)
