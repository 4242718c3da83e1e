"""Admission, success, schema and filter rules over calls and posts; each takes and returns Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions import arrays
from ..functions.numeric import nan_to_zero, within_slack
from ..functions.text import _c, match_text
from .logs import first_wins


def _there(x) -> Column:
    return F.coalesce(F.trim(_c(x)), F.lit("")) != ""


def succeeded(status, results=None, text=None) -> Column:
    """Answered with 200, and with results (an array) or with a text that isn't blank."""
    got = (arrays.size0(results) > 0 if results is not None else F.lit(False)) | (_there(text) if text is not None else F.lit(False))
    return F.coalesce(_c(status) == 200, F.lit(False)) & got


def stream_succeeded(result_type, status, posts, links, completion) -> Column:
    """Asked for links alone, a stream succeeds with posts or links; else with a completion."""
    links_alone = _c(result_type) == "ONLY_LINKS"
    return F.when(links_alone, succeeded(status, posts) | succeeded(status, links)).otherwise(succeeded(status, text=completion))


def applied(reward, status) -> Column:
    """A reward as it counts: 0 for a failed call, and for NaN."""
    return F.when(_c(status) == 200, nan_to_zero(reward)).otherwise(0.0)


def strong_key(key) -> Column:
    """Sixteen characters at least, with a capital, a small letter, a digit and a sign."""
    k = F.coalesce(_c(key), F.lit(""))
    return (F.length(k) >= 16) & k.rlike("[A-Z]") & k.rlike("[a-z]") & k.rlike("[0-9]") & k.rlike("[^A-Za-z0-9]")


def available(candidates: DataFrame, uid: str, reserved: DataFrame) -> DataFrame:
    """Candidates but the reserved ones, such as that which takes the burnt share."""
    return candidates.join(reserved.select(uid).distinct(), uid, "left_anti")


def refusal(caller, blocked: list[str], registered, alpha, total, mainnet, limited) -> Column:
    """Why a request is refused, null if it isn't: the first of blocked caller, unknown caller, low
    stake (on the main network), too many requests. A stake that is unknown is too low."""
    low = (F.coalesce(_c(alpha), F.lit(0.0)) < CONFIG.least_alpha) | (F.coalesce(_c(total), F.lit(0.0)) < CONFIG.least_stake)
    return (
        F.when(_c(caller).isin(blocked), "blocked").when(~F.coalesce(_c(registered), F.lit(False)), "unregistered")
        .when(_c(mainnet) & low, "stake").when(F.coalesce(_c(limited), F.lit(False)), "rate")
    )


def cached(writes: DataFrame, key: str, at: str, now: Column, seconds: int = CONFIG.cache_seconds, entries: int = CONFIG.cache_entries) -> DataFrame:
    """What a cache still has of its writes: the last of each key, if it isn't older than
    ``seconds``; of more than ``entries`` the newest half of that number."""
    fresh = first_wins(writes, [key], F.col(at).desc()).where(F.col(at) > now - F.make_interval(secs=F.lit(seconds)))
    n = fresh.count()
    return fresh if n < entries else fresh.orderBy(F.col(at).desc(), key).limit(n - entries // 2)


def headers(prefix: str, fields: dict[str, Column]) -> Column:
    """Fields as a header map; nulls are left out."""
    full = F.map_from_entries(F.array(*(F.struct(F.lit(prefix + k).alias("k"), v.cast("string").alias("v")) for k, v in fields.items())))
    return F.map_filter(full, lambda k, v: v.isNotNull())


def from_headers(column, prefix: str, fields: list[str]) -> Column:
    """The fields of a header map whose names have the prefix."""
    return F.struct(*(F.try_element_at(_c(column), F.lit(prefix + k)).alias(k) for k in fields))


POST = (
    "id string, text string, url string, created_at string, reply_count long, view_count long, retweet_count long, like_count long, quote_count long, bookmark_count long, "
    "is_quote_tweet boolean, is_retweet boolean, _corrupt_record string"
)


def valid_post(raw) -> Column:
    """A JSON post with its counts as whole numbers, the keys of url and both flags, and an id, a
    text, a url and a time that aren't empty."""
    p = F.from_json(_c(raw), POST, {"mode": "PERMISSIVE"})
    full = [F.coalesce(p[c], F.lit("")) != "" for c in ("id", "text", "url", "created_at")]
    counts = [p[c].isNotNull() for c in ("reply_count", "retweet_count", "like_count", "quote_count", "bookmark_count")]
    keys = F.json_object_keys(_c(raw))
    ok = p["_corrupt_record"].isNull() & F.array_contains(keys, "is_quote_tweet") & F.array_contains(keys, "is_retweet")
    for part in full + counts:
        ok &= part
    return F.coalesce(ok, F.lit(False))


def valid_result(raw) -> Column:
    """A JSON search result with a title, a link and a snippet."""
    p = F.from_json(_c(raw), "title string, link string, snippet string, _corrupt_record string", {"mode": "PERMISSIVE"})
    ok = p["_corrupt_record"].isNull()
    for c in ("title", "link", "snippet"):
        ok &= F.coalesce(p[c], F.lit("")) != ""
    return F.coalesce(ok, F.lit(False))


def filter_votes(query: dict[str, Column], post: dict[str, Column]) -> list[Column]:
    """A vote (true or false; null where the filter isn't set) of a post on each filter of a query.

    query: words, user, min_likes, min_retweets, min_replies, verified, blue_verified, is_quote,
    is_image, is_video, start, end, lang; post: text, username, name, like_count, retweet_count,
    reply_count, verified, is_blue_verified, is_quote_tweet, media_types, at, lang. Words vote
    always: any of them anywhere in the text or in a name.
    """
    q, p = query, post
    texts = [F.lower(F.coalesce(p[k], F.lit(""))) for k in ("text", "username", "name")]
    said = F.lower(F.trim(F.coalesce(q["words"], F.lit(""))))
    votes = [(said == "") | F.exists(F.split(said, " "), lambda w: F.contains(texts[0], w) | F.contains(texts[1], w) | F.contains(texts[2], w))]
    for least, count in (("min_likes", "like_count"), ("min_retweets", "retweet_count"), ("min_replies", "reply_count")):
        votes.append(F.when(q[least].isNotNull(), F.coalesce(p[count] >= q[least], F.lit(False))))
    for wanted, have in (("user", "username"), ("verified", "verified"), ("is_quote", "is_quote_tweet"), ("lang", "lang"), ("blue_verified", "is_blue_verified")):
        votes.append(F.when(q[wanted].isNotNull(), q[wanted].eqNullSafe(p[have])))
    for wanted, kind in (("is_image", "photo"), ("is_video", "video")):
        votes.append(F.when(q[wanted].isNotNull(), q[wanted] == F.coalesce(F.array_contains(p["media_types"], kind), F.lit(False))))
    votes.append(F.when(q["start"].isNotNull(), F.coalesce(p["at"] >= q["start"], F.lit(False))))
    votes.append(F.when(q["end"].isNotNull(), F.coalesce(p["at"] <= q["end"], F.lit(False))))
    return votes


POST_EXACT = ("id", "url", "created_at", "is_quote_tweet", "is_retweet", "conversation_id", "in_reply_to_status_id", "lang")
POST_COUNTS = ("view_count", "reply_count", "retweet_count", "like_count", "quote_count", "bookmark_count")
USER_EXACT = (
    "id", "url", "name", "username", "created_at", "description", "profile_image_url", "profile_banner_url", "verified", "can_dm", "can_media_tag", "location",
    "pinned_tweet_ids", "is_blue_verified",
)
USER_COUNTS = ("followers_count", "media_count", "statuses_count")


def content_votes(given, truth) -> Column:
    """The votes of a post that was handed in against the true one, an array: the quoted id (let
    off where the true quote can't be seen), the exact fields, the text, counts within their
    slack, what is nested but counts, the quote's counts where both quote, media, and the user's
    fields. Structs with the fields of POST_EXACT, POST_COUNTS, text, quoted_status_id, entities,
    extended_entities, media, quote (has_quote, text, entities' place left out, POST_COUNTS) and
    user (USER_EXACT, USER_COUNTS, entities)."""
    g, t = _c(given), _c(truth)
    lost = F.coalesce(t["is_quote_tweet"], F.lit(False)) & t["quote"].isNull()
    votes = [g["quoted_status_id"].eqNullSafe(t["quoted_status_id"]) | lost]
    votes += [g[c].eqNullSafe(t[c]) for c in POST_EXACT]
    votes.append(match_text(g["text"]).eqNullSafe(match_text(t["text"])))
    votes += [within_slack(g[c], t[c]) for c in POST_COUNTS]
    votes += [g["quote"]["text"].eqNullSafe(t["quote"]["text"]) & (g["quote"].isNull() == t["quote"].isNull()), g["entities"].eqNullSafe(t["entities"]), g["extended_entities"].eqNullSafe(t["extended_entities"])]
    both = g["quote"].isNotNull() & t["quote"].isNotNull()
    votes += [F.when(both, within_slack(g["quote"][c], t["quote"][c])) for c in POST_COUNTS]
    votes.append(arrays.same_media(g["media"], t["media"]))
    votes += [g["user"][c].eqNullSafe(t["user"][c]) for c in USER_EXACT] + [within_slack(g["user"][c], t["user"][c]) for c in USER_COUNTS]
    votes.append(g["user"]["entities"].eqNullSafe(t["user"]["entities"]))
    return F.array(*votes)


def content_accuracy(pairs: DataFrame, response: str, votes: Column, matched: Column, unordered: Column) -> DataFrame:
    """A response's mean over the true posts of the mean of their votes; a post that isn't matched,
    or fails its gates, has 0; a response that should be in order of time and isn't has 0."""
    voted = pairs.select(response, F.when(matched, votes).alias("votes_"), unordered.alias("bad_"))
    scored = voted.select(response, arrays.vote_mean("votes_").alias("vote_"), "bad_")
    mean = scored.groupBy(response).agg(F.avg("vote_").alias("mean_"), F.bool_or("bad_").alias("bad_"), F.count("*").alias("n"))
    return mean.select(response, F.when(F.coalesce("bad_", F.lit(False)), 0.0).otherwise(F.coalesce("mean_", F.lit(0.0))).alias("accuracy"), "n")


PENALTIES = {
    "ai_search": ("streaming", "timeout", "least_time", "count", "structure", "duplicates", "schema", "dates", "domains"),
    "x_search": ("timeout", "least_time", "count", "duplicates", "schema", "dates", "order"),
}


def kept_share(kind, penalties: dict[str, Column]) -> Column:
    """What the penalties of its kind of search leave of a reward: the product of 1 less each; a
    penalty that is null takes nothing, and those of another kind don't count."""
    from .scoring import penalty_product

    out = F.lit(None).cast("double")
    for name, names in PENALTIES.items():
        out = F.when(_c(kind) == name, penalty_product(*(F.coalesce(penalties[n], F.lit(0.0)) for n in names if n in penalties))).otherwise(out)
    return out


FALLBACK = {"web": "What is the latest on {0}?", "research": "What do people say about {0}, and why?"}
PROMPT = {
    "web": "Write one question on {0} that a search of the web can answer. Angle: {1}.",
    "research": "Write one question on {0} that needs several current sources. Angle: {1}.",
}


def question_prompt(topic, web_only, angle) -> Column:
    """What a model is asked to get a question; two templates, by whether the web alone is searched."""
    fill = lambda kind: F.format_string(PROMPT[kind].replace("{0}", "%1$s").replace("{1}", "%2$s"), _c(topic), _c(angle))
    return F.when(_c(web_only), fill("web")).otherwise(fill("research"))


def question_or_fallback(answer, topic, web_only) -> Column:
    """The model's question, cleaned; where it has none, a template about the topic."""
    from ..functions.text import clean_question

    fill = lambda kind: F.format_string(FALLBACK[kind].replace("{0}", "%s"), _c(topic))
    return F.coalesce(F.nullif(clean_question(answer), F.lit("")), F.when(_c(web_only), fill("web")).otherwise(fill("research")))


def post_query(draw, topic, user, ticker, tag) -> Column:
    """A search for posts by a draw from 0 to 99: 20 by a user, 15 by a ticker, 15 by a tag, else the topic."""
    d = _c(draw)
    return F.when(d < 20, F.concat(F.lit("from:"), _c(user))).when(d < 35, F.concat(F.lit("$"), _c(ticker))).when(d < 50, F.concat(F.lit("#"), _c(tag))).otherwise(_c(topic))
