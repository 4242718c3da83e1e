"""Text, URL and verdict functions. Each takes and returns Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CONFIG

TRACKERS = (
    "_ga", "_gl", "dclid", "fbclid", "feature", "gbraid", "gclid", "gclsrc", "igsh", "igshid", "mc_cid", "mc_eid", "mkt_tok", "msclkid", "scm", "si", "spm", "twclid", "wbraid", "yclid",
)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def blank_to_null(x) -> Column:
    return F.nullif(F.trim(_c(x)), F.lit(""))


def source_url(u) -> Column:
    """Trimmed and lowered URL without www. and one closing slash; null reads as ''."""
    plain = F.regexp_replace(F.lower(F.trim(F.coalesce(_c(u), F.lit("")))), r"^(https?://)www\.", "$1")
    return F.regexp_replace(plain, "/$", "")


def _form_decoded(x: Column) -> Column:
    return F.coalesce(F.try_url_decode(x), x)


def _form_encoded(x: Column) -> Column:
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def source_key(u) -> Column:
    """Identity of a source: source_url of the part before query and fragment, then the query's
    parameters, decoded, sorted and encoded again, tracking ones dropped. Parameters keep their
    case; one without a value has an empty one."""
    u = F.trim(F.coalesce(_c(u), F.lit("")))
    bare = F.regexp_replace(u, r"[?#].*$", "")
    query = F.regexp_extract(F.regexp_replace(u, r"#.*$", ""), r"\?(.*)$", 1)
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.struct(_form_decoded(F.substring_index(p, "=", 1)).alias("k"), _form_decoded(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p.k).startswith("utm_") & ~F.lower(p.k).isin(*TRACKERS)))
    joined = F.array_join(F.transform(kept, lambda p: F.concat(_form_encoded(p.k), F.lit("="), _form_encoded(p.v))), "&")
    return F.concat(source_url(bare), F.when(F.size(kept) > 0, F.concat(F.lit("?"), joined)).otherwise(F.lit("")))


def markdown_links(s) -> Column:
    """URLs of all [text](url) pairs, in order."""
    return F.regexp_extract_all(_c(s), F.lit(r"\[([^\]]+)\]\(([^)]+)\)"), 2)


def good_markdown(s) -> Column:
    """Neither blank nor with heading lines."""
    return (F.trim(F.coalesce(_c(s), F.lit(""))) != "") & ~F.coalesce(_c(s), F.lit("")).rlike(r"(?m)^#{1,6}\s")


def cited_urls(s) -> Column:
    return F.array_distinct(F.transform(markdown_links(s), source_url))


def unescape(s) -> Column:
    """The five basic entities, &nbsp; and &#39;."""
    out = _c(s)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def match_text(s) -> Column:
    """Entities resolved, URLs and leading mentions dropped, white space removed, 280 characters."""
    out = F.regexp_replace(unescape(s), r"https?://\S+", "")
    out = F.regexp_replace(F.ltrim(out), r"^(?:@\w+\s+)+", "")
    return F.left(F.regexp_replace(out, r"(?U)\s+", ""), F.lit(280))


def clean_text(s) -> Column:
    """As match_text, but signs but commas dropped and white space collapsed."""
    out = F.regexp_replace(unescape(s), r"https?://\S+", "")
    out = F.regexp_replace(F.ltrim(out), r"^(?:@\w+\s+)+", "")
    out = F.regexp_replace(out, r"(?U)[^\w\s,]", "")
    return F.regexp_replace(F.trim(F.regexp_replace(out, r"(?U)\s+", " ")), r"\p{C}", "")


def fold_text(s) -> Column:
    """Lower-case letters and digits alone, for containment tests."""
    folded = F.replace(F.replace(F.lower(unescape(F.coalesce(_c(s), F.lit("")))), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))
    return F.regexp_replace(folded, r"(?U)[^\p{L}\p{N}_]+", "")


def domain(d) -> Column:
    """Bare lower-case host of a domain or URL."""
    out = F.regexp_replace(F.lower(F.trim(_c(d))), r"^/+|/+$", "")
    out = F.split(F.regexp_replace(out, r"^[a-z][a-z0-9+.-]*://", ""), "/")[0]
    return F.regexp_replace(out, r"\.+$", "")


def domains(a) -> Column:
    return F.array_distinct(F.filter(F.transform(_c(a), domain), lambda d: d != ""))


def url_host(u) -> Column:
    """Lower-case host, null where there is none."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(_c(u), F.lit("")), r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), r"\.$", ""), F.lit(""))


def site_operators(q) -> Column:
    return F.transform(F.regexp_extract_all(_c(q), F.lit(r"(?i)\bsite:(\S+)"), 1), F.lower)


def without_site_operators(q) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(_c(q), r"(?i)\bsite:\S+", " "), r"\s+", " "))


def web_query(q, include, exclude, suffix=None) -> Column:
    """Search text: query, wanted sites (in parentheses when several), unwanted ones, a suffix."""
    wanted = F.transform(domains(include), lambda d: F.concat(F.lit("site:"), d))
    group = F.when(F.size(wanted) > 1, F.concat(F.lit("("), F.array_join(wanted, " OR "), F.lit(")"))).when(F.size(wanted) == 1, wanted[0])
    unwanted = F.when(F.size(domains(exclude)) > 0, F.array_join(F.transform(domains(exclude), lambda d: F.concat(F.lit("-site:"), d)), " "))
    return F.concat_ws(" ", blank_to_null(q), group, unwanted, blank_to_null(suffix) if suffix is not None else F.lit(None).cast("string"))


def post_id(u) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(_c(u), F.lit("")), r"/status(?:es)?/(\d+)", 1), F.lit(""))


def post_url(url, user, id_) -> Column:
    made = F.concat(F.lit("https://x.com/"), _c(user), F.lit("/status/"), _c(id_))
    return F.coalesce(F.nullif(_c(url), F.lit("")), made)


def valid_post_url(u) -> Column:
    return F.coalesce(F.lower(_c(u)).rlike(r"^https?://x\.com/(?![^/]*(?:twitter|admin))[a-z0-9_]{1,15}/status/\d+$"), F.lit(False))


def relevance_text(text, quote_user, quote_text) -> Column:
    """A post's text, and after a blank line the text that it quotes, with its author if known."""
    by = F.coalesce(F.concat(F.lit(" (@"), F.nullif(_c(quote_user), F.lit("")), F.lit(")")), F.lit(""))
    return F.concat_ws("\n\n", F.coalesce(_c(text), F.lit("")), F.concat(F.lit("Quoted tweet"), by, F.lit(": "), blank_to_null(quote_text)))


def sanitize_verdicts(s) -> Column:
    """Texts can't fake a verdict line."""
    return F.regexp_replace(_c(s), r"(?i)\bverdict\b\s*:", "verdict-")


def url_class(u) -> Column:
    h = url_host(u)
    return F.when(h.rlike(r"(^|\.)(youtube\.com|youtu\.be)$"), "youtube").when(h.rlike(r"(^|\.)reddit\.com$"), "reddit").otherwise("default")


def fetch_url(u) -> Column:
    """The address to fetch: that of the old site for reddit."""
    return F.when(url_class(u) == "reddit", F.regexp_replace(_c(u), r"(?i)^(https?://)(?:[a-z0-9-]+\.)*reddit\.com", "$1old.reddit.com")).otherwise(_c(u))


def video_id(u) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(_c(u), F.lit("")), r"(?:[?&]v=|youtu\.be/|/shorts/|/embed/|/v/)([A-Za-z0-9_-]{6,})", 1), F.lit(""))


def joined_fields(*parts) -> Column:
    return F.concat_ws(" ", *map(blank_to_null, parts))


def _verdict_word(t) -> Column:
    t = F.coalesce(_c(t), F.lit(""))
    stated = F.try_element_at(F.regexp_extract_all(t, F.lit(r"(?i)\bverdict\b\s*[:\-]?\s*([A-Za-z]+)"), 1), F.lit(-1))
    bare = F.try_element_at(F.regexp_extract_all(t, F.lit(r"(?i)\b(high|medium|fail)\b"), 1), F.lit(-1))
    return F.upper(F.coalesce(stated, bare, F.lit("")))


def verdict_score(t) -> Column:
    w = _verdict_word(t)
    return F.when(w == "HIGH", 3.0).when(w == "MEDIUM", 1.5).otherwise(0.0)


def verdict_label(t) -> Column:
    stated = F.upper(F.coalesce(F.try_element_at(F.regexp_extract_all(F.coalesce(_c(t), F.lit("")), F.lit(r"(?i)\bverdict\b\s*:\s*([A-Za-z]+)"), 1), F.lit(-1)), F.lit("")))
    return F.when(stated.isin("HIGH", "MEDIUM"), stated).otherwise("LOW")


def number_score(t) -> Column:
    """The number after the first "score", else the first whole number from 0 to 10; 0 without."""
    t = F.coalesce(_c(t), F.lit(""))
    named = F.regexp_extract(t, r"(?i)score[:\s]*(\d+(?:\.\d+)?)", 1).try_cast("double")
    first = F.regexp_extract(t, r"\b([0-9]|10)\b", 1).try_cast("double")
    return F.coalesce(F.when(named <= 10, named), first, F.lit(0.0))


def without_names(s, names: list[str]) -> Column:
    """A text with some bare names taken out, longest first."""
    out = _c(s)
    for n in sorted(names, key=len, reverse=True):
        out = F.replace(out, F.lit(n), F.lit(""))
    return out


def messages(system, body) -> Column:
    """A system and a user message; nothing where there is no body."""
    pair = F.array(*(F.struct(F.lit(role).alias("role"), _c(text).alias("content")) for role, text in (("system", system), ("user", body))))
    return F.when(F.trim(F.coalesce(_c(body), F.lit(""))) != "", F.to_json(pair))


def clean_question(s) -> Column:
    """First line with text, unquoted, without bullets or trailing labels, ending as a question or sentence."""
    line = F.try_element_at(F.filter(F.transform(F.split(F.coalesce(_c(s), F.lit("")), "\n"), F.trim), lambda x: x != ""), F.lit(1))
    line = F.regexp_replace(F.coalesce(line, F.lit("")), r"(?i)(\t|\b(?:intent|label|category)\s*:).*$", "")
    line = F.regexp_replace(line, r"^[\s\"'*\-]+|[\s\"']+$", "")
    line = F.regexp_replace(line, r"\s+", " ")
    return F.when(line == "", "").when(line.rlike(r"[.?!]$"), line).otherwise(F.concat(line, F.lit("?")))


def fix_query(s) -> Column:
    return F.replace(F.replace(_c(s), F.lit("'"), F.lit('"')), F.lit("has:polls"), F.lit(""))


def request_text(prompt, query, id_, urls) -> Column:
    text = lambda x: F.nullif(_c(x), F.lit(""))
    return F.coalesce(text(prompt), text(query), text(id_), F.nullif(F.array_join(_c(urls), ", "), F.lit("")), F.lit(""))


def short_label(key) -> Column:
    return F.when(F.length(_c(key)) <= 10, _c(key)).otherwise(F.concat(F.left(_c(key), F.lit(6)), F.lit("…"), F.right(_c(key), F.lit(4))))


GATES = (
    "please enable javascript", "enable javascript and refresh", r"something went wrong\.?\s*(?:wait a moment|please|try)", r"you (?:need to )?(?:enable|turn on) javascript",
    "access denied", "are you a robot",
)


def usable_article(s) -> Column:
    """Long enough, and not the page of a gate that wants a browser or a person."""
    s = F.coalesce(_c(s), F.lit(""))
    return (F.length(s) >= CONFIG.usable_chars) & ~s.rlike("(?i)" + "|".join(GATES))


def forbidden_markup(s) -> Column:
    """Tags and marks by which an answer could steer its judge."""
    tags = "|".join(f"/?{x}" for x in ("question", "answer", "score"))
    return F.coalesce(_c(s), F.lit("")).rlike(f"(?i)<(?:{tags})>|sm(?:[-_ ]scs)?[-_ ]?(?:ble|grn|gry|pnk|rdd)")
