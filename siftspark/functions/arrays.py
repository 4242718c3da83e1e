"""Arrays, maps and structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, fold_text


def size0(a) -> Column:
    return F.greatest(F.coalesce(F.size(_c(a)), F.lit(0)), F.lit(0))


def all_values(m) -> Column:
    return F.flatten(F.map_values(_c(m)))


def expand(values, counts) -> Column:
    """Each value as often as its count says."""
    return F.flatten(F.zip_with(_c(values), _c(counts), lambda v, n: F.array_repeat(v, n.cast("int"))))


def contained(highlights, body) -> Column:
    """The highlights found in the body, letters and digits compared."""
    b = fold_text(body)
    return F.filter(_c(highlights), lambda h: (fold_text(h) != "") & F.contains(b, fold_text(h)))


def in_order(highlights, body) -> Column:
    """Every highlight found, each after the end of the one before; false for none or a blank one."""
    # a lambda's variable is found once, however often it is used
    let = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)
    after = lambda at, h, b: let(F.call_function("locate", h, b, at), lambda p: F.when(p == 0, 0).otherwise(p + F.length(h)))
    step = lambda at, h, b: F.when(at == 0, 0).otherwise(let(fold_text(h), lambda g: F.when(g == "", 0).otherwise(after(at, g, b))))
    found = let(fold_text(body), lambda b: (b != "") & (F.aggregate(_c(highlights), F.lit(1), lambda at, h: step(at, h, b)) > 0))
    return F.when(size0(highlights) > 0, found).otherwise(False)


def last_index(keys, key) -> Column:
    """Position from 1 of a key's last occurrence, null if absent."""
    n = F.size(_c(keys))
    at = F.array_position(F.reverse(_c(keys)), _c(key))
    return F.when(at > 0, (n - at + 1).cast("int"))


def lane(search_type, mode) -> Column:
    return F.concat_ws(":", _c(search_type), F.nullif(_c(mode), F.lit("")))


def lane_type(key) -> Column:
    return F.split(_c(key), ":")[0]


def lane_mode(key) -> Column:
    return F.try_element_at(F.split(_c(key), ":"), F.lit(2))


def repeated(keys) -> Column:
    """Whether any key but null occurs twice."""
    kept = F.filter(_c(keys), lambda k: k.isNotNull())
    return F.size(kept) > F.size(F.array_distinct(kept))


def same_media(a, b) -> Column:
    """Equal kinds and addresses, in order; none equals missing."""
    empty = lambda x: F.coalesce(_c(x), F.array().cast("array<struct<media_url:string,type:string>>"))
    return (F.size(empty(a)) == F.size(empty(b))) & F.forall(F.zip_with(empty(a), empty(b), lambda x, y: x.eqNullSafe(y)), lambda t: t)


def masked(node, fields: dict) -> Column:
    """A struct with some fields replaced."""
    out = _c(node)
    for name, value in fields.items():
        out = out.withField(name, value)
    return out


def vote_mean(votes) -> Column:
    """The part of the votes (true or false; nulls don't count) that is true, 0 without any.

    Counted without lambdas, in whose arguments nothing is compiled."""
    v = _c(votes)
    yes, no = (F.size(v) - F.size(F.array_remove(v, said)) for said in (True, False))
    return F.coalesce(F.try_divide(yes.cast("double"), yes + no), F.lit(0.0))
