"""URL filter: hosts split into words by unigram Viterbi, then multinomial naive Bayes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, durable, slices, whole_id, words

SEEDS = ("adult", "ads", "bet", "bets", "casino", "loan", "loans", "pills", "poker", "porn", "sex", "spam", "viagra", "xxx")
PREFIX = 24  # letters by which words meet names; a longer word meets them by its first ones
ALPHA = 1.0  # added to each token's count
_URL = re.compile(r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^?#]*)")
_SPLIT = re.compile(r"\d+|[^\W\d_]+")
_TEN = 2.302585092994046


def segment(name: str, cost: dict[str, float], total: float) -> list[str]:
    """The cheapest split of a name into dictionary words and unknown stretches; of equally cheap
    ones that whose last word is longest. An unknown stretch of n letters counts as one word of
    10 / 10**n occurrences, so that the best one up to a letter either begins there or goes on.
    Work is the name's length times that of its longest known word."""
    lengths = sorted({len(w) for w in cost}, reverse=True)
    best, start = [0.0], [0]
    base = log(total)
    loose, since = 0.0, 0  # the best split that ends in an unknown stretch, and where that begins
    for i in range(1, len(name) + 1):
        if i > 1 and loose + _TEN <= best[i - 1] + base:
            loose += _TEN
        else:
            loose, since = best[i - 1] + base, i - 1
        value, at = loose, since
        for n in lengths:
            if n <= i and (c := cost.get(name[i - n : i])) is not None:
                v = best[i - n] + c
                if v < value or v == value and i - n < at:
                    value, at = v, i - n
        best.append(value), start.append(at)
    out, i = [], len(name)
    while i:
        out.append(name[start[i] : i])
        i = start[i]
    return out[::-1]


class Splitter:
    """URL tokens, each name segmented once while it is remembered."""

    def __init__(self, dictionary: dict[str, float], total: float):
        self.cost, self.total, self.seen = dictionary, total, {}

    def names(self, text: str) -> list[str]:
        out = []
        for name in _SPLIT.findall(text):
            if name[0].isdigit():
                out.append("#")
                continue
            found = self.seen.get(name)
            if found is None:
                if len(self.seen) > 200_000:
                    self.seen.clear()
                found = self.seen[name] = segment(name, self.cost, self.total)
            out += found
        return out

    def tokens(self, url: str) -> tuple[list[str], list[str]]:
        host, path = _URL.match(url).groups()
        return self.names(host.lower()), self.names(path.lower())


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts of each slice of text; the empty word carries the number of all words."""
    for batch in slices(batches, 0):
        codes, _, vocabulary = words(batch.column(0))
        n = np.bincount(codes, minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([vocabulary.cast(pa.string()), pa.array([""], pa.string())]), pa.array(np.r_[n, len(codes)])], ["w", "n"])


def word_counts(corpus: DataFrame, text_col: str = "text") -> DataFrame:
    """(w, n) of every word of the corpus that a name can hold; the empty word has the number of all words."""
    narrow = corpus.select(col(text_col).cast("string").alias("t")).where("t is not null")
    return narrow.mapInArrow(_words, "w string, n long").where(~F.col("w").rlike(r"\p{Nd}")).groupBy("w").agg(F.sum("n").alias("n"))


def costs(counts: dict[str, int], total: float, seeds: tuple[str, ...] = SEEDS) -> dict[str, float]:
    """The cost -log p of each word. Seeds that the corpus lacks count once."""
    rows = {w: n for w, n in counts.items() if not any(c.isdigit() for c in w)}
    for s in seeds:
        rows[s] = max(rows.get(s, 0), 1)
    return {w: log(total) - log(n) for w, n in rows.items()}


def dictionary(corpus: DataFrame, text_col: str = "text", seeds: tuple[str, ...] = SEEDS) -> tuple[dict[str, float], float]:
    """All words' costs on the driver, and the number of words; for a corpus that one machine holds."""
    rows = {r.w: r.n for r in word_counts(corpus, text_col).collect()}
    total = max(rows.pop("", 0), 1) + 10.0
    return costs(rows, total, seeds), total


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The names of each URL's host and path in order."""
    for batch in batches:
        url, path, at, names = [], [], [], []
        for u, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = [(p, "#" if x[0].isdigit() else x) for p, part in enumerate(_URL.match(text).groups()) for x in _SPLIT.findall(part.lower())]
            url += [u] * len(found)
            path += [bool(p) for p, _ in found]
            at += range(len(found))
            names += [x for _, x in found]
        yield pa.RecordBatch.from_arrays([pa.array(url, pa.int64()), pa.array(path, pa.bool_()), pa.array(at, pa.int32()), pa.array(names, pa.string())], ["u", "path", "at", "name"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All that may be a word in each name, or the beginning of a longer one."""
    for batch in batches:
        for k, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for low in range(0, len(name), 10_000):  # of a very long name not all at once
                found = list({name[i:j] for i in range(low, min(low + 10_000, len(name))) for j in range(i + 1, min(len(name), i + PREFIX) + 1)})
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(found), pa.int64()), pa.array(found, pa.string())], ["k", "part"])


def _segment(total: float, seeds: tuple[str, ...]):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [segment(name, costs({x["w"]: x["n"] for x in known or ()}, total, seeds), total) for name, known in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(split, pa.list_(pa.string()))], ["name", "words"])

    return apply


def filter_urls(pages: DataFrame, corpus: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "text", seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """(page_id, host_words, path_words, log_odds, blocked) of every row of ``pages``.

    Word frequencies are those of all of ``corpus``, of rare and long words too: each distinct name
    of the URLs meets the counts of the words it can hold. URLs in whose host or path the split
    finds a seed word are the unwanted examples, all others the wanted ones; token counts of all
    URLs make the naive Bayes model, and a URL is blocked when its log odds of being unwanted are
    above 0. Null and blank URLs have null results and aren't blocked; where no URL has a seed,
    none is. The query string and the fragment aren't looked at. Repeated rows are scored each;
    ids that aren't whole numbers read as null; other columns are ignored.
    """
    narrow = pages.select(whole_id(pages, id_col).alias("page_id"), col(url_col).cast("string").alias("url"))
    distinct = durable(narrow.where("url rlike '\\\\S'").groupBy("url").agg(F.count("*").alias("n")).withColumn("u", F.monotonically_increasing_id()))
    named = durable(distinct.select("u", "url").mapInArrow(_names, "u long, path boolean, at int, name string"))
    counts = durable(word_counts(corpus, text_col))
    every = counts.where("w = ''").first()
    total = max(every.n if every else 0, 1) + 10.0
    names = durable(named.where("name <> '#'").select("name").distinct().withColumn("k", F.monotonically_increasing_id()))
    parts = names.select("k", "name").mapInArrow(_parts, "k long, part string").distinct()
    keyed = counts.where("w <> ''").select("w", "n", F.substring("w", 1, PREFIX).alias("part"))
    met = parts.join(keyed, "part").select("k", "w", "n")
    short = met.where(F.char_length("w") <= PREFIX)
    long = met.where(F.char_length("w") > PREFIX).join(names, "k").where(F.col("name").contains(F.col("w"))).select("k", "w", "n")
    known = short.unionAll(long).groupBy("k").agg(F.collect_list(F.struct("w", "n")).alias("known"))
    split = names.join(known, "k", "left").select("k", "name", "known").mapInArrow(_segment(total, seeds), "k long, words array<string>").join(names, "k").select("name", "words")
    part = F.struct("at", "path", F.when(F.col("name") == "#", F.array(F.lit("#"))).otherwise(F.col("words")).alias("words"))
    whole = distinct.join(named.join(split, "name", "left").groupBy("u").agg(F.sort_array(F.collect_list(part)).alias("parts")), "u", "left")
    side = lambda path: F.flatten(F.transform(F.filter("parts", lambda x: x.path == path), lambda x: x.words))
    none = F.array().cast("array<string>")
    whole = whole.select("u", "url", "n", F.coalesce(side(False), none).alias("host"), F.coalesce(side(True), none).alias("path"))
    whole = durable(whole.withColumn("bad", F.arrays_overlap(F.concat("host", "path"), F.array(*map(F.lit, seeds)).cast("array<string>"))))
    tokens = whole.select("u", "n", "bad", F.explode(F.concat(F.transform("host", lambda x: F.concat(F.lit("h:"), x)), F.transform("path", lambda x: F.concat(F.lit("p:"), x)))).alias("token"))
    sums = lambda df: df.agg(F.sum(F.when(F.col("bad"), 0).otherwise(F.col("n"))).alias("g"), F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("b"))
    model = durable(sums(tokens.groupBy("token")))
    size, all_good, all_bad = model.agg(F.count("*"), F.coalesce(F.sum("g"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    good, bad = (x or 0 for x in sums(whole).first())
    prior = log(bad / good) if bad and good else (-1e9 if not bad else 1e9)
    ratio = F.log((F.col("b") + ALPHA) / (all_bad + ALPHA * (size + 1))) - F.log((F.col("g") + ALPHA) / (all_good + ALPHA * (size + 1)))
    odds = tokens.select("u", "token").join(model.select("token", ratio.alias("ratio")), "token").groupBy("u").agg(F.sum("ratio").alias("odds"))
    score = F.lit(prior) + F.coalesce("odds", F.lit(0.0))
    scored = whole.join(odds, "u", "left").select("url", F.concat_ws(" ", "host").alias("host_words"), F.concat_ws(" ", "path").alias("path_words"), score.alias("log_odds"))
    return narrow.join(scored, "url", "left").select("page_id", "host_words", "path_words", "log_odds", F.coalesce(F.col("log_odds") > 0, F.lit(False)).alias("blocked"))


def page_urls(spark, sf_dir: str) -> DataFrame:
    """op9_url_filter over the whole pages table, with the word counts of all documents."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet"))
