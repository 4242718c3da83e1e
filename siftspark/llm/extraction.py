"""HTML extraction by equivalence classes of template tokens over pages of one host."""

from __future__ import annotations

import html
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chain, col, durable, hash_strings, mix, offsets, shuffle_partitions, whole_id

SHARE = 0.01  # of a host's rows that have the tokens of a class
PAGES = 3  # different pages on which they occur
WORD_PAGES = 10  # the same for a class without a tag: words alone may agree by chance
CLASS_SIZE = 3  # tokens of a template class
PART_BYTES = 8 << 20  # html of a host that a task handles at once; layout only, never the result
BROADCAST_BYTES = 32 << 20  # of large hosts' names, up to which they are broadcast
_MARK = re.compile(r"(<(?:!--.*?(?:-->|$)|(script|style|noscript|template)\b[^>]*>.*?(?:</\2\s*>|$)|[^<>]*>?))", re.S | re.I)  # what lies between is words
_NAME = re.compile(r"</?\s*([A-Za-z][A-Za-z0-9]*)")
_ROLE = re.compile(r"""\b(?:class|id|itemprop|role)\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PLACE = 28  # bits of a place within its page


def _tag(raw: str, block: str) -> str:
    """A tag's identity: its name and class or id; comments and scripts are tags."""
    if raw.startswith("<!--"):
        return "<!-->"
    if block:
        return f"<{block.lower()}/>"
    name = _NAME.match(raw)
    if not name:
        return "<!>"
    close = raw[1] == "/"
    return f"<{'/' * close}{name[1].lower()}" + ("" if close else "".join(f" {a.lower()}" for a in sorted(_ROLE.findall(raw)))) + ">"


class Reader:
    """Pages as codes of tokens: tags by their identity, words by themselves and the tag before.

    Codes below ``n_tags`` are tags, of which 0 stands for none; words follow. They hold for the pages last read.
    """

    def read(self, *pages: str) -> np.ndarray:
        """The codes of all pages, end to end; ``length`` says how many each has."""
        named, raw = {"": 0}, {}  # tags by identity, and as written
        runs, before, first = [], [], []  # runs of words, the tag before each, each page's first run
        for page in pages:
            parts = _MARK.split(page)
            first.append(len(runs))
            runs += parts[::3]
            before.append(0)
            for t, block in zip(parts[1::3], parts[2::3]):
                code = raw.get(t)
                if code is None:
                    if len(raw) > 50_000:
                        raw.clear()
                    code = raw[t] = named.setdefault(_tag(t, block or ""), len(named))
                before.append(code)
        split = pc.utf8_split_whitespace(pa.array(runs, pa.string()))  # by what Python calls space
        words = split.flatten()
        real = pc.greater(pc.binary_length(words), 0)  # a run's ends split into empty ones
        n = np.diff(np.r_[0, np.cumsum(real.to_numpy(zero_copy_only=False))][offsets(split) if len(split) else [0]])
        coded = words.filter(real).dictionary_encode()
        before, size = np.array(before, np.int64), max(len(coded.dictionary), 1)
        pair = pa.array(np.repeat(before, n) * size + coded.indices.to_numpy()).dictionary_encode()
        self.names, self.words, self.n_tags = list(named), coded.dictionary, len(named)
        self.after, self.word = np.divmod(pair.dictionary.to_numpy(), size)  # of each word's code its tag and its word
        lead = np.ones(len(before), np.int64)
        lead[first] = 0
        start = np.cumsum(n + lead) - (n + lead)
        out, is_word = np.empty(int((n + lead).sum()), np.int64), np.ones(int((n + lead).sum()), bool)
        out[start[lead > 0]] = before[lead > 0]
        is_word[start[lead > 0]] = False
        out[is_word] = self.n_tags + pair.indices.to_numpy()
        self.length = np.add.reduceat(n + lead, first) if first else n
        return out

    @property
    def text(self) -> list[str | None]:
        """Of each code its word, None for a tag."""
        return [None] * self.n_tags + self.words.take(pa.array(self.word)).to_pylist()

    @property
    def tag(self) -> list[str]:
        """Of each code the tag, or the one before the word."""
        return self.names + [self.names[k] for k in self.after.tolist()]

    def hashes(self) -> np.ndarray:
        tag = hash_strings(pa.array(self.names, pa.string()))
        return np.r_[chain(tag, np.zeros(len(tag), np.uint64)), chain(tag[self.after], hash_strings(self.words)[self.word])]


class Group:
    """Some pages of one host, each different html once."""

    def __init__(self, pages: list[str | None]):
        self.reader = Reader()
        self.copies: list[int] = []
        self.of: list[int] = []  # of each row its page, -1 for null
        seen: dict[str, int] = {}
        for x in pages:
            if x is None:
                self.of.append(-1)
                continue
            k = seen.setdefault(x, len(seen))
            if k == len(self.copies):
                self.copies.append(0)
            self.copies[k] += 1
            self.of.append(k)
        self.flat = self.reader.read(*seen)
        self.hash = hash_strings(pa.array(list(seen), pa.large_string()).cast(pa.string()))
        self.token = self.reader.hashes()
        self.is_tag = np.arange(len(self.token)) < self.reader.n_tags
        self.length = length = self.reader.length
        self.doc = np.repeat(np.arange(len(length)), length)
        self.start = np.cumsum(length) - length
        self.page = [self.flat[a : a + n] for a, n in zip(self.start.tolist(), length.tolist())]

    def vectors(self, wanted: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """Of each token that occurs, or of the wanted ones: code, a hash of its occurrence vector (how often it is on
        each page), sum of its places, rows that have it, and its least page hashes.

        The vector's hash and the sum of places are sums over pages, so those of parts of a host
        add up to those of all of it.
        """
        n = max(len(self.page), 1)
        at, flat, page = np.arange(len(self.flat)) - self.start[self.doc], self.flat, self.doc
        if wanted is not None:
            some = np.isin(self.token, wanted)[flat]
            at, flat, page = at[some], flat[some], page[some]
        key = flat * n + page
        order = np.argsort(key, kind="stable")
        key = key[order]
        run = np.flatnonzero(np.diff(key, prepend=-1))
        count = np.diff(np.r_[run, len(key)])
        code, doc = key[run] // n, key[run] % n
        copies = np.array(self.copies, np.int64)[doc]
        place = ((at << _PLACE) // np.maximum(self.length[page], 1))[order]
        mean = (np.add.reduceat(place, run) if len(run) else place) // count
        again = np.lexsort((self.hash[doc], code))  # by page hash within a token
        code, doc, count, copies, mean = code[again], doc[again], count[again], copies[again], mean[again]
        first = np.flatnonzero(np.diff(code, prepend=-1))
        mark = mix(mix(self.hash[doc]) + count.astype(np.uint64)) * copies.astype(np.uint64)
        total = lambda x: np.add.reduceat(x, first) if len(first) else x[:0]
        rank = np.arange(len(code)) - np.repeat(first, np.diff(np.r_[first, len(code)]))
        few = rank < WORD_PAGES
        pages = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(total(few.astype(np.int64)))].astype(np.int32)), pa.array(self.hash[doc][few].view(np.int64)))
        return code[first], total(mark), total(mean * copies), total(copies), pages

    def frequent(self) -> np.ndarray:
        """The tokens on SHARE of the rows. One on SHARE of a host's rows is so in some part of it."""
        rows = np.zeros(len(self.token), np.int64)
        for page, copies in zip(self.page, self.copies):
            rows[np.unique(page)] += copies
        return self.token[rows >= max(1, SHARE * sum(self.copies))]

    def classes(self) -> dict[str, np.ndarray]:
        """The candidate tokens, where these pages are all of the host."""
        code, vector, place, rows, pages = self.vectors(self.frequent())
        n = np.diff(pages.offsets.to_numpy())
        order = np.lexsort((self.token[code].view(np.int64), place, vector))
        code, vector, rows, n = code[order], vector[order], rows[order], n[order]
        first = np.flatnonzero(np.diff(vector, prepend=~vector[:1]))
        size = np.diff(np.r_[first, len(code)])
        of = np.repeat(np.arange(len(first)), size)
        total = lambda f, x: f.reduceat(x, first) if len(first) else x[:0]
        tagged = total(np.maximum, self.is_tag[code].astype(int))
        good = (size >= CLASS_SIZE) & (n[first] >= np.where(tagged > 0, PAGES, WORD_PAGES))
        name = total(np.minimum, self.token[code].view(np.int64))
        kept = good[of]
        return {"t": self.token[code][kept].view(np.int64), "cls": name[of][kept], "rank": (np.arange(len(code)) - first[of])[kept], "size": size[of][kept], "n": rows[kept], "tag": self.is_tag[code][kept]}

    def _known(self, t: np.ndarray) -> np.ndarray:
        """Of each token here its place among ``t``, or -1."""
        order = np.argsort(t)
        mine = self.token.view(np.int64)
        at = np.minimum(np.searchsorted(t[order], mine), max(len(t) - 1, 0))
        return np.where(t[order][at] == mine, order[at], -1) if len(t) else np.full(len(mine), -1)

    def wrong(self, c: dict[str, np.ndarray]) -> np.ndarray:
        """The candidate tokens that some page here has out of order.

        A class is in order on a page if its tokens come by their mean places over all pages,
        again and again. On a page where they don't, those outside the longest subsequence that
        does are wrong; without them, the class is in order on every page.
        """
        cls = np.unique(c["cls"], return_inverse=True)[1]
        where = self._known(c["t"])[self.flat]
        some = np.flatnonzero(where >= 0)
        k, doc = where[some], self.doc[some]
        by = np.lexsort((some, k, doc))  # the i-th time on its page that a token occurs
        first = np.flatnonzero((np.diff(k[by], prepend=-1) != 0) | (np.diff(doc[by], prepend=-1) != 0))
        nth = np.empty(len(k), np.int64)
        nth[by] = np.arange(len(k)) - np.repeat(first, np.diff(np.r_[first, len(k)]))
        key = nth * c["size"][k] + c["rank"][k]
        by = np.lexsort((some, cls[k], doc))
        k, key, doc, of = k[by], key[by], doc[by], cls[k][by]
        first = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
        falls = np.diff(key, prepend=-1) <= 0
        falls[first] = False
        run = np.unique(np.searchsorted(first, np.flatnonzero(falls), "right") - 1)
        ends = np.r_[first, len(key)]
        out = [k[ends[r] : ends[r + 1]][~_rising(key[ends[r] : ends[r + 1]].tolist())] for r in run.tolist()]
        return np.unique(c["t"][np.concatenate([*out, np.zeros(0, np.int64)])])

    def extract(self, c: dict[str, np.ndarray]) -> tuple[list, list, list]:
        """Of each row: classes, template tokens and slots, by the tokens of valid classes."""
        where = self._known(c["t"])[self.flat]
        cls = np.unique(c["cls"], return_inverse=True)[1]
        size = np.bincount(cls) if len(cls) else cls
        memo, done, mark = {}, [], np.zeros(len(where), bool)
        for a, n in zip(self.start.tolist(), self.length.tolist()):
            mine = where[a : a + n]
            seen = mine[mine >= 0]
            sequence = seen.tobytes()
            if sequence not in memo:
                if len(memo) > 10_000:
                    memo.clear()
                fine = _nest(seen, cls, size, c["n"], c["cls"])
                used = np.r_[np.isin(cls, fine), False]  # the last for tokens of no class
                memo[sequence] = len(fine), len(np.unique(seen[used[seen]])), used
            n_classes, n_tokens, used = memo[sequence]
            mark[a : a + n] = used[mine]
            done.append((n_classes, n_tokens))
        words = np.flatnonzero(~mark & ~self.is_tag[self.flat])
        slot, doc = np.cumsum(mark)[words], self.doc[words]
        cut = np.flatnonzero((np.diff(slot, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
        text = self.reader.words.take(pa.array(self.reader.word[self.flat[words] - self.reader.n_tags]))
        slots = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[cut, len(words)].astype(np.int32)), text), " ").to_pylist()
        slots, ends = [html.unescape(x) for x in slots], np.searchsorted(doc[cut], np.arange(len(done) + 1)).tolist()
        rows = [(0, 0, None) if k < 0 else (*done[k], slots[ends[k] : ends[k + 1]]) for k in self.of]
        return tuple(map(list, zip(*rows))) if rows else ([], [], [])


def _rising(x: list[int]) -> np.ndarray:
    """A longest increasing subsequence, as a mask."""
    tails, at, back = [], [], []
    for i, v in enumerate(x):
        k = bisect_left(tails, v)
        if k == len(tails):
            tails.append(v), at.append(i)
        else:
            tails[k], at[k] = v, i
        back.append(at[k - 1] if k else -1)
    mask = np.zeros(len(x), bool)
    i = at[-1] if at else -1
    while i >= 0:
        mask[i] = True
        i = back[i]
    return mask


def _nest(seen: np.ndarray, cls: np.ndarray, size: np.ndarray, n: np.ndarray, name: np.ndarray) -> list[int]:
    """The classes of a page that nest: all occurrences of the inner one between two neighbours of
    the outer one, the same two each time, or before or after all of it; or, where both occur
    equally often, each occurrence in the same way across one of the other. Those on more pages
    go first, then the larger, then by hash."""
    of = cls[seen]
    present, first = np.unique(of, return_index=True)
    order = sorted(range(len(present)), key=lambda i: (-n[seen[first[i]]], -size[present[i]], name[seen[first[i]]]))
    taken: list[tuple[int, np.ndarray]] = []
    for i in order:
        c = int(present[i])
        mine = np.flatnonzero(of == c)
        ok = True
        for o, outer in taken:
            slot = np.searchsorted(outer, mine).reshape(-1, size[c])
            within = (slot[:, :1] == slot).all() and len(np.unique(slot[:, 0] % size[o])) == 1
            across = len(slot) * size[o] == len(outer) and (np.diff(slot, axis=0) == size[o]).all()
            if not within and not across:
                ok = False
                break
        if ok:
            taken.append((c, mine))
    return [c for c, _ in taken]


def _without(c: dict[str, np.ndarray], wrong: np.ndarray) -> dict[str, np.ndarray]:
    """The classes without wrong tokens, as long as the others are enough."""
    stays = ~np.isin(c["t"], wrong)
    names, of = np.unique(c["cls"], return_inverse=True)
    size = np.bincount(of, stays, len(names)).astype(np.int64) if len(names) else of
    stays &= size[of] >= CLASS_SIZE if len(names) else False
    return {k: v[stays] for k, v in (c | {"size": size[of] if len(names) else of}).items()}


_OUT = "page_id long, host string, classes int, template_tokens int, slots array<string>, text string"


def _answer(table: pa.Table, group: Group, c: dict[str, np.ndarray]) -> pa.Table:
    classes, flat, slots = group.extract(c)
    return pa.table({
        "page_id": table.column("page_id"), "host": table.column("host"), "classes": pa.array(classes, pa.int32()), "template_tokens": pa.array(flat, pa.int32()),
        "slots": pa.array(slots, pa.list_(pa.string())), "text": pa.array([None if s is None else "\n".join(s) for s in slots], pa.string()),
    })


_NONE = {k: np.zeros(0, bool if k == "tag" else np.int64) for k in ("t", "cls", "rank", "size", "n", "tag")}


def _whole(table: pa.Table) -> pa.Table:
    """All pages of a host, or any without one."""
    group = Group(table.column("html").to_pylist())
    c = _NONE
    if table.column("host")[0].as_py() is not None:
        c = group.classes()
        c = _without(c, group.wrong(c))
    return _answer(table, group, c)


def _frequent(table: pa.Table) -> pa.Table:
    found = Group(table.column("html").to_pylist()).frequent()
    return pa.table({"host": pa.array([table.column("host")[0].as_py()] * len(found), pa.string()), "t": found.view(np.int64)})


def _vectors(table: pa.Table, tokens: pa.Table) -> pa.Table:
    group = Group(table.column("html").to_pylist() if tokens.num_rows else [])
    code, vector, place, rows, pages = group.vectors(tokens.column("t").to_numpy().view(np.uint64))
    half = np.uint64(32)
    return pa.table({
        "host": pa.array([table.column("host")[0].as_py() if len(code) else None] * len(code), pa.string()), "t": group.token[code].view(np.int64), "tag": group.is_tag[code],
        "hi": (vector >> half).view(np.int64), "lo": (vector & np.uint64(0xFFFFFFFF)).view(np.int64), "place": place, "n": rows, "pages": pages,
    })


def _candidates(table: pa.Table) -> dict[str, np.ndarray]:
    return {k: table.column(k).to_numpy() for k in _NONE} if table.num_rows else _NONE


def _wrong(pages: pa.Table, tokens: pa.Table) -> pa.Table:
    if not pages.num_rows or not tokens.num_rows:
        return pa.table({"host": pa.array([], pa.string()), "t": pa.array([], pa.int64())})
    found = Group(pages.column("html").to_pylist()).wrong(_candidates(tokens))
    return pa.table({"host": pa.array([pages.column("host")[0].as_py()] * len(found), pa.string()), "t": pa.array(found, pa.int64())})


def _slots(pages: pa.Table, tokens: pa.Table) -> pa.Table:
    return _answer(pages, Group(pages.column("html").to_pylist()), _candidates(tokens))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", part_bytes: int = PART_BYTES) -> DataFrame:
    """(page_id, host, classes, template_tokens, slots, text) of every row of ``pages``.

    Tokens whose occurrence vectors over all different pages of a host are the same, hashed, make
    a class if they are CLASS_SIZE, on at least SHARE of the host's rows and on at least PAGES
    different pages (WORD_PAGES for words without any tag), so that each layout of a host has
    classes of its own. Tokens that some page has out of
    the class's order leave it. The classes that nest on a page are its template; slots are the
    texts between the template's tokens, in order, and text joins them by lines.

    A host of more than ``part_bytes`` of html goes to tasks in parts: what is frequent in one is
    counted in all, vectors are added up, classes come from the sums, and each part is held
    against them; results are those of one task.
    Pages without a host and hosts of fewer than PAGES different pages have no template: slots are
    all their text. Null html gives null slots, empty html none. Repeated rows are one page
    but count each in the share, and come out each; ids that aren't whole numbers read as null; other columns are
    ignored.
    """
    host = F.nullif(F.lower(F.regexp_extract(col(url_col).cast("string"), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    narrow = pages.select(whole_id(pages, id_col).alias("page_id"), host.alias("host"), col(html_col).cast("string").alias("html"))
    size = durable(narrow.groupBy("host").agg(F.sum(F.octet_length("html") + 64).alias("size"), F.count("html").alias("rows")))
    large = durable(size.where(F.col("size") > part_bytes).select(F.col("host").alias("h"), F.ceil(F.col("size") / part_bytes).cast("int").alias("parts"), (F.col("rows") * SHARE).alias("least")))
    total, n_large = size.agg(F.sum("size")).first()[0] or 0, large.count()
    n = max(shuffle_partitions(pages.sparkSession), -(-total // part_bytes))
    # pages without a host need no company; those of a large one are spread over its parts
    other = F.pmod(F.xxhash64("page_id", "html"), F.lit(max(1, n))).cast("int")
    if not n_large:
        part = F.when(F.col("host").isNull(), other).otherwise(0)
        return narrow.withColumn("part", part).repartition(n, "host", "part").groupBy("host", "part").applyInArrow(_whole, _OUT)
    named = F.broadcast(large) if n_large * 64 <= BROADCAST_BYTES else large  # else the pages are shuffled by host first
    placed = narrow.join(named.drop("least"), F.col("host") == F.col("h"), "left").drop("h")
    part = F.when(F.col("host").isNull(), other).when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("page_id", "html"), F.col("parts")).cast("int"))
    placed = placed.select("page_id", "host", "html", part.alias("part"), (F.col("parts").isNotNull() & F.col("host").isNotNull()).alias("large")).repartition(n, "host", "part")
    small = placed.where("not large").groupBy("host", "part").applyInArrow(_whole, _OUT)
    apart = placed.where("large").groupBy("host", "part")
    spread = lambda df: df.join(named, F.col("host") == F.col("h")).select(*df.columns, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).groupBy("host", "part")
    often = apart.applyInArrow(_frequent, "host string, t long").distinct()
    sums = (
        apart.cogroup(spread(often)).applyInArrow(_vectors, "host string, t long, tag boolean, hi long, lo long, place long, n long, pages array<long>").groupBy("host", "t")
        .agg(F.max("tag").alias("tag"), F.sum("hi").alias("hi"), F.sum("lo").alias("lo"), F.sum("place").alias("place"), F.sum("n").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("pages"))
    )
    same = Window.partitionBy("host", "hi", "lo")
    tokens = (
        sums.join(named, F.col("host") == F.col("h")).where((F.col("pages") >= PAGES) & (F.col("n") >= F.col("least")))
        .select(*sums.columns, F.count("*").over(same).alias("size"), F.max("tag").over(same).alias("tagged"), F.min("t").over(same).alias("cls"), (F.row_number().over(same.orderBy("place", "t")) - 1).cast("long").alias("rank"))
        .where((F.col("size") >= CLASS_SIZE) & (F.col("tagged") | (F.col("pages") >= WORD_PAGES))).select("host", "t", "cls", "rank", "size", "n", "tag")
    )
    wrong = apart.cogroup(spread(tokens)).applyInArrow(_wrong, "host string, t long").distinct()
    left = Window.partitionBy("host", "cls")
    valid = tokens.join(wrong, ["host", "t"], "left_anti").withColumn("size", F.count("*").over(left)).where(F.col("size") >= CLASS_SIZE)
    return small.unionAll(apart.cogroup(spread(valid)).applyInArrow(_slots, _OUT))


def page_texts(spark, sf_dir: str) -> DataFrame:
    """op6_html_extraction over the whole pages table."""
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
