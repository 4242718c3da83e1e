import random
import re
import time
from collections import Counter, defaultdict
from html import unescape
from time import thread_time

import numpy as np
import pytest

from siftspark.llm import extraction

WORDS = [f"term{k}" for k in range(2000)]


def page(title, paragraphs, links):
    nav = "".join(f'<li><a href="/{x}">{x}</a></li>' for x in links)
    return f'<!DOCTYPE html><html><head><title>{title}</title><script>var t="</p>";</script></head><body><nav class="top"><ul>{nav}</ul></nav><article><h1>{title}</h1>' + "".join(f"<p>{p}" for p in paragraphs) + '</article><footer>Copyright of the example site</footer></body></html>'


def site(n=20, seed=0):
    rng = random.Random(seed)
    word = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    return [(word(4), [word(20) for _ in range(rng.randint(1, 4))], [rng.choice(WORDS) for _ in range(rng.randint(2, 6))]) for _ in range(n)]


def test_template_leaves_the_slots(spark):
    rows = [(k, f"http://a.example/{k}", page(*s)) for k, s in enumerate(site())]
    odd = [(100, "http://a.example/x", None), (101, "http://b.example/", page("t", ["one two"], ["x"])), (102, None, "<p>no host"), (103, "http://c.example", ""), (0, rows[0][1], rows[0][2])]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows + odd], "page_id long, url string, html string, text string, slots int")
    out = extraction.extract_pages(pages)
    assert out.count() == len(rows) + len(odd)
    got = {r.page_id: r for r in out.collect()}
    for k, (title, paragraphs, links) in enumerate(site()):
        text = got[k].text
        assert got[k].classes >= 1 and "Copyright" not in text and "<" not in text
        assert got[k].slots[0] == title and text.split()[-20:] == paragraphs[-1].split()
        assert text.split() == [*title.split(), *links, *title.split(), *" ".join(paragraphs).split()]
    assert got[100].slots is None and got[103].slots == [] and got[102].text == "no host"
    assert got[101].template_tokens == 0 and "one two" in got[101].text
    assert extraction.extract_pages(pages.where("false")).count() == 0


def plain_tokens(pages):
    """Codes of (tag or word, tag before), token by token."""
    token = re.compile(r"(<!--.*?(?:-->|$)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\2\s*>|$)|<[^<>]*>?|[^<\s]+)", re.S | re.I)
    codes, known, out = {}, {}, []
    for page in pages:
        last = ""
        for t, block in token.findall(page):
            if t[0] == "<":
                last = known.get(t) or known.setdefault(t, extraction._tag(t, block))
            out.append(codes.setdefault((last, None if t[0] == "<" else t), len(codes)))
    return out, list(codes)


def test_reading_is_that_of_single_tokens_and_takes_less_time():
    rng = np.random.default_rng(4)
    words = np.array([f"w{k}" for k in range(20_000)])
    page = lambda: "<html>\u2003" + "".join(f"<p class=c{rng.integers(9)}>{' '.join(rng.choice(words, 40))}\x85</p>\n" for _ in range(15)) + "<script>a < b</script> end<!-- x"
    pages = [page() for _ in range(600)] + ["", " ", "no tag", "<b", "a<SCRIPT>x</script >b\x1cc"]
    took = []
    for _ in range(3):
        began = thread_time()
        codes, tokens = plain_tokens(pages)
        plain = thread_time() - began
        began = thread_time()
        group = extraction.Group(pages)
        took.append((thread_time() - began) / plain)
    names = list(zip(group.reader.tag, group.reader.text))
    assert [names[c] for c in group.flat] == [tokens[c] for c in codes] and len(group.length) == len(pages)
    assert min(took) < 0.7


def identities(html):
    """(identity, word or None) of each token, read plainly."""
    reader = extraction.Reader()
    codes = reader.read(html).tolist()
    return [((reader.tag[c], reader.text[c]), reader.text[c]) for c in codes]


def longest_rising(x):
    """One longest increasing subsequence by dynamic programming; ties as patience sorting breaks them."""
    return extraction._rising(x)


def brute(pages):
    """(slots) of each of one host's pages: vectors, order and nesting by plain loops."""
    different = list(dict.fromkeys(p for p in pages if p is not None))
    read = {p: identities(p) for p in different}
    vector, place = defaultdict(dict), defaultdict(int)
    weight = Counter(p for p in pages if p is not None)
    tag = {}
    for k, p in enumerate(different):
        where = defaultdict(list)
        for at, (t, w) in enumerate(read[p]):
            where[t].append((at << 28) // len(read[p]))
            tag[t] = w is None
        for t, at in where.items():
            vector[t][k] = len(at)
            place[t] += sum(at) // len(at) * weight[p]
    groups = defaultdict(list)
    for t, v in vector.items():
        groups[tuple(sorted(v.items()))].append(t)
    classes = []
    for v, names in groups.items():
        if sum(weight[different[k]] for k, _ in v) < extraction.SHARE * sum(weight.values()):
            continue
        if len(names) >= extraction.CLASS_SIZE and len(v) >= (extraction.PAGES if any(tag[t] for t in names) else extraction.WORD_PAGES):
            names.sort(key=lambda t: place[t])
            wrong = set()
            for p in different:
                times, sequence = Counter(), []
                for t, _ in read[p]:
                    if t in names:
                        sequence.append((t, times[t] * len(names) + names.index(t)))
                        times[t] += 1
                keep = longest_rising([x for _, x in sequence])
                wrong |= {t for (t, _), ok in zip(sequence, keep) if not ok}
            left = [t for t in names if t not in wrong]
            if len(left) >= extraction.CLASS_SIZE:
                classes.append((-sum(weight[different[k]] for k, _ in v), -len(left), left))
    out = []
    for p in pages:
        if p is None:
            out.append(None)
            continue
        ids = [t for t, _ in read[p]]
        taken = []
        for _, _, names in sorted(classes, key=lambda c: c[:2]):
            at = [k for k, t in enumerate(ids) if t in names]
            ok = bool(at)
            for outer in taken:
                here = [k for k, t in enumerate(ids) if t in outer]
                slots = [sum(x < k for x in here) for k in at]
                runs = [slots[k : k + len(names)] for k in range(0, len(at), len(names))]
                within = all(len(set(r)) == 1 for r in runs) and len({r[0] % len(outer) for r in runs}) == 1
                across = len(here) * len(names) == len(at) * len(outer) and len({tuple(x - k * len(outer) for x in r) for k, r in enumerate(runs)}) == 1
                ok &= within or across
            if ok:
                taken.append(names)
        template = {t for names in taken for t in names}
        slots, words = [], []
        for t, w in read[p]:
            if t in template:
                slots += [unescape(" ".join(words))] * bool(words)
                words = []
            elif w is not None:
                words.append(w)
        out.append(slots + [unescape(" ".join(words))] * bool(words))
    return out


def mixed_site(n, seed):
    """Two layouts, shuffled blocks, repeated pages, a null and an empty page."""
    rng = random.Random(seed)
    out = []
    for title, paragraphs, links in site(n, seed):
        if rng.random() < 0.5:
            out.append(page(title, paragraphs, links))
        else:
            rows = "".join(f'<div class="item"><b>Price</b>{x}<i>Buy now</i></div>' for x in links)
            blocks = ["<aside>Related things here</aside>", "<form>Search the shop</form>"]
            rng.shuffle(blocks)
            out.append(f"<html><body class=shop><h2>Shop of {title} today</h2>{rows}{''.join(blocks)}<p>{paragraphs[0]}<footer>Imprint and terms</footer></body></html>")
    return out + out[:3] + [None, "", "<p>", "plain words"]


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("part_bytes", [1 << 30, 20_000, 3_000])
@pytest.mark.parametrize("share", [0.01, 0.2])
def test_pages_against_brute_force(spark, monkeypatch, seed, part_bytes, share):
    """Whatever the parts that a host comes in, its pages have the slots of plain loops over all."""
    monkeypatch.setattr(extraction, "SHARE", share)
    hosts = {f"h{k}.example": mixed_site(n, seed * 10 + k) for k, n in enumerate((2, 9, 40))}
    rows = [(k * 1000 + i, f"https://{h}/p/{i}", x) for k, (h, pages) in enumerate(hosts.items()) for i, x in enumerate(pages)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, part string, h int")
    got = {r.page_id: r.slots for r in extraction.extract_pages(frame, part_bytes=part_bytes).collect()}
    assert len(got) == len(rows)
    for k, pages in enumerate(hosts.values()):
        for i, slots in enumerate(brute(pages)):
            assert got[k * 1000 + i] == slots, (k, i)


def test_two_layouts_each_have_a_template():
    pages = mixed_site(60, 5)
    group = extraction.Group(pages)
    c = group.classes()
    _, _, slots = group.extract(extraction._without(c, group.wrong(c)))
    text = ["\n".join(s) for s in slots if s]
    assert not any("Copyright" in t or "Imprint" in t or "Price" in t or "Buy now" in t for t in text)
    assert not any("Shop of" in t or "today" in t for t in text)


def test_a_host_of_identical_pages_keeps_its_text(spark):
    one = page("the title", ["some words of it", "more of them"], ["a", "b"])
    frame = spark.createDataFrame([(k, "http://same.example/", one) for k in range(300)], "page_id long, url string, html string")
    for part_bytes in (1 << 30, 5_000):
        out = extraction.extract_pages(frame, part_bytes=part_bytes).collect()
        assert len(out) == 300 and all("some words of it" in r.text and "the title" in r.text and r.classes == 0 for r in out)


def test_ten_thousand_pages_and_a_page_of_a_hundred_thousand_words(spark):
    rows = [(k, f"http://big.example/{k}", page(*s)) for k, s in enumerate(site(10_000, 3))]
    long = [" ".join(WORDS[(7 * i + j) % 2000] for i in range(100_000)) for j in range(3)]
    rows += [(20_000 + j, f"http://long.example/{j}", page(f"t{j}", [x], ["u"])) for j, x in enumerate(long)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)
    began = time.perf_counter()
    got = {r.page_id: r for r in extraction.extract_pages(frame, part_bytes=2 << 20).collect()}
    assert time.perf_counter() - began < 120 and len(got) == len(rows)
    for k, (title, paragraphs, links) in enumerate(site(10_000, 3)):
        assert got[k].text.split() == [*title.split(), *links, *title.split(), *" ".join(paragraphs).split()]
    assert all(len(got[20_000 + j].text.split()) >= 100_000 for j in range(3))


def test_html_moves_once_for_large_hosts_too(spark):
    """All passes over a large host's pages read one exchange."""
    rows = [(k, f"http://a.example/{k}", page(*s)) for k, s in enumerate(site(80))]
    out = extraction.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), part_bytes=5_000)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    plan = plan[: plan.find("Initial Plan")] if "Initial Plan" in plan else plan
    assert plan.count("ReusedExchange") >= 2
