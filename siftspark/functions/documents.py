"""Functions over free JSON and summaries that no built-in expresses; Arrow batches throughout."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from urllib.parse import parse_qsl, urlencode, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import TRACKERS

PIECE_CHARS = 1 << 18  # characters that are tokenized at once
_CITATION = re.compile(r"\[[0-9]+\]\((https?://[^)]+)\)")


def drop_keys(column, keys: tuple[str, ...]) -> Column:
    """A JSON text without some keys at any depth; broken JSON stays as it is."""
    gone = frozenset(keys)

    def clean(x):
        if isinstance(x, dict):
            return {k: clean(v) for k, v in x.items() if k not in gone}
        return [clean(v) for v in x] if isinstance(x, list) else x

    def run(batch: pd.Series) -> pd.Series:
        out = []
        for t in batch:
            try:
                out.append(None if t is None else json.dumps(clean(json.loads(t)), separators=(",", ":"), ensure_ascii=False))
            except ValueError:
                out.append(t)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "string")(column)


def first_difference(a, b) -> Column:
    """The path at which two JSON texts first differ, null if they are equal; a missing key is a null."""

    def differ(x, y, path):
        if isinstance(x, dict) and isinstance(y, dict):
            for k in sorted(set(x) | set(y)):
                if (d := differ(x.get(k), y.get(k), f"{path}.{k}" if path else k)) is not None:
                    return d
            return None
        if isinstance(x, list) and isinstance(y, list):
            if len(x) != len(y):
                return path
            return next((d for k, (u, v) in enumerate(zip(x, y)) if (d := differ(u, v, f"{path}[{k}]")) is not None), None)
        return None if x == y and isinstance(x, bool) == isinstance(y, bool) else path

    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([differ(*(json.loads(t) if t else None for t in p), "") for p in zip(left, right)], dtype=object)

    return F.pandas_udf(run, "string")(a, b)


def plain_source_key(u: str) -> str:
    """text.source_key of one URL."""
    at = urlsplit(u.strip())
    bare = f"{at.scheme}://{at.netloc}{at.path}" if at.netloc else at.path
    bare = re.sub(r"/$", "", re.sub(r"^(https?://)www\.", r"\1", bare.lower()))
    query = urlencode(sorted(p for p in parse_qsl(at.query, keep_blank_values=True) if not p[0].lower().startswith("utm_") and p[0].lower() not in TRACKERS))
    return bare + "?" * bool(query) + query


def renumber(summary, urls) -> Column:
    """Citations [n](url) of a summary numbered by the last place, from 1, of a URL of the same
    source in the list; other links, and citations of sources that aren't there, stay."""

    def run(texts: pd.Series, lists: pd.Series) -> pd.Series:
        out = []
        for t, urls_ in zip(texts, lists):
            place = {plain_source_key(u or ""): n for n, u in enumerate(urls_ if urls_ is not None else [], 1)}
            out.append(None if t is None else _CITATION.sub(lambda m: f"[{n}]({m[1]})" if (n := place.get(plain_source_key(m[1]))) else m[0], t))
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "string")(summary, urls)


def _token_counts(tokenizer, texts: Iterable[str | None]) -> Iterator[int]:
    """Tokens of each text. Encodings are far larger than texts, so few are there at once."""
    piece, size = [], 0

    def counted() -> list[int]:
        return [len(e.ids) for e in tokenizer.encode_batch_fast(piece, add_special_tokens=False)]

    for x in texts:
        piece.append(x or "")
        size += len(piece[-1])
        if size > PIECE_CHARS:
            yield from counted()
            piece, size = [], 0
    yield from counted()


def tokenizer_count(column, path: str) -> Column:
    """Tokens of a text by a tokenizer file of the tokenizers library."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        for batch in batches:
            yield pd.Series(list(_token_counts(t, batch)), dtype="int32")

    return F.pandas_udf(run, "int")(column)
