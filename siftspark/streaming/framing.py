"""JSON objects out of text chunks, and server-sent events out of chunks."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frames(buffer: str) -> tuple[list[dict], str]:
    """The whole JSON objects at the start of a buffer, and what is left; invalid text stays."""
    out, at = [], 0
    decoder = json.JSONDecoder()
    while True:
        while at < len(buffer) and buffer[at].isspace():
            at += 1
        try:
            value, at = decoder.raw_decode(buffer, at)
        except json.JSONDecodeError:
            return out, buffer[at:]
        out.append(value)


def unframe(chunks: DataFrame, stream: str, order: str, chunk: str) -> DataFrame:
    """(stream, seq, object): the JSON objects of each stream's chunks put end to end."""
    rows = chunks.select(F.col(stream).cast("long").alias("stream"), F.col(order).cast("long").alias("o"), F.col(chunk).alias("c"))

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        found, _ = frames("".join(pdf.sort_values("o")["c"].fillna("")))
        n = len(found)
        return pd.DataFrame({"stream": pd.Series([pdf["stream"].iloc[0]] * n, dtype="int64"), "seq": pd.Series(range(n), dtype="int64"), "object": pd.Series([json.dumps(x, ensure_ascii=False) for x in found], dtype=object)})

    return rows.groupBy("stream").applyInPandas(split, "stream long, seq long, object string")


def sse(text) -> Column:
    """A chunk as a server-sent event: each line after ``data: ``, a blank line at the end."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.concat(F.lit("data: "), F.when(x == "", " ").otherwise(x)))
    return F.concat(F.array_join(lines, "\n"), F.lit("\n\n"))


def event(kind: str, content) -> Column:
    return F.to_json(F.struct(F.lit(kind).alias("type"), content.alias("content")))
