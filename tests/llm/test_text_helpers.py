import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from siftspark.llm import common


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40))))
def test_words_are_runs_of_letters_and_digits(texts):
    codes, ends, vocabulary = common.words(pa.array(texts, pa.string()))
    vocabulary = vocabulary.to_pylist()
    assert len(ends) == len(texts) + 1 and ends[-1] == len(codes)
    for k, t in enumerate(texts):
        mine = [vocabulary[c] for c in codes[ends[k] : ends[k + 1]]]
        assert "" not in mine
        if t is None or t.isascii():
            assert mine == re.findall(r"[a-z0-9]+", (t or "").lower())


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(max_size=30)))
def test_hash_depends_on_the_string_alone(texts):
    h = common.hash_strings(pa.array(texts, pa.string()))
    for t, x in zip(texts, h):
        assert common.hash_strings(pa.array(["x", t, "yy"]))[1] == x
    assert len(set(h.tolist())) == len(set(texts))


def test_slices_keep_all_rows():
    batch = pa.record_batch({"i": list(range(50)), "t": ["x" * (1 << 20)] * 49 + [None]})
    parts = list(common.slices([batch], 1))
    assert len(parts) > 5 and np.concatenate([p.column(0).to_numpy() for p in parts]).tolist() == list(range(50))


def test_fresh_ignores_case(spark):
    df = spark.createDataFrame([(1, 2)], "Shard int, shard_ int")
    assert common.fresh(df, "shard") == "shard__"


def test_without_ids_either_way(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (2, "d")], "doc_id long, drop_id string")
    gone = spark.createDataFrame([(2,), (9,)], "doc_id long")
    for limit in (0, 1 << 20):
        out = common.without_ids(docs, "doc_id", gone, limit)
        assert out.columns == docs.columns and sorted(r.drop_id for r in out.collect()) == ["a", "c"]
