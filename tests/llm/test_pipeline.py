"""The pipeline against a plain version of each stage, and every registered query on the smallest tables."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from siftspark.llm import decontaminate, pieces, quality, registry, toxicity
from siftspark.llm.common import hash_strings, words
from test_dedup import brute

DATA = "/root/testdata/sf0.001"


def plain_quality(spark, docs):
    """The classifier fitted and applied on one machine."""
    frame, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    rows = sorted(toxicity.sample(frame, labels, "quality", quality.TRAIN_ROWS).collect(), key=lambda r: (r.o, r.i))
    model = quality.fit(pa.array([r.t for r in rows]), np.array([r.y for r in rows], np.int32))
    p, _, n = quality.score(model, pa.array(list(docs.values()), pa.string()))
    return {i: t for (i, t), q, k in zip(docs.items(), p, n) if k and q >= model["threshold"]}


def plain_exact(docs):
    first = {}
    for i in sorted(docs):
        first.setdefault(docs[i], i)
    return {i: t for t, i in first.items()}


def plain_near(docs):
    _, root = brute(docs)
    return {i: t for i, t in docs.items() if root.get(i, i) == i}


def plain_leaks(docs, items):
    """Every document aligned with every item."""

    def hashed(text):
        codes, _, vocabulary = words(pa.array([text]))
        return hash_strings(vocabulary)[codes]

    items = [h for h in map(hashed, items) if len(h)]
    held = lambda w, x: decontaminate.local_score(w, x) >= (decontaminate.SHARE if len(x) >= decontaminate.SEED else 1) * decontaminate.MATCH * len(x)
    return {i: t for i, t in docs.items() if not any(held(w, x) for w in [hashed(t)] for x in items)}


def test_pipeline_against_plain_stages(spark):
    import sentencepiece

    docs = dict(duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet'").fetchall())
    items = [r[0] for r in duckdb.sql(f"select text from '{DATA}/benchmark.parquet'").fetchall()]
    sizes = [len(docs)]
    for stage in (lambda d: plain_quality(spark, d), plain_exact, plain_near, lambda d: plain_leaks(d, items)):
        docs = stage(docs)
        sizes.append(len(docs))
    got = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id for r in got} == set(docs) and len(got) == len(docs)
    assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) == len(sizes)  # every stage takes something
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert all(r.ids == library.encode(docs[r.doc_id]) and r.n_tokens == len(r.ids) and r.round_trip for r in got)


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**6, "", "en", None, 0), (10**6, "", "en", None, 0), (10**6 + 1, None, None, "s", 5)], docs.schema)
    docs = docs.unionAll(odd)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.columns
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.count() > 0 and (docs.columns == before or k == len(corpus_pipeline.STAGES) - 1), name
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.where("false"), DATA).count() == 0


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_registered_queries(spark, name):
    df = registry.QUERIES[name](spark, DATA)
    if name not in registry.ORACLE:
        assert df.count() > 0
        return
    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    result = c.sql(registry.ORACLE[name])
    at = [result.columns.index(x) for x in sorted(df.columns)]
    want = sorted(tuple(r[i] for i in at) for r in result.fetchall())
    assert sorted(tuple(r[x] for x in sorted(df.columns)) for r in df.collect()) == want


def test_stages_with_clashing_columns_and_a_very_long_text(spark, tmp_path):
    """Columns named like the operators' own, one text of megabytes: every stage goes through."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    long = " ".join(f"word{k % 5000}" for k in range(400_000))
    extra = spark.createDataFrame([(10**6, long, "en", "web", len(long)), (None, long, "en", "web", len(long)), (None, None, None, None, None)], docs.schema)
    docs = docs.unionAll(extra)
    for name in ("print", "maybe", "rank", "drop_id", "maybe_gone", "sig", "id", "ids", "keep", "quality", "i", "t", "o", "y"):
        docs = docs.withColumn(name, docs.n_chars)
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, DATA)
        assert docs.columns == columns or k == len(corpus_pipeline.STAGES) - 1
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert docs.count() > 0
