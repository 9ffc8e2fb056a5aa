"""The pipeline's run() and op2, op5 and op8 as queries, against brute force."""

import random

import duckdb
import numpy as np
from test_llm import SF, brute_words

import corpus_pipeline
from plumbline.llm import registry, secrets, unigram


def documents():
    return duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet' ORDER BY ALL").fetchall()


def test_pipeline_run(spark, tmp_path):
    random.seed(11)
    words = lambda: " ".join(random.choice("pqrstuvw") + str(random.randrange(90)) for _ in range(40))
    lone, near, copy = [words() for _ in range(30)], words(), words()
    rows = [(None if k % 3 == 0 else k % 7, t) for k, t in enumerate(lone)]
    rows += [(None, copy), (None, copy), (None, near), (50, near + " a"), (None, near + " b"), (None, None)]
    docs = spark.createDataFrame([(i, t, f"s{k % 2}") for k, (i, t) in enumerate(rows)], "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    model = unigram.load(unigram.model_path())
    texts = model.decode(np.array([x for r in got for x in r.ids], np.int32), np.array([len(r.ids) for r in got]))
    found = [(r.doc_id, t.decode()) for r, t in zip(got, texts, strict=True)]
    want = {*((i, t) for i, t in rows[:30]), (None, copy), (50, near + " a"), (None, "")}
    assert set(found) == want and max(map(found.count, want)) <= 2 and all(r.round_trip for r in got)


def test_op2_query(spark):
    rows = registry.queries()["op2_quality"](spark, SF).collect()
    got = sorted((r.doc_id, r.n_words, r.n_repeat_words, r.base_failed) for r in rows)
    want = []
    for i, t in documents():
        n, repeat = len(t.encode().split()), brute_words(t)
        want.append((i, n, repeat, n < 20 or 100 * repeat > 30 * n))
    assert got == sorted(want)
    assert all(r.kept == (not r.base_failed and r.score >= 0.5) for r in rows)


def test_op5_query(spark):
    model = unigram.load(unigram.model_path())
    got = {r.doc_id: list(r.ids) for r in registry.queries()["op5_sentencepiece"](spark, SF).collect()}
    docs = documents()
    ids, n = model.encoder()([t for _, t in docs])
    assert model.decode(ids, n) == [t.encode().replace(unigram.MARK.encode(), b" ") for _, t in docs]
    assert got == {i: x.tolist() for (i, _), x in zip(docs, np.split(ids, np.cumsum(n)[:-1]), strict=True)}


def test_op8_query(spark):
    got = sorted((r.doc_id, r.base_sha256) for r in registry.queries()["op8_secrets"](spark, SF).collect())
    assert got == sorted((i, secrets.base_digest(t)) for i, t in documents())
