"""The shared shingles of the Jaccard join, by any number of parts, tasks and files."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import jaccard_join as j

NONE = np.zeros(0, np.uint64)


def written(spark):
    """Bytes that all stages so far have written for shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_bytes_do_not_grow_with_parts(spark):
    """A tag travels with several shingles, however many parts there are."""
    rng = np.random.default_rng(14)
    df = spark.createDataFrame([(d, " ".join(f"w{k}" for k in rng.integers(0, 10**6, 400))) for d in range(300)], "doc_id long, text string").coalesce(1).cache()
    df.count()
    sent = []
    for parts in (32, 800):
        before = written(spark)
        assert j.shared_sets(df, parts, NONE).count() == 0
        sent.append(written(spark) - before)
    assert 300 * 396 * 8 < sent[0] and sent[1] < 1.5 * sent[0]


def test_parts_in_tasks_and_files(spark):
    """Sets, shingles and prefixes are the same however parts are dealt out and held."""
    rng = np.random.default_rng(15)
    lines = [" ".join(f"l{i}w{k}" for k in range(12)) for i in range(40)]
    texts = [" ".join(lines[i] for i in rng.integers(0, 40, 6)) for _ in range(120)]
    texts += texts[:30] + [x + " a tail" for x in texts[30:60]] + [" ".join(f"own{d}w{k}" for k in range(50)) for d in range(20)] + ["", "a b"]
    found = {j._tag(x): x for x in j.Shingler()(texts) if len(x)}
    df = Counter(np.concatenate(list(found.values())).tolist())
    want = {}
    for tag, x in found.items():
        keys = [k for k in x.tolist() if df[k] > 1]
        need = (3 * len(x) + 3) // 4
        if len(keys) >= need:
            want[tag] = (len(x), sorted(keys), sorted(sorted(keys, key=lambda k: (df[k], k))[: len(keys) - need + 1]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    signed = lambda x: sorted(np.array(x, np.int64).view(np.uint64).tolist())
    for options in ({"parts": 8}, {"parts": 40, "wide": 2}, {"parts": 40, "wide": 2, "held": 0}, {"parts": 40, "wide": 3, "held": 3000}):
        got = {bytes(r.tag): (r.n, signed(r.keys), signed(r.prefix)) for r in j.shared_sets(docs.select(F.col("doc_id"), "text"), common=NONE, **options).collect()}
        assert got == want and 100 < len(want) < len(found)
