"""What the Jaccard join keeps on disk and sends for shuffles."""

import os

import numpy as np

from plumbline.llm import jaccard_join as j
from test_jaccard_parts import NONE, written


def on_disk(spark):
    """Bytes of the shuffle files that the session holds now."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(os.path.getsize(os.path.join(a, f)) for top in folders for a, _, names in os.walk(top.getPath()) for f in names if f.startswith("shuffle_"))


def test_shuffles_are_freed(spark, tmp_path):
    """Once sets are landed, neither the shingles that travelled nor those sent back are on disk; the setting is as it was."""
    rng = np.random.default_rng(16)
    lines = [" ".join(f"l{i}w{k}" for k in range(20)) for i in range(60)]
    texts = [" ".join(lines[i] for i in rng.integers(0, 60, 12)) for _ in range(400)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path := str(tmp_path / "docs"))
    docs = spark.read.parquet(path)
    for setting in (None, "true", "false"):
        spark.conf.unset(j._CLEANUP) if setting is None else spark.conf.set(j._CLEANUP, setting)
        was = spark.conf.get(j._CLEANUP), on_disk(spark), written(spark)
        sets = j.shared_sets(docs, 16, NONE, rounds=3)
        assert sets.count() and not any(f.startswith("shared-") for f in os.listdir(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")))
        sent, held = written(spark) - was[2], on_disk(spark) - was[1]
        assert sent > 400 * 200 * 8 * 2 and held < 0.02 * sent and spark.conf.get(j._CLEANUP) == was[0]
    spark.conf.unset(j._CLEANUP)


def test_rounds_change_nothing(spark):
    """Sets, shingles and prefixes are the same in any number of rounds, also where a round has no shingle at all."""
    rng = np.random.default_rng(17)
    lines = [" ".join(f"l{i}w{k}" for k in range(12)) for i in range(30)]
    texts = [" ".join(lines[i] for i in rng.integers(0, 30, 5)) for _ in range(60)] + ["a b", "a b", "c d e f g", "c d e f g h", ""]
    got = []
    for some, rounds in ((texts, 1), (texts, 2), (texts, 7), (["a b c d e"], 1), (["a b c d e"], 5), ([""], 2)):
        docs = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
        got.append(sorted((bytes(r.tag), r.n, r["keys"], r.prefix) for r in j.shared_sets(docs, 8, NONE, rounds=rounds).collect()))
    assert got[0] == got[1] == got[2] and len(got[0]) > 30 and got[3:] == [[], [], []]


def test_texts_stay_where_they_are(spark, tmp_path):
    """The rows that go are sent to the texts; only beyond `most_sent` of them do texts travel, to the same result."""
    rng = np.random.default_rng(18)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 10**6, 500)) for _ in range(200)]
    texts += [x + " tail" for x in texts[:80]]
    spark.createDataFrame([(i, x, i % 7) for i, x in enumerate(texts)], "doc_id long, text string, more long").write.parquet(path := str(tmp_path / "docs"))
    docs, sent, left = spark.read.parquet(path), [], []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    for options in ({}, {"most_sent": 10}):
        kept = j.drop_near_copies(docs, **options)
        before = written(spark)
        kept.write.format("noop").mode("overwrite").save()
        sent.append(written(spark) - before)
        left.append(sorted(map(tuple, kept.collect())))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert left[0] == left[1] == [(i, x, i % 7) for i, x in enumerate(texts[:200])]
    assert sent[0] < 20_000 and sent[1] > 100_000
