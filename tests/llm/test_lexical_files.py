"""Shards of the ranked search are files; what goes through Spark is their names."""

import numpy as np

from plumbline.llm import lexical
from plumbline.llm._common import filesystem


def test_only_names_go_through_spark(spark):
    rng = np.random.default_rng(16)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 5000, 300)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    index = lexical.shards(df, shard_bytes=20_000)
    cut, n = lexical.blocked(index)
    assert n == 60 and index.count() == cut.count() >= 6
    for rows in (index.collect(), cut.collect()):
        assert max(len(str(tuple(r))) for r in rows) < 400  # shards hold some 20,000 bytes of text each
    held = [lexical._loaded(r.file, "doc_ids", "terms", "df") for r in cut.orderBy("shard").collect()]
    assert [i for x in held for i in x["doc_ids"].to_pylist()] == list(range(60))
    assert sum(sum(x["df"].to_pylist()) for x in held) == sum(len(set(t.split())) for t in texts)
    fs, path = filesystem(cut.first().file)
    assert fs.get_file_info(path).size > 2000
