"""The Jaccard join on few, unrelated, equal, common and far-apart documents."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import jaccard_join as j


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"tag": F.lit("x"), "n": F.lit(1), "keys": F.lit(None).cast("string")})


def got(df, **options):
    return [r.component_id for r in j.jaccard_components(df, **options).orderBy("doc_id").collect()]


@pytest.mark.parametrize("texts, want", [(["a b c d e f"], [0]), (["a b c d e f", "p q r s t u v"], [0, 1]), (["a b c d e f"] * 2, [0, 0])])
def test_few(spark, texts, want):
    assert got(table(spark, texts)) == want


def test_common_shingles(spark):
    """Shingles of all documents travel without names, and change nothing."""
    random.seed(12)
    shared = " ".join(f"s{k}" for k in range(60))
    texts = [shared + "".join(f" u{d}x{k}" for k in range(3 if d < 6 else 80)) for d in range(12)] + ["y " * 200000]
    sets = j.shingle_sets(table(spark, texts), row_col=None).collect()
    common = np.sort(np.array([c.key for r in sets if r.common for c in r.common], np.int64).view(np.uint64))
    assert len(common) >= 56
    df = table(spark, texts).select("doc_id", "text")
    links = [{frozenset(map(bytes, r)) for r in j.components(j.jaccard_links(df, 8, x)).collect()} for x in (common, common[:0])]
    assert links[0] == links[1] and len(links[0]) == 6


def test_far_apart(spark):
    """Documents that share their shingles but are far from each other and from all pivots are compared in tiles."""
    random.seed(13)
    blocks = [" ".join(f"b{b}w{k}" for k in range(30)) for b in range(14)]
    texts = [" ".join(random.sample(blocks, 3)) for _ in range(60)]
    texts += [x + " tail" for x in texts[::7]]
    df, sets = table(spark, texts), []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for k, b in enumerate(sets[:i]):
            if 4 * len(a & b) >= 3 * len(a | b):
                old, new = max(root[i], root[k]), min(root[i], root[k])
                root = [new if r == old else r for r in root]
    assert got(df, leaf=3, pivots=2, levels=2) == root == got(df)
