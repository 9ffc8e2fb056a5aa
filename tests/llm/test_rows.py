"""The pipeline's stages decide by row: null and repeated ids against brute force."""

import random
import re
from collections import Counter

from plumbline.llm import exact_dedup, jaccard_join, mixing, toxicity

SCHEMA = "doc_id long, text string, source string, n long"


def table(spark, rows):
    """(id, text) rows, numbered by n."""
    return spark.createDataFrame([(i, t, f"s{k % 2}", k) for k, (i, t) in enumerate(rows)], SCHEMA)


def left(df):
    return sorted(r.n for r in df.collect())


def test_toxic_rows(spark):
    random.seed(5)
    rows, labels = [], []
    for i in range(300):
        w = ["".join(random.choice("abcdefgh") for _ in range(4)) for _ in range(30)]
        if i % 3 == 0:
            w[random.randrange(30)] = "vilest"
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 3 == 0)))
    rows += [(None, "so vilest a thing"), (None, "abcd efgh"), (0, "abcd efgh"), (None, None), (777, "")]
    df, lab = table(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    scored = toxicity.toxic_scores(df, toxicity.train(df, lab), id_col="n").collect()
    want = sorted(r.doc_id for r in scored if r.score < 0.3)
    got = toxicity.drop_toxic(df, lab)
    assert left(got) == want and got.columns == df.columns
    assert {301, 302, 303, 304} <= set(want) and 300 not in want


def test_exact_rows(spark):
    rows = [(None, "a b"), (None, "a b"), (None, "ab"), (1, "c d"), (1, "c d"), (None, "c d"), (1, "alone"), (None, "alone too"), (3, "x y"), (2, "x y"), (None, "x  y"), (5, None), (None, "")]
    left_rows = [rows[k] for k in left(exact_dedup.drop_exact_copies(table(spark, rows)))]
    want = {}
    for i, t in rows:
        rank = (-len(t or ""), i is None, i or 0)
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        want[norm] = min(want.get(norm, rank), rank)
    got = {re.sub(r"[\x20\x09-\x0D]", "", t or ""): (-len(t or ""), i is None, i or 0) for i, t in left_rows}
    assert got == want and len(left_rows) == len(want)


def test_near_rows(spark):
    random.seed(6)
    words = lambda: [random.choice("pqrstuvw") + str(random.randrange(40)) for _ in range(60)]
    base, rows = [words() for _ in range(4)], []
    for k in range(40):
        w = list(base[k % 4])
        w[59] = f"e{k}"
        # Groups 0 and 1 have null ids among others, group 2 has no other ids, group 3 repeats its smallest id.
        rows.append((None if k % 4 == 2 or k % 3 == 0 and k % 4 < 2 else 7 if k % 4 == 3 else k + 10, " ".join(w)))
    rows += [(7, " ".join(words())), (None, " ".join(words())), (None, None), (None, ""), (7, " ")]
    kept = left(jaccard_join.drop_near_copies(table(spark, rows)))
    assert [k for k in kept if k >= 40] == [40, 41, 42, 43, 44]
    for g in range(4):
        own = [k for k in kept if k < 40 and k % 4 == g]
        assert len(own) == 1
        assert rows[own[0]][0] == min((rows[k][0] for k in range(g, 40, 4) if rows[k][0] is not None), default=None)


def test_mixed_rows(spark):
    rows = [(None if k % 3 == 0 else k % 20, "w " * (1 + k % 7) * (2 - k % 2)) for k in range(200)]
    df = table(spark, rows)
    reads = mixing.mix(df, max_repeats=1.25, target_entropy=0.999, block_tokens=50, seed=17).collect()
    got = mixing.mixed_documents(df, max_repeats=1.25, target_entropy=0.999, block_tokens=50, seed=17)
    many = Counter(r.n for r in got.collect())
    assert set(many) == set(range(200)) and max(many.values()) <= 2
    name = lambda i, s, n: (str(i), s, n)
    assert Counter(name(rows[k][0], f"s{k % 2}", len(rows[k][1].split())) for k in many.elements()) == Counter(name(r.doc_id, r.source, r.n_tokens) for r in reads)
    assert got.columns == df.columns
