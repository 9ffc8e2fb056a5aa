"""Suffix arrays, common prefixes and anchors by brute force; anchors of several shards; megabytes of one byte."""

import hashlib
import random

import numpy as np
import pytest

from plumbline.llm import suffix_dedup as s


def test_suffix_array():
    rng = np.random.default_rng(4)
    for letters, window in ((2, 20), (3, 100), (1, 30)):
        raw = bytes(rng.integers(97, 97 + letters, 900).astype(np.uint8)) + b"ab" * 150
        starts = np.array([i for i in range(len(raw) - window) if i % 200 < 150])
        order, common = s.suffixes(s._words(np.frombuffer(raw, np.uint8)), starts, window)
        assert order.tolist() == sorted(starts.tolist(), key=lambda i: (raw[i : i + window], i))
        for k in range(1, len(order)):
            a, b = raw[order[k - 1] : order[k - 1] + window], raw[order[k] : order[k] + window]
            assert common[k] == next((i for i in range(window) if a[i] != b[i]), window)


def test_anchors():
    """Each window belongs to one anchor, equal windows to equal ones at equal offsets."""
    rng = np.random.default_rng(5)
    for letters in (1, 2, 26):
        texts = [bytes(rng.integers(97, 97 + letters, n).astype(np.uint8)) for n in (0, 99, 100, 350, 1000)]
        texts.append(texts[3][40:340])
        at, h, low, high = s.anchors(np.frombuffer(b"".join(texts), np.uint8), np.array([len(x) for x in texts]), 100)
        data, begin, own = b"".join(texts), 0, {}
        for p, k, a, e in zip(at.tolist(), h.tolist(), low.tolist(), high.tolist()):
            for i in range(a, e + 1):
                assert i not in own
                own[i] = (k, p - i)
        met = {}
        for t in texts:
            for i in range(begin, begin + len(t) - 99):
                assert met.setdefault(data[i : i + 100], own[i]) == own[i]
            begin += len(t)
        assert len(own) == sum(max(0, len(t) - 99) for t in texts)


def brute(rows):
    seen, want = set(), []
    for i, t in rows:
        raw, cov = t.encode(), set()
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                cov.update(range(k, k + 100))
            seen.add(raw[k : k + 100])
        want.append((i, len(raw), len(cov), sum(k - 1 not in cov for k in cov), hashlib.sha256(bytes(c for k, c in enumerate(raw) if k not in cov)).hexdigest()))
    return want


@pytest.mark.parametrize("shard", [4 << 20, 1500])
def test_frequent_anchors(spark, monkeypatch, shard):
    """A passage that most texts share: its anchors go to many shards, which are merged."""
    random.seed(9)
    line = lambda n: "".join(random.choice("abcdefgh ") for _ in range(n))
    passage = line(260)
    rows = [(i, line(random.randrange(80)) + passage[random.randrange(30) : 230 + random.randrange(30)] + line(random.randrange(160))) for i in range(80)]
    monkeypatch.setattr(s, "HOT_ROWS", 10)
    monkeypatch.setattr(s, "HOT_SHARE", 0.0)
    monkeypatch.setattr(s.repeated_spans, "__defaults__", (100, "doc_id", "text", shard))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert sorted(map(tuple, s.remove_repeats(df).collect())) == brute(rows)


def test_one_byte(spark):
    rows = [(1, "a" * 1_500_000), (2, "a" * 99), (3, "ba" + "a" * 120)]
    got = sorted(map(tuple, s.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert [r[:4] for r in got] == [(1, 1_500_000, 1_499_999, 1), (2, 99, 0, 0), (3, 122, 121, 1)]
    assert s.remove_repeats(spark.createDataFrame([], "doc_id long, text string, digest string")).count() == 0
