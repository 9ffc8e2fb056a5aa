"""Quality rules: gradient-boosted trees over document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import landed, sampled, table
from .units import _Index, chunks

SYMBOLS, BLANKS, WINDOW = "#*$%&|<>", " \t\n\x0b\x0c\r", 8
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Features of the trees; the sign is the direction that quality may take as the feature grows (0: any).
FEATURES = {"log_words": 0, "mean_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "distinct_share": 0, "words_per_line": 0, "stops_per_word": 0, "commas_per_word": 0, "digit_share": 0, "upper_share": 0, "short_share": 0, "top_share": 0}


def statistics(texts: list[str]) -> dict[str, np.ndarray]:
    """BASE counts and FEATURES of whole texts, all texts at once.

    Words are split as bytes, whose white space is exactly space and \\t to \\r.
    Equal 8-word windows are found by 64-bit hashes of word numbers and text number.
    """
    index = _Index()
    words = [x.encode("utf-8", "replace").split() for x in texts]
    n = np.array([len(x) for x in words], np.int64)
    flat = np.fromiter((index[w] for x in words for w in x), np.uint64, int(n.sum()))
    doc = np.repeat(np.arange(len(n)), n)
    ends = np.cumsum(n)
    out = {"n_words": n}
    out["word_chars"] = np.array([len(x) - sum(map(x.count, BLANKS)) for x in texts], np.int64)
    out["n_symbols"] = np.array([sum(map(x.count, SYMBOLS)) for x in texts], np.int64)
    lines = [[y for y in x.split("\n") if y.strip(BLANKS)] for x in texts]
    n_lines = np.array([len(x) for x in lines], np.int64)
    out["n_dup_lines"] = n_lines - np.array([len(set(x)) for x in lines], np.int64)
    repeat = np.zeros(len(n), np.int64)
    if len(flat) >= WINDOW:
        odd = np.random.default_rng(8).integers(1, 1 << 62, WINDOW + 1, dtype=np.uint64) | np.uint64(1)
        mix = (flat + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mix ^= mix >> np.uint64(29)
        h = sum((mix[k : len(mix) - WINDOW + 1 + k] * odd[k] for k in range(1, WINDOW)), mix[: len(mix) - WINDOW + 1] * odd[0])
        h = h + doc[: len(h)].astype(np.uint64) * odd[WINDOW]
        at = np.flatnonzero(doc[: len(h)] == doc[WINDOW - 1 :])
        h, order = h[at], np.argsort(h[at])
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(flat) + 1, np.int64)
        hit = at[order[(np.append(same, False) | np.append(False, same))[: len(order)]]]
        twice[hit] += 1
        np.subtract.at(twice, np.minimum(hit + WINDOW, len(flat)), 1)
        repeat = np.bincount(doc[np.cumsum(twice[:-1]) > 0], minlength=len(n))
    out["n_repeat_words"] = repeat
    many, some_lines = np.maximum(n, 1), np.maximum(n_lines, 1)
    raw = [x.encode("utf-8", "replace") for x in texts]
    size = np.maximum([len(x) for x in raw], 1)
    without = lambda drop: np.array([len(x) - len(x.translate(None, drop)) for x in raw])
    per = np.zeros((2, len(n)))
    for d, (a, b) in enumerate(zip(ends - n, ends, strict=True)):
        if b > a:
            _, count = np.unique(flat[a:b], return_counts=True)
            per[:, d] = len(count), count.max()
    short = np.fromiter((len(w) <= 3 for x in words for w in x), bool, len(flat))
    values = [
        np.log1p(n), out["word_chars"] / many, out["n_symbols"] / many, out["n_dup_lines"] / some_lines, repeat / many, per[0] / many, n / some_lines,
        without(b".") / many, without(b",") / many, without(b"0123456789") / size, without(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") / size,
        np.bincount(doc[short], minlength=len(n)) / many, per[1] / many,
    ]
    return out | dict(zip(FEATURES, (np.asarray(x, float) for x in values), strict=True))


def document_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id with BASE (long) and FEATURES (double) of each row's whole text; a null text has no words."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches):
        for b in (c for b in batches for c in chunks(b, "text")):
            s = statistics(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, s.values())], ["doc_id", *s])

    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", " + ", ".join(f"{c} double" for c in FEATURES))


@dataclass
class Trees:
    """A forest as flat node arrays. A leaf has feature -1; roots are where trees begin."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the rows of x, all rows a level at a time."""
        total, rows = np.full(len(x), self.bias), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while (inner := self.feature[node] >= 0).any():
                f = np.maximum(self.feature[node], 0)
                node = np.where(inner, np.where(x[rows, f] <= self.threshold[node], self.left[node], self.right[node]), node)
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 10, l2: float = 1.0) -> Trees:
    """Newton boosting on binned features. A split on a constrained feature must order its children's values, and their midpoint bounds all that grows below."""
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    bias = float(np.log(mean / (1 - mean)))
    nodes: list[list] = []
    roots = []
    if len(y) == 0 or y.min() == y.max():
        return Trees(*(np.zeros(0, t) for t in (int, float, int, int, float, int)), bias)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)])
    total = np.full(len(y), bias)

    def grow(rows, g, h, level, low, high):
        value = float(np.clip(-g[rows].sum() / (h[rows].sum() + l2), low, high))
        me = len(nodes)
        nodes.append([-1, 0.0, 0, 0, rate * value])
        best = (1e-6, None)
        if level < depth and len(rows) >= 2 * least:
            gs, hs = g[rows].sum(), h[rows].sum()
            for f, b in enumerate(binned):
                if not len(cuts[f]):
                    continue
                k = b[rows]
                gl, hl, nl = (np.cumsum(np.bincount(k, w, len(cuts[f]) + 1))[:-1] for w in (g[rows], h[rows], None))
                vl, vr = np.clip(-gl / (hl + l2), low, high), np.clip(-(gs - gl) / (hs - hl + l2), low, high)
                gain = -(2 * gl * vl + (hl + l2) * vl**2) - (2 * (gs - gl) * vr + (hs - hl + l2) * vr**2) + (2 * gs * value + (hs + l2) * value**2)
                gain[(nl < least) | (len(rows) - nl < least) | (signs[f] * (vr - vl) < 0)] = 0
                if gain.max() > best[0]:
                    at = int(gain.argmax())
                    best = (gain[at], (f, at, (vl[at] + vr[at]) / 2))
        if best[1]:
            f, at, mid = best[1]
            go = binned[f][rows] <= at
            lows, highs = [low, low], [high, high]
            if signs[f]:
                lows[signs[f] > 0] = highs[signs[f] < 0] = mid
            kids = [grow(r, g, h, level + 1, lo, hi) for r, lo, hi in ((rows[go], lows[0], highs[0]), (rows[~go], lows[1], highs[1]))]
            nodes[me] = [f, float(cuts[f][at]), *kids, 0.0]
        else:
            total[rows] += rate * value
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -8.0, 8.0))
    f, t, a, b, v = zip(*nodes, strict=True)
    return Trees(np.array(f), np.array(t), np.array(a), np.array(b), np.array(v), np.array(roots), bias)


def train(stats: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> Trees:
    """Trees from at most max_labelled rows of stats that labels (doc_id, quality) know."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL")
    known = sampled(known.groupBy("doc_id").agg(F.max("y").alias("y")), max_labelled, "doc_id")
    # At most max_labelled ids: that bounds the broadcast. Rows that repeat an id are bounded by the second sample.
    rows = sampled(stats.join(F.broadcast(known), "doc_id"), max_labelled, "doc_id", *BASE).select("doc_id", "y", *FEATURES).toPandas()
    rows = rows.sort_values(list(rows.columns))
    return fit_trees(rows[list(FEATURES)].to_numpy(float), rows["y"].to_numpy(float), list(FEATURES.values()))


def quality_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = 20_000) -> DataFrame:
    """Statistics and a quality probability of each row of df: doc_id, BASE, base_failed, score.

    The trees learn labels.quality from at most max_labelled labelled rows, the first by a hash
    of id and counts: the one bounded sample, collected to the driver as 13 numbers a row. Statistics
    are computed once, written to the shared folder and scored from there.

    Defined cases: a null or empty text has no words and fails the base rules; a null id is
    scored but never learnt from; a repeated id gets a row each; with no labels, or one class
    only, every document gets the same score; an empty table gives no rows; other columns are ignored.
    """
    stats = landed(document_statistics(df, id_col, text_col), "quality")
    model = train(stats, labels, max_labelled)

    def score(batches):
        for b in batches:
            p = model.score(np.stack([b.column(c).to_numpy() for c in FEATURES], axis=1))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ["doc_id", *BASE]), pa.array(p)], ["doc_id", *BASE, "score"])

    scored = stats.mapInArrow(score, "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", score double")
    return scored.withColumn("base_failed", F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: quality_scores() with its verdict at 0.5."""
    scored = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", *BASE, "base_failed", F.expr("NOT base_failed AND score >= 0.5").alias("kept"), "score")
