"""Toxic spans by a linear-chain conditional random field.

Two states (0 ordinary, 1 toxic). Forward and backward messages are kept as ratios of
state 1 to state 0, so each step is one Möbius map over all chains at once.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import sampled, table
from .units import _Index

BITS, CORE = 18, 512
_TOKEN = re.compile(r"\S+")
_TRIM = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def features(word: str) -> list[int]:
    """Hashed features of a token: bias, the word, its length, prefixes and suffix."""
    w = word.lower().strip(_TRIM)
    names = ["b", f"w{w}", f"l{min(len(w), 12)}", f"4{w[:4]}", f"5{w[:5]}", f"6{w[:6]}", f"7{w[:7]}", f"e{w[-3:]}"]
    return [zlib.crc32(x.encode("utf-8", "replace")) & ((1 << BITS) - 1) for x in names]


def _segments(n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Cores of at most CORE tokens of chains of n tokens: first, end, and the chain's bounds."""
    ends = np.cumsum(n)
    k = -(-n // CORE)
    chain = np.repeat(np.arange(len(n)), k)
    part = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
    lo, hi = (ends - n)[chain], ends[chain]
    a = lo + part * CORE
    return a, np.minimum(a + CORE, hi), lo, hi


def messages(e: np.ndarray, n: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ratios r (forward) and s (backward) of each token; emissions e, chain lengths n, potentials move (2 x 2).

    Long chains are cut into cores that start early by a warm-up. A message forgets
    its start by Birkhoff's contraction factor at each step; the warm-up is as long
    as it takes for that to fall below 1e-17, so cutting changes nothing.
    """
    a = np.exp(move)
    cross = np.sqrt(a[0, 0] * a[1, 1] / (a[0, 1] * a[1, 0]))
    rho = abs(cross - 1) / (cross + 1)
    warm = int(np.ceil(np.log(1e-17) / np.log(max(rho, 1e-9)))) if rho < 0.995 else int(n.max(initial=0))
    big = np.exp(np.clip(e, -30, 30))
    r, s = np.ones(len(e)), np.ones(len(e))
    first, end, lo, hi = _segments(n)
    if not len(first):
        return r, s
    x, top = np.ones(len(first)), len(e) - 1
    for t in range(-min(warm, int((first - lo).max())), CORE):
        at = first + t
        on = (at >= lo) & (at < end)
        b = big[np.clip(at, 0, top)]
        x = np.where(on, np.where(at == lo, b, b * (a[0, 1] + a[1, 1] * x) / (a[0, 0] + a[1, 0] * x)), x)
        if t >= 0:
            r[at[on]] = x[on]
    x = np.ones(len(first))
    for t in range(CORE - 1 + min(warm, int((hi - end).max())), -1, -1):
        at = first + t
        on = (at < hi - 1) & (at < end + warm)
        b = big[np.clip(at + 1, 0, top)] * x
        x = np.where(on, (a[1, 0] + a[1, 1] * b) / (a[0, 0] + a[0, 1] * b), x)
        if t < CORE:
            core = at < end
            s[at[core]] = x[core]
    return r, s


def marginals(e: np.ndarray, n: np.ndarray, move: np.ndarray) -> np.ndarray:
    r, s = messages(e, n, move)
    return r * s / (1 + r * s)


@dataclass
class Tagger:
    weights: np.ndarray
    move: np.ndarray
    blend: np.ndarray  # of a document's evidence: bias, log(1 + expected toxic tokens), largest log-odds

    def emission(self, word: str) -> float:
        return float(self.weights[features(word)].sum())

    def document_scores(self, p: np.ndarray, n: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-evidence(p, n) @ self.blend))


def evidence(p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A document's inputs to its score, from the marginals of its tokens; zeros where it has none."""
    some = n > 0
    starts = (np.cumsum(n) - n)[some]
    x = np.zeros((len(n), 3))
    x[:, 0], x[:, 2] = 1, -6
    if len(p):
        x[some, 1] = np.log1p(np.add.reduceat(p, starts))
        x[some, 2] = np.clip(np.log(np.maximum.reduceat(p, starts) + 1e-9) - np.log1p(1e-9 - np.maximum.reduceat(p, starts)), -6, 6)
    return x


def token_labels(words: np.ndarray, n: np.ndarray, toxic: np.ndarray, table_: np.ndarray, strength: float = 20.0, least: int = 3, most_forms: int = 5) -> np.ndarray:
    """Labels of tokens from labels of documents.

    A token of a toxic document is labelled 1 if the word or a prefix of it occurs so much
    more in toxic documents than in clean ones that twice the log likelihood ratio exceeds
    `strength`. A document counts once for each different word that has the feature, up
    to most_forms; a feature needs `least` toxic documents.
    """
    doc = np.repeat(np.arange(len(n)), n)
    use = table_[:, [1, 3, 4, 5, 6]]
    forms = np.unique(doc.astype(np.int64) << 32 | words)
    d, w = forms >> 32, forms & 0xFFFFFFFF
    total = np.bincount((toxic[d] > 0).astype(int), minlength=2)
    c1, c0, docs = (np.zeros(1 << BITS) for _ in range(3))
    for column in use.T:
        once = np.unique((d << BITS | column[w]) * len(table_) + w) // len(table_)
        pairs, many = np.unique(once, return_counts=True)
        kind, bad, many = pairs & ((1 << BITS) - 1), toxic[pairs >> BITS] > 0, np.minimum(many, most_forms).astype(float)
        c1 += np.bincount(kind[bad], many[bad], 1 << BITS)
        c0 += np.bincount(kind[~bad], many[~bad], 1 << BITS)
        docs += np.bincount(kind[bad], minlength=1 << BITS)
    share = total[1] / max(total.sum(), 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(c1 > 0, c1 * np.log(c1 / ((c1 + c0) * share)), 0) + np.where(c0 > 0, c0 * np.log(c0 / ((c1 + c0) * (1 - share))), 0))
    strong = (g > strength) & (docs >= least) & ((c1 + 0.5) / (total[1] + 1) > 8 * (c0 + 0.5) / (total[0] + 1))
    return (strong[use].any(axis=1)[words] & (toxic[doc] > 0)).astype(float)


def distinct_enough(chains: list[np.ndarray], names: np.ndarray, hashes: int = 6) -> list[int]:
    """Places of the documents that share no minimum hash of word triples with an earlier one. names: a hash of each word.

    Copies of one document would otherwise make its rare words look like a class's words.
    """
    odd = np.random.default_rng(3).integers(1, 1 << 62, hashes, dtype=np.uint64) | np.uint64(1)
    seen, kept = set(), []
    for d, x in enumerate(chains):
        h = names[x].astype(np.uint64)
        h = (h[:-2] * np.uint64(31) + h[1:-1]) * np.uint64(1000003) + h[2:] if len(h) > 2 else h
        h = (h ^ (h >> np.uint64(17))) * np.uint64(0x9E3779B97F4A7C15)
        least = {(k, int((h * m >> np.uint64(8)).min())) for k, m in enumerate(odd)} if len(h) else {(-1, 0)}
        if not least & seen:
            kept.append(d)
        seen |= least
    return kept


def fit_tagger(chains: list[np.ndarray], names: np.ndarray, table_: np.ndarray, toxic: np.ndarray, clean_share: float | None = None, rounds: int = 30, rate: float = 0.5, l2: float = 1e-6) -> Tagger:
    """Train on documents: token labels, then gradient ascent (AdaGrad) of the chains' likelihood, then a logistic blend, with classes weighted to clean_share.

    chains: the word numbers of each document; names, table_: a hash and the features of each word.
    """
    kept = distinct_enough(chains, names)
    chains, toxic = [chains[d] for d in kept], toxic[kept]
    n = np.array([len(x) for x in chains], np.int64)
    weights, move = np.zeros(1 << BITS), np.array([[0.0, -4.0], [-1.0, -1.0]])
    if not n.sum() or toxic.min() == toxic.max():
        mean = float(np.clip(toxic.mean(), 1e-3, 0.999)) if len(toxic) else 0.01
        return Tagger(weights - 1, move, np.array([np.log(mean / (1 - mean)), 0.0, 0.0]))
    words = np.concatenate(chains).astype(np.int64)
    y = token_labels(words, n, toxic, table_)
    first = np.cumsum(n)[n > 0] - n[n > 0]
    inner = np.ones(len(y), bool)
    inner[first] = False
    inner = np.flatnonzero(inner)
    pairs = lambda u, v: np.array([[((1 - u) * (1 - v)).sum(), ((1 - u) * v).sum()], [(u * (1 - v)).sum(), (u * v).sum()]])
    seen = pairs(y[inner - 1], y[inner])
    sum_w, sum_m = np.full(1 << BITS, 1e-8), np.full((2, 2), 1e-8)
    weights[features("")[0]] = -2.0
    for _ in range(rounds):
        e = weights[table_].sum(axis=1)[words]
        r, s = messages(e, n, move)
        p = r * s / (1 + r * s)
        a, b = np.exp(move), np.exp(np.clip(e, -30, 30))[inner] * s[inner]
        joint = [a[0, 0], a[0, 1] * b, r[inner - 1] * a[1, 0], r[inner - 1] * a[1, 1] * b]
        some = joint[0] + joint[1] + joint[2] + joint[3]
        push = np.bincount(words, y - p, len(table_))
        grad = np.bincount(table_.ravel(), np.repeat(push, table_.shape[1]), 1 << BITS) / len(n) - l2 * weights
        turn = (seen - np.array([(x / some).sum() for x in joint]).reshape(2, 2)) / len(n)
        turn[0, 0] = 0
        sum_w, sum_m = sum_w + grad**2, sum_m + turn**2
        weights, move = weights + rate * grad / np.sqrt(sum_w), np.clip(move + rate * turn / np.sqrt(sum_m), -6, 3)
    x, blend = evidence(marginals(weights[table_].sum(axis=1)[words], n, move), n), np.zeros(3)
    mean = 1 - toxic.mean()
    w = np.where(toxic > 0, 1, clean_share / (1 - clean_share) * (1 - mean) / mean if clean_share and clean_share < 1 else 1)
    for _ in range(25):
        q = 1 / (1 + np.exp(-x @ blend))
        blend = blend + np.linalg.solve((x * (w * q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(3), x.T @ (w * (toxic - q)) - 1e-2 * blend)
    blend[1:] = np.maximum(blend[1:], 0)
    return Tagger(weights, move, blend)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


#: A word's hash and features.
_ROW = np.dtype([("name", "<u8"), ("features", "<u4", 8)])


def _hashed(rows: DataFrame, most_tokens: int) -> DataFrame:
    """_toxic, names (64-bit hashes of the tokens, in order) and table (a hash and features of each distinct one) of rows of _text, _toxic."""

    def run(batches):
        for b in batches:
            out = []
            for text in b.column("_text").to_pylist():
                words = text.split()
                if len(words) > most_tokens:  # runs of 50 tokens from all over the text, by a hash of their place
                    starts = sorted(range(0, len(words), 50), key=lambda i: zlib.crc32(b"%d" % i))[: most_tokens // 50]
                    words = [w for i in sorted(starts) for w in words[i : i + 50]]
                index = _Index()
                chain = [index[w] for w in words]
                name = np.frombuffer(b"".join(hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=8).digest() for w in index), "<u8")
                rows = np.zeros(len(name), _ROW)
                rows["name"], rows["features"] = name, np.array([features(w) for w in index], "<u4").reshape(-1, 8)
                out.append((name[chain].tobytes() if chain else b"", rows.tobytes()))
            yield pa.RecordBatch.from_arrays([b.column("_toxic"), *(pa.array([x[i] for x in out], pa.binary()) for i in (0, 1))], ["_toxic", "names", "table"])

    return rows.select(F.col("_toxic").cast("int").alias("_toxic"), "_text").mapInArrow(run, "_toxic int, names binary, table binary")


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_toxic: int = 1000, max_clean: int = 2000, most_tokens: int = 2000) -> Tagger:
    """A tagger from at most max_toxic and max_clean labelled rows that aren't held out, the first by a hash.

    That is the one bounded sample. The driver gets the hashed features of its words, and of a
    text of more than most_tokens tokens runs from all over it; no texts. Of an id's labels
    the largest counts.
    """
    known = labels.where(~held_out()).select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("_toxic")).where("_id IS NOT NULL AND _toxic IS NOT NULL")
    known = known.groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    clean = known.agg(F.avg((F.col("_toxic") == 0).cast("double"))).first()[0]
    texts = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).where("_text IS NOT NULL")
    parts, chains, toxic = [np.zeros(0, _ROW)], [], []
    for kind, most in ((1, max_toxic), (0, max_clean)):
        # At most `most` ids: that bounds the broadcast. Rows that repeat an id are bounded by the second sample.
        ids = sampled(known.where(F.col("_toxic") == kind), most, "_id")
        rows = sampled(texts.join(F.broadcast(ids), "_id"), most, "_id", "_text")
        for b in _hashed(rows, most_tokens).toArrow().to_batches():
            for names, table_ in zip(b.column("names"), b.column("table"), strict=True):
                chains.append(np.frombuffer(names.as_buffer(), "<u8").copy())
                toxic.append(kind)
                parts.append(np.frombuffer(table_.as_buffer(), _ROW).copy())
                if len(parts) > 200:
                    parts = [_distinct(parts)]
    words = _distinct(parts)
    order = sorted(range(len(chains)), key=lambda k: (-toxic[k], chains[k].tobytes()))
    return fit_tagger([np.searchsorted(words["name"], chains[k]).astype(np.int32) for k in order], words["name"], words["features"].astype(np.int64), np.array([toxic[k] for k in order], float), clean)


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    rows = np.concatenate(parts)
    return rows[np.unique(rows["name"], return_index=True)[1]]


def _marker(tagger: Tagger, most_words: int):
    """texts -> marginals of all their tokens, and the texts' numbers of tokens; words keep their emissions in a bounded dictionary."""
    index, e = _Index(), np.zeros(0)

    def run(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        nonlocal index, e
        if len(index) > most_words:
            index, e = _Index(), np.zeros(0)
        chains = [np.fromiter(map(index.__getitem__, w), np.int32, len(w)) for w in (x.split() for x in texts)]
        e = np.append(e, [tagger.emission(w) for w in index.new])
        index.new = []
        n = np.array([len(x) for x in chains], np.int64)
        return marginals(e[np.concatenate(chains)] if len(chains) else np.zeros(0), n, tagger.move), n

    return run


def toxic_scores(df: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text", most_words: int = 300_000) -> DataFrame:
    """doc_id, score, spans (start and end in code points, end exclusive) of each row of df.

    Every token of the whole text has a marginal; the score blends the expected number of
    toxic tokens with the largest one; spans are runs of tokens of at least 0.5.
    A null or empty text has no tokens and no spans, and gets the lowest score.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])

    def run(batches):
        tag = _marker(tagger, most_words)
        for b in batches:
            texts = b.column("text").to_pylist()
            p, n = tag(texts)
            spans: list[list] = [[] for _ in texts]
            ends = np.cumsum(n)
            hot = np.flatnonzero(p >= 0.5)
            for d in np.unique(np.searchsorted(ends, hot, "right")):
                own = set((hot[(hot >= ends[d] - n[d]) & (hot < ends[d])] - (ends[d] - n[d])).tolist())
                for k, m in enumerate(_TOKEN.finditer(texts[d])):
                    if k in own:
                        if k - 1 in own and spans[d]:
                            spans[d][-1]["end"] = m.end()
                        else:
                            spans[d].append({"start": m.start(), "end": m.end()})
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(tagger.document_scores(p, n)), pa.array(spans, schema.field("spans").type)], schema=schema)

    return rows.mapInArrow(run, "doc_id long, score double, spans array<struct<start: int, end: int>>")


def drop_toxic(df: DataFrame, labels: DataFrame, limit: float = 0.3, text_col: str = "text", most_words: int = 300_000) -> DataFrame:
    """df without the rows whose score is at least limit; columns as they were.

    Each row is judged by its own text as it streams by, so a null or repeated doc_id changes nothing.
    """
    tagger = train(df, labels, text_col=text_col)

    def run(batches):
        tag = _marker(tagger, most_words)
        for b in batches:
            scores = tagger.document_scores(*tag([x or "" for x in b.column(text_col).to_pylist()]))
            yield b.filter(pa.array(scores < limit))

    return df.mapInArrow(run, df.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query. A null doc_id isn't held out; a repeated doc_id gets a row each; with no or one-sided labels all scores are equal."""
    docs = table(spark, sf_dir, "documents")
    scores = toxic_scores(docs, train(docs, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))
