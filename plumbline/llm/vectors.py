"""Exact top-k search by inner product over an impact-ordered index, score at a time.

A shard holds some vectors of whole numbers. For each dimension, its places stand in segments of equal
quantised value (impact). A block of queries takes the segments of all dimensions in descending order of what
they can change in its scores, posting by posting for all its queries at once, and keeps for each query and
vector a sum and a bound of what is left. A query stops only when that proves few vectors to be possible
members; those are then scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import landed, shared_dir, ship, table
from .lexical import _items

SHARD = "shard long, dim int, ids array<long>, vectors binary, places binary, seg_dim binary, seg_low binary, seg_high binary, seg_end binary"
#: Shares of all postings after which the bounds are looked at.
LOOKS = (0.65, 0.8, 1.0)
#: Queries that take segments together, and places whose sums for all of them a processor's cache holds.
BLOCK, TILE = 256, 2048
#: Postings of a tile that fill more than one in so many places of their dimensions are multiplied as a matrix.
DENSE = 16
#: Scoring a place exactly takes as long as so many postings in each of its dimensions.
EXACT = 4


def impact_segments(v: np.ndarray, levels: int) -> tuple[np.ndarray, ...]:
    """(places, dimension, least value, greatest value, end) of the segments of n x dim whole numbers: each dimension's range in at most `levels` equal steps."""
    n, dim = v.shape
    low, high = v.min(axis=0), v.max(axis=0)
    step = (high - low) // levels + 1
    level = (v - low) // step
    places = np.argsort(level, axis=0, kind="stable").T.reshape(-1)
    key = np.sort(level, axis=0).T + np.arange(dim)[:, None] * (levels + 1)
    edge = np.flatnonzero(np.diff(key.reshape(-1), prepend=-1, append=-1))
    start, end = edge[:-1], edge[1:]
    value = np.take_along_axis(v, places.reshape(dim, n).T, axis=0).T.reshape(-1)
    return places, start // n, np.minimum.reduceat(value, start), np.maximum.reduceat(value, start), end


def shards(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0, rows: int = 65536, levels: int = 64) -> DataFrame:
    """The landed index of all vectors of whole finite components, floor(scale * component) each, `rows` to a shard."""
    x = F.col(vector_col)
    own = x.isNotNull() & F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    whole = df.where(own).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("long")).alias("v"))

    def row(k, ids, lists):
        dim = max(map(len, lists))
        v = np.zeros((len(ids), dim), np.int64)
        for at, one in enumerate(lists):
            v[at, : len(one)] = one
        seg = impact_segments(v, levels) if dim else [np.zeros(0, np.int64)] * 5
        places, seg_dim, seg_low, seg_high, seg_end = seg
        one = [k, dim, ids, v.tobytes(), places.astype("<u4").tobytes(), *(s.astype("<i8").tobytes() for s in (seg_dim, seg_low, seg_high, seg_end))]
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), *[pa.binary()] * 6]
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(one, kinds, strict=True)], [c.split()[0] for c in SHARD.split(", ")])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, lists = TaskContext.get().partitionId() << 32, [], []
        for b in batches:
            flat, ends = b.column("v").flatten().to_numpy(zero_copy_only=False), np.cumsum(b.column("v").value_lengths().to_numpy(zero_copy_only=False))
            ids += b.column("id").to_pylist()
            lists += np.split(flat, ends[:-1])
            while len(ids) >= rows:
                yield row(at, ids[:rows], lists[:rows])
                at, ids, lists = at + 1, ids[rows:], lists[rows:]
        if ids:
            yield row(at, ids, lists)

    whole = landed(whole, "vectors")
    return landed(whole.repartition(max(1, -(-whole.count() // rows))).mapInArrow(build, SHARD), "vector-shards")


class Shard:
    """One shard, ready to search; processed counts the postings that searches went through, of `seen` in all."""

    def __init__(self, x: dict):
        self.ids, self.dim = x["ids"], x["dim"]
        self.v = np.frombuffer(x["vectors"], np.int64).reshape(len(self.ids), self.dim)
        n = len(self.ids)
        seg_dim, low, high, end = (np.frombuffer(x[c], "<i8") for c in ("seg_dim", "seg_low", "seg_high", "seg_end"))
        start, peak = np.append(0, end[:-1])[: len(end)], np.maximum(np.abs(low), np.abs(high))
        # Of each dimension, segments and their postings in descending order of impact, so that what a search takes is a prefix.
        order = np.lexsort((-peak, seg_dim))
        self.seg_dim, self.peak, self.size = seg_dim[order], peak[order], (end - start)[order]
        places = np.frombuffer(x["places"], "<u4")[np.repeat(start[order] - np.cumsum(self.size) + self.size, self.size) + np.arange(n * self.dim)]
        # Tiles of places: columns at to at + TILE of `places` are the tile's own list in each dimension.
        tile = (places // TILE).astype(np.uint16 if n < TILE << 16 else np.int64).reshape(self.dim, n)
        at = np.argsort(tile, axis=1, kind="stable")
        self.places = np.take_along_axis(places.reshape(self.dim, n), at, axis=1).astype(np.int64)
        self.values = np.take_along_axis(np.ascontiguousarray(self.v.T), self.places, axis=1)
        # By tile and dimension: postings in the first 0, 1, 2 ... segments. Dimension d begins at column heads[d].
        segments = np.bincount(self.seg_dim, minlength=self.dim)
        first = np.cumsum(segments) - segments
        self.heads, tiles = first + np.arange(self.dim), -(-n // TILE)
        count = np.bincount(tile.reshape(-1).astype(np.int64) * len(order) + np.repeat(np.arange(len(order)), self.size), minlength=tiles * len(order)).reshape(tiles, len(order))
        self.upto = np.insert(count, first, 0, axis=1)
        np.cumsum(self.upto, axis=1, out=self.upto)
        self.upto -= np.repeat(self.upto[:, self.heads], segments + 1, axis=1)
        self.most = max(int(self.v.max(initial=0)), -int(self.v.min(initial=0)))
        self.rows = self.v.astype(np.float32 if self.most < 2**24 else float)
        self.key = np.array([np.iinfo(np.int64).max if i is None else i for i in self.ids], np.int64)
        self.null = np.array([i is None for i in self.ids], bool)
        self.seen = self.processed = 0

    def _scores(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        reach = float(np.abs(q.astype(float)).sum()) * self.most
        if reach >= 2**53:
            return self.v[p] @ q
        return (self.rows[p] @ q.astype(np.float32) if reach < 2**24 else self.rows[p].astype(float) @ q.astype(float)).astype(np.int64)

    def _take(self, sums: np.ndarray, rest: np.ndarray, qs: np.ndarray, weight: np.ndarray, took: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Adds segments took to upto of each dimension to the sums of the queries `rest`; the weighted length of what each place has left."""
        dims, kind = np.flatnonzero(upto > took), sums.dtype
        q, left = np.ascontiguousarray(qs[rest][:, dims].T.astype(kind)), np.zeros(sums.shape[1])
        for t, (a, b) in enumerate(zip(self.upto[:, self.heads + took].tolist(), self.upto[:, self.heads + upto].tolist(), strict=True)):
            at, n = t * TILE, min(TILE, len(left) - t * TILE)
            postings = sum(b) - sum(a)
            self.processed += postings * len(rest)
            if postings * DENSE > n * len(dims):
                block = np.zeros((n, len(dims)), kind)
                for j, d in enumerate(dims.tolist()):
                    block[self.places[d, at + a[d] : at + b[d]] - at, j] = self.values[d, at + a[d] : at + b[d]]
                part = block @ q
            else:
                part = np.zeros((n, len(rest)), kind)
                for j, d in enumerate(dims.tolist()):
                    part[self.places[d, at + a[d] : at + b[d]] - at] += self.values[d, at + a[d] : at + b[d], None].astype(kind) * q[j]
            sums[rest, at : at + n] += part.T
            for d in np.flatnonzero(weight).tolist():
                left[self.places[d, at + b[d] : at + n]] += (self.values[d, at + b[d] : at + n] * weight[d]) ** 2
        return np.sqrt(left)

    def members_of_block(self, qs: np.ndarray, k: int, own: np.ndarray) -> list[np.ndarray]:
        """Of each query of a block, the places that can be among its k best: all others are proven not to be."""
        n, every = len(self.ids), np.arange(len(self.ids))
        reach = np.abs(qs.astype(float)).sum(axis=1) * self.most
        found, rest = [every] * len(qs), np.flatnonzero((reach > 0) & (reach < 2**53))
        if n <= 2 * k or not len(rest):
            return found  # too few, no difference, or beyond what doubles hold exactly
        # What a segment can change in the scores of the block: its impact times the root mean square of the queries' components.
        weight = np.sqrt((qs[rest].astype(float) ** 2).mean(axis=0))
        gain = weight[self.seg_dim] * self.peak
        order = np.argsort(-gain, kind="stable")
        order = order[gain[order] > 0]
        if not len(order):
            return found
        done = np.cumsum(self.size[order])
        used = weight > 0
        length = np.sqrt(((qs[:, used] / weight[used]) ** 2).sum(axis=1))
        # Whole numbers, so sums are exact.
        sums, took = np.zeros((len(qs), n), np.float32 if reach[rest].max() < 2**24 else float), np.zeros(self.dim, np.int64)
        group = min(32, n // (2 * k))
        self.seen += int(done[-1]) * len(rest)
        for share in LOOKS:
            to = int(np.searchsorted(done, share * done[-1])) + 1
            upto = np.bincount(self.seg_dim[order[:to]], minlength=self.dim)
            left = self._take(sums, rest, qs, weight, took, upto).astype(sums.dtype)
            took, more, open_ = upto, int(done[-1] - done[min(to, len(order)) - 1]), []
            for i in rest.tolist():
                # The k-th best exact score of the leaders of the best groups of places; no member scores less.
                groups = sums[i, : n // group * group].reshape(-1, group)
                best = np.argpartition(groups.max(axis=1), -2 * k)[-2 * k :]
                lead = best * group + groups[best].argmax(axis=1)
                least = float(np.partition(self._scores(lead[lead != own[i]], qs[i]), -k)[-k])
                # By Cauchy and Schwarz, what is left adds at most the product of the two lengths; the rest is for rounding.
                p = np.flatnonzero(sums[i] >= (least - 2) - left * left.dtype.type(length[i] * (1 + 1e-5)))
                if EXACT * len(p) * self.dim <= more or not more:
                    found[i] = p
                else:
                    open_.append(i)
            rest = np.array(open_, np.int64)
            if not len(rest):
                break
        return found

    def members(self, q: np.ndarray, k: int, own: int = -1) -> np.ndarray:
        return self.members_of_block(q[None], k, np.array([own]))[0]

    def search_block(self, queries: list[np.ndarray], k: int, own: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each query of a block, (places, scores) of the k best vectors but its `own`; of equal scores, the smaller ids."""
        qs, found = np.zeros((len(queries), self.dim), np.int64), []
        for row, q in zip(qs, queries, strict=True):
            row[: len(q)] = q[: self.dim]
        for q, p, me in zip(qs, self.members_of_block(qs, k, own), own, strict=True):
            p = p[p != me]
            score = self._scores(p, q)
            if len(p) > k:
                least = np.partition(score, -k)[-k]
                p, score = p[score >= least], score[score >= least]
            keep = np.lexsort((p, self.key[p], self.null[p], -score))[:k]
            found.append((p[keep], score[keep]))
        return found

    def search(self, q: np.ndarray, k: int, own: int = -1) -> tuple[np.ndarray, np.ndarray]:
        return self.search_block([q], k, np.array([own]))[0]


@lru_cache(1)
def _shard(uri: str, part: int) -> Shard:
    """A landed shard; tasks of one worker mostly take the same one again."""
    return Shard({c: x[0] for c, x in _items(uri, part).items()})


def nearest(index: DataFrame, every: int = 20, k: int = 20, block: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score of the k best other vectors of each indexed one whose id is divisible by `every`.

    Shards are landed by name and queries in blocks of about `block`: each task reads a shard and a block, so only their
    names are dealt out. Of each shard the k best go on.
    """
    spark = ship(index.sparkSession)

    def pick(batches):
        for b in batches:
            for x in b.to_pylist():
                v = np.frombuffer(x["vectors"], np.int64).reshape(len(x["ids"]), x["dim"])
                own = [p for p, i in enumerate(x["ids"]) if i is not None and i % every == 0]
                yield pa.RecordBatch.from_arrays([pa.array([x["shard"]] * len(own), pa.int64()), pa.array(own, pa.int64()), pa.array([x["ids"][p] for p in own], pa.int64()), pa.array([v[p].tobytes() for p in own], pa.binary())], ["home", "own", "query_id", "q"])

    queries = landed(index.select("shard", "dim", "ids", "vectors").mapInArrow(pick, "home long, own long, query_id long, q binary"), "vector-queries")
    parts, uri = max(1, -(-queries.count() // block)), shared_dir(spark, "vector-blocks-of-queries")
    queries.withColumn("part", F.expr(f"pmod(xxhash64(home, own), {parts})")).write.partitionBy("part").parquet(uri)

    by_name = shared_dir(spark, "vector-shards-by-name")
    index.withColumn("part", F.col("shard")).write.partitionBy("part").parquet(by_name)

    def run(batches):
        for b in batches:
            for x in b.to_pylist():
                items = _items(uri, x["part"])
                if items is None:
                    continue
                shard, out = _shard(by_name, x["shard"]), []
                asked = [np.frombuffer(q, np.int64) for q in items["q"]]
                own = np.where(np.array(items["home"], np.int64) == x["shard"], np.array(items["own"], np.int64), -1)
                for at in range(0, len(asked), BLOCK):
                    out += shard.search_block(asked[at : at + BLOCK], k, own[at : at + BLOCK])
                size = [len(p) for p, _ in out]
                again = lambda c: pa.array(np.repeat(np.array(items[c], np.int64), size))  # noqa: E731, B023
                place = np.concatenate([p for p, _ in out])
                cols = [again("home"), again("own"), again("query_id"), pa.array([shard.ids[p] for p in place], pa.int64()), pa.array(np.full(len(place), x["shard"], np.int64)), pa.array(place), pa.array(np.concatenate([s for _, s in out]))]
                yield pa.RecordBatch.from_arrays(cols, ["home", "own", "query_id", "vec_id", "shard", "place", "score"])

    pairs = index.select("shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    dealt = pairs.repartitionByRange(max(1, min(index.count() * parts, 20_000)), "shard", "part")
    found = dealt.mapInArrow(run, "home long, own long, query_id long, vec_id long, shard long, place long, score long")
    best = Window.partitionBy("home", "own").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "shard", "place")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: nearest() over shards() of embeddings.

    Defined cases: vectors that are null or hold a null or non-finite component take no part; a shorter vector counts as filled up
    with zeros; a row with a null id is found, after equal scores with ids, and asks nothing; rows that repeat an id ask and are
    found each for itself, and only the asking row itself is left out; an empty table gives no rows; other columns are
    ignored. Scores wrap beyond 64 bits.
    """
    return nearest(shards(table(spark, sf_dir, "embeddings")))


SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, [floor(64 * x::double) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.r, a.vec_id AS query_id, b.vec_id, b.r AS other, list_inner_product(a.e, b.e)::bigint AS score FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 20 = 0)
SELECT query_id, rank::int AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, other) AS rank FROM s) WHERE rank <= 20
"""
