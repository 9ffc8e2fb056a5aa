"""Exact order statistics and samples that no task has to hold whole."""

from __future__ import annotations

from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


#: Samples of at most so many rows are merged in one task.
ONE_PASS = 10_000


def local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver as local data, which plans and Spark itself read without a job."""
    kind = StructType.fromDDL(schema)
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kind)
    return spark.createDataFrame(pa.table([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, kind, strict=True)], names=kind.names), kind)


def fixed(one: DataFrame) -> DataFrame:
    """The single row of a DataFrame as local data: computed now, so plans built on it don't compute it again."""
    return one.sparkSession.createDataFrame(one.toArrow(), one.schema)


def bucket(col: str, low: float, high: float, buckets: int) -> Column:
    """Number of the equal bucket of a value between low and high."""
    width = (high - low) / buckets
    return F.least(F.floor((F.col(col) - F.lit(low)) / F.lit(width)), F.lit(buckets - 1)).cast("int") if width > 0 else F.lit(0)


class Ranks:
    """Which values have which ranks, from counts of buckets: counts[condition, bucket], and the least and greatest value of each bucket.

    A bucket with one value tells it at once; the values of the others are looked up together by values().
    """

    def __init__(self, counts: np.ndarray, low: np.ndarray, high: np.ndarray, shares: list[float]):
        self.totals, self.shares = counts.sum(axis=1).tolist(), shares
        ends = np.cumsum(counts, axis=1)
        self.known: dict[tuple[int, int], float] = {}  # (condition, rank) -> value
        self.open: dict[tuple[int, int], tuple[int, int]] = {}  # (condition, rank) -> bucket, rank within it
        for k, total in enumerate(self.totals):
            for p in shares:
                for r in {floor(p * (total - 1)), min(floor(p * (total - 1)) + 1, total - 1)} if total else ():
                    b = int(np.searchsorted(ends[k], r, "right"))
                    if low[b] == high[b]:
                        self.known[k, r] = float(low[b])
                    else:
                        self.open[k, r] = (b, int(r - ends[k][b] + counts[k][b]))

    def values(self, rows: DataFrame, on: list[str]) -> list[list[float | None]]:
        """The quantiles of each condition; rows: v, at (its bucket) and what the conditions need, read only if a bucket is open."""
        if self.open:
            sums = [F.count_if(F.expr(c)).alias(f"n{k}") for k, c in enumerate(on)]
            values = rows.where(F.col("at").isin({b for b, _ in self.open.values()})).groupBy("at", "v").agg(*sums)
            values = values.select("at", "v", *(F.expr(f"sum(n{k}) OVER (PARTITION BY at ORDER BY v)").alias(f"s{k}") for k in range(len(on))))
            found = values.agg(*(F.min(F.expr(f"IF(at = {b} AND s{k} > {r}, v, NULL)")).alias(f"q{i}") for i, ((k, _), (b, r)) in enumerate(self.open.items()))).first()
            self.known |= dict(zip(self.open, found, strict=True))
        return [[self._one(k, p, total) for p in self.shares] for k, total in enumerate(self.totals)]

    def _one(self, k, p, total):
        if not total:
            return None
        x, r = p * (total - 1), floor(p * (total - 1))
        a, b = self.known[k, r], self.known[k, min(r + 1, total - 1)]
        return a if a == b else (r + 1 - x) * a + (x - r) * b


def quantiles(df: DataFrame, col: str, shares: list[float], on: list[str] | None = None, buckets: int = 1 << 14) -> list[list[float | None]]:
    """Exact interpolated quantiles of a column, for each condition of `on` (all rows by default); None where a condition has no values.

    Two or three passes of any size: the extent; counts of equal buckets, which tell the bucket of
    each rank; and, where such a bucket has several values, the counts of those alone, summed up in order. NaN
    counts as missing.
    """
    on = on or ["true"]
    rows = df.where(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double"))).select(F.col(col).cast("double").alias("v"), *(F.expr(c).alias(f"c{k}") for k, c in enumerate(on)))
    own = [f"c{k}" for k in range(len(on))]
    rows = rows.where(" OR ".join(own))
    low, high = rows.agg(F.min("v"), F.max("v")).first()
    if low is None:
        return [[None] * len(shares) for _ in on]
    rows = rows.withColumn("at", bucket("v", low, high, buckets))
    counts, ends = np.zeros((len(on), buckets), np.int64), np.full((2, buckets), np.nan)
    for r in rows.groupBy("at").agg(F.min("v"), F.max("v"), *(F.count_if(c) for c in own)).collect():  # one row a bucket
        ends[:, r[0]], counts[:, r[0]] = r[1:3], r[3:]
    return Ranks(counts, *ends, shares).values(rows, own)


def sample_exact(df: DataFrame, k: int, seed: int = 42, key: str = "vertex_idx") -> DataFrame:
    """Exactly k rows (all, if there are fewer), without replacement, the same for a seed, whatever the partitions.

    Rows have a hash of seed and key as their rank; of ties the lesser key comes first. Up to ONE_PASS rows, each
    partition keeps its k first ones and those are merged, in one scan, when the rows are asked for. Beyond, a
    count tells where the k-th rank lies; the few rows around there alone are sorted, and
    the sample is then a filter. Both ways give the same rows.
    """
    if k <= 0:
        return df.limit(0)
    rank = F.expr(f"cast(conv(substr(md5(concat('{seed}|', {key})), 1, 15), 16, 10) AS bigint)")
    if k <= ONE_PASS:
        return df.withColumn("_rank", rank).orderBy("_rank", key).limit(k).drop("_rank")
    n = df.count()
    if n <= k:
        return df
    ranked, top = df.withColumn("_rank", rank), 1 << 60
    slack = 8 * k**0.5 + 20
    low, high = int(max(0.0, (k - slack) / n) * top), int(min(1.0, (k + slack) / n) * top)
    below, within = ranked.agg(F.count_if(F.col("_rank") < low), F.count_if(F.col("_rank") < high)).first()
    if not below < k <= within:  # more than eight standard deviations off
        low, high, below = 0, top, 0
    last = ranked.where(F.col("_rank").between(low, high - 1)).select("_rank", key).orderBy("_rank", key).offset(k - below - 1).limit(1).first()
    return ranked.where((F.col("_rank") < last[0]) | ((F.col("_rank") == last[0]) & (F.col(key) <= last[1]))).drop("_rank")
