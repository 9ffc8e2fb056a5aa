"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepared as ship

#: White space of the text contracts: space, and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
#: A word is a maximal run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder (URI) that the driver and all executors see.

    It lies in the folder that spark.checkpoint.dir names, and whoever owns that clears
    it: results may be read long after a query returned. Where the setting is missing, a
    session on one machine gets a temporary folder; any other one, an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = Path(tempfile.mkdtemp(prefix="spark-plumbline-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def landed(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage."""
    path = shared_dir(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.parquet(path)


def keyed(df: DataFrame) -> DataFrame:
    """df with _row, a 64-bit name of each row: by its file and its place there, so null and repeated ids don't matter.

    A plain read of Parquet files names its own rows; anything else is landed first.
    """
    plan = df._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation" or "parquet" not in plan.toString().lower():
        df = landed(df, "rows")
    return df.select("*", F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("_row"))


def sampled(df: DataFrame, most: int, *by: str) -> DataFrame:
    """At most `most` rows of df, the first by a hash of the columns `by`.

    A count sets a threshold for the hash, so few rows beyond `most` are ever sorted or sent on.
    """
    n = df.count()
    if n <= most:
        return df
    h = F.pmod(F.xxhash64(*by), F.lit(1 << 40))
    return df.where(h < int((1 << 40) * min(1.0, (1.1 * most + 50) / n))).orderBy(h, *by).limit(most)


def salted(groups: DataFrame, keys: list[str], salt: str, aggs: dict[str, tuple[Column, Column]]) -> DataFrame:
    """keys, salt and the aggregates of each whole group, for each salt of it that has rows.

    aggs: name -> (aggregate of the rows of one salt, aggregate of those). The salts of a group
    are combined and handed back to each, so rows join on keys and salt and a group of
    any size stays dealt out.
    """
    part = groups.groupBy(*keys, salt).agg(*(a.alias(n) for n, (a, _) in aggs.items()))
    whole = part.groupBy(*keys).agg(*(b.alias(n) for n, (_, b) in aggs.items()), F.collect_set(salt).alias("_salts"))
    return whole.withColumn(salt, F.explode("_salts")).drop("_salts")


def filesystem(uri: str):
    """(filesystem, path) of a URI, for file, HDFS and object stores alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
