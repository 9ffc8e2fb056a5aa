"""A deterministic point cloud projected from lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepared

_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def points(spark: SparkSession, sf_dir: str, indexed: bool = False) -> DataFrame:
    """x, y, z, r, g, b, intensity; with vertex_idx first if indexed.

    The index is dense and global without a global sort: key ranges are counted, their
    counts summed up, and rows numbered within their range.
    """
    rows = prepared(spark).read.parquet(f"{sf_dir}/lineitem.parquet")
    if indexed:
        rows = rows.withColumn("_range", F.expr("l_orderkey div 4096"))
        before = rows.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.expr("coalesce(sum(_n) OVER (ORDER BY _range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)").alias("_before"))
        rows = rows.join(F.broadcast(before), "_range").withColumn("vertex_idx", F.expr(f"_before + row_number() OVER (PARTITION BY _range ORDER BY {', '.join(_ORDER)}) - 1"))
    rows = rows.withColumn("x", F.expr("(l_extendedprice - 900D) / 104100D * 20D")).withColumn("y", F.expr("datediff(l_shipdate, timestamp'1995-01-01') / 2500D * 10D"))
    z = "CASE WHEN l_returnflag <> 'R' THEN 0.002D * x + 0.001D * y + (l_discount - 0.05D) * 0.2D + (l_tax - 0.04D) * 0.25D ELSE 0.3D + l_quantity / 50D * 2.5D END"
    return rows.selectExpr(*["vertex_idx"] * indexed, "x", "y", f"{z} AS z", "l_discount * 10D AS r", "l_tax * 12.5D AS g", "l_quantity / 50D AS b", "l_quantity * 20D + l_discount * 100D AS intensity")
