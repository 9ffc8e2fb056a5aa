"""The data behind the report's charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.geometry import distance
from .histogram import extent, floor_peak, histogram
from .select import fixed, quantiles


def fwhm_overlay(points: DataFrame, cfg: Config = Config(), peak: DataFrame | None = None) -> DataFrame:
    """One row z_left, z_right, level: the peak's width at half the count of the bin whose centre is nearest to it."""
    peak = fixed(floor_peak(points, cfg) if peak is None else peak)
    h = histogram(points, "z", cfg.num_bins).crossJoin(F.broadcast(peak))
    best = h.groupBy("peak_z", "fwhm").agg(F.min_by("n", F.struct(F.abs((F.col("lo") + F.col("hi")) / 2 - F.col("peak_z")), "bin")).alias("n"))
    return best.selectExpr("peak_z - fwhm / 2 AS z_left", "peak_z + fwhm / 2 AS z_right", "n / 2D AS level")


def intensity_threshold(floor: DataFrame, cfg: Config = Config()) -> DataFrame:
    """threshold, passed, failed, bins of the floor's intensity; no rows where there is none (the chart is a placeholder then)."""
    threshold = quantiles(floor, "intensity", [cfg.intensity_percentile / 100])[0][0] if "intensity" in floor.columns else None
    if threshold is None:
        return floor.sparkSession.range(0).selectExpr("0D AS threshold", "id AS passed", "id AS failed", "id AS bins")
    out = floor.agg(F.count_if(F.col("intensity") >= threshold).alias("passed"), F.count_if(F.col("intensity") < threshold).alias("failed"))
    return out.select(F.lit(threshold).alias("threshold"), "passed", "failed", F.expr("least(100L, greatest(20L, (passed + failed) div 50)) AS bins"))


def intensity_histogram(floor: DataFrame, cfg: Config = Config()) -> DataFrame:
    """bin, lo, hi, passed, failed: two histograms of the floor's intensity over one extent, empty bins too; no rows without intensity."""
    one = intensity_threshold(floor, cfg).first()
    if one is None:
        return floor.sparkSession.range(0).selectExpr("id AS bin", "0D AS lo", "0D AS hi", "id AS passed", "id AS failed")
    span = fixed(extent(floor, "intensity"))
    every, passed = (histogram(x, "intensity", one["bins"], span) for x in (floor, floor.where(F.col("intensity") >= one["threshold"])))
    return every.join(passed.selectExpr("bin", "n AS passed"), "bin").selectExpr("bin", "lo", "hi", "passed", "n - passed AS failed")


def with_color_distance(floor: DataFrame) -> DataFrame:
    """floor with dist: the distance of each colour to the mean colour."""
    means = floor.agg(*(F.avg(c) for c in "rgb")).first()
    return floor.withColumn("dist", distance(*zip("rgb", means, strict=True)))


def color_histogram(floor: DataFrame, cfg: Config = Config()) -> DataFrame:
    """bin, lo, hi, n, passed (by the bin's centre) of 59 bins of the colour distance; no rows without colours, or where they hardly vary (the chart is a placeholder then)."""
    empty = floor.sparkSession.range(0).selectExpr("id AS bin", "0D AS lo", "0D AS hi", "id AS n", "false AS passed")
    if not {"r", "g", "b"} <= set(floor.columns):
        return empty
    spread = floor.agg((F.stddev_pop("r") + F.stddev_pop("g") + F.stddev_pop("b")) / 3).first()[0]
    if spread is None or spread <= cfg.color_std_threshold:
        return empty
    c = with_color_distance(floor)
    h = histogram(c, "dist", 59, fixed(c.agg(F.lit(0.0).alias("lo"), (F.max("dist") * 1.05).alias("hi"))))
    return h.selectExpr("bin", "lo", "hi", "n", f"(lo + hi) / 2 <= {cfg.color_tolerance!r}D AS passed")
