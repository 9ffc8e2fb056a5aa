"""The registered queries over the point cloud."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import format_size
from ..operators import charts, floor, grid, histogram, select, surface, view
from ..session import shared_dir
from ..sources import ply
from ..sources.fixture import points
from .report import report, report_fields

CFG = Config()
ROI = ((5.0, 15.0), (2.0, 8.0))
BAND = (-0.05, 0.1)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, with no negative zero."""
    return df.select(*((F.round(c, places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _floor(spark: SparkSession, d: str) -> DataFrame:
    return floor.with_floor(points(spark, d)).where("is_floor").drop("in_band", "is_floor")


def _roi(spark: SparkSession, d: str, indexed: bool = False) -> DataFrame:
    return view.z_band(view.roi(points(spark, d, indexed), *ROI), *BAND)


def _ply(s, d):
    """The cloud written as PLY files with zone maps to the shared folder, and read from there."""
    folder = shared_dir(s, "cloud")
    ply.write_ply(points(s, d, indexed=True), folder)
    ply.write_zones(s, folder, every=100_000)
    return ply.read_ply(s, folder)


def _nearest(s, d):
    pts = _roi(s, d, True)
    x0, x1, y0, y1, _ = view.spans(pts, 1)
    nodes = view.lattice(pts, 25)
    found = surface.nearest(nodes, surface.ranked(pts), x0, y0, max(x1 - x0, y1 - y0), 0.05)
    return rounded(nodes.join(found, ["ix", "iy"]))


def _counts(**kwargs):
    return lambda s, d: floor.stage_counts(points(s, d), **kwargs)


def _peak(cfg: Config, scale: float = 1.0):
    return lambda s, d: rounded(histogram.floor_peak(points(s, d).withColumn("z", F.col("z") * scale), cfg))


def _funnel(s, d):
    rows = "array(named_struct('stage', 'total', 'n', total), named_struct('stage', 'after_z_filter', 'n', after_z_filter), named_struct('stage', 'after_refinement', 'n', after_refinement))"
    return rounded(floor.stage_counts(points(s, d)).select("total", F.inline(F.expr(rows))).selectExpr("stage", "n", "n / cast(greatest(total, 1) AS double) * 100 AS pct"))


def _ratio(s, d):
    out = floor.with_floor(points(s, d)).agg(F.count_if("is_floor").alias("floor"), F.count_if(~F.col("is_floor")).alias("non_floor"))
    return rounded(out.selectExpr("floor", "non_floor", "coalesce(try_divide(floor, floor + non_floor), 0D) AS floor_ratio"))


def _refine(s, d):
    pts = points(s, d)
    return rounded(floor.refine_stats(pts, histogram.floor_peak(pts)))


def _intensity(s, d):
    return rounded(charts.intensity_threshold(_floor(s, d)))


def _color(s, d):
    return charts.with_color_distance(_floor(s, d))


def _color_stats(s, d):
    return rounded(_color(s, d).agg(*(F.avg(c).alias(f"mean_{c}") for c in "rgb"), *(F.stddev_pop(c).alias(f"std_{c}") for c in "rgb"), F.max("dist").alias("max_dist")))


def _color_split(s, d):
    return _color(s, d).agg(F.count_if(F.col("dist") <= CFG.color_tolerance).alias("passed"), F.count_if(F.col("dist") > CFG.color_tolerance).alias("removed"))


def _sweep(param: str):
    return lambda s, d: rounded(floor.sensitivity(points(s, d), params=(param,)))


def queries():
    flat = _floor
    return {
        "points_projection": lambda s, d: rounded(points(s, d, indexed=True)),
        "z_extent": lambda s, d: rounded(points(s, d).agg(*(f(c).alias(f"{c}_{n}") for c in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))))),
        "z_histogram": lambda s, d: rounded(histogram.histogram(points(s, d), "z", CFG.num_bins)),
        "peak_candidates": lambda s, d: rounded(histogram.peak_candidates(points(s, d), "z", CFG.num_bins)),
        "floor_peak": _peak(CFG),
        "floor_peak_fallback": _peak(replace(CFG, min_peak_width=3)),
        "floor_peak_fixed_band": _peak(replace(CFG, band_width=0.04)),
        "floor_peak_tilt_limited": _peak(CFG, 100.0),
        "fwhm_overlay": lambda s, d: rounded(charts.fwhm_overlay(points(s, d))),
        "z_filter_count": lambda s, d: floor.with_floor(points(s, d)).agg(F.count_if("in_band").alias("n")),
        "refine_stats": _refine,
        "filtering_funnel": _funnel,
        "floor_mask_count": _counts(),
        "refine_intensity_only": _counts(color=False),
        "refine_color_only": _counts(intensity=False),
        "refine_no_attributes": _counts(intensity=False, color=False),
        "floor_ratio": _ratio,
        "intensity_threshold": _intensity,
        "intensity_histogram": lambda s, d: rounded(charts.intensity_histogram(_floor(s, d))),
        "color_stats": _color_stats,
        "color_distance_histogram": lambda s, d: rounded(charts.color_histogram(_floor(s, d)).selectExpr("bin", "n", "passed")),
        "color_distance_split": _color_split,
        "sweep_width_multiplier": _sweep("width_multiplier"),
        "sweep_color_tolerance": _sweep("color_tolerance"),
        "sweep_intensity_percentile": _sweep("intensity_percentile"),
        "sweep_grid": lambda s, d: rounded(floor.sensitivity_grid(points(s, d))),
        "sweep_without_intensity": lambda s, d: rounded(floor.sensitivity(points(s, d).drop("intensity"))),
        "sweep_without_colors": lambda s, d: rounded(floor.sensitivity(points(s, d).drop("r", "g", "b"))),
        "grid_geometry": lambda s, d: rounded(grid.geometry(flat(s, d), CFG.flatness_grid)),
        "cell_counts": lambda s, d: grid.cell_covariance(flat(s, d), 20).select("ix", "iy", "n"),
        "cell_covariance": lambda s, d: rounded(grid.cell_covariance(flat(s, d), 20)),
        "flatness_cells": lambda s, d: rounded(grid.flatness_cells(flat(s, d), 20), 4),
        "flatness_grid_dense": lambda s, d: rounded(grid.dense(grid.flatness_cells(f := flat(s, d), 20, geo=(g := grid.geometry(f, 20))), g), 4),
        "flatness_summary": lambda s, d: rounded(grid.flatness_summary(flat(s, d), CFG.flatness_grid), 4),
        "plane_fit": lambda s, d: rounded(grid.plane(_roi(s, d))),
        "detrended_residuals": lambda s, d: rounded(grid.detrended(_roi(s, d)).agg(F.count("*").alias("n"), F.min("residual").alias("low"), F.max("residual").alias("high"), F.stddev_pop("residual").alias("sigma"))),
        "roi_filter": lambda s, d: rounded(view.roi(points(s, d), *ROI).agg(F.count("*").alias("n"), F.sum("z").alias("sum_z")), 4),
        "z_roi_filter": lambda s, d: _roi(s, d).agg(F.count("*").alias("n")),
        "z_roi_histogram": lambda s, d: rounded(histogram.histogram(view.roi(points(s, d), *ROI), "z", 100)),
        "height_grid": lambda s, d: rounded(grid.height_cells(_roi(s, d))),
        "height_grid_summary": lambda s, d: rounded(grid.height_cells(_roi(s, d)).agg(F.count("*").alias("valid"), F.avg("z_range").alias("mean_range"), F.max("z_range").alias("max_range"))),
        "height_profile": lambda s, d: rounded(grid.height_profile(_roi(s, d))),
        "height_profile_stats": lambda s, d: rounded(grid.profile_stats(grid.height_profile(_roi(s, d))), 4),
        "sample_exact_k": lambda s, d: select.sample_exact(points(s, d, indexed=True), 1000).select("vertex_idx"),
        "view_floor": lambda s, d: floor.with_floor(points(s, d)).where("is_floor").agg(F.count("*").alias("n"), F.sum(F.expr("cast(r * 255 AS int)")).alias("sum_r")),
        "view_nonfloor": lambda s, d: floor.with_floor(points(s, d)).where("NOT is_floor").agg(F.count("*").alias("n"), F.sum(F.expr("cast(r * 255 AS int)")).alias("sum_r")),
        "view_highlight_rgba": lambda s, d: view.highlighted(floor.with_floor(points(s, d))).groupBy("cr", "cg", "cb", "ca").agg(F.count("*").alias("n")),
        "roi_rectangle": lambda s, d: rounded(view.roi_rectangle(points(s, d), *ROI)),
        "roi_box": lambda s, d: rounded(view.roi_box(points(s, d), *ROI)),
        "roi_segments": lambda s, d: rounded(view.roi_segments(points(s, d), *ROI)),
        "surface_lattice": lambda s, d: rounded(view.lattice(_roi(s, d), 40)),
        "surface_interpolated": lambda s, d: rounded(view.surface(_roi(s, d, True), 40, method="mean")),
        "surface_nearest": lambda s, d: rounded(view.surface(_roi(s, d, True), CFG.surface_resolution, method="mean")),
        "surface_linear": lambda s, d: rounded(view.surface(_roi(s, d, True), 40, method="linear")),
        "surface_cubic": lambda s, d: rounded(view.surface(_roi(s, d, True), 40)),
        "nearest_points": _nearest,
        "ply_round_trip": lambda s, d: rounded(_ply(s, d)),
        "ply_region": lambda s, d: rounded(view.z_band(view.roi(_ply(s, d), *ROI), *BAND).select("vertex_idx", "x", "y", "z")),
        "z_exaggeration": lambda s, d: rounded(view.exaggerated(_roi(s, d), 3.0).agg(F.min("z").alias("low"), F.max("z").alias("high"))),
        "format_size": lambda s, d: points(s, d, indexed=True).select("vertex_idx", format_size(F.expr("cast(pow(2D, vertex_idx % 60) AS bigint)")).alias("size")),
        "report_document": lambda s, d: report(points(s, d)),
        "report_fields": lambda s, d: rounded(report_fields(report(points(s, d)))),
        "profile_spline": lambda s, d: rounded(grid.spline(grid.height_profile(_roi(s, d)))),
    }
