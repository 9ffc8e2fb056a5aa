"""Point-cloud operators: published peak rules, golden values, recovered planes, regions, files."""

import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.config import Config
from plumbline.operators import charts, floor, grid, histogram, select, view
from plumbline.plans import report
from plumbline.sources import ply
from plumbline.sources.fixture import points

SF = "/root/testdata/sf0.001"


def cloud(spark, x, y, z):
    return spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x, y, z, strict=True)], "x double, y double, z double")


def test_golden_counts(spark):
    row = floor.stage_counts(points(spark, SF)).first()
    assert tuple(row) == (6000, 4032, 3699)
    peak = histogram.floor_peak(points(spark, SF)).first()
    assert (round(peak.peak_z, 6), round(peak.fwhm, 6)) == (0.029735, 0.041406)


def test_golden_flatness(spark):
    f = floor.with_floor(points(spark, SF)).where("is_floor")
    s = grid.flatness_summary(f, 20).first()
    assert (s.valid_cells, s.total_cells, round(s.mean_tilt, 4), round(s.max_tilt, 4)) == (200, 210, 0.5396, 1.8029)


def test_empty_and_constant(spark):
    empty = points(spark, SF).where("false")
    assert tuple(histogram.floor_peak(empty).first())[:4] == (0, 0, 0, 0)
    assert tuple(floor.stage_counts(empty).first()) == (0, 0, 0)
    same = histogram.floor_peak(cloud(spark, [1, 2, 3], [1, 2, 3], [5, 5, 5])).first()
    assert same.is_fallback and same.z_min == same.z_max == 5.0


def test_plane_and_residuals(spark):
    rng = np.random.default_rng(1)
    x, y = rng.uniform(0, 10, (2, 300))
    df = cloud(spark, x, y, 0.5 * x + 0.3 * y + 2)
    assert np.allclose(tuple(grid.plane(df).first()), (0.5, 0.3, 2.0))
    assert grid.height_cells(df, 5).agg({"z_range": "max"}).first()[0] < 1e-9
    assert np.allclose(tuple(grid.plane(cloud(spark, x, x * 0 + 3, 2 * x)).first())[:2], (2, 0))


def test_regions_and_samples(spark):
    df = cloud(spark, [1, 2, 3, 4], [1, 2, 3, 4], [0, 1, 2, 3])
    assert view.roi(df, (3, 1), (1, 3)).count() == 3
    assert view.z_band(df, 1, 2).count() == 2
    assert tuple(view.roi_box(df, (100, 200), (100, 200)).first()) == (0, 3)
    with pytest.raises(ValueError):
        view.require_points(df)
    many = spark.range(5000).withColumnRenamed("id", "vertex_idx")
    a, b = (select.sample_exact(many.repartition(n), 200).collect() for n in (3, 7))
    assert len(a) == 200 and sorted(a) == sorted(b)
    low, high = view.exaggerated(df, 3.0).agg({"z": "min"}).first()[0], view.exaggerated(df, 3.0).agg({"z": "max"}).first()[0]
    assert high - low == 9.0


def test_sweep_matches_single_runs(spark):
    pts = points(spark, SF)
    got = {(r.param, r.value): r.floor_ratio for r in floor.sensitivity(pts).collect()}
    one = floor.stage_counts(pts, Config(width_multiplier=1.0)).first()
    assert len(got) == 21 and got["width_multiplier", 1.0] == one.after_refinement / one.total


def test_ply_round_trip(spark, tmp_path):
    n = 2500
    rng = np.random.default_rng(2)
    cols = {c: rng.uniform(0, 9, n).astype("f4") for c in "xyz"} | {c: rng.integers(0, 256, n).astype("u1") for c in ("red", "green", "blue")} | {"scalar_Intensity": rng.uniform(0, 1, n).astype("f4")}
    path = tmp_path / "a.ply"
    path.write_bytes(ply.ply_bytes(cols))
    got = ply.read_ply(spark, str(path), chunk_size="700").orderBy("vertex_idx").toPandas()
    assert list(got.columns) == ["vertex_idx", "x", "y", "z", "r", "g", "b", "intensity"]
    assert np.allclose(got["x"], cols["x"]) and np.allclose(got["r"] * 255, cols["red"])
    assert ply.read_ply(spark, str(path), chunk_size="700", max_points="100").count() == 100
    assert ply.list_files(spark, str(tmp_path)).first().size.endswith("KB")
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        ply.list_files(spark, str(tmp_path / "none"))
    few = ply.read_ply(spark, str(path), chunk_size="100", max_points="5")
    assert few.rdd.getNumPartitions() <= 5 and few.count() == 5
    rows, seen = ply.observed(ply.read_ply(spark, str(path), max_points="2400", seed="7"))
    assert rows.count() == seen.get["rows"] == 2400
    for n, k in ((10, 3), (10, 9), (1000, 500), (10**12, 50)):
        got = ply.sampled_numbers(n, k, 5)
        assert len(np.unique(got)) == k and got.min() >= 0 and got.max() < n
    for bad in (b"ply\nformat ascii 1.0\nend_header\n", b"ply\nformat binary_little_endian 1.0\n", path.read_bytes()[:-5]):
        (tmp_path / "bad.ply").write_bytes(bad)
        with pytest.raises(ValueError):
            ply.read_header(str(tmp_path / "bad.ply"))


def test_quantiles(spark):
    rng = np.random.default_rng(7)
    for v in (rng.normal(size=4001), rng.integers(0, 5, 999).astype(float), np.array([2.0]), np.full(50, 3.5)):
        df = spark.createDataFrame([(float(x),) for x in v], "v double")
        got = select.quantiles(df, "v", [0, 0.25, 0.5, 0.9, 1], ["true", "v > 2.5", "v > 1e9"], buckets=64)
        for g, x in zip(got, (v, v[v > 2.5]), strict=False):
            assert np.allclose(g, np.quantile(x, [0, 0.25, 0.5, 0.9, 1]), atol=1e-12) if len(x) else g == [None] * 5
        assert got[2] == [None] * 5
    assert select.quantiles(spark.createDataFrame([], "v double"), "v", [0.5]) == [[None]]


def test_samples(spark):
    rows = spark.range(20000).withColumnRenamed("id", "vertex_idx")
    one, two = ({r[0] for r in select.sample_exact(rows, 3000, seed).collect()} for seed in (1, 2))
    assert len(one) == len(two) == 3000 and 350 < len(one & two) < 550
    assert abs(np.mean(list(one)) - 10000) < 500
    assert select.sample_exact(rows, 0).count() == 0 and select.sample_exact(rows, 10**6).count() == 20000


def test_plane_of_least_norm(spark):
    x = np.linspace(0, 4, 50)
    for y, z in ((x * 0 + 3, 2 * x + 1), (x, x + 2), (-2 * x + 1, 3 * x), (x * 0, x * 0 + 1), (x * 0 + 2, x * 0 + 5)):
        want = np.linalg.lstsq(np.column_stack([x, y, np.ones(50)]), z, rcond=None)[0]
        assert np.allclose(tuple(grid.plane(cloud(spark, x, y, z)).first()), want, atol=1e-9)
    one = np.linalg.lstsq(np.array([[1.0, 2.0, 1.0]]), np.array([6.0]), rcond=None)[0]
    assert np.allclose(tuple(grid.plane(cloud(spark, [1, 1], [2, 2], [6, 6])).first()), one)


def test_surface(spark):
    rng = np.random.default_rng(3)
    x, y = rng.uniform(0, 10, 400), rng.uniform(0, 5, 400)
    df = cloud(spark, x, y, x + y)
    few, many = (view.surface(df, k, method="mean").collect() for k in (10, 40))
    assert len(few) == 10 * 4 or len(few) == 10 * 5 and len(many) > len(few)
    assert all(min(x + y) <= r.z <= max(x + y) for r in many)
    assert max(abs(r.z - r.x - r.y) for r in many) < 2.5
    flat, steep = (np.ptp([r.z for r in view.surface(df, 20, k).collect()]) for k in (1.0, 3.0))
    assert steep / flat > 2.5
    far = cloud(spark, [0, 0.1, 9.9, 10], [0, 0.1, 4.9, 5], [1, 1, 7, 7])
    got = {(r.ix, r.iy): round(r.z, 9) for r in view.surface(far, 30, method="mean").collect()}
    assert got[0, 0] == 1 and got[29, 13] == 7 and set(got.values()) == {1.0, 7.0}
    with pytest.raises(ValueError):
        view.surface(cloud(spark, [1, 1], [2, 2], [3, 4]), 10)


def test_missing_columns(spark):
    pts = points(spark, SF)
    assert floor.stage_counts(pts.drop("intensity")).first() == floor.stage_counts(pts, intensity=False).first()
    bare = pts.select("x", "y", "z")
    assert floor.stage_counts(bare).first().after_refinement == 4032
    assert charts.intensity_histogram(bare).count() == charts.color_histogram(bare).count() == 0
    assert charts.color_histogram(pts.withColumns({"r": pts.z * 0, "g": pts.z * 0, "b": pts.z * 0})).count() == 0
    same = charts.intensity_histogram(pts.withColumn("intensity", pts.z * 0 + 5)).collect()
    assert len(same) == 100 and sum(r.passed for r in same) == 6000


def test_run_report(spark, tmp_path):
    got = report.run_report(points(spark, SF), filename="a.ply", timestamp="t", total_points=9000)
    assert set(got) == {"z_histogram", "fwhm_overlay", "filtering_funnel", "intensity_histogram", "color_histogram", "floor_ratio", "sensitivity", "flatness_cells", "report"}
    doc = json.loads(got["report"].first()[0])
    assert doc["metadata"] == {"file": "a.ply", "timestamp": "t", "elapsed_seconds": None, "view_mode": 4, "total_vertices": 9000, "max_points_loaded": 5_000_000, "actual_points_loaded": 6000}
    assert doc["peak_detection"]["num_bins"] == 200 and doc["filtering"]["total_points"] == 6000
    assert doc["sensitivity"]["width_multiplier"]["values"] == list(Config().width_sweep) and len(doc["sensitivity"]["color_tolerance"]["floor_ratios"]) == 7
    assert doc["filtering"]["after_refinement"] == 3699 and doc["flatness"]["valid_cells"] == 56 and len(doc["sensitivity"]) == 3
    assert got["filtering_funnel"].count() == 3 and got["floor_ratio"].first().floor == 3699
    empty = report.write_report(points(spark, SF).where("false"), tmp_path.as_uri(), "20240102")
    assert json.loads(spark.read.text(f"{empty}/report").first()[0])["flatness"]["mean_tilt_degrees"] is None
    assert spark.read.json(f"{empty}/filtering_funnel").count() == 3
    assert sorted(os.listdir(f"{tmp_path}")) == ["20240102"] and "_SUCCESS" in os.listdir(f"{tmp_path}/20240102")


def test_failed_report_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(report.ReportSink)
    good = spark.range(40).selectExpr("'z' AS chart", "concat('{\"a\":', id, '}') AS row").repartition(4)
    bad = good.withColumn("row", F.expr("IF(row LIKE '%39%', raise_error('broken'), row)"))
    with pytest.raises(Exception, match="broken"):
        bad.write.format("report").mode("append").option("path", f"{tmp_path}/r").save()
    shown = lambda: [x for x in os.listdir(tmp_path) if not x.startswith("_writing-")]  # noqa: E731 (killed tasks may leave a hidden folder, which no reader takes for data)
    assert shown() == []
    good.write.format("report").mode("append").option("path", f"{tmp_path}/r").save()
    assert shown() == ["r"] and spark.read.json(f"{tmp_path}/r/z").count() == 40


def test_spline(spark):
    rng = np.random.default_rng(11)
    for n in (1, 3, 4, 5, 30):
        x, z = np.cumsum(rng.uniform(0.2, 1, n)), rng.normal(size=n)
        got = sorted(tuple(r) for r in grid.spline(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, z, strict=True)], "x_center double, z_mean double")).collect())
        if n < 4:
            assert [r[1:] for r in got] == list(zip(x, z, strict=True))
            continue
        # Unknowns: four coefficients a piece, all conditions at once.
        a, b = np.zeros((4 * n - 4, 4 * n - 4)), np.zeros(4 * n - 4)
        power = lambda t, k: np.array([np.prod(range(p - k + 1, p + 1)) * t ** max(p - k, 0) if p >= k else 0.0 for p in range(4)])
        row = 0
        for i in range(n - 1):
            h = x[i + 1] - x[i]
            for t, v in ((0, z[i]), (h, z[i + 1])):
                a[row, 4 * i : 4 * i + 4], b[row], row = power(t, 0), v, row + 1
            for k in (1, 2, *([3] if i in (0, n - 3) else [])):
                if i < n - 2:
                    a[row, 4 * i : 4 * i + 4], a[row, 4 * i + 4 : 4 * i + 8], row = power(h, k), -power(0, k), row + 1
        c = (np.linalg.solve(a, b) if n > 4 else np.linalg.lstsq(a, b, rcond=None)[0]).reshape(-1, 4)
        xs = np.linspace(x[0], x[-1], 10 * n)
        at = np.clip(np.searchsorted(x, xs, "right") - 1, 0, n - 2)
        want = [(c[i] * power(t - x[i], 0)).sum() for i, t in zip(at, xs, strict=True)]
        assert np.allclose([r[1] for r in got], xs) and np.allclose([r[2] for r in got], want, atol=1e-9)


def test_roi_context(spark):
    rows = view.roi_context(points(spark, SF, indexed=True), (5, 15), (2, 8), Config(roi_points=500)).collect()
    assert len(rows) == 500 and {r.inside for r in rows} == {True, False} and all(0 <= r.shade <= 1 for r in rows)
    assert [r.segment for r in view.roi_segments(points(spark, SF), (3, 1), (2, 5)).orderBy("segment").collect()] == [0, 1, 2, 3]


def test_without_the_training_data_folders(tmp_path):
    """The rest imports and lists its queries when the training-data folders are gone, with corpus_pipeline.py left or not."""
    root = Path(__file__).resolve().parents[1]
    for pipeline in (True, False):
        copy = tmp_path / str(pipeline)
        shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache", *([] if pipeline else ["corpus_pipeline.py"])))
        code = "import __spark_entry__ as e; q = set(e.queries()); assert q and set(e.oracle_sql()) <= q and 'pipeline' not in q and not any(x.startswith('op') for x in q)"
        subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": ""})
