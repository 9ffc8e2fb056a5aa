"""Peaks, sweeps, samples and tilts against plain versions; jobs and scans counted."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.config import Config
from plumbline.functions.geometry import tilt_degrees
from plumbline.operators import floor, histogram, select
from plumbline.sources.fixture import points

SF = "/root/testdata/sf0.001"


def peaks(n: np.ndarray) -> list[tuple[int, float, float]]:
    """(bin, prominence, width at half prominence) of each interior local maximum; a plateau counts at its middle."""
    found, i = [], 1
    while i < len(n) - 1:
        j = i
        while j < len(n) - 1 and n[j + 1] == n[i]:
            j += 1
        if j < len(n) - 1 and n[i - 1] < n[i] > n[j + 1]:
            at, sides = (i + j) // 2, []
            for step in (-1, 1):
                low, base, k = n[at], at, at
                while 0 <= k < len(n) and n[k] <= n[at]:
                    if n[k] < low:
                        low, base = n[k], k
                    k += step
                sides.append((low, base))
            prominence = n[at] - max(sides[0][0], sides[1][0])
            level, ends = n[at] - prominence / 2, []
            for step, (_, base) in zip((-1, 1), sides, strict=True):
                k = at
                while k != base and n[k] > level:
                    k += step
                ends.append(k - step * (level - n[k]) / (n[k - step] - n[k]) if n[k] < level else float(k))
            found.append((at, float(prominence), float(ends[1] - ends[0])))
        i = j + 1
    return found


def peaks_of(spark, rows):
    df = spark.createDataFrame(list(enumerate(rows)), "i int, h array<long>")
    return {r.i: [(p.bin, p.prominence, round(p.width, 9)) for p in r.p] for r in df.select("i", F.expr(histogram.peak_structs("h")).alias("p")).collect()}


def test_peaks_are_the_plain_ones(spark):
    rng = np.random.default_rng(0)
    rows = [rng.integers(0, int(rng.integers(2, 12)), int(rng.integers(1, 40))).tolist() for _ in range(1000)]  # few levels: many plateaus
    rows += [[0, 1, 0], [0, 2, 2, 2, 0, 5, 5], [0] * 5, [3], [1, 1], [0, 5, 5, 0]]
    got = peaks_of(spark, rows)
    assert all(got[i] == [(a, b, round(c, 9)) for a, b, c in peaks(np.array(h, float))] for i, h in enumerate(rows))
    assert got[1000] == [(1, 1.0, 1.0)] and [p[0] for p in got[1001]] == [2] and got[1002] == []


def test_no_python_in_the_peak(spark):
    plan = histogram.peak_candidates(points(spark, SF), "z", 50)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def single(pts, cfg):
    one = floor.stage_counts(pts, cfg).first()
    return one.after_refinement / one.total


def test_cube_equals_single_runs(spark):
    pts = points(spark, SF).cache()
    got = {tuple(r)[:3]: r.floor_ratio for r in floor.sensitivity_grid(pts).collect()}
    assert len(got) == 343
    for w, t, p in [(1.0, 0.1, 10.0), (2.0, 0.5, 75.0), (10.0, 0.8, 50.0), (3.0, 0.3, 25.0)]:
        assert got[w, t, p] == single(pts, Config(width_multiplier=w, color_tolerance=t, intensity_percentile=p))
    for gone in (["intensity"], ["r", "g", "b"], ["intensity", "r", "g", "b"]):
        bare = pts.drop(*gone)
        runs = {(r.param, r.value): r.floor_ratio for r in floor.sensitivity(bare).collect()}
        assert len(runs) == 21 and not any(map(math.isnan, runs.values()))
        for param, value in (("width_multiplier", 1.0), ("color_tolerance", 0.4), ("intensity_percentile", 75.0)):
            assert runs[param, value] == single(bare, Config(**{param: value}))
    pts.unpersist()


def test_sweep_of_odd_values(spark):
    cfg = Config(percentile_sweep=(-5.0, 25.0, 130.0), tolerance_sweep=(float("nan"), 0.6), width_sweep=(2.5,))
    runs = [(r.param, r.floor_ratio) for r in floor.sensitivity(points(spark, SF), cfg).orderBy("param", "value").collect()]
    assert [math.isnan(x) for _, x in runs] == [False, True, True, False, True, False]
    assert {x for _, x in runs if not math.isnan(x)} == {single(points(spark, SF), Config())}
    assert {r.floor_ratio for r in floor.sensitivity(points(spark, SF).where("false")).collect()} == {0.0}
    flat = points(spark, SF).withColumns({c: F.lit(0.5) for c in "rgb"})  # colours that don't vary
    assert floor.sensitivity(flat, params=("color_tolerance",)).select("floor_ratio").distinct().count() == 1
    some = floor.sensitivity(points(spark, SF, indexed=True), Config(sweep_points=500)).first().floor_ratio
    assert round(some * 500, 6) == round(some * 500)


def jobs(spark):
    return spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()


def test_extraction_takes_few_jobs(spark):
    before = jobs(spark)
    rows = floor.with_floor(points(spark, SF))
    assert jobs(spark) - before < 8 and rows.where("is_floor").count() == 3699


@pytest.mark.parametrize("k", [0, 1, 700])
def test_one_pass_sample_has_the_same_rows(spark, monkeypatch, k):
    rows = spark.range(3000).withColumnRenamed("id", "vertex_idx").repartition(7)
    before = jobs(spark)
    one = select.sample_exact(rows, k)
    assert jobs(spark) == before
    got = sorted(one.collect())
    monkeypatch.setattr(select, "ONE_PASS", -1)
    assert got == sorted(select.sample_exact(rows, k).collect()) and len(got) == k


def test_quantiles_of_one_value_buckets(spark):
    v = np.random.default_rng(3).integers(0, 50, 4000) * 1.0
    before = jobs(spark)
    got = select.quantiles(spark.createDataFrame([(float(x),) for x in v], "v double"), "v", [0.1, 0.5, 0.77])
    assert np.allclose(got[0], np.quantile(v, [0.1, 0.5, 0.77])) and jobs(spark) - before <= 4  # the values weren't looked up again


def test_tilt_is_that_of_the_svd(spark):
    rng = np.random.default_rng(4)
    rows, want = [], []
    for _ in range(200):
        p = rng.normal(size=(int(rng.integers(4, 30)), 3)) * rng.uniform(0.01, 3, 3) @ np.linalg.qr(rng.normal(size=(3, 3)))[0]
        c = np.cov(p.T, bias=True)
        normal = np.linalg.svd(p - p.mean(axis=0))[2][2]
        rows.append(tuple(map(float, (c[0, 0], c[1, 1], c[2, 2], c[0, 1], c[0, 2], c[1, 2]))))
        want.append(math.degrees(math.acos(min(1.0, abs(normal[2])))))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, xx double, yy double, zz double, xy double, xz double, yz double")
    got = [r.tilt for r in df.select("i", tilt_degrees().alias("tilt")).orderBy("i").collect()]
    assert np.allclose(got, want, atol=1e-4)
