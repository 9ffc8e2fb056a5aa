"""Floor extraction: peak, Z band, refinement by intensity and colour; sweeps of its parameters."""

from __future__ import annotations

from dataclasses import dataclass, replace
from math import isfinite

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.geometry import distance
from .histogram import floor_peak
from .select import Ranks, bucket, local, sample_exact


def _given(points: DataFrame, intensity: bool | None, color: bool | None) -> tuple[bool, bool]:
    """Which filters there are columns for, unless the caller says so."""
    return "intensity" in points.columns if intensity is None else intensity, {"r", "g", "b"} <= set(points.columns) if color is None else color


@dataclass(frozen=True)
class Extents:
    """Number of points, and the extents of z and of the intensity (None: no such values)."""

    n: int
    z: tuple[float, float] | None
    intensity: tuple[float, float] | None

    def span(self, spark) -> DataFrame:
        """The z extent as a row mn, mx, lo, hi; a constant widens by half on either side."""
        mn, mx = self.z or (None, None)
        lo, hi = (mn - 0.5, mx + 0.5) if self.z and mn == mx else (mn, mx)
        return local(spark, [(mn, mx, lo, hi)], "mn double, mx double, lo double, hi double")


def extents(points: DataFrame, intensity: bool) -> Extents:
    """One scan for all extents that an extraction needs."""
    sound = F.when(~F.isnan(F.col("intensity").cast("double")), F.col("intensity").cast("double")) if intensity else F.lit(None).cast("double")
    n, a, b, c, d = points.agg(F.count("*"), F.min("z"), F.max("z"), F.min(sound), F.max(sound)).first()
    return Extents(n, None if a is None else (float(a), float(b)), None if c is None else (c, d))


#: Thresholds at the given shares, and mr, mg, mb, spread of the colours; None where a band has no such values.
Stats = tuple[list[float | None], tuple[float | None, ...]]


def band_stats(points: DataFrame, bands: list[tuple[float, float]], shares: list[float], known: Extents, intensity: bool, color: bool, buckets: int = 1 << 12) -> list[Stats]:
    """The statistics of each Z band, computed now in one scan; bands lie in each other, the smallest first.

    A point counts in the first band that holds it and its bucket of intensity, so what comes to the driver is a row for each of those; bands are
    summed up from there. One more scan, of few buckets, is made only if one that holds a threshold has several values.
    """
    ring = F.coalesce(*(F.when(F.col("z").between(a, b), F.lit(k)) for k, (a, b) in enumerate(bands)))
    v = F.col("intensity").cast("double") if intensity and known.intensity else F.lit(None).cast("double")
    rows = points.select(ring.alias("ring"), F.when(~F.isnan(v), v).alias("v"), *("rgb" if color else ())).where("ring IS NOT NULL")
    rows = rows.withColumn("at", F.coalesce(bucket("v", *known.intensity, buckets), F.lit(-1)) if intensity and known.intensity else F.lit(-1))
    tones = [f(c).cast("double") for c in ("rgb" if color else ()) for f in (F.count, F.avg, F.var_pop)]
    got = rows.groupBy("ring", "at").agg(F.min("v"), F.max("v"), F.count("v"), *tones).toArrow()
    in_ring, at, least, most, n, *tones = (x.to_numpy() for x in got.columns)
    counts, ends = np.zeros((len(bands), buckets), np.int64), np.array([np.full(buckets, np.inf), np.full(buckets, -np.inf)])
    np.add.at(counts, (in_ring[at >= 0], at[at >= 0]), n[at >= 0])
    np.minimum.at(ends[0], at[at >= 0], least[at >= 0])
    np.maximum.at(ends[1], at[at >= 0], most[at >= 0])
    thresholds = Ranks(np.cumsum(counts, axis=0), *ends, shares).values(rows, [f"ring <= {k}" for k in range(len(bands))]) if intensity else [[None] * len(shares)] * len(bands)
    out = []
    for k, t in enumerate(thresholds):
        means, spreads = [], []
        for n, mean, var in zip(tones[::3], tones[1::3], tones[2::3], strict=True):
            on = (in_ring <= k) & (n > 0)
            if on.any():
                total = n[on].sum()
                means.append(float((n[on] * mean[on]).sum() / total))
                spreads.append(float((n[on] * (var[on] + (mean[on] - means[-1]) ** 2)).sum() / total) ** 0.5)
        out.append((t, (*means, sum(spreads) / 3) if len(means) == 3 else (None,) * 4))
    return out


def refine_stats(points: DataFrame, peak: DataFrame, cfg: Config = Config(), intensity: bool | None = None, color: bool | None = None) -> DataFrame:
    """One row, computed now: threshold, mr, mg, mb, spread over the peak's Z band; nulls where a column is absent."""
    intensity, color = _given(points, intensity, color)
    (threshold,), tones = band_stats(points, [tuple(peak.select("z_min", "z_max").first())], [cfg.intensity_percentile / 100], extents(points, intensity), intensity, color)[0]
    return local(points.sparkSession, [(threshold, *tones)], "threshold double, mr double, mg double, mb double, spread double")


def with_floor(points: DataFrame, cfg: Config = Config(), intensity: bool | None = None, color: bool | None = None, peak: DataFrame | None = None) -> DataFrame:
    """points with in_band and is_floor. A point in the band is floor if either active filter passes it, or none is active.

    intensity, color: whether to use those columns; by default if they are there. Three scans are made now, for the extents, the
    histogram and the band's statistics; the rows stay lazy.
    """
    intensity, color = _given(points, intensity, color)
    known = extents(points, intensity)
    low, high = (floor_peak(points, cfg, span=known.span(points.sparkSession)) if peak is None else peak).select("z_min", "z_max").first()
    (limit,), (*means, spread) = band_stats(points, [(low, high)], [cfg.intensity_percentile / 100], known, intensity, color)[0]
    passed = [F.col("intensity") >= F.lit(limit).cast("double")] if intensity else []
    if color and spread is not None and spread > cfg.color_std_threshold:
        passed.append(distance(*zip("rgb", means, strict=True)) <= cfg.color_tolerance)
    ok = F.lit(not passed)
    for x in passed:
        ok = ok | x
    band = F.col("z").between(low, high)
    return points.select("*", band.alias("in_band"), (band & F.coalesce(ok, F.lit(False))).alias("is_floor"))


def stage_counts(points: DataFrame, cfg: Config = Config(), **kwargs) -> DataFrame:
    """One row: total, after_z_filter, after_refinement."""
    return with_floor(points, cfg, **kwargs).agg(F.count("*").alias("total"), F.count_if("in_band").alias("after_z_filter"), F.count_if("is_floor").alias("after_refinement"))


PARAMS = ("width_multiplier", "color_tolerance", "intensity_percentile")
Run = tuple[float, float, float]


def _steps(tests: list[Column], missing: bool) -> Column:
    """How many of the tests hold; a test of a null is as `missing` says."""
    return sum((F.coalesce(t, F.lit(missing)).cast("int") for t in tests), F.lit(0))


def run_counts(points: DataFrame, cfg: Config, runs: list[Run], intensity: bool | None = None, color: bool | None = None) -> DataFrame:
    """run (place in runs), n (floor points), total: the extraction with each (width multiplier, colour tolerance, intensity percentile).

    Every point becomes, for each band that holds it, the number of intensity thresholds it reaches and the number of colour tolerances it
    exceeds. One scan counts those into a cube, whose size depends on the distinct values alone; a run adds up the
    cells of its band that pass either filter. n is null for a run that no extraction can have: a percentile outside of 0 to 100, or a value that is no number.
    """
    spark = points.sparkSession
    intensity, color = _given(points, intensity, color)
    sound = [all(x is not None and isfinite(x) for x in r) and 0 <= r[2] <= 100 for r in runs]
    widths, tolerances, percents = (sorted({r[i] for r, ok in zip(runs, sound, strict=True) if ok}) for i in range(3))
    known = extents(points, intensity)
    peak = floor_peak(points, replace(cfg, width_multiplier=1.0), span=known.span(spark)).first()  # z_max - peak_z is half a width
    half = peak["z_max"] - peak["peak_z"]
    fixed_band = peak["is_fallback"] or peak["is_tilt_limited"] or cfg.band_width is not None
    of_width = {m: (peak["z_min"], peak["z_max"]) if fixed_band else (peak["peak_z"] - half * m, peak["peak_z"] + half * m) for m in widths}
    bands = sorted(set(of_width.values()), key=lambda x: x[1] - x[0])
    stats = band_stats(points, bands, [p / 100 for p in percents], known, intensity, color) if bands else []
    table = [(i, bands.index(of_width[w]), percents.index(p) + 1, tolerances.index(t)) if ok else (i, None, None, None) for i, ((w, t, p), ok) in enumerate(zip(runs, sound, strict=True))]
    want = local(spark, table, "run int, band int, least int, most int")
    if not bands:
        return want.selectExpr("run", "cast(null AS bigint) AS n", f"{known.n}L AS total")
    # A row a band: its thresholds, mean colour, and what a filter that isn't active gives.
    limits = [f"l{i}" for i in range(len(percents))]
    rows = []
    for k, (t, (*means, spread)) in enumerate(stats):
        toned = bool(color and spread is not None and spread > cfg.color_std_threshold)
        rows.append((k, toned, None if intensity else 0 if toned else len(limits), *t, *means))
    of_band = local(spark, rows, ", ".join(["band int", "toned boolean", "given int", *(f"{x} double" for x in (*limits, "mr", "mg", "mb"))]))
    ring = F.coalesce(*(F.when(F.col("z").between(a, b), F.lit(k)) for k, (a, b) in enumerate(bands)))
    used = points.select(ring.alias("ring"), *(["intensity"] * intensity), *("rgb" if color else ())).where("ring IS NOT NULL")
    cells = used.withColumn("band", F.explode(F.sequence("ring", F.lit(len(bands) - 1)))).join(F.broadcast(of_band), "band")
    if color:
        cells = cells.withColumn("d", F.when(F.col("toned"), F.sqrt(sum((F.pow(F.col(c) - F.col(f"m{c}"), 2) for c in "rgb"), F.lit(0.0)))))
    reached = _steps([F.col("intensity") >= F.col(x) for x in limits], False) if intensity else F.col("given")
    over = _steps([F.col("d") > t for t in tolerances], True) if color else F.lit(len(tolerances))
    cube = cells.select("band", reached.alias("reached"), over.alias("over")).groupBy("band", "reached", "over").agg(F.count("*").alias("n"))
    met = F.broadcast(want).join(cube, "band").where("reached >= least OR over <= most").groupBy("run").agg(F.sum("n").alias("n"))
    return want.join(met, "run", "left").selectExpr("run", "IF(band IS NULL, NULL, coalesce(n, 0L)) AS n", f"{known.n}L AS total")


def sensitivity(points: DataFrame, cfg: Config = Config(), params: tuple[str, ...] = PARAMS, max_points: int | None = None) -> DataFrame:
    """param, value, is_current, floor_ratio of the sweeps of `params`, one parameter at a time; NaN where a value allows no extraction.

    Clouds without intensity or colours are swept as well; what a run doesn't use doesn't change it. Of clouds with a vertex_idx, a seeded sample of
    max_points (cfg.sweep_points by default) is swept; others whole.
    """
    if max_points is not None or "vertex_idx" in points.columns:
        points = sample_exact(points, cfg.sweep_points if max_points is None else max_points, cfg.seed)
    values = {"width_multiplier": cfg.width_sweep, "color_tolerance": cfg.tolerance_sweep, "intensity_percentile": cfg.percentile_sweep}
    current = {p: float(getattr(cfg, p)) for p in PARAMS}
    named = [(p, float("nan") if v is None else float(v)) for p in params for v in values[p]]
    runs = [tuple({**current, p: v}[q] for q in PARAMS) for p, v in named]
    names = local(points.sparkSession, [(i, p, v, v == current[p]) for i, (p, v) in enumerate(named)], "run int, param string, value double, is_current boolean")
    done = run_counts(points, cfg, runs)
    return names.join(F.broadcast(done), "run").selectExpr("param", "value", "is_current", "CASE WHEN n IS NULL THEN double('nan') WHEN total = 0 THEN 0D ELSE n / total END AS floor_ratio")


def sensitivity_grid(points: DataFrame, cfg: Config = Config()) -> DataFrame:
    """width_multiplier, color_tolerance, intensity_percentile, floor_ratio of every combination of the sweeps' values, from the same cube."""
    runs = [(float(w), float(t), float(p)) for w in cfg.width_sweep for t in cfg.tolerance_sweep for p in cfg.percentile_sweep]
    names = local(points.sparkSession, [(i, *r) for i, r in enumerate(runs)], "run int, width_multiplier double, color_tolerance double, intensity_percentile double")
    done = run_counts(points, cfg, runs)
    return names.join(F.broadcast(done), "run").selectExpr(*PARAMS, "CASE WHEN n IS NULL THEN double('nan') WHEN total = 0 THEN 0D ELSE n / total END AS floor_ratio")
