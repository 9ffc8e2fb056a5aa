"""Histograms and the floor peak."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from .select import fixed, local


def extent(df: DataFrame, col: str) -> DataFrame:
    """One row: lo, hi of the column; a constant column widens by half on either side. Nulls for no rows."""
    return df.agg(F.min(col).alias("mn"), F.max(col).alias("mx")).selectExpr("mn", "mx", "IF(mn = mx, mn - 0.5D, mn) AS lo", "IF(mn = mx, mx + 0.5D, mx) AS hi")


def bin_index(col: Column, bins: int) -> Column:
    """Bin of a value between the row's lo and hi; the last bin is closed."""
    return F.least(F.floor((col - F.col("lo")) / ((F.col("hi") - F.col("lo")) / F.lit(float(bins)))), F.lit(bins - 1)).cast("long")


def histogram(df: DataFrame, col: str, bins: int, span: DataFrame | None = None) -> DataFrame:
    """bin, lo, hi, n: equal bins over the extent (or a one-row span of lo, hi), empty ones too."""
    one = F.broadcast((fixed(extent(df, col)) if span is None else span).select("lo", "hi"))
    counts = df.where(F.col(col).isNotNull()).select(col).crossJoin(one).where(F.col(col).between(F.col("lo"), F.col("hi"))).groupBy(bin_index(F.col(col), bins).alias("bin")).agg(F.count("*").alias("n"))
    every = one.where("lo IS NOT NULL").withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)).cast("array<long>")))
    width = f"((hi - lo) / {float(bins)}D)"
    return every.join(counts, "bin", "left").selectExpr("bin", f"lo + bin * {width} AS lo", f"lo + (bin + 1) * {width} AS hi", "coalesce(n, 0L) AS n")


def peak_structs(h: str) -> str:
    """The interior local maxima of an array h of counts as an expression: an array of (bin, n, prominence, width at half prominence). A plateau counts at its middle."""
    let = lambda value, name, body: f"transform(array({value}), {name} -> {body})[0]"
    # A rise to a plateau's first bin i, which ends in a fall after its last bin j.
    rises = f"filter(sequence(1, greatest(size({h}) - 2, 1)), i -> i < size({h}) - 1 AND {h}[i - 1] < {h}[i])"
    last = f"coalesce(array_min(filter(sequence(i, size({h}) - 1), k -> {h}[k] <> {h}[i])), size({h})) - 1"
    tops = f"transform(filter(transform({rises}, i -> struct(i, {last} AS j)), x -> x.j < size({h}) - 1 AND {h}[least(x.j + 1, size({h}) - 1)] < {h}[x.i]), x -> (x.i + x.j) div 2)"
    # On each side: the bins up to a higher one, their least count, and the nearest bin with it.
    left = f"filter(sequence(0, cast(p AS int)), k -> k > coalesce(array_max(filter(sequence(0, cast(p AS int)), w -> {h}[w] > {h}[p])), -1))"
    right = f"filter(sequence(cast(p AS int), size({h}) - 1), k -> k < coalesce(array_min(filter(sequence(cast(p AS int), size({h}) - 1), w -> {h}[w] > {h}[p])), size({h})))"
    low = lambda side: f"array_min(transform({side}, k -> {h}[k]))"
    base = lambda side, pick: f"{pick}(filter(s.{side}, k -> {h}[k] = {low(f's.{side}')}))"
    sides = f"struct({left} AS l, {right} AS r)"
    found = f"struct({base('l', 'array_max')} AS lb, {base('r', 'array_min')} AS rb, {h}[p] - greatest({low('s.l')}, {low('s.r')}) AS prominence)"
    # The nearest bin on each side that is at the base or not above the level, and where the line to it crosses the level.
    stop_l = f"array_max(filter(s.l, k -> k = b.lb OR k > b.lb AND {h}[k] <= {h}[p] - b.prominence / 2D))"
    stop_r = f"array_min(filter(s.r, k -> k = b.rb OR k < b.rb AND {h}[k] <= {h}[p] - b.prominence / 2D))"
    cross = lambda e, inner: f"IF({h}[{e}] < v, (v - {h}[{e}]) / ({h}[{inner}] - {h}[{e}]), 0D)"
    width = f"e.r - {cross('e.r', 'e.r - 1')} - (e.l + {cross('e.l', 'e.l + 1')})"
    one = f"struct(cast(p AS bigint) AS bin, cast({h}[p] AS bigint) AS n, cast(b.prominence AS double) AS prominence, cast({width} AS double) AS width)"
    one = let(f"struct({stop_l} AS l, {stop_r} AS r)", "e", let(f"{h}[p] - b.prominence / 2D", "v", one))
    return f"transform({tops}, p -> {let(sides, 's', let(found, 'b', one))})"


def _counts(df: DataFrame, col: str, bins: int, span: DataFrame) -> DataFrame:
    """One row: h, the counts of all bins, and lo, hi, mn, mx of the span."""
    mn, mx, lo, hi = (None if x is None else float(x) for x in span.select("mn", "mx", "lo", "hi").first())
    found = {}
    if lo is not None:
        given = df.select(F.col(col)).where(F.col(col).between(lo, hi)).withColumns({"lo": F.lit(lo), "hi": F.lit(hi)})
        found = {r[0]: r[1] for r in given.groupBy(bin_index(F.col(col), bins).alias("bin")).agg(F.count("*")).collect()}  # a row a bin
    return local(df.sparkSession, [([found.get(k, 0) for k in range(bins)], lo, hi, mn, mx)], "h array<long>, lo double, hi double, mn double, mx double")


def peak_candidates(df: DataFrame, col: str, bins: int) -> DataFrame:
    """bin, n, prominence, width of each peak of a column's histogram."""
    return _counts(df, col, bins, fixed(extent(df, col))).select(F.inline(F.expr(peak_structs("h"))))


def floor_peak(df: DataFrame, cfg: Config = Config(), col: str = "z", span: DataFrame | None = None) -> DataFrame:
    """One row: peak_z, z_min, z_max, fwhm, is_fallback, is_tilt_limited; zeros for no points. Two scans, made now: extent (unless span has it: lo, hi, mn, mx) and histogram."""
    one = _counts(df, col, cfg.num_bins, fixed(extent(df, col)) if span is None else span)
    ok = f"filter(p, x -> x.prominence >= {cfg.prominence_ratio!r}D * array_max(h) AND x.width >= {float(cfg.min_peak_width)!r}D)"
    one = one.withColumn("p", F.expr(peak_structs("h"))).withColumn("best", F.expr(f"array_max(transform({ok}, x -> struct(x.n AS n, -x.bin AS bin, x.width AS width)))"))
    one = one.withColumn("w", F.expr(f"(hi - lo) / {float(cfg.num_bins)}D")).withColumn("fwhm", F.expr("best.width * w"))
    tilt = f"fwhm > {cfg.tilt_fwhm_threshold!r}D"
    half = f"{cfg.band_width!r}D" if cfg.band_width is not None else f"fwhm * IF({tilt}, {cfg.tilt_width_multiplier!r}D, {cfg.width_multiplier!r}D) / 2"
    top = f"(mn + (mx - mn) * {cfg.fallback_z_ratio!r}D)"
    one = one.withColumn("at", F.expr("lo + (-best.bin + 0.5D) * w"))
    return one.selectExpr(
        f"coalesce(at, (mn + {top}) / 2, 0D) AS peak_z", f"coalesce(at - {half}, mn, 0D) AS z_min", f"coalesce(at + {half}, {top}, 0D) AS z_max",
        f"coalesce(fwhm, {top} - mn, 0D) AS fwhm", "best IS NULL AS is_fallback", f"coalesce({tilt}, false) AS is_tilt_limited",
    )
