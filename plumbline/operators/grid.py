"""Grids over the plane: geometry, cells, tilt, height ranges, profiles, planes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import tilt_degrees
from .select import fixed


def geometry(df: DataFrame, target: int) -> DataFrame:
    """One row, computed now: x_min, y_min, cell, nx, ny of square cells, `target` of them along the longer side."""
    e = df.agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))
    e = e.withColumn("longest", F.expr("greatest(x_max - x_min, y_max - y_min)")).withColumn("cell", F.expr(f"IF(longest > 0, longest / {float(target)}D, 1D)"))
    side = "coalesce(greatest(cast(ceil(({0}_max + cell - {0}_min) / cell) AS bigint) - 1, 1L), 1L) AS n{0}"
    return fixed(e.selectExpr("x_min", "y_min", "coalesce(cell, 1D) AS cell", side.format("x"), side.format("y")))


def with_cell(df: DataFrame, geo: DataFrame) -> DataFrame:
    """df with ix, iy and the geometry's columns."""
    at = "greatest(least(cast(floor(({0} - {0}_min) / cell) AS bigint), n{0} - 1), 0L)"
    return df.crossJoin(F.broadcast(geo)).withColumn("ix", F.expr(at.format("x"))).withColumn("iy", F.expr(at.format("y")))


def cell_covariance(df: DataFrame, target: int, geo: DataFrame | None = None) -> DataFrame:
    """ix, iy, n and the covariances of x, y, z of each cell with points."""
    return with_cell(df, geometry(df, target) if geo is None else geo).groupBy("ix", "iy").agg(
        F.count("*").alias("n"), F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.var_pop("z").alias("zz"),
        F.covar_pop("x", "y").alias("xy"), F.covar_pop("x", "z").alias("xz"), F.covar_pop("y", "z").alias("yz"),
    )


def flatness_cells(df: DataFrame, target: int, min_points: int = 3, geo: DataFrame | None = None) -> DataFrame:
    """ix, iy, n, tilt (degrees) of each cell with enough points."""
    return cell_covariance(df, target, geo).where(F.col("n") >= min_points).select("ix", "iy", "n", tilt_degrees().alias("tilt"))


def dense(cells: DataFrame, geo: DataFrame) -> DataFrame:
    """Every cell of the grid; nulls where cells has none."""
    every = geo.select(F.explode(F.expr("sequence(0L, nx - 1)")).alias("ix"), "ny").select("ix", F.explode(F.expr("sequence(0L, ny - 1)")).alias("iy"))
    return every.join(cells, ["ix", "iy"], "left")


def flatness_summary(df: DataFrame, target: int, min_points: int = 3) -> DataFrame:
    """One row: mean_tilt, max_tilt, valid_cells, total_cells, cell_size."""
    geo = geometry(df, target)
    cells = flatness_cells(df, target, min_points, geo).agg(F.avg("tilt").alias("mean_tilt"), F.max("tilt").alias("max_tilt"), F.count("tilt").alias("valid_cells"))
    return cells.crossJoin(F.broadcast(geo)).selectExpr("mean_tilt", "max_tilt", "valid_cells", "nx * ny AS total_cells", "cell AS cell_size")


def plane(df: DataFrame) -> DataFrame:
    """One row a, b, c, computed now, of the least-squares plane z = ax + by + c.

    Centred normal equations. Points on a line or in one place leave planes to choose from: of those,
    the one with the least a * a + b * b + c * c.
    """
    s = df.agg(F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.covar_pop("x", "y").alias("xy"), F.covar_pop("x", "z").alias("xz"), F.covar_pop("y", "z").alias("yz"), *(F.avg(c).alias(f"m{c}") for c in "xyz"))
    s = s.withColumn("det", F.expr("xx * yy - xy * xy")).withColumn("flat", F.expr("det <= 1e-12 * xx * yy OR xx = 0 OR yy = 0"))
    # On a line: (u, v) is its direction, g the slope along it. Any plane with that slope fits; t turns it about the line.
    s = s.withColumn("len", F.expr("sqrt(xx + yy)"))
    s = s.withColumn("u", F.expr("coalesce(try_divide(sqrt(xx), len), 0D)")).withColumn("v", F.expr("coalesce(try_divide(sqrt(yy), len), 0D) * IF(xy < 0, -1, 1)"))
    s = s.withColumn("g", F.expr("coalesce(try_divide(xz * u + yz * v, xx + yy), 0D)"))
    s = s.withColumn("c0", F.expr("mz - g * (u * mx + v * my)")).withColumn("w", F.expr("u * my - v * mx")).withColumn("t", F.expr("c0 * w / (1 + w * w)"))
    s = s.withColumn("one", F.expr("mz / (1 + mx * mx + my * my)"))
    s = s.withColumn("a", F.expr("CASE WHEN NOT flat THEN try_divide(xz * yy - yz * xy, det) WHEN len > 0 THEN g * u - t * v ELSE one * mx END"))
    s = s.withColumn("b", F.expr("CASE WHEN NOT flat THEN try_divide(yz * xx - xz * xy, det) WHEN len > 0 THEN g * v + t * u ELSE one * my END"))
    return fixed(s.selectExpr("a", "b", "mz - a * mx - b * my AS c"))


def detrended(df: DataFrame, fit: DataFrame | None = None) -> DataFrame:
    """df with residual: z less the plane."""
    return df.crossJoin(F.broadcast((plane(df) if fit is None else fit).selectExpr("a AS _a", "b AS _b", "c AS _c"))).withColumn("residual", F.expr("z - (_a * x + _b * y + _c)")).drop("_a", "_b", "_c")


def height_cells(df: DataFrame, target: int = 100, min_points: int = 3) -> DataFrame:
    """ix, iy, n, z_range: the range of the residuals of each cell with enough points."""
    cells = with_cell(detrended(df), geometry(df, target)).groupBy("ix", "iy").agg(F.count("*").alias("n"), (F.max("residual") - F.min("residual")).alias("z_range"))
    return cells.where(F.col("n") >= min_points)


def height_profile(df: DataFrame, target: int = 100, strip_ratio: float = 0.5, min_points: int = 3, cell: float | None = None) -> DataFrame:
    """bin, x_center, z_mean: mean residuals along x in the central strip of y; bins are as wide as the height grid's cells unless cell says so."""
    low, high = df.agg(F.min("y"), F.max("y")).first()
    if low is None:
        return df.sparkSession.range(0).selectExpr("id AS bin", "0D AS x_center", "0D AS z_mean")
    w = geometry(df, target).first()["cell"] if cell is None else cell
    strip = detrended(df).where(F.expr(f"y BETWEEN ({low!r}D + {high!r}D) / 2 - ({high!r}D - {low!r}D) * {strip_ratio!r}D / 2 AND ({low!r}D + {high!r}D) / 2 + ({high!r}D - {low!r}D) * {strip_ratio!r}D / 2")).select("x", "residual")
    ends = fixed(strip.agg(F.min("x").alias("x0"), F.max("x").alias("x1")).selectExpr("x0", f"{w!r}D AS w", f"greatest(cast(ceil((x1 + {w!r}D - x0) / {w!r}D) AS bigint) - 1, 1L) AS nb"))
    bins = strip.crossJoin(F.broadcast(ends)).withColumn("bin", F.expr("greatest(least(cast(floor((x - x0) / w) AS bigint), nb - 1), 0L)"))
    out = bins.groupBy("bin").agg(F.count("*").alias("n"), F.avg("residual").alias("z_mean"), F.first("x0").alias("x0"), F.first("w").alias("w"))
    return out.where(F.col("n") >= min_points).selectExpr("bin", "x0 + (bin + 0.5D) * w AS x_center", "z_mean")


def profile_stats(profile: DataFrame) -> DataFrame:
    """One row: sigma_mm and peak_to_valley_mm of the bins' means, each bin alike."""
    return profile.agg(F.stddev_pop(F.col("z_mean") * 1000).alias("sigma_mm"), ((F.max("z_mean") - F.min("z_mean")) * 1000).alias("peak_to_valley_mm"))


def spline(profile: DataFrame, per_bin: int = 10) -> DataFrame:
    """step, x, z: the not-a-knot cubic spline through a profile (x_center, z_mean), at per_bin places a bin from its first to its last centre.

    With fewer than four bins the profile itself. The bins (as many as a grid has along x) meet in one row; the second derivatives solve a
    tridiagonal system, by a fold forward over the array and one back.
    """
    one = profile.where("x_center IS NOT NULL AND z_mean IS NOT NULL").agg(F.sort_array(F.collect_list(F.struct(F.col("x_center").alias("x"), F.col("z_mean").alias("z")))).alias("p")).withColumn("n", F.expr("size(p)"))
    one = one.withColumn("h", F.expr("transform(sequence(0, greatest(n - 2, 0)), i -> IF(n < 2, 0D, p[least(i + 1, n - 1)].x - p[i].x))"))
    one = one.withColumn("s", F.expr("transform(sequence(0, greatest(n - 2, 0)), i -> IF(n < 2, 0D, (p[least(i + 1, n - 1)].z - p[i].z) / h[i]))"))
    # Rows 1 to n - 2: h[i-1] m[i-1] + 2 (h[i-1] + h[i]) m[i] + h[i] m[i+1] = 6 (s[i] - s[i-1]). At the ends the third derivative goes on over
    # the second and the last but one point, so m[0] and m[n-1] are replaced by their neighbours.
    a = "IF(i = n - 2, h[i - 1] - h[i] * h[i] / h[i - 1], h[i - 1])"
    b = "2 * (h[i - 1] + h[i]) + IF(i = 1, h[0] * (1 + h[0] / h[1]), 0D) + IF(i = n - 2, h[i] * (1 + h[i] / h[i - 1]), 0D)"
    c = "IF(i = 1, h[i] - h[0] * h[0] / h[1], h[i])"
    one = one.withColumn("rows", F.expr(f"IF(n < 4, array(), transform(sequence(1, greatest(n - 2, 1)), i -> struct(IF(i = 1, 0D, {a}) AS a, {b} AS b, IF(i = n - 2, 0D, {c}) AS c, 6 * (s[i] - s[i - 1]) AS d)))"))
    first = "cast(array() AS array<struct<c: double, d: double>>)"
    ahead = "transform(array(r.b - r.a * coalesce(element_at(w, -1).c, 0D)), v -> struct(r.c / v AS c, (r.d - r.a * coalesce(element_at(w, -1).d, 0D)) / v AS d))"
    one = one.withColumn("w", F.expr(f"aggregate(rows, {first}, (w, r) -> concat(w, IF(size(w) = 0, array(struct(r.c / r.b AS c, r.d / r.b AS d)), {ahead})))"))
    one = one.withColumn("m", F.expr("reverse(aggregate(reverse(w), cast(array() AS array<double>), (m, r) -> concat(m, array(r.d - r.c * IF(size(m) = 0, 0D, element_at(m, -1))))))"))
    one = one.withColumn("m", F.expr("IF(n < 4, m, concat(array((1 + h[0] / h[1]) * m[0] - h[0] / h[1] * m[1]), m, array((1 + h[n - 2] / h[n - 3]) * m[n - 3] - h[n - 2] / h[n - 3] * m[n - 4])))"))
    at = one.select("*", F.posexplode(F.expr(f"IF(n < 4, transform(p, q -> q.x), transform(sequence(0, n * {per_bin} - 1), k -> IF(k = n * {per_bin} - 1, p[n - 1].x, p[0].x + k * ((p[n - 1].x - p[0].x) / (n * {per_bin} - 1)))))")).alias("step", "x"))
    at = at.withColumn("i", F.expr("IF(n < 4, step, greatest(least(size(filter(p, q -> q.x <= x)), n - 1), 1) - 1)"))
    left, right = "(p[i + 1].x - x)", "(x - p[i].x)"
    curve = f"(m[i] * {left} * {left} * {left} + m[i + 1] * {right} * {right} * {right}) / (6 * h[i]) + (p[i].z / h[i] - m[i] * h[i] / 6) * {left} + (p[i + 1].z / h[i] - m[i + 1] * h[i] / 6) * {right}"
    return at.selectExpr("cast(step AS bigint) AS step", "x", f"IF(n < 4, p[step].z, {curve}) AS z")
