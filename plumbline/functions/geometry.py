"""Expressions over coordinates and colours."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(*axes: tuple[str, float]) -> Column:
    """Euclidean distance of columns to given values."""
    return F.sqrt(sum((F.pow(F.col(c) - F.lit(m), 2) for c, m in axes), F.lit(0.0)))


def tilt_degrees() -> Column:
    """Angle of a plane to the horizontal, from a cell's covariances xx, yy, zz, xy, xz, yz.

    The normal is the eigenvector of the least eigenvalue, both in closed form. 0 if all
    points are equal. Where the normal isn't unique (points on a line), any is taken.
    """
    q = "((xx + yy + zz) / 3)"
    p = f"sqrt(((xx - {q}) * (xx - {q}) + (yy - {q}) * (yy - {q}) + (zz - {q}) * (zz - {q}) + 2 * (xy * xy + xz * xz + yz * yz)) / 6)"
    det = "((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz))"
    least = f"q + 2 * p * cos(acos(greatest(-1D, least(1D, {det} / (2 * p * p * p)))) / 3 + 2 * pi() / 3)"
    # Columns of the adjugate of S - m I; the longest one is the normal.
    a, d, f = "(xx - m)", "(yy - m)", "(zz - m)"
    c1 = f"array({d} * {f} - yz * yz, xz * yz - xy * {f}, xy * yz - xz * {d})"
    c2 = f"array(xz * yz - xy * {f}, {a} * {f} - xz * xz, xy * xz - {a} * yz)"
    c3 = f"array(xy * yz - xz * {d}, xy * xz - {a} * yz, {a} * {d} - xy * xy)"
    norm = "sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])"
    best = f"array_max(transform(array({c1}, {c2}, {c3}), v -> struct({norm} AS len, abs(v[2]) AS nz)))"
    angle = "CASE WHEN w.len > 0 THEN degrees(acos(least(1D, w.nz / w.len))) ELSE 0D END"
    let = lambda value, name, body: f"transform(array({value}), {name} -> {body})[0]"
    inner = let(least, "m", let(best, "w", angle))
    return F.expr(let(q, "q", let(p, "p", f"CASE WHEN p > 0 THEN {inner} ELSE 0D END")))
