"""SQL for DuckDB that gives the same rows as the registered queries, by other means where there are any."""

from __future__ import annotations

_POINTS = """pts AS (
  SELECT *, CASE WHEN l_returnflag <> 'R' THEN 0.002::double * x + 0.001::double * y + (l_discount - 0.05::double) * 0.2::double + (l_tax - 0.04::double) * 0.25::double
                 ELSE 0.3::double + l_quantity / 50.0::double * 2.5::double END AS z,
         l_discount * 10.0::double AS r, l_tax * 12.5::double AS g, l_quantity / 50.0::double AS b, l_quantity * 20.0::double + l_discount * 100.0::double AS intensity
  FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS vertex_idx,
               (l_extendedprice - 900.0::double) / 104100.0::double * 20.0::double AS x,
               date_diff('day', timestamp '1995-01-01', l_shipdate) / 2500.0::double * 10.0::double AS y FROM lineitem)
)"""


def _hist(src: str, col: str, bins: int, name: str, lo: str | None = None, hi: str | None = None) -> str:
    lo, hi = lo or f"min({col})", hi or f"max({col})"
    return f"""{name}x AS (SELECT {lo} AS lo, {hi} AS hi FROM {src}),
{name} AS (SELECT k AS bin, lo + k * ((hi - lo) / {bins}.0) AS lo, lo + (k + 1) * ((hi - lo) / {bins}.0) AS hi, coalesce(n, 0)::bigint AS n
  FROM {name}x, range(0, {bins}) t(k) LEFT JOIN (
    SELECT least(floor(({col} - lo) / ((hi - lo) / {bins}.0)), {bins - 1})::bigint AS bin, count(*) AS n FROM {src}, {name}x GROUP BY 1) c ON c.bin = k)"""


#: Local maxima, prominences and widths of histogram h.
_PEAKS = """runs AS (SELECT min(bin) AS b0, max(bin) AS b1, any_value(n) AS n FROM (
    SELECT *, sum(chg) OVER (ORDER BY bin) AS g FROM (SELECT *, CASE WHEN n = lag(n) OVER (ORDER BY bin) THEN 0 ELSE 1 END AS chg FROM h)) GROUP BY g),
tops AS (SELECT (b0 + b1) // 2 AS bin, n FROM (SELECT *, lag(n) OVER (ORDER BY b0) AS p, lead(n) OVER (ORDER BY b0) AS q FROM runs) WHERE p < n AND q < n),
walls AS (SELECT t.bin, t.n, coalesce(max(h.bin) FILTER (WHERE h.bin < t.bin AND h.n > t.n), -1) AS lw, coalesce(min(h.bin) FILTER (WHERE h.bin > t.bin AND h.n > t.n), 1000000) AS rw FROM tops t, h GROUP BY 1, 2),
lows AS (SELECT w.bin, w.n, min(h.n) FILTER (WHERE h.bin BETWEEN w.lw + 1 AND w.bin) AS lm, min(h.n) FILTER (WHERE h.bin BETWEEN w.bin AND w.rw - 1) AS rm, w.lw, w.rw FROM walls w, h GROUP BY w.bin, w.n, w.lw, w.rw),
bases AS (SELECT l.bin, l.n, l.n - greatest(lm, rm) AS prominence, l.n - (l.n - greatest(lm, rm)) / 2.0 AS level,
    max(h.bin) FILTER (WHERE h.bin BETWEEN lw + 1 AND l.bin AND h.n = lm) AS lb, min(h.bin) FILTER (WHERE h.bin BETWEEN l.bin AND rw - 1 AND h.n = rm) AS rb FROM lows l, h GROUP BY l.bin, l.n, lm, rm),
ends AS (SELECT b.bin, b.n, b.prominence, b.level, max(h.bin) FILTER (WHERE h.bin <= b.bin AND (h.bin = lb OR h.n <= level)) AS li, min(h.bin) FILTER (WHERE h.bin >= b.bin AND (h.bin = rb OR h.n <= level)) AS ri FROM bases b, h GROUP BY ALL),
peaks AS (SELECT e.bin, e.n, e.prominence::double AS prominence,
    ri - CASE WHEN r0.n < level THEN (level - r0.n) / (r1.n - r0.n) ELSE 0 END - li - CASE WHEN l0.n < level THEN (level - l0.n) / (l1.n - l0.n) ELSE 0 END AS width
  FROM ends e JOIN h l0 ON l0.bin = li JOIN h l1 ON l1.bin = li + 1 JOIN h r0 ON r0.bin = ri JOIN h r1 ON r1.bin = ri - 1)"""


def _peak(scale: float = 1.0, min_width: float = 2.0, band: float | None = None, mult: str = "2.5") -> str:
    half = f"{band}::double" if band is not None else f"f * CASE WHEN f > 2.0 THEN 1.0::double ELSE {mult}::double END / 2"
    return f"""zs AS (SELECT z * {scale}::double AS z FROM pts), {_hist("zs", "z", 200, "h")}, {_PEAKS},
ex AS (SELECT min(z) AS mn, max(z) AS mx FROM zs),
pick AS (SELECT * FROM peaks WHERE prominence >= 0.1 * (SELECT max(n) FROM h) AND width >= {min_width} ORDER BY n DESC, bin LIMIT 1),
pk0 AS (SELECT mn, mn + (mx - mn) * 0.2::double AS top, lo + (bin + 0.5) * ((hi - lo) / 200.0) AS pz, width * ((hi - lo) / 200.0) AS f FROM ex, hx LEFT JOIN pick ON true),
pk AS (SELECT coalesce(pz, (mn + top) / 2) AS peak_z, coalesce(pz - {half}, mn) AS z_min, coalesce(pz + {half}, top) AS z_max, coalesce(f, top - mn) AS fwhm, pz IS NULL AS is_fallback, coalesce(f > 2.0, false) AS is_tilt_limited FROM pk0)"""


def _mask(mult: str = "2.5", tol: str = "0.6", pct: str = "25.0", intensity: bool = True, color: bool = True) -> str:
    ok = [*(["intensity >= thr"] if intensity else []), *(["(spread > 0.01 AND sqrt(pow(r - mr, 2) + pow(g - mg, 2) + pow(b - mb, 2)) <= {tol}::double)".format(tol=tol)] if color else [])]
    return f"""{_POINTS}, {_peak(mult=mult)},
band AS (SELECT pts.*, z BETWEEN z_min AND z_max AS in_band FROM pts, pk),
st AS (SELECT quantile_cont(intensity, {pct}::double / 100) AS thr, avg(r) AS mr, avg(g) AS mg, avg(b) AS mb, (stddev_pop(r) + stddev_pop(g) + stddev_pop(b)) / 3 AS spread FROM band WHERE in_band),
m AS (SELECT x, y, z, r, g, b, intensity, vertex_idx, in_band, in_band AND ({" OR ".join(ok) or "true"}) AS is_floor FROM band, st), f AS (SELECT * FROM m WHERE is_floor)"""


def _r(*cols: str, n: int = 6) -> str:
    return ", ".join(f"round({c.split(' AS ')[0]}, {n}) + 0.0 AS {c.split(' AS ')[-1]}" for c in cols)


def _grid(src: str, target: int) -> str:
    return f"""e AS (SELECT min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max FROM {src}),
c0 AS (SELECT *, CASE WHEN greatest(x_max - x_min, y_max - y_min) > 0 THEN greatest(x_max - x_min, y_max - y_min) / {target}.0::double ELSE 1.0 END AS cell FROM e),
geo AS (SELECT x_min, y_min, cell, greatest(ceil((x_max + cell - x_min) / cell)::bigint - 1, 1) AS nx, greatest(ceil((y_max + cell - y_min) / cell)::bigint - 1, 1) AS ny FROM c0),
ac AS (SELECT s.*, greatest(least(floor((x - x_min) / cell)::bigint, nx - 1), 0)::bigint AS ix, greatest(least(floor((y - y_min) / cell)::bigint, ny - 1), 0)::bigint AS iy FROM {src} s, geo)"""


_COV = "cov AS (SELECT ix, iy, count(*) AS n, var_pop(x) AS xx, var_pop(y) AS yy, var_pop(z) AS zz, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz FROM ac GROUP BY 1, 2)"
_TILT = """e1 AS (SELECT *, (xx + yy + zz) / 3 AS q FROM cov WHERE n >= 3),
e2 AS (SELECT *, sqrt((pow(xx - q, 2) + pow(yy - q, 2) + pow(zz - q, 2) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM e1),
e3 AS (SELECT *, CASE WHEN p > 0 THEN q + 2 * p * cos(acos(greatest(-1, least(1, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * p * p * p)))) / 3 + 2 * pi() / 3) END AS l FROM e2),
e4 AS (SELECT ix, iy, n, p, (yy - l) * (zz - l) - yz * yz AS a11, xz * yz - xy * (zz - l) AS a12, xy * yz - xz * (yy - l) AS a13, (xx - l) * (zz - l) - xz * xz AS a22, xy * xz - (xx - l) * yz AS a23, (xx - l) * (yy - l) - xy * xy AS a33 FROM e3),
e5 AS (SELECT *, a11 * a11 + a12 * a12 + a13 * a13 AS n1, a12 * a12 + a22 * a22 + a23 * a23 AS n2, a13 * a13 + a23 * a23 + a33 * a33 AS n3 FROM e4),
tilts AS (SELECT ix, iy, n, CASE WHEN p > 0 AND greatest(n1, n2, n3) > 0 THEN degrees(acos(least(1, abs(CASE WHEN n1 >= n2 AND n1 >= n3 THEN a13 WHEN n2 >= n3 THEN a23 ELSE a33 END) / sqrt(greatest(n1, n2, n3))))) ELSE 0 END AS tilt FROM e5)"""
_ROI = f"{_POINTS}, q AS (SELECT * FROM pts WHERE x BETWEEN 5 AND 15 AND y BETWEEN 2 AND 8), f AS (SELECT * FROM q WHERE z BETWEEN -0.05 AND 0.1)"
_PLANE = """ps AS (SELECT regr_slope(z, x) AS sx, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM f),
pab AS (SELECT (xz * yy - yz * xy) / (xx * yy - xy * xy) AS a, (yz * xx - xz * xy) / (xx * yy - xy * xy) AS b, mx, my, mz FROM ps), pl AS (SELECT a, b, mz - a * mx - b * my AS c FROM pab),
res AS (SELECT f.*, f.z - (pl.a * f.x + pl.b * f.y + pl.c) AS residual FROM f, pl)"""


def _surface(resolution: int) -> str:
    return f"""e AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM f),
n0 AS (SELECT *, greatest(x1 - x0, y1 - y0) / {resolution}.0::double AS step FROM e),
n AS (SELECT *, greatest(trunc((x1 - x0) / step)::bigint, 2) AS nx, greatest(trunc((y1 - y0) / step)::bigint, 2) AS ny FROM n0),
nodes AS (SELECT i AS ix, j AS iy, x0 + (x1 - x0) * i / (nx - 1) AS x, y0 + (y1 - y0) * j / (ny - 1) AS y FROM n, range(0, nx) a(i), range(0, ny) b(j))"""


#: Means of the cells around each node.
_MEANS = """cl AS (SELECT floor((x - x0) / step)::bigint AS cx, floor((y - y0) / step)::bigint AS cy, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM f, n GROUP BY 1, 2),
known AS (SELECT ix, iy, any_value(q.x) AS x, any_value(q.y) AS y, sum(w * mz) / sum(w) AS z FROM (
    SELECT ix, iy, d.x, d.y, mz, cl.n / (pow(d.x - mx, 2) + pow(d.y - my, 2) + 1e-12) AS w
    FROM (SELECT nodes.*, floor((x - x0) / step)::bigint + i AS cx, floor((y - y0) / step)::bigint + j AS cy FROM nodes, n, range(-1, 2) a(i), range(-1, 2) b(j)) d JOIN cl USING (cx, cy)) q GROUP BY ix, iy)"""
#: The Delaunay triangle around a node has, of all triangles around it, the least mean of squared distances to the node, weighted as the node lies in it.
#: Corners come from the nearest points, as the triangle's circle holds no point, and from those along the axes, as triangles at the border are long and flat. Nodes move a little inwards to be looked up, so none lies on a side.
_TRIANGLES = """one AS (SELECT row_number() OVER () AS id, x AS px, y AS py, arg_min(z, vertex_idx) AS z FROM f GROUP BY x, y),
few AS (SELECT ix, iy, x, y, unnest(list_distinct(arg_min(id, pow(px - x, 2) + pow(py - y, 2), 36) || arg_min(id, pow(px - x, 2) + 1e6 * pow(py - y, 2), 6) || arg_min(id, 1e6 * pow(px - x, 2) + pow(py - y, 2), 6))) AS id FROM nodes, one GROUP BY ix, iy, x, y),
near AS (SELECT ix, iy, x, y, id AS k, z, px - x AS u, py - y AS v, px - (x + 1e-8 * ((x0 + x1) / 2 + 0.001 - x)) AS us, py - (y + 1e-8 * ((y0 + y1) / 2 + 0.002 - y)) AS vs FROM few JOIN one USING (id), n),
trio AS (SELECT a.ix, a.iy, a.x, a.y, b.us * c.vs - c.us * b.vs AS p, c.us * a.vs - a.us * c.vs AS q, a.us * b.vs - b.us * a.vs AS r,
    a.us * a.us + a.vs * a.vs AS ha, b.us * b.us + b.vs * b.vs AS hb, c.us * c.us + c.vs * c.vs AS hc,
    ((b.u * c.v - c.u * b.v) * a.z + (c.u * a.v - a.u * c.v) * b.z + (a.u * b.v - b.u * a.v) * c.z) AS zz, (b.u * c.v - c.u * b.v) + (c.u * a.v - a.u * c.v) + (a.u * b.v - b.u * a.v) AS w
  FROM near a JOIN near b ON a.ix = b.ix AND a.iy = b.iy AND a.k < b.k JOIN near c ON b.ix = c.ix AND b.iy = c.iy AND b.k < c.k),
known AS (SELECT ix, iy, any_value(x) AS x, any_value(y) AS y, arg_min(zz / w, (p * ha + q * hb + r * hc) / (p + q + r)) AS z
  FROM trio WHERE abs(p + q + r) > 1e-12 AND p / (p + q + r) >= 0 AND q / (p + q + r) >= 0 AND r / (p + q + r) >= 0 GROUP BY ix, iy)"""
#: The nearest point of the other nodes, by comparing all of them.
_NEAREST = """holes AS (SELECT nodes.* FROM nodes ANTI JOIN known USING (ix, iy)),
heights AS (SELECT ix, iy, x, y, z FROM known UNION ALL SELECT ix, iy, x, y, z FROM (
  SELECT ix, iy, holes.x, holes.y, f.z, row_number() OVER (PARTITION BY ix, iy ORDER BY (f.x - holes.x) * (f.x - holes.x) + (f.y - holes.y) * (f.y - holes.y), vertex_idx) AS k FROM holes, f) WHERE k = 1)"""


SWEEPS = {"mult": ("width_multiplier", [1, 2, 3, 4, 5, 7, 10], 2.5), "tol": ("color_tolerance", [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8], 0.6), "pct": ("intensity_percentile", [10, 20, 25, 30, 40, 50, 75], 25)}


def _sweep(kind: str, **given) -> str:
    """One scan for each value, unlike the query's one for all."""
    param, values, current = SWEEPS[kind]
    parts = []
    for v in values:
        args = {"mult": "2.5", "tol": "0.6", "pct": "25.0"} | {kind: str(float(v))}
        parts.append(f"SELECT '{param}' AS param, {float(v)}::double AS value, {str(v == current).lower()} AS is_current, (WITH {_mask(**args, **given)} SELECT round(count(*) FILTER (WHERE is_floor) / count(*)::double, 6) FROM m) AS floor_ratio")
    return " UNION ALL ".join(parts)


def _sweep_grid() -> str:
    """Every combination, by comparing all points of each band with all thresholds and tolerances."""
    lists = {k: f"unnest([{', '.join(str(float(v)) for v in values)}]::double[])" for k, (_, values, _) in SWEEPS.items()}
    return f"""WITH {_POINTS}, {_peak(mult="1.0")}, w AS (SELECT {lists["mult"]} AS mult), t AS (SELECT {lists["tol"]} AS tol), p AS (SELECT {lists["pct"]} AS pct),
band AS (SELECT mult, pts.* FROM pts, pk, w WHERE z BETWEEN peak_z - (z_max - peak_z) * mult AND peak_z + (z_max - peak_z) * mult),
tone AS (SELECT mult, avg(r) AS mr, avg(g) AS mg, avg(b) AS mb, (stddev_pop(r) + stddev_pop(g) + stddev_pop(b)) / 3 AS spread FROM band GROUP BY 1),
lim AS (SELECT mult, pct, any_value(l[i]) AS thr FROM (SELECT mult, quantile_cont(intensity, [0.1, 0.2, 0.25, 0.3, 0.4, 0.5, 0.75]) AS l FROM band GROUP BY 1), (SELECT pct, row_number() OVER (ORDER BY pct) AS i FROM p) GROUP BY 1, 2)
SELECT mult AS width_multiplier, tol AS color_tolerance, pct AS intensity_percentile, round(count(*) / (SELECT count(*) FROM pts)::double, 6) AS floor_ratio
FROM band JOIN tone USING (mult) JOIN lim USING (mult), t WHERE intensity >= thr OR (spread > 0.01 AND sqrt(pow(r - mr, 2) + pow(g - mg, 2) + pow(b - mb, 2)) <= tol) GROUP BY ALL"""


def _spline(profile: str) -> str:
    """The not-a-knot spline as a least sum: its second derivatives solve the system that a recursion eliminates row by row."""
    return f"""WITH RECURSIVE {profile.removeprefix("WITH ")}, knots AS (SELECT row_number() OVER (ORDER BY x_center) - 1 AS i, x_center AS x, z_mean AS z, count(*) OVER () AS n FROM pr),
hs AS (SELECT i, n, x, z, lead(x) OVER w - x AS h, (lead(z) OVER w - z) / (lead(x) OVER w - x) AS s, x - lag(x) OVER w AS g, (z - lag(z) OVER w) / (x - lag(x) OVER w) AS t FROM knots WINDOW w AS (ORDER BY i)),
sys AS (SELECT i, n, g, h, CASE WHEN i = n - 2 THEN g - h * h / g ELSE g END AS a, 2 * (g + h) + CASE WHEN i = 1 THEN g + g * g / h ELSE 0 END + CASE WHEN i = n - 2 THEN h + h * h / g ELSE 0 END AS b,
  CASE WHEN i = 1 THEN h - g * g / h ELSE h END AS c, 6 * (s - t) AS d FROM hs WHERE i BETWEEN 1 AND n - 2),
down AS (SELECT i, c / b AS c, d / b AS d FROM sys WHERE i = 1 UNION ALL SELECT y.i, y.c / (y.b - y.a * p.c), (y.d - y.a * p.d) / (y.b - y.a * p.c) FROM down p JOIN sys y ON y.i = p.i + 1),
up AS (SELECT i, d AS m FROM down WHERE i = (SELECT max(i) FROM down) UNION ALL SELECT y.i, y.d - y.c * p.m FROM up p JOIN down y ON y.i = p.i - 1),
curve AS (SELECT * FROM up UNION ALL SELECT 0, (1 + g / h) * u.m - g / h * v.m FROM sys, up u, up v WHERE sys.i = 1 AND u.i = 1 AND v.i = 2
  UNION ALL SELECT n - 1, (1 + h / g) * u.m - h / g * v.m FROM sys, up u, up v WHERE sys.i = n - 2 AND u.i = n - 2 AND v.i = n - 3),
piece AS (SELECT a.i, a.x AS x0, b.x AS x1, a.z AS z0, b.z AS z1, ma.m AS m0, mb.m AS m1, b.x - a.x AS h FROM knots a JOIN knots b ON b.i = a.i + 1 JOIN curve ma ON ma.i = a.i JOIN curve mb ON mb.i = b.i),
reach AS (SELECT min(x) AS lo, max(x) AS hi, any_value(n) AS n FROM knots),
steps AS (SELECT k AS step, CASE WHEN k = n * 10 - 1 THEN hi ELSE lo + k * ((hi - lo) / (n * 10 - 1)) END AS x FROM reach, range(0, n * 10) r(k))
SELECT step, {_r("x")}, round((m0 * pow(x1 - x, 3) + m1 * pow(x - x0, 3)) / (6 * h) + (z0 / h - m0 * h / 6) * (x1 - x) + (z1 / h - m1 * h / 6) * (x - x0), 6) + 0.0 AS z
FROM steps ASOF JOIN (SELECT * FROM piece) piece ON steps.x >= piece.x0"""


def _report_fields() -> str:
    """The document's numbers, each from the tables rather than from the document."""
    rows = lambda section, names, src: " UNION ALL ".join(f"SELECT '{section}' AS section, '{f}' AS field, {e}::double AS value FROM {src}" for f, e in names.items())
    peak = {c: f"round_even({c}, 6)" for c in ("peak_z", "z_min", "z_max", "fwhm")} | {"num_bins": "200"}
    stages = {"total_points": "count(*)", "after_z_filter": "count(*) FILTER (WHERE in_band)", "after_refinement": "count(*) FILTER (WHERE is_floor)", "floor_ratio": "round_even(count(*) FILTER (WHERE is_floor) / count(*)::double, 6)"}
    given = {"width_multiplier": "2.5", "intensity_percentile": "25", "color_tolerance": "0.6", "num_bins": "200", "prominence_ratio": "0.1", "min_peak_width": "2"}
    flat = {"mean_tilt_degrees": "round_even(avg(tilt), 4)", "max_tilt_degrees": "round_even(max(tilt), 4)", "cell_size_meters": "round_even(any_value(cell), 4)", "valid_cells": "count(tilt)", "total_cells": "any_value(nx * ny)"}
    sweeps = " UNION ALL ".join(f"SELECT 'sensitivity', param || '.' || (row_number() OVER (ORDER BY value) - 1), floor_ratio FROM ({_sweep(k)})" for k in SWEEPS)
    return f"""WITH {_mask()}, {_grid('f', 150)}, {_COV}, {_TILT}
SELECT section, field, round(value, 6) + 0.0 AS value FROM ({rows("peak_detection", peak, "pk")} UNION ALL {rows("filtering", stages, "m")} UNION ALL {rows("parameters_used", given, "(SELECT 1)")} UNION ALL {rows("flatness", flat, "tilts, geo")} UNION ALL {sweeps})"""


def oracle_sql() -> dict[str, str]:
    peak_cols = _r("peak_z", "z_min", "z_max", "fwhm") + ", is_fallback, is_tilt_limited"
    stages = "SELECT count(*) AS total, count(*) FILTER (WHERE in_band) AS after_z_filter, count(*) FILTER (WHERE is_floor) AS after_refinement FROM m"
    floor_color = f"{_mask()}, mc AS (SELECT avg(r) AS ar, avg(g) AS ag, avg(b) AS ab FROM f), cd AS (SELECT f.*, sqrt(pow(r - ar, 2) + pow(g - ag, 2) + pow(b - ab, 2)) AS dist FROM f, mc)"
    geo20 = f"WITH {_mask()}, {_grid('f', 20)}, {_COV}"
    roi_grid = f"WITH {_ROI}, {_PLANE}, {_grid('res', 100)}, hc AS (SELECT ix, iy, count(*) AS n, max(residual) - min(residual) AS z_range FROM ac GROUP BY 1, 2 HAVING count(*) >= 3)"
    profile = f"""WITH {_ROI}, {_PLANE}, {_grid('res', 100)}, ys AS (SELECT min(y) AS y0, max(y) AS y1 FROM f),
strip AS (SELECT res.*, cell FROM res, ys, geo WHERE y BETWEEN (y0 + y1) / 2 - (y1 - y0) * 0.5 / 2 AND (y0 + y1) / 2 + (y1 - y0) * 0.5 / 2),
sx AS (SELECT min(x) AS x0, greatest(ceil((max(x) + any_value(cell) - min(x)) / any_value(cell))::bigint - 1, 1) AS nb FROM strip),
pr AS (SELECT greatest(least(floor((x - x0) / cell)::bigint, nb - 1), 0)::bigint AS bin, x0 + (greatest(least(floor((x - x0) / cell)::bigint, nb - 1), 0) + 0.5) * cell AS x_center, avg(residual) AS z_mean FROM strip, sx GROUP BY 1, 2 HAVING count(*) >= 3)"""
    px = lambda c: f"trunc({c} * 255)::int"
    return {
        "points_projection": f"WITH {_POINTS} SELECT vertex_idx, {_r(*'xyzrgb', 'intensity')} FROM pts",
        "z_extent": f"WITH {_POINTS} SELECT {_r(*(f'{f}({c}) AS {c}_{f}' for c in 'xyz' for f in ('min', 'max')))} FROM pts",
        "z_histogram": f"WITH {_POINTS}, {_hist('pts', 'z', 200, 'h')} SELECT bin, {_r('lo', 'hi')}, n FROM h",
        "peak_candidates": f"WITH {_POINTS}, {_hist('pts', 'z', 200, 'h')}, {_PEAKS} SELECT bin, n, {_r('prominence', 'width')} FROM peaks",
        "floor_peak": f"WITH {_POINTS}, {_peak()} SELECT {peak_cols} FROM pk",
        "floor_peak_fallback": f"WITH {_POINTS}, {_peak(min_width=3)} SELECT {peak_cols} FROM pk",
        "floor_peak_fixed_band": f"WITH {_POINTS}, {_peak(band=0.04)} SELECT {peak_cols} FROM pk",
        "floor_peak_tilt_limited": f"WITH {_POINTS}, {_peak(scale=100.0)} SELECT {peak_cols} FROM pk",
        "fwhm_overlay": f"WITH {_POINTS}, {_peak()} SELECT {_r('peak_z - fwhm / 2 AS z_left', 'peak_z + fwhm / 2 AS z_right')}, n / 2.0::double AS level FROM pk, h ORDER BY abs((lo + hi) / 2 - peak_z), bin LIMIT 1",
        "z_filter_count": f"WITH {_mask()} SELECT count(*) FILTER (WHERE in_band) AS n FROM m",
        "refine_stats": f"WITH {_mask()} SELECT {_r('thr AS threshold', 'mr', 'mg', 'mb', 'spread')} FROM st",
        "filtering_funnel": f"WITH {_mask()}, s AS ({stages}) SELECT stage, n, round(n / greatest(total, 1)::double * 100, 6) AS pct FROM (SELECT total, unnest(['total', 'after_z_filter', 'after_refinement']) AS stage, unnest([total, after_z_filter, after_refinement]) AS n FROM s)",
        "floor_mask_count": f"WITH {_mask()} {stages}",
        "refine_intensity_only": f"WITH {_mask(color=False)} {stages}",
        "refine_color_only": f"WITH {_mask(intensity=False)} {stages}",
        "refine_no_attributes": f"WITH {_mask(intensity=False, color=False)} {stages}",
        "floor_ratio": f"WITH {_mask()} SELECT count(*) FILTER (WHERE is_floor) AS floor, count(*) FILTER (WHERE NOT is_floor) AS non_floor, round(count(*) FILTER (WHERE is_floor) / count(*)::double, 6) AS floor_ratio FROM m",
        "intensity_threshold": f"WITH {_mask()}, t AS (SELECT quantile_cont(intensity, 0.25) AS threshold FROM f) SELECT threshold, count(*) FILTER (WHERE intensity >= threshold) AS passed, count(*) FILTER (WHERE intensity < threshold) AS failed, least(100, greatest(20, count(*) // 50))::bigint AS bins FROM f, t GROUP BY 1",
        "intensity_histogram": f"WITH {_mask()}, t AS (SELECT quantile_cont(intensity, 0.25) AS threshold, min(intensity) AS lo, max(intensity) AS hi, least(100, greatest(20, count(*) // 50))::bigint AS bins FROM f), c AS (SELECT least(floor((intensity - lo) / ((hi - lo) / bins))::bigint, bins - 1)::bigint AS bin, count(*) FILTER (WHERE intensity >= threshold) AS passed, count(*) FILTER (WHERE intensity < threshold) AS failed FROM f, t GROUP BY 1) SELECT k AS bin, {_r('lo + k * ((hi - lo) / bins) AS lo', 'lo + (k + 1) * ((hi - lo) / bins) AS hi')}, coalesce(passed, 0)::bigint AS passed, coalesce(failed, 0)::bigint AS failed FROM t, range(0, bins) b(k) LEFT JOIN c ON c.bin = k",
        "color_stats": f"WITH {floor_color} SELECT {_r(*(f'avg({c}) AS mean_{c}' for c in 'rgb'), *(f'stddev_pop({c}) AS std_{c}' for c in 'rgb'), 'max(dist) AS max_dist')} FROM cd",
        "color_distance_histogram": f"WITH {floor_color}, {_hist('cd', 'dist', 59, 'ch', '0.0::double', 'max(dist) * 1.05::double')} SELECT bin, n, (lo + hi) / 2 <= 0.6 AS passed FROM ch",
        "color_distance_split": f"WITH {floor_color} SELECT count(*) FILTER (WHERE dist <= 0.6) AS passed, count(*) FILTER (WHERE dist > 0.6) AS removed FROM cd",
        "sweep_width_multiplier": _sweep("mult"),
        "sweep_color_tolerance": _sweep("tol"),
        "sweep_intensity_percentile": _sweep("pct"),
        "sweep_grid": _sweep_grid(),
        "sweep_without_intensity": " UNION ALL ".join(_sweep(k, intensity=False) for k in SWEEPS),
        "sweep_without_colors": " UNION ALL ".join(_sweep(k, color=False) for k in SWEEPS),
        "grid_geometry": f"WITH {_mask()}, {_grid('f', 150)} SELECT {_r('x_min', 'y_min', 'cell')}, nx, ny FROM geo",
        "cell_counts": f"{geo20} SELECT ix, iy, n FROM cov",
        "cell_covariance": f"{geo20} SELECT ix, iy, n, {_r('xx', 'yy', 'zz', 'xy', 'xz', 'yz')} FROM cov",
        "flatness_cells": f"{geo20}, {_TILT} SELECT ix, iy, n, {_r('tilt', n=4)} FROM tilts",
        "flatness_grid_dense": f"{geo20}, {_TILT} SELECT i AS ix, j AS iy, n, round(tilt, 4) + 0.0 AS tilt FROM geo, range(0, nx) a(i), range(0, ny) b(j) LEFT JOIN tilts ON tilts.ix = i AND tilts.iy = j",
        "flatness_summary": f"WITH {_mask()}, {_grid('f', 150)}, {_COV}, {_TILT} SELECT round(avg(tilt), 4) AS mean_tilt, round(max(tilt), 4) AS max_tilt, count(tilt) AS valid_cells, any_value(nx * ny) AS total_cells, round(any_value(cell), 4) AS cell_size FROM tilts, geo",
        "plane_fit": f"WITH {_ROI}, {_PLANE} SELECT {_r('a', 'b', 'c')} FROM pl",
        "detrended_residuals": f"WITH {_ROI}, {_PLANE} SELECT count(*) AS n, {_r('min(residual) AS low', 'max(residual) AS high', 'stddev_pop(residual) AS sigma')} FROM res",
        "roi_filter": f"WITH {_ROI} SELECT count(*) AS n, round(sum(z), 4) AS sum_z FROM q",
        "z_roi_filter": f"WITH {_ROI} SELECT count(*) AS n FROM f",
        "z_roi_histogram": f"WITH {_ROI}, {_hist('q', 'z', 100, 'h')} SELECT bin, {_r('lo', 'hi')}, n FROM h",
        "height_grid": f"{roi_grid} SELECT ix, iy, n, {_r('z_range')} FROM hc",
        "height_grid_summary": f"{roi_grid} SELECT count(*) AS valid, {_r('avg(z_range) AS mean_range', 'max(z_range) AS max_range')} FROM hc",
        "height_profile": f"{profile} SELECT bin, {_r('x_center', 'z_mean')} FROM pr",
        "height_profile_stats": f"{profile} SELECT {_r('stddev_pop(z_mean * 1000) AS sigma_mm', '(max(z_mean) - min(z_mean)) * 1000 AS peak_to_valley_mm', n=4)} FROM pr",
        "sample_exact_k": f"WITH {_POINTS} SELECT vertex_idx FROM pts ORDER BY ('0x' || substr(md5('42|' || vertex_idx), 1, 15))::bigint, vertex_idx LIMIT 1000",
        "view_floor": f"WITH {_mask()} SELECT count(*) AS n, sum({px('r')})::bigint AS sum_r FROM m WHERE is_floor",
        "view_nonfloor": f"WITH {_mask()} SELECT count(*) AS n, sum({px('r')})::bigint AS sum_r FROM m WHERE NOT is_floor",
        "view_highlight_rgba": f"WITH {_mask()} SELECT CASE WHEN is_floor THEN 255 ELSE {px('r')} END AS cr, CASE WHEN is_floor THEN 51 ELSE {px('g')} END AS cg, CASE WHEN is_floor THEN 51 ELSE {px('b')} END AS cb, 255 AS ca, count(*) AS n FROM m GROUP BY 1, 2, 3, 4",
        "roi_rectangle": f"WITH {_POINTS} SELECT k AS corner, [5.0, 15.0, 15.0, 5.0][k + 1]::double AS x, [2.0, 2.0, 8.0, 8.0][k + 1]::double AS y, round(z, 6) AS z FROM (SELECT median(z) AS z FROM pts), (SELECT unnest([0, 1, 2, 3]) AS k)",
        "roi_box": f"WITH {_ROI} SELECT {_r('min(z) AS z_low', 'max(z) AS z_high')} FROM q",
        "surface_lattice": f"WITH {_ROI}, {_surface(40)} SELECT ix, iy, {_r('x', 'y')} FROM nodes",
        "surface_interpolated": f"WITH {_ROI}, {_surface(40)}, {_MEANS}, {_NEAREST} SELECT ix, iy, {_r('x', 'y', 'least(greatest(z, z0), z1) AS z')} FROM heights, n",
        "surface_nearest": f"WITH {_ROI}, {_surface(200)}, {_MEANS}, {_NEAREST} SELECT ix, iy, {_r('x', 'y', 'least(greatest(z, z0), z1) AS z')} FROM heights, n",
        "surface_linear": f"WITH {_ROI}, {_surface(40)}, {_TRIANGLES}, {_NEAREST} SELECT ix, iy, {_r('x', 'y', 'least(greatest(z, z0), z1) AS z')} FROM heights, n",
        "nearest_points": f"WITH {_ROI}, {_surface(25)}, known AS (SELECT *, 0.0::double AS z FROM nodes WHERE false), {_NEAREST} SELECT ix, iy, {_r('x', 'y', 'z')} FROM heights",
        "ply_round_trip": f"WITH {_POINTS} SELECT vertex_idx, {_r(*(f'{c}::float::double AS {c}' for c in 'xyz'), *(f'trunc({c} * 255) / 255.0 AS {c}' for c in 'rgb'), 'intensity::float::double AS intensity')} FROM pts",
        "ply_region": f"WITH {_POINTS}, fl AS (SELECT vertex_idx, x::float::double AS x, y::float::double AS y, z::float::double AS z FROM pts) SELECT vertex_idx, {_r('x', 'y', 'z')} FROM fl WHERE x BETWEEN 5 AND 15 AND y BETWEEN 2 AND 8 AND z BETWEEN -0.05 AND 0.1",
        "report_fields": _report_fields(),
        "profile_spline": _spline(profile),
        "roi_segments": f"WITH {_POINTS} SELECT k AS segment, [5.0, 15.0, 15.0, 5.0][k + 1]::double AS x0, [2.0, 2.0, 8.0, 8.0][k + 1]::double AS y0, [15.0, 15.0, 5.0, 5.0][k + 1]::double AS x1, [2.0, 8.0, 8.0, 2.0][k + 1]::double AS y1, round(z, 6) AS z FROM (SELECT median(z) AS z FROM pts), (SELECT unnest([0, 1, 2, 3]) AS k)",
        "z_exaggeration": f"WITH {_ROI}, mm AS (SELECT avg(z) AS m FROM f) SELECT {_r('min(m + (z - m) * 3.0) AS low', 'max(m + (z - m) * 3.0) AS high')} FROM f, mm",
        "format_size": f"WITH {_POINTS} SELECT vertex_idx, format('{{:.1f}} ' || ['B', 'KB', 'MB', 'GB', 'TB', 'PB'][((vertex_idx % 60) // 10 + 1)::int], pow(2, vertex_idx % 60 % 10)::double) AS size FROM pts",
    }
