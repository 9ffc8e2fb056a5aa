"""Triangulated surfaces and nearest points: formulas recovered, tiles without effect, brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.config import Config
from plumbline.operators import surface, view
from plumbline.sources import fixture

FORMS = {"plane": lambda x, y: 0.5 * x - 0.2 * y + 1, "quadric": lambda x, y: 0.1 * x * x - 0.05 * x * y + 0.2 * y * y + x, "wave": lambda x, y: np.sin(x) * np.cos(y)}


def cloud(spark, xy, z):
    return spark.createDataFrame([(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(xy, z, strict=True))], "vertex_idx long, x double, y double, z double")


@pytest.fixture(scope="module")
def scattered():
    return np.random.default_rng(3).uniform(0, 1, (1500, 2)) * [10, 6]


@pytest.mark.parametrize(("method", "form", "worst"), [("linear", "plane", 1e-12), ("cubic", "plane", 1e-12), ("cubic", "quadric", 1e-12), ("cubic", "wave", 0.02), ("linear", "wave", 0.08)])
def test_surface_follows_formula(spark, scattered, method, form, worst):
    f = FORMS[form]
    df = cloud(spark, scattered, f(*scattered.T))
    nodes = view.lattice(df, 24)
    rows = nodes.join(surface.triangulated(nodes, surface.sites(df), method), ["ix", "iy"]).collect()
    assert len(rows) > 250 and max(abs(r.z - f(r.x, r.y)) for r in rows) < worst


def test_tiles_change_nothing(spark, scattered):
    grid = np.array([(i * 0.25, j * 0.25) for i in range(25) for j in range(13)])  # points on common circles
    for xy in (scattered, grid):
        df = cloud(spark, xy, FORMS["wave"](*xy.T)).repartition(5)
        nodes, points = view.lattice(df, 20), surface.sites(df)
        found = [sorted((r.ix, r.iy, round(r.z, 10)) for r in surface.triangulated(nodes, points, "cubic", tile).collect()) for tile in (0.5, None, 50.0)]
        assert found[0] == found[1] == found[2] and len(found[0]) > 150


def test_empty_circle():
    rng = np.random.default_rng(4)
    p = np.column_stack([rng.uniform(0, 1, (300, 2)), np.zeros(300), rng.random(300)])
    q = rng.uniform(0.2, 0.8, (60, 2))
    corners = surface._convex(p)
    where = [int(np.flatnonzero((p == c).all(axis=1))[0]) for c in corners]
    tri, circle = surface.containing(p, np.array(where), q, 1e-12)
    for t, (x, y, r2), node in zip(tri, circle, q, strict=True):
        d2 = (p[:, 0] - x) ** 2 + (p[:, 1] - y) ** 2
        assert np.allclose(d2[t], r2, atol=1e-9) and (np.delete(d2, t) > r2 - 1e-9).all()
        share = np.linalg.solve(np.vstack([p[t, :2].T, np.ones(3)]), np.append(node, 1))
        assert (share > -1e-9).all()
    assert surface.containing(p, np.array(where), np.array([[2.0, 2.0]]), 1e-12)[0].tolist() == [[-1, -1, -1]]


def test_hull_of_lines_and_repeats():
    p = np.array([[0, 0, 0, 0], [1, 1, 0, 0], [2, 2, 0, 0], [1, 1, 0, 0.0]])
    assert sorted(map(tuple, surface._convex(p)[:, :2])) == [(0, 0), (2, 2)]
    square = np.array([[x, y, 0, 0] for x in range(5) for y in range(5)], float)
    assert sorted(map(tuple, surface._convex(np.concatenate([square, square]))[:, :2])) == [(0, 0), (0, 4), (4, 0), (4, 4)]


def test_nearest_point(spark):
    rng = np.random.default_rng(5)
    xy = np.concatenate([rng.uniform(0, 1, (200, 2)), rng.uniform(8, 10, (50, 2)), [[5, 5], [5, 5], [4, 6], [6, 6]]])
    df = cloud(spark, xy, np.arange(len(xy)))
    nodes = view.lattice(df, 40)
    got = {(r.ix, r.iy): r.z for r in surface.nearest(nodes, surface.sites(df), float(xy[:, 0].min()), float(xy[:, 1].min()), 10.0, 0.1).collect()}
    for n in nodes.collect():
        d2 = (xy[:, 0] - n.x) * (xy[:, 0] - n.x) + (xy[:, 1] - n.y) * (xy[:, 1] - n.y)
        assert got[n.ix, n.iy] == np.argmin(d2)
    assert len(got) == nodes.count()


def test_surface_of_few_or_flat_points(spark):
    line = cloud(spark, [(0, 0), (1, 1), (2, 2), (10, 10)], [1, 2, 3, 4])
    for method in ("cubic", "linear", "mean"):
        got = {(r.ix, r.iy): r.z for r in view.surface(line, 5, method=method).collect()}
        assert len(got) == 25 and (method == "mean" or got[0, 0] == 1 and got[4, 4] == 4)
    three = {(r.ix, r.iy): r.z for r in view.surface(cloud(spark, [(0, 0), (4, 0), (0, 4), (0, 0)], [0, 4, 8, 99]), 5, method="linear").collect()}
    assert abs(three[1, 1] - 3) < 1e-6 and three[4, 4] in (4, 8)  # the first point of a place counts
    odd = line.unionByName(line.selectExpr("vertex_idx + 4 AS vertex_idx", "x", "y", "double('nan') AS z"))
    assert view.surface(odd.where("NOT isnan(z)"), 5).count() == 25
    with pytest.raises(ValueError):
        view.surface(line, 5, method="spline")


def test_surface_cap(spark, scattered):
    df = cloud(spark, scattered, FORMS["plane"](*scattered.T))
    few = view.surface(df, 12, cfg=Config(surface_points=400)).agg(F.max(F.abs(F.expr("z - (0.5 * x - 0.2 * y + 1)")))).first()[0]
    whole = view.surface(df, 12, cfg=Config(surface_points=10**6)).agg(F.max(F.abs(F.expr("z - (0.5 * x - 0.2 * y + 1)")))).first()[0]
    assert whole < few < 1  # the nodes outside of the sample's hull


def test_all_points_take_part(spark):
    """More points than Config.surface_points: no sample unless a cfg asks for one."""
    n = 520_000
    df = spark.range(n).selectExpr("id AS vertex_idx", "id % 1000 / 10D AS x", "id div 1000 / 10D AS y", "pmod(hash(id), 1000) / 1000D AS z")
    got = {(r.ix, r.iy): r.z for r in view.surface(df, 8, method="mean").collect()}
    x, y, z = (df.toPandas()[c].to_numpy() for c in "xyz")
    step = 99.9 / 8
    cx, cy = np.floor(x / step).astype(int), np.floor(y / step).astype(int)
    for n_ in view.lattice(df, 8).collect():
        i, j = int(np.floor(n_.x / step)), int(np.floor(n_.y / step))
        cells = [(cx == a) & (cy == b) for a in (i - 1, i, i + 1) for b in (j - 1, j, j + 1)]
        w = [c.sum() / ((x[c].mean() - n_.x) ** 2 + (y[c].mean() - n_.y) ** 2 + 1e-12) for c in cells if c.any()]
        assert abs(got[n_.ix, n_.iy] - np.average([z[c].mean() for c in cells if c.any()], weights=w)) < 1e-9


def test_far_circles(spark):
    """Nodes on a border whose neighbours there lie far apart: the height between these two, whatever the points of the tile are."""
    rng = np.random.default_rng(8)
    inner = np.column_stack([rng.uniform(0, 10, 3000), rng.uniform(0.001, 5, 3000)])
    border = np.array([[0, 0], [1, 0], *[[9 + k / 10, 0] for k in range(11)], [0, 5], [10, 5]])
    xy = np.concatenate([inner, border])
    z = np.concatenate([rng.uniform(-1, 1, 3000), border[:, 0]])
    nodes = spark.createDataFrame([(i, 0, 1.5 + i, 0.0) for i in range(8)], "ix long, iy long, x double, y double")
    got = {r.ix: r.z for r in surface.triangulated(nodes, surface.sites(cloud(spark, xy, z).repartition(3)), "linear").collect()}
    assert len(got) == 8 and all(abs(got[i] - (1.5 + i)) < 1e-9 for i in range(8))


def test_indexed_cloud_is_not_shuffled_for_its_places(spark):
    """What needs no vertex_idx (extents, cells) leaves the rows of an indexed cloud where they are, even where no join is broadcast by size."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = fixture.points(spark, "/root/testdata/sf0.001", indexed=True).groupBy(F.floor("x").alias("cx")).agg(F.avg("z"))
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "SortMergeJoin" not in plan and "row_number" not in plan and len(df.collect()) > 10
