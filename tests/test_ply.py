"""The PLY source: pruning by zone maps, bounded batches, samples without lists, folders, progress."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from plumbline.operators import view
from plumbline.sources import ply


@pytest.fixture(scope="module")
def strip(tmp_path_factory):
    """20,000 vertices along x, in one file."""
    rng = np.random.default_rng(1)
    n = 20_000
    cols = {"x": np.sort(rng.uniform(0, 20, n)).astype("f4"), "y": rng.uniform(0, 5, n).astype("f4"), "z": np.linspace(-1, 1, n).astype("f4"), "scalar_Intensity": rng.uniform(0, 9, n).astype("f4")}
    path = tmp_path_factory.mktemp("ply") / "strip.ply"
    path.write_bytes(ply.ply_bytes(cols))
    return str(path), cols


def ranges(df):
    return df.rdd.getNumPartitions()


def test_zones_prune(spark, strip):
    path, cols = strip
    read = lambda: ply.read_ply(spark, path, chunk_size="1000")
    box = lambda df: view.z_band(view.roi(df, (5.0, 7.0), (0.0, 5.0)), -1, 1)
    want = sorted(tuple(r) for r in box(read()).collect())
    assert len(want) == ((cols["x"] >= 5) & (cols["x"] <= 7)).sum()
    assert ranges(box(read())) == 20  # no zone map, no pruning
    ply.write_zones(spark, path, every=500)
    assert sorted(tuple(r) for r in box(read()).collect()) == want
    assert ranges(box(read())) <= 4
    assert ranges(view.z_band(read(), 0.9, 2)) <= 2 and view.z_band(read(), 0.9, 2).count() == (cols["z"] >= np.float32(0.9)).sum()
    assert ranges(read().where("intensity > 100")) == 1 and read().where("intensity > 100").count() == 0
    assert ranges(read().where("x > 19 OR y > 1")) == 20  # not a bound on one column
    assert ranges(read().where("vertex_idx BETWEEN 2500 AND 3500")) == 2 and read().where("vertex_idx BETWEEN 2500 AND 3500").count() == 1001
    assert read().where("vertex_idx IN (3, 19999) AND x >= 0").count() == 2
    assert read().where("vertex_idx = 70000").count() == 0


def test_old_zones_are_not_used(spark, tmp_path):
    path = str(tmp_path / "a.ply")
    made = lambda n, top: (tmp_path / "a.ply").write_bytes(ply.ply_bytes({c: np.linspace(0, top, n).astype("f4") for c in "xyz"}))
    made(100, 1)
    ply.write_zones(spark, path, every=10)
    made(200, 50)
    assert ply.read_ply(spark, path, chunk_size="20").where("x > 40").count() == 40


def test_columns_and_batches(spark, strip):
    path, cols = strip
    few = ply.read_ply(spark, path, ["x", "intensity"], chunk_size="100000000", batch_bytes="4096")
    assert few.columns == ["x", "intensity"] and ranges(few) == 1
    assert np.allclose(np.sort(few.toPandas()["intensity"]), np.sort(cols["scalar_Intensity"]))
    reader = ply._Reader({"path": path, "batch_bytes": "4096", "chunk_size": "100000000"}, ["x", "z"])
    sizes = [b.nbytes for b in reader.read(reader.partitions()[0])]
    assert len(sizes) == -(-20_000 // (4096 // 16)) and max(sizes) <= 4096


def test_samples(spark, strip):
    path, _ = strip
    got = ply.read_ply(spark, path, chunk_size="700", max_points="5000", seed="3")
    ids = [r[0] for r in got.select("vertex_idx").collect()]
    assert len(set(ids)) == len(ids) == 5000 and sorted(ids) == sorted(r[0] for r in got.select("vertex_idx").collect())
    assert ply.read_ply(spark, path, chunk_size="700", max_points="5000", seed="4").select("vertex_idx").intersect(got.select("vertex_idx")).count() < 1600
    reader = ply._Reader({"path": path, "chunk_size": "700", "max_points": "5000"}, ["x"])
    assert all(isinstance(r.own, int) for r in reader.partitions()) and sum(r.own for r in reader.partitions()) == 5000
    # Whatever the ranges and batches, each vertex is as likely: chi-square over 20 bands of 300 draws, 99.9 % limit of 19 degrees.
    for chunk, batch in (("20000", "8000000"), ("900", "2000"), ("6000", "4096")):
        n = np.zeros(20)
        for seed in range(30):
            r = ply._Reader({"path": path, "chunk_size": chunk, "batch_bytes": batch, "max_points": "400", "seed": str(seed)}, ["vertex_idx"])
            for part in r.partitions():
                for b in r.read(part):
                    n += np.bincount(b.column(0).to_numpy() // 1000, minlength=20)
        assert n.sum() == 30 * 400 and ((n - 600) ** 2 / 600).sum() < 43.8
    big = ply.split_sample(np.array([10**12, 10**6, 3 * 10**12]), 10**7, np.random.default_rng(0))
    assert big.sum() == 10**7 and abs(big[0] - 2.5 * 10**6) < 10_000 and big[1] < 50


def test_folder_round_trip(spark, tmp_path):
    rows = spark.range(5000).selectExpr("id AS vertex_idx", "id / 7D AS x", "sin(id) AS y", "cos(id) AS z", "(id % 11) / 10D AS r", "0.5D AS g", "1D AS b", "id * 0.25D AS intensity")
    folder = f"{tmp_path}/cloud"
    ply.write_ply(rows, folder, files=4)
    got = ply.read_ply(spark, folder, chunk_size="600")
    assert len(ply.ply_files(folder)) > 1 and got.count() == 5000
    want = rows.selectExpr("vertex_idx", *(f"cast(cast({c} AS float) AS double) AS {c}" for c in "xyz"), *(f"cast({c} * 255 AS int) / 255D AS {c}" for c in "rgb"), "intensity")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    ply.write_zones(spark, folder, every=100)
    assert ranges(ply.read_ply(spark, folder, chunk_size="100").where("x >= 700")) <= 2 < 50
    assert ply.read_ply(spark, folder, max_points="77").count() == 77
    with pytest.raises(AnalysisException, match="no property"):
        spark.read.format("ply").options(path=folder, columns="x,nothing").load()


LONG_FILE = """
import resource, sys, time
import pyarrow as pa
from pyspark.sql import SparkSession
from plumbline.sources import ply

spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()

def peak(batches):
    list(batches)
    time.sleep(1)
    yield pa.RecordBatch.from_pydict({"kb": [resource.getrusage(resource.RUSAGE_SELF).ru_maxrss]})

def most():
    return max(r[0] for r in spark.range(2, numPartitions=2).mapInArrow(peak, "kb long").collect())

cloud = lambda n: spark.range(n).selectExpr("id AS vertex_idx", "id / 7D AS x", "id / 5D AS y", "id / 3D AS z", "id / 2D AS intensity")
ply.write_ply(cloud(1000), sys.argv[1] + "/short", files=1)
before = most()
ply.write_ply(cloud(4_000_000), sys.argv[1] + "/long", files=1)
print(before, most(), ply.read_header(ply.ply_files(sys.argv[1] + "/long")[0])["count"])
"""


def test_writer_memory_is_bounded(tmp_path):
    """A file of 64 MB takes the task that writes it less than that: rows aren't held until its end."""
    got = subprocess.run([sys.executable, "-c", LONG_FILE, str(tmp_path)], cwd=Path(__file__).parents[1], capture_output=True, text=True, timeout=300)
    before, after, n = map(int, got.stdout.split())
    assert n == 4_000_000 and after - before < 40_000


def test_progress(spark, strip):
    path, _ = strip
    seen = []
    slow = F.udf(lambda v: __import__("time").sleep(0.001) or v, "double")
    rows = ply.with_progress(spark, lambda: ply.read_ply(spark, path, chunk_size="500").where("vertex_idx % 10 = 0").select(slow("x")).collect(), lambda share, left: seen.append((share, left)), every=0.05)
    shares = [s for s, _ in seen]
    assert len(rows) == 2000 and shares == sorted(shares) and seen[-1] == (1.0, 0.0) and len({s for s in shares if 0 < s < 1}) > 1
