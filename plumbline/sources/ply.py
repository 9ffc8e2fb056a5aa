"""Binary PLY files as a batch source, and their writer.

Headers are read on the driver; ranges of vertices are the input partitions, each read in batches
of bounded size. Filters on coordinates, intensity and vertex numbers leave out ranges that a zone map
(a small file beside the cloud) shows to hold no such vertex. A sampled read draws on the driver how many vertices each range
gives, and in each task which ones.
"""

from __future__ import annotations

import json
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Scalar names of the format, their layouts and Spark types.
SCALARS = {
    "double": ("<f8", "double"), "float64": ("<f8", "double"),
    "float": ("<f4", "float"), "float32": ("<f4", "float"),
    "uchar": ("u1", "short"), "uint8": ("u1", "short"),
    "char": ("i1", "byte"), "int8": ("i1", "byte"),
    "ushort": ("<u2", "int"), "uint16": ("<u2", "int"),
    "short": ("<i2", "short"), "int16": ("<i2", "short"),
    "uint": ("<u4", "long"), "uint32": ("<u4", "long"),
    "int": ("<i4", "int"), "int32": ("<i4", "int"),
}
_ARROW = {"double": pa.float64(), "float": pa.float32(), "short": pa.int16(), "byte": pa.int8(), "int": pa.int32(), "long": pa.int64()}


#: Columns that a zone map has the range of.
ZONED = ("x", "y", "z", "scalar_Intensity")


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _open(path: str):
    f, p = _filesystem(path)
    return f.open_input_file(p)


def ply_files(path: str) -> list[str]:
    """The file itself, or the *.ply files of a folder, by name; FileNotFoundError if there are none."""
    from pyarrow import fs

    f, p = _filesystem(path)
    if f.get_file_info(p).type != fs.FileType.Directory:
        return [path]
    found = sorted(x.base_name for x in f.get_file_info(fs.FileSelector(p)) if x.base_name.endswith(".ply"))
    if not found:
        raise FileNotFoundError(f"no *.ply files in {path}")
    return [f"{path.rstrip('/')}/{x}" for x in found]


def read_header(path: str) -> dict:
    """count, properties [(name, type)], start, width; ValueError for what isn't a binary little-endian PLY file."""
    with _open(path) as f:
        size = f.size()
        raw = f.read_at(min(size, 1 << 16), 0)
    end = raw.find(b"end_header\n")
    if not raw.startswith(b"ply") or end < 0:
        raise ValueError(f"{path}: no PLY header with an end_header line")
    lines = [x.split() for x in raw[:end].decode("ascii").splitlines()]
    if ["format", "binary_little_endian"] not in [x[:2] for x in lines]:
        raise ValueError(f"{path}: only the binary_little_endian format is read")
    count, properties, element = 0, [], None
    for x in lines:
        if x[:1] == ["element"]:
            if element is None and x[1] != "vertex":
                raise ValueError(f"{path}: the vertex element must come first")
            element = x[1]
            if element == "vertex":
                count = int(x[2])
        elif x[:1] == ["property"] and element == "vertex":
            if x[1] not in SCALARS:
                raise ValueError(f"{path}: property {x[-1]} has the unknown type {x[1]}")
            properties.append((x[2], x[1]))
    if missing := {"x", "y", "z"} - {n for n, _ in properties}:
        raise ValueError(f"{path}: no property {sorted(missing)}")
    width = sum(np.dtype(SCALARS[t][0]).itemsize for _, t in properties)
    start = end + len(b"end_header\n")
    if start + count * width > size:
        raise ValueError(f"{path}: cut short, {count} vertices of {width} bytes don't fit")
    return {"count": count, "properties": properties, "start": start, "width": width}


def sampled_numbers(n: int, k: int, seed: int) -> np.ndarray:
    """k different numbers under n, ascending, each set of them as likely: memory is in proportion to k, never to n."""
    rng, own = np.random.default_rng(seed), np.zeros(0, np.int64)
    most = min(k, n - k)  # the fewer of those taken and those left out are drawn
    while len(own) < most:
        own = np.unique(np.append(own, rng.integers(0, n, most - len(own) + most // 16 + 16)))
    own = np.sort(rng.permutation(own)[:most])
    return own if most == k else np.setdiff1d(np.arange(n), own, assume_unique=True)


def split_sample(sizes: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """How many of k vertices, drawn without replacement, fall into each range: multivariate hypergeometric, one range after the other.

    Beyond 10**9 vertices, where the generator ends, a range's number is drawn from the normal distribution of the same mean and variance.
    """
    out, left = np.zeros(len(sizes), np.int64), int(sizes.sum())
    for i, size in enumerate(sizes.tolist()):
        rest = left - size
        if left < 10**9:
            n = int(rng.hypergeometric(size, rest, k)) if k else 0
        else:
            mean = k * size / left
            n = round(rng.normal(mean, (mean * (rest / left) * ((left - k) / max(left - 1, 1))) ** 0.5))
        out[i] = n = min(max(n, 0, k - rest), size, k)
        k, left = k - n, rest
    return out


class _Range(InputPartition):
    """Vertices first to end of a file, numbered from base on; own: how many of them a sample takes (None: all)."""

    def __init__(self, path: str, base: int, first: int, end: int, own: int | None = None):
        self.path, self.base, self.first, self.end, self.own = path, base, first, end, own


class PlySource(DataSource):
    """format("ply"): option path (a file, or a folder of files with the same properties), chunk_size (vertices a partition), batch_bytes,
    columns (names, by commas; all by default), max_points and seed for an exact-size sample."""

    @classmethod
    def name(cls):
        return "ply"

    def schema(self):
        own = read_header(ply_files(self.options["path"])[0])["properties"]
        given = self.options.get("columns")
        if given is not None and (odd := set(given.split(",")) - {"vertex_idx", *(n for n, _ in own)}):
            raise ValueError(f"no property {sorted(odd)}")
        return ", ".join(f"`{n}` {t}" for n, t in [("vertex_idx", "long"), *((n, SCALARS[t][1]) for n, t in own)] if given is None or n in given.split(","))

    def reader(self, schema):
        return _Reader(self.options, [f.name for f in schema])


class _Reader(DataSourceReader):
    def __init__(self, options, names):
        self.files, self.names = ply_files(options["path"]), names
        self.chunk, self.batch = int(options.get("chunk_size", 1_000_000)), int(options.get("batch_bytes", 8 << 20))
        self.most, self.seed = int(options.get("max_points", 0)), int(options.get("seed", 42))
        self.heads = {p: read_header(p) for p in self.files}
        if any(h["properties"] != self.heads[self.files[0]]["properties"] for h in self.heads.values()):
            raise ValueError("the files have different properties")
        self.bounds: dict[str, tuple[float, float]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Notes the bounds that filters set; Spark applies all of them to the rows as well."""
        for f in filters:
            value = None if not hasattr(f, "value") else f.value
            if isinstance(value, (tuple, list)) and isinstance(f, In) and value:
                low, high = min(value), max(value)
            elif isinstance(f, EqualTo):
                low = high = value
            else:
                low = value if isinstance(f, (GreaterThan, GreaterThanOrEqual)) else None
                high = value if isinstance(f, (LessThan, LessThanOrEqual)) else None
            a, b = self.bounds.get(f.attribute[0], (-np.inf, np.inf))
            self.bounds[f.attribute[0]] = (a if low is None else max(a, low), b if high is None else min(b, high))
            yield f

    def _zones(self, path: str) -> dict | None:
        """The zone map of a file, if there is one that fits it."""
        from pyarrow import fs

        f, p = _filesystem(path)
        if f.get_file_info(f"{p}.zones").type != fs.FileType.File:
            return None
        with f.open_input_file(f"{p}.zones") as g:
            zones = json.loads(g.read())
        return zones if zones["count"] == self.heads[path]["count"] and zones["size"] == f.get_file_info(p).size else None

    def partitions(self):
        base, out = 0, []
        for path in self.files:
            n = self.heads[path]["count"]
            out += [_Range(path, base, a, min(a + self.chunk, n)) for a in range(0, n, self.chunk)]
            base += n
        if 0 < self.most < base:
            for r, own in zip(out, split_sample(np.array([r.end - r.first for r in out]), self.most, np.random.default_rng(self.seed)).tolist(), strict=True):
                r.own = own
            out = [r for r in out if r.own]
        low, high = self.bounds.get("vertex_idx", (-np.inf, np.inf))
        out = [r for r in out if r.base + r.end > low and r.base + r.first <= high]
        if self.bounds.keys() & set(ZONED):
            out = [r for p, zones in ((p, self._zones(p)) for p in self.files) for r in out if r.path == p and (zones is None or self._meets(r, zones))]
        return out or [_Range(self.files[0], 0, 0, 0)]

    def _meets(self, r: _Range, zones: dict) -> bool:
        """Whether a zone that overlaps the range meets all bounds."""
        every = zones["every"]
        held = range(r.first // every, -(-r.end // every))
        return any(all(c not in self.bounds or lo is not None and hi >= self.bounds[c][0] and lo <= self.bounds[c][1] for c, (lo, hi) in zones["zones"][i].items()) for i in held)

    def read(self, part):
        h = self.heads[part.path]
        kinds = dict(h["properties"])
        layout = np.dtype([(n, SCALARS[t][0]) for n, t in h["properties"]])
        step = max(1, self.batch // h["width"])
        starts = np.arange(part.first, part.end, step)
        ends = np.minimum(starts + step, part.end)
        rng = np.random.default_rng([self.seed, part.base, part.first])
        takes = [None] * len(starts) if part.own is None else split_sample(ends - starts, part.own, rng).tolist()
        with _open(part.path) as f:
            for a, b, own in zip(starts.tolist(), ends.tolist(), takes, strict=True):
                if own == 0:
                    continue
                rows = np.frombuffer(f.read_at((b - a) * h["width"], h["start"] + a * h["width"]), layout)
                index = np.arange(part.base + a, part.base + b)
                if own is not None:
                    at = sampled_numbers(b - a, own, int(rng.integers(1 << 62)))
                    rows, index = rows[at], index[at]
                columns = [pa.array(index, pa.int64()) if n == "vertex_idx" else pa.array(np.ascontiguousarray(rows[n])).cast(_ARROW[SCALARS[kinds[n]][1]]) for n in self.names]
                yield pa.RecordBatch.from_arrays(columns, self.names)


def register(spark):
    """Let the session read format("ply"), with filters handed down; read_ply() and write_zones() do so themselves."""
    from ..session import prepared

    prepared(spark).dataSource.register(PlySource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def write_zones(spark, path: str, every: int = 1_000_000) -> None:
    """Write the zone map of each file of path: the least and greatest x, y, z and intensity of each run of `every` vertices. One pass; a row a zone comes to the driver."""
    from pyspark.sql import functions as F

    register(spark)
    for file in ply_files(path):
        head = read_header(file)
        names = [n for n, _ in head["properties"] if n in ZONED]
        rows = spark.read.format("ply").options(path=file, columns=",".join(["vertex_idx", *names])).load()
        sound = lambda c: F.when(~F.isnan(c), F.col(c).cast("double"))
        got = rows.groupBy(F.expr(f"vertex_idx div {every}").alias("zone")).agg(*(f(sound(n)) for n in names for f in (F.min, F.max))).collect()
        zones = [{n: [None, None] for n in names}] * -(-head["count"] // every)
        for r in got:
            zones[r[0]] = {n: [r[1 + 2 * i], r[2 + 2 * i]] for i, n in enumerate(names)}
        fs, p = _filesystem(file)
        with fs.open_output_stream(f"{p}.zones") as f:
            f.write(json.dumps({"count": head["count"], "size": fs.get_file_info(p).size, "every": every, "zones": zones}).encode())


def read_ply(spark, path: str, columns: list[str] | None = None, **options):
    """Points of a file or a folder of files: vertex_idx, x, y, z; r, g, b in 0 to 1, intensity and classification where the files have them.

    columns: those of them to read. Filters reach the source and leave out ranges by number, and by zone maps where write_zones() made some.
    """
    from pyspark.sql import functions as F

    register(spark)
    own = [n for n, _ in read_header(ply_files(path)[0])["properties"]]
    made = {"vertex_idx": ("vertex_idx", lambda c: F.col(c)), **{c: (c, lambda c: F.col(c).cast("double")) for c in "xyz"}}
    if "red" in own:
        made |= {c[0]: (c, lambda c: F.col(c) / 255.0) for c in ("red", "green", "blue")}
    made |= {c.lower(): (f"scalar_{c}", lambda c: F.col(c).cast("double")) for c in ("Intensity", "Classification") if f"scalar_{c}" in own}
    if columns is not None:
        made = {c: made[c] for c in columns}
    df = spark.read.format("ply").options(path=path, columns=",".join(c for c, _ in made.values()), **options).load()
    return df.select(*(f(c).alias(name) for name, (c, f) in made.items()))


def observed(df, name: str = "points"):
    """(df, observation): once an action on df ran, observation.get["rows"] is the number of rows that it read."""
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def list_files(spark, folder: str):
    """path, length, size (readable) of the *.ply files of a folder, by name; FileNotFoundError if there are none."""
    from pyspark.sql import functions as F

    from ..functions.text import format_size

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ply").load(folder)
    if files.select("path").isEmpty():
        raise FileNotFoundError(f"no *.ply files in {folder}")
    return files.select("path", "length", format_size(F.col("length")).alias("size")).orderBy("path")


def ply_head(kinds: dict[str, np.dtype], count: int) -> bytes:
    """The header of a file with `count` vertices of these properties."""
    names = {np.dtype(v[0]): k for k, v in reversed(SCALARS.items())}
    head = ["ply", "format binary_little_endian 1.0", f"element vertex {count}"]
    head += [f"property {names[v]} {k}" for k, v in kinds.items()]
    return ("\n".join([*head, "end_header"]) + "\n").encode()


def ply_rows(columns: dict[str, np.ndarray]) -> bytes:
    """The vertices of columns, as they lie in a file."""
    return np.rec.fromarrays(list(columns.values()), names=list(columns)).tobytes()


def ply_bytes(columns: dict[str, np.ndarray]) -> bytes:
    """A whole file of columns such as x, y, z (float), red, green, blue (uchar)."""
    return ply_head({k: v.dtype for k, v in columns.items()}, len(next(iter(columns.values())))) + ply_rows(columns)


def write_ply(points, folder: str, files: int | None = None) -> None:
    """Write points (vertex_idx, x, y, z; r, g, b and intensity where there) as PLY files of float and uchar properties, in the order of vertex_idx.

    Each task (about `files` of them; by size if None) writes a file of its own, named so that the files' order is that of the vertices. As the header, which
    comes first, has their number, rows are spooled to the task's temp folder beyond 8 MB, and copied behind it; memory holds a batch of them.
    """
    from pyspark import TaskContext
    from pyspark.sql import functions as F

    from ..session import prepared

    prepared(points.sparkSession)
    cols = {c: F.col(c).cast("float") for c in "xyz"}
    if {"r", "g", "b"} <= set(points.columns):
        cols |= {n: F.expr(f"cast({n[0]} * 255 AS int)").cast("short") for n in ("red", "green", "blue")}
    if "intensity" in points.columns:
        cols["scalar_Intensity"] = F.col("intensity").cast("float")

    kinds = {c: np.dtype("<f4" if c in "xyz" or c.startswith("scalar") else "u1") for c in cols}

    def write(batches):
        n, block = 0, 8 << 20
        with tempfile.SpooledTemporaryFile(max_size=block) as body:
            for b in batches:
                if b.num_rows:
                    body.write(ply_rows({c: b.column(c).to_numpy(zero_copy_only=False).astype(k) for c, k in kinds.items()}))
                    n += b.num_rows
            if not n:
                return
            body.seek(0)
            fs, top = _filesystem(folder)
            fs.create_dir(top, recursive=True)
            name = f"{top}/part-{TaskContext.get().partitionId():06d}"
            with fs.open_output_stream(f"{name}.writing-{TaskContext.get().taskAttemptId()}") as f:
                f.write(ply_head(kinds, n))
                while part := body.read(block):
                    f.write(part)
            fs.move(f"{name}.writing-{TaskContext.get().taskAttemptId()}", f"{name}.ply")  # whole, whichever attempt comes last
        yield pa.RecordBatch.from_pydict({"n": [n]})

    points.repartitionByRange(*[files] * (files is not None), "vertex_idx").sortWithinPartitions("vertex_idx").select(*(e.alias(c) for c, e in cols.items())).mapInArrow(write, "n long").count()


def with_progress(spark, action: Callable, report: Callable[[float, float], None], every: float = 0.2):
    """action(), with report(share done, seconds left) called while its jobs run and once at its end; shares never fall.

    Tasks are counted, those of stages known so far; a later stage lengthens the estimate, not the share.
    """
    import threading
    import time
    import uuid

    sc, group, done, began = spark.sparkContext, f"progress-{uuid.uuid4().hex}", threading.Event(), time.monotonic()

    def watch():
        tracker, top = sc.statusTracker(), 0.0
        while not done.wait(every):
            stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in (tracker.getJobInfo(j) or _NO_JOB).stageIds]
            total, ended = (sum(getattr(s, k) for s in stages if s) for k in ("numTasks", "numCompletedTasks"))
            if total:
                top = max(top, ended / total)
                report(top, (time.monotonic() - began) * (1 / top - 1) if top else float("inf"))

    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        sc.setJobGroup(group, "with progress")
        out = action()
    finally:
        done.set()
        watcher.join()
        sc.setLocalProperty("spark.jobGroup.id", None)
    report(1.0, 0.0)
    return out


class _NO_JOB:
    stageIds = ()
