"""Exact Jaccard similarity join of word shingles in metric space: pivots, Voronoi regions, windows, recursion.

Jaccard distances of unrelated documents are all 1, so pivots can't tell those apart. A first
dealing therefore brings together only documents that share one of their rarest shingles
(a link must share one); each such region has a document as its first pivot. Where a
region has more open pairs than a task should compare, further documents become
pivots: each document belongs to the region of its nearest pivot, and those near a border,
by the triangle inequality, are replicated across it; regions are split again until
they are small, and compared exactly.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections import defaultdict
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import keyed, salted, shared_dir, table
from .units import _Index, chunks

WORDS = 5
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = np.random.default_rng(5).integers(1, 1 << 62, WORDS + 1, dtype=np.uint64) | np.uint64(1)


class Shingler:
    """Sorted distinct 64-bit hashes of each text's shingles; words keep their hashes in a bounded dictionary."""

    def __init__(self, most: int = 400_000):
        self.most, self.index, self.hash = most, _Index(), np.zeros(0, np.uint64)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.index) > self.most:
            self.index, self.hash = _Index(), np.zeros(0, np.uint64)
        get = self.index.__getitem__
        words = [np.fromiter(map(get, w), np.int64, len(w)) for w in (x.encode().translate(_LOWER).split() for x in texts)]
        if new := self.index.new:
            self.hash = np.append(self.hash, np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in new), "<u8"))
            self.index.new = []
        out = []
        for w in words:
            h, k = self.hash[w], min(len(w), WORDS)
            if k == 0:
                out.append(np.zeros(0, np.uint64))
                continue
            # A shorter text is one shingle, by its number of words another kind.
            s = sum((h[i : len(h) - k + 1 + i] * _ODD[i] for i in range(1, k)), h[: len(h) - k + 1] * _ODD[0]) + np.uint64(k) * _ODD[WORDS]
            s = (s ^ (s >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            out.append(np.unique(s ^ (s >> np.uint64(29))))
        return out


#: Links are at most this far apart (with room for rounding): similarity 0.75.
RADIUS = 0.25 + 1e-9
SALTS = 32


def _tag(keys: np.ndarray) -> bytes:
    """95 bits for a set: equal sets have equal tags. The last bit is set, so that no tag ends in a zero byte."""
    d = hashlib.blake2b(keys.tobytes(), digest_size=12).digest()
    return d[:11] + bytes([d[11] | 1])


def _often(sets: list[np.ndarray], share: float = 0.005, least: int = 3) -> list[dict]:
    """The shingles that at least this share of these sets have (and `least` of them), and how many do."""
    most = max(least, share * len(sets))
    keys = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    cell = (keys >> np.uint64(20)).astype(np.int64) & 0xFFFFF
    keys, n = np.unique(keys[np.bincount(cell, minlength=1)[cell] >= most], return_counts=True)
    return [{"key": k, "n": c} for k, c in zip(keys[n >= most].view(np.int64).tolist(), n[n >= most].tolist(), strict=True)]


def shingle_sets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, n (set size), tag of each row's whole text, row_col, and common: the frequent shingles of a batch, in its first row."""
    more = [row_col] if row_col else []
    kind = pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int64())]))

    def run(batches):
        sets = Shingler()
        for b in (c for b in batches for c in chunks(b, "text")):
            found = sets(b.column("text").to_pylist())
            tags = [_tag(x) for x in found]
            common = [_often(list(dict(zip(tags, found, strict=True)).values()))] + [None] * (len(found) - 1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) for x in found], pa.int64()), pa.array(tags, pa.binary()), *(b.column(c) for c in more), pa.array(common[: len(found)], kind)], ["doc_id", "n", "tag", *more, "common"])

    return _texts(df, id_col, text_col, *more).mapInArrow(run, ", ".join(["doc_id long", "n long", "tag binary", *(f"{c} long" for c in more), "common array<struct<key: long, n: long>>"]))


def frequent(rows: DataFrame, share: float = 0.0025) -> np.ndarray:
    """Of the landed shingle_sets(), the sorted shingles that more than this share of the rows is known to have.

    Their number is bounded by the mean size of a set over `share`, whatever the number of rows.
    They come last in every set's order and travel without names, so no task has to
    hold all documents that share one. The order changes no result.
    """
    most = max(1000.0, share * rows.count())
    keys = rows.select(F.explode("common").alias("c")).groupBy("c.key").agg(F.sum("c.n").alias("n")).where(F.col("n") > most).select("key").collect()
    return np.sort(np.array([r["key"] for r in keys], np.int64).view(np.uint64))


def _texts(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more)


def _blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _within(names: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places in the sorted names of those keys that are there."""
    at = np.minimum(np.searchsorted(names, keys), max(len(names) - 1, 0))
    return at[names[at] == keys] if len(names) else at[:0]


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that hold many shingles each reach Python, and Parquet's reader, so many at a time.
_FEW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.parquet.columnarReaderBatchSize": "500"}


@contextmanager
def _set(spark: SparkSession, conf: dict[str, str]):
    """Settings that hold meanwhile."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _landed(df: DataFrame, path: str, **conf: str) -> DataFrame:
    """df, written and read back; its shuffle files go as soon as it is written, not when the driver next collects garbage."""
    with _set(df.sparkSession, {_CLEANUP: "true", **conf}):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def landed(df: DataFrame, name: str) -> DataFrame:
    """As in _common, and the shuffle files of df are gone once it is written: steps take disk in turn, not all at once."""
    return _landed(df, shared_dir(df.sparkSession, name))


def _delete(spark: SparkSession, path: str) -> None:
    """Takes away a folder that shared_dir() named and nothing reads any more."""
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    to.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(to, True)


class _Spool:
    """Arrays by name, appended; beyond `most` bytes in all, what is held goes to files of a folder of its own."""

    def __init__(self, folder: str, most: int = 64 << 20):
        self.folder, self.most, self.size, self.held = folder, most, 0, defaultdict(list)

    def add(self, name: str, x: np.ndarray) -> None:
        self.held[name].append(x)
        self.size += x.nbytes
        if self.size > self.most:
            for k, v in self.held.items():
                with open(f"{self.folder}/{k}", "ab") as f:
                    f.writelines(map(np.ascontiguousarray, v))
            self.held, self.size = defaultdict(list), 0

    def get(self, name: str, kind: str) -> np.ndarray:
        path, held = f"{self.folder}/{name}", self.held.get(name, [])
        if not os.path.exists(path):
            return np.concatenate(held) if held else np.zeros(0, kind)
        if held:
            with open(path, "ab") as f:
                f.writelines(map(np.ascontiguousarray, self.held.pop(name)))
        return np.asarray(np.memmap(path, kind, "r"))


def shared_sets(texts: DataFrame, parts: int, common: np.ndarray, wide: int = 64, held: int = 64 << 20, rounds: int = 2) -> DataFrame:
    """tag, n, keys, prefix of each distinct set that may have a link, landed.

    Shingles go to `parts` parts by hash; a part counts the distinct sets of each
    and sends those of two or more back to the sets' buckets. Both ways they travel packed, a tag with
    several shingles: up to `wide` tasks hold several parts each, which they deal out among themselves
    (in files, beyond `held` bytes), so that a tag has as many shingles to travel with however many
    parts there are. Common ones go to the buckets at once. Shingles take turns, by hash, in `rounds` rounds that
    each read the texts anew: on disk is one round's share of all shingles, and of earlier ones what is sent
    back, not all of both. A set with fewer than three quarters of its shingles shared has no link. prefix: the rarest shared shingles, one more than a link could miss.
    """
    wide = min(parts, wide)

    def packed_rows(part, who, keys, tags, n):
        """Of postings (tag number who, key), the places and (part, tags, n, many, keys) of each part."""
        order = np.lexsort((who, part))
        keys, who, part = keys[order], who[order], part[order]
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))[: len(part)]
        for i, j in zip(first, np.append(first[1:], len(part)), strict=True):
            head = np.flatnonzero(np.append(True, who[i + 1 : j] != who[i : j - 1]))
            own = who[i:j][head]
            yield order[i:j], (int(part[i]), _blob(tags[own]), _blob(n[own].astype("<u4")), _blob(np.diff(np.append(head, j - i)).astype("<u4")), _blob(keys[i:j]))

    def bucket(tags):
        return (tags.view("u1").reshape(-1, 12)[:, :8].copy().view("<u8").ravel() % np.uint64(parts)).astype(np.int64)

    def part_of(keys):
        return ((keys >> np.uint64(20)) % np.uint64(parts)).astype(np.int32)

    def scatter(batches, turn):
        sets = Shingler()
        for b in (c for b in batches for c in chunks(b, "text")):
            by_tag = {_tag(x): x for x in sets(b.column("text").to_pylist()) if len(x)}
            if not by_tag:
                continue
            tags, n = np.array(list(by_tag), "S12"), np.array([len(x) for x in by_tag.values()], np.int64)
            keys, who = np.concatenate(list(by_tag.values())), np.repeat(np.arange(len(n)), n)
            now = keys % np.uint64(rounds) == turn
            keys, who = keys[now], who[now]
            if not len(keys):
                continue
            part = part_of(keys) % wide
            if len(common):
                often = common[np.minimum(np.searchsorted(common, keys), len(common) - 1)] == keys
                part[often] = wide + bucket(tags)[who[often]]
            rows = [r for _, r in packed_rows(part, who, keys, tags, n)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], ["part", "tags", "n", "many", "keys"])

    def unpack(rows):
        """The distinct tags of packed rows; flat tag numbers, n, keys."""
        tags, n, many, keys = (np.concatenate([np.frombuffer(r[k], t) for r in rows]) for k, t in ((0, "S12"), (1, "<u4"), (2, "<u4"), (3, "<u8")))
        names, codes = np.unique(tags, return_inverse=True)
        return names, np.repeat(codes.astype(np.int32), many), np.repeat(n, many).astype(np.int32), keys

    def grouped(batches, columns):
        """Rows of a stream sorted by its first column, by that column."""
        rows, last = [], None
        for b in batches:
            for k, *r in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
                if rows and k != last:
                    yield last, rows
                    rows = []
                rows.append(r)
                last = k
        if rows:
            yield last, rows

    counts = pa.schema([("bucket", pa.int64()), *((c, pa.binary()) for c in ("tags", "n", "many", "keys", "df"))])

    def shared(who, keys, tags, n):
        """Of a part's postings (tag number who, key), those of two or more distinct tags: distinct tags, their n; flat tag numbers, keys and numbers of tags."""
        order = np.argsort(keys)
        who, keys = who[order], keys[order]
        same = keys[1:] == keys[:-1]
        more = np.append(False, same) | np.append(same, False)
        own, who, keys = *np.unique(who[more], return_inverse=True), keys[more]
        names, first, codes = np.unique(tags[own], return_index=True, return_inverse=True)
        who = codes.astype(np.int32)[who]
        order = np.lexsort((who, keys))
        who, keys = who[order], keys[order]
        new = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
        once = new | np.append(True, who[1:] != who[:-1])[: len(keys)]  # copies of a set count once
        who, keys, new = who[once], keys[once], new[once]
        size = np.diff(np.append(np.flatnonzero(new), len(keys)))
        size = np.repeat(np.minimum(size, 2**32 - 2).astype("<u4"), size)
        return names, n[own][first], who[size > 1], keys[size > 1], size[size > 1]

    def back(found):
        """Rows to the buckets, of the shared() postings of some parts."""
        at = np.cumsum([0, *(len(f[0]) for f in found)])
        names, first, codes = np.unique(np.concatenate([f[0] for f in found]), return_index=True, return_inverse=True)
        n, keys, size = (np.concatenate([f[i] for f in found]) for i in (1, 3, 4))
        who = codes.astype(np.int32)[np.concatenate([f[2] + np.int32(a) for f, a in zip(found, at, strict=False)])]
        out = [(*r, _blob(size[at])) for at, r in packed_rows(bucket(names)[who], who, keys, names, n[first])]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), counts.types, strict=True)], schema=counts)

    def count(batches):
        with tempfile.TemporaryDirectory() as folder:
            spool, tagged, seen = _Spool(folder, held), 0, set()
            for b in batches:
                for part, tags, n, many, keys in zip(*(b.column(c).to_pylist() for c in ("part", "tags", "n", "many", "keys")), strict=True):
                    if part >= wide:
                        row = (part - wide, tags, n, many, keys, _blob(np.full(len(keys) // 8, 2**32 - 1, "<u4")))
                        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, counts.types, strict=True)], schema=counts)
                        continue
                    tags, n, many, keys = (np.frombuffer(x, t) for x, t in ((tags, "S12"), (n, "<u4"), (many, "<u4"), (keys, "<u8")))
                    who, part = np.repeat(np.arange(tagged, tagged + len(tags), dtype=np.uint32), many), part_of(keys)
                    tagged += len(tags)
                    spool.add("tags", tags)
                    spool.add("n", n)
                    order = np.argsort(part, kind="stable")
                    for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                        seen.add(p := int(part[own[0]]))
                        spool.add(f"keys-{p}", keys[own])
                        spool.add(f"who-{p}", who[own])
            tags, n, found, size = spool.get("tags", "S12"), spool.get("n", "<u4"), [], 0
            for p in sorted(seen):
                found.append(shared(spool.get(f"who-{p}", "<u4"), spool.get(f"keys-{p}", "<u8"), tags, n))
                size += len(found[-1][2])
                if size >= 1_000_000:
                    yield back(found)
                    found, size = [], 0
            if size:
                yield back(found)

    schema = pa.schema([("tag", pa.binary()), ("n", pa.int64()), ("keys", pa.list_(pa.int64())), ("prefix", pa.list_(pa.int64()))])

    def gather(batches):
        for _, rows in grouped(batches, ["bucket", "tags", "n", "many", "keys", "df"]):
            df = np.concatenate([np.frombuffer(r[4], "<u4") for r in rows])
            names, who, n, keys = unpack(rows)
            order = np.lexsort((keys, df, who))
            who, n, keys = who[order], n[order], keys[order]
            once = np.append(True, (who[1:] != who[:-1]) | (keys[1:] != keys[:-1]))  # a common one comes with each copy
            who, n, keys = who[once], n[once], keys[once]
            first = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
            out = []
            for i, j in zip(first, np.append(first[1:], len(who)), strict=True):
                need = (3 * int(n[i]) + 3) // 4
                if j - i >= need:
                    out.append((names[who[i]], int(n[i]), np.sort(keys[i:j]).view(np.int64), keys[i : j - need + 1].view(np.int64)))
                if len(out) >= 2000 or (out and j == len(who)):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                    out = []

    spark, back_at = texts.sparkSession, shared_dir(texts.sparkSession, "shared")
    for turn in range(rounds):
        packed = texts.mapInArrow(lambda batches, turn=turn: scatter(batches, turn), "part int, tags binary, n binary, many binary, keys binary")
        _landed(packed.repartitionById(wide, "part").mapInArrow(count, "bucket long, tags binary, n binary, many binary, keys binary, df binary"), f"{back_at}/turn={turn}", **_FEW)
    counted = spark.read.parquet(back_at).drop("turn")
    sets = _landed(counted.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(gather, "tag binary, n long, keys array<long>, prefix array<long>"), shared_dir(spark, "sets"), **_FEW)
    _delete(spark, back_at)
    return sets


def _salt(col: str) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(SALTS))


def _streams(members: DataFrame, pivots: DataFrame, sets: DataFrame, parts: int, most: int) -> DataFrame:
    """Rows grp, turn, p, b, n, keys in streams of about `most` members: of each, the pivots of a group (turn 0, numbered p), then members (turn 1).

    members: grp, b. pivots: grp, p, a. A group of any size is dealt into as many streams as it needs.
    """
    members = members.withColumn("_s", _salt("b"))
    sizes = salted(members.select("grp", "_s"), ["grp"], "_s", {"_n": (F.count("*"), F.sum("_n"))}).withColumn("salts", F.expr(f"cast(ceil(_n / {float(most)}D) AS bigint)"))
    named = sets.select("tag", "n", "keys")
    per_group = sizes.groupBy("grp").agg(F.max("salts").alias("salts"))
    heads = pivots.join(named, F.col("a") == F.col("tag")).join(per_group, "grp").select("grp", F.explode(F.expr("sequence(0L, salts - 1)")).alias("salt"), F.lit(0).alias("turn"), "p", F.col("a").alias("b"), "n", "keys")
    rows = members.join(sizes, ["grp", "_s"]).join(named, F.col("b") == F.col("tag")).select("grp", F.pmod(F.xxhash64("b", F.lit(7)), "salts").alias("salt"), F.lit(1).alias("turn"), F.lit(0).alias("p"), "b", "n", "keys")
    return heads.unionByName(rows).repartition(parts, "grp", "salt").sortWithinPartitions("grp", "salt", "turn", "p")


def _measured(streams: DataFrame) -> DataFrame:
    """grp, b, dists: for each member of a stream, (pivot, both, any) of each pivot: sizes of intersection and union."""
    kind = pa.list_(pa.struct([("pivot", pa.binary()), ("both", pa.int64()), ("any", pa.int64())]))

    def run(batches):
        pivots: list[tuple] = []
        names, rows, head = np.zeros(0, np.int64), np.zeros((0, 0), np.int32), False
        for x in batches:
            out = []
            for grp, turn, b, n, keys in zip(*(x.column(c) for c in ("grp", "turn", "b", "n", "keys")), strict=True):
                own, n = keys.values.to_numpy(), n.as_py()
                if turn.as_py() == 0:
                    pivots = [*(pivots if head else []), (b.as_py(), n, own)]
                    head = True
                    continue
                if head:
                    names = np.unique(np.concatenate([k for _, _, k in pivots]))
                    rows = np.zeros((len(pivots), len(names)), np.int32)
                    for i, (_, _, k) in enumerate(pivots):
                        rows[i, np.searchsorted(names, k)] = 1
                    head = False
                both = rows[:, _within(names, own)].sum(axis=1).tolist()
                out.append((grp.as_py(), b.as_py(), [{"pivot": p, "both": c, "any": m + n - c} for (p, m, _), c in zip(pivots, both, strict=True)]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.binary(), pa.binary(), kind))], ["grp", "b", "dists"])

    return streams.mapInArrow(run, "grp binary, b binary, dists array<struct<pivot: binary, both: long, any: long>>")


LINKED = "4 * both >= 3 * any"


def components(links: DataFrame, rounds: int = 60, local_edges: int = 200_000) -> DataFrame:
    """node, root: the least node that links (a, b) reach, for the nodes of links.

    Up to local_edges of them, counted first, are joined up within one task. More go through
    large-star and small-star steps in turn, each landed in the shared folder, until nothing
    changes; RuntimeError if that isn't within `rounds`. Both ways give the same rows.
    """
    node = links.schema["a"].dataType
    edges = landed(links.selectExpr("greatest(a, b) AS u", "least(a, b) AS v").where("u <> v").distinct(), "edges")
    if edges.count() <= local_edges:

        def join(batches):
            parent: dict = {}

            def find(x):
                while (p := parent.setdefault(x, x)) != x:
                    parent[x] = x = parent[p]
                return x

            for b in batches:
                for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
                    u, v = find(u), find(v)
                    parent[max(u, v)] = min(u, v)
            nodes = list(parent)
            kind = pa.binary() if nodes and isinstance(nodes[0], bytes) else pa.int64()
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([find(x) for x in nodes], kind)], ["node", "root"])

        return landed(edges.coalesce(1).mapInArrow(join, f"node {node.simpleString()}, root {node.simpleString()}"), "roots")
    state = None
    for _ in range(rounds):
        both = edges.unionByName(edges.selectExpr("v AS u", "u AS v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").selectExpr("v AS u", "m AS v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").selectExpr("v AS u", "m AS v").unionByName(low.selectExpr("u", "m AS v"))
        edges, last = landed(small.where("u <> v").distinct(), "edges"), state
        state = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if state == last:
            break
    else:
        raise RuntimeError(f"components aren't settled after {rounds} rounds")
    roots = edges.selectExpr("u AS node", "v AS root")
    return roots.unionByName(roots.selectExpr("root AS node", "root").distinct())


def _pruned(groups: DataFrame) -> DataFrame:
    """groups (tag, grp, home, open, d) without what can have no unknown link in its region, with m and n_open of what is left.

    d: distance to the region's pivot; open: not linked to it; home: the pivot is the nearest
    one. Two documents that are linked to the pivot are connected, and of two that aren't at
    home another region takes care. Links differ by at most the radius in d, so a document
    stays only if one that it needs is that near.
    """
    groups = groups.withColumn("_s", _salt("tag"))
    ends = {"low": ("open", F.min), "high": ("home", F.max)}
    spans = salted(groups, ["grp"], "_s", {k: (f(F.when(F.col(c), F.col("d"))), f(k)) for k, (c, f) in ends.items()})
    kept = groups.join(spans, ["grp", "_s"]).where(f"(open OR d >= low - {RADIUS!r}D) AND (home OR d <= high + {RADIUS!r}D)").drop("low", "high")
    kept = landed(kept, "regions")
    sizes = salted(kept, ["grp"], "_s", {"m": (F.count("*"), F.sum("m")), "n_open": (F.count_if("open"), F.sum("n_open"))})
    return kept.join(sizes.where("n_open > 0 AND m > 1"), ["grp", "_s"]).drop("_s")


def _split(groups: DataFrame, sets: DataFrame, parts: int, pivots: int, level: int) -> tuple[DataFrame, DataFrame]:
    """(regions, links): Voronoi regions of each group around `pivots` of its documents, with windows, and links to the pivots.

    A document is at home with its nearest pivot i. It also enters the region of j if
    d(x, j) - d(x, i) is at most twice the radius: a document linked to x may be at home there.
    No distance exceeds 1, so at half or more from the nearest pivot that says nothing: such
    documents have a region of their own, and enter that of j if d(x, j) is at most half and a radius.
    """
    h = F.xxhash64("tag", F.lit(level))
    chosen = groups.groupBy("grp", F.pmod(h, F.lit(pivots)).cast("int").alias("p")).agg(F.min(F.struct(h.alias("h"), "tag")).alias("x")).select("grp", "p", F.col("x.tag").alias("a"))
    every = _measured(_streams(groups.select("grp", F.col("tag").alias("b")), chosen, sets, parts, 500))
    near = "array_min(transform(dists, (x, i) -> struct(1 - x.both / cast(x.any AS double) AS d, i AS i)))"
    keep = f"filter(transform(dists, (x, i) -> struct(x.pivot AS pivot, x.both AS both, x.any AS any, i AS i, 1 - x.both / cast(x.any AS double) AS d)), x -> x.d <= least(near.d + {2 * RADIUS!r}D, {0.5 + RADIUS!r}D))"
    rows = landed(every.withColumn("near", F.expr(near)).select("grp", "b", "near", F.expr(keep).alias("cells")), "voronoi")
    cells = rows.select("grp", "b", "near", F.explode("cells").alias("x")).select("grp", "b", "near", "x.*")
    regions = cells.select(F.col("b").alias("tag"), F.expr("unhex(md5(concat(grp, pivot)))").alias("grp"), F.expr("i = near.i AND near.d < 0.5D").alias("home"), F.expr(f"NOT ({LINKED})").alias("open"), "d")
    outer = rows.where("near.d >= 0.5D").select(F.col("b").alias("tag"), F.expr("unhex(md5(concat(grp, cast('far' AS binary))))").alias("grp"), F.lit(True).alias("home"), F.lit(True).alias("open"), F.lit(1.0).alias("d"))
    return regions.unionByName(outer), cells.where(LINKED).where("b <> pivot").select(F.col("pivot").alias("a"), "b")


def _settled(groups: DataFrame, sets: DataFrame, parts: int, block: int = 400) -> DataFrame:
    """a, b: links that connect the documents of each region as all its links do, tile by tile.

    groups: as from _pruned(). The open documents of a region and all of it are dealt
    into blocks of about `block`; a tile holds two blocks, whatever the region's size.
    """
    rows = groups.withColumn("nb", F.expr(f"cast(ceil(m / {float(block)}D) AS int)")).withColumn("nz", F.expr(f"cast(ceil(n_open / {float(block)}D) AS int)"))
    h = F.xxhash64("tag", "grp")
    rows = rows.withColumn("j", F.pmod(h, F.col("nb").cast("long")).cast("int")).withColumn("i", F.pmod(h, F.col("nz").cast("long")).cast("int"))
    every = rows.select("tag", "grp", "d", "home", F.explode(F.sequence(F.lit(0), F.col("nz") - 1)).alias("i"), "j", F.lit(False).alias("side"))
    opened = rows.where("open").select("tag", "grp", "d", "home", "i", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("j"), F.lit(True).alias("side"))
    tiles = every.unionByName(opened).join(sets.select("tag", "n", "keys"), "tag").repartition(parts, "grp", "i", "j").sortWithinPartitions("grp", "i", "j")

    def tile(rows):
        """Of the links of open rows with the others, the ones that first connect two documents."""
        z, x = ([r for r in rows if r[2] is s] for s in (True, False))
        if not z or not x:
            return
        flat = np.concatenate([r[1] for r in x])
        names, ids = np.unique(flat, return_inverse=True)
        starts = np.cumsum([0, *(len(r[1]) for r in x)])[:-1]
        n, far, home = (np.array([r[k] for r in x]) for k in (3, 4, 5))
        tags = [r[0] for r in x]
        flag = np.zeros(len(names), np.int32)
        parent = {t: t for t in [*(r[0] for r in z), *tags]}

        def find(t):
            while parent[t] != t:
                parent[t] = t = parent[parent[t]]
            return t

        for tag, keys, _, size, d, at_home in z:
            may = np.abs(far - d) <= RADIUS
            if not at_home:
                may &= home
            if not may.any():
                continue
            at = _within(names, keys)
            flag[at] = 1
            both = np.add.reduceat(flag[ids], starts)
            flag[at] = 0
            for k in np.flatnonzero(may & (4 * both >= 3 * (size + n - both))):
                if (u := find(tag)) != (v := find(tags[k])):
                    parent[u] = v
                    yield tag, tags[k]

    def run(batches):
        rows, last = [], None

        def close():
            out = list(tile(rows))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.binary()) for i in (0, 1)], ["a", "b"])

        for b in batches:
            for g, i, j, tag, keys, side, n, d, home in zip(*(b.column(c) for c in ("grp", "i", "j", "tag", "keys", "side", "n", "d", "home")), strict=True):
                key = (g.as_py(), i.as_py(), j.as_py())
                if rows and key != last:
                    yield close()
                    rows = []
                rows.append((tag.as_py(), keys.values.to_numpy(), side.as_py(), n.as_py(), d.as_py(), home.as_py()))
                last = key
        if rows:
            yield close()

    return tiles.mapInArrow(run, "a binary, b binary")


def jaccard_links(texts: DataFrame, parts: int, common: np.ndarray, leaf: int = 4000, pivots: int = 16, levels: int = 3) -> DataFrame:
    """a, b: links between distinct sets (by tag) whose components are those of all links.

    A region is compared once it has at most leaf * leaf open pairs, and otherwise split
    around `pivots` documents, up to `levels` times; what is then still larger (documents that
    share a shingle, but are far from each other and from any pivot) is compared in tiles.
    """
    sets = shared_sets(texts, parts, common)
    members = sets.select("tag", F.explode("prefix").alias("key"), _salt("tag").alias("salt"))
    first = salted(members, ["key"], "salt", {"size": (F.count("*"), F.sum("size")), "pivot": (F.min("tag"), F.min("pivot"))}).where("size > 1")
    stars = landed(members.join(first, ["key", "salt"]).where("tag <> pivot").selectExpr("pivot AS grp", "tag AS b").distinct(), "stars")
    heads = stars.select("grp").distinct().select("grp", F.lit(0).alias("p"), F.col("grp").alias("a"))
    near = landed(_measured(_streams(stars, heads, sets, parts, 500)).select("grp", "b", F.expr("dists[0].both").alias("both"), F.expr("dists[0].any").alias("any")), "near")
    links = [near.where(LINKED).select(F.col("grp").alias("a"), "b")]
    groups = near.select(F.col("b").alias("tag"), "grp", F.lit(True).alias("home"), F.expr(f"NOT ({LINKED})").alias("open"), F.expr("1 - both / cast(any AS double)").alias("d"))
    small = []
    for level in range(levels + 1):
        groups = landed(_pruned(groups), "groups")
        large = F.col("m") * F.col("n_open") > leaf * leaf
        if level == levels or groups.where(large).isEmpty():
            small.append(groups)
            break
        small.append(groups.where(~large))
        groups, more = _split(groups.where(large).select("tag", "grp"), sets, parts, pivots, level)
        links.append(more)
    rest = small[0]
    for x in small[1:]:
        rest = rest.unionByName(x)
    links.append(_settled(rest, sets, parts))
    out = links[0]
    for x in links[1:]:
        out = out.unionByName(x)
    return out


def _rooted(rows: DataFrame, df: DataFrame, id_col: str, text_col: str, part_shingles: int, *aggs: Column, local_edges: int = 200_000, **split) -> DataFrame:
    """tag, root of its component, and aggs of its rows, for each distinct set of rows, the landed shingle_sets() of df."""
    total = rows.agg(F.sum("n")).first()[0] or 0
    links = jaccard_links(_texts(df, id_col, text_col), max(8, -(-total // part_shingles)), frequent(rows), **split)
    classes = rows.where("n > 0").groupBy("tag").agg(*aggs)
    roots = components(links, local_edges=local_edges)
    return classes.join(roots, F.col("tag") == F.col("node"), "left").withColumn("root", F.coalesce("root", "tag")).drop("node")


def _back(rows: DataFrame, classes: DataFrame, value: str) -> DataFrame:
    """rows with their class's value (null for rows without shingles): the classes meet their rows by tag and salt, so copies stay dealt out."""
    rows = rows.withColumn("_s", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)))
    held = rows.where("n > 0").select("tag", "_s").distinct().join(classes.select("tag", value), "tag")
    return rows.join(held, ["tag", "_s"], "left").drop("_s")


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_shingles: int = 2_500_000, **options) -> DataFrame:
    """doc_id, n_shingles, component_id of each row: components of links of similarity 0.75 or more.

    Defined cases: a null, empty or blank text has no shingles and is its own component;
    fewer than five words are one shingle; equal sets are one document with many rows; a
    null id takes the smallest id of its component, and counts for none; a repeated id gets a
    row each; an empty table gives no rows; other columns are ignored. Sets are named by 95
    bits of a digest and shingles by 64 bits.
    """
    docs = keyed(df)
    rows = landed(shingle_sets(docs, id_col, text_col, "_row"), "shingle-sets")
    classes = _rooted(rows, docs, id_col, text_col, part_shingles, F.min("doc_id").alias("first"), **options)
    least = classes.groupBy("root").agg(F.min("first").alias("component"))
    named = _back(rows.select("doc_id", "n", "tag", "_row"), classes.join(least, "root"), "component")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_shingles: int = 2_500_000, most_sent: int = 1_000_000) -> DataFrame:
    """df with one row of each component, one of the smallest id; columns as they were.

    Rows are told apart by keyed(): a row with a null id goes if its component has a row
    with an id, and of rows that have only null ids, or repeat the smallest id, one stays.
    Rows without shingles all stay. The names of up to `most_sent` rows that go, counted first, are sent to
    all tasks, so that texts aren't shuffled; more are joined.
    """
    docs = keyed(df)
    rows = landed(shingle_sets(docs, id_col, text_col, "_row"), "shingle-sets")
    # min_by passes over null ids: they count only where there is no other.
    one = F.coalesce(F.min_by("_row", "doc_id"), F.min("_row")).alias("one")
    classes = _rooted(rows, docs, id_col, text_col, part_shingles, F.min("doc_id").alias("first"), one)
    kept = classes.groupBy("root").agg(F.coalesce(F.min_by("one", "first"), F.min("one")).alias("kept"))
    named = _back(rows.select("tag", "n", "_row"), classes.join(kept, "root"), "kept")
    gone = landed(named.where("_row <> kept").select("_row"), "gone")
    if gone.count() <= most_sent:
        gone = F.broadcast(gone)
    return docs.join(gone, "_row", "left_anti").select(*df.columns)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: jaccard_components() of documents."""
    return jaccard_components(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, list_extract(l, 1) AS sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [[array_to_string(ws, ' ')]]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: [array_to_string(ws[i:i + 4], ' ')]) END) AS l
    FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS d, doc_id AS t FROM documents UNION SELECT r.d, u.b FROM r JOIN u ON r.t = u.a)
SELECT d.doc_id, coalesce(max(n.n), 0)::bigint AS n_shingles, min(r.t) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.d = d.doc_id GROUP BY d.doc_id
"""
