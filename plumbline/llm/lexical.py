"""Ranked lexical search: variable-block-max WAND over shards of documents.

A shard holds the posting lists of some documents. Each list is cut into blocks whose
boundaries dynamic programming chooses, and each block keeps its greatest impact. For an item, the
block maxima add up to a bound of every document; postings of blocks without a document whose
bound reaches the threshold are skipped, the others are scored exactly. Each shard is a file, which
tasks write and read themselves: only the names go through Spark, which would hold all shards of a task at once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import filesystem, landed, shared_dir, ship, table
from .units import chunks

#: Bytes of terms stay, A-Z in lower case; all others part terms.
_FOLD = bytes(b + 32 if 65 <= b < 91 else b if 48 <= b < 58 or 97 <= b < 123 or b > 127 else 32 for b in range(256))
#: What a shard's file holds, and what goes through Spark, before and after blocks are cut.
SHARD = {"doc_ids": pa.list_(pa.int64()), "lens": pa.binary(), "terms": pa.list_(pa.string()), "df": pa.list_(pa.int32()), "docs": pa.binary(), "tfs": pa.binary()}
BLOCKED = {"doc_ids": pa.list_(pa.int64()), "terms": pa.list_(pa.string()), "df": pa.list_(pa.int32()), **dict.fromkeys(("docs", "impacts", "n_blocks", "ends", "tops"), pa.binary())}



def terms_of(raw: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return raw.translate(_FOLD).split()


class _Numbers(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _saved(uri: str, kinds: dict, values: list) -> str:
    """The URI of a new file below uri with a row of these values. Each attempt of a task has files of its own."""
    import pyarrow.parquet as pq

    fs, top = filesystem(uri)
    fs.create_dir(top, recursive=True)
    name = f"{uuid.uuid4().hex}.parquet"
    row = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) if isinstance(x, pa.Array) else pa.array([x], t) for t, x in zip(kinds.values(), values, strict=True)]
    pq.write_table(pa.table(row, list(kinds)), f"{top}/{name}", filesystem=fs, compression="zstd", use_dictionary=False)
    return f"{uri}/{name}"


def _loaded(uri: str, *columns: str) -> dict:
    """Columns of such a file: lists as Arrow arrays, all else as buffers."""
    import pyarrow.parquet as pq

    fs, path = filesystem(uri)
    row = pq.read_table(path, filesystem=fs, columns=list(columns), partitioning=None)
    return {c: x.values if isinstance(x := row.column(c)[0], pa.ListScalar) else x.as_buffer() for c in columns}


def _dealt(index: DataFrame) -> DataFrame:
    return index.repartitionByRange(max(1, min(index.count(), 20_000)), "shard")


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 8 << 20) -> DataFrame:
    """shard, file, n_docs, n_terms of landed posting lists of all terms of all documents, a file a shard of about shard_bytes of text (one document at least).

    doc_ids and lens (terms of each) are by place; docs and tfs are the lists, one after the other, df long each.
    """
    uri = shared_dir(ship(docs.sparkSession), "lexical-shard-files")

    def row(k, keys, lens, flat, names):
        place = np.repeat(np.arange(len(lens)), lens)
        both, tf = np.unique(np.concatenate(flat).astype(np.int64) << 32 | place if flat else np.zeros(0, np.int64), return_counts=True)
        df = np.bincount(both >> 32, minlength=len(names))
        file = _saved(uri, SHARD, [keys, np.array(lens, "<u4").tobytes(), [x.decode() for x in names], df, (both & 0xFFFFFFFF).astype("<u4").tobytes(), tf.astype("<u4").tobytes()])
        return pa.RecordBatch.from_pydict({"shard": [k], "file": [file], "n_docs": [int(np.count_nonzero(lens))], "n_terms": [int(sum(lens))]})

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, made, size = TaskContext.get().partitionId() << 32, 0, 0
        keys, lens, flat, names = [], [], [], _Numbers()
        for b in (c for b in batches for c in chunks(b, "raw", shard_bytes // 4)):
            more = pc.sum(pc.binary_length(b.column("raw"))).as_py() or 0
            if keys and size + more > shard_bytes:
                yield row(top + made, keys, lens, flat, names)
                made, size, keys, lens, flat, names = made + 1, 0, [], [], [], _Numbers()
            found = [terms_of(x) for x in b.column("raw").to_pylist()]
            keys += b.column("doc_id").to_pylist()
            lens += map(len, found)
            flat.append(np.fromiter(map(names.__getitem__, chain.from_iterable(found)), np.uint32))
            size += more
        if keys:
            yield row(top + made, keys, lens, flat, names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("raw"))
    return landed(rows.mapInArrow(build, "shard long, file string, n_docs long, n_terms long"), "lexical-shards")


def block_ends(scores: np.ndarray, sizes: np.ndarray, cost: int = 1_000_000, longest: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(ends of blocks in `scores`, number of blocks of each list) of lists that lie end to end.

    Of all ways to cut a list into blocks of at most `longest`, the one with the least sum, over
    its blocks, of cost and of what the block's maximum is above each score. Exact; lists of like length go side by side.
    """
    starts = np.cumsum(sizes) - sizes
    back = np.ones(len(scores), np.int64)  # length of the last block of the best cut that ends here
    order = np.argsort(-sizes, kind="stable")
    order = order[: np.count_nonzero(sizes > 1)]
    slot = np.arange(longest)
    for g in range(0, len(order), 2048):
        lanes = order[g : g + 2048]
        n, at = sizes[lanes], starts[lanes]
        top, base = np.zeros((2, len(lanes), longest), np.int64)
        best, total = np.zeros((2, len(lanes)), np.int64)
        for i in range(int(n[0])):
            on = int(np.searchsorted(-n, -i))  # lists of more than i
            s = scores[at[:on] + i].astype(np.int64)
            k = i % longest
            top[:on, k], base[:on, k] = 0, best[:on] + total[:on]
            w = min(i + 1, longest)
            np.maximum(top[:on, :w], s[:, None], out=top[:on, :w])
            total[:on] += s
            length = (k - slot[:w]) % longest + 1
            value = base[:on, :w] + top[:on, :w] * length
            pick = np.argmin(value, axis=1)
            best[:on] = value[np.arange(on), pick] - total[:on] + cost
            back[at[:on] + i] = length[pick]
    ends, left = [], starts + sizes
    lanes = np.flatnonzero(sizes)
    while len(lanes):
        ends.append(left[lanes])
        left[lanes] -= back[left[lanes] - 1]
        lanes = lanes[left[lanes] > starts[lanes]]
    ends = np.sort(np.concatenate(ends)) if ends else np.zeros(0, np.int64)
    return ends, np.diff(np.searchsorted(ends, np.append(starts, len(scores)), "right"), prepend=0)[1:] if len(sizes) else np.zeros(0, np.int64)


def blocked(index: DataFrame) -> tuple[DataFrame, int]:
    """(shard, file of shards with impacts and blocks, landed; number of documents with a term). A posting's impact is its score at weight 1."""
    n, total = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    uri = shared_dir(index.sparkSession, "lexical-block-files")

    def cut(batches):
        for b in batches:
            for k, file in zip(b.column("shard").to_pylist(), b.column("file").to_pylist(), strict=True):
                x = _loaded(file, *SHARD)
                docs, tf, lens = (np.frombuffer(x[c], "<u4") for c in ("docs", "tfs", "lens"))
                m = 75 + 25 * lens.astype(np.int64) * n // max(total, 1)
                tf = tf.astype(np.int64)
                impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[docs])
                ends, count = block_ends(impact, x["df"].to_numpy().astype(np.int64))
                tops = np.maximum.reduceat(impact, np.append(0, ends[:-1])) if len(ends) else ends
                file = _saved(uri, BLOCKED, [x["doc_ids"], x["terms"], x["df"], x["docs"].to_pybytes(), *(v.astype("<u4").tobytes() for v in (impact, count, ends, tops))])
                yield pa.RecordBatch.from_pydict({"shard": [k], "file": [file]})

    return landed(_dealt(index).mapInArrow(cut, "shard long, file string"), "lexical-blocks"), n


def _sums(at: np.ndarray, value: np.ndarray, n: int, exact: bool) -> np.ndarray:
    """Sums of whole numbers by place; doubles hold them where `exact` says that all stay under 2**53."""
    if exact:
        return np.bincount(at, value, n).astype(np.int64)
    out = np.zeros(n, np.int64)
    np.add.at(out, at, value)
    return out


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = end - start
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


class Shard:
    """One shard, ready to search; skipped counts postings of blocks that a search passed over, of `seen` in all."""

    def __init__(self, x: dict):
        self.ids, self.terms = x["doc_ids"], x["terms"]
        self.docs, self.impacts, ends, tops, count = (np.frombuffer(x[c], "<u4").astype(np.int64) for c in ("docs", "impacts", "ends", "tops", "n_blocks"))
        self.ends, self.tops, self.starts = ends, tops, np.append(0, ends[:-1]) if len(ends) else ends
        self.first, self.last = self.docs[self.starts], self.docs[ends - 1]
        self.block_end = np.cumsum(count)
        self.block_start = self.block_end - count
        self.key = np.array([np.iinfo(np.int64).max if i is None else i for i in self.ids], np.int64)
        self.null = np.array([i is None for i in self.ids], bool)
        self.seen = self.skipped = 0

    def search(self, slots: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the k best documents with a score above 0; of equal scores, the smaller ids."""
        n = len(self.ids)
        b = _ranges(self.block_start[slots], self.block_end[slots])
        w = np.repeat(weights, self.block_end[slots] - self.block_start[slots])
        exact = float((self.tops[b] * w.astype(float)).sum()) < 2**53
        rise = _sums(np.append(self.first[b], self.last[b] + 1), np.append(self.tops[b] * w, -self.tops[b] * w), n + 1, exact)
        bound = np.cumsum(rise)[:n]
        order = np.argsort(-bound, kind="stable")
        places, scores, least, at, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 1, 0, 4 * k
        high = -bound[order]
        self.seen += int((self.ends[b] - self.starts[b]).sum())
        read = np.zeros(len(b), bool)
        while at < (end := min(at + step, int(np.searchsorted(high, -least, "right")))):
            want = np.zeros(n + 1, np.int64)
            want[order[at:end] + 1] = 1
            before = np.cumsum(want)
            on = before[self.last[b] + 1] > before[self.first[b]]  # blocks with a candidate between their ends
            read |= on
            post = _ranges(self.starts[b[on]], self.ends[b[on]])
            value = self.impacts[post] * np.repeat(w[on], self.ends[b[on]] - self.starts[b[on]])
            take = want[self.docs[post] + 1] > 0
            got = _sums(self.docs[post[take]], value[take], n, exact)[order[at:end]]
            places, scores = np.append(places, order[at:end]), np.append(scores, got)
            keep = np.lexsort((places, self.key[places], self.null[places], -scores))[:k]
            keep = keep[scores[keep] > 0]
            places, scores = places[keep], scores[keep]
            least = int(scores[-1]) if len(scores) == k else 1
            at, step = end, 4 * step
        self.skipped += int((self.ends[b] - self.starts[b])[~read].sum())
        return places, scores


@lru_cache(2)
def _items(uri: str, part: int) -> dict | None:
    """A block of items: item, item_id, and their terms and weights, end to end."""
    import pyarrow.parquet as pq
    from pyarrow import fs as pafs

    fs, top = filesystem(f"{uri}/part={part}")
    if fs.get_file_info(top).type == pafs.FileType.NotFound:
        return None
    return pa.concat_tables(pq.read_table(f.path, filesystem=fs, partitioning=None) for f in fs.get_file_info(pafs.FileSelector(top)) if f.path.endswith(".parquet")).to_pydict()


def search(index: DataFrame, n: int, queries: DataFrame, id_col: str = "item_id", text_col: str = "text", k: int = 20, block: int = 1024) -> DataFrame:
    """item, item_id, doc_id, score, rank of the k best documents of each row of queries.

    index, n: as blocked() gives them. Items are landed in blocks of about `block`; a task reads one block at a time,
    so any number of them goes over any number of shards; of each shard the k best go on.
    """
    spark = ship(queries.sparkSession)
    rows = landed(queries.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).alias("item_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("raw")), "lexical-items")

    def count(batches):
        for b in batches:
            for item, raw in zip(b.column("item").to_pylist(), b.column("raw").to_pylist(), strict=True):
                found, times = np.unique(np.array(terms_of(raw), object), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.int64()), pa.array([x.decode() for x in found], pa.string()), pa.array(times, pa.int64())], ["item", "term", "times"])

    terms = landed(rows.select("item", "raw").mapInArrow(count, "item long, term string, times long"), "lexical-terms")

    def listed(batches):
        for file in (f for b in batches for f in b.column("file").to_pylist()):
            x = _loaded(file, "terms", "df")
            for at in range(0, len(x["df"]), 100_000):
                yield pa.RecordBatch.from_arrays([x["terms"].slice(at, 100_000), x["df"].slice(at, 100_000)], ["term", "df"])

    index = _dealt(index)
    lists = index.mapInArrow(listed, "term string, df int")
    df = lists.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = df.select("term", F.expr(f"cast(floor(1000D * ln((2D * {n} + 2D) / (2D * df + 1D))) AS bigint)").alias("w")).where("w > 0")
    parts = max(1, -(-rows.count() // block))
    given = terms.join(weight, "term").groupBy("item").agg(F.collect_list("term").alias("terms"), F.collect_list(F.expr("w * times")).alias("weights"))
    uri = shared_dir(spark, "lexical-blocks-of-items")
    given.join(rows.select("item", "item_id"), "item").withColumn("part", F.expr(f"pmod(xxhash64(item), {parts})")).write.partitionBy("part").parquet(uri)

    def run(batches):
        for b in batches:
            for number, file in zip(b.column("shard").to_pylist(), b.column("file").to_pylist(), strict=True):
                x = _loaded(file, *BLOCKED)
                shard, names = Shard(x | {"doc_ids": x["doc_ids"].to_pylist()}), x["terms"]
                for part in range(parts):
                    items = _items(uri, part)
                    if items is None:
                        continue
                    sizes = [len(t) for t in items["terms"]]
                    slots = pc.index_in(pa.array(list(chain.from_iterable(items["terms"])), pa.string()), value_set=names).fill_null(-1).to_numpy(zero_copy_only=False)
                    weights, at = np.fromiter(chain.from_iterable(items["weights"]), np.int64), 0
                    out = []
                    for item, size in zip(items["item"], sizes, strict=True):
                        s, w = slots[at : at + size], weights[at : at + size]
                        at += size
                        if (s >= 0).any():
                            out += [(item, shard.ids[p], p, v) for p, v in zip(*(y.tolist() for y in shard.search(s[s >= 0], w[s >= 0], k)), strict=True)]
                    cols = list(zip(*out)) if out else [[]] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array([number] * len(out), pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], ["item", "doc_id", "shard", "place", "score"])

    found = index.mapInArrow(run, "item long, doc_id long, shard long, place long, score long")
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "shard", "place")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(rows.select("item", "item_id"), "item").select("item", "item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 20, shard_bytes: int = 8 << 20) -> DataFrame:
    """item, item_id, rank, doc_id, score: the k best of docs (doc_id, text) for each row of queries (item_id, text).

    Terms are maximal runs of ASCII letters, digits and all characters beyond ASCII, A-Z in lower case; scores are
    whole numbers. Defined cases: a null or empty text has no terms; a document is found once a row, whatever its id, and of equal scores
    the smaller id comes first, null ids last; each row of queries is an item of its own; an item without a
    term that any document has gets no rows, as does everything on empty tables; other columns are ignored.
    """
    index, n = blocked(shards(docs, shard_bytes=shard_bytes))
    return search(index, n, queries, k=k)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: ranked_search() of all documents for each benchmark item; cases as defined there."""
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents), s AS (SELECT count(*) AS n, sum(len(t))::bigint AS l FROM d WHERE len(t) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n) + 2)::double / (2 * count(*) + 1)::double))::bigint AS w FROM tf, s GROUP BY 1),
q AS (SELECT i, item_id, unnest(t) AS term FROM (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS t FROM benchmark)),
sc AS (SELECT i, any_value(item_id) AS item_id, r, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(t) * n) // l))))::bigint AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN d USING (r), s GROUP BY i, r)
SELECT item_id, rank::int AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id, r) AS rank FROM sc WHERE score > 0) WHERE rank <= 20
"""
