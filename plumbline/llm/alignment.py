"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Texts are cut into units at places where tokens of both tokenizers always end, and each distinct unit is
aligned once, by joins and windows over its tokens: posexplode, windowed cumulative lengths,
a full outer equi-join on unit and end, and running counts of the ends that both share.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import filesystem, landed, shared_dir, ship, table
from .units import chunks
from .unigram import BYTE, read_pieces

MARK = "▁"
#: A unit begins at a single space between two characters that aren't white space.
_CUT = re.compile(r"(?<=\S)(?= \S)")
#: Where a space has white space, or the text's end, beside it.
_ODD = re.compile(r"\s | \s| \Z")
PARTS = "part int, ids array<long>, n_units array<int>, flat array<int>, units array<string>, times array<long>"
#: Up to so many pairs (they are counted first) tasks read the table of pairs whole; more are joined by shuffle.
MOST_PAIRS = 1 << 20


def units_of(text: str) -> list[str]:
    """Units of a text with a space before it; each begins with a space, which is left out here."""
    return [x[1:] for x in _CUT.split(f" {text}")] if _ODD.search(f" {text}") else text.split(" ")


@cache
def _byte_level(path: str):
    """(tokenizer, bytes of each id); ValueError unless its pieces are byte-level, so that they always spell the text."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    x = json.loads(t.to_str())
    pre = x["pre_tokenizer"] or {}
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or x["normalizer"] or x["model"].get("dropout"):
        raise ValueError("the first tokenizer must be byte-level, without a normalizer")
    t.encode_special_tokens = True
    vocab, stand = t.get_vocab(with_added_tokens=False), _alphabet()
    out: list[bytes] = [b""] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        out[i] = bytes(map(stand.__getitem__, piece))
    return t, out


def _alphabet() -> dict[str, int]:
    """The byte that a character of a byte-level piece stands for: printable ones are themselves, the others have the characters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@cache
def _pieces(path: str):
    """(model, bytes of each id); ValueError if a piece runs on into the next word or a byte has no piece."""
    from sentencepiece import SentencePieceProcessor

    found = read_pieces(path)
    if any(re.search(f"[^{MARK}]{MARK}", p) for p, _, _ in found) or sum(kind == BYTE for _, _, kind in found) != 256:
        raise ValueError("the second tokenizer must have byte pieces and none that runs over a space")
    model = SentencePieceProcessor(model_file=path)
    out = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in found]
    if b"".join(out[i] for i in model.encode("  a b ")) != b"   a b ":
        raise ValueError("the second tokenizer must keep all spaces and put one before the text")
    return model, out


def parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = 8 << 20) -> str:
    """A folder with parts of the documents, about part_bytes of text each: ids, how many units each has, their numbers, and the part's distinct units with counts.

    A null or empty text, and one with the marker character (which the second tokenizer spells as a space), has no units.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, flat, names, size, k = [], [], [], {}, 0, TaskContext.get().partitionId() << 12

        def row():
            all_flat = np.concatenate(flat)
            cols = [[k], [ids], [np.array(sizes, np.int32)], [all_flat], [list(names)], [np.bincount(all_flat, minlength=len(names))]]
            kinds = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in PARTS.split(", ")])

        for b in (c for b in batches for c in chunks(b, "text", 1 << 20)):
            texts = b.column("text").to_pylist()
            more = sum(map(len, texts))
            if ids and size + more > part_bytes:
                yield row()
                ids, sizes, flat, names, size, k = [], [], [], {}, 0, k + 1
            found = [units_of(x) if x and MARK not in x else [] for x in texts]
            ids += b.column("doc_id").to_pylist()
            sizes += map(len, found)
            for x in dict.fromkeys(chain.from_iterable(found)):
                names.setdefault(x, len(names))
            flat.append(np.fromiter(map(names.__getitem__, chain.from_iterable(found)), np.int32))
            size += more
        if ids:
            yield row()

    uri = shared_dir(docs.sparkSession, "alignment-parts")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows.mapInArrow(cut, PARTS).write.partitionBy("part").option("compression", "zstd").parquet(uri)
    return uri


def encoded(units: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """times, homes, and tokens a, b of each distinct unit of (unit, times, home), landed with uid. Tokens are id << 8 | length in bytes, and are checked to spell the unit."""

    def run(batches):
        (ta, bytes_a), (tb, bytes_b) = _byte_level(a_path), _pieces(b_path)
        len_a, len_b = (np.array([len(x) for x in y], np.int32) for y in (bytes_a, bytes_b))

        def tokens(lists, spelt, lens, want):
            flat = np.fromiter(chain.from_iterable(lists), np.int32)
            if b"".join(map(spelt.__getitem__, flat.tolist())) != want:
                raise ValueError("tokens don't spell their text")
            return pa.ListArray.from_arrays(np.append(0, np.cumsum([len(x) for x in lists])).astype(np.int32), pa.array(flat << 8 | lens[flat]))

        def rows(texts, times, homes, sizes):
            want = (" " + " ".join(texts)).encode() if texts else b""
            a = tokens([x.ids for x in ta.encode_batch_fast([f" {x}" for x in texts], add_special_tokens=False)], bytes_a, len_a, want)
            bb = tokens(tb.encode(texts, num_threads=1), bytes_b, len_b, want)
            lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(sizes)).astype(np.int32), pa.array(homes))
            return pa.RecordBatch.from_arrays([pa.array(times), lists, a, bb], ["times", "homes", "a", "b"])

        # Rows come sorted by unit; the last unit of a batch may go on in the next one.
        unit, times, homes = [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in (c for b in batches for c in chunks(b, "unit", 1 << 17)):
            unit += b.column("unit").to_pylist()
            times, homes = np.append(times, b.column("times").to_numpy()), np.append(homes, b.column("home").to_numpy())
            first = np.array([0, *(i for i in range(1, len(unit)) if unit[i] != unit[i - 1])])
            done = int(first[-1])
            if done:
                yield rows([unit[i] for i in first[:-1]], np.add.reduceat(times[:done], first[:-1]), homes[:done], np.diff(first))
                unit, times, homes = unit[done:], times[done:], homes[done:]
        if unit:
            yield rows(unit[:1], times.sum(keepdims=True), homes, np.array([len(unit)]))

    dealt = units.repartition(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), "unit").sortWithinPartitions("unit")
    return landed(dealt.mapInArrow(run, "times long, homes array<long>, a array<int>, b array<int>").withColumn("uid", F.monotonically_increasing_id()), "alignment-units", compression="zstd")


@contextmanager
def _together(spark: SparkSession):
    """Lets rows dealt out by unit be joined on unit and end where they are."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _dealt(units: DataFrame, *columns: str) -> DataFrame:
    return units.select("uid", *columns).repartition(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), "uid")


def _ends(units: DataFrame, side: str) -> DataFrame:
    """uid, end, id of one tokenizer: tokens by place, with running sums of their lengths."""
    t = _dealt(units, side).select("uid", F.posexplode(side).alias("pos", "t"))
    end = F.sum(F.expr("t & 255")).over(Window.partitionBy("uid").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return t.select("uid", end.alias("end"), F.shiftright("t", 8).cast("long").alias(f"{side}_id"))


def aligned(units: DataFrame) -> DataFrame:
    """times, homes, cells of each unit, landed. A cell is a << 32 | b << 2 | flags: the two tokens over a stretch of bytes, and whether a (1) and b (2) end with it.

    The join's rows are the stretches between ends of either tokenizer. A stretch lies in one token of each, the
    first to end there or later, and two tokens that overlap share exactly one stretch. So cells are the
    links, at most m + n - 1 of a group of m and n tokens and never all its pairs; flags 3 are the shared ends, which close a group.
    """
    back = Window.partitionBy("uid").orderBy(F.col("end").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = _ends(units, "a").join(_ends(units, "b"), ["uid", "end"], "full")
    flags = "IF(a_id IS NULL, 0L, 1L) | IF(b_id IS NULL, 0L, 2L)"
    rows = rows.select("uid", "end", F.last("a_id", True).over(back).alias("a"), F.last("b_id", True).over(back).alias("b"), F.expr(flags).alias("flags"))
    one = rows.select("uid", F.struct("end", F.expr("(a << 32) | (b << 2) | flags").alias("cell")).alias("c")).groupBy("uid").agg(F.sort_array(F.collect_list("c")).alias("c"))
    with _together(units.sparkSession):
        return landed(one.join(_dealt(units, "times", "homes"), "uid").select("uid", "times", "homes", F.col("c.cell").alias("cells")), "alignment", compression="zstd")


def pair_counts(found: DataFrame) -> DataFrame:
    """link (a << 30 | b), n, best, landed in order: how many links of all documents hold each pair of ids, and whether none of its second id's is higher."""
    n = found.select("times", F.explode("cells").alias("cell")).groupBy(F.shiftright("cell", 2).alias("link")).agg(F.sum("times").alias("n"))
    top = F.max("n").over(Window.partitionBy(F.expr("link & 1073741823")))
    return landed(n.select("link", "n", (F.col("n") == top).alias("best")), "alignment-pairs")


@lru_cache(2)
def _pair_table(uri: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The landed pairs, sorted by link."""
    t = _read(uri)
    link = t.column("link").to_numpy()
    order = np.argsort(link)
    return link[order], t.column("n").to_numpy()[order], t.column("best").to_numpy(zero_copy_only=False)[order]


def _read(uri: str) -> pa.Table:
    import pyarrow.parquet as pq
    from pyarrow import fs as pafs

    fs, top = filesystem(uri)
    return pa.concat_tables(pq.read_table(f.path, filesystem=fs, partitioning=None) for f in fs.get_file_info(pafs.FileSelector(top)) if f.path.endswith(".parquet"))


@lru_cache(1)
def _marks(most: int) -> np.ndarray:
    """Every id up to `most` as text, after a comma, a bar and a semicolon."""
    return np.array([[f"{m}{i}" for i in range(most + 1)] for m in ",|;"], object)


def _marked(most: int) -> np.ndarray:
    return _marks((1 << most.bit_length()) - 1)


def spelt(cells: np.ndarray, sizes: np.ndarray) -> list[str]:
    """The groups of each unit as text, from its cells; the running count of shared ends numbers the groups."""
    flags, link = cells & 3, cells >> 2
    group = np.cumsum(flags == 3) - (flags == 3)
    a, b = np.flatnonzero(flags & 1), np.flatnonzero(flags & 2)
    key = np.concatenate([group[a] * 2, group[b] * 2 + 1])
    order = np.argsort(key, kind="stable")
    key, ids = key[order], np.concatenate([link[a] >> 30, link[b] & 0x3FFFFFFF])[order]
    # A token after another one of its kind in the group, after the group's first kind, or in a new group.
    mark = np.where(np.diff(key, prepend=-2) == 0, 0, np.where(key & 1, 1, 2))
    pieces = _marked(int(ids.max(initial=0)))[mark, ids].tolist()
    unit = np.repeat(np.arange(len(sizes)), sizes)
    count = np.bincount(np.concatenate([unit[a], unit[b]]), minlength=len(sizes))
    ends = np.cumsum(count)
    return ["".join(pieces[s:e])[1:] for s, e in zip((ends - count).tolist(), ends.tolist(), strict=True)]


def align(docs: DataFrame, a_path: str, b_path: str, part_bytes: int = 8 << 20, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document.

    a: a byte-level tokenizer over space and text; b: a SentencePiece model with byte pieces. Defined
    cases: a null or empty text, or one whose tokens don't spell it (it holds the marker character), has
    zeros and ''; rows that repeat an id, and null ids, are documents each; texts of any length take part, one without
    spaces as one unit; an empty table gives no rows; other columns are ignored.
    """
    spark = ship(docs.sparkSession)
    uri = parts(docs, part_bytes=part_bytes)
    dealt = spark.read.schema(PARTS).parquet(uri)
    named = dealt.select("part", F.posexplode(F.arrays_zip("units", "times")).alias("no", "x")).select(F.col("x.units").alias("unit"), F.col("x.times").alias("times"), F.expr("cast(part AS bigint) << 32 | no").alias("home"))
    units = encoded(named, a_path, b_path)
    found = aligned(units)
    pairs = pair_counts(found)
    if pairs.count() <= most_pairs:  # tasks look their links up in the whole table of pairs
        pair_uri, scores = pairs.inputFiles()[0].rpartition("/")[0], F.array().cast("array<bigint>")
    else:  # links are joined with theirs
        scored = found.select("uid", F.explode("cells").alias("cell")).withColumn("link", F.shiftright("cell", 2)).join(pairs, "link").groupBy("uid").agg(F.array(F.count_if("best"), F.sum("n")).alias("scores"))
        pair_uri, found, scores = None, found.join(scored, "uid"), F.col("scores")
    sums = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]

    def whole(ids, value, size, flat, groups):
        ends = np.cumsum(size, dtype=np.int64)
        digest = [hashlib.sha256(";".join(map(groups.__getitem__, flat[e - s : e].tolist())).encode()).hexdigest() if s else "" for s, e in zip(size.tolist(), ends.tolist(), strict=True)]
        cols = []
        for v in value:
            run = np.append(0, np.cumsum(v[flat]))
            cols.append(pa.array(run[ends] - run[ends - size]))
        return pa.table([pa.array(ids, pa.int64()), *cols, pa.array(digest, pa.string())], ["doc_id", *sums, "groups_sha256"])

    def gather(units: pa.Table) -> pa.Table:
        units = units.combine_chunks()
        home = units.column("home").to_numpy()
        order = np.argsort(home)
        lists = units.column("cells").combine_chunks().take(pa.array(order))
        cells, size = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
        start = np.cumsum(size) - size
        per = lambda x: np.add.reduceat(x.astype(np.int64), start)
        if pair_uri:
            keys, n, best = _pair_table(pair_uri)
            at = np.searchsorted(keys, cells >> 2)
            scores = [per(best[at]), per(n[at])]
        else:
            scores = units.column("scores").combine_chunks().take(pa.array(order)).flatten().to_numpy().reshape(-1, 2).T
        value = [per(cells & 1), per(cells >> 1 & 1), per((cells & 3) == 3), size.astype(np.int64), *scores]
        groups = []
        for i in range(0, len(size), 20_000):
            groups += spelt(cells[start[i] :][: size[i : i + 20_000].sum()], size[i : i + 20_000])
        docs = _read(f"{uri}/part={home[0] >> 32}")
        return pa.concat_tables(whole(x.column("ids")[0].values.to_pylist(), value, x.column("n_units")[0].values.to_numpy(), x.column("flat")[0].values.to_numpy(), groups) for x in (docs.slice(i, 1).combine_chunks() for i in range(len(docs))))

    def bare(batches):
        for b in batches:
            for ids in b.column("ids").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(np.zeros(len(ids), np.int64))] * len(sums), pa.array([""] * len(ids))], ["doc_id", *sums, "groups_sha256"])

    schema = ", ".join(["doc_id long", *(f"{c} long" for c in sums), "groups_sha256 string"])
    cells = found.select(F.explode("homes").alias("home"), "cells", scores.alias("scores"))
    # parts whose documents have no units at all meet no cell
    return cells.groupBy(F.shiftright("home", 32)).applyInArrow(gather, schema).unionByName(dealt.where("size(units) = 0").select("ids").mapInArrow(bare, schema))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: align() of documents by the byte-level and the piece tokenizer; cases as defined there."""
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model")))
