"""Token ids as length-delimited binary records with masked checksums.

A shard file holds records: length (u64), masked CRC-32C of the length, payload,
masked CRC-32C of the payload, all little-endian. Beside it an index file has an
entry (offset, id, tokens) of 24 bytes per record, for reads in any order.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import filesystem, keyed, landed, shared_dir, ship, table
from .units import UnitEncoder, chunks

#: Flags of a payload's header (id i64, flags u32, tokens u32): the id is null; ids are 2 bytes wide.
NULL_ID, NARROW = 1, 2
ENTRY = np.dtype([("offset", "<u8"), ("id", "<i8"), ("tokens", "<u4"), ("flags", "<u4")])
_LANE = 256


# --- checksums ------------------------------------------------------------------------


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """CRC-32C by four bytes at a time, and the advance of a state over _LANE zero bytes, as 4 tables of 256 each."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0x82F63B78), t >> 1)
    by4 = [t]
    for _ in range(3):
        by4.append(t[by4[-1] & 255] ^ (by4[-1] >> 8))
    state = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(_LANE):
        state = t[state & 255] ^ (state >> 8)
    byte = np.arange(256)
    skip = [np.bitwise_xor.reduce(np.where((byte[:, None] >> np.arange(8)) & 1, state[8 * k : 8 * k + 8], 0).astype(np.uint32), axis=1) for k in range(4)]
    return np.array(by4), np.array(skip)


def _words(rows: np.ndarray) -> np.ndarray:
    """The raw CRC (state 0 at the start) of each row of little-endian u32."""
    (t0, t1, t2, t3), _ = _tables()
    c = np.zeros(len(rows), np.uint32)
    for w in np.ascontiguousarray(rows.T):
        c = c ^ w
        c = t3[c & 255] ^ t2[(c >> 8) & 255] ^ t1[(c >> 16) & 255] ^ t0[c >> 24]
    return c


def crc32c(messages: list[bytes]) -> np.ndarray:
    """CRC-32C of each message of at least 4 bytes, all at once."""
    if not messages:
        return np.zeros(0, np.uint32)
    _, (s0, s1, s2, s3) = _tables()
    size = np.array([len(x) for x in messages])
    lanes = -(-size // _LANE)
    data = np.frombuffer(bytearray(b"".join(x for m in messages for x in (bytes(-len(m) % _LANE), m))), np.uint8)
    ends = np.cumsum(lanes) * _LANE
    data[(ends - size)[:, None] + np.arange(4)] ^= 255  # as if the state began with all ones
    lane = _words(data.view("<u4").reshape(-1, _LANE // 4))
    first, order = np.cumsum(lanes) - lanes, np.argsort(-lanes, kind="stable")
    out, left = np.zeros(len(size), np.uint32), np.sort(lanes)[::-1]
    for k in range(int(lanes.max())):
        on = order[: np.searchsorted(-left, -k)]  # messages of more than k lanes
        c = out[on]
        out[on] = lane[first[on] + k] ^ s0[c & 255] ^ s1[(c >> 8) & 255] ^ s2[(c >> 16) & 255] ^ s3[c >> 24]
    return ~out


def masked(crc: np.ndarray) -> np.ndarray:
    """Rotated and shifted, so that a checksum of data with checksums stays strong."""
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)


def frame(payloads: list[bytes]) -> list[bytes]:
    sizes = np.array([len(x) for x in payloads], "<u8")
    heads = [x.tobytes() for x in sizes]
    a, b = masked(crc32c(heads)).astype("<u4"), masked(crc32c(payloads)).astype("<u4")
    return [h + x.tobytes() + p + y.tobytes() for h, x, p, y in zip(heads, a, payloads, b, strict=True)]


def unframe(raw: bytes) -> list[bytes]:
    """The payloads of whole records that lie end to end; ValueError if a checksum is wrong."""
    heads, sums, payloads, p = [], [], [], 0
    while p < len(raw):
        n = int.from_bytes(raw[p : p + 8], "little")
        heads.append(raw[p : p + 8])
        payloads.append(raw[p + 12 : p + 12 + n])
        sums.append(raw[p + 8 : p + 12] + raw[p + 12 + n : p + 16 + n])
        p += 16 + n
        if p > len(raw):
            raise ValueError("a record is cut short")
    want = np.frombuffer(b"".join(sums), "<u4").reshape(-1, 2)
    if not (np.array_equal(masked(crc32c(heads)), want[:, 0]) and np.array_equal(masked(crc32c(payloads)), want[:, 1])):
        raise ValueError("a record's checksum is wrong")
    return payloads


# --- tokens ---------------------------------------------------------------------------


@cache
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is its own
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return t, tuple(x.content for x in t.get_added_tokens_decoder().values())


def _library(path: str, texts: list[str]) -> list[list[int]]:
    return [x.ids for x in _tokenizer(path)[0].encode_batch_fast(texts, add_special_tokens=False)]


#: White space other than the space itself, before a space; among Latin-1 characters.
_EDGE = re.compile("[\t-\r\x1c-\x1f\x85\xa0] ")


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _cuts_at_spaces(tokenizer) -> bool:
    """True if the file's own settings say that texts may be cut before single spaces: byte-level pieces by its usual pattern, nothing normalised or left to chance."""
    x = json.loads(tokenizer.to_str())
    pre, model = x["pre_tokenizer"] or {}, x["model"]
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    return bool(plain and not x["normalizer"] and not x["truncation"] and not x["padding"] and model.get("type") == "BPE" and not model.get("dropout"))


@cache
def token_encoder(path: str, most: int = 1_000_000):
    """texts -> the ids of each, as the tokenizer's library encodes each whole text.

    A byte-level tokenizer splits before a single space that stands between other
    characters. Texts of Latin-1 characters without double spaces and without
    special tokens are so cut into units, if the file's settings allow it; the library's pre-tokenizer
    and model encode each new unit, and any other text whole. A process has one
    encoder, so its units outlive a task; it holds up to about `most` units, and as many pieces.
    """
    tokenizer, special = _tokenizer(path)
    safe, model = _cuts_at_spaces(tokenizer), tokenizer.model
    cut = tokenizer.pre_tokenizer.pre_tokenize_str if safe else None
    # The characters that stand for bytes, as the library gives them: letters alone need no more than those.
    stand = {b: c for x in map(chr, range(256)) if safe for b, c in zip(x.encode(), "".join(p for p, _ in cut(x)), strict=True)}

    def pieces(new):
        found = [model.tokenize(x) for x in new]
        return np.fromiter((t.id for x in found for t in x), np.int32), np.array([len(x) for x in found], np.int32)

    by_piece = UnitEncoder(pieces, most)

    def encode(keys):
        """A key is what follows a unit's space; a key of a unit without one begins with a space."""
        return by_piece([f" {x}".encode().decode("latin-1").translate(stand)] if x.isalpha() else [p for p, _ in cut(x[1:] if x[:1] == " " else f" {x}")] for x in keys)

    cached = UnitEncoder(encode, most)

    def units(text: str) -> list[str]:
        keys = text.split(" ")
        if keys[0]:
            keys[0] = f" {keys[0]}"
        else:
            del keys[0]
        return keys

    def run(texts: list[str]) -> list[np.ndarray]:
        plain = [safe and "  " not in x and not _EDGE.search(x) and not any(t in x for t in special) and _latin(x) for x in texts]
        ids, size = cached(units(x) for x, p in zip(texts, plain, strict=True) if p)
        ends = np.cumsum(size)
        easy = iter(np.split(ids, ends[:-1]) if len(ends) else ())
        hard = iter(_library(path, [x for x, p in zip(texts, plain, strict=True) if not p]))
        return [next(easy) if p else np.array(next(hard), np.int32) for p in plain]

    return run


@cache
def _largest_id(path: str) -> int:
    """The largest id that a tokenizer can give, added tokens included."""
    return max(_tokenizer(path)[0].get_vocab(with_added_tokens=True).values(), default=0)


def write_token_records(df: DataFrame, uri: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> DataFrame:
    """Encode each text, append end_id and write shards in ascending id order below uri.

    Rows are range-partitioned and sorted by id (nulls first, ties by a hash of the text, then by
    row, so that one id doesn't fill a task), a shard to a task, streamed batch by batch. Returns
    the manifest (shard, path, n_docs, n_tokens) as written to the shared folder; retried
    tasks write new names. Ids take 16 bits if all of the tokenizer's and end_id fit, else 32.

    Defined cases: a null or empty text has the end id alone; null ids come first; rows that repeat
    an id get a record each; an empty table gives an empty manifest; other columns are ignored.
    """
    rows = keyed(df).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), "_row").withColumn("tie", F.xxhash64("text"))
    if not 0 <= end_id < 1 << 31:
        raise ValueError("end_id doesn't fit 31 bits")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, (fs, top) = token_encoder(tokenizer), filesystem(uri)
        wide, flag = ("<u2", NARROW) if max(_largest_id(tokenizer), end_id) < 1 << 16 else ("<u4", 0)
        fs.create_dir(top, recursive=True)
        name, at, docs, tokens, out, index = f"{top}/{uuid.uuid4().hex}", 0, 0, 0, None, None
        for b in (c for b in batches for c in chunks(b, "text")):
            if out is None:
                out, index = fs.open_output_stream(f"{name}.rec"), fs.open_output_stream(f"{name}.idx")
            keys = b.column("doc_id").to_pylist()
            ids = [np.append(x, end_id).astype(wide) for x in encode(b.column("text").to_pylist())]
            entry = np.zeros(len(ids), ENTRY)
            entry["id"], entry["tokens"] = [x or 0 for x in keys], [len(x) for x in ids]
            entry["flags"] = [flag | (NULL_ID if x is None else 0) for x in keys]
            heads = entry[["id", "flags", "tokens"]].astype([("id", "<i8"), ("flags", "<u4"), ("tokens", "<u4")])
            records = frame([h.tobytes() + x.tobytes() for h, x in zip(heads, ids, strict=True)])
            sizes = np.array([len(x) for x in records])
            entry["offset"] = at + np.cumsum(sizes) - sizes
            out.write(b"".join(records))
            index.write(entry.tobytes())
            at, docs, tokens = at + int(sizes.sum()), docs + len(ids), tokens + int(entry["tokens"].sum())
        if out is not None:
            out.close()
            index.close()
            yield pa.RecordBatch.from_pydict({"shard": [TaskContext.get().partitionId()], "path": [name], "n_docs": [docs], "n_tokens": [tokens]})

    sorted_rows = rows.repartitionByRange("doc_id", "tie", "_row").sortWithinPartitions("doc_id", "tie", "_row").select("doc_id", "text")
    return landed(sorted_rows.mapInArrow(write, "shard long, path string, n_docs long, n_tokens long"), "token-manifest")


def read_token_records(manifest: DataFrame, uri: str, range_bytes: int = 8 << 20) -> DataFrame:
    """Each record of the manifest's shards: doc_id, start (tokens before it in all shards), n_tokens, ids_crc32, ids.

    The indexes are read first; they give the record boundaries, and ranges of whole records, about
    range_bytes each, are dealt out and read one by one. Checksums are verified. The
    running sum has a row per shard.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))])
    ranges = pa.schema([("path", pa.string()), ("at", pa.int64()), ("length", pa.int64()), ("start", pa.int64())])

    def plan(batches):
        fs, _ = filesystem(uri)
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
                with fs.open_input_stream(f"{path}.idx") as f:
                    entry = np.frombuffer(f.read(), ENTRY)
                with fs.open_input_file(f"{path}.rec") as f:
                    bounds = np.append(entry["offset"], f.size()).astype(np.int64)
                before, at, out = start + np.append(0, np.cumsum(entry["tokens"], dtype=np.int64)), 0, []
                while at < len(entry):
                    end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + range_bytes, "right")) - 1)
                    out.append((path, int(bounds[at]), int(bounds[end] - bounds[at]), int(before[at])))
                    at = end
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(ranges.types)], schema=ranges)

    def read(batches):
        fs, _ = filesystem(uri)
        for b in batches:
            for path, at, length, start in zip(*(b.column(c).to_pylist() for c in ranges.names), strict=True):
                keys, ids = [], []
                with fs.open_input_file(f"{path}.rec") as f:
                    raw = f.read_at(length, at)
                for p in unframe(raw):
                    flags = int.from_bytes(p[8:12], "little")
                    keys.append(None if flags & NULL_ID else int.from_bytes(p[:8], "little", signed=True))
                    ids.append(np.frombuffer(p, "<u2" if flags & NARROW else "<u4", offset=16).astype("<u4"))
                size = np.array([len(x) for x in ids], np.int64)
                crc = pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())
                lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(size)).astype(np.int32), np.concatenate(ids).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(start + np.cumsum(size) - size), pa.array(size), crc, lists], schema=schema)

    ship(manifest.sparkSession)
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    based = manifest.withColumn("base", F.expr("coalesce(sum(n_tokens) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)"))
    dealt = based.repartition(n, "shard").mapInArrow(plan, "path string, at long, length long, start long").repartition(n, "path", "at")
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>")


def shuffled(manifest: DataFrame, seed: int = 0) -> DataFrame:
    """shard, number, place: every record of the manifest's shards once; place is its turn's hash, so that reads by place are in shuffled order."""
    one = manifest.where("n_docs > 0").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_docs") - 1)).alias("number"))
    return one.withColumn("place", F.xxhash64(F.lit(seed), "shard", "number"))


def fetch_records(manifest: DataFrame, wanted: DataFrame, by: str | None = None) -> DataFrame:
    """The rows of wanted (shard, number and any others) with doc_id, n_tokens and ids of that record, in the order of the column `by`, if given.

    The index entry of a record, and then the record alone, are read by their places; nothing else of a shard is. Checksums are verified. Rows of
    wanted may repeat; one whose shard or number doesn't exist is left out.
    """
    ship(manifest.sparkSession)
    rows = wanted.join(F.broadcast(manifest.select("shard", "path", "n_docs")) if manifest.count() <= 10_000 else manifest.select("shard", "path", "n_docs"), "shard").where("number BETWEEN 0 AND n_docs - 1")
    if by:
        rows = rows.orderBy(by)
    kinds = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}

    def read(batches):
        for b in batches:
            fs, files, found = filesystem(b.column("path")[0].as_py())[0] if b.num_rows else None, {}, []
            try:
                for path, number in zip(b.column("path").to_pylist(), b.column("number").to_pylist(), strict=True):
                    if path not in files:
                        files[path] = fs.open_input_file(f"{path}.idx"), fs.open_input_file(f"{path}.rec")
                    index, records = files[path]
                    entry = np.frombuffer(index.read_at(2 * ENTRY.itemsize, number * ENTRY.itemsize), ENTRY)
                    end = int(entry["offset"][1]) if len(entry) > 1 else records.size()
                    (raw,) = unframe(records.read_at(end - int(entry["offset"][0]), int(entry["offset"][0])))
                    flags = int(entry["flags"][0])
                    ids = np.frombuffer(raw, "<u2" if flags & NARROW else "<u4", offset=16).astype(np.int32)
                    found.append((None if flags & NULL_ID else int(entry["id"][0]), len(ids), ids))
            finally:
                for pair in files.values():
                    for f in pair:
                        f.close()
            keep = [c for c in b.schema.names if c not in ("path", "n_docs")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array([r[i] for r in found], t) for i, t in enumerate(kinds.values()))], [*keep, *kinds])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("path", "n_docs"))
    return rows.mapInArrow(read, f"{own}, doc_id long, n_tokens long, ids array<int>")


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: write_token_records() and read_token_records() of documents."""
    import public_tokenizers

    uri = shared_dir(spark, "tokens")
    manifest = write_token_records(table(spark, sf_dir, "documents"), uri, str(public_tokenizers.path("byte_bpe_50k.json")))
    return read_token_records(manifest, uri).select("doc_id", "start", "n_tokens", "ids_crc32")
