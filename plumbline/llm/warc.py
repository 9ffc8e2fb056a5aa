"""WARC records in ZIP-packaged archives: written by tasks, read by byte ranges.

An archive is a ZIP file of stored members: archive/*.warc.gz (one gzip member for each
WARC record) and indexes/*.cdx (a line with file name, offset and length of each
record, as JSON at its end; also packed as .cdx.gz). A reader takes the central directory, the
indexes and then only the ranges it wants; nothing is extracted.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import filesystem, keyed, landed, salted, shared_dir, ship, table

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads under this many bytes never become revisits.
LEAST_REVISIT = 100


# --- ZIP ------------------------------------------------------------------------------


def zip_members(read, size: int) -> dict[str, dict]:
    """name -> method, size, packed, start of a ZIP file's members, from its directories.

    read(offset, n) gives bytes. The end record is looked for in the last 64 KB + 22
    bytes; a ZIP64 end record and ZIP64 extra fields are followed where present.
    Raises ValueError if the file is no ZIP archive.
    """
    tail_at = max(0, size - 65_557)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(b"PK\5\6")
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(b"PK\5\6", 0, at)  # those bytes may stand in the comment, too
    if at < 0:
        raise ValueError("no end of a central directory: not a ZIP file")
    n, length, start = struct.unpack_from("<HII", tail, at + 10)
    if at >= 20 and tail[at - 20 : at - 16] == b"PK\6\7":
        (where,) = struct.unpack_from("<Q", tail, at - 12)
        end = read(where, 56)
        if end[:4] != b"PK\6\6":
            raise ValueError("the ZIP64 locator points nowhere")
        n, length, start = struct.unpack_from("<QQQ", end, 32)
    found, directory, p = {}, read(start, length), 0
    for _ in range(n):
        if directory[p : p + 4] != b"PK\1\2":
            raise ValueError("the central directory is broken")
        flags, method, packed, full, n_name, n_extra, n_note, offset = struct.unpack_from("<8xHH8xIIHHH8xI", directory, p)
        name, extra = directory[p + 46 : p + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437"), directory[p + 46 + n_name : p + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, k = struct.unpack_from("<HH", extra)
            if kind == 1:  # only the fields that don't fit above, in this order
                wide = iter(struct.unpack_from(f"<{k // 8}Q", extra, 4))
                full, packed, offset = (next(wide) if x == 0xFFFFFFFF else x for x in (full, packed, offset))
            extra = extra[4 + k :]
        found[name] = {"method": method, "size": full, "packed": packed, "header": offset}
        p += 46 + n_name + n_extra + n_note
    return found


def data_start(read, member: dict) -> int:
    """Where a stored member's bytes begin; ValueError if it is compressed."""
    if member["method"] != 0:
        raise ValueError("only stored members can be read by range")
    head = read(member["header"], 30)
    if head[:4] != b"PK\3\4":
        raise ValueError("no local header where the directory says")
    return member["header"] + 30 + sum(struct.unpack_from("<HH", head, 26))


# --- records --------------------------------------------------------------------------


def warc_record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit without."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='%/:?#[]@!$&()*+,;=~-._')}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The fields of a record; a response's payload is checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    field = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(field["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
    digest = field["warc-payload-digest"].partition(":")[2]
    kind = field["warc-type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"{field['warc-record-id']}: its payload doesn't match its digest")
    page = lambda x: int(x[10:-1]) if x and x[10:-1] else None  # noqa: E731  <urn:page:N>
    return {"page_id": page(field["warc-record-id"]), "url": field.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": page(field.get("warc-refers-to")), "payload": payload if kind == "response" else None}


# --- jobs -----------------------------------------------------------------------------


def located(read, size: int) -> list[tuple[int, int]]:
    """(offset in the ZIP file, length) of each record that its indexes list, by member and offset.

    ValueError where a stored archive has no index lines, a line names no member, or there is no archive at all.
    """
    members = zip_members(read, size)
    base = {n.removeprefix("archive/"): data_start(read, m) for n, m in members.items() if n.startswith("archive/") and n.endswith(".warc.gz")}
    found: dict[str, list[tuple[int, int]]] = {n: [] for n in base}
    for name, m in members.items():
        if name.startswith("indexes/") and name.endswith((".cdx", ".cdxj", ".cdx.gz")):
            raw = read(data_start(read, m), m["size"])
            for line in (gzip.decompress(raw) if name.endswith(".gz") else raw).decode().splitlines():
                if "{" in line:
                    x = json.loads(line[line.index("{") :])
                    if x["filename"] not in found:
                        raise ValueError(f"the index names {x['filename']}, which isn't in the archive")
                    found[x["filename"]].append((base[x["filename"]] + int(x["offset"]), int(x["length"])))
    if not found or not all(found.values()):
        raise ValueError(f"no index lines for {[n for n, x in found.items() if not x]}")
    return [x for n in sorted(found) for x in sorted(found[n])]


def _packed(parts: list[bytes]) -> bytes:
    out, at, index = io.BytesIO(), 0, []
    for x in parts:
        index.append(json.dumps({"filename": DATA.removeprefix("archive/"), "offset": str(at), "length": str(len(x))}) + "\n")
        at += len(x)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        with z.open(DATA, "w", force_zip64=True) as f:
            f.writelines(parts)
        z.writestr(INDEX, "".join(index))
    return out.getvalue()


def write_archives(pages: DataFrame, uri: str, archive_bytes: int = 32 << 20, date: str = "2024-01-01T00:00:00Z", level: int = 4) -> DataFrame:
    """Write a record per row of pages (page_id, url, html) into archives below uri.

    Returns the manifest (path, n_records, n_bytes) as written to the shared folder.
    Each try of a task writes under new names and only finished tasks are in the
    manifest, so a lost executor leaves nothing that is read. A task holds one
    archive at a time. Digests alone meet, salted by row; the payloads are dealt out by row.

    Defined cases: a null html is an empty payload; a null page_id is written, never referred to and
    refers to the smallest page_id with its payload; pages that repeat the smallest page_id are
    all responses; an empty table gives an empty manifest; other columns are ignored.
    """
    rows = keyed(pages)
    rows = rows.select("_row", F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    keys = rows.where(F.length("payload") >= LEAST_REVISIT).select("digest", F.pmod("_row", F.lit(32)).alias("salt"), "_row", "page_id")
    first = salted(keys, ["digest"], "salt", {"first": (F.min("page_id"), F.min("first")), "n": (F.count("*"), F.sum("n"))}).where("n > 1")
    revisits = keys.join(first, ["digest", "salt"]).where("first IS NOT NULL AND NOT (page_id <=> first)").select("_row", F.col("first").alias("refers_to"))
    rows = rows.join(revisits, "_row", "left").select("page_id", "url", "payload", "digest", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = filesystem(uri)
        fs.create_dir(top, recursive=True)
        parts: list[bytes] = []
        size = 0

        def close():
            name = f"{top}/{uuid.uuid4().hex}.wacz"
            data = _packed(parts)
            with fs.open_output_stream(name) as f:
                f.write(data)
            return pa.RecordBatch.from_pydict({"path": [name], "n_records": [len(parts)], "n_bytes": [len(data)]})

        for b in batches:
            for r in zip(*(b.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                parts.append(gzip.compress(warc_record(*(x.as_py() for x in r), date), level, mtime=0))
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield close()
                    parts, size = [], 0
        if parts:
            yield close()

    return landed(rows.mapInArrow(write, "path string, n_records long, n_bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame, uri: str, range_bytes: int = 4 << 20) -> DataFrame:
    """Every record of the archives that manifest lists: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits).

    Directories and indexes are read first; ranges of whole records, about
    range_bytes each, are then dealt out and read one by one.
    """

    def plan(batches):
        fs, _ = filesystem(uri)
        for b in batches:
            out = []
            for path in b.column("path").to_pylist():
                with fs.open_input_file(path) as f:
                    read = lambda at, n: f.read_at(n, at)  # noqa: B023, E731
                    lines = located(read, f.size())
                at = length = 0
                for o, n in lines:
                    if length and (length + n > range_bytes or o != at + length):
                        out.append((path, at, length))
                        length = 0
                    at, length = at if length else o, length + n
                if length:
                    out.append((path, at, length))
            yield pa.RecordBatch.from_pydict({k: [x[i] for x in out] for i, k in enumerate(("path", "at", "length"))}, pa.schema([("path", pa.string()), ("at", pa.int64()), ("length", pa.int64())]))

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def fetch(batches):
        fs, _ = filesystem(uri)
        for b in batches:
            for path, at, length in zip(*(b.column(c).to_pylist() for c in ("path", "at", "length")), strict=True):
                with fs.open_input_file(path) as f:
                    raw, found = f.read_at(length, at), []
                while raw:
                    z = zlib.decompressobj(31)
                    found.append(parse_record(z.decompress(raw)))
                    raw = z.unused_data
                yield pa.RecordBatch.from_pylist(found, schema)

    spark = ship(manifest.sparkSession)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = manifest.repartition(n, "path").mapInArrow(plan, "path string, at long, length long")
    return ranges.repartition(n, "path", "at").mapInArrow(fetch, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: write_archives() and read_archives() of pages."""
    uri = shared_dir(spark, "warc")
    manifest = write_archives(table(spark, sf_dir, "pages"), uri)
    return read_archives(manifest, uri).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages
), q AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
SELECT page_id, n::bigint AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM q
"""
