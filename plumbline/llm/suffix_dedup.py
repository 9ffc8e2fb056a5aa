"""Removal of repeated byte strings by suffix arrays over shards.

A text's anchors (least hashes of 32-byte grams within each window of 100 bytes) route the
work: equal windows have equal anchors at equal offsets, so a repeated window belongs
to an anchor that occurs more than once. The windows of those anchors are dealt into shards
by anchor; each shard has its suffix array and common prefixes. An anchor with
more windows than a shard takes is cut into many, and their sorted windows are merged by
binary search.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import keyed, landed, salted, shared_dir, table
from .units import chunks

GRAM = 32
#: An anchor with more occurrences than these, and than this share of all, is dealt into several shards from the start.
HOT_ROWS, HOT_SHARE = 500, 1 / 2000


# --- suffix arrays ----------------------------------------------------------------------


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes at each position as one number, big-endian; zeros follow the end."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | padded[k : n + k]
    return key


def refined_ranks(key: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each position by its first `depth` bytes (zeros follow the end); equal strings have equal ranks. key: _words() of the bytes.

    Larsson and Sadakane's refinement: positions sorted by 8 bytes, then by pairs of
    ranks of twice the depth; a position alone in its group is never sorted again.
    """
    n = len(key)

    def numbered(order, new):
        """Ranks (first place of each group) of sorted positions, and which of them aren't alone."""
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(order)))
        return np.repeat(first, size), np.repeat(size > 1, size)

    order = np.argsort(key)
    place, tied = numbered(order, np.append(True, key[order][1:] != key[order][:-1]))
    rank = np.zeros(n + 1, np.int64)
    rank[order] = place + 1
    todo, done = order[tied], 8
    while done < depth and len(todo):
        step = min(done, depth - done)  # strings of `done` bytes at i and at i + step overlap if step < done
        nxt = rank[np.minimum(todo + step, n)]
        by = np.argsort(rank[todo] * (n + 1) + nxt)
        todo, nxt = todo[by], nxt[by]
        own = rank[todo]
        head = np.append(True, own[1:] != own[:-1])
        new = head | np.append(True, nxt[1:] != nxt[:-1])
        place, tied = numbered(todo, new)
        group = np.maximum.accumulate(np.where(head, np.arange(len(todo)), 0))
        rank[todo] = own + place - group
        todo, done = todo[tied], done + step
    return rank[:n]


def suffixes(key: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of the given starts (ascending) by `window` bytes, and the common prefix of each entry with the one before, `window` at most.

    Kasai's algorithm, all runs of 64 starts side by side: the prefix that a start shares with
    its predecessor is at most one byte shorter than that of the start before it, so
    comparison goes on where that one ended.
    """
    rank = refined_ranks(key, window)[starts]
    order = starts[np.argsort(rank * len(starts) + np.arange(len(starts)))]
    before = np.full(len(key) + 1, -1, np.int64)
    before[order[1:]] = order[:-1]
    kind = np.zeros(len(key) + 1, bool)
    kind[starts] = True
    padded = np.concatenate([key, np.zeros(window + 8, np.uint64)])
    common = np.zeros(len(key), np.int64)
    head = np.append(True, np.diff(starts) != 1)[: len(starts)]
    run = np.flatnonzero(head)
    place = np.arange(len(starts)) - np.repeat(run, np.diff(np.append(run, len(starts))))
    lanes = starts[place % 64 == 0]
    ends = np.append(np.flatnonzero(place % 64 == 0)[1:], len(starts))
    many = ends - np.flatnonzero(place % 64 == 0)
    shared = np.zeros(len(lanes), np.int64)
    for t in range(int(many.max(initial=0))):
        on = np.flatnonzero(many > t)
        i = lanes[on] + t
        j = before[i]
        if t:  # the lemma needs the predecessor's successor to be an entry, too
            last = before[i - 1]
            length = np.where((last >= 0) & kind[last + 1], np.maximum(shared[on] - 1, 0), 0)
            # A prefix cut off at `window` tells nothing of what follows: either that byte is equal, too, or all is compared anew.
            whole = np.flatnonzero((length == window - 1) & (shared[on] == window))
            same = key[i[whole] + window - 1] >> np.uint64(56) == key[last[whole] + window] >> np.uint64(56)
            length[whole] = np.where(same, window, 0)
        else:
            length = np.zeros(len(on), np.int64)
        length[j < 0] = 0
        todo = np.flatnonzero((j >= 0) & (length < window))
        while len(todo):
            x = padded[i[todo] + length[todo]] ^ padded[j[todo] + length[todo]]
            same = (x[:, None] < _LEADING).sum(axis=1)
            length[todo] += same
            todo = todo[(same == 8) & (length[todo] < window)]
        shared[on] = common[i] = np.minimum(length, window)
    return order, common[order]


#: A difference below the k-th of these leaves k + 1 leading bytes equal.
_LEADING = np.array([1 << (56 - 8 * k) for k in range(8)], np.uint64)


def repeated_starts(parts: list[bytes], window: int) -> list[np.ndarray]:
    """For each part, in order: which starts of `window` bytes repeat one of an earlier part, or an earlier start of it."""
    sizes = np.array([len(x) for x in parts], np.int64)
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum(sizes)
    at = np.arange(len(data))
    later = np.zeros(len(data), bool)
    starts = at[at + window <= np.repeat(ends, sizes)]
    if len(starts):
        order, common = suffixes(_words(data), starts, window)
        later[order[1:]] = common[1:] >= window  # of equal entries the first has the least position
    return np.split(later, ends[:-1])


# --- anchors ----------------------------------------------------------------------------


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """best of x[i : i + width] for each i; the end is padded by the last values."""
    k = 1
    while 2 * k <= width:
        x = best(x, np.append(x[k:], x[-k:])[: len(x)])
        k *= 2
    rest = width - k
    return best(x, np.append(x[rest:], x[len(x) - rest :])[: len(x)]) if rest else x


def anchors(data: np.ndarray, sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of texts that lie end to end, and the first and last start of the windows that are theirs.

    A gram is an anchor if its hash is the least of a whole window's grams. A window belongs
    to the first of those, so equal windows have equal anchors at equal offsets.
    """
    if len(data) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, power, k = data.astype(np.uint64) + np.uint64(1), np.uint64(0x9E3779B97F4A7C15), 1
    while k < GRAM:
        with np.errstate(over="ignore"):
            h = h * power + np.append(h[k:], np.zeros(k, np.uint64))
            power = power * power
        k *= 2
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) | np.uint64(1)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))
    most = np.uint64(2**64 - 1)
    least = _slide(np.where(left >= GRAM, h, most), window - GRAM + 1, np.minimum)
    least[left < window] = 0
    held = _slide(least[::-1], window - GRAM + 1, np.maximum)[::-1]
    at = np.flatnonzero((held == h) & (left >= GRAM))
    h, reach, ends = h[at], window - GRAM, np.cumsum(sizes)
    text = np.searchsorted(ends, at, "right")
    # An anchor's windows end before the next lesser one, and begin after the last one that isn't greater.
    low, high = np.maximum(at - reach, (ends - sizes)[text]), np.minimum(at, ends[text] - window)
    for step, beats in ((-1, np.less_equal), (1, np.less)):
        todo, k = np.arange(len(at)), step
        while len(todo):
            todo = todo[(todo + k >= 0) & (todo + k < len(at))]
            other = todo + k
            near = np.abs(at[other] - at[todo]) <= reach
            todo, other = todo[near], other[near]
            hit = beats(h[other], h[todo])
            if step < 0:
                low[todo[hit]] = np.maximum(low[todo[hit]], at[other[hit]] + 1)
            else:
                high[todo[hit]] = np.minimum(high[todo[hit]], at[other[hit]] - reach - 1)
            todo, k = todo[~hit], k + step
    own = low <= high
    return at[own], h[own], low[own], high[own]


# --- jobs -------------------------------------------------------------------------------


def _union(spans: np.ndarray) -> np.ndarray:
    """Maximal runs covered by [start, end) rows."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    top = np.maximum.accumulate(spans[:, 1])
    first = np.append(True, spans[1:, 0] > top[:-1])
    return np.stack([spans[first, 0], top[np.append(np.flatnonzero(first)[1:] - 1, len(spans) - 1)]], axis=1)


#: Kinds of anchor rows, in the low bits of pos: alone in its batch; tells that its anchor is shared; known to be shared.
ALONE, TELLS, KNOWN = 0, 1, 2


def _found(docs: DataFrame, window: int) -> DataFrame:
    """h, tag, pos of the anchors of all texts; pos packs the place, how far its windows reach from there, and the row's kind.

    Of an anchor that two texts or places of one batch share, the rows are known to be shared
    and needn't meet; one more row of it tells the others. So no anchor sends more than one
    row a batch to where it is counted, however many documents share it.
    """
    schema = pa.schema([("h", pa.int64()), ("tag", pa.int64()), ("pos", pa.int64())])

    def scan(batches):
        for b in (c for b in batches for c in chunks(b, "text", 2 << 20)):
            raw = [x.encode() for x in b.column("text").to_pylist()]
            sizes = np.array([len(x) for x in raw], np.int64)
            at, h, low, high = anchors(np.frombuffer(b"".join(raw), np.uint8), sizes, window)
            if not len(at):
                continue
            ends = np.cumsum(sizes)
            d = np.searchsorted(ends, at, "right")
            tag, h = b.column("tag").to_numpy()[d], h.view(np.int64)
            pos = (at - (ends - sizes)[d]) << 18 | (at - low) << 10 | (at - high) << 2
            order = np.argsort(h)
            first = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
            size = np.diff(np.append(first, len(h)))
            alone, some = order[first[size == 1]], order[np.repeat(size > 1, size)]
            some = some[np.lexsort((pos[some], tag[some], h[some]))]  # copies of a text are one
            x, y, z = h[some], tag[some], pos[some]
            some = some[np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (z[1:] != z[:-1]))[: len(some)]]
            first = np.flatnonzero(np.append(True, h[some][1:] != h[some][:-1]))[: len(some)]
            size = np.diff(np.append(first, len(some)))
            alone, told, known = np.append(alone, some[first[size == 1]]), some[first[size > 1]], some[np.repeat(size > 1, size)]
            rows = np.concatenate([alone, told, known])
            kind = np.repeat([ALONE, TELLS, KNOWN], [len(alone), len(told), len(known)])
            yield pa.RecordBatch.from_arrays([pa.array(h[rows]), pa.array(tag[rows]), pa.array(pos[rows] | kind)], schema=schema)

    return docs.select("text", "tag").mapInArrow(scan, "h long, tag long, pos long")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by h, tag, pos: those known to be shared once each, and the others whose anchor another row has, too."""
    last, kept = None, [np.zeros(0, np.int64)] * 3

    def out(h, tag, pos):
        return pa.RecordBatch.from_arrays([pa.array(tag), pa.array(pos >> 2), pa.array(h)], ["tag", "pos", "h"])

    def settled(h, tag, pos):
        once = np.append(True, (h[1:] != h[:-1]) | (tag[1:] != tag[:-1]) | (pos[1:] != pos[:-1]))
        h, tag, pos = h[once], tag[once], pos[once]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        size = np.diff(np.append(first, len(h)))
        told = np.maximum.reduceat(pos & 3, first) == TELLS
        keep = np.repeat((size > 1) | told, size) & (pos & 3 == ALONE)
        return out(h[keep], tag[keep], pos[keep])

    for b in batches:
        rows = [b.column(c).to_numpy() for c in ("h", "tag", "pos")]
        known = rows[2] & 3 == KNOWN
        if known.any():  # these stream by
            h, tag, pos = (x[known] for x in rows)
            once = np.append(last != (h[0], tag[0], pos[0]), (h[1:] != h[:-1]) | (tag[1:] != tag[:-1]) | (pos[1:] != pos[:-1]))
            last = (h[-1], tag[-1], pos[-1])
            yield out(h[once], tag[once], pos[once])
        rows = [np.append(x, y[~known]) for x, y in zip(kept, rows, strict=True)]
        # What has the last anchor waits for the next batch.
        cut = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
        if cut:
            yield settled(*(x[:cut] for x in rows))
        kept = [x[cut:] for x in rows]
    if len(kept[0]):
        yield settled(*kept)


def _bucketed(df: DataFrame, key: str, n: int) -> DataFrame:
    """df written to the shared folder in n buckets by key, and read back: a join on key needn't move it again."""
    spark, name = df.sparkSession, f"plumbline_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(n, key).option("path", shared_dir(spark, "suspects")).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay
    return out


_PIECE = pa.schema([("h", pa.int64()), ("salt", pa.int32()), ("late", pa.int32()), ("id", pa.int64()), ("tag", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("part", pa.binary())])


def _cut(window: int, hot: dict[int, int], most: int = 64 << 20):
    """suspects -> pieces: the bytes of runs of windows of each shared anchor, and (part null) runs that repeat an earlier piece of this task.

    hot: the number of shards of each frequent anchor.
    """

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), _PIECE.types, strict=True)], schema=_PIECE)

    def run(batches):
        seen: dict[tuple, tuple] = {}
        held = 0
        for b in batches:
            out: list[tuple] = []
            for late, i, tag, row, text, own in zip(*(b.column(c) for c in ("late", "id", "tag", "_row", "text", "anchors")), strict=True):
                raw, own = text.as_py().encode(), own.values
                pos, h = own.field("pos").to_numpy(), own.field("h").to_numpy()
                a, e = (pos >> 16) - (pos >> 8 & 255), (pos >> 16) - (pos & 255) + window
                order = np.lexsort((a, h))
                h, a, e = h[order], a[order], e[order]
                once = np.append(True, (h[1:] != h[:-1]) | (a[1:] != a[:-1]))[: len(h)]
                h, a, e = h[once], a[once], e[once]
                new = np.append(True, (h[1:] != h[:-1]) | (a[1:] != e[:-1] - window + 1))[: len(h)]
                first = np.flatnonzero(new)
                h, a, e = h[first].tolist(), a[first].tolist(), e[np.append(first[1:], len(h)) - 1].tolist()
                late, i, tag, row = late.as_py(), i.as_py(), tag.as_py(), row.as_py()
                for k, j, m in zip(h, a, e, strict=True):
                    piece, place = raw[j:m], (late, i, tag, j)
                    last = seen.get((k, piece))
                    if last is not None and last < place:
                        out.append((tag ^ j, 0, late, i, tag, row, j, m, None))
                        continue
                    if last is None:
                        held += len(piece) + 200
                    seen[k, piece] = place
                    n = hot.get(k, 1)
                    out.append((k, (tag % n) if n > 1 else 0, late, i, tag, row, j, m, piece))
                if len(out) >= 20_000:
                    yield batch(out)
                    out = []
                if held > most:
                    seen, held = {}, 0
            if out:
                yield batch(out)

    return run


_RUN = pa.schema([("cell", pa.int64()), ("tag", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("windows", pa.binary()), ("places", pa.binary())])
#: Of a window that waits for other shards: 16 bytes of its hash; its text's order, and where it stands.
_WINDOW = np.dtype([("a", "<u8"), ("b", "<u8")])
_PLACE = np.dtype([("late", "<i8"), ("id", "<i8"), ("tag", "<i8"), ("start", "<i8"), ("row", "<i8")])


def _shard(window: int, limit: int, hot: dict[int, int], cells: int):
    """Pieces sorted by anchor, shard and order -> spans (tag, row, start, end), and for anchors of several shards the sorted runs of windows that are new to one."""
    often = np.sort(np.array(list(hot), np.int64))
    columns = _PIECE.names[:-1]

    def close(x: dict[str, np.ndarray], parts: list, split: list[int]):
        order = np.lexsort((x["start"], x["tag"], x["id"], x["late"], x["h"]))  # shards of one anchor may have met again
        x, parts = {c: v[order] for c, v in x.items()}, [parts[k] for k in order.tolist()]
        first: dict[tuple, int] = {}
        new = np.array([p is not None and first.setdefault((h, p), k) == k for k, (h, p) in enumerate(zip(x["h"].tolist(), parts, strict=True))], bool)
        spans = [[x[c][~new] for c in ("tag", "row", "start", "end")]]  # an earlier piece's bytes: all of it is a repeat
        x, parts = {c: v[new] for c, v in x.items()}, [p for p, k in zip(parts, new.tolist(), strict=True) if k]
        runs = []
        if parts:
            later = np.concatenate(repeated_starts(parts, window))
            sizes = np.array([len(p) for p in parts], np.int64)
            begin = np.cumsum(sizes) - sizes
            at = np.flatnonzero(later)
            piece = np.searchsorted(begin, at, "right") - 1
            head = np.flatnonzero(np.append(True, (piece[1:] != piece[:-1]) | (at[1:] > at[:-1] + window)))[: len(at)]
            tail = np.append(head[1:], len(at))[: len(head)] - 1
            place = x["start"][piece] + at - begin[piece]
            spans.append([x["tag"][piece[head]], x["row"][piece[head]], place[head], place[tail] + window])
            wait = np.isin(x["h"], split)
            if len(often):
                wait |= often[np.minimum(np.searchsorted(often, x["h"]), len(often) - 1)] == x["h"]
            fresh = np.repeat(wait, sizes) & ~later
            ends = np.repeat(begin + sizes, sizes)
            at = np.flatnonzero(fresh & (np.arange(len(fresh)) + window <= ends))
            if len(at):
                data, piece = b"".join(parts), np.searchsorted(begin, at, "right") - 1
                names = np.frombuffer(b"".join(hashlib.blake2b(data[i : i + window], digest_size=16).digest() for i in at.tolist()), _WINDOW)
                places = np.zeros(len(at), _PLACE)
                for c in _PLACE.names:
                    places[c] = x[c][piece]
                places["start"] += at - begin[piece]
                cell = (names["a"] % np.uint64(cells)).astype(np.int64)
                order = np.lexsort((names["b"], names["a"], cell))
                names, places, cell = names[order], places[order], cell[order]
                heads = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))[: len(cell)]
                runs = [(int(cell[i]), names[i:j].tobytes(), places[i:j].tobytes()) for i, j in zip(heads, np.append(heads[1:], len(cell)), strict=True)]
        flat = [np.concatenate(v) for v in zip(*spans, strict=True)]
        n, m = len(flat[0]), len(runs)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, -1)), *map(pa.array, flat), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], schema=_RUN)
        if m:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in runs]), *(pa.nulls(m, pa.int64()) for _ in range(4)), *(pa.array([r[k] for r in runs], pa.binary()) for k in (1, 2))], schema=_RUN)

    def run(batches):
        x: dict[str, np.ndarray] = {c: np.zeros(0, np.int64) for c in columns}
        parts: list = []
        size, going = 0, None  # going: the anchor whose earlier part another shard has
        for b in batches:
            x = {c: np.append(x[c], b.column(c).to_numpy()) for c in columns}
            parts += (own := b.column("part").to_pylist())
            size += sum(len(p) for p in own if p is not None) + 100 * len(own)
            while size >= limit:
                change = np.flatnonzero((x["h"][1:] != x["h"][:-1]) | (x["salt"][1:] != x["salt"][:-1]))
                sizes = np.cumsum([100 + len(p or b"") for p in parts])
                # Whole anchors where they fit, else as much of the first one as does.
                k = int(change[max(np.searchsorted(sizes[change], limit, "right") - 1, 0)]) + 1 if len(change) else len(parts)
                more = sizes[k - 1] > 2 * limit
                if more or not len(change):
                    more, k = True, max(1, min(k, int(np.searchsorted(sizes, limit, "right"))))
                last = int(x["h"][k - 1])
                yield from close({c: v[:k] for c, v in x.items()}, parts[:k], [v for v in (going, last if more else None) if v is not None])
                going = last if more else None
                x, parts, size = {c: v[k:] for c, v in x.items()}, parts[k:], size - int(sizes[k - 1])
        if parts:
            yield from close(x, parts, [] if going is None else [going])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs of windows by cell -> tag, row, first and last start of the windows that another shard has under an earlier place.

    Each run is looked up by binary search in the windows of all runs of its cell.
    """

    def settle(runs):
        names = np.concatenate([np.frombuffer(w, _WINDOW) for w, _ in runs])
        places = np.concatenate([np.frombuffer(p, _PLACE) for _, p in runs])
        every = np.unique(names["a"])
        at = np.searchsorted(every, names["a"])
        order = np.lexsort((places["start"], places["tag"], places["id"], places["late"], names["b"], at))
        a, b = at[order], names["b"][order]
        later = order[np.append(False, (a[1:] == a[:-1]) & (b[1:] == b[:-1]))]
        x = places[later][np.lexsort((places["start"][later], places["tag"][later], places["row"][later]))]
        first = np.flatnonzero(np.append(True, (x["row"][1:] != x["row"][:-1]) | (x["tag"][1:] != x["tag"][:-1]) | (x["start"][1:] != x["start"][:-1] + 1)))[: len(x)]
        last = np.append(first[1:], len(x)) - 1
        return x["tag"][first], x["row"][first], x["start"][first], x["start"][last[: len(first)]]

    rows, last = [], None
    for b in batches:
        for cell, w, p in zip(*(b.column(c).to_pylist() for c in ("cell", "windows", "places")), strict=True):
            if rows and cell != last:
                yield settle(rows)
                rows = []
            rows.append((w, p))
            last = cell
    if rows:
        yield settle(rows)


def repeated_spans(df: DataFrame, window: int = 100, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 4 << 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, suspects, spans): digests of all rows, texts with repeated anchors, and their repeated runs.

    Of rows with equal texts only one is looked at further, under the smallest id; the
    others repeat it whole. Texts come in the order of their ids, null ids last, and of
    their digests where ids are equal or null. A shard takes whole anchors up to shard_bytes;
    an anchor with more, or one that is frequent everywhere, is cut into several, whose windows are merged.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = keyed(df).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), "_row")
    docs = docs.withColumn("digest", F.sha2("text", 256)).withColumn("tag", F.conv(F.substring("digest", 1, 15), 16, 10).cast("long"))
    dealt = _found(docs, window).repartition(n, F.expr(f"IF(pos & 3 = {KNOWN}, xxhash64(h, tag, pos), h)"))
    ties = dealt.sortWithinPartitions("h", "tag", "pos").mapInArrow(_shared, "tag long, pos long, h long")
    by_text = ties.groupBy("tag").agg(F.collect_list(F.struct("pos", "h")).alias("anchors"))
    firsts = docs.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("tag").alias("tag"), F.min("_row").alias("_row"))
    chosen = firsts.join(by_text, "tag").select(F.col("digest").alias("_digest"), "_row", "tag", F.col("doc_id").isNull().cast("int").alias("late"), F.coalesce("doc_id", F.lit(0)).alias("id"), "anchors")
    # Not by equality, or the digest would become a second key and the rows leave their buckets.
    suspects = _bucketed(docs.select("_row", "text", "digest").join(chosen, "_row").where("instr(digest, _digest) = 1").drop("_digest"), "_row", n)
    counts = suspects.select(F.explode("anchors.h").alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    total = suspects.agg(F.sum(F.size("anchors"))).first()[0] or 0
    most = max(HOT_ROWS, total * HOT_SHARE)  # so there are at most 1 / HOT_SHARE frequent anchors
    hot = {r["h"]: int(-(-r["n"] // most)) for r in counts.where(F.col("n") > most).collect()}
    pieces = suspects.select("late", "id", "tag", "_row", "text", "anchors").mapInArrow(_cut(window, hot), "h long, salt int, late int, id long, tag long, row long, start long, end long, part binary")
    dealt = pieces.repartition(n, "h", "salt").sortWithinPartitions("h", "salt", "late", "id", "tag", "start")
    runs = landed(dealt.mapInArrow(_shard(window, shard_bytes, hot, 16 * n), "cell long, tag long, row long, start long, end long, windows binary, places binary"), "spans")

    def merged(batches):
        for tag, row, start, last in _merged(batches):
            yield pa.RecordBatch.from_arrays([pa.array(tag), pa.array(row), pa.array(start), pa.array(last + window)], ["tag", "row", "start", "end"])

    waiting = runs.where("cell >= 0").select("cell", "windows", "places").repartition(n, "cell").sortWithinPartitions("cell")
    spans = runs.where("cell < 0").select("tag", "row", "start", "end").unionByName(waiting.mapInArrow(merged, "tag long, row long, start long, end long"))
    return docs, suspects, spans


def remove_repeats(df: DataFrame, window: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each byte of a window-byte string that also starts earlier (smaller id, or same text, earlier).

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, one row per input row. Strings
    are judged on the input and never cross texts.

    Defined cases: a null text is empty; texts under `window` bytes stay; null ids come after
    all others, in the order of their texts' digests, and of null-id rows with one text all but one
    are copies; texts that repeat an id come in that order too; rows with one id and one text are one
    document, judged alike; an empty table gives no rows; other columns are ignored.
    """
    docs, suspects, spans = repeated_spans(df, window, id_col, text_col)
    by_text = spans.groupBy("row").agg(F.collect_list(F.struct("tag", "start", "end")).alias("spans")).withColumnRenamed("row", "_row")

    def finish(batches):
        for b in batches:
            out = []
            for digest, tag, text, own in zip(*(b.column(c) for c in ("digest", "tag", "text", "spans")), strict=True):
                raw, own = text.as_py().encode(), own.values
                rows = np.stack([own.field("start").to_numpy(), own.field("end").to_numpy()], axis=1)
                runs = _union(rows[own.field("tag").to_numpy() == tag.as_py()])
                kept, at = hashlib.sha256(), 0
                for i, j in runs.tolist():
                    kept.update(raw[at:i])
                    at = j
                kept.update(raw[at:])
                out.append((digest.as_py(), int((runs[:, 1] - runs[:, 0]).sum()), len(runs), kept.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], ["digest", "n_removed", "n_spans", "kept_sha256"])

    cut = suspects.select("_row", "tag", "digest", "text").join(by_text, "_row").mapInArrow(finish, "digest string, n_removed long, n_spans long, kept_sha256 string")
    rows = docs.select("doc_id", "digest", "_row", F.octet_length("text").cast("long").alias("n_bytes"), F.pmod("_row", F.lit(32)).alias("salt"))
    firsts = salted(rows, ["digest"], "salt", {"first_id": (F.min("doc_id"), F.min("first_id")), "first_row": (F.min("_row"), F.min("first_row"))}).join(cut, "digest", "left")
    first = F.when(F.col("first_id").isNull(), F.col("_row") == F.col("first_row")).otherwise(F.col("doc_id").eqNullSafe(F.col("first_id")))
    copy = (F.col("n_bytes") >= window) & ~first
    return rows.join(firsts, ["digest", "salt"]).select(
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"),
    )


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: remove_repeats() of documents."""
    return remove_repeats(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, sha256(coalesce(text, ''))) AS o, doc_id, coalesce(text, '') AS t, strlen(coalesce(text, ''))::bigint AS n,
         hex(encode(coalesce(text, ''))) AS h
  FROM documents
), w AS (SELECT o, s, md5(substr(h, 2 * s + 1, 200)) AS k FROM (SELECT o, h, unnest(range(0, n - 99)) AS s FROM d)),
l AS (SELECT o, s FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY o, s) > 1),
i AS (SELECT o, s, sum(new) OVER (PARTITION BY o ORDER BY s) AS run FROM (SELECT o, s, CASE WHEN s <= lag(s) OVER (PARTITION BY o ORDER BY s) + 100 THEN 0 ELSE 1 END AS new FROM l)),
r AS (SELECT o, min(s) AS a, max(s) + 100 AS e FROM i GROUP BY o, run),
c AS (
  SELECT o, sum(e - a)::bigint AS n_removed, count(*) AS n_spans, max(e) AS last, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS before
  FROM (SELECT o, a, e, coalesce(lag(e) OVER (PARTITION BY o ORDER BY a), 0) AS p FROM r) JOIN d USING (o) GROUP BY o
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::bigint AS n_removed, coalesce(n_spans, 0)::bigint AS n_spans,
       CASE WHEN n_spans IS NULL THEN sha256(t) ELSE sha256(unhex(before || substr(h, 2 * last + 1))) END AS kept_sha256
FROM d LEFT JOIN c USING (o)
"""
