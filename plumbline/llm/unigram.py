"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces."""

from __future__ import annotations

import struct
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table
from .units import UnitEncoder, chunks

MARK = "▁"
#: Types of pieces in a model file.
NORMAL, USER, BYTE = 1, 4, 6
#: Stands for a marker character that is part of a text: no piece has it, so its bytes fall back, as the marker's own.
LITERAL, MARK_BYTES = "\udfff", MARK.encode()
LITERAL_BYTES = LITERAL.encode("utf-8", "surrogatepass")
#: Units of more bytes are encoded in steps of so many, with the paths carried on.
LONG = 1 << 16
#: Units whose paths grow side by side.
AT_ONCE = 20_000
#: Below the least score of any piece, for characters that no piece covers.
UNKNOWN_PENALTY = 10.0


def _fields(raw: bytes):
    """(number, value) of a message's fields; varints as ints, the rest as bytes."""
    p = 0

    def varint():
        nonlocal p
        n = shift = 0
        while True:
            b = raw[p]
            p += 1
            n |= (b & 127) << shift
            if b < 128:
                return n
            shift += 7

    while p < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, raw[p : p + n]
        p += n


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) by id, from a model file."""
    found = []
    with open(path, "rb") as f:
        for k, v in _fields(f.read()):
            if k == 1:
                x = dict(_fields(v))
                found.append((x.get(1, b"").decode(), struct.unpack("<f", x[2])[0] if 2 in x else 0.0, x.get(3, NORMAL)))
    return found


def rank_scores(pieces: list[tuple[str, float, int]]) -> np.ndarray:
    """Log scores of the normal pieces by Zipf's law of their rank; other pieces score 0.

    For files that list pieces by merge order with no probabilities.
    """
    out, rank = np.zeros(len(pieces)), 0
    total = np.log(np.sum(1 / np.arange(1, 1 + sum(t in (NORMAL, USER) for _, _, t in pieces))))
    for i, (_, _, kind) in enumerate(pieces):
        if kind in (NORMAL, USER):
            rank += 1
            out[i] = -np.log(rank) - total
    return out


@dataclass
class DoubleArray:
    """State s goes by byte c to base[s] + c if check there is s; value is a piece id, or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @classmethod
    def build(cls, keys: dict[bytes, int]) -> DoubleArray:
        children: list[dict[int, int]] = [{}]
        ids = [-1]
        for key, i in keys.items():
            node = 0
            for c in key:
                nxt = children[node].get(c)
                if nxt is None:
                    nxt = children[node][c] = len(children)
                    children.append({})
                    ids.append(-1)
                node = nxt
            ids[node] = i
        size = 6 * len(children) + 2048
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used, first, wide, place = bytearray(size), 1, 1, {0: 0}
        used[0] = 1
        for node in range(len(children)):  # parents come before children
            kids, s = children[node], place.pop(node)
            value[s] = ids[node]
            if not kids:
                base[s] = size - 512  # leads to cells that are nobody's
                continue
            codes = list(kids)
            if len(codes) == 1:  # any free cell does; these fill the gaps that the others leave
                while used[first] or first < codes[0]:
                    first += 1
                b = first - codes[0]
            else:
                b = max(wide - min(codes), 0)
                tries = 0
                while any(used[b + c] for c in codes):
                    b += 1
                    tries += 1
                wide += tries // 16
            base[s] = b
            for c in codes:
                used[b + c], check[b + c], place[kids[c]] = 1, s, b + c
        return cls(base, check, value)


class Model:
    """Pieces with log scores; encode() and decode() of many texts at once."""

    def __init__(self, pieces: list[tuple[str, float, int]], scores: np.ndarray):
        if any(a != MARK and b == MARK for p, _, t in pieces if t in (NORMAL, USER) for a, b in zip(p, p[1:], strict=False)):
            raise ValueError("a piece has a whitespace marker after another character: texts can't be cut into units")
        whole = {p.encode(): i for i, (p, _, t) in enumerate(pieces) if t in (NORMAL, USER)}
        self.trie, self.scores, self.longest = DoubleArray.build(whole), scores, max(map(len, whole))
        self.unknown = min(scores[i] for i in whole.values()) - UNKNOWN_PENALTY
        self.bytes = np.full(256, -1, np.int32)
        text = []
        for i, (p, _, t) in enumerate(pieces):
            if t == BYTE:
                self.bytes[int(p[3:5], 16)] = i
            text.append(bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(MARK, " ").encode() if t in (NORMAL, USER) else b"")
        if (self.bytes < 0).any():
            raise ValueError("byte fallback needs all 256 byte pieces")
        self.size = np.array([len(x) for x in text])
        self.start, self.pool = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(text), np.uint8)

    def matches(self, data: np.ndarray, stop: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, bytes and piece of each match from the places `lead`; a character that no piece covers matches alone as piece -1. stop: where each place's unit ends."""
        at, state, found = lead, np.zeros(len(lead), np.int32), []
        width = np.where(data < 0x80, 1, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, 4)))
        covered = np.zeros(len(data), bool)
        for k in range(self.longest):
            inside = at + k < stop[at]
            at, state = at[inside], state[inside]
            if not len(at):
                break
            nxt = self.trie.base[state] + data[at + k]
            ok = self.trie.check[nxt] == state
            at, state = at[ok], nxt[ok]
            hit = self.trie.value[state] >= 0
            found.append((at[hit], np.full(hit.sum(), k + 1), self.trie.value[state[hit]]))
            covered[at[hit & (width[at] == k + 1)]] = True
        bare = lead[~covered[lead]]
        found.append((bare, width[bare], np.full(len(bare), -1)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def encode_long(self, raw: bytes) -> np.ndarray:
        """The ids of one unit of any length: matches are looked up LONG starts at a time, the best paths are carried on. The same as encode_units()."""
        data = np.frombuffer(raw, np.uint8)
        best, back, piece = np.full(len(raw) + 1, -np.inf), np.zeros(len(raw) + 1, np.int32), np.zeros(len(raw) + 1, np.int32)
        best[0] = 0
        for p in range(0, len(raw), LONG):
            part = data[p : p + LONG + self.longest + 4]
            lead = np.flatnonzero((part[:LONG] & 0xC0) != 0x80)
            a, size, ids = self.matches(part, np.full(len(part), len(part)), lead)
            order = np.argsort(a, kind="stable")
            score = np.where(ids >= 0, self.scores[ids], self.unknown)[order].tolist()
            ahead, prev, via = best[p : p + len(part) + 1].tolist(), {}, {}
            for i, n, s, k in zip(a[order].tolist(), size[order].tolist(), score, ids[order].tolist(), strict=True):
                if (x := ahead[i] + s) > ahead[i + n]:
                    ahead[i + n], prev[i + n], via[i + n] = x, p + i, k
            best[p : p + len(part) + 1] = ahead
            to = p + np.fromiter(prev, np.int64, len(prev))
            back[to], piece[to] = list(prev.values()), list(via.values())
        out, j, emit = [], len(raw), raw.replace(LITERAL_BYTES, MARK_BYTES)
        while j:
            i = int(back[j])
            out.append([int(piece[j])] if piece[j] >= 0 else self.bytes[np.frombuffer(emit[i:j], np.uint8)].tolist())
            j = i
        return np.array([x for ids in reversed(out) for x in ids], np.int32)

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Best segmentation of each unit (spaces already marked): flat ids and the number of each.

        Matches of all units are found by walking the trie from every character at
        once; the best paths then grow by start offset, all units side by side.
        """
        raw = [u.encode("utf-8", "surrogatepass") for u in units]
        if any(len(x) > LONG for x in raw):
            parts = [self.encode_long(x) if len(x) > LONG else self.encode_units([u])[0] for u, x in zip(units, raw, strict=True)]
            return np.concatenate(parts), np.array([len(x) for x in parts], np.int32)
        n = np.array([len(x) for x in raw], np.int64)
        data, unit = np.frombuffer(b"".join(raw), np.uint8), np.repeat(np.arange(len(n)), n)
        emit = np.frombuffer(b"".join(raw).replace(LITERAL_BYTES, MARK_BYTES), np.uint8)
        first = np.cumsum(n) - n
        a, size, ids = self.matches(data, (first + n)[unit], np.flatnonzero((data & 0xC0) != 0x80))
        offset = a - first[unit[a]]
        order = np.argsort(offset, kind="stable")
        a, size, ids, offset = a[order], size[order], ids[order], offset[order]
        score = np.where(ids >= 0, self.scores[ids], self.unknown)
        src = a + unit[a]  # a unit of n bytes has n + 1 places
        dst = src + size
        best, back = np.full(len(data) + len(n), -np.inf), np.zeros(len(data) + len(n), np.int64)
        best[first + np.arange(len(n))] = 0
        cuts = np.append(np.flatnonzero(np.diff(offset, prepend=-1)), len(offset))
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            path = best[src[i:j]] + score[i:j]
            # Of ties to one place within this step there are none: an offset's matches differ in length.
            better = path > best[dst[i:j]]
            to = dst[i:j][better]
            best[to], back[to] = path[better], i + np.flatnonzero(better)
        who = np.flatnonzero(n > 0)
        place, start = (first + np.arange(len(n)) + n)[who], (first + np.arange(len(n)))[who]
        steps = []
        while len(who):
            m = back[place]
            steps.append((who, m))
            place = src[m]
            on = place > start
            who, place, start = who[on], place[on], start[on]
        if not steps:
            return np.zeros(0, np.int32), np.zeros(len(n), np.int32)
        who, m = np.concatenate([x for x, _ in steps]), np.concatenate([x for _, x in steps])
        m = m[np.lexsort((a[m], who))]
        many = np.where(ids[m] >= 0, 1, size[m])
        ends = np.cumsum(many)
        part = np.arange(ends[-1]) - np.repeat(ends - many, many)
        out = np.where(np.repeat(ids[m], many) >= 0, np.repeat(ids[m], many), self.bytes[emit[np.repeat(a[m], many) + part]])
        return out.astype(np.int32), np.bincount(unit[a[m]], many, len(n)).astype(np.int32)

    def encoder(self):
        """texts -> (flat ids, number of each), units of a space and what follows it encoded once each, so many at a time that their matches take little memory."""

        def encode(new: list[str]) -> tuple[np.ndarray, np.ndarray]:
            parts = [self.encode_units(new[i : i + AT_ONCE]) for i in range(0, len(new), AT_ONCE)]
            return np.concatenate([x for x, _ in parts]), np.concatenate([n for _, n in parts])

        cached = UnitEncoder(encode)

        def units(text: str) -> list[str]:
            if not text:
                return []
            marked = text.replace(MARK, LITERAL).replace(" ", MARK)
            parts = (MARK + marked).split(MARK)
            if "" not in parts[1:]:
                return [MARK + x for x in parts[1:]]
            out, run = [], 0  # runs of markers stay with what follows them
            for x in parts[1:]:
                run += 1
                if x:
                    out.append(MARK * run + x)
                    run = 0
            return [*out, MARK * run] if run else out

        return lambda texts: cached(map(units, texts))

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The UTF-8 texts of consecutive runs of ids: pieces joined, their markers as spaces, byte pieces as bytes, the first space dropped."""
        size = self.size[ids]
        ends = np.cumsum(size)
        data = self.pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[ids] - ends + size, size)].tobytes()
        bounds = np.append(0, ends)[np.append(0, np.cumsum(counts))].tolist()
        out = [data[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return [x[1:] if x[:1] == b" " else x for x in out]


@cache
def load(path: str) -> Model:
    """The model of a file; built once in a process."""
    pieces = read_pieces(path)
    return Model(pieces, rank_scores(pieces))


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, ids, round_trip of each row's whole text.

    round_trip: decoding the ids gives the text back, byte by byte; a marker character that is
    part of a text goes through byte fallback. Workers read the model file at `path`, one copy each.

    Defined cases: a null or empty text has no ids and round_trip true; a text without
    spaces may be of any length; a null or repeated id is passed through, a row each; an empty
    table gives no rows; other columns are ignored.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("n_byte_pieces", pa.int64()), ("ids", pa.list_(pa.int32())), ("round_trip", pa.bool_())])

    def run(batches):
        model = load(path)
        encode, is_byte = model.encoder(), np.zeros(len(model.size), bool)
        is_byte[model.bytes] = True
        for b in (c for b in batches for c in chunks(b, "text")):
            texts = b.column("text").to_pylist()
            ids, n = encode(texts)
            same = [x == t.encode() for x, t in zip(model.decode(ids, n), texts, strict=True)]
            fallback = np.diff(np.append(0, np.cumsum(is_byte[ids]))[np.append(0, np.cumsum(n))])
            lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(n)).astype(np.int32), ids)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(fallback, pa.int64()), lists, pa.array(same)], schema=schema)

    return rows.mapInArrow(run, "doc_id long, n_pieces long, n_byte_pieces long, ids array<int>, round_trip boolean")


def model_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: encode_documents() of documents, by the 32,000 piece model."""
    return encode_documents(table(spark, sf_dir, "documents"), model_path())
