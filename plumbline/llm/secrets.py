"""Secret scans: fixed patterns, and automata inferred from the credentials they find."""

from __future__ import annotations

import hashlib
import re
import zlib
from math import inf, log, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import landed, sampled, table

#: Fixed patterns, in the order of kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "learned"]
#: What may be a credential that no pattern names: a run of these with a digit and a letter.
CANDIDATE, RUN, DIGIT, LETTER = re.compile(r"[A-Za-z0-9+/_=-]{16,}"), re.compile(r"[A-Za-z0-9+/_=-]{5,}"), re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
#: Runs of more characters train no automaton (candidates of any length are scored).
LONGEST = 128


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, value start, value end) of the fixed patterns, in order.

    Each pattern's matches are leftmost and don't overlap; runs of the other two
    kinds are maximal, so asking for their least length at once changes nothing.
    """
    found = [(m.start(), 0, m.end(), m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start(), m.end()) for m in ACCESS.finditer(text)]
    if DIGIT.search(text) or HEX.search(text):
        found += [(m.start(), 2, m.end(), m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found)


# --- automata ---------------------------------------------------------------------------

_CLASS = {c: "U" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"} | {c: "l" for c in "ghijklmnopqrstuvwxyz"} | {c: "h" for c in "abcdef"} | {c: "d" for c in "0123456789"}
_WITHIN = {"U": log(26), "l": log(20), "h": log(6), "d": log(10)}


def classes(value: str) -> str:
    """A value's characters by class: U upper, l and h lower (h also a hex digit), d digit, others themselves."""
    return "".join(_CLASS.get(c, c) for c in value)


class Automaton:
    """A probabilistic automaton learnt by merging compatible states of a prefix tree.

    Two states are compatible if, by Hoeffding's bound at level alpha, they end and go on by
    each symbol equally often, and so do their successors in turn. States of the same depth
    are merged first, layer by layer; that gathers the counts of sparse branches and
    keeps length and order. States of different depth are merged afterwards, and only
    if both were seen `least` times: few observations agree with anything.
    """

    def __init__(self, values: list[str], alpha: float = 0.05, least: int = 50):
        self.next: list[dict[str, int]] = [{}]
        self.flow: list[dict[str, int]] = [{}]
        self.stop, self.seen = [0], [0]
        layers: list[list[int]] = [[0]]
        for v in values:
            s = 0
            self.seen[0] += 1
            for depth, c in enumerate(classes(v), 1):
                if c not in self.next[s]:
                    self.next[s][c] = len(self.next)
                    if depth == len(layers):
                        layers.append([])
                    layers[depth].append(len(self.next))
                    self.next.append({})
                    self.flow.append({})
                    self.stop.append(0)
                    self.seen.append(0)
                self.flow[s][c] = self.flow[s].get(c, 0) + 1
                s = self.next[s][c]
                self.seen[s] += 1
            self.stop[s] += 1
        self.parent = list(range(len(self.next)))
        self.bound = sqrt(0.5 * log(2 / alpha))
        kept: list[int] = []
        for layer in layers:
            own: list[int] = []
            for q in sorted({self.find(x) for x in layer}, key=lambda x: (-self.seen[x], x)):
                if not any(self._merged(r, q) for r in own):
                    own.append(q)
            kept += own
        strong: list[int] = []
        for q in kept:
            if self.seen[self.find(q)] >= least and not any(self._merged(r, q) for r in strong):
                strong.append(q)
        self.states = len({self.find(x) for x in kept})

    def find(self, s: int) -> int:
        while self.parent[s] != s:
            self.parent[s] = s = self.parent[self.parent[s]]
        return s

    def _alike(self, f1, n1, f2, n2) -> bool:
        return n1 == 0 or n2 == 0 or abs(f1 / n1 - f2 / n2) < self.bound * (1 / sqrt(n1) + 1 / sqrt(n2))

    def _merged(self, a: int, b: int) -> bool:
        """Merge two states, and with them their successors, if they are compatible."""
        a, b = self.find(a), self.find(b)
        todo, met = [(a, b)], set()
        while todo:
            x, y = todo.pop()
            if x == y or (x, y) in met:
                continue
            met.add((x, y))
            if not self._alike(self.stop[x], self.seen[x], self.stop[y], self.seen[y]):
                return False
            for c in self.flow[x].keys() | self.flow[y].keys():
                if not self._alike(self.flow[x].get(c, 0), self.seen[x], self.flow[y].get(c, 0), self.seen[y]):
                    return False
                if c in self.next[x] and c in self.next[y]:
                    todo.append((self.find(self.next[x][c]), self.find(self.next[y][c])))
        todo = [(a, b)]
        while todo:
            x, y = (self.find(s) for s in todo.pop())
            if x == y:
                continue
            self.parent[y] = x
            self.seen[x] += self.seen[y]
            self.stop[x] += self.stop[y]
            for c, n in self.flow[y].items():
                self.flow[x][c] = self.flow[x].get(c, 0) + n
                if c in self.next[x]:
                    todo.append((self.next[x][c], self.next[y][c]))
                else:
                    self.next[x][c] = self.next[y][c]
        return True

    def rate(self, value: str) -> float:
        """Log likelihood per character; -inf if the format isn't this one's."""
        s, total = 0, 0.0
        for c in classes(value):
            s = self.find(s)
            if c not in self.next[s]:
                return -inf
            total += log(self.flow[s][c] / self.seen[s]) - _WITHIN.get(c, 0.0)
            s = self.next[s][c]
        s = self.find(s)
        return (total + log(self.stop[s] / self.seen[s])) / (len(value) + 1) if self.stop[s] else -inf


class Formats:
    """Automata by kind, the least rate accepted of each, and a model of ordinary runs of the same characters."""

    def __init__(self, values: dict[int, list[str]], ordinary: list[str], margin: float = 0.25):
        self.margin = margin
        self.ordinary = Automaton(ordinary) if ordinary else None
        self.by_kind = []
        for _, v in sorted(values.items()):
            v = sorted({x for x in v if 16 <= len(x) <= LONGEST and DIGIT.search(x) and LETTER.search(x)})
            if len(v) >= 20:
                a = Automaton(v)
                self.by_kind.append((a, sorted(a.rate(x) for x in v)[len(v) // 20]))

    def accepts(self, value: str) -> bool:
        """True if a format explains the value as well as its own credentials, and better than ordinary runs' model does."""
        ordinary = self.ordinary.rate(value) if self.ordinary else -inf
        return any((rate := a.rate(value)) >= least and rate > ordinary + self.margin for a, least in self.by_kind)


# --- jobs -------------------------------------------------------------------------------


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_values: int = 1500) -> DataFrame:
    """doc_id, spans array of (kind, start, end) of each row's whole text, in order.

    The texts are read once: fixed patterns and candidates go to the shared folder. At most
    max_values credentials per kind and twice as many ordinary runs, the first by a hash, train the
    automata on the driver (the one bounded sample); every candidate is then scored.
    A candidate is a run of at least 16 of [A-Za-z0-9+/_=-] with a letter and a digit that doesn't
    lie wholly in a fixed pattern's match. Ordinary runs are shorter ones or ones without
    digits, from four hashed places of each whole text.

    Defined cases: offsets are code points, ends exclusive. A null or empty text has no spans; a null
    or repeated id is passed through, a row each; an empty table gives no rows; with fewer than 20
    different credentials of a kind it gets no automaton; other columns are ignored.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())])
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(span)), ("ordinary", pa.list_(pa.string()))])

    def scan(batches):
        for b in batches:
            out, ordinary = [], []
            for text in b.column("text").to_pylist():
                found = base_spans(text)
                got = [{"kind": k, "start": s, "end": e, "value": text[vs:ve]} for s, k, e, vs, ve in found]
                if DIGIT.search(text):
                    for m in CANDIDATE.finditer(text):
                        if DIGIT.search(m[0]) and LETTER.search(m[0]) and not any(s <= m.start() and m.end() <= e for s, _, e, _, _ in found):
                            got.append({"kind": 3, "start": m.start(), "end": m.end(), "value": m[0]})
                out.append(got)
                words = text.split()
                seed = zlib.crc32(text.encode("utf-8", "replace"))
                picked = (m[0] for k in range(4) if words for m in RUN.finditer(words[(seed * (2 * k + 1) >> k) % len(words)]))
                ordinary.append([x for x in picked if len(x) <= LONGEST and (len(x) < 16 or not DIGIT.search(x)) and not base_spans(x)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, schema.field("spans").type), pa.array(ordinary, pa.list_(pa.string()))], schema=schema)

    seen = landed(rows.mapInArrow(scan, "doc_id long, spans array<struct<kind: int, start: int, end: int, value: string>>, ordinary array<string>"), "secrets")
    each = seen.select(F.explode("spans").alias("s")).select("s.kind", "s.value").where("kind < 3").distinct()
    values = {k: [r["value"] for r in sampled(each.where(F.col("kind") == k), max_values, "value").collect()] for k in range(3)}
    runs = seen.select(F.explode("ordinary").alias("run")).distinct()
    ordinary = [r["run"] for some in (runs.where("run RLIKE '[0-9]'"), runs.where("run NOT RLIKE '[0-9]'")) for r in sampled(some, max_values, "run").collect()]
    formats = Formats(values, sorted(ordinary))
    final = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))])

    def score(batches):
        for b in batches:
            out = []
            for spans in b.column("spans").to_pylist():
                kept = [x for x in spans if x["kind"] < 3 or formats.accepts(x["value"])]
                kept.sort(key=lambda x: (x["start"], x["kind"]))
                out.append([{"kind": KINDS[x["kind"]], "start": x["start"], "end": x["end"]} for x in kept])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, final.field("spans").type)], schema=final)

    return seen.select("doc_id", "spans").mapInArrow(score, "doc_id long, spans array<struct<kind: string, start: int, end: int>>")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: find_secrets(), counted by kind and as text."""
    listed = "array_join(transform({}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"
    count = "cast(size(filter(spans, x -> x.kind = '{}')) AS bigint)"
    return find_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *(F.expr(count.format(k)).alias(f"n_{k}") for k in KINDS[:3]),
        F.expr(f"sha2({listed.format('filter(spans, y -> y.kind <> "learned")')}, 256)").alias("base_sha256"),
        F.expr(listed.format("spans")).alias("spans"),
    )


def base_digest(text: str) -> str:
    """base_sha256 of one text, for tests."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _, _ in base_spans(text)).encode()).hexdigest()
