"""Texts as sequences of units (a space and what follows it), each encoded once.

Token boundaries fall between units, so a text's ids are its units' ids in turn. A
worker keeps a bounded dictionary of units; only units new to it are encoded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class _Index(dict):
    """Gives each new key the next number and lists the new keys."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key):
        self[key] = n = len(self)
        self.new.append(key)
        return n


class UnitEncoder:
    """encode(list of units) -> (flat ids, number of ids of each); most: units kept before it starts anew."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 300_000):
        self.encode, self.most = encode, most
        self._clear()

    def _clear(self):
        self.index, self.ids, self.start, self.size = _Index(), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def __call__(self, texts: Iterable[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts (each a list of units) and the number of ids of each text."""
        if len(self.index) > self.most:
            self._clear()
        count: list[int] = []

        def counted():
            for units in texts:
                count.append(len(units))
                yield units

        flat = np.fromiter(map(self.index.__getitem__, chain.from_iterable(counted())), np.int32)
        if new := self.index.new:
            ids, size = self.encode(new)
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
            self.ids, self.size = np.concatenate([self.ids, ids]).astype(np.int32), np.concatenate([self.size, size]).astype(np.int32)
            self.index.new = []
        n = np.array(count, np.int64)
        size = self.size[flat]
        ends = np.cumsum(size, dtype=np.int64)
        ids = self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[flat] - ends + size, size)]
        bounds = np.concatenate([[0], np.cumsum(n)])
        ends = np.concatenate([[0], ends])
        return ids, np.diff(ends[bounds])


def chunks(batch: pa.RecordBatch, text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of text, a row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end
