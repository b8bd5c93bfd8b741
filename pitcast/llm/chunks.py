"""Tables of distinct text chunks and their token ids, kept by a task or by its worker process."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable
from itertools import chain, repeat
from typing import Any

import numpy as np

#: Entries after which a table keeps only the chunks that it met most; results do not depend on it.
TABLE_LIMIT = 150_000
#: Chunks that the encoder sees at a time, as its answers are many times their size.
ENCODE_STEP = 4_096


class ChunkTable:
    """Encodes each distinct chunk once and joins ids back by position.

    ``encode`` returns the ids of each chunk, or a pair of arrays: all ids one after another, and the number of each chunk's.
    """

    def __init__(self, encode: Callable[[list], Iterable | tuple[np.ndarray, np.ndarray]], limit: int | None = None):
        self.encode = encode
        self.limit = limit or TABLE_LIMIT
        self.generation = 1
        self.rows: dict = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.starts, self.sizes, self.met = (np.zeros(1 << 12, np.int64) for _ in range(3))

    def shrink(self) -> None:
        """Keep the chunks met most and more than once, at most half of the limit; rows get new numbers."""
        n = len(self.rows)
        keep = np.argsort(-self.met[:n], kind="stable")[: self.limit // 2]
        keep = np.sort(keep[self.met[keep] > 1])
        ids, sizes = self.expand(keep)
        names = list(self.rows)
        self.generation += 1
        self.rows = {names[k]: row for row, k in enumerate(keep.tolist())}
        self.used = len(ids)
        self.ids[: self.used] = ids
        self.met[: len(keep)] = self.met[keep] // 2
        self.met[len(keep) :] = 0
        self.starts[: len(keep)], self.sizes[: len(keep)] = np.cumsum(sizes) - sizes, sizes

    def positions(self, chunks: list, times: np.ndarray | None = None) -> np.ndarray:
        """Table rows of ``chunks``, each met once or ``times``; unseen ones are encoded together first."""
        if len(self.rows) > self.limit:
            self.shrink()
        out = np.fromiter(map(self.rows.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(out < 0).tolist()
        fresh = list(dict.fromkeys([chunks[i] for i in missing]))
        for at in range(0, len(fresh), ENCODE_STEP):
            self._add(fresh[at : at + ENCODE_STEP], self.encode(fresh[at : at + ENCODE_STEP]))
        out[missing] = [self.rows[chunks[i]] for i in missing]
        self.met[: len(self.rows)] += np.bincount(out, times, len(self.rows)).astype(np.int64)
        return out

    def _add(self, chunks: list, encoded: Iterable | tuple[np.ndarray, np.ndarray]) -> None:
        if isinstance(encoded, tuple):
            ids, sizes = encoded
        else:
            encoded = list(encoded)
            sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
            ids = np.fromiter(chain.from_iterable(encoded), np.uint32, int(sizes.sum()))
        row = len(self.rows)
        ends = self.used + np.cumsum(sizes)
        while row + len(chunks) > len(self.starts):
            self.starts, self.sizes = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.sizes, 2 * len(self.sizes))
            self.met = np.concatenate((self.met, np.zeros(len(self.met), np.int64)))
        used = int(self.used + sizes.sum())
        while used > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used : used] = ids
        self.starts[row : row + len(chunks)], self.sizes[row : row + len(chunks)] = ends - sizes, sizes
        self.rows.update(zip(chunks, range(row, row + len(chunks))))
        self.used = used

    def expand(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows one after another, and the number of ids of each row."""
        sizes = self.sizes[rows]
        return ragged(self.ids, self.starts[rows], sizes), sizes


def ragged(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` one after another."""
    shift = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return values[shift + np.arange(len(shift))]


_kept: dict[Hashable, Any] = {}


def kept_table(name: Hashable, make: Callable[[], Any]) -> Any:
    """The table, with what else ``make`` gives, that this worker process keeps under ``name`` from task to task, which saves later tasks known chunks."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]
