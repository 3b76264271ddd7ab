"""What a Python worker remembers between batches, and between tasks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_made: dict[tuple, object] = {}


def once(kind: Callable[[str], object], source: str) -> object:
    """kind(source), made once in a worker and kept for the tasks that follow (of a few sources at most)."""
    key = kind, source
    if key not in _made:
        if len(_made) >= 4:
            _made.clear()
        _made[key] = kind(source)
    return _made[key]


class Memo(dict):
    """A dict of bounded size in two generations: what is found in the older one moves to the newer."""

    def __init__(self, size: int):
        super().__init__()
        self.half, self.older = size // 2, {}

    def find(self, keys: list) -> list:
        """The value of each key, None where there is none. The newer generation answers without a Python call a key."""
        found = list(map(self.get, keys))
        for i, x in enumerate(found):
            if x is None and (x := self.older.get(keys[i])) is not None:
                found[i] = self[keys[i]] = x
        return found

    def put(self, key, value):
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class Numbers:
    """Numbers 0, 1, 2 ... for 64-bit keys in order of arrival. A large sorted table and a small one of the latest keys, so that an arrival seldom rebuilds the large one."""

    def __init__(self):
        self.large = self.small = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def __len__(self) -> int:
        return len(self.large[0]) + len(self.small[0])

    @staticmethod
    def _look(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
        known, number = table
        if not len(known):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, number[at], -1).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key (all different; sorted keys are the fastest), -1 where there is none."""
        at = self._look(self.large, keys)
        rest = np.flatnonzero(at < 0)
        at[rest] = self._look(self.small, keys[rest])
        return at

    @staticmethod
    def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys, number = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
        order = np.argsort(keys, kind="stable")
        return keys[order], number[order]

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Numbers for keys that have none."""
        made = np.arange(len(self), len(self) + len(keys))
        self.small = self._merged(self.small, (keys, made.astype(np.int32)))
        if 4 * len(self.small[0]) > len(self.large[0]):
            self.large, self.small = self._merged(self.large, self.small), (keys[:0], made[:0].astype(np.int32))
        return made


class Flat:
    """A growing array of arrays, end to end."""

    def __init__(self, kind: str):
        self.begin, self.size, self.data, self.used, self.n = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, kind), 0, 0

    def extend(self, data: np.ndarray, size: np.ndarray) -> None:
        """Adds arrays that lie end to end in data."""
        n, used = self.n + len(size), self.used + len(data)
        if n > len(self.begin):
            self.begin, self.size = np.resize(self.begin, 2 * n), np.resize(self.size, 2 * n)
        if used > len(self.data):
            self.data = np.resize(self.data, 2 * used)
        self.size[self.n : n], self.begin[self.n : n] = size, self.used + np.cumsum(size) - size
        self.data[self.used : used] = data
        self.n, self.used = n, used

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the rows `which`, end to end; where each begins, and the end)."""
        n = self.size[which]
        total = np.concatenate([[0], np.cumsum(n)])
        kind = np.int32 if self.used + total[-1] < 1 << 31 else np.int64  # places: the largest arrays here
        at = np.repeat((self.begin[which] - total[:-1]).astype(kind), n)
        at += np.arange(total[-1], dtype=kind)
        return self.data[at], total
