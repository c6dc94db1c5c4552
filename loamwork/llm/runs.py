"""A log-structured index over fixed-width digests, in numpy.

Batches of (digest, payload) collect in a memtable. A full memtable is sorted
and each digest reduced to one entry. A ``RunIndex`` merges entries that an older run holds already
into that run's payload (a Bloom filter per run says which runs need
a binary search), and flushes the rest as a new run. So runs never share a
digest, and compaction, which joins the runs of a level into one of the next, is a plain merge.
A ``LogIndex`` never touches a run again: every memtable is flushed whole, and compaction is what reduces equal digests of several runs to one entry.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: (payload so far, payload that joins it) -> payload; both structured arrays of one length.
Combine = Callable[[np.ndarray, np.ndarray], np.ndarray]


class Bloom:
    """Bits set at places read off the digest itself, which is uniform already."""

    def __init__(self, keys: np.ndarray, bits_per_key: int = 10, size: int | None = None):
        self.size = size or max(64, len(keys) * bits_per_key)
        self.bits = np.zeros(self.size // 8 + 1, np.uint8)
        for place in self._places(keys):
            np.bitwise_or.at(self.bits, place >> 3, np.left_shift(1, place & 7).astype(np.uint8))

    @classmethod
    def of(cls, bits: np.ndarray, size: int) -> Bloom:
        out = cls.__new__(cls)
        out.bits, out.size = bits, size
        return out

    def _places(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        parts = np.frombuffer(keys.tobytes(), np.uint32).reshape(len(keys), -1)
        for k in range(min(4, parts.shape[1])):
            yield (parts[:, k].astype(np.int64) * 2654435761 + k * 40503) % self.size

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for place in self._places(keys):
            found &= (self.bits[place >> 3] >> (place & 7)) & 1 == 1
        return found


class Run:
    def __init__(self, keys: np.ndarray, payload: np.ndarray):
        self.keys, self.payload, self.filter = keys, payload, Bloom(keys)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``keys`` that this run holds, and where it holds them."""
        asked = np.flatnonzero(self.filter.maybe(keys))
        at = np.searchsorted(self.keys, keys[asked])
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == keys[asked] if len(self.keys) else np.zeros(0, bool)
        return asked[hit], at[hit]


class RunIndex:
    """width: bytes of a digest, a multiple of 4. payload: numpy dtype of what an entry carries.

    memtable: entries that are held unsorted; fanout: runs of a level that are compacted into one.
    """

    def __init__(self, width: int, payload: np.dtype, combine: Combine, memtable: int = 200_000, fanout: int = 4):
        self.kind, self.dtype, self.combine = np.dtype(f"S{width}"), np.dtype(payload), combine
        self.capacity, self.fanout = memtable, fanout
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_held = 0
        self.levels: list[list[Run]] = []

    def add(self, keys: np.ndarray, payload: np.ndarray) -> None:
        self.held.append((keys, payload))
        self.n_held += len(keys)
        if self.n_held >= self.capacity:
            self.flush()

    def reduce(self, keys: np.ndarray, payload: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct digests; payloads of equal ones are combined by halving, so n of them take log n steps."""
        order = np.argsort(keys, kind="stable")
        keys, payload = keys[order], payload[order]
        while len(keys):
            first = np.ones(len(keys), bool)
            first[1:] = keys[1:] != keys[:-1]
            if first.all():
                break
            rank = np.arange(len(keys)) - np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))
            odd = np.flatnonzero(rank % 2)
            payload[odd - 1] = self.combine(payload[odd - 1], payload[odd])
            keys, payload = np.delete(keys, odd), np.delete(payload, odd)
        return keys, payload

    def flush(self) -> None:
        if not self.n_held:
            return
        keys, payload = self.reduce(np.concatenate([k for k, _ in self.held]), np.concatenate([p for _, p in self.held]))
        self.held, self.n_held = [], 0
        for level in self.levels:
            for run in level:
                mine, theirs = run.find(keys)
                if len(mine):
                    run.payload[theirs] = self.combine(run.payload[theirs], payload[mine])
                    keys, payload = np.delete(keys, mine), np.delete(payload, mine)
        if len(keys):
            self.place(Run(keys, payload), 0)

    def place(self, run: Run, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = self.merge(self.levels[level])
            self.levels[level] = []
            self.place(merged, level + 1)

    def merge(self, runs: list[Run]) -> Run:
        keys, payload = np.concatenate([r.keys for r in runs]), np.concatenate([r.payload for r in runs])
        order = np.argsort(keys, kind="stable")
        return Run(keys[order], payload[order])

    def compacted(self) -> tuple[np.ndarray, np.ndarray]:
        """All entries, sorted by digest."""
        self.flush()
        runs = [r for level in self.levels for r in level]
        if not runs:
            return np.zeros(0, self.kind), np.zeros(0, self.dtype)
        whole = runs[0] if len(runs) == 1 else self.merge(runs)
        self.levels = [[whole]]
        return whole.keys, whole.payload


class LogIndex(RunIndex):
    """Immutable runs. Compaction reduces: what it keeps of equal digests is up to ``combine``. A lookup asks the filters of all runs, the newest first."""

    def flush(self) -> None:
        if not self.n_held:
            return
        keys, payload = self.reduce(np.concatenate([k for k, _ in self.held]), np.concatenate([p for _, p in self.held]))
        self.held, self.n_held = [], 0
        for part in (keys, payload):
            part.flags.writeable = False
        self.place(Run(keys, payload), 0)

    def merge(self, runs: list[Run]) -> Run:
        keys, payload = np.concatenate([r.keys for r in runs]), np.concatenate([r.payload for r in runs])
        keys, payload = self.reduce(keys, payload)
        for part in (keys, payload):
            part.flags.writeable = False
        return Run(keys, payload)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key has been flushed, and its payload of all runs combined."""
        found, out = np.zeros(len(keys), bool), np.zeros(len(keys), self.dtype)
        for level in self.levels:
            for run in reversed(level):
                mine, theirs = run.find(keys)
                both = found[mine]
                out[mine[both]] = self.combine(out[mine[both]], run.payload[theirs[both]])
                out[mine[~both]] = run.payload[theirs[~both]]
                found[mine] = True
        return found, out
