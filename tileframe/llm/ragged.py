"""Lists of numbers by key, end to end in numpy, and a bounded memory of them for Arrow strings."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Remembered by a worker: so many distinct pieces and pretokens, of at most so many bytes each (some 20 MB in all).
MEMORY_KEYS = 400_000
MEMORY_BYTES = 8 << 20


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def spaced(keys: pa.Array) -> str:
    """The strings of a large_string array with one space between neighbours."""
    _, offsets, data = keys.buffers()
    at = np.frombuffer(offsets, "int64")[keys.offset : keys.offset + len(keys) + 1]
    if not at[-1]:
        return " " * (len(keys) - 1)
    return np.insert(np.frombuffer(data, "uint8")[at[0] : at[-1]], at[1:-1] - at[0], 32).tobytes().decode()


class Lists:
    """A list of numbers for each key, laid end to end; ``flat`` is None where only lengths are wanted."""

    def __init__(self, lengths: np.ndarray, flat: np.ndarray | None):
        self.lengths, self.flat = lengths, flat
        self.starts = np.cumsum(lengths) - lengths

    def take(self, at: np.ndarray) -> Lists:
        lengths = self.lengths[at]
        return Lists(lengths, None if self.flat is None else self.flat[ragged(self.starts[at], lengths)])

    def joined(self, owner: np.ndarray, n: int) -> Lists:
        """The lists of neighbours with the same owner (0 to n - 1, ascending) as one list for each owner."""
        return Lists(np.bincount(owner, self.lengths, n).astype("int64"), self.flat)

    def __add__(self, other: Lists) -> Lists:
        return Lists(np.concatenate([self.lengths, other.lengths]), None if self.flat is None else np.concatenate([self.flat, other.flat]))


class Memory:
    """What keys were encoded to. When full, keys that came up only once make room, then the less recent half."""

    def __init__(self, encode: Callable[[pa.Array], Lists], empty: Lists):
        self.encode, self.lists = encode, empty
        self.keys, self.hits = pa.array([], pa.large_string()), np.empty(0, "int64")

    def get(self, keys: pa.Array) -> Lists:
        """Of distinct keys."""
        at = pc.index_in(keys, value_set=self.keys).fill_null(-1).to_numpy()
        new = at < 0
        self.hits[at[~new]] += 1
        if not new.any():
            return self.lists.take(at)
        fresh_keys = keys.filter(pa.array(new))
        fresh = self.encode(fresh_keys)
        at = at.astype("int64")
        at[new] = len(self.keys) + np.arange(len(fresh_keys))
        every = self.lists + fresh
        out = every.take(at)
        self.keys, self.lists, self.hits = pa.concat_arrays([self.keys, fresh_keys]), every, np.concatenate([self.hits, np.ones(len(fresh_keys), "int64")])
        if len(self.keys) > MEMORY_KEYS or self.keys.nbytes > MEMORY_BYTES:
            self.forget()
        return out

    def forget(self) -> None:
        stay = np.flatnonzero(self.hits > 1)
        sizes = pc.binary_length(self.keys).to_numpy()
        if 2 * len(stay) > MEMORY_KEYS or 2 * sizes[stay].sum() > MEMORY_BYTES:
            stay = stay[len(stay) // 2 :]
            stay = stay[np.cumsum(sizes[stay][::-1])[::-1] <= MEMORY_BYTES // 2]
        self.keys, self.lists, self.hits = self.keys.take(pa.array(stay)), self.lists.take(stay), self.hits[stay] // 2
