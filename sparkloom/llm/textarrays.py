"""Texts as byte arrays: words, shingles and hashes of any span, worked out for a whole batch at once."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES, CHUNK_ROWS = 3 << 19, 1 << 15
BASE = 0x9E3779B97F4A7C15 | 1
_LOW = np.uint64(0xFFFFFFFFFFFFFFFF)


def chunks(batch: pa.RecordBatch, text: int, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text and CHUNK_ROWS rows at most each; one longer text is a slice of its own."""
    if not batch.num_rows:
        return
    ends = np.cumsum(np.diff(_offsets(batch.column(text))))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = min(max(at + 1, int(np.searchsorted(ends, base + most, "right"))), at + CHUNK_ROWS)
        yield batch.slice(at, to - at)
        at = to


def _offsets(column: pa.Array) -> np.ndarray:
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    raw = np.frombuffer(column.buffers()[1], width, column.offset + len(column) + 1)
    return raw[column.offset :].astype(np.int64)


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): the texts' UTF-8 one after another; nulls are empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = _offsets(column)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


@functools.cache
def _values() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** j and its inverse for j under n, modulo 2 ** 64; kept for the worker's next batch."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 2**64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _POWERS[name] = np.cumprod(table)
    return _POWERS["up"], _POWERS["down"]


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit over the whole word."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Prefixes:
    """Prefix polynomial hashes of a byte array: the hash of any span in constant time, equal for equal bytes."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_values()[data] * self.up[: len(data)], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Unmixed hashes of data[start:end]."""
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def windows(self, n: int) -> np.ndarray:
        """Unmixed hashes of every window of n bytes, by its start."""
        count = max(0, len(self.sums) - n)
        return (self.sums[n : n + count] - self.sums[:count]) * self.down[:count]


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text numbers) of all words; words end with their text."""
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    first[edges] = word[edges]
    last = word.copy()
    last[:-1] &= ~word[1:]
    inner = edges[edges > 0] - 1
    last[inner] = word[inner]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text numbers) of all words in order."""
    if lower:
        data = _LOWER[data]
    starts, ends, owner = words(data, offsets)
    prefixes = Prefixes(data)
    return mixed(prefixes.spans(starts, ends) + (ends - starts).astype(np.uint64)), owner


_TURNS = np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def shingles(hashes: np.ndarray, owner: np.ndarray, n_texts: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text numbers) of all runs of `size` words, in order; a shorter text with a word gives its whole sequence as one."""
    count = max(0, len(hashes) - size + 1)
    sums = np.full(count, size, np.uint64)
    for k in range(size):
        sums += hashes[k : k + count] * _TURNS[k]
    whole = owner[:count] == owner[size - 1 : size - 1 + count] if count else np.zeros(0, bool)
    found, who = mixed(sums[whole]), owner[:count][whole]
    per_text = np.bincount(owner, minlength=n_texts) if len(owner) else np.zeros(n_texts, np.int64)
    short = np.flatnonzero((per_text > 0) & (per_text < size))
    if len(short):
        at = np.concatenate(([0], np.cumsum(per_text)))
        extra = np.array([int(np.sum(hashes[at[t] : at[t + 1]] * _TURNS[: per_text[t]], dtype=np.uint64) + np.uint64(per_text[t])) & int(_LOW) for t in short], np.uint64)
        found, who = np.concatenate((found, mixed(extra))), np.concatenate((who, short))
    return found, who


def distinct_pairs(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owners, hashes, counts) of the different pairs, sorted by owner, then hash."""
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return owner[at], hashes[at], np.diff(np.append(at, len(owner)))


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of equal values in an array."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return at, np.append(at[1:], len(values))


def runs_of(*values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs in which all arrays stay equal."""
    if not len(values[0]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.zeros(len(values[0]), bool)
    new[0] = True
    for x in values:
        new[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(new)
    return at, np.append(at[1:], len(new))
