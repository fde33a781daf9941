"""Arrays packed as binary columns: one row for each batch and shard instead of one for each entry, and unions of intervals."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import textarrays as ta


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals as disjoint ones in order; touching ones are joined."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1])))
    return start[new], end[np.append(new[1:] - 1, len(end) - 1)]


def merged_by(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Unions of the intervals of each key."""
    order = np.lexsort((start, key))
    key, start, end = key[order], start[order], end[order]
    out: list[list[np.ndarray]] = [[], [], []]
    for a, b in zip(*ta.runs(key), strict=True):
        s, e = merged(start[a:b], end[a:b])
        for k, x in enumerate((np.full(len(s), key[a]), s, e)):
            out[k].append(x)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def bucket(key: np.ndarray, n: int) -> np.ndarray:
    return ((ta.mixed(key.astype(np.uint64)) >> np.uint64(20)) % np.uint64(n)).astype(np.int32)


def packed(key: np.ndarray, n: int, *arrays: np.ndarray) -> dict[int, list[bytes]]:
    order = np.argsort(key, kind="stable")
    bounds = np.searchsorted(key[order], np.arange(n + 1))
    arrays = [a[order] for a in arrays]
    return {int(k): [a[bounds[k] : bounds[k + 1]].tobytes() for a in arrays] for k in np.flatnonzero(np.diff(bounds))}


def packed_texts(key: np.ndarray, texts: list[bytes]) -> dict[int, bytes]:
    """The texts of each key, joined in the order that packed() gives their other fields."""
    order = np.argsort(key, kind="stable")
    return {int(key[order[a]]): b"".join([texts[x] for x in order[a:b].tolist()]) for a, b in zip(*ta.runs(key[order]), strict=True)}


def batch(first: str, names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[k + 1] for r in rows], pa.binary()) for k in range(len(names))]], names=[first, *names]
    )


def schema(first: str, names: list[str]) -> str:
    return ", ".join([f"{first} int", *(f"{x} binary" for x in names)])


def joined(batches: Iterator[pa.RecordBatch], kinds: tuple) -> list[np.ndarray] | None:
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    for batch in batches:
        for k, kind in enumerate(kinds):
            parts[k] += [np.frombuffer(x, kind) for x in batch.column(k + 1).to_pylist()]
    return [np.concatenate(x) for x in parts] if parts[0] else None


#: Most partitions that shards are dealt to; beyond it a partition holds several, sorted, and works on one at a time.
MOST_PARTITIONS = 8192


def _one_at_a_time(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run() over each shard's rows by itself; rows come sorted by shard."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            shard = batch.column(0).to_numpy()
            for a, b in zip(*ta.runs(shard), strict=True):
                if held and shard[a] != last:
                    yield from run(iter(held))
                    held = []
                held.append(batch.slice(a, b - a))
                last = shard[a]
        if held:
            yield from run(iter(held))

    return each


def by_shard(rows: DataFrame, shards: int, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], kind: str, most: int = MOST_PARTITIONS) -> DataFrame:
    """rows, whose first column is their shard, brought together by shard and given to run() shard by shard."""
    shard = rows.columns[0]
    if shards <= most:
        return rows.repartitionById(shards, shard).mapInArrow(run, kind)
    dealt = rows.repartitionById(most, (F.col(shard) % most).cast("int")).sortWithinPartitions(shard)
    return dealt.mapInArrow(_one_at_a_time(run), kind)
