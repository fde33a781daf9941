"""Values that so many documents hold that their entries must not meet in one task: found over all rows, with a proven bound."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import textarrays as ta
from sparkloom.llm.common import stored

#: A value that fewer documents hold is never heavy, whatever their share.
LEAST_DOCS = 2048
#: Shares of a chunk's documents that make a candidate, and of all documents that make a heavy value.
CHUNK_SHARE, SHARE = 32, 64
#: Most heavy values, 8 bytes each: none has fewer than this part of all entries.
MOST = 1 << 18
_DOCS, _ENTRIES = np.array([0, 1], np.uint64).tolist()


def heavy_values(rows: DataFrame, text: int, entries: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sorted values that about one document in SHARE or more holds, or LEAST_DOCS if that is more.

    entries() gives a batch's values, once for each document that holds them; 0 and 1 are no values. A value with a
    larger share of all documents than 1 in CHUNK_SHARE has that share of some chunk, so each chunk names its
    candidates with their documents, all rows are read, and the counts are summed map-side. The sums are lower bounds that lack
    less than one document in CHUNK_SHARE, or four a chunk. As a value is named only with a MOST-th of all entries,
    there are at most MOST of them, which is what may be sent to every task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, counts, docs, total = [], [], 0, 0
        for batch in batches:
            for part in ta.chunks(batch, text):
                value, n = np.unique(entries(part), return_counts=True)
                docs, total = docs + part.num_rows, total + int(n.sum())
                many = n >= max(4, part.num_rows // CHUNK_SHARE)
                found.append(value[many])
                counts.append(n[many])
        value, which = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_inverse=True)
        sums = np.bincount(which, np.concatenate([np.zeros(0, np.int64), *counts]), minlength=len(value)).astype(np.int64)
        value, sums = np.concatenate((np.array([_DOCS, _ENTRIES], np.uint64), value)), np.concatenate(([docs, total], sums))
        yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(sums)], names=["value", "n"])

    counted = stored(rows.mapInArrow(run, "value long, n long").groupBy("value").agg(F.sum("n").alias("n")).where(F.col("n") >= F.when(F.col("value").isin(_DOCS, _ENTRIES), 0).otherwise(LEAST_DOCS)))
    known = {r.value: r.n for r in counted.where(F.col("value").isin(_DOCS, _ENTRIES)).collect()}
    least = max(LEAST_DOCS, known.get(_DOCS, 0) // SHARE, known.get(_ENTRIES, 0) // MOST + 1)
    heavy = counted.where(~F.col("value").isin(_DOCS, _ENTRIES) & (F.col("n") >= least)).select("value").toPandas()["value"].to_numpy(np.int64)
    return np.sort(heavy.view(np.uint64))


def member(values: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """Whether each value is among the sorted heavy ones."""
    if not len(heavy):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(heavy, values), len(heavy) - 1)
    return heavy[at] == values
