"""Cross-entropy difference: per-token losses under a target and a background bigram model of one vocabulary.

The vocabulary is the same for both models: words (A-Z in lower case) in VOCABULARY classes by hash. Both are
matched: bigram models with additive smoothing, P(b | a) = (n(a b) + ALPHA) / (n(a) + ALPHA * VOCABULARY), the
target's counts from the target documents, the background's from all. A document's own counts are taken off
before it is scored, so that membership in the target is no advantage.

The loss splits into a part that needs only n(a b) and one that needs only n(a). Counts of all documents'
words and bigrams are therefore dealt by hash, packed, and counted and scored in the shard where they meet; only
sums for each document go on. A word or bigram has at most one entry a document, but for counts over MOST,
which are dealt as several and summed before anything is taken off or scored. Heavy words and bigrams, which a good
part of all documents hold, never meet: their counts are summed map-side over all documents first, and each document
scores its own where it is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import packing
from sparkloom.llm import textarrays as ta
from sparkloom.llm.common import shard_count, whole_id
from sparkloom.llm.heavy import heavy_values, member

VOCABULARY = 1 << 24
ALPHA = 0.01
SHARD_BYTES, LEAST_SHARDS = 4 << 20, 48
#: Most target ids that are sent to every executor (8 bytes each); beyond it they are joined by shuffle.
BROADCAST_IDS = 2_000_000

#: Greatest count of one packed entry.
MOST = 65535

SHARD = ["docs", "target", "values", "owners", "counts", "keys", "ids", "named", "sizes", "heavy_target", "heavy_background"]
BUCKET = ["docs", "target", "background", "keys", "ids", "named", "sizes", "heavy_target", "heavy_background"]


def _six(values: np.ndarray) -> np.ndarray:
    """48-bit numbers as rows of six bytes."""
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6]


def _from_six(data: bytes) -> np.ndarray:
    rows = np.frombuffer(data, np.uint8).reshape(-1, 6)
    whole = np.zeros((len(rows), 8), np.uint8)
    whole[:, :6] = rows
    return whole.view("<u8").ravel()


def entries(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, value, count) of every word and bigram of each text, and the texts' numbers of words.

    A bigram is the class of its first word and that of its second, 24 bits each; a word, counted as the first of a
    bigram, has 0 as its second. Words have the classes from 1; before a text's first word stands class 0.
    """
    hashes, owner = ta.word_hashes(*ta.buffer_of(texts))
    word = (hashes >> np.uint64(40)) % np.uint64(VOCABULARY - 1) + np.uint64(1)
    first = np.concatenate(([True], owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, bool)
    before = np.where(first, np.uint64(0), np.concatenate((word[:1], word[:-1]))) << np.uint64(24)
    found = ta.distinct_pairs(np.concatenate((owner, owner)), np.concatenate((before, before | word)))
    return *found, np.bincount(owner, minlength=len(texts))


def _tagged(value: np.ndarray) -> np.ndarray:
    """Values as heavy_values() takes them: none is 0 or 1."""
    return value + np.uint64(2)


def _totals(heavy: np.ndarray):
    """(target, text) to the heavy values' counts in target and background, one row a task and value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, len(heavy)))
        for batch in batches:
            for part in ta.chunks(batch, 1):
                flags = part.column(0).fill_null(False).to_numpy(zero_copy_only=False)
                owner, value, n, _ = entries(part.column(1))
                ours = member(_tagged(value), heavy)
                at, n, flag = np.searchsorted(heavy, _tagged(value[ours])), n[ours], flags[owner[ours]]
                sums += np.stack((np.bincount(at, n * flag, minlength=len(heavy)), np.bincount(at, n, minlength=len(heavy))))
        some = np.flatnonzero(sums[1])
        yield pa.RecordBatch.from_arrays([pa.array(heavy[some].view(np.int64)), *(pa.array(x[some].astype(np.int64)) for x in sums)], names=["value", "target", "background"])

    return run


def _part(value: np.ndarray, n: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Parts of the loss: n * log(count + prior), taken off for bigrams."""
    single = value & np.uint64(VOCABULARY - 1) == 0
    return np.where(single, 1, -1) * n * np.log(counts + np.where(single, ALPHA * VOCABULARY, ALPHA))


def _split(shards: int, heavy: np.ndarray, totals: np.ndarray):
    """(key, doc_id, target, text) to shards of word and bigram counts; heavy ones are scored here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.chunks(batch, 3):
                key = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                ids, named = part.column(1).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), part.column(1).is_valid().to_numpy(zero_copy_only=False)
                flags = part.column(2).fill_null(False).to_numpy(zero_copy_only=False)
                owner, value, n, sizes = entries(part.column(3))
                often = member(_tagged(value), heavy)
                at, who, own = np.searchsorted(heavy, _tagged(value[often])), owner[often], n[often]
                sums = [np.bincount(who, _part(value[often], own, totals[k][at] - own * (flags[who] if k == 0 else 1)), minlength=len(key)) for k in range(2)]
                owner, value, n = owner[~often], value[~often], n[~often]
                if len(n) and n.max() > MOST:
                    times = -(-n // MOST)
                    last = np.cumsum(times) - 1
                    rest = n - (times - 1) * MOST
                    owner, value, n = np.repeat(owner, times), np.repeat(value, times), np.full(last[-1] + 1, MOST)
                    n[last] = rest
                shard = ((ta.mixed(value + np.uint64(1)) >> np.uint64(17)) % np.uint64(shards)).astype(np.int32)
                order = np.argsort(shard, kind="stable")  # owners stay in order inside a shard
                shard, owner, value, n = shard[order], owner[order], value[order], n[order]
                new = np.ones(len(owner), bool)
                new[1:] = (shard[1:] != shard[:-1]) | (owner[1:] != owner[:-1])
                there = owner[new]
                docs = packing.packed(shard[new], shards, key[there], flags[there])
                place = np.cumsum(new) - 1
                local = place - place[np.searchsorted(shard, shard)]
                counts = packing.packed(shard, shards, _six(value), local.astype(np.uint16), n.astype(np.uint16))
                home = int(key[0] % shards) if len(key) else 0  # the shard that is told of the texts themselves
                whole = [x.tobytes() for x in (key, ids, named, sizes.astype(np.int64), *sums)]
                yield packing.batch("shard", SHARD, [(k, *docs.get(k, [b""] * 2), *counts.get(k, [b""] * 3), *(whole if k == home else [b""] * 6)) for k in {**docs, home: None}])

    return run


def _losses(value: np.ndarray, doc: np.ndarray, n: np.ndarray, flags: np.ndarray, docs: int) -> list[np.ndarray]:
    """Sums over each document of its parts of the loss, by the target's and the background's counts without its own."""
    order = np.argsort(value, kind="stable")
    value, doc, n = value[order], doc[order], n[order].astype(np.float64)
    if n.size and n.max() == MOST:  # the entries of one count stand together, as they were dealt
        first, _ = ta.runs_of(value, doc)
        value, doc, n = value[first], doc[first], np.add.reduceat(n, first)
    start, end = ta.runs(value)
    sums = []
    for own in (n * flags[doc], n):
        total = np.repeat(np.add.reduceat(own, start) if len(start) else start, end - start) - own
        sums.append(np.bincount(doc, _part(value, n, total), minlength=docs))
    return sums


def _score(buckets: int):
    """Shards of counts to sums for each document, by bucket of its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = [[np.zeros(0, k)] for k in (np.int64, bool, np.uint64, np.int64, np.uint16, np.int64, np.int64, bool, np.int64, np.float64, np.float64)]
        base = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                for k, kind in ((0, np.int64), (1, bool), (4, np.uint16), (5, np.int64), (6, np.int64), (7, bool), (8, np.int64), (9, np.float64), (10, np.float64)):
                    parts[k].append(np.frombuffer(row[k], kind))
                parts[2].append(_from_six(row[2]))
                parts[3].append(np.frombuffer(row[3], np.uint16).astype(np.int64) + base)
                base += len(parts[0][-1])
        key, flags, value, doc, n, *home = (np.concatenate(x) for x in parts)
        del parts
        sums = _losses(value, doc, n, flags, base)
        found = packing.packed(packing.bucket(key, buckets), buckets, key, *(x.astype(np.float32) for x in sums))
        whole = packing.packed(packing.bucket(home[0], buckets), buckets, *home)
        yield packing.batch("bucket", BUCKET, [(k, *found.get(k, [b""] * 3), *whole.get(k, [b""] * 6)) for k in {**found, **whole}])

    return run


RESULT = "doc_id long, n_tokens long, target double, background double"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets to one row for each row of the input; rows equal in id and text, which share a key, have equal sums."""
    found = packing.joined(batches, (np.int64, np.float32, np.float32, np.int64, np.int64, bool, np.int64, np.float64, np.float64))
    if found is None:
        return
    part_key, *parts, key, ids, named, n, target, background = found
    keys, which, times = np.unique(key, return_inverse=True, return_counts=True)
    at = np.searchsorted(keys, part_key)
    sums = [heavy + (np.bincount(at, x.astype(np.float64), minlength=len(keys)) / times)[which] for x, heavy in zip(parts, (target, background), strict=True)]
    columns = [pa.array(ids, mask=~named), pa.array(n), *(pa.array(x / np.maximum(n, 1), mask=n == 0) for x in sums)]
    yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in RESULT.split(", ")])


def cross_entropy_difference(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background and score (their difference, nats a token) of every row of docs.

    target names the target documents by id; the less the score, the more a text is like them. Each row is a document
    of its own, also rows that share an id, are repeated in full or have no id (those are never of the target). Texts
    without words, and null ones, have no tokens, and null losses and score; an empty target or corpus is no error. Ids
    are whole numbers (else TypeError); other columns are ignored. Counts cover all rows and whole texts, however long, without
    a greatest count.
    """
    ids = target.select(F.col(target_id_col).cast("long").alias("_target")).where("_target IS NOT NULL").distinct()
    near = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    rows = docs.select(whole_id(docs, id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    flagged = rows.join(near, F.col("doc_id") == F.col("_target"), "left").select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", F.col("_target").isNotNull().alias("target"), "text")
    shards = shard_count(docs, SHARD_BYTES, LEAST_SHARDS)
    heavy = heavy_values(rows.select("text"), 0, lambda part: _tagged(entries(part.column(0))[1]))
    counted = flagged.select("target", "text").mapInArrow(_totals(heavy), "value long, target long, background long")
    summed = counted.groupBy("value").agg(F.sum("target").alias("target"), F.sum("background").alias("background")).toPandas() if len(heavy) else None  # no more rows than heavy values
    totals = np.zeros((2, len(heavy)))
    if summed is not None:
        totals[:, np.searchsorted(heavy, summed["value"].to_numpy(np.int64).view(np.uint64))] = summed[["target", "background"]].to_numpy(np.float64).T
    dealt = flagged.mapInArrow(_split(shards, heavy, totals), packing.schema("shard", SHARD))
    sums = packing.by_shard(dealt, shards, _score(shards), packing.schema("bucket", BUCKET))
    losses = packing.by_shard(sums, shards, _summed, RESULT)
    return losses.select(
        "doc_id", "n_tokens", F.round("target", 5).alias("loss_target"), F.round("background", 5).alias("loss_background"),
        F.round(F.col("target") - F.col("background"), 5).alias("score"),
    )
