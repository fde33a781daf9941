"""Substring dedup by hashing lines, paragraphs and passages: the earliest ranked occurrence of a unit stays.

Lines of any length are units, and with them paragraphs, which are lines or runs of them: a paragraph that occurs again goes
line by line. Most repeated passages stand inside lines, though, so the shortest runs of whole sentences with a
least number of words are units too, and, where asked for, all runs of a given number of words. Digests have 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import packing
from sparkloom.llm import textarrays as ta
from sparkloom.llm.common import shard_count, stored, whole_id

#: Fewest words of a run of sentences; shorter ones repeat by chance inside lines.
UNIT_WORDS = 20
#: Fewest words of a line: lines of any length, or, in the query and the pipeline, those that are no boilerplate.
LINE_WORDS, LONG_LINE_WORDS = 1, 12
#: Words of a passage that is removed wherever it stands, and of the run inside that chooses the shard where equal ones meet.
PASSAGE_WORDS, ANCHOR_WORDS = 50, 25
SHARD_BYTES, LEAST_SHARDS = 16 << 20, 64
_ENDS = np.zeros(256, np.int64)
_ENDS[[ord(c) for c in ".!?\n"]] = 1
_LINE_ENDS = np.zeros(256, np.int64)
_LINE_ENDS[ord("\n")] = 1
_SECOND = np.uint64(0xA0761D6478BD642F)


def units(data: np.ndarray, offsets: np.ndarray, least: int = UNIT_WORDS, line: int = LINE_WORDS) -> tuple[np.ndarray, ...]:
    """(start, stop, hash, second hash, text number) of every unit, in bytes of data.

    Every line with `line` words or more is a unit. A sentence ends with a word that holds one of . ! ? or is the last of
    its line or text. From each sentence the following ones are added until there are `least` words, and before each
    end the preceding ones: both are units, so that a repeated passage is covered up to its outer sentences wherever
    it stands in a line. Units compare by their words, A-Z in lower case: white space and line breaks do not count.
    """
    start, stop, owner, sums = _sums(data, offsets)
    none = np.zeros(0, np.int64)
    if not len(start):
        return none, none, none.astype(np.uint64), none.astype(np.uint64), none
    following, ends_text = np.append(start[1:], len(data)), np.append(owner[1:], -1) != owner

    def bounds(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, word behind the last) of the runs that end with a word with a mark before the next."""
        seen = np.concatenate(([0], np.cumsum(marks[data])))
        end = np.flatnonzero((seen[following] > seen[start]) | ends_text) + 1
        return np.concatenate(([0], end[:-1])), end

    s_start, s_end = bounds(_ENDS)
    s_owner = owner[s_start]
    ahead = np.searchsorted(s_end, s_start + least)
    ok = ahead < len(s_end)
    ok[ok] = s_owner[ahead[ok]] == s_owner[ok]
    back = np.searchsorted(s_start, s_end - least, "right") - 1
    ok_back = back >= 0
    ok_back[ok_back] = s_owner[back[ok_back]] == s_owner[ok_back]
    l_start, l_end = bounds(_LINE_ENDS)
    long = l_end - l_start >= line
    n = len(start) + 1
    first = np.concatenate((s_start[ok], s_start[back[ok_back]], l_start[long]))
    last = np.concatenate((s_end[ahead[ok]], s_end[ok_back], l_end[long]))
    pairs = np.unique(first * n + last)
    a, b = pairs // n, pairs % n
    return start[a], stop[b - 1], _hashes(sums[0], a, b), _hashes(sums[1], a, b), owner[a]


def _sums(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(starts, ends, text numbers) of all words, and two prefix hashes over the words, A-Z in lower case."""
    lower = ta._LOWER[data]
    start, stop, owner = ta.words(lower, offsets)
    hashes = ta.mixed(ta.Prefixes(lower).spans(start, stop) + (stop - start).astype(np.uint64))
    up, _ = ta._powers(len(hashes) + 1)
    both = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * up[: len(hashes)], dtype=np.uint64))) for x in (hashes, ta.mixed(hashes ^ _SECOND))]
    return start, stop, owner, both


def _hashes(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the runs of words from a to b."""
    return ta.mixed((sums[b] - sums[a]) * ta._powers(len(sums))[1][a] + (b - a).astype(np.uint64))


def passages(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text number, first word in the text, hash, anchor's place, anchor's hash) of every run of `length` words, wherever sentences end.

    The anchor is the run of ANCHOR_WORDS words inside, or of all if there are fewer, that has the least hash:
    equal passages have equal anchors, and neighbours mostly share theirs. Passages are the same if both hashes are.
    """
    _, _, owner, (sums, _) = _sums(data, offsets)
    count, short = max(0, len(owner) - length + 1), min(ANCHOR_WORDS, length)
    at = np.flatnonzero(owner[:count] == owner[length - 1 :]) if count else np.zeros(0, np.int64)
    place = np.arange(max(0, len(owner) - short + 1))
    grams = _hashes(sums, place, place + short)
    best, width, wide = place, 1, length - short + 1
    while width < wide and len(best):
        step = min(width, wide - width)
        a, b = best[: len(best) - step], best[step:]
        best, width = np.where(grams[b] < grams[a], b, a), width + step
    first = np.searchsorted(owner, owner[at])
    return owner[at], at - first, _hashes(sums, at, at + length), best[at], grams[best[at]]


def _settled(h: np.ndarray, anchor: np.ndarray, key: np.ndarray, rank: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Whether each passage is the earliest of its kind, and (key, first word, end) of what goes of the others.

    Where a passage overlaps the earliest in the same text, as in text that repeats a word, the earliest stays whole.
    """
    order = np.lexsort((start, key, rank, h, anchor))
    first, end = ta.runs_of(anchor[order], h[order])
    lead = np.zeros(len(h), np.int64)
    lead[order] = np.repeat(order[first], end - first)
    earliest = np.zeros(len(h), bool)
    earliest[order[first]] = True
    same = key == key[lead]
    later = ~earliest & ~(same & (start == start[lead]))
    since = np.where(same, np.maximum(start, start[lead] + length), start)
    return earliest, packing.merged_by(key[later], since[later], start[later] + length)


def _repeated(values: np.ndarray) -> np.ndarray:
    """Whether each value is there more than once."""
    order = np.argsort(values)
    first, end = ta.runs(values[order])
    out = np.zeros(len(values), bool)
    out[order] = np.repeat(end - first > 1, end - first)
    return out


SHARD = ["keys", "ranks", "start", "stop", "hashes", "seconds", "done", "done_from", "done_to", "anchors", "said_keys", "said_ranks", "words", "counts", "passages", "said", "said_from", "said_to"]
BUCKET = ["done", "done_from", "done_to", "said", "said_from", "said_to"]
_LAST = np.iinfo(np.int64).max


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(20)) % np.uint64(shards)).astype(np.int32)


def _dealt(key: np.ndarray, rank: np.ndarray, data: np.ndarray, offsets: np.ndarray, length: int, shards: int) -> tuple[dict, dict, dict]:
    """A batch's passages by shard: one head for neighbours with one anchor, their hashes, and those that the batch settles."""
    owner, word, h, place, anchor = passages(data, offsets, length)
    key, rank = key[owner], rank[owner]
    first, end = ta.runs(place)
    again = np.flatnonzero(np.repeat(_repeated(anchor[first]), end - first))
    earliest, said = _settled(h[again], anchor[again], key[again], rank[again], word[again], length)
    goes = np.ones(len(h), bool)
    goes[again[~earliest]] = False
    key, rank, word, h, place, anchor = (x[goes] for x in (key, rank, word, h, place, anchor))
    first = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (word[1:] != word[:-1] + 1)))) if len(h) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(h)))
    shard = _shard(anchor[first], shards)
    heads = packing.packed(shard, shards, anchor[first], key[first], rank[first], word[first].astype(np.int32), n.astype(np.int32))
    return heads, packing.packed(np.repeat(shard, n), shards, h), packing.packed(packing.bucket(said[0], shards), shards, *said)


def _split(shards: int, least: int, line: int, length: int):
    """Texts to shards of units and passages; of those equal inside a batch the first goes on and the others are settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.chunks(batch, 2):
                key = part.column(0).to_numpy(zero_copy_only=False)
                rank = part.column(1).fill_null(_LAST).to_numpy(zero_copy_only=False)
                data, offsets = ta.buffer_of(part.column(2))
                heads, tails, said = _dealt(key, rank, data, offsets, length, shards) if length else ({}, {}, {})
                start, stop, h, h2, owner = units(data, offsets, least, line)
                start, stop = start - offsets[owner], stop - offsets[owner]
                key, rank = key[owner], rank[owner]
                order = np.lexsort((start, key, rank, h2, h))
                first, end = ta.runs_of(h[order], h2[order])
                later = np.ones(len(h), bool)
                later[order[first]] = False
                later &= ~_same_place(key, start, order, first, end)
                done = packing.merged_by(key[later], start[later], stop[later])
                send = np.sort(order[first])
                kept = packing.packed(_shard(h[send], shards), shards, key[send], rank[send], start[send].astype(np.int32), stop[send].astype(np.int32), h[send], h2[send])
                ends = packing.packed(packing.bucket(done[0], shards), shards, *done)
                yield packing.batch("shard", SHARD, [
                    (k, *kept.get(k, [b""] * 6), *ends.get(k, [b""] * 3), *heads.get(k, [b""] * 5), *tails.get(k, [b""]), *said.get(k, [b""] * 3)) for k in {**kept, **ends, **heads, **said}
                ])

    return run


def _same_place(key: np.ndarray, start: np.ndarray, order: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether an entry has the key and place of its run's first, as rows repeated in full do."""
    lead = np.zeros(len(order), np.int64)
    lead[order] = np.repeat(order[first], end - first)
    return (key == key[lead]) & (start == start[lead])


def _later(buckets: int, length: int):
    """Shards of units and passages to the intervals of all but the earliest occurrence of each; a passage's are counted in words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = packing.joined(batches, (np.int64, np.int64, np.int32, np.int32, np.uint64, np.uint64, np.int64, np.int64, np.int64, np.uint64, np.int64, np.int64, np.int32, np.int32, np.uint64, np.int64, np.int64, np.int64))
        if found is None:
            return
        key, rank, start, stop, h, h2, *done = found[:9]
        order = np.lexsort((start, key, rank, h2, h))
        first, end = ta.runs_of(h[order], h2[order])
        later = np.ones(len(h), bool)
        later[order[first]] = False
        later &= ~_same_place(key, start, order, first, end)
        done = packing.merged_by(*(np.concatenate((x, y[later])) for x, y in zip(done, (key, start, stop), strict=True)))
        ends = packing.packed(packing.bucket(done[0], buckets), buckets, *done)
        anchor, key, rank, word, n, h, *said = found[9:]
        again = _repeated(anchor)
        h, anchor, key, rank, word, n = h[np.repeat(again, n)], anchor[again], key[again], rank[again], word[again], n[again]
        within = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
        more = _settled(h, np.repeat(anchor, n), np.repeat(key, n), np.repeat(rank, n), np.repeat(word, n) + within, length)[1]
        said = packing.merged_by(*(np.concatenate(x) for x in zip(said, more, strict=True)))
        runs = packing.packed(packing.bucket(said[0], buckets), buckets, *said)
        yield packing.batch("bucket", BUCKET, [(k, *ends.get(k, [b""] * 3), *runs.get(k, [b""] * 3)) for k in {**ends, **runs}])

    return run


def _by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = packing.joined(batches, (np.int64,) * 6)
    if found is None:
        return
    spans: dict[int, list[bytes]] = {}
    for kind, part in enumerate((found[:3], found[3:])):
        key, start, stop = packing.merged_by(*part)
        rows = np.stack((start, stop), axis=1)
        for a, b in zip(*ta.runs(key), strict=True):
            spans.setdefault(int(key[a]), [b"", b""])[kind] = rows[a:b].tobytes()
    columns = [pa.array(list(spans), pa.int64()), *(pa.array([x[k] for x in spans.values()], pa.binary()) for k in range(2))]
    yield pa.RecordBatch.from_arrays(columns, names=["key", "spans", "said"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key columns, text, spans in bytes, spans in words) to kept text and spans; white space before a removed run goes with it."""
    for batch in batches:
        for part in ta.chunks(batch, 1):
            data, offsets = ta.buffer_of(part.column(1))
            kept, lists = [], []
            said = part.column(3).to_pylist()
            if any(said):
                starts, ends, owner = ta.words(data, offsets)
                first = np.searchsorted(owner, np.arange(len(said)))
            for k, spans in enumerate(part.column(2).to_pylist()):
                text = data[offsets[k] : offsets[k + 1]]
                pairs = np.frombuffer(spans or b"", np.int64).reshape(-1, 2)
                if said[k]:
                    a, b = (first[k] + np.frombuffer(said[k], np.int64).reshape(-1, 2)).T
                    more = np.stack((starts[a], ends[b - 1]), axis=1) - offsets[k]
                    pairs = np.stack(packing.merged(*np.concatenate((pairs, more)).T), axis=1)
                rest, found, at = [], [], 0
                for a, b in pairs.tolist():
                    while a > at and ta._SPACE[text[a - 1]]:
                        a -= 1
                    while a == 0 and b < len(text) and ta._SPACE[text[b]]:
                        b += 1
                    rest.append(text[at:a].tobytes())
                    if found and found[-1]["stop"] == a:
                        found[-1]["stop"] = b
                    else:
                        found.append({"start": a, "stop": b})
                    at = b
                rest.append(text[at:].tobytes())
                kept.append(b"".join(rest).decode() if part.column(1)[k].is_valid else None)
                lists.append(found)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.string()), pa.array(lists, kind)], names=["rows", "kept", "spans"])


def remove_repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = UNIT_WORDS, line: int = LINE_WORDS, passage: int = 0) -> DataFrame:
    """All columns of docs but its text, with kept_text and spans (byte offsets in the original text) added or replaced.

    A unit (see units()) that occurs earlier, in a text of a smaller id or before in the same text, is removed;
    the earliest occurrence stays. With `passage`, so is every run of that many words or more that occurs earlier,
    wherever its sentences end (see passages()). Ids are whole numbers (else TypeError). Rows without an id rank last, by
    a hash of their text; rows repeated in full are cut alike, as one occurrence. Null texts stay null; an empty table
    gives no rows; texts of any length are worked on whole. Units and passages are shuffled once, packed, with one entry
    a batch for those that repeat in it; texts once, by a hash of id and text.
    """
    names = docs.columns
    rank = whole_id(docs, id_col)
    keyed = docs.select(F.struct(*names).alias("rows"), F.col(text_col).cast("string").alias("text"), F.xxhash64(rank, F.col(text_col)).alias("key"), rank.alias("rank"))
    shards = shard_count(docs, SHARD_BYTES, LEAST_SHARDS)
    split = keyed.select("key", "rank", "text").mapInArrow(_split(shards, least, line, passage), packing.schema("shard", SHARD))
    later = packing.by_shard(split, shards, _later(shards, passage), packing.schema("bucket", BUCKET))
    spans = stored(packing.by_shard(later, shards, _by_text, "key long, spans binary, said binary"))
    others = [c for c in names if c not in (text_col, "kept_text", "spans")]
    slim = keyed.select(F.struct(F.lit(1).alias("__sparkloom"), *[F.col("rows")[c].alias(c) for c in others]).alias("rows"), "text", "key")
    joined = slim.join(spans.hint("shuffle_hash"), "key", "left")
    kind = joined.schema["rows"].dataType.simpleString()
    cut = joined.select("rows", "text", "spans", "said").mapInArrow(_cut, f"rows {kind}, kept string, spans array<struct<start:bigint,stop:bigint>>")
    return cut.select(*[F.col("rows")[c].alias(c) for c in others], F.col("kept").alias("kept_text"), "spans")
