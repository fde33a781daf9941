"""Removal of every byte covered by a long string that also starts elsewhere: hash-compared suffix sort.

A suffix array over all bytes of a large corpus is out of reach, and most suffixes have no match at all. So
anchors are chosen by content: of the 64-byte strings inside a window of 200 bytes, the one with the least
hash. Equal windows have equal anchors at equal places. Window starts with one anchor form a segment, and
anchors are brought together by hash, packed:

- an anchor found once rules out its whole segment;
- segments with equal bytes are one, by a digest of 128 bits over all their bytes, and only one of them goes on;
- the windows of different segments of one anchor are suffixes to sort: a merge sort in which two suffixes are
  compared through their longest common extension, found by binary search over prefix polynomial hashes.
  Neighbours that agree over the full length are compared byte by byte before they count.

There is one route for anchors of all sizes. What is sorted together is a slice: windows of one anchor at neighbouring
distances from it, whose common core of bytes is equal. An anchor with few segments is one slice; one with more has
narrower slices, down to single windows, so that no group that is sorted grows with the number of near copies. Equal
items of a slice are reduced to one, compared by all their bytes, first in the batch and then where slices meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import packing
from sparkloom.llm import textarrays as ta
from sparkloom.llm.common import shard_count, stored, whole_id

GRAM = 64
#: Different segments of one anchor that one slice takes; beyond it slices are made narrower.
GROUP = 512
#: Suffixes and bytes that are sorted at once.
SUFFIXES, SORTED_BYTES = 1 << 19, 4 << 20
#: Repeated digests that a task remembers, so that it need not send them again.
KNOWN = 1 << 17
SHARD_BYTES, LEAST_SHARDS = 16 << 20, 64
_PLACE = np.uint64((1 << 30) - 1)
_DIGEST = np.dtype([("a", np.uint64), ("b", np.uint64)])


def segments(data: np.ndarray, offsets: np.ndarray, length: int, size: int = GRAM) -> tuple[np.ndarray, ...]:
    """(first window start, number of windows, anchor's place, anchor's hash, text number) of every segment."""
    grams = length - size + 1
    starts = np.arange(max(0, len(data) - length + 1))
    owner = np.searchsorted(offsets, starts, "right") - 1
    starts = starts[starts + length <= offsets[owner + 1]] if len(starts) else starts
    if not len(starts):
        return (*(np.zeros(0, np.int64),) * 3, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    gram = ta.mixed(ta.Prefixes(data).windows(size))
    least = (gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64)
    span = 1
    while 2 * span <= grams:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[: len(least) - (grams - span)], least[grams - span :])
    place = (least[starts] & _PLACE).astype(np.int64)
    new = np.concatenate(([True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)))
    at = np.flatnonzero(new)
    first, windows = starts[at], np.diff(np.append(at, len(starts)))
    return first, windows, place[at], gram[place[at]], np.searchsorted(offsets, first, "right") - 1


SHARD = ["docs", "at", "windows", "shifts", "anchors", "digests", "twice", "done", "done_from", "done_to"]
BUCKET = ["done", "done_from", "done_to", "docs", "at", "windows", "shifts", "anchors", "single", "parts"]


def _split(shards: int, length: int):
    """Texts to shards of segments by anchor; segments equal inside a batch are settled here and sent once, and not
    again from the same task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[bytes] = set()
        of_bytes = xxhash.xxh3_128_digest
        for batch in batches:
            for part in ta.chunks(batch, 1):
                ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                data, offsets = ta.buffer_of(part.column(1))
                first, windows, place, anchor, owner = segments(data, offsets, length)
                view = memoryview(np.ascontiguousarray(data))
                digests = [of_bytes(view[a:b]) for a, b in zip(first.tolist(), (first + windows - 1 + length).tolist(), strict=True)]
                again = np.fromiter((x in known for x in digests), bool, len(first))
                digest = np.frombuffer(b"".join(digests), _DIGEST)
                order = np.lexsort((digest["b"], digest["a"], anchor))
                start, end = ta.runs_of(anchor[order], digest["a"][order], digest["b"][order])
                twice, lead = np.zeros(len(first), bool), np.zeros(len(first), bool)
                twice[order] = np.repeat(end - start > 1, end - start)
                lead[order[start]] = True
                if len(known) < KNOWN:
                    known.update(digests[k] for k in np.flatnonzero(lead & twice).tolist())
                send = np.flatnonzero(lead & ~again)
                at, gone = first - offsets[owner], twice | again
                done = packing.merged_by(ids[owner[gone]], at[gone], (at + windows - 1 + length)[gone])
                send_key = (anchor[send] >> np.uint64(20)) % np.uint64(shards)
                kept = packing.packed(
                    send_key.astype(np.int32), shards, ids[owner[send]], at[send].astype(np.int64), windows[send].astype(np.int16),
                    (place - first)[send].astype(np.int16), anchor[send], digest[send], twice[send],
                )
                ends = packing.packed(packing.bucket(done[0], shards), shards, *done)
                yield packing.batch("shard", SHARD, [(k, *kept.get(k, [b""] * 7), *ends.get(k, [b""] * 3)) for k in {**kept, **ends}])

    return run


def slices(kinds: np.ndarray, gathered: int, grams: int) -> np.ndarray:
    """Slices of an anchor with so many different segments: one up to `gathered`, else a power of two twice as many as that takes, single windows at most."""
    over = -(-kinds // gathered)
    return np.where(over <= 1, 1, np.minimum(grams, 2 ** (np.ceil(np.log2(np.maximum(over, 1))).astype(np.int64) + 1)))


def _matched(buckets: int, length: int, gathered: int):
    """Shards of segments to buckets of documents: what is settled, and which segments must be sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = packing.joined(batches, (np.int64, np.int64, np.int16, np.int16, np.uint64, _DIGEST, bool, np.int64, np.int64, np.int64))
        if found is None:
            return
        columns, done = found[:7], found[7:]
        order = np.lexsort((columns[5]["b"], columns[5]["a"], columns[4]))
        doc, at, windows, shift, anchor, digest, twice = (x[order] for x in columns)
        start, end = ta.runs_of(anchor, digest["a"], digest["b"])
        total = np.add.reduceat(1 + twice.astype(np.int64), start) if len(start) else start
        equal = np.repeat(total > 1, end - start)
        a_start, a_end = ta.runs(anchor[start])
        kinds = np.repeat(a_end - a_start, a_end - a_start)
        lone = np.add.reduceat((total == 1).astype(np.int64), a_start) if len(a_start) else a_start
        mixed = (kinds > 1) & (np.repeat(lone, a_end - a_start) > 0)
        ask, parts = start[mixed], slices(kinds[mixed], gathered, length - GRAM + 1).astype(np.int16)
        stop = at + windows - 1 + length
        done = [np.concatenate((x, y)) for x, y in zip(done, (doc[equal], at[equal], stop[equal]), strict=True)]
        done = packing.merged_by(*done)
        kept = packing.packed(packing.bucket(done[0], buckets), buckets, *done)
        asked = packing.packed(packing.bucket(doc[ask], buckets), buckets, doc[ask], at[ask], windows[ask], shift[ask], anchor[ask], ~equal[ask], parts)
        yield packing.batch("bucket", BUCKET, [(k, *kept.get(k, [b""] * 3), *asked.get(k, [b""] * 7)) for k in {**kept, **asked}])

    return run


_ASK = np.dtype([("at", np.int64), ("windows", np.int16), ("shift", np.int16), ("anchor", np.uint64), ("single", bool), ("parts", np.int16)])
DOCUMENT = "key long, done binary, asked binary"


def _grouped(of: np.ndarray, rows: np.ndarray) -> dict[int, bytes]:
    order = np.argsort(of, kind="stable")
    of, rows = of[order], rows[order]
    return {int(of[a]): rows[a:b].tobytes() for a, b in zip(*ta.runs(of), strict=True)}


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets to one row for each document: its settled intervals, and its segments to sort."""
    found = packing.joined(batches, (np.int64, np.int64, np.int64, np.int64, np.int64, np.int16, np.int16, np.uint64, bool, np.int16))
    if found is None:
        return
    done = packing.merged_by(*found[:3])
    asks = np.zeros(len(found[3]), _ASK)
    for name, x in zip(_ASK.names, found[4:], strict=True):
        asks[name] = x
    groups = [_grouped(done[0], np.stack(done[1:], axis=1)), _grouped(found[3], asks)]
    keys = list({**groups[0], **groups[1]})
    for k in range(0, len(keys), 4096):
        part = keys[k : k + 4096]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), *[pa.array([g.get(x) for x in part], pa.binary()) for g in groups]], names=["key", "done", "asked"])


PIECES = ["slices", "docs", "at", "windows", "shifts", "single", "twice", "sizes", "texts", "done", "done_from", "done_to"]
FOUND = ["done", "done_from", "done_to"]


def _first_of_each(slice_of: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """For each item the first with the same slice and the same bytes."""
    seen: dict[tuple[int, bytes], int] = {}
    return np.fromiter((seen.setdefault(x, k) for k, x in enumerate(zip(slice_of.tolist(), texts, strict=True))), np.int64, len(texts))


def _pieces(shards: int, length: int):
    """Documents with the segments asked for to shards of those segments' slices, with their bytes."""
    grams = length - GRAM + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.chunks(batch, 1, 1 << 20):
                data, offsets = ta.buffer_of(part.column(1))
                asks = [np.frombuffer(x, _ASK) for x in part.column(2).to_pylist()]
                row, ask = np.repeat(np.arange(len(asks)), [len(x) for x in asks]), np.concatenate(asks)
                parts, high = ask["parts"].astype(np.int64), ask["shift"].astype(np.int64)
                low = high - ask["windows"] + 1
                first = low * parts // grams
                times = high * parts // grams - first + 1
                of = np.repeat(np.arange(len(ask)), times)
                k = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
                near, far = -(-k * grams // parts[of]), -(-(k + 1) * grams // parts[of]) - 1  # the slice's least and greatest distance
                a_shift, b_shift = np.minimum(high[of], far), np.maximum(low[of], near)
                place = offsets[row[of]] + ask["at"][of] + high[of]
                core = ta.Prefixes(data).spans(place - near, place - far + length)
                slice_of = ta.mixed(core ^ ta.mixed(ask["anchor"][of] + k.astype(np.uint64)))
                start, windows = place - a_shift, a_shift - b_shift + 1
                texts = [data[a:b].tobytes() for a, b in zip(start.tolist(), (start + windows - 1 + length).tolist(), strict=True)]
                lead = _first_of_each(slice_of, texts)
                twice = np.bincount(lead, minlength=len(texts))[lead] > 1 if len(texts) else np.zeros(0, bool)
                doc, at, single = part.column(0).to_numpy(zero_copy_only=False)[row[of]], start - offsets[row[of]], ask["single"][of]
                gone = twice & single
                done = packing.merged_by(doc[gone], at[gone], (at + windows - 1 + length)[gone])
                ends = packing.packed(packing.bucket(done[0], shards), shards, *done)
                send = np.flatnonzero(lead == np.arange(len(texts)))
                to = ((slice_of[send] >> np.uint64(20)) % np.uint64(shards)).astype(np.int32)
                sent = [texts[x] for x in send.tolist()]
                kept = packing.packed(
                    to, shards, slice_of[send], doc[send], at[send], windows[send].astype(np.int16), a_shift[send].astype(np.int16), (single & ~twice)[send], twice[send],
                    np.array([len(x) for x in sent], np.int32),
                )
                bodies = packing.packed_texts(to, sent)
                yield packing.batch("shard", PIECES, [(x, *kept.get(x, [b""] * 8), bodies.get(x, b""), *ends.get(x, [b""] * 3)) for x in {**kept, **ends}])

    return run


def extension(prefixes: ta.Prefixes, x: np.ndarray, y: np.ndarray, length: int) -> np.ndarray:
    """Longest common extension, up to length, of suffixes starting at x and y: binary search over prefix hashes."""
    low, high = np.zeros(len(x), np.int64), np.full(len(x), length, np.int64)
    whole = prefixes.spans(x, x + length) == prefixes.spans(y, y + length)
    low[whole] = length
    left = np.flatnonzero(~whole)
    high[left] = length - 1
    while len(left):
        mid = (low[left] + high[left] + 1) // 2
        same = prefixes.spans(x[left], x[left] + mid) == prefixes.spans(y[left], y[left] + mid)
        low[left] = np.where(same, mid, low[left])
        high[left] = np.where(same, high[left], mid - 1)
        left = left[low[left] < high[left]]
    return low


def _before(data: np.ndarray, prefixes: ta.Prefixes, x: np.ndarray, y: np.ndarray, length: int, equal: np.ndarray) -> np.ndarray:
    """Whether suffix x comes before suffix y; equal says what holds for equal ones."""
    n = extension(prefixes, x, y, length)
    at = np.minimum(n, length - 1)
    return np.where(n == length, equal, data[x + at] < data[y + at])


def sorted_suffixes(data: np.ndarray, prefixes: ta.Prefixes, suffix: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes, groups) sorted by group, then by their first `length` bytes: a bottom-up merge sort, all merges of a level at once."""
    order = np.argsort(group, kind="stable")
    suffix, group = suffix[order], group[order]
    start, end = ta.runs(group)
    first, size = np.repeat(start, end - start), np.repeat(end - start, end - start)
    rank = np.arange(len(suffix)) - first
    width = 1
    while len(size) and width < size.max():
        live = np.flatnonzero(size > width)
        r, base = rank[live], first[live]
        block, right = r // (2 * width) * (2 * width), r // width % 2 == 1
        other = block + np.where(right, 0, width)
        low, high = np.zeros(len(live), np.int64), np.clip(size[live] - other, 0, width)
        left = np.flatnonzero(low < high)
        while len(left):
            mid = (low[left] + high[left]) // 2
            goes = _before(data, prefixes, suffix[base[left] + other[left] + mid], suffix[live[left]], length, right[left])
            low[left] = np.where(goes, mid + 1, low[left])
            high[left] = np.where(goes, high[left], mid)
            left = left[low[left] < high[left]]
        to = base + block + r % width + low
        moved = suffix.copy()
        moved[to] = suffix[live]
        suffix = moved
        width *= 2
    return suffix, group


def repeated_windows(data: np.ndarray, suffix: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """The suffixes whose first `length` bytes another suffix of the group also has, verified byte by byte."""
    prefixes = ta.Prefixes(data)
    suffix, group = sorted_suffixes(data, prefixes, suffix, group, length)
    near = np.flatnonzero(group[1:] == group[:-1]) if len(group) else np.zeros(0, np.int64)
    near = near[prefixes.spans(suffix[near], suffix[near] + length) == prefixes.spans(suffix[near + 1], suffix[near + 1] + length)]
    reach = np.arange(length)
    sure = [np.all(data[suffix[x][:, None] + reach] == data[suffix[x + 1][:, None] + reach], axis=1) for x in np.array_split(near, len(near) // 8192 + 1)]
    near = near[np.concatenate(sure)]
    return np.unique(np.concatenate((suffix[near], suffix[near + 1])))


def _sorted(buckets: int, length: int):
    """Shards of slices to the repeated intervals of segments whose bytes no other segment has, by bucket of the document."""

    def solve(rows: np.ndarray, slice_of: np.ndarray, texts: list[bytes], windows: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, window) of every repeated window of the rows, which are whole slices in order."""
        data = np.frombuffer(b"".join([texts[x] for x in rows.tolist()]), np.uint8)
        base = np.cumsum([0, *[len(texts[x]) for x in rows.tolist()]])[:-1]
        n = windows[rows].astype(np.int64)
        row = np.repeat(np.arange(len(rows)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        suffix = base[row] + step
        number = np.unique(slice_of[rows], return_inverse=True)[1]
        distance = shift[rows].astype(np.int64)[row] - step
        which = np.searchsorted(suffix, repeated_windows(data, suffix, number[row] * length + distance, length))
        return rows[row[which]], step[which]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = packing.joined(batches, (np.uint64, np.int64, np.int64, np.int16, np.int16, bool, bool, np.int32, np.uint8, np.int64, np.int64, np.int64))
        if found is None:
            return
        slice_of, doc, at, windows, shift, single, twice, size, body, *done = found
        end = np.cumsum(size.astype(np.int64))
        body = body.tobytes()
        texts = [body[a:b] for a, b in zip((end - size).tolist(), end.tolist(), strict=True)]
        lead = _first_of_each(slice_of, texts)
        total = np.bincount(lead, 1 + twice.astype(np.int64), minlength=len(texts))[lead] if len(texts) else np.zeros(0)
        gone = np.flatnonzero(single & (total > 1))
        pairs = [(doc[gone], at[gone], at[gone] + windows[gone] - 1 + length)]
        rows = np.flatnonzero(lead == np.arange(len(texts)))
        rows = rows[np.argsort(slice_of[rows], kind="stable")]
        first, last = ta.runs(slice_of[rows])
        wanted = single[rows] & (total[rows] == 1)
        open_ = (last - first > 1) & (np.add.reduceat(wanted.astype(np.int64), first) > 0) if len(first) else first > 0
        held: list[np.ndarray] = []
        load = weight = 0
        groups = list(zip(first[open_].tolist(), last[open_].tolist(), strict=True))
        for k, (a, b) in enumerate(groups):
            held.append(rows[a:b])
            load, weight = load + int(windows[rows[a:b]].sum()), weight + int(size[rows[a:b]].sum())
            if load >= SUFFIXES or weight >= SORTED_BYTES or k + 1 == len(groups):
                row, step = solve(np.concatenate(held), slice_of, texts, windows, shift)
                ours = single[row]
                row, step = row[ours], step[ours]
                pairs.append((doc[row], at[row] + step, at[row] + step + length))
                held, load, weight = [], 0, 0
        done = packing.merged_by(*(np.concatenate((x, *y)) for x, y in zip(done, zip(*pairs, strict=True), strict=True)))
        kept = packing.packed(packing.bucket(done[0], buckets), buckets, *done)
        yield packing.batch("bucket", FOUND, [(k, *x) for k, x in kept.items()])

    return run


def _more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of intervals to one row for each document."""
    found = packing.joined(batches, (np.int64, np.int64, np.int64))
    if found is None:
        return
    done = packing.merged_by(*found)
    spans = _grouped(done[0], np.stack(done[1:], axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(list(spans), pa.int64()), pa.array(list(spans.values()), pa.binary())], names=["key", "more"])


REMOVED = "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their settled and sorted intervals to spans and what is left."""
    for batch in batches:
        for part in ta.chunks(batch, 1):
            data, offsets = ta.buffer_of(part.column(1))
            spans, kept = [], []
            for k, (done, more) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                text = data[offsets[k] : offsets[k + 1]]
                pairs = np.frombuffer((done or b"") + (more or b""), np.int64).reshape(-1, 2)
                start, stop = packing.merged(pairs[:, 0], pairs[:, 1])
                stay = np.ones(len(text), bool)
                for a, b in zip(start.tolist(), stop.tolist(), strict=True):
                    stay[a:b] = False
                spans.append([{"start": a, "stop": b} for a, b in zip(start.tolist(), stop.tolist(), strict=True)])
                kept.append(text[stay].tobytes() if len(start) else text.tobytes())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, gathered: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, spans and kept of every row: the maximal runs of bytes covered by a string of `length` bytes that
    also starts elsewhere in any text, the same included, and the other bytes concatenated (kept may cut characters).

    All occurrences are removed, the first one too, as judged on the input. Null texts are empty; texts under
    `length` bytes keep everything; rows may repeat, share an id or have none, as each row's key is a hash of
    its id and text; ids are whole numbers (else TypeError); other columns are ignored; an empty table gives no rows. Very long
    texts are worked on whole, one at a time. The texts are shuffled twice, by that key.
    """
    if not GRAM <= length <= 8 * GRAM:
        raise ValueError(f"length must be from {GRAM} to {8 * GRAM}")
    named = docs.select(whole_id(docs, id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keyed = named.withColumn("key", F.xxhash64("doc_id", "text"))
    shards = shard_count(docs, SHARD_BYTES, LEAST_SHARDS)
    split = keyed.select("key", "text").mapInArrow(_split(shards, length), packing.schema("shard", SHARD))
    matched = packing.by_shard(split, shards, _matched(shards, length, gathered), packing.schema("bucket", BUCKET))
    settled = stored(packing.by_shard(matched, shards, _by_document, DOCUMENT))

    asked = settled.where("asked IS NOT NULL").select("key", "asked").hint("shuffle_hash")
    pieces = keyed.join(asked, "key").select("key", "text", "asked").mapInArrow(_pieces(shards, length), packing.schema("shard", PIECES))
    alike = packing.by_shard(pieces, shards, _sorted(shards, length), packing.schema("bucket", FOUND))
    more = packing.by_shard(alike, shards, _more, "key long, more binary")
    done = settled.where("done IS NOT NULL").select("key", "done").hint("shuffle_hash")
    whole = keyed.join(done, "key", "left").join(more.hint("shuffle_hash"), "key", "left")
    return whole.select("doc_id", "text", "done", "more").mapInArrow(_cut, REMOVED)
