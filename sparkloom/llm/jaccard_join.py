"""Exact n-gram Jaccard join: token-combination prefixes, then verification, then components.

A document's tokens are its distinct shingles. Tokens are ordered by document frequency, rare first. Rare
tokens are signatures by themselves; frequent ones are dealt by hash into small classes and only pairs within
a class are signatures. A class whose first c tokens are in the prefix loses one token of coverage, so the
prefix goes on until its coverage exceeds the number of tokens that a partner may miss: two sets similar
enough then share a signature (the longer prefix holds every shared token of the shorter one).
The number of classes depends on the set's size alone, and each set also signs for the next larger partner
size, so that linked sets always use a common division.

Tokens meet by hash to be counted. Heavy ones, which a good part of all documents hold, need not: they are frequent
for certain, all have the same place in the order, and go straight to their documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import packing
from sparkloom.llm import textarrays as ta
from sparkloom.llm.common import if_small, shard_count, stored, whole_id
from sparkloom.llm.components import components
from sparkloom.llm.heavy import heavy_values, member

#: Tokens in more documents than this are of the frequent class.
RARE_DOCS = 32
#: Expected tokens of a class of frequent tokens, in a set of which all tokens are frequent.
CLASS_TOKENS = 16
#: Bytes of input a shard of tokens stands for, and the fewest shards.
SHARD_BYTES, LEAST_SHARDS = 6 << 20, 64
#: The frequency that stands for that of every heavy token.
HEAVY_DOCS = np.iinfo(np.int32).max


def most_missing(n: int) -> int:
    """Tokens of a set of n that a partner at 75 % may lack."""
    return n - (3 * n + 3) // 4


def _sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text numbers, hashes) of the distinct shingles of each text; no hash is 0 or 1."""
    hashes, owner = ta.word_hashes(*ta.buffer_of(texts))
    found, who = ta.shingles(hashes, owner, len(texts), size)
    who, found, _ = ta.distinct_pairs(who, np.maximum(found, np.uint64(2)))
    return who, found


SHARD = ["docs", "hashes", "heavy_docs", "heavy_hashes"]
BUCKET = ["docs", "sizes", "owners", "hashes", "dfs", "heavy_owners", "heavy_hashes"]


def token_shards(docs: DataFrame, shards: int, heavy: np.ndarray, size: int = 5) -> DataFrame:
    """(shard, ...): the distinct shingles of all texts, packed by shard of the hash for each batch; heavy ones by that of the document."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.chunks(batch, 1):
                ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                who, found = _sets(part.column(1), size)
                none = np.setdiff1d(np.arange(len(ids)), who)
                often = member(found, heavy)
                hot = packing.packed(packing.bucket(ids[who[often]], shards), shards, ids[who[often]], found[often])
                who, found = np.concatenate((who[~often], none)), np.concatenate((found[~often], np.zeros(len(none), np.uint64)))
                shard = ((found >> np.uint64(40)) % np.uint64(shards)).astype(np.int32)
                shard[len(found) - len(none) :] = ids[none] % shards
                own = packing.packed(shard, shards, ids[who], found)
                yield packing.batch("shard", SHARD, [(k, *own.get(k, [b""] * 2), *hot.get(k, [b""] * 2)) for k in {**own, **hot}])

    return docs.mapInArrow(split, packing.schema("shard", SHARD))


def _frequencies(buckets: int):
    """Shards of tokens to document buckets: each document's number of tokens, and those that two documents or more have."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = packing.joined(batches, (np.int64, np.uint64, np.int64, np.uint64))
        if parts is None:
            return
        doc, h, hot, hot_h = parts
        del parts
        order = np.argsort(h)
        doc, h = doc[order], h[order]
        start, end = ta.runs(h)
        many = np.repeat((end - start > 1) & (h[start] != 0), end - start)
        once, zero = doc[~many & (h != 0)], np.unique(doc[h == 0])
        doc, h = doc[many], h[many]
        doc, h, _ = ta.distinct_pairs(doc, h)
        order = np.argsort(h, kind="stable")
        doc, h = doc[order], h[order]
        start, end = ta.runs(h)
        df = np.repeat(end - start, end - start).astype(np.int32)
        seen, n = np.unique(np.concatenate((once, doc)), return_counts=True)
        seen, n = np.concatenate((seen, zero)), np.concatenate((n, np.zeros(len(zero), np.int64))).astype(np.int32)
        to = lambda x: packing.bucket(x, buckets)
        counts, tokens = packing.packed(to(seen), buckets, seen, n), packing.packed(to(doc), buckets, doc, h, df)
        often = packing.packed(to(hot), buckets, hot, hot_h)
        yield packing.batch("bucket", BUCKET, [(k, *counts.get(k, [b""] * 2), *tokens.get(k, [b""] * 3), *often.get(k, [b""] * 2)) for k in {**counts, **often}])

    return count


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document buckets to one row for each document; its tokens only where a link is possible."""
    parts = packing.joined(batches, (np.int64, np.int32, np.int64, np.uint64, np.int32, np.int64, np.uint64))
    if parts is None:
        return
    doc, n, owner, h, df, hot, hot_h = parts
    hot, hot_h, _ = ta.distinct_pairs(hot, hot_h)
    owner, h, df = np.concatenate((owner, hot)), np.concatenate((h, hot_h)), np.concatenate((df, np.full(len(hot), HEAVY_DOCS, np.int32)))
    ids, which = np.unique(np.concatenate((doc, hot)), return_inverse=True)
    sizes = np.bincount(which, weights=np.concatenate((n, np.ones(len(hot))))).astype(np.int64)
    order = np.lexsort((h, df, owner))
    owner, h, df = owner[order], h[order], df[order]
    start, end = np.searchsorted(owner, ids), np.searchsorted(owner, ids, "right")
    alone = sizes - (end - start)
    may = (sizes > 1) & (alone <= sizes - (3 * sizes + 3) // 4) | (sizes == 1) & (alone == 0)
    out: list[tuple] = []
    for k, doc_id in enumerate(ids.tolist()):
        if not may[k]:
            out.append((doc_id, int(sizes[k]), int(alone[k]), None, None, None))
        else:
            own, freq = h[start[k] : end[k]], df[start[k] : end[k]]
            digest = hashlib.blake2b(np.sort(own).tobytes(), digest_size=16).digest() if not alone[k] else None
            out.append((doc_id, int(sizes[k]), int(alone[k]), digest, own.tobytes(), freq.tobytes()))
        if len(out) >= 4096:
            yield _documents_batch(out)
            out = []
    if out:
        yield _documents_batch(out)


DOCUMENT = "doc_id long, n long, alone long, digest binary, hashes binary, dfs binary"


def _documents_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.binary()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in DOCUMENT.split(", ")])


def division(n: int) -> int:
    """Classes of frequent tokens in a set of n: a power of two, CLASS_TOKENS tokens each or up to twice that."""
    return 1 << max(0, (n // CLASS_TOKENS).bit_length() - 1)


def signatures(n: int, alone: int, hashes: np.ndarray, dfs: np.ndarray) -> np.ndarray:
    """The signatures of one set: hashes and document frequencies of its shared tokens by (frequency, hash), alone the others' number."""
    need = most_missing(n) + 1 - alone
    found = []
    rare = dfs <= RARE_DOCS
    for classes in {division(n), division(-(-4 * n // 3))}:
        own = (hashes >> np.uint64(17)) % np.uint64(classes)
        first = np.zeros(len(own), bool)
        frequent = np.flatnonzero(~rare)
        first[frequent[np.unique(own[frequent], return_index=True)[1]]] = True
        covered = np.cumsum(rare | ~first)
        upto = int(np.searchsorted(covered, need)) + 1
        single, paired = hashes[:upto][rare[:upto]], np.arange(len(hashes[:upto]))[~rare[:upto]]
        found.append(ta.mixed(single ^ np.uint64(0x5BD1E995)))
        paired = paired[np.lexsort((hashes[paired], own[paired]))]
        for a, b in zip(*ta.runs(own[paired]), strict=True):
            if b - a > 1:
                i, j = np.triu_indices(b - a, 1)
                h = hashes[paired[a:b]]
                found.append(ta.mixed(ta.mixed(h[i]) * np.uint64(0x9E3779B97F4A7C15) + h[j] + np.uint64(classes)))
    return np.unique(np.concatenate(found))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list[np.ndarray]] = [[], [], [], []]
        for row in batch.to_pylist():
            sigs = signatures(row["n"], row["alone"], np.frombuffer(row["hashes"], np.uint64), np.frombuffer(row["dfs"], np.int32)).view(np.int64)
            for k, x in enumerate((sigs, *(np.full(len(sigs), row[c], np.int64) for c in ("doc_id", "n", "alone")))):
                out[k].append(x)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["sig", "sid", "n", "u"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h1, h2 = batch.column(4).to_pylist(), batch.column(5).to_pylist()
        shared = np.zeros(batch.num_rows, np.int64)
        for k in range(batch.num_rows):
            x = np.concatenate((np.frombuffer(h1[k], np.uint64), np.frombuffer(h2[k], np.uint64)))
            x.sort()
            shared[k] = np.count_nonzero(x[1:] == x[:-1])
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(shared)], names=["a", "b", "n1", "n2", "o"])


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, n1, n2, o): the sets' sizes and the number of tokens both have, counted exactly."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("n1"), F.col("hashes").alias("h1"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("n2"), F.col("hashes").alias("h2"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "n1", "n2", "h1", "h2")
    return both.mapInArrow(_counted, "a long, b long, n1 long, n2 long, o long")


def _enough(shared: Column, n1: Column, n2: Column) -> Column:
    """100 * shared >= 75 * union, in whole numbers."""
    return 7 * shared >= 3 * (n1 + n2)


def _rest(placed: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs (a, b) in a common signature, in different components, whose overlap may suffice.

    With o tokens shared with the signature's centre and s tokens shared with anybody, two sets share at most
    min(o1, o2) tokens of the centre and min(s1 - o1, s2 - o2) others. Sets at 75 % differ by a third in size at most,
    so that only those of the same or the next class of sizes meet.
    """
    rows = placed.join(label, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    least = rows.groupBy("sig").agg(F.min("n").alias("n_min"))
    able = stored(rows.join(least, "sig").where(_enough(F.col("s"), F.col("n"), F.col("n_min"))).drop("n_min"))
    parts = able.groupBy("sig", "label").agg(F.count(F.lit(1)).alias("k"))
    split = parts.groupBy("sig").agg(F.count(F.lit(1)).alias("labels"), F.max(F.struct("k", "label"))["label"].alias("main")).where("labels > 1")
    by_size = F.floor(F.log(F.col("n").cast("double")) / float(np.log(4 / 3))).cast("int")
    open_rows = able.join(split.select("sig", "main"), "sig").withColumn("size", by_size)
    few = open_rows.where(F.col("label") != F.col("main")).select("sig", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)).alias("size"), *[F.col(c).alias(f"x_{c}") for c in ("sid", "n", "s", "o", "label")])
    most = F.least("x_o", "o") + F.least(F.col("x_s") - F.col("x_o"), F.col("s") - F.col("o"))
    meet = (F.col("x_label") != F.col("label")) & ((F.col("label") == F.col("main")) | (F.col("x_sid") < F.col("sid"))) & _enough(most, F.col("x_n"), F.col("n"))
    return few.join(open_rows, ["sig", "size"]).where(meet).select(F.least("x_sid", "sid").alias("a"), F.greatest("x_sid", "sid").alias("b")).distinct()


def links(sets: DataFrame) -> DataFrame:
    """Edges (a, b) that give the components of the similarity graph over distinct sets, stored.

    First every set meets one set of each signature it shares, its centre: the one with the fewest tokens of its
    own. Most groups of near copies are joined by that. Then, among sets of one signature that are still in
    different components, every set outside the largest of these meets each set of another component that the
    overlaps with the centre leave possible. Small signatures go first, as they join what is left at least cost;
    then come all sets with one centre: they hold every other common signature, and name a pair seldom more than
    once. So no link between components is lost, and members of one component are not compared again.
    """
    sigs = stored(sets.select("doc_id", "n", "alone", "hashes", "dfs").where("n > 1").mapInArrow(_signed, "sig long, sid long, n long, u long"))
    centres = sigs.groupBy("sig").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("u", "sid")).alias("c")).where("size > 1")
    shared = stored(sigs.join(centres, "sig").select("sig", "size", "sid", "n", (F.col("n") - F.col("u")).alias("s"), F.col("c.sid").alias("c_sid")).where("sid != c_sid"))
    met = stored(overlaps(shared.select(F.col("sid").alias("a"), F.col("c_sid").alias("b")).distinct(), sets))
    found = stored(met.where(_enough(F.col("o"), F.col("n1"), F.col("n2"))).select("a", "b"))
    placed = stored(shared.join(met.select(F.col("a").alias("sid"), F.col("b").alias("c_sid"), "o"), ["sid", "c_sid"]).where("size > 2"))
    by_signature = placed.where(F.col("size") <= RARE_DOCS).select("sig", "sid", "n", "s", "o")
    by_centre = stored(placed.select(F.col("c_sid").alias("sig"), "sid", "n", "s", "o").distinct())
    for some in (by_signature, by_centre):
        label = components(found).select(F.col("node").alias("sid"), F.col("component").alias("label"))
        more = overlaps(_rest(some, label), sets).where(_enough(F.col("o"), F.col("n1"), F.col("n2"))).select("a", "b")
        found = stored(found.unionByName(more))
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id for every document, component_id the smallest doc_id that links reach.

    A document's set is that of its lower-cased (A-Z) word shingles; with fewer words than `size` its whole
    sequence is one shingle; without words the set is empty and links with nothing. Two documents link at a
    Jaccard similarity of 75 % or more. Rows that share an id are one document, whose set is the union; rows
    without an id are a row each that links with nothing (component_id null). Ids are whole numbers (else TypeError);
    null texts have no words; an empty table gives no rows; very long texts are worked on whole. Other columns are ignored.
    Shingles are compared by 64-bit hashes.

    Equal sets are one class, joined through the smallest id by a map-side minimum. Each shingle is shuffled
    once, packed; a document of which too many shingles are its own is settled there, and only the others'
    shared shingles go on.
    """
    named = docs.select(whole_id(docs, id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shards = shard_count(docs, SHARD_BYTES, LEAST_SHARDS)
    heavy = heavy_values(named.select("text"), 0, lambda part: _sets(part.column(0), size)[1])
    rows = token_shards(named.where("doc_id IS NOT NULL"), shards, heavy, size)
    buckets = packing.by_shard(rows, shards, _frequencies(shards), packing.schema("bucket", BUCKET))
    found = stored(packing.by_shard(buckets, shards, _documents, DOCUMENT))
    equal = found.where("digest IS NOT NULL").groupBy("digest", "n").agg(F.min("doc_id").alias("rep"))
    classed = stored(found.where("digest IS NOT NULL").select("doc_id", "digest", "n").join(equal, ["digest", "n"]).select("doc_id", "rep"))
    sets = stored(found.where("hashes IS NOT NULL").join(classed.where("doc_id != rep").select("doc_id"), "doc_id", "left_anti"))
    groups = components(links(sets).unionByName(classed.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))))
    whole = found.select("doc_id", "n").join(groups, F.col("doc_id") == F.col("node"), "left")
    result = whole.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.chunks(batch, 1):
                n = np.bincount(_sets(part.column(1), size)[0], minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), part.column(0)], names=["doc_id", "n_shingles", "component_id"])

    nameless = named.where("doc_id IS NULL").mapInArrow(sizes, "doc_id long, n_shingles long, component_id long")
    return result.unionByName(nameless)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose document is the smallest id of its component; rows without an id stay."""
    found = near_duplicates(docs, id_col, text_col)
    gone = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__sparkloom_gone"))
    return docs.join(if_small(gone), whole_id(docs, id_col) == F.col("__sparkloom_gone"), "left_anti")
