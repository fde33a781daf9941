"""Benchmark decontamination by spaced seeds and substitution-tolerant overlaps around their hits. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import WHITE_SPACE, bind, if_small

#: Fewest words of an item that is searched for, and fewest matches that count.
SPAN = 8
#: Words of an item by which an overlap is judged: so many in a row, or the whole item if it has fewer.
STRETCH = 24
#: Fixed masks: of four words in a row, those that a seed keeps; the others are ignored.
MASKS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
#: Least share of a stretch's words that the masks are made for.
LEAST_SHARE = 0.6
#: Characters that are no part of a token.
PUNCTUATION = ".,;:!?\"'()[]{}*#$%&|<>-_/\\`~^+=@"
#: Most seeds of a benchmark that are sent to every executor, about 32 bytes each, and three for each of its words; beyond
#: it seeds and the texts' words around them are shuffled.
BROADCAST_SEEDS = 1_000_000
#: Places before and after a seed's first word that a stretch with the seed can reach.
_BEFORE, _AFTER = STRETCH - 3, STRETCH - 1


def token_hashes(text: Column) -> Column:
    """Hashes of the text's words, lower-cased and without punctuation; null text has none."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), WHITE_SPACE + PUNCTUATION, " " * len(WHITE_SPACE))
    return F.transform(F.array_remove(F.split(plain, " "), ""), lambda w: F.xxhash64(w))


def _seed(tokens: str, at: Column, number: int) -> Column:
    return F.xxhash64(F.lit(number), *[F.get(tokens, at + k) for k in MASKS[number]])


def _around(tokens: str, at: Column, first: Column, n: Column) -> Column:
    """n tokens from the place `first` after `at`."""
    return F.slice(tokens, at + first + 1, n)


def _seeds(items: DataFrame) -> DataFrame:
    """(_seed, item, _from): every masked run of an item's words by hash, once for all places of the item with the same words around."""
    placed = items.select("item", "words", F.explode(F.sequence(F.lit(0), F.size("words") - 3)).alias("_from"))
    first = F.greatest(F.lit(-_BEFORE), -F.col("_from"))
    near = _around("words", F.col("_from"), first, F.least(F.lit(_AFTER), F.size("words") - 1 - F.col("_from")) - first + 1)
    one = placed.select("item", "words", "_from", first.alias("_first"), near.alias("_near")).groupBy("item", "_first", "_near").agg(F.min("_from").alias("_from"), F.first("words").alias("words"))
    kept = [F.when(F.col("_from") + max(m) < F.size("words"), _seed("words", F.col("_from"), k)) for k, m in enumerate(MASKS)]
    return one.select(F.explode(F.array(*kept)).alias("_seed"), "item", "_from").where("_seed IS NOT NULL")


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", share: float = LEAST_SHARE) -> DataFrame:
    """(key, id, item, item_id, start, n_words, n_matched): the best stretch around the seeds of each item placed on each text.

    start is the token place in the text at which the item's first word would stand (it may be negative); n_words is
    STRETCH, or the item's number of words if it has fewer, and n_matched how many of so many words in a row equal the
    text's. Placements that do not reach SPAN matches and `share` are left out. Of an item's places with the same words around,
    as where a word is repeated, one stands for all. key is a hash of a row's id and text, item one of an item's.

    No placement that counts is missed: of the k matches among n words, k - 2 runs of three in a row span 2 n - 4 places
    together at most, so that with k >= 0.6 n one spans three or fewer, and the masks are all the ways to do so.
    """
    if share < LEAST_SHARE:
        raise ValueError(f"share must be {LEAST_SHARE} or more, or the masks would miss overlaps")
    words = benchmark.select(F.xxhash64(F.col(item_col), F.col(item_text_col)).alias("item"), F.col(item_col).alias("item_id"), token_hashes(F.col(item_text_col)).alias("words"))
    words = words.where(F.size("words") >= SPAN).dropDuplicates(["item"])
    seeds = _seeds(words)
    small = seeds.count() <= BROADCAST_SEEDS
    near = F.broadcast if small else lambda df: df
    texts = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.col(id_col).alias("id"), token_hashes(F.col(text_col)).alias("tokens"))
    # the array is named by place in generated code and is not copied for each row
    spots = texts.where(F.size("tokens") >= 3).select("*", F.explode(F.sequence(F.lit(0), F.size("tokens") - 3)).alias("_at"))
    hashes = F.array(*[_seed("tokens", F.col("_at"), k) for k in range(len(MASKS))])
    if not small:  # a bounded part of the text goes with its seeds
        from_ = F.greatest(F.col("_at") - _BEFORE, F.lit(0))
        part = F.slice("tokens", from_ + 1, _BEFORE + _AFTER + 1)
        spots = spots.select("key", "id", part.alias("tokens"), (F.col("_at") - from_).alias("_at"), from_.alias("_moved"), hashes.alias("_hashes"))
        found = spots.select("key", "id", "tokens", "_at", "_moved", F.explode("_hashes").alias("_seed")).join(seeds, "_seed").join(words, "item")
    else:
        found = spots.select("*", F.lit(0).alias("_moved"), F.explode(hashes).alias("_seed")).join(near(seeds), "_seed").join(near(words), "item")
    at, from_ = F.col("_at"), F.col("_from")
    first = F.greatest(F.lit(-_BEFORE), -at, -from_)
    n = F.least(F.lit(_AFTER), F.size("tokens") - 1 - at, F.size("words") - 1 - from_) - first + 1
    both = F.struct(_around("tokens", at, first, n).alias("there"), _around("words", from_, first, n).alias("expected"))
    # a generator lets no filter pass, and rows leave generated code without the text's tokens
    slim = found.select("key", "id", "item", "item_id", (at + F.col("_moved") - from_).alias("start"), F.least(F.size("words"), F.lit(STRETCH)).alias("n_words"), F.explode(F.array(both)).alias("_both"))
    matched = F.zip_with("_both.there", "_both.expected", lambda a, b: F.when(a == b, 1).otherwise(0))
    total = lambda flags: F.aggregate(flags, F.lit(0), lambda s, x: s + x)
    need = F.greatest(F.lit(SPAN), F.ceil(F.lit(share) * F.col("n_words"))).cast("int")
    stretches = lambda flags: F.array_max(F.transform(F.sequence(F.lit(1), F.size(flags) - F.col("n_words") + 1), lambda k: total(F.slice(flags, k, F.col("n_words")))))
    best = bind(matched, lambda flags: F.when(total(flags) < need, F.lit(0)).when(F.size(flags) <= F.col("n_words"), total(flags)).otherwise(stretches(flags)))
    judged = slim.withColumn("n_matched", best).where(F.col("n_matched") >= need)
    return judged.groupBy("key", "item", "start").agg(F.first("id").alias("id"), F.first("item_id").alias("item_id"), F.first("n_words").alias("n_words"), F.max("n_matched").alias("n_matched"))


def assess(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = LEAST_SHARE, **names: str) -> DataFrame:
    """key, doc_id, contaminated, n_items, items, best_share for every row of docs.

    A text is contaminated by an item if, in place, at least `share` of STRETCH of the item's words in a row, and SPAN of
    them, equal the text's; of an item with fewer words, of all its words. Every such overlap is found (see overlaps()),
    and nothing outside the stretch counts, however long text and item are. Items under SPAN words are no evidence and are
    passed over, as are null texts and items. Each item row is judged by its own text: n_items counts the rows found
    (rows repeated in full once), items lists their ids, without null ones. An empty benchmark contaminates nothing, an
    empty table gives no rows; rows with equal or null ids are judged each by its text; very long texts are searched whole;
    other columns are ignored. Texts are not shuffled: the benchmark's seeds go to the executors if a count shows that they
    are few enough.
    """
    hits = overlaps(docs, benchmark, id_col, text_col, share=share, **names)
    found = hits.groupBy("key").agg(
        F.sort_array(F.collect_set("item_id")).alias("items"), F.count_distinct("item").alias("n_items"), F.max(F.col("n_matched") / F.col("n_words")).alias("best_share")
    )
    rows = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.col(id_col).alias("doc_id"))
    return rows.join(found, "key", "left").select(
        "key", "doc_id", F.col("best_share").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast(found.schema["items"].dataType)).alias("items"), F.coalesce("best_share", F.lit(0.0)).alias("best_share"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """The rows of docs that no item contaminates, with all their columns; see assess() for nulls, repeats and empty tables."""
    bad = overlaps(docs, benchmark, id_col, text_col, **more).select(F.col("key").alias("__sparkloom_key")).distinct()
    return docs.join(if_small(bad), F.xxhash64(F.col(id_col), F.col(text_col)) == F.col("__sparkloom_key"), "left_anti")
