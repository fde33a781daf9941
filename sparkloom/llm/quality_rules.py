"""Quality rules over each text and over lines that many documents of a host share. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import bind, without_space, words_of

#: The characters counted as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def _has_word(line: Column) -> Column:
    return F.length(without_space(line)) > 0


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), _has_word)


def normalised_line(line: Column) -> Column:
    """Lower case, all white space left out: lines that look alike are one line."""
    return F.lower(without_space(line))


def line_hash(line: Column) -> Column:
    return F.xxhash64(normalised_line(line))


def word_figures(words: Column) -> Column:
    """(n_words, n_repeat_words) of an array of words that is worked out once; the second are the words inside windows of eight words that the text holds twice or more, the first one included.

    Each window's hash comes from three pairings of shifted arrays (2, 4, 8 words). A text whose window
    hashes are all distinct ends there; else the hashes are sorted with their places, neighbours compared,
    and the places' covers added up. Work per text is n log n, and nothing is exploded or shuffled.
    """

    def paired(hashes: Column, by: int) -> Column:
        return bind(hashes, lambda h: F.zip_with(h, F.slice(h, by + 1, F.size(h)), lambda a, b: F.xxhash64(a, b)))

    def covered(places: Column) -> Column:
        following = F.slice(places, 2, F.greatest(F.size(places), F.lit(1)))
        gaps = F.zip_with(places, following, lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)

    def from_windows(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda h, p: F.struct(h.alias("h"), p.alias("p"))))

        def repeated(rows: Column) -> Column:
            before = F.concat(F.array(F.lit(None).cast("long")), F.transform(rows, lambda r: r["h"]))
            after = F.slice(F.transform(rows, lambda r: r["h"]), 2, F.size(rows))
            twice = F.zip_with(
                F.zip_with(rows, F.slice(before, 1, F.size(rows)), lambda r, b: F.struct(r.alias("r"), b.alias("b"))),
                after,
                lambda x, a: F.when(x["r"]["h"].eqNullSafe(x["b"]) | x["r"]["h"].eqNullSafe(a), x["r"]["p"]),
            )
            return F.sort_array(F.filter(twice, lambda p: p.isNotNull()))

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(
            bind(bind(placed, repeated), covered)
        )

    def from_words(w: Column) -> Column:
        eight = paired(paired(paired(F.transform(w, lambda x: F.xxhash64(x)), 1), 2), 4)
        windows = F.slice(eight, 1, F.greatest(F.size(w) - (WINDOW - 1), F.lit(0)))
        return F.when(F.size(w) < 2, F.lit(0)).when(F.size(w) < WINDOW + 1, F.lit(0)).otherwise(bind(windows, from_windows))

    return bind(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), from_words(w).cast("long").alias("n_repeat_words")))


def base_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed of each row, plus the columns named in keep."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(
        F.col(id_col).alias("doc_id"),
        *[F.col(c) for c in keep if c != id_col],
        word_figures(words_of(text)).alias("_w"),
        F.length(without_space(text)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        bind(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).select("doc_id", *[c for c in keep if c != id_col], "_w.n_words", "word_chars", "n_symbols", "n_dup_lines", "_w.n_repeat_words")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return found.withColumn("base_failed", failed)


def _document(id_col: str, text_col: str) -> Column:
    """What rows of one document share: their id, or their text if they have none."""
    return F.when(F.col(id_col).isNull(), F.xxhash64(F.lit("text"), F.col(text_col))).otherwise(F.xxhash64(F.col(id_col)))


def frequent_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = 10, host_share: float = 0.10) -> DataFrame:
    """(host, line): hashes of normalised lines found in more documents of the host than both limits allow.

    Documents are distinct ids (texts, where there is no id), of lines and of hosts alike: a row that is repeated counts once.
    Spark dedups (host, line, document) before it counts, so that a host with a third of all rows, or a line that all of its documents
    hold, is spread over all tasks.
    """
    rows = docs.select(F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("_host"), _document(id_col, text_col).alias("_doc"), F.col(text_col).alias("_text"))
    lines = rows.select("_host", "_doc", F.explode(F.array_distinct(F.transform(_lines(F.col("_text")), line_hash))).alias("_line"))
    counted = lines.groupBy("_host", "_line").agg(F.count_distinct("_doc").alias("_n")).where(F.col("_n") > min_docs)
    hosts = rows.groupBy("_host").agg(F.count_distinct("_doc").alias("_docs"))
    return counted.join(hosts, "_host").where(F.col("_n") > host_share * F.col("_docs")).select("_host", "_line")


def _slim(docs: DataFrame, id_col: str, text_col: str, host_col: str, *more: Column) -> DataFrame:
    """Only what the rules read, under names of its own; null hosts are one host."""
    host = F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), host.alias("source"), *more)


def _flagged(slim: DataFrame, min_docs: int, host_share: float) -> DataFrame:
    """(_id, _host, _text, _bad): the frequent lines of each document that has one, as (place, hash, words)."""
    each = F.transform(_lines(F.col("text")), lambda x: F.struct(line_hash(x).alias("h"), F.size(words_of(x)).alias("w")))
    rows = slim.select(F.col("doc_id").alias("_id"), F.col("source").alias("_host"), F.xxhash64("text").alias("_text"), F.posexplode(each).alias("_at", "_x"))
    rows = rows.select("_id", "_host", "_text", "_at", F.col("_x.h").alias("_line"), F.col("_x.w").alias("_w"))
    return (
        rows.join(frequent_lines(slim, min_docs=min_docs, host_share=host_share), ["_host", "_line"])
        .groupBy("_id", "_host", "_text")
        .agg(F.collect_set(F.struct("_at", "_line", "_w")).alias("_bad"))
    )


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = 10, host_share: float = 0.10, min_words_left: int = 10, min_share_left: float = 0.3) -> DataFrame:
    """Statistics and verdict for each row of docs; no text is shuffled.

    A line that more than min_docs documents and more than host_share of the documents of its host hold
    (normalised, counted once a document) is removed; a document left with fewer than min_words_left words or
    less than min_share_left of its words is depleted and rejected, as is one that fails the base rules.
    Null and empty texts have no words and fail the base rules; null hosts are one host; rows with equal or
    null ids are judged each by its own text; an empty table gives no rows; very long texts are worked on whole; other
    columns are ignored.
    """
    slim = _slim(docs, id_col, text_col, host_col)
    stats = base_statistics(slim.withColumns({"_host": F.col("source"), "_text": F.xxhash64("text")}), keep=("_host", "_text"))
    bad = _flagged(slim, min_docs, host_share)
    removed = F.aggregate("_bad", F.lit(0), lambda total, x: total + x["_w"])
    bad = bad.select(F.col("_id"), F.col("_host").alias("_h"), F.col("_text").alias("_t"), removed.alias("_removed"))
    joined = stats.join(bad, stats["doc_id"].eqNullSafe(bad["_id"]) & (stats["_host"] == bad["_h"]) & (stats["_text"] == bad["_t"]), "left")
    left = F.col("n_words") - F.coalesce("_removed", F.lit(0))
    depleted = (left < min_words_left) | (left < min_share_left * F.col("n_words"))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        left.alias("n_words_left"), (~F.col("base_failed") & ~depleted).alias("kept"),
    )


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = 10, host_share: float = 0.10, min_words_left: int = 10, min_share_left: float = 0.3) -> DataFrame:
    """The rows of docs that assess() keeps, with all their columns, and with frequent lines taken out of the texts;
    nulls, repeats, long texts and empty tables as there."""
    slim = _slim(docs, id_col, text_col, host_col, F.struct(*docs.columns).alias("_row"))
    bad = _flagged(slim, min_docs, host_share).select(
        F.col("_id"), F.col("_host"), F.col("_text"), F.transform("_bad", lambda x: x["_line"]).alias("_lines"),
        F.aggregate("_bad", F.lit(0), lambda total, x: total + x["_w"]).alias("_removed"),
    )
    passed = base_statistics(slim, keep=("text", "source", "_row")).where(~F.col("base_failed"))
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("source") == F.col("_host")) & (F.xxhash64("text") == F.col("_text"))
    left = F.col("n_words") - F.coalesce("_removed", F.lit(0))
    kept = passed.join(bad, on, "left").where((left >= min_words_left) & (left >= min_share_left * F.col("n_words")))
    fewer = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("_lines", line_hash(x))), "\n")
    text = F.when(F.col("_lines").isNull(), F.col("text")).otherwise(fewer)
    return kept.select(*[text.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns])
