"""A corpus pipeline of five stages over documents, each by one operator of sparkloom.llm.

Every stage gets all rows that its predecessor kept; all but the last return the columns of documents. In every stage an
empty table gives no rows, rows repeated in full are treated alike, and texts of any length are worked on whole. Null texts
have no words and go in the first stage; the others would keep them. Rows without an id are kept apart: they are no
one's near copy, and rank last among equal passages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontamination, jaccard_join, line_dedup, quality_rules, sentencepiece_codec
from sparkloom.llm.common import stored


def _with_text(docs: DataFrame, names: list[str], text: str) -> DataFrame:
    """The columns named, text replaced and n_chars, where there is one, counted anew."""
    values = {"text": F.col(text), "n_chars": F.length(F.col(text)).cast("long")}
    return docs.select(*[values[c].alias(c) if c in values else F.col(c) for c in names])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that too many documents of their host share."""
    return _with_text(quality_rules.clean(docs), docs.columns, "text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by shingle similarity of 75 % or more."""
    return jaccard_join.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document, or an earlier place, already has."""
    return _with_text(line_dedup.remove_repeated_units(docs, line=line_dedup.LONG_LINE_WORDS, passage=line_dedup.PASSAGE_WORDS), docs.columns, "kept_text")


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, text, lang, source, ids, n_ids, and whether decoding the ids gives the text again."""
    both = sentencepiece_codec.encode(docs.select("doc_id", "text", "lang", "source"), decoded_col="decoded")
    same = F.col("decoded").eqNullSafe(F.col("text"))
    return both.select("doc_id", "text", "lang", "source", "ids", F.size("ids").cast("long").alias("n_ids"), same.alias("round_trip"))


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_leaks),
    ("sentencepiece", tokens),
]

#: SQL cannot express the near-duplicate components, the passages and the token ids; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stored in the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
