"""The corpus operators' queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontamination, jaccard_join, line_dedup, lm_scoring, quality_classifier, quality_rules, sentencepiece_codec, suffix_dedup, token_counts, warc


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    rules = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.predict(docs, rules)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    both = sentencepiece_codec.encode(docs, decoded_col="decoded")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"), "ids")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    return line_dedup.remove_repeated_units(docs, line=line_dedup.LONG_LINE_WORDS, passage=line_dedup.PASSAGE_WORDS).select("doc_id", F.size("spans").cast("long").alias("n_spans"), removed.alias("n_removed"), "spans", "kept_text")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.assess(_documents(spark, sf_dir))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_documents(spark, sf_dir))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 AND toxic = 0")
    return lm_scoring.cross_entropy_difference(_documents(spark, sf_dir), good)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.assess(_documents(spark, sf_dir), benchmark).drop("key").withColumn("items", F.array_join("items", ","))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_warc": op5_warc,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_decontamination": op8_decontamination,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_token_counts": op10_token_counts,
}

ORACLES: dict[str, str] = {
    "op4_quality_rules": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        l AS (SELECT doc_id, host, line, lower(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS same, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
            FROM (SELECT doc_id, host, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
        dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l GROUP BY doc_id),
        hosts AS (SELECT host, count(*) AS docs FROM d GROUP BY host),
        common AS (SELECT host, same FROM (SELECT host, same, count(DISTINCT doc_id) AS n FROM l GROUP BY host, same) JOIN hosts USING (host) WHERE n > 10 AND n > 0.1 * docs),
        gone AS (SELECT doc_id, sum(n) AS n FROM l JOIN common USING (host, same) GROUP BY doc_id),
        win AS (SELECT doc_id, p, hash(w[p:p + 7]) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM d WHERE len(w) >= 8)),
        twice AS (SELECT doc_id, p FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, h) > 1),
        cover AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM twice, range(8) r(k) GROUP BY doc_id),
        s AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
            CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
            CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(w) - coalesce(gone.n, 0) AS BIGINT) AS n_words_left
            FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN cover USING (doc_id) LEFT JOIN gone USING (doc_id)),
        b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_words_left,
            NOT base_failed AND n_words_left >= 10 AND n_words_left >= 0.3 * n_words AS kept FROM b""",
    "op6_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY doc_id),
        o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
        e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
        u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        r(doc_id, seen) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, u.b FROM r JOIN u ON u.a = r.seen)
        SELECT r.doc_id, any_value(n.n) AS n_shingles, min(seen) AS component_id FROM r JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
    "op8_decontamination": r"""
        WITH c AS (SELECT ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || '.,;:!?"''()[]{}*#$%&|<>-_/\`~^+=@' AS f),
        d AS (SELECT doc_id, list_filter(string_split(translate(lower(coalesce(text, '')), f, '      '), ' '), lambda x: x <> '') AS w FROM documents, c),
        i AS (SELECT item_id, list_filter(string_split(translate(lower(coalesce(text, '')), f, '      '), ' '), lambda x: x <> '') AS w FROM benchmark, c),
        db AS (SELECT doc_id, p, hash(w[p], w[p + 1]) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS p FROM d)),
        ib AS (SELECT item_id, p, hash(w[p], w[p + 1]) AS h FROM (SELECT item_id, w, unnest(range(1, len(w))) AS p FROM i WHERE len(w) >= 8)),
        hit AS (SELECT DISTINCT doc_id, item_id, db.p - ib.p AS s FROM db JOIN ib USING (h)),
        m AS (SELECT doc_id, item_id, least(len(i.w), 24) AS l, list_transform(range(1, len(i.w) + 1), lambda q: CASE WHEN q + s >= 1 AND d.w[q + s] = i.w[q] THEN 1 ELSE 0 END) AS m FROM hit JOIN d USING (doc_id) JOIN i USING (item_id)),
        n AS (SELECT doc_id, item_id, l, list_max(list_transform(range(1, len(m) - l + 2), lambda q: list_sum(m[q:q + l - 1]))) AS k FROM m WHERE list_sum(m) >= 8),
        bad AS (SELECT doc_id, list_sort(list_distinct(list(item_id))) AS items, max(k / l) AS best FROM n WHERE k >= 8 AND k >= 0.6 * l GROUP BY doc_id)
        SELECT doc_id, items IS NOT NULL AS contaminated, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, coalesce(array_to_string(items, ','), '') AS items, CAST(coalesce(best, 0) AS DOUBLE) AS best_share FROM documents LEFT JOIN bad USING (doc_id)""",
    "op9_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        win AS (SELECT doc_id, p, hash(x[2 * p + 1:2 * p + 400]) AS h FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 199)) AS p FROM d WHERE length(x) >= 400)),
        hit AS (SELECT doc_id, p FROM win QUALIFY count(*) OVER (PARTITION BY h) > 1),
        edge AS (SELECT doc_id, p, p > coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200, -1) AS new FROM hit),
        runs AS (SELECT doc_id, p, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM edge),
        span AS (SELECT doc_id, run, min(p) AS a, max(p) + 200 AS b FROM runs GROUP BY doc_id, run),
        cut AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM span),
        kept AS (SELECT doc_id, count(*) AS n, sum(b - a) AS gone, max(b) AS last, string_agg(x[2 * before + 1:2 * a], '' ORDER BY a) AS head FROM cut JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
            sha256(unhex(coalesce(head, '') || CASE WHEN last IS NULL THEN x ELSE x[2 * last + 1:] END)) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op5_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
            CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN first <> page_id THEN first END AS refers_to FROM f""",
}
