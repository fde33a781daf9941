"""Vector, full-text, trigram and hybrid search on built-in functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.session import kept


def _sum(pairs: Column) -> Column:
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def distance(metric: str, a: Column, b: Column) -> Column:
    """l2, l1, ip (negative inner product), cosine (1 - similarity; a zero vector has similarity 0) or hamming distance."""
    a, b = _double(a), _double(b)
    if metric == "l2":
        return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))
    if metric == "l1":
        return _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    if metric == "ip":
        return -dot(a, b)
    if metric == "hamming":
        return _sum(F.zip_with(a, b, lambda x, y: F.when(x != y, 1.0).otherwise(0.0)))
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return 1 - F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def knn(df: DataFrame, vector: str, target: Column, k: int, metric: str = "l2", tie: str = "vec_id", before: Column | None = None, after: Column | None = None) -> DataFrame:
    """The k nearest rows with _distance. `before` filters first (k rows of those that pass), `after` filters the k (fewer may stay).

    Spark keeps k rows a task and merges them (TakeOrderedAndProject); nothing is sorted as a whole.
    """
    rows = df if before is None else df.where(before)
    near = rows.withColumn("_distance", distance(metric, F.col(vector), target)).orderBy("_distance", tie).limit(k)
    return near if after is None else near.where(after)


#: Numbers of the queries' vectors that are sent to every executor at once, 8 bytes each; products a partition of knn_join() works
#: out, and distances at once.
BROADCAST_NUMBERS, TASK_PRODUCTS, CHUNK_DISTANCES = 4_000_000, 1 << 32, 1 << 21


def _pairs(rows: DataFrame, wanted: DataFrame, row_id: str, vector: str, metric: str) -> DataFrame:
    pairs = rows.select(row_id, vector).crossJoin(F.broadcast(wanted))
    return pairs.select(F.col("_q").alias("query"), F.col(row_id).alias("neighbour"), distance(metric, F.col(vector), F.col("_v")).alias("_distance"))


def _nearest(ids: np.ndarray, q: np.ndarray, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (id, vector) to the k nearest rows of each query in the partition. A matrix product bounds each distance within its
    rounding; what may be among the nearest is measured as distance() does, in its order of summing, and ties go by id."""
    chunk = CHUNK_DISTANCES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, d = q.shape
        norm = (q * q).sum(axis=1)
        slack = (d + 8) * 8 * np.finfo(np.float64).eps
        of, at, far = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        limit = np.full(m, np.inf)
        for batch in batches:
            for since in range(0, len(batch), max(1, chunk // m)):
                part = batch.slice(since, max(1, chunk // m))
                row = part.column(0).to_numpy(zero_copy_only=False)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                both = (x * x).sum(axis=1)[None, :] + norm[:, None]
                about, error = both - 2 * (q @ x.T), both * slack
                top = limit
                if len(x) > k and np.isinf(limit).any():
                    top = np.minimum(limit, np.partition(about + error, k - 1, axis=1)[:, k - 1])
                i, j = np.nonzero(about - error <= top[:, None])
                if not len(i):
                    continue
                total = np.zeros(len(i))
                for c in range(d):
                    gap = x[j, c] - q[i, c]
                    total += gap * gap
                of, at, far = np.concatenate((of, i)), np.concatenate((at, row[j])), np.concatenate((far, np.sqrt(total)))
                order = np.lexsort((at, far, of))
                of = of[order]
                first = np.searchsorted(of, of)
                best = np.arange(len(of)) - first < k
                of, at, far = of[best], at[order][best], far[order][best]
                full = np.flatnonzero(np.arange(len(of)) - np.searchsorted(of, of) == k - 1)
                limit[of[full]] = far[full] ** 2 * (1 + 4 * np.finfo(np.float64).eps)
        yield pa.RecordBatch.from_arrays([pa.array(ids[of]), pa.array(at), pa.array(far)], names=["query", "neighbour", "_distance"])

    return run


def knn_join(queries: DataFrame, df: DataFrame, query_id: str, query_vector: str, row_id: str, vector: str, k: int, metric: str = "l2") -> DataFrame:
    """The k nearest rows for each query, exactly. Queries are counted and sent in blocks of BROADCAST_NUMBERS numbers at
    most. With l2 and whole numbers as ids, distances come from matrix products of blocks, in tasks of TASK_PRODUCTS; null, uneven
    and very large vectors, other metrics and other ids go by pairs. k rows a task and query are kept before anything is shuffled."""
    wanted = queries.select(F.col(query_id).alias("_q"), F.col(query_vector).alias("_v"))
    numbers, size = wanted.agg(F.sum(F.size("_v")), F.max(F.size("_v"))).first()
    blocks = max(1, -(-2 * numbers // BROADCAST_NUMBERS)) if (numbers or 0) > BROADCAST_NUMBERS else 1
    whole = {"tinyint", "smallint", "int", "bigint"}
    fast = metric == "l2" and (size or 0) > 0 and k > 0 and dict(wanted.dtypes)["_q"] in whole and dict(df.dtypes)[row_id] in whole
    if fast:
        even = lambda i, v: F.coalesce(F.col(i).isNotNull() & (F.size(v) == size) & F.forall(_double(F.col(v)), lambda y: F.coalesce(F.abs(y) < 1e100, F.lit(False))), F.lit(False))
        good, odd = df.where(even(row_id, vector)).select(F.col(row_id).cast("long").alias("i"), _double(F.col(vector)).alias("v")), df.where(~even(row_id, vector))
        n, some = good.count(), not odd.isEmpty()
    found = None
    for block in range(blocks):
        part = wanted.where(F.pmod(F.xxhash64("_q"), F.lit(blocks)) == block)
        if fast:
            sent = part.where(even("_q", "_v")).select(F.col("_q").cast("long"), _double(F.col("_v")).alias("_v")).toArrow()
            q = np.array(sent.column("_v").to_pylist(), np.float64).reshape(-1, size)
            parts = max(1, -(-n * q.size // TASK_PRODUCTS))
            rows = good.repartition(parts, "i") if parts > 1 else good
            measured = rows.mapInArrow(_nearest(sent.column("_q").to_numpy(), q, k), "query long, neighbour long, _distance double")
            types = {"query": dict(wanted.dtypes)["_q"], "neighbour": dict(df.dtypes)[row_id]}
            measured = measured.select(*[F.col(c).cast(t).alias(c) for c, t in types.items()], "_distance") if len(q) else None
            others = part.where(~even("_q", "_v"))
            rest = [_pairs(odd, part, row_id, vector, metric)] if some else []
            if sent.num_rows == 0 or not others.isEmpty():
                rest.append(_pairs(df.where(even(row_id, vector)), others, row_id, vector, metric))
            for more in rest:
                measured = more if measured is None else measured.unionByName(more)
        else:
            measured = _pairs(df, part, row_id, vector, metric)
        rank = F.row_number().over(Window.partitionBy("query").orderBy("_distance", "neighbour"))
        near = measured.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)
        found = near if found is None else found.unionByName(near)
    return found


def within(df: DataFrame, vector: str, target: Column, most: float, metric: str = "l2") -> DataFrame:
    """Rows at a distance of at most `most`, with _distance."""
    return df.withColumn("_distance", distance(metric, F.col(vector), target)).where(F.col("_distance") <= most)


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def fts_match(text: Column, query: list[str], mode: str = "and") -> Column:
    """Whether a text has all (and) or any (or) of the query's terms."""
    has = [F.array_contains(terms(text), q.lower()) for q in query]
    found = has[0]
    for h in has[1:]:
        found = found & h if mode == "and" else found | h
    return found


def _occurrences(tokens: Column, term: str) -> Column:
    return F.size(F.filter(tokens, lambda t: t == term))


def fixed_bm25(text: Column, query: list[str], k1: float = 1.2, b: float = 0.75, average: float = 50.0) -> Column:
    """BM25 without document frequencies and with a fixed average length; split at white space, cases matter."""
    tokens = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    total = F.lit(0.0)
    for q in query:
        tf = _occurrences(tokens, q).cast("double")
        total = total + F.when(tf > 0, tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.size(tokens) / average))).otherwise(0.0)
    return total


def inverted_index(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(term, id, tf, length) for every term of every text."""
    each = df.select(F.col(row_id).alias("id"), terms(F.col(text)).alias("_t")).select("id", F.size("_t").alias("length"), F.explode("_t").alias("term"))
    return each.groupBy("term", "id", "length").agg(F.count(F.lit(1)).alias("tf"))


def _occurring(df: DataFrame, row_id: str, text: str, query: list[str]) -> tuple[DataFrame, DataFrame]:
    """((term, id, tf, length) of the query's terms, and one row with n and average) of a table. Texts are read and split
    once; what both come from, a length and the found terms a text, is stored."""
    wanted = sorted({q.lower() for q in query})
    tokens = df.select(F.col(row_id).alias("id"), terms(F.col(text)).alias("_t"))
    slim = kept(tokens.select("id", F.size("_t").alias("length"), F.filter("_t", lambda t: t.isin(wanted)).alias("_t")))
    tf = slim.where(F.size("_t") > 0).select("id", "length", F.explode("_t").alias("term")).groupBy("term", "id", "length").agg(F.count(F.lit(1)).alias("tf"))
    return tf, slim.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("average"))


def _bm25(tf: DataFrame, whole: DataFrame, k1: float, b: float) -> DataFrame:
    df_t = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("average")))
    return tf.join(F.broadcast(df_t), "term").crossJoin(F.broadcast(whole)).groupBy("id").agg(F.sum(part).alias("score"))


def bm25(df: DataFrame, row_id: str, text: str, query: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) by BM25 over the whole table; of the texts only the query's terms go on, a row a term of the query is broadcast."""
    return _bm25(*_occurring(df, row_id, text, query), k1, b)


def tf_idf(df: DataFrame, row_id: str, text: str, query: list[str]) -> DataFrame:
    """(id, score): the sum of tf / length * ln(n / df) over the query's terms."""
    tf, whole = _occurring(df, row_id, text, query)
    df_t = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    part = F.col("tf") / F.col("length") * F.log(F.col("n") / F.col("df"))
    return tf.join(F.broadcast(df_t), "term").crossJoin(F.broadcast(whole)).groupBy("id").agg(F.sum(part).alias("score"))


def term_frequency(df: DataFrame, row_id: str, text: str, query: list[str]) -> DataFrame:
    """(id, score): occurrences of the query's terms over the text's length."""
    return _occurring(df, row_id, text, query)[0].groupBy("id").agg((F.sum("tf") / F.max("length")).alias("score"))


def proximity(text: Column, a: str, b: str) -> Column:
    """The least distance in terms between two terms of a text; null if it lacks one.

    The places of both terms in order, and only neighbours of different terms, are compared.
    """
    places = F.filter(F.transform(terms(text), lambda t, i: F.when(t == a.lower(), F.struct(i.alias("i"), F.lit(0).alias("k"))).when(t == b.lower(), F.struct(i.alias("i"), F.lit(1).alias("k")))), lambda x: x.isNotNull())
    start = F.struct(F.lit(None).cast("int").alias("least"), F.lit(None).cast("int").alias("i"), F.lit(None).cast("int").alias("k"))

    def step(s: Column, x: Column) -> Column:
        near = F.when(s["k"] != x["k"], x["i"] - s["i"])
        return F.struct(F.least(s["least"], near).alias("least"), x["i"].alias("i"), x["k"].alias("k"))

    return F.aggregate(places, start, step, lambda s: s["least"])


def search_index(index: DataFrame, query: list[str], n_texts: int, average: float, mode: str = "or", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) by BM25 from inverted_index() alone: only the query's terms are read, which prunes files sorted by term.

    n_texts and average are the number of indexed texts and their mean length; with mode "and" texts have all terms.
    """
    wanted = sorted({q.lower() for q in query})
    hits = index.where(F.col("term").isin(wanted))
    whole = index.sparkSession.range(1).select(F.lit(n_texts).alias("n"), F.lit(average).alias("average"))
    found = _bm25(hits, whole, k1, b)
    if mode == "or":
        return found
    every = hits.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(wanted)).select("id")
    return found.join(every, "id", "left_semi")


def trigram_join(left: DataFrame, right: DataFrame, a: str, b: str, least: float = 0.3) -> DataFrame:
    """Pairs (a, b, sim) with a < b and a similarity of `least` or more (the % operator), by a join on shared trigrams.

    Trigrams are ordered by frequency, rare first, and only the first ones of each text are joined: of a text's n trigrams,
    a partner must have ceil(least * n), so one of the first n - ceil(least * n) + 1 is shared.
    """
    x, y = left.select(F.col(a).alias("a")).distinct(), right.select(F.col(b).alias("b")).distinct()
    count = x.select(F.explode(trigrams(F.col("a"))).alias("g")).unionByName(y.select(F.explode(trigrams(F.col("b"))).alias("g"))).groupBy("g").agg(F.count(F.lit(1)).alias("df"))

    def prefix(df: DataFrame, name: str) -> DataFrame:
        each = df.select(name, F.explode(trigrams(F.col(name))).alias("g")).join(count, "g")
        ordered = each.groupBy(name).agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("_o"))
        first = F.size("_o") - F.ceil(F.lit(least) * F.size("_o")).cast("int") + 1
        return ordered.select(name, F.explode(F.slice("_o", 1, F.least(first, F.size("_o")))).alias("_x")).select(name, F.col("_x.g").alias("g"))

    pairs = prefix(x, "a").join(prefix(y, "b"), "g").where(F.col("a") < F.col("b")).select("a", "b").distinct()
    return pairs.withColumn("sim", similarity(F.col("a"), F.col("b"))).where(F.col("sim") >= least)


def trigrams(text: Column) -> Column:
    """The distinct 3-grams of a lower-cased text, two spaces before and one after it."""
    padded = F.concat(F.lit("  "), F.lower(text), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3))))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of two texts."""
    x, y = trigrams(a), trigrams(b)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def reciprocal_rank_fusion(rankings: list[DataFrame], k: int = 60) -> DataFrame:
    """(id, score): the sum of 1 / (k + rank) over rankings of (id, rank)."""
    all_of = rankings[0]
    for r in rankings[1:]:
        all_of = all_of.unionByName(r)
    return all_of.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def weighted_fusion(text: Column, vector: Column, alpha: float) -> Column:
    """alpha * s / (s + 1) + (1 - alpha) / (1 + d) of a text score s and a distance d."""
    return alpha * text / (text + 1) + (1 - alpha) / (1 + vector)
