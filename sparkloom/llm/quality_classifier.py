"""Quality classifier: a sparse ensemble of rules over text statistics, compiled to a column expression.

Small trees are grown on a bounded, deterministic sample of labelled rows; every path from a root is a
conjunctive rule; lasso logistic regression over the rules keeps a few of them; and the kept rules with their
weights become one Spark expression, so that scoring is a projection without a shuffle or Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import bind, words_of

#: Most labelled rows that a fit collects: the first by hash of their id. More labels do not change its cost.
FIT_ROWS = 20_000
SYMBOLS = "#*$%&|<>"
STATISTICS = ("n_words", "word_length", "distinct_share", "upper_share", "digit_share", "symbol_share", "exclaim_share", "stop_share", "line_words")


def statistics(text: Column) -> Column:
    """A struct of STATISTICS of a text; shares are of its characters or words, and 0 where there are none.

    Upper case, digits and symbols are mapped to one character a class in a single pass, then counted by
    removing that character; words are split once.
    """
    text = F.coalesce(text, F.lit(""))
    upper, digits = "".join(map(chr, range(65, 91))), "0123456789"
    mapped = F.translate(text, upper + digits + SYMBOLS, "A" * 26 + "0" * 10 + "#" * len(SYMBOLS))

    def count(value: Column, char: str) -> Column:
        return F.length(value) - F.length(F.replace(value, F.lit(char), F.lit("")))

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(0.0)

    def figures(words: Column, classes: Column) -> Column:
        chars, n = F.length(classes), F.size(words)
        return F.struct(
            n.cast("double").alias("n_words"), share(chars, n).alias("word_length"), share(F.size(F.array_distinct(words)), n).alias("distinct_share"),
            share(count(classes, "A"), chars).alias("upper_share"), share(count(classes, "0"), chars).alias("digit_share"),
            share(count(classes, "#"), chars).alias("symbol_share"), share(count(classes, "!"), chars).alias("exclaim_share"),
            share(count(classes, "."), n).alias("stop_share"), share(n, count(classes, "\n") + 1).alias("line_words"),
        )

    return bind(words_of(text), lambda w: bind(mapped, lambda m: figures(w, m)))


@dataclass(frozen=True)
class Rules:
    """A fitted ensemble: an intercept and (weight, conditions) pairs; a condition is (statistic, '<=' or '>', threshold)."""

    intercept: float
    rules: tuple[tuple[float, tuple[tuple[str, str, float], ...]], ...]

    def score(self, figures: Column) -> Column:
        """Probability of label 1 from a struct of statistics."""
        total = F.lit(self.intercept)
        for weight, conditions in self.rules:
            holds = F.lit(True)
            for name, sign, threshold in conditions:
                holds &= figures[name] <= threshold if sign == "<=" else figures[name] > threshold
            total += F.when(holds, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _tree(x: np.ndarray, residual: np.ndarray, rows: np.ndarray, depth: int, least: int, path: tuple, out: list) -> None:
    """Grow a regression tree and append the path to each of its nodes below the root."""
    if depth == 0 or len(rows) < 2 * least:
        return
    r, best = residual[rows], (1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        values = x[rows, f]
        for cut in np.unique(np.quantile(values, np.linspace(0.02, 0.98, 33))):
            left = values <= cut
            n = int(left.sum())
            if least <= n <= len(rows) - least:
                a, b = r[left].sum(), r[~left].sum()
                gain = a * a / n + b * b / (len(rows) - n) - (a + b) ** 2 / len(rows)
                if gain > best[0]:
                    best = (gain, f, float(cut))
    if best[1] < 0:
        return
    left = x[rows, best[1]] <= best[2]
    for side, sign in ((left, "<="), (~left, ">")):
        longer = (*path, (best[1], sign, best[2]))
        out.append(longer)
        _tree(x, residual, rows[side], depth - 1, least, longer, out)


def _holds(x: np.ndarray, path: tuple) -> np.ndarray:
    found = np.ones(len(x), bool)
    for f, sign, cut in path:
        found &= x[:, f] <= cut if sign == "<=" else x[:, f] > cut
    return found


def fit(x: np.ndarray, y: np.ndarray, trees: int = 12, depth: int = 3, penalty: float = 1e-3, rounds: int = 400, seed: int = 5) -> Rules:
    """Rules and weights from statistics x and labels y (0 or 1). One class, or none, gives its base rate alone."""
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(rate / (1 - rate)))
    if len(np.unique(y)) < 2:
        return Rules(base, ())
    random, paths, logit = np.random.default_rng(seed), [], np.full(len(y), base)
    for _ in range(trees):
        residual = y - 1 / (1 + np.exp(-logit))
        rows = np.sort(random.choice(len(y), max(1, len(y) * 2 // 3), replace=False))
        grown: list = []
        _tree(x, residual, rows, depth, max(5, len(y) // 500), (), grown)
        for path in (p for p in grown if len(p) == depth):
            own = _holds(x, path)
            p = 1 / (1 + np.exp(-logit[own]))
            logit[own] += 0.5 * residual[own].sum() / max(float((p * (1 - p)).sum()), 1.0)
        paths += grown
    columns, kept = [], []
    for path in dict.fromkeys(paths):
        column = _holds(x, path)
        if 0 < column.sum() < len(column):
            columns.append(column)
            kept.append(path)
    z = np.array(columns, np.float64).T
    mean, spread = z.mean(0), np.maximum(z.std(0), 0.05)
    z = (z - mean) / spread
    step = 4.0 / max(float(np.linalg.norm(z, 2) ** 2) / len(y), 1e-9)
    w, b, w_last, t = np.zeros(z.shape[1]), base, np.zeros(z.shape[1]), 1.0
    for _ in range(rounds):  # accelerated proximal gradient
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = w + (t - 1) / t_next * (w - w_last)
        error = 1 / (1 + np.exp(-(z @ v + b))) - y
        moved = v - step * (z.T @ error) / len(y)
        w_last, w, t = w, np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0), t_next
        b -= 4 * float(error.mean())
    weight = w / spread
    names = [(float(k), tuple((STATISTICS[f], sign, cut) for f, sign, cut in path)) for k, path in zip(weight, kept, strict=True) if abs(k) > 1e-6]
    return Rules(float(b - weight @ mean), tuple(names))


def held_out(id_col: str) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> Rules:
    """Fit on at most fit_rows labelled documents that are not held out; no rows, or labels of one kind, give a base rate.

    Null labels, ids and labels other than 0 and 1 are passed over; an id with both labels counts as 1. Of rows that share an id
    the one with the least statistics stands for all, so that never more than fit_rows rows are collected.
    """
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y"))
    sample = usable.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(fit_rows)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col)).join(F.broadcast(sample), "_id")
    one = rows.select("_id", "_y", statistics(F.col(text_col)).alias("_s")).groupBy("_id").agg(F.max("_y").alias("_y"), F.min("_s").alias("_s"))
    found = one.select("_id", "_y", "_s.*").toPandas().sort_values("_id")
    return fit(found[list(STATISTICS)].to_numpy(np.float64), found["_y"].to_numpy(np.float64))


def predict(docs: DataFrame, rules: Rules, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row, from its whole text alone, however long; null texts are empty ones,
    rows that repeat or have no id are scored each, an empty table gives no rows, other columns are ignored."""
    figures = docs.select(F.col(id_col).alias("doc_id"), statistics(F.col(text_col)).alias("_s"))
    scored = figures.select("doc_id", held_out("doc_id").alias("held_out"), rules.score(F.col("_s")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
