"""Row patterns: streaks by windows, and MATCH_RECOGNIZE by a string of the conditions that hold in each row of a partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Where the characters start that stand for the conditions of a row, one for each combination.
BASE = 0x4E00


def streaks(df: DataFrame, keys: list[str], order: list[str], holds: Column, least: int = 1) -> DataFrame:
    """Maximal runs of rows for which `holds` is true (pattern A+): keys, first and last of the first order column, n."""
    by = Window.partitionBy(*keys).orderBy(*order)
    flagged = df.withColumns({"_h": F.coalesce(holds, F.lit(False)), "_n": F.row_number().over(by)})
    runs = flagged.where("_h").withColumn("_i", F.col("_n") - F.row_number().over(by))
    return runs.groupBy(*keys, "_i").agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("_i")


def rising(df: DataFrame, keys: list[str], order: list[str], value: str, least: int = 1) -> DataFrame:
    """Runs in which value is over that of the previous row: DEFINE up AS up.value > PREV(up.value), PATTERN (up+)."""
    previous = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    return streaks(df.withColumn("_up", F.col(value) > previous), keys, order, F.col("_up"), least)


def _seek(pattern: str, letters: list[str]) -> regex.Pattern:
    """The pattern over rows: each letter is a group of that name that takes every combination with its condition."""
    combinations = range(1 << len(letters))
    texts = {"-": f"(?P<_{len(letters)}>{chr(BASE)})"}
    for i, letter in enumerate(letters):
        texts[letter] = f"(?P<_{i}>[{''.join(chr(BASE + c) for c in combinations if c >> i & 1)}])"
    return regex.compile("".join(texts.get(x, x) for x in pattern))


def match_recognize(
    df: DataFrame, keys: list[str], order: list[str], define: dict[str, Column], pattern: str, measure: str, skip: str = "past last row", all_rows: bool = False
) -> DataFrame:
    """ONE ROW PER MATCH: keys, match_number, first and last of `measure`, n rows and the symbols (CLASSIFIER of each row).
    With all_rows (ALL ROWS PER MATCH): keys, match_number, place (from 1), symbol and `measure` of each row, from which
    aggregates of a match are groups.

    Symbols are single letters. A row may take every symbol whose condition is true; a symbol of the pattern without a
    condition takes any row, '-' one for which no condition is true (null counts as false). Conditions may use lag and
    lead over the partition (PREV and NEXT), not the rows matched so far. The pattern has sequence, groups, | (the first
    that leads to a match) and the greedy or reluctant quantifiers * + ? {n,m}. skip says where the search goes on:
    "past last row", "to next row", "to first X" or "to last X", which raises where X is the first row or not in the match.
    Empty matches are left out. A partition is one row of small numbers, so that many small ones share a batch; the largest
    has to fit into one task.
    """
    if not regex.fullmatch(r"[A-Za-z()|*+?{},\d-]*", pattern):
        raise ValueError("only letters, groups, alternation and quantifiers are supported")
    if not regex.fullmatch(r"past last row|to next row|to (first|last) [A-Za-z]", skip):
        raise ValueError(f"skip must be past last row, to next row, to first X or to last X, not {skip}")
    letters = sorted({x for x in pattern if x.isalpha()} | set(define))
    if len(letters) > 12:
        raise ValueError("a pattern has 12 symbols at most")
    unknown = sum(1 << i for i, x in enumerate(letters) if x not in define)
    holds = F.lit(0)
    for i, letter in enumerate(letters):
        if letter in define:
            holds = holds + F.when(define[letter], 1 << i).otherwise(0)
    rows = df.select(*keys, F.struct(*order).alias("_o"), holds.alias("_s"), F.col(measure).alias("_m"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    seek = _seek(pattern, letters)

    def matches(text: str) -> Iterator[tuple[int, str]]:
        """The start and the symbols of each match in one partition."""
        at = 0
        while found := seek.search(text, at):
            a, b = found.span()
            taken = [""] * (b - a)
            for i, letter in enumerate([*letters, "-"]):
                if f"_{i}" in seek.groupindex:
                    for start, _ in found.spans(f"_{i}"):
                        taken[start - a] = letter
            symbols = "".join(taken)
            if b > a:
                yield a, symbols
            if b == a or skip == "to next row":
                at = a + 1
            elif skip == "past last row":
                at = b
            else:
                to = symbols.find(skip[-1]) if skip.startswith("to first") else symbols.rfind(skip[-1])
                if to <= 0:
                    raise ValueError(f"skip {skip}: the symbol is not behind the first row of the match {symbols}")
                at = a + to

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                key, codes, values = row[:-2], row[-2], row[-1]
                text = "".join(map(chr, (BASE + (np.asarray(codes) | unknown)).tolist()))
                for number, (a, symbols) in enumerate(matches(text), 1):
                    n = len(symbols)
                    if all_rows:
                        out += [(*key, number, i + 1, symbols[i], values[a + i]) for i in range(n)]
                    else:
                        out.append((*key, number, values[a], values[a + n - 1], n, symbols))
            yield pd.DataFrame(out, columns=names)

    last = [f"place long, symbol string, {measure} {kinds['_m']}"] if all_rows else [f"first {kinds['_m']}", f"last {kinds['_m']}", "n long", "symbols string"]
    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + ["match_number long", *last])
    names = [*keys, "match_number", *(("place", "symbol", measure) if all_rows else ("first", "last", "n", "symbols"))]
    sequence = F.array_sort(F.collect_list(F.struct("_o", "_s", "_m"))).alias("_r")
    partitions = rows.groupBy(*keys).agg(sequence).select(*keys, F.transform("_r", lambda x: x["_s"]).alias("_codes"), F.transform("_r", lambda x: x["_m"]).alias("_values"))
    return partitions.mapInPandas(run, schema)
