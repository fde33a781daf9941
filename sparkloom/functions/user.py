"""User functions: vectorised scalars and aggregates, table functions, SQL functions, and a registry of named recipes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Recipes:
    """Named column recipes that SQL may call once installed: a grammar extension without a parser change.

    A recipe is a SQL body over its parameters, inlined by the optimiser, so that it costs what the body costs.
    """

    def __init__(self):
        self._known: dict[str, tuple[str, str, str]] = {}

    def add(self, name: str, parameters: str, returns: str, body: str) -> None:
        self._known[name] = (parameters, returns, body)

    def install(self, spark: SparkSession) -> None:
        for name, (parameters, returns, body) in self._known.items():
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")


def vectorised(f: Callable[[np.ndarray], np.ndarray], returns: str = "double", deterministic: bool = True):
    """A scalar function over whole Arrow batches; f maps an array to one of the same length."""

    @F.pandas_udf(returns)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield pd.Series(f(values.to_numpy()))

    return run if deterministic else run.asNondeterministic()


@F.pandas_udf(T.DoubleType())
def geometric_mean(values: pd.Series) -> float:
    """A user aggregate; each group is one batch, so groups should be bounded. geometric_mean_native() has no such bound."""
    return float(np.exp(np.log(values).mean()))


def geometric_mean_native(value: Column) -> Column:
    """The same from built-in aggregates, which Spark combines before the shuffle."""
    return F.exp(F.avg(F.ln(value)))


@F.udtf(returnType=T.StructType([T.StructField("part", T.IntegerType()), T.StructField("piece", T.StringType())]))
class SplitInto:
    """A table function: the pieces of a text with their places."""

    def eval(self, text: str, by: str):
        if text is not None:
            yield from enumerate(text.split(by), 1)


def split_rows(df: DataFrame, text: str, by: str) -> DataFrame:
    """df with a row for each piece, by the table function."""
    spark = df.sparkSession
    spark.udtf.register("sparkloom_split", SplitInto)
    return spark.sql("SELECT d.*, s.part, s.piece FROM {df} d, LATERAL sparkloom_split(d." + text + ", '" + by.replace("'", "\\'") + "') s", df=df)
