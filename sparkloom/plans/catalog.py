"""Every query of this package outside the corpus operators, with the SQL that must give the same rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.plans import operator_queries, stream_queries  # noqa: F401  (they register themselves)
from sparkloom.plans.registry import ORACLES, QUERIES, query
from sparkloom.plans.sql_queries import SQL
from sparkloom.sources.tables import TABLES, register, table

@query(
    "tpch_q1",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
    round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_quantity), 4) AS avg_qty, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
)
def tpch_q1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
            F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"),
            F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"),
            F.round(F.avg("l_quantity"), 4).alias("avg_qty"),
            F.count(F.lit(1)).alias("count_order"),
        )
    )


def _from_sql(name: str, text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, *(t for t in TABLES if re.search(rf"\b{t}\b", text)))
        return spark.sql(text)

    run.__name__ = name
    return run


for _name, _text in SQL.items():
    _spark_text, _oracle = (_text, _text.replace("TIMESTAMP_NTZ '", "TIMESTAMP '")) if isinstance(_text, str) else _text
    QUERIES[_name] = _from_sql(_name, _spark_text)
    ORACLES[_name] = _oracle
