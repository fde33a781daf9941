"""Session factory and the settings every plan in this package assumes."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that hold on a laptop and on a cluster alike; sizes are left to the deployment.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | None = None, app: str = "sparkloom", **more: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the submitter's session is used instead."""
    cores = cores or os.cpu_count() or 4
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in {**SETTINGS, "spark.sql.shuffle.partitions": str(cores), "spark.driver.memory": "12g", **more}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A fresh path in the folder that spark.checkpoint.dir names, which driver and executors share.

    Where it is unset, a local session gets a folder of its own; on a cluster that is an error, as each executor would
    write to its own disk.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        if given.isDefined():
            at = given.get()
        elif spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
            at = f"file://{tempfile.mkdtemp(prefix='sparkloom-')}"
            spark.sparkContext.setCheckpointDir(at)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{at}/sparkloom-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """The rows written to the session's shared checkpoint folder and read again: worked out once, lineage cut."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
