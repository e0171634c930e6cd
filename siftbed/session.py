"""Spark session, shared folder and the few settings that operators rely on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(app: str = "siftbed", master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings the operators are planned for; on a cluster spark-submit provides master and memory."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.variant.allowDuplicateKeys": "true",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.appName(app).master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset a local one, on one machine only."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.gettempdir()}/siftbed-{os.getuid()}"
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet into the shared folder and read back: lineage is cut, and lost executors cost nothing.

    The files are deleted when the application ends.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    context = df.sparkSession.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(place)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most_rows: int) -> DataFrame:
    """`df` hinted for broadcast if it has at most `most_rows` rows, else as it is (the join then shuffles).

    Costs one bounded count; use it for dimension tables only.
    """
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer partitions than there are cores, as of a file of few row groups, over all cores; else `df` as it is.

    For what is costly per row. Only the file listing is looked at: a plan with a shuffle is left alone.
    """
    plan = df._jdf.queryExecution()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "AdaptiveSparkPlan" in plan.executedPlan().toString() or plan.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)
