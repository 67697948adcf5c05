"""Tables written in passing: a plan that is used many times, or is too deep to plan again, starts anew from its rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which all machines see; a temporary one where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = getattr(spark, "_riskloom_staging", None)
        if not folder:
            folder = spark._riskloom_staging = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return folder


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again, so that lost executors cost a read, not the plan."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
