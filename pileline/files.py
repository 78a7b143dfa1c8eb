"""Folders in the place that the driver and all executors share, and tables that are staged there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """The path of a folder that is not there yet; what is written to it goes when the application ends."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not told and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{(told or 'file:///tmp/checkpoints/pileline').rstrip('/')}/{name}-{uuid.uuid4().hex}")
    system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    system.mkdirs(path)
    system.deleteOnExit(path)  # only what is there can be marked
    return f"{path.toString()}/rows"


def staged(df: DataFrame) -> DataFrame:
    """The same rows from a Parquet table: what depends on a sample or on a row's place is then the same for all that read them."""
    path = folder(df.sparkSession, "staged")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
