"""The crawl tables of a scale folder, read as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of the folder; a Parquet file or a folder of files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def has_table(spark: SparkSession, folder: str, name: str) -> bool:
    """Whether the folder has that table at all."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
