"""Start urls: from a table, a text file or a list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.functions.url import hostname, with_scheme
from gossamer.operators.gates import excluded_url


def normal_seeds(seeds: DataFrame, exclude: tuple[str, ...] = (), asn: DataFrame | None = None) -> DataFrame:
    """(url, root_host): trimmed, schemes added, repeats and blanks dropped; hosts under the exclusion rules go."""
    u = seeds.select(with_scheme("url").alias("url"), F.regexp_replace("url", r"[\s\x{a0}]+", "").alias("bare")).filter("bare <> ''").select("url").distinct()
    out = u.withColumn("root_host", F.lower(hostname("url")))
    return out.filter(~excluded_url(F.col("url"), exclude, asn)) if exclude else out


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file as (url)."""
    return spark.read.text(path).withColumnRenamed("value", "url")


def list_seeds(spark: SparkSession, urls: list[str]) -> DataFrame:
    return spark.createDataFrame([(u,) for u in urls], "url string")
