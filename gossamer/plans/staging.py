"""Shared-folder tables that cut lineage, and joins that hold up under skew.

Everything written here goes to the folder the cluster names in
``spark.checkpoint.dir``; executors may be lost at any time and the tables are
still there.  Only a local session that names no folder gets one of its own.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its counted rows stay below this.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; in local mode, when unset, a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="gossamer-")
        spark.conf.set("spark.checkpoint.dir", named)
        _forget_at_exit(spark, named)
    return named.rstrip("/")


def _forget_at_exit(spark: SparkSession, path: str) -> None:
    def drop() -> None:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone; nothing to clean with
            pass

    atexit.register(drop)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back with the same schema."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gossamer-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    _forget_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete staged tables whose last reader is staged itself."""
    for t in tables:
        path = getattr(t, "_staged", None)
        if path:
            jvm = t.sparkSession.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def maybe_broadcast(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when the counted size is under the bound, else leave the shuffle join to AQE."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df


def salted_join(rows: DataFrame, side: DataFrame, key: str, weight: str, heavy: int = 1_000_000, how: str = "inner") -> DataFrame:
    """Join rows with one ``side`` row per key where single keys may hold a third of all rows.

    ``weight`` is the number of rows of a key.  Keys above ``heavy`` are at most
    rows/heavy many: while their counted number is below the bound of a broadcast, they are broadcast, so their rows stay where
    they are.  All other keys, and all keys beyond that bound, go through an ordinary shuffle join.
    """
    big = side.filter(F.col(weight) > heavy)
    if not 0 < big.count() <= BROADCAST_ROWS:
        return rows.join(side, key, how)
    hot = big.select(F.col(key).alias("__hot"))
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    light = marked.filter(F.col("__hot").isNull()).drop("__hot").join(side.filter(F.col(weight) <= heavy), key, how)
    dense = marked.filter(F.col("__hot").isNotNull()).drop("__hot").join(F.broadcast(big), key, how)
    return light.unionByName(dense)
