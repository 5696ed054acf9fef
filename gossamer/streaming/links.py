"""Links and requests as streams: file sources, stateful uniqueness, watermarked counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gossamer.functions import url as ur
from gossamer.plans.staging import shared_dir


def read(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def unique_requests(stream: DataFrame) -> DataFrame:
    """First sighting of each request; the state is one key each, kept in the state store."""
    keyed = stream.filter(ur.is_url("url")).withColumn("key", ur.request_key("method", "url", "body"))
    return keyed.dropDuplicates(["key"])


def unique_within(stream: DataFrame, at: str, late: str = "3 days") -> DataFrame:
    """First sighting of each request within the watermark; state older than that is dropped."""
    keyed = stream.filter(ur.is_url("url")).withColumn("key", ur.request_key("method", "url", "body"))
    return keyed.withWatermark(at, late).dropDuplicatesWithinWatermark(["key"])


def pages_per_window(stream: DataFrame, at: str = "timestamp", width: str = "1 hour", late: str = "7 days") -> DataFrame:
    """(window_start, host, pages): fetched pages per host and event-time window."""
    host = F.lower(ur.hostname(F.col("request.endpoint")))
    g = stream.filter(F.col(at).isNotNull()).withWatermark(at, late).groupBy(F.window(at, width).alias("w"), host.alias("host"))
    return g.agg(F.count(F.lit(1)).alias("pages")).select(F.col("w.start").alias("window_start"), "host", "pages")


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All there is now, through the stream, into a table of the shared folder; returns that table."""
    import uuid

    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", base + "/data").option("checkpointLocation", base + "/checkpoint").trigger(availableNow=True).start()
    else:  # complete results replace the table batch by batch
        def put(df: DataFrame, _: int) -> None:
            df.write.mode("overwrite").parquet(base + "/data")

        q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", base + "/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(base + "/data")
