"""Files and events as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.sources.packages import read_documents

FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark: SparkSession, path: str, per_batch: int = 100) -> DataFrame:
    """New files of a folder, each once."""
    return spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", per_batch).load(path)


def stream_blocks(spark: SparkSession, path: str, per_batch: int = 100) -> DataFrame:
    """Block rows of new files: stateless, in append mode."""
    return read_documents(stream_files(spark, path, per_batch))


def write_once(df: DataFrame, path: str, checkpoint: str):
    """Starts a query that writes each batch to a folder of its own number: a batch that runs again replaces itself."""
    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type; on a stream, windows close when the watermark passes."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str = "1 hour") -> DataFrame:
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", width, step).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """A user's runs of events with at most ``gap`` between."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    return g.select("user_id", F.col("w.start").alias("start"), "last", "n")


def distinct_content(files: DataFrame, late: str = "1 hour") -> DataFrame:
    """Files whose content is new within the watermark."""
    d = files.withColumn("sha256", F.sha2("content", 256))
    return d.withWatermark("modificationTime", late).dropDuplicatesWithinWatermark(["sha256"]) if d.isStreaming else d.dropDuplicates(["sha256"])
