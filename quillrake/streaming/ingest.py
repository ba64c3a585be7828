"""Files as they arrive: an extension for folders that grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arriving(spark: SparkSession, path: str, files_per_batch: int = 1_000, late: str = "1 hour") -> DataFrame:
    """The files of a folder as a stream, each content once within the watermark."""
    read = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_batch)
    told = read.load(path).select(F.col("path").alias("file_path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), "content", F.sha2("content", 256).alias("file_hash"))
    return told.withWatermark("modified", late).dropDuplicatesWithinWatermark(["file_hash"]).drop("file_hash")


def ingest_stream(engine, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Ingests arriving files batch by batch. Ids depend on path and content, so a batch that runs again changes nothing."""
    write = arriving(engine.spark, path).writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: engine.ingest_files(df))
    return (write.trigger(availableNow=True) if available_now else write.trigger(processingTime="30 seconds")).start()
