"""Streaming forms: new structure files into the coordinate table, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.columns import normal_id
from strandline.operators.relational import parse_structures
from strandline.sources.structures import parse_mmcif


def structure_stream(spark: SparkSession, folder: str, pattern: str = "*.cif", per_trigger: int = 1000) -> DataFrame:
    """New files of a folder as (pid, text)."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).load(folder)
    return files.select(normal_id(F.element_at(F.split("path", "/"), -1)).alias("pid"), F.decode("content", "UTF-8").alias("text"))


def ingest_structures(spark: SparkSession, folder: str, table: str, checkpoint: str, **options):
    """Append the chains of new files to a Parquet table; one folder for each batch, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        atoms, scheme, _ = parse_mmcif(batch.persist())
        parse_structures(atoms, scheme).write.mode("overwrite").parquet(f"{table}/batch={number}")
        batch.unpersist()

    return structure_stream(spark, folder, **options).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Events by type and window; rows later than the watermark are left out. Works on batches as well."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")
