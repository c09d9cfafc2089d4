"""Incremental ingest as Structured Streaming: new files become units, a catalogue keeps each document's state.

Each micro-batch is one commit: units are appended under their batch number, and a batch that is run again after a
failure replaces its own output, so every unit stands once. Stopping keeps what was committed; starting again goes
on from the checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

UNITS = "uri string, kind string, text string, indexed_at timestamp"


def start_ingest(spark: SparkSession, source: str, target: str, checkpoint: str, drain: bool = True) -> StreamingQuery:
    """Follow a folder of JSON-lines documents (UNITS); write units and catalogue rows under `target`."""
    docs = spark.readStream.schema(UNITS).json(source)

    def commit(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        units = batch.select("uri", "kind", F.posexplode(F.split("text", "\n\n")).alias("ordinal", "text")).where(F.trim("text") != "")
        units.write.mode("overwrite").parquet(f"{target}/units/batch={number}")
        last = batch.groupBy("uri").agg(F.max("indexed_at").alias("indexed_at"), F.max_by("text", "indexed_at").alias("text"))
        last.select("uri", F.lit("complete").alias("state"), F.sha2("text", 256).alias("content_key"), "indexed_at").write.mode("overwrite").parquet(f"{target}/catalogue/batch={number}")
        batch.unpersist()

    w = docs.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if drain else w.trigger(processingTime="10 seconds")).start()


def catalogue(spark: SparkSession, target: str) -> DataFrame:
    """The latest state of every document."""
    rows = spark.read.parquet(f"{target}/catalogue")
    return rows.groupBy("uri").agg(F.max_by("state", F.struct("indexed_at", "batch")).alias("state"), F.max_by("content_key", F.struct("indexed_at", "batch")).alias("content_key"), F.max_by("batch", F.struct("indexed_at", "batch")).alias("batch"))


def current_units(spark: SparkSession, target: str) -> DataFrame:
    """The units of the latest batch of every document; older ones are superseded."""
    return spark.read.parquet(f"{target}/units").join(catalogue(spark, target).select("uri", "batch"), ["uri", "batch"], "left_semi")


def needs_reindex(found: DataFrame, known: DataFrame) -> DataFrame:
    """Of (uri, content_key) found, those that are new, not complete or changed."""
    k = known.select(F.col("uri").alias("u"), F.col("state"), F.col("content_key").alias("old"))
    return found.join(k, F.col("uri") == F.col("u"), "left").where("u is null or state <> 'complete' or not (old <=> content_key)").select("uri", "content_key")


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events per type and window of event time, rows later than the watermark left out; for streams and tables."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet")).select(F.col("window.start").alias("start_at"), "event_type", "n")


QUERIES = {"s2_17_event_windows": (event_windows, "select date_trunc('hour', ts) as start_at, event_type, count(*) as n from @events group by 1, 2")}
