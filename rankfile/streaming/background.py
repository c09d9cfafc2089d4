"""An indexer in the background: a folder is watched, files that are put there are ingested, one batch after another.

It is a streaming query over the folder: its checkpoint is the queue's memory. Cancelling stops it after the running
batch, and what was committed stays; starting again goes on with the files that are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from . import ingest


class Background:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.query: StreamingQuery | None = None

    def enqueue(self, docs: DataFrame) -> int:
        """Put documents (uri, kind, text, indexed_at) in the queue; returns how many."""
        docs.select("uri", "kind", "text", "indexed_at").write.mode("append").json(f"{self.folder}/queue")
        return docs.count()

    def start(self) -> StreamingQuery:
        """Follow the queue until cancelled."""
        self.query = ingest.start_ingest(self.spark, f"{self.folder}/queue", self.folder, f"{self.folder}/checkpoint", drain=False)
        return self.query

    def run_now(self) -> None:
        """Take all that is queued, and return when it is committed."""
        self.query = ingest.start_ingest(self.spark, f"{self.folder}/queue", self.folder, f"{self.folder}/checkpoint", drain=True)
        self.query.awaitTermination()

    def cancel(self) -> None:
        if self.query is not None:
            self.query.stop()

    def progress(self) -> DataFrame:
        """(documents, units, bytes) committed so far, and whether the indexer is active."""
        units = ingest.current_units(self.spark, self.folder)
        per = units.agg(F.countDistinct("uri").alias("documents"), F.count("*").alias("units"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"))
        return per.withColumn("active", F.lit(bool(self.query is not None and self.query.isActive)))
