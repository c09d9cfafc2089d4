"""Plain sources and sinks: text in paragraphs, file fingerprints, JSON lines with a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def text_units(df: DataFrame, uri: str, text: str, start: int = 0) -> DataFrame:
    """(uri, ordinal, text) of the blocks between blank lines, from an ordinal on; blank blocks are left out."""
    blocks = df.select(F.col(uri).alias("uri"), F.posexplode(F.split(text, "\n\n")).alias("ordinal", "text"))
    return blocks.where((F.trim("text") != "") & (F.col("ordinal") >= start))


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(uri, size_bytes, content_key): size and time of change; no content is read."""
    f = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    return f.select(F.col("path").alias("uri"), F.col("length").alias("size_bytes"), F.concat_ws(":", "length", F.unix_micros("modificationTime")).alias("content_key"))


def write_sidecar(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_sidecar(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
