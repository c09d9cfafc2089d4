"""Incremental ingest of documents: what to skip, start, resume or start again, up to a budget, as plans over tables.

A catalogue row is (uri, state, content_key, cursor, nodes, error); states go from pending over partial to complete, or
to failed. A source row is (uri, content_key); a unit is (uri, ordinal, text). Units are taken in the order of uri and
ordinal while the budget of bytes lasts, so a document is left partial at a cursor and goes on there. A unit's order is
cut into ranges for the running sum; no task sees all units. Repeated sources and units count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from .ordered import ranked

CATALOGUE = "uri string, state string, content_key string, cursor long, nodes long, error string"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CATALOGUE)


def actions(known: DataFrame, sources: DataFrame, force: bool = False) -> DataFrame:
    """(uri, content_key, action, cursor): start what is new, skip what is complete and unchanged, resume what is partial and
    unchanged at its cursor, restart what has changed, failed, or is forced."""
    k = known.select("uri", "state", F.col("content_key").alias("old"), F.col("cursor").alias("at"))
    s = sources.select("uri", "content_key").dropDuplicates(["uri"]).join(k, "uri", "left")
    same = F.col("old").eqNullSafe(F.col("content_key")) & (F.col("content_key") != "") & F.lit(not force)
    action = F.when(F.col("state").isNull(), "start").when(same & (F.col("state") == "complete"), "skip").when(same & (F.col("state") == "partial"), "resume").otherwise("restart")
    return s.select("uri", "content_key", action.alias("action"), F.when(action == "resume", F.col("at")).otherwise(0).cast("long").alias("cursor"))


def needs_reindex(known: DataFrame, sources: DataFrame) -> DataFrame:
    """(uri) of the sources that are absent, not complete, or changed."""
    return actions(known, sources).where("action <> 'skip'").select("uri")


def taken(units: DataFrame, todo: DataFrame, budget: int | None) -> DataFrame:
    """(uri, ordinal, text) of the units from each cursor on, while the running sum of bytes before them is under budget."""
    u = units.join(todo.where("action <> 'skip'").select("uri", "cursor"), "uri").where("ordinal >= cursor").dropDuplicates(["uri", "ordinal"])
    if budget is None:
        return u.select("uri", "ordinal", "text")
    u = ranked(u.withColumn("bytes", F.octet_length("text")), ["uri", "ordinal"], "upto", "bytes")
    return u.where(F.col("upto") - F.col("bytes") < budget).select("uri", "ordinal", "text")


def purged(units: DataFrame, todo: DataFrame) -> DataFrame:
    """Stored units without those of documents that start again."""
    return units.join(todo.where("action = 'restart'").select("uri"), "uri", "left_anti")


def ingest(known: DataFrame, stored: DataFrame, sources: DataFrame, units: DataFrame, budget: int | None = None, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(catalogue, stored units) after one round."""
    todo = written(actions(known, sources, force), "actions")
    new = written(taken(units, todo, budget), "taken")
    kept = purged(stored, todo)
    every = kept.unionByName(new).dropDuplicates(["uri", "ordinal"])
    own = units.join(todo.select("uri"), "uri", "left_semi").groupBy("uri").agg((F.max("ordinal") + 1).alias("end"))
    got = every.groupBy("uri").agg(F.count("*").alias("nodes"), (F.max("ordinal") + 1).alias("cursor"))
    done = todo.select("uri", "content_key", "action").join(own, "uri", "left").join(got, "uri", "left").fillna(0, ["nodes", "cursor", "end"])
    state = F.when(F.col("cursor") >= F.col("end"), "complete").when(F.col("cursor") > 0, "partial").otherwise("pending")
    fresh = done.where("action <> 'skip'").select("uri", state.alias("state"), "content_key", "cursor", "nodes", F.lit(None).cast("string").alias("error"))
    return upsert(known, fresh), every


def upsert(known: DataFrame, rows: DataFrame) -> DataFrame:
    """The catalogue with the rows in the place of those of the same uri."""
    new = rows.select(*(c.split()[0] for c in CATALOGUE.split(", "))).dropDuplicates(["uri"])
    return known.join(new.select("uri"), "uri", "left_anti").unionByName(new)


def mark_failed(known: DataFrame, failures: DataFrame) -> DataFrame:
    """The catalogue with the uris of failures (uri, error) failed; their other columns stay, new ones are added."""
    f = failures.select("uri", F.col("error").alias("why")).dropDuplicates(["uri"])
    hit = known.join(f, "uri").select("uri", F.lit("failed").alias("state"), "content_key", "cursor", "nodes", F.col("why").alias("error"))
    new = f.join(known.select("uri"), "uri", "left_anti").select("uri", F.lit("failed").alias("state"), F.lit(None).cast("string").alias("content_key"), F.lit(0).cast("long").alias("cursor"), F.lit(0).cast("long").alias("nodes"), F.col("why").alias("error"))
    return upsert(known, hit.unionByName(new))


def remove(known: DataFrame, stored: DataFrame, uris: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(catalogue, units) without the documents of uris (uri)."""
    gone = uris.select("uri").distinct()
    return known.join(gone, "uri", "left_anti"), stored.join(gone, "uri", "left_anti")


def progress(known: DataFrame, sizes: DataFrame) -> DataFrame:
    """(state, documents, bytes, fraction) of sizes (uri, bytes): what is not in the catalogue is absent."""
    s = sizes.dropDuplicates(["uri"]).join(known.select("uri", "state"), "uri", "left").withColumn("state", F.coalesce("state", F.lit("absent")))
    total = s.agg(F.sum("bytes").alias("total"))  # one row
    per = s.groupBy("state").agg(F.count("*").alias("documents"), F.sum("bytes").alias("bytes"))
    return per.crossJoin(F.broadcast(total)).select("state", "documents", "bytes", F.round(F.coalesce(F.try_divide("bytes", "total"), F.lit(0.0)), 6).alias("fraction"))
