"""Corpus substitution: find every match, preview it, apply the accepted ones with a journal, undo a batch.

A plan writes nothing. Applying gives the new nodes, the journal rows of the batch, and the nodes that were skipped as
their text is still in the source; undoing restores the text the journal holds, not an inverse substitution. Null and
empty texts have no match. If a node was edited several times in a batch, its earliest text is restored. Batches are
undone newest first: one that later batches built on has to wait for them. Offsets are characters from 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .predicates import compiled


def matches(nodes: DataFrame, pattern: str, replacement: str | None = None, limit: int | None = None) -> DataFrame:
    """(node_id, doc_id, i, start, end, match, becomes) of every match of a pattern that matches no empty text, in the order of
    nodes and offsets; `limit` is of matches."""
    n = nodes.where(F.col("text").rlike(compiled(pattern))).select("node_id", "doc_id", "text").dropDuplicates(["node_id"])
    n = n.withColumn("found", F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).withColumn("between", F.split("text", pattern, -1))
    sizes = F.zip_with("found", F.slice("between", 1, F.size("found")), lambda m, gap: F.struct(F.length(gap).alias("gap"), F.length(m).alias("n"), m.alias("m")))
    step = lambda acc, x: F.struct((acc["at"] + x["gap"] + x["n"]).alias("at"), F.concat(acc["rows"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["n"]).alias("end"), x["m"].alias("match")))).alias("rows"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,match:string>>").alias("rows"))
    rows = n.select("node_id", "doc_id", F.posexplode(F.aggregate(sizes, start, step)["rows"]).alias("i", "x"))
    becomes = F.regexp_replace("x.match", pattern, replacement) if replacement is not None else F.lit(None).cast("string")
    out = rows.select("node_id", "doc_id", "i", "x.start", "x.end", "x.match", becomes.alias("becomes"))
    return out if limit is None else out.orderBy("node_id", "start").limit(limit)


def plan(nodes: DataFrame, pattern: str, replacement: str, scope: str | None = None) -> DataFrame:
    """(node_id, doc_id, i, start, end, match, becomes, accepted): every match that would change, all accepted."""
    n = nodes.where(F.col("scope") == scope) if scope else nodes
    return matches(n, pattern, replacement).where("match <> becomes").withColumn("accepted", F.lit(True))


def preview(nodes: DataFrame, edits: DataFrame) -> DataFrame:
    """(node_id, doc_id, edits, text_before, text_after): the texts with the accepted edits put in, from the last to the first."""
    e = edits.where("accepted").groupBy("node_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "becomes")), False).alias("e"))  # the matches of one text
    d = nodes.select("node_id", "doc_id", "text").dropDuplicates(["node_id"]).join(e, "node_id")
    put = lambda t, x: F.concat(F.substr(t, F.lit(1), x["start"]), x["becomes"], F.substr(t, x["end"] + 1))
    return d.select("node_id", "doc_id", F.size("e").alias("edits"), F.col("text").alias("text_before"), F.aggregate("e", F.col("text"), put).alias("text_after"))


def apply(nodes: DataFrame, edits: DataFrame, batch: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes with the accepted texts, journal rows of the batch, (node_id) skipped). A node is skipped if its text is still in
    the source or has changed since the plan, so that an edit's match no longer stands where it stood."""
    p = preview(nodes, edits)
    stale = edits.where("accepted").join(nodes.select("node_id", "text").dropDuplicates(["node_id"]), "node_id", "left").where("text is null or text = '' or substring(text, start + 1, end - start) <> match").select("node_id").distinct()
    p = p.join(stale, "node_id", "left_anti")
    e = p.select("node_id", "text_after")
    new = nodes.join(e, "node_id", "left").withColumn("text", F.coalesce("text_after", "text")).drop("text_after")
    journal = p.select(F.xxhash64(F.lit(batch), "node_id").alias("edit_id"), F.lit(batch).alias("batch"), "doc_id", "node_id", "text_before", "text_after", F.lit(False).alias("undone"))
    return new, journal, stale


def undoable(journal: DataFrame, order: str = "batch") -> DataFrame:
    """(batch) that no later batch, by `order`, has built on: none of its nodes stands in a later batch that isn't undone."""
    live = journal.where("not undone").select("batch", "node_id", F.col(order).alias("o")).distinct()
    last = live.withColumn("top", F.max("o").over(Window.partitionBy("node_id")))
    return last.groupBy("batch").agg(F.min((F.col("o") == F.col("top")).cast("int")).alias("ok")).where("ok = 1").select("batch")


def undo(nodes: DataFrame, journal: DataFrame, batch: str) -> tuple[DataFrame, DataFrame]:
    """(nodes with the batch's earliest texts back, journal with the batch marked undone)."""
    mine = journal.where((F.col("batch") == batch) & ~F.col("undone")).groupBy("node_id").agg(F.min_by("text_before", "edit_id").alias("back"))
    old = nodes.join(mine, "node_id", "left").withColumn("text", F.coalesce("back", "text")).drop("back")
    return old, journal.withColumn("undone", F.col("undone") | (F.col("batch") == batch))
