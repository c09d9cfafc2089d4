"""Queries of incremental ingest: documents in paragraphs, in rounds with and without a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalogue as c
from ..operators.ordered import ranked
from ..session import fresh, written
from ..streaming.background import Background
from .registry import Registry

R = Registry()
BUDGET = 100_000  # bytes of a round


def _docs(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/documents.parquet").where("text is not null").select(F.concat(F.lit("doc/"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("uri"), "doc_id", "text", "source", "lang", F.md5("text").alias("content_key")).dropDuplicates(["uri"])


def _units(docs: DataFrame) -> DataFrame:
    return docs.select("uri", F.posexplode(F.split("text", "\n\n")).alias("ordinal", "text")).where(F.trim("text") != "")


def _round(s: SparkSession, d: str, budget: int | None) -> tuple[DataFrame, DataFrame]:
    docs = _docs(s, d)
    return c.ingest(c.empty(s), s.createDataFrame([], "uri string, ordinal int, text string"), docs, _units(docs), budget)


_D = "(select distinct 'doc/' || lpad(doc_id::varchar, 12, '0') as uri, doc_id, text, source, lang, md5(text) as content_key from @documents where text is not null)"
_U = f"(select uri, o as ordinal, b as text from (select uri, unnest(range(len(l)))::int as o, unnest(l) as b from (select uri, string_split(text, chr(10) || chr(10)) as l from {_D} d) x) y where trim(b, ' ') <> '')"
_RUN = f"(select uri, ordinal, sum(strlen(text)) over (order by uri, ordinal rows unbounded preceding) - strlen(text) < {BUDGET} as got from {_U} u)"
_CAT = f"(select uri, case when c >= e then 'complete' when c > 0 then 'partial' else 'pending' end as state, c as cursor, n as nodes from (select uri, max(ordinal) + 1 as e, coalesce(max(ordinal) filter (got) + 1, 0)::bigint as c, count(*) filter (got) as n from {_RUN} r group by uri) q)"
_EMPTY = f"select uri, 'complete' as state, 0::bigint as cursor, 0::bigint as nodes from {_D} d where uri not in (select uri from {_U} u)"
R.plan("o13_1_add", lambda s, d: _round(s, d, BUDGET)[0].select("uri", "state", "cursor", "nodes"), f"select * from {_CAT} c union all {_EMPTY}")


def _twice(s: SparkSession, d: str) -> DataFrame:
    """A round with a budget, then one without: what was partial goes on at its cursor."""
    docs = _docs(s, d)
    known, stored = _round(s, d, BUDGET)
    known, stored = written(known, "catalogue"), written(stored, "units")
    return c.ingest(known, stored, docs, _units(docs))[0].select("uri", "state", "cursor", "nodes")


R.plan("o13_10_index_all", _twice, f"select uri, 'complete' as state, (max(ordinal) + 1)::bigint as cursor, count(*) as nodes from {_U} u group by uri union all {_EMPTY}")
R.plan("o13_2_needs_reindex", lambda s, d: c.needs_reindex(_round(s, d, BUDGET)[0], _docs(s, d).withColumn("content_key", F.when(F.col("lang").isNull(), "changed").otherwise(F.col("content_key")))), f"select uri from {_D} d left join (select * from {_CAT} c union all {_EMPTY}) k using (uri) where state <> 'complete' or lang is null")
R.plan("o13_3_remove", lambda s, d: c.remove(*_round(s, d, None), _docs(s, d).where("source is null"))[1].groupBy("uri").agg(F.count("*").alias("nodes")), f"select uri, count(*) as nodes from {_U} u where uri not in (select uri from {_D} d where source is null) group by uri")
R.plan("o13_4_mark_failed", lambda s, d: c.mark_failed(_round(s, d, BUDGET)[0], _docs(s, d).where("lang is null").select("uri", F.lit("no label").alias("error"))).select("uri", "state", "cursor", "error"), f"select uri, case when lang is null then 'failed' else state end as state, cursor, case when lang is null then 'no label' end as error from {_D} d join (select * from {_CAT} c union all {_EMPTY}) k using (uri)")


def _restart(s: SparkSession, d: str) -> DataFrame:
    """Units that stay when the documents without a label come with another key: theirs are purged before the new round."""
    docs = _docs(s, d)
    known, stored = _round(s, d, None)
    todo = c.actions(known, docs.withColumn("content_key", F.when(F.col("lang").isNull(), "changed").otherwise(F.col("content_key"))))
    return c.purged(stored, todo).groupBy("uri").agg(F.count("*").alias("nodes"))


R.plan("o13_9_purge", _restart, f"select uri, count(*) as nodes from {_U} u where uri not in (select uri from {_D} d where lang is null) group by uri")
R.plan("o13_7_flush", lambda s, d: _round(s, d, BUDGET)[1].groupBy("uri").agg(F.max("ordinal").alias("last"), F.count("*").alias("nodes")), f"select uri, max(ordinal) as last, count(*) as nodes from {_RUN} r where got group by uri")
R.plan("o13_8_upsert_document", lambda s, d: c.upsert(_round(s, d, BUDGET)[0], _docs(s, d).where("source is null").select("uri", F.lit("pending").alias("state"), "content_key", F.lit(0).cast("long").alias("cursor"), F.lit(0).cast("long").alias("nodes"), F.lit(None).cast("string").alias("error"))).select("uri", "state", "nodes"), f"select uri, case when source is null then 'pending' else state end as state, case when source is null then 0 else nodes end as nodes from {_D} d join (select * from {_CAT} c union all {_EMPTY}) k using (uri)")
R.plan("o13_5_documents", lambda s, d: ranked(_round(s, d, BUDGET)[0], ["uri"], "rn").select("uri", "state", F.col("rn").cast("long").alias("rn")), f"select uri, state, row_number() over (order by uri) as rn from (select * from {_CAT} c union all {_EMPTY}) k")
R.plan("o13_6_document", lambda s, d: _round(s, d, BUDGET)[0].where("uri = 'doc/000000000007'").select("uri", "state", "cursor"), f"select uri, state, cursor from (select * from {_CAT} c union all {_EMPTY}) k where uri = 'doc/000000000007'")
R.plan("o13_13_progress", lambda s, d: c.progress(_round(s, d, BUDGET)[0], _docs(s, d).select("uri", F.octet_length("text").cast("long").alias("bytes"))), f"select state, count(*) as documents, sum(strlen(text))::bigint as bytes, floor(sum(strlen(text)) / (select sum(strlen(text)) from {_D} e) * 1e6 + 5e-1) / 1e6 as fraction from {_D} d join (select * from {_CAT} c union all {_EMPTY}) k using (uri) group by state")


def _background(s: SparkSession, d: str, what: str) -> DataFrame:
    """Documents put in a watched folder in two portions, drained after each."""
    b = Background(s, fresh(s, "background"))
    docs = _docs(s, d).withColumn("kind", F.lit("text")).withColumn("indexed_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    queued = b.enqueue(docs.where("lang is not null"))
    if what == "enqueue":
        return s.createDataFrame([(queued + b.enqueue(docs.where("lang is null")),)], "queued long")
    b.run_now()
    if what == "cancel":
        b.start()
        b.cancel()
        return b.progress()
    b.enqueue(docs.where("lang is null"))
    b.run_now()
    return b.progress()


R.plan("o13_12_enqueue", lambda s, d: _background(s, d, "enqueue"), f"select count(*) as queued from {_D} d")
_DONE = "select count(distinct uri) as documents, count(*) as units, coalesce(sum(strlen(text)), 0)::bigint as bytes, false as active from "
R.plan("o13_15_run_now", lambda s, d: _background(s, d, "drain"), _DONE + f"{_U} u")
R.plan("o13_14_cancel", lambda s, d: _background(s, d, "cancel"), _DONE + f"{_U} u where uri in (select uri from {_D} d where lang is not null)")
