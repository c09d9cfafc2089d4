"""Queries of document trees, exports, payloads, page ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extensions import ENGINES, EXPORTERS
from ..operators import trees as t
from ..session import fresh
from .registry import Registry

R = Registry()


def _nodes(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/nodes.parquet")


def _tree(s: SparkSession, d: str) -> DataFrame:
    return t.tree(_nodes(s, d))


def _path() -> Column:
    return F.array_join(F.transform("path", lambda x: x.cast("string")), "/")


_OWN = "(select distinct node_id, doc_id, scope, ordinal, text from @nodes)"
_GAME = f"(select *, case when scope in ('mainline', 'variations', 'comments') or (scope = 'headers' and text like '[%') then coalesce(last_value(mark ignore nulls) over (partition by doc_id order by ordinal, node_id rows unbounded preceding), -1) else -1 end as game from (select *, case when scope = 'headers' and text like '[%' then ordinal when not (scope in ('mainline', 'variations', 'comments')) then -1 end as mark from {_OWN} n) m)"
R.plan("o1_7_ir_units", lambda s, d: t.units(_tree(s, d)).select("node_id", "scope", _path().alias("path")), f"select node_id, scope, case when game >= 0 then game::varchar || '/' || (ordinal + 1)::varchar else ordinal::varchar end as path from {_GAME} g")
R.plan("o1_8_units_for_node", lambda s, d: _tree(s, d).groupBy("tag").agg(F.count("*").alias("nodes"), F.count("node_id").alias("indexed")), f"select case when game >= 0 then case scope when 'headers' then 'header' when 'variations' then 'variation' when 'comments' then 'comment' else scope end else case scope when 'headers' then 'heading' when 'all' then 'paragraph' when 'captions' then 'figure' when 'variations' then 'variation' when 'comments' then 'comment' else scope end end as tag, count(*) as nodes, count(*) as indexed from {_GAME} g group by 1 union all select 'game', count(*), 0 from {_GAME} g where game >= 0 and game = ordinal union all select 'document', count(distinct doc_id), 0 from @nodes")
R.plan("o15_1_walk", lambda s, d: _tree(s, d).select("doc_id", _path().alias("path"), "depth", "tag"), f"select doc_id, case when game >= 0 then game::varchar || '/' || (ordinal + 1)::varchar else ordinal::varchar end as path, case when game >= 0 then 2 else 1 end as depth, case when game >= 0 then case scope when 'headers' then 'header' when 'variations' then 'variation' when 'comments' then 'comment' else scope end else case scope when 'headers' then 'heading' when 'all' then 'paragraph' when 'captions' then 'figure' when 'variations' then 'variation' when 'comments' then 'comment' else scope end end as tag from {_GAME} g union all select doc_id, game::varchar, 1, 'game' from {_GAME} g where game >= 0 and game = ordinal union all select distinct doc_id, '', 0, 'document' from @nodes")
R.plan("o15_2_find", lambda s, d: _tree(s, d).where("tag = 'figure'").select("doc_id", _path().alias("path")), f"select doc_id, ordinal::varchar as path from {_OWN} n where scope = 'captions'")
R.plan("o15_3_transform", lambda s, d: t.transformed(_tree(s, d), ["variation"], ["game"], {"comment": "note"}).groupBy("tag").agg(F.count("*").alias("nodes")), f"select case when game >= 0 then case scope when 'headers' then 'header' when 'comments' then 'note' else scope end else case scope when 'headers' then 'heading' when 'all' then 'paragraph' when 'captions' then 'figure' when 'comments' then 'note' else scope end end as tag, count(*) as nodes from {_GAME} g where scope <> 'variations' group by 1 union all select 'document', count(distinct doc_id) from @nodes")
R.plan("o15_5_block_children", lambda s, d: t.children(_tree(s, d)).where(F.size("parent") == 0).select("doc_id", "place", "tag"), f"select doc_id, row_number() over (partition by doc_id order by p) as place, tag from (select doc_id, ordinal as p, case scope when 'headers' then 'heading' when 'all' then 'paragraph' when 'captions' then 'figure' when 'variations' then 'variation' when 'comments' then 'comment' else scope end as tag from {_GAME} g where game < 0 union all select doc_id, game, 'game' from {_GAME} g where game >= 0 and game = ordinal) x")
R.plan("o15_6_child_nodes", lambda s, d: t.children(_tree(s, d)).where(F.size("parent") == 1).select("doc_id", F.col("parent")[0].alias("game"), "place", "tag", "node_id"), f"select doc_id, game, row_number() over (partition by doc_id, game order by ordinal) as place, case scope when 'headers' then 'header' when 'variations' then 'variation' when 'comments' then 'comment' else scope end as tag, node_id from {_GAME} g where game >= 0")


# payloads
def _loaded(s: SparkSession, d: str) -> DataFrame:
    """Nodes written as lines of JSON in the shared folder, and read again."""
    path = fresh(s, "dump")
    _tree(s, d).select(t.dumped(F.lit(None)).alias("value")).write.text(path)
    return t.loaded(s.read.text(path))


R.plan("o1_52_dumps", lambda s, d: _tree(s, d).where("tag = 'figure'").select("node_id", F.get_json_object(t.dumped(F.lit(None)), "$.text").alias("text"), F.get_json_object(t.dumped(F.lit(None)), "$.tag").alias("tag"), F.get_json_object(t.dumped(F.lit(None)), "$.kind").isNull().alias("omitted")), f"select node_id, text, 'figure' as tag, true as omitted from {_OWN} n where scope = 'captions'")
R.plan("o1_53_loads", lambda s, d: _loaded(s, d).where("id is not null").select(F.col("id").alias("node_id"), "text", F.size("path").alias("depth")), f"select node_id, text, case when game >= 0 then 2 else 1 end as depth from {_GAME} g")


def _old(s: SparkSession, d: str) -> DataFrame:
    """Captions as payloads of the first version, comments as the second, headers as the present one."""
    n = _nodes(s, d).select("node_id", "scope", "text").distinct()
    one = n.where("scope = 'captions'").select(F.to_json(F.struct(F.lit(1).alias("version"), F.lit("figure").alias("kind"), F.col("node_id").alias("id"), F.col("text").alias("body"))).alias("value"))
    two = n.where("scope = 'comments'").select(F.to_json(F.struct(F.lit(2).alias("version"), F.lit("comment").alias("tag"), F.col("node_id").alias("id"), F.col("text").alias("body"))).alias("value"))
    now = n.where("scope = 'headers'").select(F.to_json(F.struct(F.lit(3).alias("version"), F.lit("heading").alias("tag"), F.col("node_id").alias("id"), "text")).alias("value"))
    return one.unionByName(two).unionByName(now)


R.plan("o15_7_migrate", lambda s, d: t.loaded(_old(s, d)).select(F.col("id").alias("node_id"), "tag", "text"), "select distinct node_id, case scope when 'captions' then 'figure' when 'comments' then 'comment' else 'heading' end as tag, text from @nodes where scope in ('captions', 'comments', 'headers')")
R.plan("o15_8_migration_plan", lambda s, d: s.createDataFrame([(v, i, x, t.MIGRATIONS.steps[x].note) for v in (1, 2, 3) for i, x in enumerate(t.MIGRATIONS.plan(v))], "from_version int, i int, step int, note string"), "select * from (values (1, 0, 1, 'kind became tag'), (1, 1, 2, 'body became text'), (2, 0, 2, 'body became text')) v(from_version, i, step, note)")
R.plan("o16_11_migrations", lambda s, d: t.loaded(_old(s, d)).groupBy("tag").agg(F.count("text").alias("texts")), "select case scope when 'captions' then 'figure' when 'comments' then 'comment' else 'heading' end as tag, count(text) as texts from (select distinct node_id, scope, text from @nodes where scope in ('captions', 'comments', 'headers')) n group by 1")


# exports
def _rows(s: SparkSession, d: str) -> DataFrame:
    n = _nodes(s, d).select("doc_id", "ordinal", "node_id", F.col("scope").alias("scope"), "text").distinct()
    return n.select("doc_id", "ordinal", "node_id", F.create_map(*[F.lit(x) for kv in {**t.PARTS, **t.TAGS}.items() for x in kv])[F.col("scope")].alias("tag"), "text")


def _again(s: SparkSession, d: str, form: str) -> DataFrame:
    path = fresh(s, f"export-{form}")
    t.export(_rows(s, d), path, form)
    return t.read_back(s, path, form)


def _exports(s: SparkSession, d: str) -> DataFrame:
    parts = [_again(s, d, form).agg(F.lit(form).alias("format"), F.count("*").alias("rows_back"), F.count("node_id").alias("ids"), F.sum(F.length("text")).cast("long").alias("chars")) for form in EXPORTERS.names()]
    return reduce(DataFrame.unionByName, parts)


_TEXTS = "(select distinct doc_id, ordinal, node_id, scope, text from @nodes)"
R.plan("o1_30_export", _exports, f"select 'jsonl' as format, count(*) as rows_back, count(*) as ids, sum(length(text))::bigint as chars from {_TEXTS} n union all select 'html', count(*), count(*), sum(length(text))::bigint from {_TEXTS} n where text is not null union all select 'text', count(*), 0, sum(length(regexp_replace(text, '\\s*\\n\\s*', ' ', 'g')))::bigint from {_TEXTS} n where text is not null")
R.plan("o1_32_read_html", lambda s, d: _again(s, d, "html").where("tag = 'figure'").select("node_id", "doc_id", "ordinal", "text"), "select distinct node_id, doc_id, ordinal, text from @nodes where scope = 'captions' and text is not null")
R.plan("o16_10_exporters", lambda s, d: s.createDataFrame([(x, len(EXPORTERS.get(x).keeps)) for x in EXPORTERS.names()], "format string, fields int"), "select * from (values ('html', 5), ('jsonl', 5), ('text', 0)) v(format, fields)")
R.plan("o15_26_measure_all", lambda s, d: reduce(DataFrame.unionByName, [t.losses(_rows(s, d), _again(s, d, form), form) for form in EXPORTERS.names()]), f"select f.format, c.field, case f.format when 'jsonl' then 0 when 'html' then (select count(*) from {_TEXTS} n where text is null) else (select count(*) from {_TEXTS} n where text is not null) end as lost, f.format = 'text' as declared from (values ('jsonl'), ('html'), ('text')) f(format) cross join (values ('doc_id'), ('ordinal'), ('tag'), ('text'), ('node_id')) c(field) where (f.format = 'text' and c.field <> 'text') or (f.format <> 'text' and c.field <> 'node_id')")


# sidecars
def _sidecar(s: SparkSession, d: str) -> str:
    path = fresh(s, "sidecar")
    head = s.createDataFrame([("head", "captions", None, None)], "kind string, form string, key long, text string")
    body = _nodes(s, d).where("scope = 'captions'").select(F.lit("record").alias("kind"), F.lit(None).cast("string").alias("form"), F.col("node_id").alias("key"), "text").distinct()
    head.unionByName(body).write.json(path)
    return path


def _read_sidecar(s: SparkSession, d: str) -> DataFrame:
    rows = s.read.schema("kind string, form string, key long, text string").json(_sidecar(s, d))
    return rows.where("kind = 'record'").select(F.col("key").alias("node_id"), "text")


R.plan("o1_47_read_sidecar", _read_sidecar, "select distinct node_id, text from @nodes where scope = 'captions'")
R.plan("o1_46_write_sidecar", lambda s, d: s.read.schema("kind string, form string, key long").json(_sidecar(s, d)).groupBy("kind").agg(F.count("*").alias("lines")), "select 'record' as kind, count(distinct node_id) as lines from @nodes where scope = 'captions' union all select 'head', 1")
R.plan("o1_55_save_manifest", lambda s, d: _manifest(s, d).groupBy("suite").agg(F.count("*").alias("items")), "select suite, count(*) as items from (select distinct item_id, suite, lang from @eval_items) e group by suite")


def _manifest(s: SparkSession, d: str) -> DataFrame:
    path = fresh(s, "manifest")
    s.read.parquet(f"{d}/eval_items.parquet").select("item_id", "suite", "lang").distinct().write.json(path)
    return s.read.schema("item_id long, suite string, lang string").json(path)


R.plan("o1_54_load_manifest", lambda s, d: _manifest(s, d).where(F.conv(F.substring(F.sha2(F.col("item_id").cast("string"), 256), 1, 4), 16, 10).cast("int") < 49152).select("item_id", "suite", "lang"), "select distinct item_id, suite, lang from @eval_items where ('0x' || substr(sha256(item_id::varchar), 1, 4))::int < 49152")


# pages
def _pages(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/text_spans.parquet").where("page >= 1").groupBy("doc_id").agg(F.collect_set(F.col("page") - 1).alias("pages"), F.max("page").alias("count")).withColumn("ranges", t.described("pages"))  # the pages of one document, as one row


R.plan("o15_31_describe_pages", lambda s, d: _pages(s, d).select("doc_id", "ranges"), "select doc_id, string_agg(case when a = b then a::varchar else a::varchar || '-' || b::varchar end, ',' order by a) as ranges from (select doc_id, min(page) as a, max(page) as b from (select doc_id, page, page - row_number() over (partition by doc_id order by page) as g from (select distinct doc_id, page from @text_spans where page >= 1) p) q group by doc_id, g) r group by doc_id")
R.plan("o15_30_parse_page_range", lambda s, d: _pages(s, d).withColumn("typed", F.concat("ranges", F.lit(", 9999, x"))).select("doc_id", F.explode(t.page_range("typed", "count")).alias("idx")), "select distinct doc_id, page - 1 as idx from @text_spans where page >= 1")
R.plan("o15_38_book_profile", lambda s, d: s.read.parquet(f"{d}/library.parquet").where("content_key <> ''").groupBy("content_key").agg(F.max_by("uri", F.struct(F.coalesce("indexed_at", F.lit("1900-01-01").cast("timestamp")), "doc_id")).alias("uri"), F.countDistinct("doc_id").alias("versions")), "select content_key, arg_max(uri, (coalesce(indexed_at, timestamp '1900-01-01'), doc_id)) as uri, count(distinct doc_id) as versions from @library where content_key <> '' group by content_key")

# engines: scorers of spans by name, each asked in turn
ENGINES.register("length", lambda: lambda text, confidence: F.least(F.lit(1.0), F.length(text) / 60.0), replace=True)
ENGINES.register("confidence", lambda: lambda text, confidence: F.coalesce(confidence, F.lit(0.0)), replace=True)
R.plan("o16_4_engine_registry", lambda s, d: s.read.parquet(f"{d}/text_spans.parquet").where("text is not null").select("span_id", *(F.round(ENGINES.get(n)(F.col("text"), F.col("confidence")), 6).alias(n) for n in ENGINES.names())).distinct(), "select distinct span_id, floor(coalesce(confidence, 0) * 1e6 + 5e-1) / 1e6 as confidence, floor(least(1.0, length(text) / 60.0) * 1e6 + 5e-1) / 1e6 as length from @text_spans where text is not null")

