"""Queries of page layout, fusion of readings, repair of games, and corpus substitution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import SAN
from ..operators import edits as x
from ..operators import fusion as fu
from ..operators import layout as la
from ..operators import repair as re_
from ..session import written
from .registry import Registry

R = Registry()


def _boxes(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/text_spans.parquet").dropDuplicates(["span_id"]).select("doc_id", "page", F.col("span_id").alias("id"), "line_no", "x", "y", "w", "h", "text", "confidence", "engine")


_B = "(select distinct span_id as id, doc_id, page, line_no, span_no, x, y, w, h, text, confidence, engine from @text_spans)"
_OK = f"(select * from {_B} b where x is not null and y is not null and w > 0 and h > 0)"
_COV = f"(select doc_id, page, bin, count(distinct line_no) as n from (select doc_id, page, line_no, unnest(range(floor(x / 4)::int, ceil((x + w) / 4)::int)) as bin from {_OK} b) c group by doc_id, page, bin)"
_SPAN = f"(select doc_id, page, floor(min(x) / 4)::int as lo, ceil(max(x + w) / 4)::int as hi, count(distinct line_no) as lines from {_OK} b group by doc_id, page)"
_FREE = f"(select s.doc_id, s.page, s.lo, s.hi, s.bin from (select *, unnest(range(lo, hi)) as bin from {_SPAN} q) s left join {_COV} c on c.doc_id = s.doc_id and c.page = s.page and c.bin = s.bin where coalesce(n, 0) <= 1e-1 * lines)"
_RUNS = f"(select doc_id, page, min(bin) * 4e0 as l, (max(bin) + 1) * 4e0 as r from (select *, bin - row_number() over (partition by doc_id, page order by bin) as g from {_FREE} f) t group by doc_id, page, g having min(bin) > any_value(lo) and max(bin) + 1 < any_value(hi) and (max(bin) + 1 - min(bin)) * 4 >= 12)"
_GUT = f'(select g.doc_id, g.page, l, r from {_RUNS} g join {_OK} b on b.doc_id = g.doc_id and b.page = g.page group by g.doc_id, g.page, l, r having count(distinct case when x + w <= l + 4 then line_no end) >= 3 and count(distinct case when x >= r - 4 then line_no end) >= 3)'
R.plan("o12_15_find_gutters", lambda s, d: la.gutters(_boxes(s, d)).select("doc_id", "page", F.col("left").alias("from_x"), F.col("right").alias("to_x")), f"select doc_id, page, l as from_x, r as to_x from {_GUT} g")
R.plan("o5_5_detect_columns", lambda s, d: la.columns(_boxes(s, d)).groupBy("doc_id", "page", "column").agg(F.count("*").alias("boxes")), f"select doc_id, page, c as \"column\", count(*) as boxes from (select b.doc_id, b.page, b.id, count(g.l) filter (b.x + b.w / 2 > g.l) + 1 as c from {_OK} b left join {_GUT} g on g.doc_id = b.doc_id and g.page = b.page group by b.doc_id, b.page, b.id) t group by doc_id, page, c")
R.plan("o12_16_split_at_gutters", lambda s, d: la.columns(_boxes(s, d)).select(F.col("id").alias("span_id"), "column"), f"select b.id as span_id, count(g.l) filter (b.x + b.w / 2 > g.l) + 1 as \"column\" from {_OK} b left join {_GUT} g on g.doc_id = b.doc_id and g.page = b.page group by b.id")
R.plan("o5_7_reading_order", lambda s, d: la.reading_order(_boxes(s, d)).select(F.col("id").alias("span_id"), "rank"))
_ROW = f"(select doc_id, page, line_no, count(*) as cells, sum(length(text)) as chars from {_OK} b where text <> '' group by doc_id, page, line_no having count(*) >= 2 and quantile_cont(length(text), 5e-1) <= 12 and max(length(text)) <= 24)"
R.plan("o12_14_rows_of_tables", lambda s, d: la.table_rows(_boxes(s, d)).select("doc_id", "page", "line_no", "cells"), f"select doc_id, page, line_no, cells from {_ROW} r")
R.plan("o12_13_table_groups", lambda s, d: la.tables(_boxes(s, d)).select("doc_id", "page", "first", "last", "rows"), f"select doc_id, page, min(line_no) as \"first\", max(line_no) as \"last\", count(*) as rows from (select *, line_no - row_number() over (partition by doc_id, page order by line_no) as g from {_ROW} r) t group by doc_id, page, g having count(*) >= 3")
_EDGE = f"(select *, case when line_no = top then 'header' else 'footer' end as band, lower(regexp_replace(regexp_replace(trim(text, ' '), '\\d+', '#', 'g'), '\\s+', ' ', 'g')) as fp from (select *, min(line_no) over (partition by doc_id, page) as top, max(line_no) over (partition by doc_id, page) as bottom from {_B} b where text <> '' and line_no is not null) t where line_no in (top, bottom))"
_VOTES = f"(select doc_id, fp, count(distinct page) as votes from {_EDGE} e group by doc_id, fp)"
_HEADS = f"(select v.doc_id, v.fp, votes from {_VOTES} v join (select doc_id, count(distinct page) as pages from {_B} b group by doc_id) p on p.doc_id = v.doc_id where votes >= greatest(3, floor(pages * 25e-2)))"
R.plan("o5_1_furniture_observe", lambda s, d: la.margins(_boxes(s, d)).select("doc_id", "page", la.fingerprint("text").alias("fp")).distinct().groupBy("doc_id", "fp").agg(F.count("*").alias("votes")), f"select * from {_VOTES} v")
R.plan("o5_2_furniture_finalize", lambda s, d: la.furniture(_boxes(s, d)).select("doc_id", F.col("print").alias("fp"), F.col("pages").alias("votes")), f"select * from {_HEADS} h")
R.plan("o5_3_furniture_classify", lambda s, d: la.classified(_boxes(s, d)).select(F.col("id").alias("span_id"), "kind"), f"select e.id as span_id, case when regexp_matches(lower(trim(regexp_replace(text, '[^0-9A-Za-z]', ' ', 'g'), ' ')), '^([0-9]{{1,4}}|[ivxlcdm]+)$') then 'page number' when h.fp is not null then band else 'body' end as kind from {_EDGE} e left join {_HEADS} h on h.doc_id = e.doc_id and h.fp = e.fp")
R.plan("o12_17_analyze_page", lambda s, d: la.analyzed(_boxes(s, d)))
R.plan("o12_18_analyze_document", lambda s, d: la.documents(la.analyzed(_boxes(s, d))))


# fusion: three readings of each edited node
def _readings(s: SparkSession, d: str) -> DataFrame:
    """The text before, the text after, and the stored text of each edit's node, as three sources of one region."""
    j = s.read.parquet(f"{d}/edit_journal.parquet").dropDuplicates(["edit_id"]).select("edit_id", "node_id", "text_before", "text_after")
    n = s.read.parquet(f"{d}/nodes.parquet").where("text <> ''").select("node_id", F.col("text").alias("stored")).dropDuplicates(["node_id"])
    j = j.join(n, "node_id", "left")
    sources = [("before", 1, 0.7, "text_before"), ("after", 2, 0.6, "text_after"), ("stored", 3, 0.8, "stored")]
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("source"), F.lit(b).alias("level"), F.lit(c).alias("score"), F.col(t).alias("text")) for a, b, c, t in sources]))
    return j.select(F.col("edit_id").alias("region"), each.alias("r")).select("region", "r.*")


R.plan("o12_7_fuse_candidates", lambda s, d: fu.fused(_readings(s, d)).where("disputed"))
R.plan("o12_8_agreement", lambda s, d: fu.fused(_readings(s, d)).select("region", "i", F.round(F.col("votes") / F.col("readings"), 6).alias("agreement")))
R.plan("o12_9_fusion_summary", lambda s, d: fu.fusion_summary(fu.fused(_readings(s, d))))
_THREE = "(select edit_id as region, text_before is not null as a, text_after is not null as b, exists (select 1 from @nodes n where n.node_id = j.node_id and n.text <> '') as c from (select distinct edit_id, node_id, text_before, text_after from @edit_journal) j)"
R.plan("o12_2_arbiter_run", lambda s, d: fu.arbitrated(_readings(s, d)).select("region", "source", "asked"), f"select region, case when c then 'stored' when a then 'before' else 'after' end as source, (a::int + b::int + c::int)::int as asked from {_THREE} t where a or b or c")
R.plan("o12_1_arbiter_score", lambda s, d: _boxes(s, d).where("text is not null").select(F.col("id").alias("span_id"), F.round(fu.score(F.col("confidence"), F.least(F.lit(1.0), F.length("text") / 60.0), F.when(F.col("engine") != "", F.lit(0.5))), 6).alias("score")), f"select id as span_id, floor((coalesce(45e-2 * confidence, 0) + 35e-2 * least(1.0, length(text) / 60.0) + case when engine <> '' then 1e-1 else 0 end) / (case when confidence is null then 0 else 45e-2 end + 35e-2 + case when engine <> '' then 2e-1 else 0 end) * 1e6 + 5e-1) / 1e6 as score from {_B} b where text is not null")


# games
def _games(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/nodes.parquet").where("scope = 'mainline' and text <> ''").select("node_id", "text").distinct()


R.plan("o11_2_repair_token", lambda s, d: re_.repairs(_games(s, d)))
R.plan("o11_6_repair_confidence", lambda s, d: re_.repairs(_games(s, d)).groupBy("node_id").agg(F.max("locale").alias("locale"), F.count("san").alias("legal"), F.round(F.avg("confidence"), 6).alias("confidence")))
R.plan("o11_13_candidates", lambda s, d: re_.repairs(_games(s, d)).where("readings > 1").select("node_id", "i", "printed", "san", "readings"))
R.plan("o11_37_is_invention", lambda s, d: re_.repairs(_games(s, d)).where("san is not null").select("node_id", "i", re_.invention().alias("invented")))
_FIRST = f"(select node_id, regexp_extract_all(text, '{SAN}') as l from (select distinct node_id, text from @nodes where scope = 'mainline' and text <> '') n)"
R.plan("o11_18_variation_text", lambda s, d: _games(s, d).select("node_id", F.regexp_extract_all("text", F.lit(SAN), F.lit(0)).alias("l"), F.lit("8/8/8/8/8/8/8/8 b - - 0 7").alias("fen")).select("node_id", re_.numbered("l").alias("movetext")), f"select node_id, array_to_string(list_transform(range(1, len(l) + 1), lambda i: case when i % 2 = 0 then (7 + i // 2)::varchar || '. ' when i = 1 then '7... ' else '' end || l[i]), ' ') as movetext from {_FIRST} f")
R.plan("o11_12_label_lineage", lambda s, d: s.createDataFrame([("B1.2",), ("A",), ("C3.1.4",), ("",)], "label string").select("label", F.array_join(re_.lineage("label"), ",").alias("lineage")), "select * from (values ('B1.2', 'B,B1,B1.2'), ('A', 'A'), ('C3.1.4', 'C,C3,C3.1,C3.1.4'), ('', '')) v(label, lineage)")
_SEG = "(select doc_id, row_number() over (partition by doc_id order by ordinal) as game, ordinal as a, coalesce(lead(ordinal) over (partition by doc_id order by ordinal) - 1, (select max(ordinal) from @nodes m where m.doc_id = h.doc_id)) as z from (select distinct doc_id, ordinal from @nodes where scope = 'headers' and text like '[%') h)"


def _nodes(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/nodes.parquet")


def _cursors(s: SparkSession, d: str) -> DataFrame:
    """A cursor in the middle of each document."""
    return _nodes(s, d).groupBy("doc_id").agg(F.floor(F.max("ordinal") / 2).alias("position"))


R.plan("o9_20_split_games", lambda s, d: re_.segments(_nodes(s, d)).select("doc_id", "game", F.col("first").alias("a"), F.col("last").alias("z")), f"select doc_id, game, a, z from {_SEG} s")
R.plan("o9_21_segment_at", lambda s, d: re_.segment_at(re_.segments(_nodes(s, d)), _cursors(s, d)), f"select c.doc_id, c.position, s.game from (select doc_id, max(ordinal) // 2 as position from @nodes group by doc_id) c left join {_SEG} s on s.doc_id = c.doc_id and c.position between s.a and s.z")


def _analyzed(s: SparkSession, d: str) -> DataFrame:
    """The moves of the game that the cursor of each document stands in."""
    seg = re_.segments(_nodes(s, d))
    at = re_.segment_at(seg, _cursors(s, d)).where("game is not null").join(seg, ["doc_id", "game"])
    n = _nodes(s, d).where("scope = 'mainline' and text <> ''").select("doc_id", "ordinal", "text").distinct()
    return at.join(n, "doc_id").where("ordinal between first and last").select("doc_id", "game", F.posexplode(F.regexp_extract_all("text", F.lit(SAN), F.lit(0))).alias("i", "san"))


R.plan("o11_15_analyze_segment", _analyzed, f"select doc_id, game, unnest(range(len(l)))::int as i, unnest(l) as san from (select c.doc_id, s.game, regexp_extract_all(n.text, '{SAN}') as l from (select doc_id, max(ordinal) // 2 as position from @nodes group by doc_id) c join {_SEG} s on s.doc_id = c.doc_id and c.position between s.a and s.z join (select distinct doc_id, ordinal, text from @nodes where scope = 'mainline' and text <> '') n on n.doc_id = c.doc_id and n.ordinal between s.a and s.z) t")

# substitution
_OWN = "(select distinct node_id, doc_id, scope, text from @nodes)"
_HITS = f"(select node_id, doc_id, m, i, (select coalesce(sum(length(g[k])), 0) from unnest(range(1, i + 1)) t(k)) + (select coalesce(sum(length(l[k])), 0) from unnest(range(1, i)) t(k)) as a from (select node_id, doc_id, l, g, unnest(range(1, len(l) + 1)) as i, unnest(l) as m from (select node_id, doc_id, regexp_extract_all(text, '[Tt]he [a-z]+ king') as l, string_split_regex(text, '[Tt]he [a-z]+ king') as g from {_OWN} n where regexp_matches(text, '[Tt]he [a-z]+ king')) x) y)"
_P, _TO = "([Tt])he ([a-z]+) king", "$1he $2 monarch"
R.plan("o14_1_corpus_regex", lambda s, d: x.matches(_nodes(s, d), "[Tt]he [a-z]+ king").select("node_id", F.col("i").cast("long").alias("i"), F.col("start").cast("long").alias("start"), "match"), f"select node_id, i - 1 as i, a::bigint as start, m as match from {_HITS} h")
R.plan("o14_2_plan", lambda s, d: x.plan(_nodes(s, d), _P, _TO, "comments").select("node_id", F.col("start").cast("long").alias("start"), "becomes"), f"select h.node_id, a::bigint as start, regexp_replace(m, 'king$', 'monarch') as becomes from {_HITS} h where node_id in (select node_id from @nodes where scope = 'comments')")
_NEW = f"(select node_id, text, regexp_replace(text, '([Tt])he ([a-z]+) king', '\\1he \\2 monarch', 'g') as t from {_OWN} n)"
R.plan("o14_8_preview", lambda s, d: x.preview(_nodes(s, d), x.plan(_nodes(s, d), _P, _TO)).select("node_id", "text_after"), f"select node_id, t as text_after from {_NEW} n where t <> text")
R.plan("o14_3_apply", lambda s, d: x.apply(_nodes(s, d).dropDuplicates(["node_id"]), x.plan(_nodes(s, d), _P, _TO), "b1")[0].where("scope = 'comments'").select("node_id", "text"), f"select n.node_id, coalesce(w.t, n.text) as text from {_OWN} n left join {_NEW} w on w.node_id = n.node_id where n.scope = 'comments'")
R.plan("o14_9_apply_result", lambda s, d: x.apply(_nodes(s, d).dropDuplicates(["node_id"]), x.plan(_nodes(s, d), _P, _TO), "b1")[1].select("node_id", F.col("text_after").alias("text"), F.col("text_before").alias("previous_text")), f"select node_id, t as text, text as previous_text from {_NEW} n where t <> text")


def _two_batches(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = _nodes(s, d).dropDuplicates(["node_id"])
    one, j1, _ = x.apply(n, x.plan(n, _P, _TO), "b1")
    one = written(one, "edited")
    two, j2, _ = x.apply(one, x.plan(one, "monarch", "ruler"), "b2")
    return two, written(j1.unionByName(j2), "journal")


def _undone(s: SparkSession, d: str) -> DataFrame:
    """Two batches that build on each other, and the second undone: the first one's texts stand."""
    two, journal = _two_batches(s, d)
    back, _ = x.undo(two, journal, "b2")
    return back.where("text like '% monarch%' or text like '% king%'").select("node_id", "text")


R.plan("o14_4_undo", _undone, f"select node_id, t as text from {_NEW} n where t like '% monarch%' or t like '% king%'")
R.plan("o14_7_apply_and_undo", lambda s, d: x.undoable(_two_batches(s, d)[1]), f"select 'b2' as batch from (select 1 from {_NEW} n where t <> text limit 1) q")
