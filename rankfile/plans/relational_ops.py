"""Filters, joins, aggregations, windows, sorts, set operations, updates and trees over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import bind
from ..functions.scalars import SAN, TEMPLATES
from ..operators import movetext
from .registry import Registry

R = Registry()
S, P = R.shared, R.pair

RADIUS, SHARED = 60, "25e-2"  # points around a box that count as near; share of the shorter side two boxes must have in common


def _move_depth(s: SparkSession, d: str) -> DataFrame:
    """Depth of variations at every printed move; pos counts the moves of a node."""
    return movetext.moves(s.read.parquet(f"{d}/nodes.parquet")).select("node_id", F.col("i").alias("pos"), "depth")


# 2.1 scans
P("o1_6_text_units", "select doc_id, pos as ordinal, block from (select doc_id, posexplode(split(text, '\n\n')) as (pos, block) from @documents) t where trim(block) <> ''", "select doc_id, ordinal, block from (select doc_id, unnest(range(len(l)))::int as ordinal, unnest(l) as block from (select doc_id, string_split(text, '\n\n') as l from @documents) s) t where trim(block) <> ''")
S("o1_2_index_unit", "select n.node_id, n.doc_id, n.scope, n.page, n.ordinal, n.byte_start, n.byte_len, (n.text <> '') as store_text, f.white, f.black, f.eco, f.year, f.result from @N n left join @F f on n.node_id = f.node_id")
S("o1_3_facets", "select node_id, white, black, eco, year, result from @F f where white is not null and black is not null")
P("o1_4_position_refs", f"select node_id, pos + 1 as ply, (pos % 2 = 0) as white_moved, san from (select node_id, posexplode(ALL(text, '{SAN}')) as (pos, san) from @N n where scope = 'mainline' and text <> '') t", f"select node_id, ply, (ply % 2 = 1) as white_moved, san from (select node_id, unnest(range(1, len(l) + 1))::int as ply, unnest(l) as san from (select node_id, ALL(text, '{SAN}') as l from @N n where scope = 'mainline' and text <> '') s) t")
S("o1_5_content_key", "select doc_id, content_key, (split_part(content_key, ':', 1) = STR(size_bytes)) as size_agrees from @D d where content_key <> ''")
S("o1_14_pgn_unit", "select h.node_id, EX(h.text, '[[]White \"([^\"]*)\"', 1) as white, EX(h.text, '[[]Black \"([^\"]*)\"', 1) as black, EX(h.text, '[[]Result \"([^\"]*)\"', 1) as result, EX(h.text, '[[]ECO \"([^\"]*)\"', 1) as eco from @N h where h.scope = 'headers' and h.text like '[%'")
S("o1_16_game_spans", "select doc_id, count(*) as games, min(ordinal) as first_ordinal, max(ordinal) as last_ordinal from @N n where scope = 'headers' and text like '[%' group by doc_id")
S("o1_24_content_hash", "select doc_id, SHA(text) as hash from (select distinct doc_id, text from @documents) t where text is not null")
P("o1_25_sample_indices", "select doc_id, explode(transform(sequence(0, 3), i -> INT(floor(i * node_count / 4)))) as idx from @D d where node_count >= 4", "select doc_id, unnest([0, node_count // 4, 2 * node_count // 4, 3 * node_count // 4])::int as idx from @D d where node_count >= 4")
P("o1_45_records", "select node_id, to_json(struct(node_id, scope)) as record from @N n where scope = 'captions'", "select node_id, '{\"node_id\":' || node_id || ',\"scope\":\"' || scope || '\"}' as record from @N n where scope = 'captions'")
S("o1_48_verify_duplicates", "select node_id, count(*) as n from @nodes group by node_id having count(*) > 1")
P("o1_50_structural_json", "select node_id, to_json(struct(white, black, year), map('ignoreNullFields', 'false')) as js from @F f", "select node_id, to_json({'white': white, 'black': black, 'year': year}) as js from @F f")
P("o1_51_normalized_text", "select doc_id, concat_ws(' | ', transform(array_sort(collect_list(struct(ordinal, node_id, text))), x -> x.text)) as text from @N n where scope = 'captions' and text is not null group by doc_id", "select doc_id, string_agg(text, ' | ' order by ordinal, node_id, text) as text from @N n where scope = 'captions' and text is not null group by doc_id")

# 2.2 filters
S("o2_3_scope_filter", "select node_id from @N n where scope = 'captions'")
S("o2_4_documents_in", "select node_id from @N n join @D d on n.doc_id = d.doc_id where d.uri in (select uri from @D e where e.kind = 'pgn')")
S("o2_5_stratum_filter", "select doc_id, uri from @D d where stratum = 'scan'")
S("o2_6_eco_nonempty", "select node_id, eco from @F f where eco is not null and eco <> ''")
S("o2_7_eco_matches", "select node_id, eco from @F f where RL(eco, '^(?:B[0-4][0-9])')")
S("o2_8_player_like", "select node_id, white, black from @F f where lower(white) like '%mitri%' or lower(black) like '%mitri%'")
S("o2_9_year_min", "select node_id, year from @F f where year >= 1950")
S("o2_10_year_max", "select node_id, year from @F f where year <= 1950 and year > 0")
P("o2_11_filter_regex", "select node_id, regexp_instr(text, '[0-9]+[.]{3}[A-Z]') as first_at, SIZE(ALL(text, '[0-9]+[.]{3}[A-Z]')) as matches from @N n where RL(text, '[0-9]+[.]{3}[A-Z]')", "select node_id, instr(text, EX(text, '[0-9]+[.]{3}[A-Z]', 0))::int as first_at, SIZE(ALL(text, '[0-9]+[.]{3}[A-Z]')) as matches from @N n where RL(text, '[0-9]+[.]{3}[A-Z]')")
P("o2_16_first_move_match", "select node_id, min(pos) as chunk from (select node_id, posexplode(SPLIT(text, '[ \n]+')) as (pos, c) from @N n where text <> '') t where RL(RR(RR(c, '^[0-9]+[.]+', ''), '[!?.,;:]+$', ''), '^Q.*x') group by node_id", "select node_id, min(pos) as chunk from (select node_id, unnest(range(len(l)))::int as pos, unnest(l) as c from (select node_id, SPLIT(text, '[ \n]+') as l from @N n where text <> '') s) t where RL(RR(RR(c, '^[0-9]+[.]+', ''), '[!?.,;:]+$', ''), '^Q.*x') group by node_id")
S("o2_19_text_of", "select node_id, case when text = '' then 'source' when text is null then 'none' else 'stored' end as place, INT(length(text)) as n from @N n")
P("o2_24_regex_search", "select node_id, pos as i, m from (select node_id, posexplode(ALL(text, '[a-h]x[a-h][1-8]')) as (pos, m) from @N n where scope <> 'headers') t", "select node_id, unnest(range(len(l)))::int as i, unnest(l) as m from (select node_id, ALL(text, '[a-h]x[a-h][1-8]') as l from @N n where scope <> 'headers') t")
_MOVE_ROWS_S = f"select node_id, pos + 1 as ply, san from (select node_id, posexplode(ALL(text, '{SAN}')) as (pos, san) from @N n where scope = 'mainline' and text <> '') t"
_MOVE_ROWS_D = f"select node_id, unnest(range(1, len(l) + 1))::int as ply, unnest(l) as san from (select node_id, ALL(text, '{SAN}') as l from @N n where scope = 'mainline' and text <> '') s"
_WHERE = "where san like '%x%' and san like 'R%' and ply between 10 and 40 and ply % 2 = 1"
S("o2_27_matches_eco", "select f.doc_id, count(*) as n from @F f where RL(eco, '^C') group by f.doc_id")
S("o2_38_eco_query", "select node_id, eco from @F f where RL(eco, '^(?:E6[0-9]|E[7-9].)$')")
_ISLANDS = "select doc_id, s, e, sum(case when s <= back then 0 else 1 end) over (partition by doc_id order by s, e rows unbounded preceding) as island from (select doc_id, s, e, max(e) over (partition by doc_id order by s, e rows between unbounded preceding and 1 preceding) as back from (select doc_id, byte_start as s, byte_start + byte_len as e from @N n where byte_start >= 0) a) b"
S("o2_45_merge_spans", f"select doc_id, island, min(s) as s, max(e) as e from (select doc_id, s, e, LONG(island) as island from ({_ISLANDS}) c) d group by doc_id, island")
S("o2_44_spans_for", f"select doc_id, count(distinct island) as spans, LONG(sum(e - s)) as bytes from ({_ISLANDS}) c group by doc_id")
S("o2_46_region_contains", "select a.node_id as outer_id, b.node_id as inner_id from (select * from @N n where byte_start >= 0) a join (select * from @N m where byte_start >= 0) b on a.doc_id = b.doc_id and a.node_id <> b.node_id and b.byte_start >= a.byte_start and b.byte_start + b.byte_len <= a.byte_start + a.byte_len and a.ordinal - b.ordinal between -3 and 3")

# 2.3 joins
S("o3_1_nodes_documents", "select n.node_id, d.uri, d.kind from @N n join @D d on n.doc_id = d.doc_id")
S("o3_2_nodes_facets", "select n.node_id, n.scope, f.white, f.year from @N n left join @F f on n.node_id = f.node_id")
S("o3_3_intersect_candidates", "select a.node_id, LONG(a.score + b.score) as score from (select node_id, 1 as score from @N n where text like '%king%') a join (select node_id, 2 as score from @N m where text like '%queen%') b on a.node_id = b.node_id")
S("o3_4_candidate_restriction", "select node_id, scope from @N n where exists (select 1 from @F f where f.node_id = n.node_id and f.eco = 'B90')")
_GAPS = "select a.span_id as anchor, b.span_id as near_id, greatest(a.x - b.x - b.w, b.x - a.x - a.w, 0e0) as dx, greatest(a.y - b.y - b.h, b.y - a.y - a.h, 0e0) as dy, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) as ox, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) as oy, a.w as aw, b.w as bw, a.h as ah, b.h as bh from @S a join @S b on a.doc_id = b.doc_id and a.page = b.page and a.span_id <> b.span_id and a.x + a.y + a.w + a.h is not null and b.x + b.y + b.w + b.h is not null"
P("o3_12_lines_near", f"select anchor, near_id, round(distance, 4) as distance from (select *, sqrt(dx * dx + dy * dy) as distance from ({_GAPS}) g) t where distance <= {RADIUS} and ((dy > 0 or dx = 0) and ox >= {SHARED} * least(aw, bw) and least(aw, bw) > 0 or dx > 0 and oy >= {SHARED} * least(ah, bh) and least(ah, bh) > 0)", f"with s as (select span_id, doc_id, page, x as l, x + w as r, y as t, y + h as b from @S s where x + y + w + h is not null), p as (select a.span_id as anchor, c.span_id as near_id, case when c.l > a.r then c.l - a.r when a.l > c.r then a.l - c.r else 0 end as dx, case when c.t > a.b then c.t - a.b when a.t > c.b then a.t - c.b else 0 end as dy, (least(a.r, c.r) - greatest(a.l, c.l)) / nullif(least(a.r - a.l, c.r - c.l), 0) as sx, (least(a.b, c.b) - greatest(a.t, c.t)) / nullif(least(a.b - a.t, c.b - c.t), 0) as sy from s a join s c on a.doc_id = c.doc_id and a.page = c.page and a.span_id <> c.span_id) select anchor, near_id, round(sqrt(dx * dx + dy * dy), 4) as distance from p where dx * dx + dy * dy <= {RADIUS} * {RADIUS} and (((dy > 0 or dx = 0) and sx >= {SHARED}) or (dx > 0 and sy >= {SHARED}))")
S("o3_8_pair_lines", "select anchor, other from (select a.span_id as anchor, b.span_id as other, row_number() over (partition by a.span_id order by abs(a.y - b.y), b.span_id) as r from @S a join @S b on a.doc_id = b.doc_id and a.page = b.page and b.line_no = a.line_no + 1) t where r = 1")
S("o3_13_assign_lines", "select line_id, anchor from (select b.span_id as line_id, a.span_id as anchor, row_number() over (partition by b.span_id order by abs(a.y - b.y), a.span_id) as r from (select * from @S s where font_size <= 9) a join @S b on a.doc_id = b.doc_id and a.page = b.page and a.span_id <> b.span_id) t where r = 1")
S("o3_15_decision_match", "select s1, max(s2) as s2 from (select a.span_id as s1, b.span_id as s2 from @S a join @S b on a.doc_id = b.doc_id and a.page = b.page and a.span_id <> b.span_id and least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) >= a.h * 5e-1) t group by s1")
P("o3_17_semantic_diff", "select coalesce(a.node_id, b.node_id) as node_id, case when a.node_id is null then 'added' when b.node_id is null then 'removed' when a.t <> b.t then 'changed' else 'same' end as change from (select node_id, max(text_before) as t from @J j where not undone group by node_id) a full join (select node_id, min(text_after) as t from @J k group by node_id) b on a.node_id = b.node_id", "select node_id, case when x is null then 'added' when y is null then 'removed' when x <> y then 'changed' else 'same' end as change from (select node_id, max(text_before) filter (not undone) as x, min(text_after) as y from @J j group by node_id) t")
S("o3_18_validate", "select 'dangling facet' as problem, f.node_id as id from @F f where not exists (select 1 from @N n where n.node_id = f.node_id) union all select 'duplicate node', node_id from @nodes group by node_id having count(*) > 1 union all select 'document without nodes', d.doc_id from @D d where not exists (select 1 from @N m where m.doc_id = d.doc_id)")
S("o3_19_calibration_lookup", "select item_id, code, coalesce(case when code = 'en' then 1 end, case when code in ('de', 'fr') then 2 end, 3) as table_no from @L l where code is not null")

# 2.4 aggregations
S("o4_4_next_node_id", "select coalesce(max(node_id), 0) + 1 as next_id from @nodes")
S("o4_5_finish", "select d.doc_id, d.node_count as stored, count(n.node_id) as counted from @D d left join @N n on n.doc_id = d.doc_id group by d.doc_id, d.node_count")
S("o4_6_batches", "select batch, min(applied_at) as applied_at, count(*) as edits from @J j where not undone group by batch")
S("o14_5_batches", "select batch, min(applied_at) as applied_at, count(*) as edits from @J j where not undone group by batch")
S("o4_7_plan_documents", "select batch, count(distinct doc_id) as documents from @J j group by batch")
S("o4_8_plan_accepted", "select batch, LONG(sum(case when text_before <> text_after then 1 else 0 end)) as accepted from @J j group by batch")
_ROWS = "select s.span_id, d.stratum, d.kind, s.engine, s.confidence, (s.confidence > 85e-2) as ok, LONG(length(s.text)) as chars from @S s join @D d on s.doc_id = d.doc_id where s.confidence is not null and s.text is not null"
_BINS = f"select INT(least(floor(confidence * 10), 9)) as bin, count(*) as n, avg(confidence) as conf, avg(case when ok then 1e0 else 0e0 end) as acc from ({_ROWS}) r group by 1"
S("o4_21_mean", "select coalesce(round(avg(score), 6), 0e0) as mean_score, count(score) as n from @L l")
S("o4_22_assess_page", f"select doc_id, page, round(sum(confidence * length(text)) / sum(length(text)), 6) as weighted, max(case when confidence < 45e-2 then 2 when confidence < 8e-1 then 1 else 0 end) as severity from @S s where confidence is not null and length(text) > 0 group by doc_id, page")
S("o4_27_label_summary", "select count(*) as n, LONG(sum(case when review then 1 else 0 end)) as to_review, LONG(sum(case when confidence is null then 1 else 0 end)) as unknown from @S s")
S("o4_28_page_counts", "select doc_id, page, count(*) as spans, LONG(sum(case when review then 1 else 0 end)) as to_review from @S s group by doc_id, page")
R.pair("o4_29_measure_group", "select undone, LONG(sum(levenshtein(text_before, text_after))) as distance, LONG(sum(length(text_before))) as chars from @J j group by undone", None)
S("o4_30_book_measure", "select a.doc_id, a.n as with_engine, coalesce(b.n, 0) as without_engine from (select doc_id, count(*) as n from @S s where engine <> '' group by doc_id) a left join (select doc_id, count(*) as n from @S t where engine = '' group by doc_id) b on a.doc_id = b.doc_id")
S("o4_31_decision_counts", "select case when confidence is null then 'abstained' when confidence >= 8e-1 then 'accepted' when confidence >= 45e-2 then 'review' else 'abstained' end as decision, count(*) as n from @S s group by 1")
S("o4_32_count_by_severity", "select case when confidence < 45e-2 then 'bad' when confidence < 8e-1 then 'attention' else 'ok' end as severity, count(*) as n from @S s where confidence is not null group by 1")
S("o4_33_by_property", "select font, count(*) as n from @S s group by font")
S("o4_34_by_kind", "select kind, state, count(*) as n from @D d group by kind, state")
S("o4_35_by_node_type", "select scope, LONG(sum(case when text is null then 1 else 0 end)) as damaged, count(*) as n from @N n group by scope")
S("o4_36_by_property_distinct", "select 'font' as field, count(distinct span_id) as n from @S s where font is null union all select 'confidence', count(distinct span_id) from @S t where confidence is null")
S("o4_37_diff_fidelity", "select round(greatest(0e0, (count(*) - sum(case when text_before <> text_after then 1 else 0 end)) / DBL(count(*))), 6) as fidelity from @J j")
S("o4_38_piece_counts", "select p.p as piece, count(*) as lines from @S s cross join (values ('♔'),('♕'),('♖'),('♗'),('♘')) p(p) where instr(s.text, p.p) > 0 group by p.p")
P("o4_39_oversample", "select span_id, explode(sequence(1, case when text like '%♔%' then 3 else 1 end)) as copy from @S s where text like '%♔%' or text like '%♕%'", "select span_id, unnest(range(1, case when text like '%♔%' then 4 else 2 end))::int as copy from @S s where text like '%♔%' or text like '%♕%'")

# 2.5 windows
_MARGIN = "select distinct s.doc_id, s.page, lower(RR(trim(s.text), '[0-9]+', '#')) as fp from @S s join (select doc_id, page, min(line_no) as top, max(line_no) as bottom from @S t group by doc_id, page) e on s.doc_id = e.doc_id and s.page = e.page and (s.line_no = e.top or s.line_no = e.bottom) where s.text is not null"
S("o5_4_body_font_size", "select doc_id, font_size from (select doc_id, font_size, row_number() over (partition by doc_id order by n desc, font_size) as r from (select doc_id, font_size, sum(length(text)) as n from @S s where text is not null group by doc_id, font_size) a) b where r = 1")
S("o5_6_largest_gap", "select doc_id, page, round(max(y - back), 4) as gap from (select doc_id, page, y, max(y + h) over (partition by doc_id, page order by y, span_id rows between unbounded preceding and 1 preceding) as back from @S s) t where back is not null group by doc_id, page")
S("o5_8_running_page_number", "select doc_id, page, (page = back + 1) as follows from (select doc_id, page, lag(page) over (partition by doc_id order by page) as back from (select distinct doc_id, page from @S s) p) t")
S("o5_9_dominant_placement", "select doc_id, max(case when r = 1 then engine end) as engine from (select doc_id, engine, row_number() over (partition by doc_id order by count(*) desc, engine) as r from @S s group by doc_id, engine) t group by doc_id")
S("o5_10_paragraph_builder", "select doc_id, page, para, count(*) as spans, min(span_id) as first_span from (select doc_id, page, span_id, LONG(sum(brk) over (partition by doc_id, page order by line_no, span_no, span_id rows unbounded preceding)) as para from (select doc_id, page, line_no, span_no, span_id, case when RL(lag(text) over (partition by doc_id, page order by line_no, span_no, span_id), '[.!?]$') then 1 else 0 end as brk from @S s where text is not null) a) b group by doc_id, page, para")
P("o5_11_column_measures", "select doc_id, round(percentile(x + w, 5e-1), 4) as right_edge from @S s group by doc_id", "select doc_id, round(quantile_cont(x + w, 5e-1), 4) as right_edge from @S s group by doc_id")
S("o5_12_heading_levels", "select doc_id, font_size, LONG(dense_rank() over (partition by doc_id order by font_size desc)) as level from (select distinct doc_id, font_size from @S s) t")
P("o5_13_weak_word_confidence", "select doc_id, page, element_at(sort_array(collect_list(confidence)), INT(floor(1e-1 * (count(confidence) - 1))) + 1) as weak from @S s where confidence is not null group by doc_id, page", "select doc_id, page, list_extract(list_sort(list(confidence)), INT(floor(1e-1 * (count(confidence) - 1))) + 1) as weak from @S s where confidence is not null group by doc_id, page")
S("o5_14_mean_confidence", "select doc_id, page, round(sum(confidence * length(text)) / sum(length(text)), 6) as mean_confidence from @S s where confidence is not null and length(text) > 0 group by doc_id, page")
S("o5_15_line_confidence", "select doc_id, page, line_no, round(sum(confidence * length(text)) / sum(length(text)), 6) as mean_confidence from @S s where confidence is not null and length(text) > 0 group by doc_id, page, line_no")
S("o5_17_review_decided", "select node_id, edit_id, undone from (select node_id, edit_id, undone, row_number() over (partition by node_id order by edit_id desc) as r from @J j) t where r = 1")

# 2.6 sorts and top-k
S("o6_2_final_order", "select node_id, doc_id, ordinal from @N n where text like '%Nxd5%' order by doc_id, ordinal, node_id limit 50")
S("o6_5_sort_issues", "select span_id, confidence from @S s where confidence < 5e-1 order by confidence, span_id limit 40")
S("o6_6_worst_regions", "select doc_id, page, round(avg(confidence), 6) as c from @S s where confidence is not null group by doc_id, page having avg(confidence) < 9e-1")
S("o6_8_page_value", "select doc_id, page, round(sum(case when review then 1e0 else 0e0 end) + 5e-1 * sum(case when confidence < 8e-1 then 1e0 else 0e0 end), 4) as value from @S s group by doc_id, page")
S("o6_9_rank_pages", "select doc_id, page, n from (select doc_id, page, count(*) as n from @S s where confidence < 8e-1 group by doc_id, page) t order by n desc, doc_id, page limit 10")
S("o6_10_ranking_top", "select engine, span_id from (select engine, span_id, row_number() over (partition by engine order by confidence, span_id) as r from @S s where confidence is not null) t where r <= 3")

# 2.7 set operations
S("o7_6_merge_layers", "select k, v from (select k, v, row_number() over (partition by k order by layer desc) as r from (select code as k, 1 as layer, STR(count(*)) as v from @L l where code is not null group by code union all select lang as k, 2 as layer, 'label' as v from @A a where lang is not null group by lang) u) t where r = 1")
S("o7_8_merge_into_manifest", "select item_id, max(lang) as lang from (select item_id, lang from @eval_items union all select item_id, lang from @eval_items where item_id < 50) t group by item_id")
S("o7_9_merge_profiles", "select k, max(v) as v from (select * from (values ('bold', 'yes'), ('color', 'no')) a(k, v) union all select * from (values ('color', 'yes')) b(k, v)) t group by k")

# 2.8 and 2.9: counts by words
_TOK_S = "select node_id, explode(SPLIT(lower(text), '[^a-z]+')) as t from @N n where scope in ('all', 'comments') and text <> ''"
_TOK_D = "select node_id, unnest(SPLIT(lower(text), '[^a-z]+')) as t from @N n where scope in ('all', 'comments') and text <> ''"
P("o8_6_emit_prose", f"select t, count(*) as n from ({_TOK_S}) x where t <> '' group by t", f"select t, count(*) as n from ({_TOK_D}) x where t <> '' group by t")
_WORDS = "('the','of','and','der','die','das','und','el','la','de','que','le','les','et','o','a','os','as','do','da')"
P("o9_50_is_move_token", "select t, RL(t, '[a-h][1-8]') as names_square from (select distinct t from (select explode(SPLIT(text, '[ \n]+')) as t from @N n where scope in ('all', 'comments')) x) y where t <> ''", "select t, RL(t, '[a-h][1-8]') as names_square from (select distinct t from (select unnest(SPLIT(text, '[ \n]+')) as t from @N n where scope in ('all', 'comments')) x) y where t <> ''")
P("o9_53_mangled_move_ratio", "select node_id, round(avg(case when RL(t, '^[0-9.]*[KQRBNDTSLCFA]?[a-h]?[1-8]?x?[a-h][1-8][+#!?.,;:)]*$') then 0e0 else 1e0 end), 6) as mangled from (select node_id, explode(SPLIT(text, '[ \n]+')) as t from @N n where scope in ('all', 'comments')) x where RL(t, '[a-h][1-8]') group by node_id", "select node_id, round(avg(case when RL(t, '^[0-9.]*[KQRBNDTSLCFA]?[a-h]?[1-8]?x?[a-h][1-8][+#!?.,;:)]*$') then 0e0 else 1e0 end), 6) as mangled from (select node_id, unnest(SPLIT(text, '[ \n]+')) as t from @N n where scope in ('all', 'comments')) x where RL(t, '[a-h][1-8]') group by node_id")
P("o9_13_repeated_lines", "select doc_id, line, count(*) as n from (select doc_id, trim(l) as line from (select doc_id, explode(split(text, '\n')) as l from @N n where text <> '') e) t where length(line) between 3 and 80 group by doc_id, line having count(*) >= 3", "select doc_id, line, count(*) as n from (select doc_id, trim(unnest(string_split(text, '\n'))) as line from @N n where text <> '') t where length(line) between 3 and 80 group by doc_id, line having count(*) >= 3")
P("o9_12_clean_pdf_text", "select node_id, RR(RR(RR(text, '(?U)(?<=\\\\w)[-‐‑]\\\\s*\n\\\\s*(?=\\\\p{Ll})', ''), '\n', ' '), '[ ]+', ' ') as clean from @N n where scope = 'all'", "select node_id, regexp_replace(replace(regexp_replace(regexp_replace(text, '([\\p{L}\\p{M}\\p{N}_])[-‐‑]\\s*\\n\\s*(\\p{Ll})', '\\1\\2', 'g'), '([\\p{L}\\p{M}\\p{N}_])[-‐‑]\\s*\\n\\s*(\\p{Ll})', '\\1\\2', 'g'), chr(10), ' '), ' +', ' ', 'g') as clean from @N n where scope = 'all'")

# 2.11 and 2.12
S("o11_11_join_wrapped_lines", "select doc_id, page, para, count(*) as lines from (select doc_id, page, LONG(sum(case when RL(text, '^[A-Z]') and RL(back, '[.]$') then 1 else 0 end) over (partition by doc_id, page order by line_no, span_no, span_id rows unbounded preceding)) as para from (select doc_id, page, line_no, span_no, span_id, text, lag(text) over (partition by doc_id, page order by line_no, span_no, span_id) as back from @S s where text is not null) a) b group by doc_id, page, para")
P("o11_27_count_moves", f"select node_id, SIZE(ALL(text, '{SAN}')) as moves from @N n where scope in ('mainline', 'variations')", f"select node_id, SIZE(ALL(text, '{SAN}')) as moves from @N n where scope in ('mainline', 'variations')")
P("o11_28_count_variations", "select node_id, SIZE(ALL(text, '[(]')) as variations from @N n where scope = 'variations'", "select node_id, SIZE(ALL(text, '[(]')) as variations from @N n where scope = 'variations'")
P("o11_33_move_runs", f"with t as (select node_id, posexplode(SPLIT(text, '[ \n]+')) as (pos, c) from @N n where scope = 'comments' and text <> ''), m as (select node_id, pos, pos - row_number() over (partition by node_id order by pos) as island from t where RL(RR(c, '^[0-9]+[.]+', ''), '^{SAN}[!?]*$')) select node_id, min(pos) as first_pos, count(*) as moves from m group by node_id, island", f"with t as (select node_id, unnest(range(len(l)))::int as pos, unnest(l) as c from (select node_id, SPLIT(text, '[ \n]+') as l from @N n where scope = 'comments' and text <> '') s), m as (select node_id, pos, pos - row_number() over (partition by node_id order by pos) as island from t where RL(RR(c, '^[0-9]+[.]+', ''), '^{SAN}[!?]*$')) select node_id, min(pos) as first_pos, count(*) as moves from m group by node_id, island")
P("o11_34_longest_run", f"select node_id, max(SIZE(ALL(text, '{SAN}'))) as moves from @N n where scope = 'comments' group by node_id", f"select node_id, max(SIZE(ALL(text, '{SAN}'))) as moves from @N n where scope = 'comments' group by node_id")
P("o12_6_measure_evidence", "select doc_id, page, round(median(h), 4) as h, count(*) as n from @S s group by doc_id, page", "select doc_id, page, round(median(h), 4) as h, count(*) as n from @S s group by doc_id, page")
S("o12_11_router_order", "select span_id, LONG(row_number() over (partition by doc_id, page order by case engine when '' then 0 when 'glyphnet' then 1 else 2 end, span_id)) as rank from @S s")
S("o12_30_facet_counts", "select lang, suite, count(*) as n from (select distinct item_id, lang, suite from @eval_items) t group by lang, suite")
P("o12_31_manifest_hash", "select SHA(array_join(sort_array(collect_list(SHA(text))), '')) as hash from @eval_items", "select SHA(string_agg(SHA(text), '' order by SHA(text))) as hash from @eval_items")
S("o12_32_manifest_validate", "select item_id, 'short' as problem from @eval_items where length(text) < 60 union all select item_id, 'no lang' from @eval_items where lang is null")

# 2.13 maintenance and 2.14 updates
S("o14_6_scope_names", "select distinct scope from @nodes")
S("o14_11_substitution", "select edit_id, RR(text_before, '^1[.]', '1. ') as t from @J j")
S("o14_12_rules_by_scope", "select scope, locale, count(*) as n from (values ('token','de'),('prefix','de'),('token','es'),('free','en')) r(scope, locale) group by scope, locale")

# 2.15 trees: documents hold nodes in order, scopes are the tags
P("o15_4_plain_text", "select doc_id, array_join(transform(array_sort(collect_list(struct(ordinal, node_id, text))), x -> x.text), ' ') as text from @N n where scope = 'captions' and text is not null group by doc_id", "select doc_id, string_agg(text, ' ' order by ordinal, node_id, text) as text from @N n where scope = 'captions' and text is not null group by doc_id")
S("o15_9_style_chain", "with recursive chain(name, base, depth) as (select name, base, 0 from (values ('title','head'),('head','base'),('base','')) s(name, base) where name = 'title' union all select s.name, s.base, depth + 1 from chain join (values ('title','head'),('head','base'),('base','')) s(name, base) on chain.base = s.name where depth < 10) select name, base, depth from chain")
S("o15_10_resolve_run_props", "select span_id, coalesce(font, case when bold_like then 'BodyB-Roman' else 'BodyA-Roman' end) as font from (select span_id, font, (font_size > 11) as bold_like from @S s) t")
S("o15_11_resolve_paragraph_props", "select doc_id, page, coalesce(max(font), 'BodyA-Roman') as font, coalesce(max(font_size), 10e0) as font_size from @S s group by doc_id, page")
P("o15_20_mainline", _MOVE_ROWS_S, _MOVE_ROWS_D)
S("o15_23_doubtful", "select doc_id, page, count(*) as n from @S s where confidence < 8e-1 group by doc_id, page")
S("o15_24_degradation", "select distinct doc_id, font from @text_spans where font is not null")
S("o15_25_fidelity_measure", "select case when text_before = text_after then 'kept' when length(text_before) = length(text_after) then 'declared' else 'silent' end as loss, count(*) as n from @J j group by 1")
S("o15_27_declared_fidelity", "select round(avg(case when text_before = text_after then 1e0 else 0e0 end), 6) as fidelity from @J j")
S("o15_28_run_support", "select s.span_id, c.ok from @S s join (values ('BodyA-Roman', true), ('BodyB-Roman', false)) c(font, ok) on s.font = c.font")
S("o15_32_carry_over", "select a.edit_id, b.edit_id as kept from @J a join @J b on a.node_id = b.node_id and a.edit_id > b.edit_id and a.text_before = b.text_before")
S("o15_33_corrections", "select edit_id from @J j where text_before <> text_after and not exists (select 1 from @N n where n.node_id = j.node_id and n.scope = 'headers')")
S("o15_34_pending", "select n.node_id from @N n where not exists (select 1 from @J j where j.node_id = n.node_id and not j.undone)")
S("o15_35_manifest_items", "select item_id, suite, lang, INT(length(text)) as chars from @eval_items where length(text) > 100")
P("o15_36_calibration_pairs", "select engine, sort_array(collect_list(confidence)) as confidences from @S s where confidence is not null group by engine", "select engine, list_sort(list(confidence)) as confidences from @S s where confidence is not null group by engine")
P("o15_37_partition_split", "select suite, sort_array(collect_set(item_id)) as ids from @eval_items group by suite", "select suite, list_sort(list(distinct item_id)) as ids from @eval_items group by suite")
