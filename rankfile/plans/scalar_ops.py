"""Scalar operators over the tables."""

from __future__ import annotations

from .registry import CAPTIONS, COMMENTS, FENS, HEADERS, LABELS, LINES, MOVES, TEXTS, TOKENS, WORDS, Registry, _values, both

R = Registry()
_one = R.scalar

# 2.1 and 2.2: move records
for key, name, out in (
    ("o2_29_piece", "piece", "piece"), ("o2_30_is_capture", "is_capture", "capture"), ("o2_31_is_check", "is_check", "is_check"), ("o2_32_is_mate", "is_mate", "mate"),
    ("o2_33_to_square", "to_square", "to_square"), ("o2_34_promotion", "promotion", "promotion"), ("o8_10_is_notation", "is_notation", "notation"), ("o8_8_match_term", "relaxed_term", "variants"),
    ("o9_69_figurine", "figurine", "figurine"), ("o9_74_to_figurine", "figurine", "figurine"), ("o9_67_to_language", "to_german", "german"), ("o9_72_to_language", "to_spanish", "spanish"),
):
    _one(key, MOVES, "x", name, out)
_one("o8_11_encode_case", MOVES, "x", "encode_case", "encoded", spark_args={"up": "$1_"}, up="\\1_")
R.pair("o9_73_from_language", "select x, " + "{g}".replace("{g}", "translate(g, 'KDTLS', 'KQRBN')") + f" as san from (select x, translate(x, 'QRBN', 'DTLS') as g from ({MOVES[0]}) m)", "select x, translate(g, 'KDTLS', 'KQRBN') as san from (select x, translate(x, 'QRBN', 'DTLS') as g from (" + MOVES[1] + ") m)")
R.pair("o9_75_from_figurine", f"select x, translate(translate(x, 'KQRBN', '♔♕♖♗♘'), '♔♕♖♗♘', 'KQRBN') as san from ({MOVES[0]}) m", f"select x, translate(translate(x, 'KQRBN', '♔♕♖♗♘'), '♔♕♖♗♘', 'KQRBN') as san from ({MOVES[1]}) m")
R.pair(
    "o9_70_parse_san",
    f"select x, EX(x, '^([KQRBN])', 1) as piece, EX(x, '^[KQRBN]([a-h]?[1-8]?)x?[a-h][1-8]', 1) as disambiguator, EX(x, '([a-h][1-8])(?:=[QRBN])?[+#]?$', 1) as target, EX(x, '=([QRBN])', 1) as promotion, EX(x, '([+#]?)$', 1) as suffix, (x like 'O-O%') as castling from ({MOVES[0]}) m",
    f"select x, EX(x, '^([KQRBN])', 1) as piece, EX(x, '^[KQRBN]([a-h]?[1-8]?)x?[a-h][1-8]', 1) as disambiguator, EX(x, '([a-h][1-8])(?:=[QRBN])?[+#]?$', 1) as target, EX(x, '=([QRBN])', 1) as promotion, EX(x, '([+#]?)$', 1) as suffix, (x like 'O-O%') as castling from ({MOVES[1]}) m",
)
for key, name, out in (
    ("o11_3_canonical_castling", "canonical_castling", "castling"), ("o11_14_looks_like_move", "looks_like_move", "looks"), ("o9_45_is_chess_notation", "looks_like_move", "notation"),
):
    _one(key, TOKENS, "x", name, out)
for key, cols in (("o11_4_split_numbering", ("move_number", "after_number")), ("o11_5_split_tail", ("core_of_move", "tail_of_move"))):
    from ..functions.dialect import bind
    from ..functions.scalars import TEMPLATES

    sel = ", ".join(f"{bind(TEMPLATES[c], x='x')} as {c}" for c in cols)
    R.pair(key, f"select x, {sel} from ({TOKENS[0]}) t", f"select x, {sel} from ({TOKENS[1]}) t")
_one("o9_48_is_implausible_token", WORDS, "x", "implausible_token", "implausible")
_LETTERS = _values("x, lang", *(f"('{p}', '{g}')" for p in "KQRBN" for g in ("en", "de", "es", "fr", "pt")))
_one("o9_77_piece_letter", _LETTERS, "x, lang", "piece_letter", "letter", lang="lang")
_one("o9_78_piece_for_letter", _values("x, lang", "('D', 'de')", "('S', 'de')", "('T', 'es')", "('C', 'fr')", "('B', 'pt')", "('Q', 'en')"), "x, lang", "piece_for_letter", "piece", lang="lang")
_one("o9_76_render_san", (f"select x, s.style from ({MOVES[0]}) m cross join (values ('letters'), ('figurine')) s(style)", f"select x, s.style from ({MOVES[1]}) m cross join (values ('letters'), ('figurine')) s(style)"), "x, style", "rendered_move", "rendered", style="style")
R.pair("o9_80_render_move", f"select l.lang, m.x, case l.lang when 'de' then translate(m.x, 'QRBN', 'DTLS') when 'es' then translate(m.x, 'KQRBN', 'RDTAC') else m.x end as rendered from ({MOVES[0]}) m cross join (values ('en'), ('de'), ('es')) l(lang)", f"select l.lang, m.x, case l.lang when 'de' then translate(m.x, 'QRBN', 'DTLS') when 'es' then translate(m.x, 'KQRBN', 'RDTAC') else m.x end as rendered from ({MOVES[1]}) m cross join (values ('en'), ('de'), ('es')) l(lang)")
_NAGS = _values("x", *(f"({i})" for i in (1, 2, 3, 4, 5, 6, 10, 13, 14, 15, 16, 17, 18, 19, 99)))
_one("o9_79_nag_symbol", _NAGS, "x", "nag_symbol", "symbol")
_one("o9_33_describe_nag", _NAGS, "x", "nag_name", "name")
_MARKS = (f"select distinct m as x from (select EX(x, '([!?]+)$', 1) as m from ({TOKENS[0].replace('mainline', 'comments')}) t) where m <> ''", f"select distinct m as x from (select EX(x, '([!?]+)$', 1) as m from ({TOKENS[1].replace('mainline', 'comments')}) t) where m <> ''")
_one("o9_31_canonical_code", _MARKS, "x", "nag_code", "code")
_one("o9_32_nags_from_suffix", _MARKS, "x", "nag_code", "nag")
R.shared("o9_34_nags_by_group", "select case when n <= 6 then 'move' when n <= 19 then 'position' else 'other' end as grp, count(*) as n_codes, LONG(min(n)) as first_code from (select INT(x) as n from (values ('1'),('2'),('3'),('4'),('5'),('6'),('10'),('13'),('14'),('15'),('16'),('17'),('18'),('19')) v(x)) t group by 1")
_LOCALES = "(values ('en','KQRBN'),('de','KDTLS'),('es','RDTAC'),('fr','RDTFC'),('pt','RDTBC')) v(locale, letters)"
R.shared("o9_71_available_locales", f"select locale, letters from {_LOCALES}")

# 2.10: boards
for key, name, out in (
    ("o10_1_placement_from_fen", "placement", "placement"), ("o1_12_turn_of", "white_to_move", "white"), ("o10_8_is_valid_fen", "fen_ok", "ok"), ("o10_6_validate_fen", "fen_ok", "ok"),
    ("o10_21_material_summary", "material", "material"),
):
    _one(key, FENS, "x", name, out)
_B64 = "select x as fen, " + TEMPLATES["board64"].replace("{x}", "split_part(x, ' ', 1)") + f" as b from ({FENS[0]}) f"
R.shared("o10_9_board_squares", f"select fen, b as board64 from ({_B64}) t")
R.shared("o10_10_count_of_piece", "select fen, p.piece, " + bind(TEMPLATES["piece_count"], x="b", p="p.piece") + f" as n from ({_B64}) t cross join (values ('K'),('Q'),('P'),('k'),('p')) p(piece)")
R.shared("o10_11_piece_at", f"select fen, i.i as idx, substr(b, INT(i.i) + 1, 1) as piece from ({_B64}) t cross join (values (0),(4),(27),(63)) i(i)")
R.shared("o10_15_rotate_placement", f"select fen, REV(b) as rotated from ({_B64}) t")
R.shared("o10_17_matrix_from_placement", f"select fen, substr(b, 1, 8) as r8, substr(b, 9, 8) as r7, substr(b, 17, 8) as r6, substr(b, 25, 8) as r5, substr(b, 33, 8) as r4, substr(b, 41, 8) as r3, substr(b, 49, 8) as r2, substr(b, 57, 8) as r1 from ({_B64}) t")
_RUN = " || '/' || ".join(bind(TEMPLATES["run_length"], x=f"substr(b, {1 + 8 * k}, 8)") for k in range(8))
R.shared("o10_18_placement_from_matrix", f"select fen, {_RUN} as placement from ({_B64}) t")
R.shared("o10_7_position_problems", f"select fen, (length(b) <> 64) as bad_size, (length(b) - length(replace(b, 'K', '')) <> 1) as white_king, (length(b) - length(replace(b, 'k', '')) <> 1) as black_king, (RL(substr(b, 1, 8) || substr(b, 57, 8), '[pP]')) as pawn_on_edge, (length(b) - length(replace(b, 'P', '')) > 8) as white_pawns from ({_B64}) t")
R.shared("o10_5_parse_fen", "select x as fen, " + ", ".join(f"{bind(TEMPLATES[n], x='x')} as {n}" for n in ("placement", "fen_side", "fen_castling", "fen_ep", "fen_half", "fen_full")) + f" from ({FENS[0]}) f")
R.shared("o10_3_pack_placement", f"select fen, upper(translate(REV(b), '.PNBRQKpnbrqk', '0123456789ABC')) as packed from ({_B64}) t")
R.shared("o10_4_unpack_placement", f"select fen, REV(translate(packed, '0123456789ABC', '.PNBRQKpnbrqk')) as board64 from (select fen, upper(translate(REV(b), '.PNBRQKpnbrqk', '0123456789ABC')) as packed from ({_B64}) t) u")
R.shared("o10_16_plausibility", f"select fen, INT(length(RR(substr(b, 33, 32), '[^A-Z]', '')) + length(RR(substr(b, 1, 32), '[^a-z]', '')) - length(RR(substr(b, 1, 32), '[^A-Z]', '')) - length(RR(substr(b, 33, 32), '[^a-z]', ''))) as score from ({_B64}) t")
R.shared("o6_12_rank_orientations", f"select fen, turn, LONG(row_number() over (partition by fen order by score desc, turn)) as rank from (select fen, 0 as turn, length(RR(substr(b, 33, 32), '[^A-Z]', '')) as score from ({_B64}) t union all select fen, 180 as turn, length(RR(substr(b, 1, 32), '[^A-Z]', '')) as score from ({_B64}) u) v")
_SQ = "select x, f.f || r.r as s from (values (1)) one(x) cross join (values ('a'),('b'),('c'),('d'),('e'),('f'),('g'),('h')) f(f) cross join (values ('1'),('2'),('3'),('4'),('5'),('6'),('7'),('8')) r(r)"
R.shared("o10_12_square_index", f"select s, {bind(TEMPLATES['square_index'], x='s')} as idx from ({_SQ}) t")
R.shared("o10_13_square_name", f"select idx, {bind(TEMPLATES['square_name'], x='idx')} as s from (select {bind(TEMPLATES['square_index'], x='s')} as idx from ({_SQ}) t) u")
_one("o10_14_is_square_name", _values("x", "('e4')", "('i9')", "('a1')", "('')", "('h8x')"), "x", "is_square_name", "ok")

# headers, dates, results
_one("o1_11_year", HEADERS, "node_id", "header_year", "year", x="EX(x, '[[]Date \"([^\"]*)\"', 1)")
_one("o9_14_normalize_pgn_date", both("select distinct EX(text, '[[]Date \"([^\"]*)\"', 1) as x from @nodes where scope = 'headers' and text like '[%' union select x from (values ('1999'), ('1999-3'), ('1999-03-07'), ('7.3.1999'), (''), ('soon')) v(x)"), "x", "pgn_date", "pgn")
_one("o9_15_normalize_pgn_result", both("select distinct result as x from @facets"), "x", "pgn_result", "result")
_one("o9_16_extract_headers", HEADERS, "node_id", "header", "white", tag="'White'")
_one("o15_21_header_by_name", HEADERS, "node_id", "header", "event", tag="'Event'")
_one("o9_18_validate_headers", HEADERS, "node_id", "header_problems", "problems")
_one("o9_22_segment_title", HEADERS, "node_id", "segment_title", "title", i="node_id")
_one("o9_29_start_fen", HEADERS, "node_id", "start_fen", "fen")
R.shared("o9_19_render_header_block", "select node_id, '[White \"' || white || '\"]' || chr(10) || '[Black \"' || black || '\"]' || chr(10) || '[Result \"' || result || '\"]' as block from @F f")
R.shared("o9_17_merge_headers", "select node_id, coalesce(nullif(white, ''), '?') as white, coalesce(nullif(eco, ''), '?') as eco, case when year > 0 then STR(year) || '.??.??' else '????.??.??' end as date_tag from @F f")
R.pair("o15_22_headers_as_tuples", "select node_id, pos as i, pair from (select node_id, posexplode(ALL(x, '[[][A-Za-z]+ \"[^\"]*\"[]]')) as (pos, pair) from (" + HEADERS[0] + ") h)", "select node_id, cast(unnest(range(len(l))) as int) as i, unnest(l) as pair from (select node_id, ALL(x, '[[][A-Za-z]+ \"[^\"]*\"[]]') as l from (" + HEADERS[1] + ") h) t")

# comments, captions, marks
for key, name, out in (("o1_43_split_move_commands", "commands", "commands"), ("o9_24_strip_annotations", "without_commands", "prose"), ("o1_44_escape_pgn_comment", "escaped_comment", "safe"), ("o9_27_find_diagram_marks", "diagram_marks", "marks"), ("o9_30_map_book_symbols", "book_symbols", "mapped")):
    _one(key, COMMENTS, "node_id", name, out)
_CMD = both("select distinct text as x from @nodes where scope in ('comments', 'captions') and text <> '' union select x from (values ('[%clk 0:10:00] good [%cal Ge2e4,Rd7d5] plan'), ('plain'), ('[%csl Gd4]'), ('a {b} [#] c'), ('')) v(x)")
_one("o9_23_parse_annotations", _CMD, "x", "commands", "commands")
R.shared("o9_25_format_annotations", f"select x, JOIN(ALL(x, '[[]%(?:cal|csl) [^]]*[]]'), ' ') as canonical from ({_CMD[0]}) t")
R.shared("o9_26_apply_annotations", f"select x, trim({bind(TEMPLATES['without_commands'], x='x')} || ' [%csl Ge4]') as annotated from ({_CMD[0]}) t")
_one("o9_28_normalize_diagram_marks", _CMD, "x", "normal_diagram_marks", "marked", mark="{[#]}")
for key, name, out in (("o9_4_parse_stipulation", "mate_in", "moves"), ("o9_8_after_move", "after_move", "number")):
    _one(key, CAPTIONS if key != "o9_8_after_move" else TEXTS, "node_id", name, out)
_one("o9_7_move_start", both("select distinct node_id, text as x from @nodes where scope in ('mainline', 'variations')"), "node_id", "starts_with_move", "number")

# text
for key, name, out in (("o9_10_fingerprint", "fingerprint", "print"), ("o9_11_is_page_number", "is_page_number", "page_number"), ("o9_82_fold_ligatures", "folded_ligatures", "folded"), ("o9_57_script_profile", "cyrillic_chars", "cyrillic"), ("o9_56_modelled_script_share", "cyrillic_share", "share"), ("o9_58_implausible_char_ratio", "odd_char_ratio", "ratio")):
    _one(key, LINES, "span_id", name, out)
R.pair("o9_44_tokenize", "select node_id, SIZE(" + TEMPLATES["word_tokens"].replace("{x}", "x") + f") as n from ({TEXTS[0]}) t", "select node_id, SIZE(" + TEMPLATES["word_tokens"].replace("{x}", "x") + f") as n from ({TEXTS[1]}) t")
_one("o9_59_normalise_lang", LABELS, "x", "language_code", "code")
_one("o2_17_locate", TEXTS, "node_id", "locate", "at", t="'Initiative'")
_one("o2_47_match_context", TEXTS, "node_id", "snippet", "context", s="greatest(instr(x, '.') + 20, 1)", n="80")
_one("o12_29_partition_for", both("select distinct STR(item_id) as x from @eval_items"), "x", "partition", "part")
_one("o15_18_ulid_from_string", both("select distinct node_ulid as x from @nodes"), "x", "ulid_ok", "ok")
_DIGITS = " + ".join(f"LONG(instr('0123456789ABCDEFGHJKMNPQRSTVWXYZ', substr(node_ulid, {i + 1}, 1)) - 1) * {32 ** (9 - i)}" for i in range(10))
R.shared("o15_16_ulid_timestamp_ms", f"select distinct node_id, LONG({_DIGITS}) as ms from @nodes where node_ulid is not null")
R.pair("o15_17_ulid_created_at", f"select distinct node_id, timestamp_millis(LONG({_DIGITS})) as created_at from @nodes where node_ulid is not null", f"select distinct node_id, make_timestamp(LONG({_DIGITS}) * 1000) as created_at from @nodes where node_ulid is not null")
R.shared("o11_25_child_label", "select p.p, i.i, case when RL(p.p, '^[A-Z]$') then p.p || STR(i.i) else p.p || '.' || STR(i.i) end as child from (values ('A'),('A1'),('B2.3')) p(p) cross join (values (1),(2)) i(i)")

# units, colours, geometry
_one("o15_13_measure_to_points", _values("v, u", "(1e0, 'in')", "(10e0, 'mm')", "(25e-1, 'cm')", "(12e0, 'pt')", "(16e0, 'px')"), "v, u", "points", "points", x="v", v="DBL(v)", u="u")
R.shared("o15_14_color_from_hex", "select x, HEXINT(substr(x, 2, 2)) as r, HEXINT(substr(x, 4, 2)) as g, HEXINT(substr(x, 6, 2)) as b from (values ('#FF8000'),('#000000'),('#0A0B0C')) t(x)")
R.pair("o15_15_color_to_hex", "select r, g, b, '#' || lpad(hex(r), 2, '0') || lpad(hex(g), 2, '0') || lpad(hex(b), 2, '0') as x from (values (255, 128, 0), (0, 0, 0), (10, 11, 12)) t(r, g, b)", "select r, g, b, '#' || lpad(to_hex(r), 2, '0') || lpad(to_hex(g), 2, '0') || lpad(to_hex(b), 2, '0') as x from (values (255, 128, 0), (0, 0, 0), (10, 11, 12)) t(r, g, b)")
_PAIRS = "select a.span_id as s1, b.span_id as s2, a.x as ax, a.y as ay, a.x + a.w as ax2, a.y + a.h as ay2, b.x as bx, b.y as by_, b.x + b.w as bx2, b.y + b.h as by2, a.w as aw, a.h as ah, b.w as bw, b.h as bh from @S a join @S b on a.doc_id = b.doc_id and a.page = b.page and a.line_no = b.line_no and a.span_id < b.span_id"
_IX, _IY = "greatest(0.0, least(ax2, bx2) - greatest(ax, bx))", "greatest(0.0, least(ay2, by2) - greatest(ay, by_))"
R.shared("o3_11_iou", f"select s1, s2, round({_IX} * {_IY} / (aw * ah + bw * bh - {_IX} * {_IY}), 6) as iou from ({_PAIRS}) p")
R.shared("o12_19_bbox_iou", f"select s1, s2, round({_IX} * {_IY} / (aw * ah + bw * bh - {_IX} * {_IY}), 6) as iou from ({_PAIRS}) p")
R.shared("o12_20_bbox_union", f"select s1, s2, least(ax, bx) as x, least(ay, by_) as y, round(greatest(ax2, bx2) - least(ax, bx), 6) as w, round(greatest(ay2, by2) - least(ay, by_), 6) as h from ({_PAIRS}) p")
R.shared("o12_21_coverage_by", f"select s1, s2, round({_IX} * {_IY} / (aw * ah), 6) as covered from ({_PAIRS}) p")
# a zero width divides as in DuckDB (0 / 0 is NaN); Spark's floor gives a long, so what no long holds isn't rounded by it
_BY_NARROWER = f"coalesce(try_divide({_IX}, least(aw, bw)), {_IX} * power(least(aw, bw), -1))"
R.pair(
    "o12_22_horizontal_overlap",
    f"select s1, s2, case when abs(v) < 1e12 then round(v, 6) else (v * 1e6 + 5e-1) / 1e6 end as share from (select s1, s2, {_BY_NARROWER} as v from ({_PAIRS}) p) q",
    f"select s1, s2, round({_IX} / least(aw, bw), 6) as share from ({_PAIRS}) p",
)
R.shared("o12_23_vertical_overlap", f"select s1, s2, round({_IY} / least(ah, bh), 6) as share from ({_PAIRS}) p")
R.shared("o12_28_page_to_pixels", "select span_id, round(x * 300 / 72, 4) as px, round(y * 300 / 72, 4) as py, round(w * 300 / 72, 4) as pw, round(h * 300 / 72, 4) as ph from @S s")
R.shared("o12_24_affine_apply", "select span_id, round(2 * x + 0.5 * y + 10, 6) as x2, round(-0.5 * x + y - 3, 6) as y2 from @S s")
R.shared("o12_27_affine_rect", "select span_id, round(least(2 * x, 2 * (x + w)), 6) as x1, round(least(700 - y, 700 - y - h), 6) as y1, round(2 * w, 6) as w2, round(h, 6) as h2 from @S s")
_MAT = "(values (2.0, 0.5, -0.5, 1.0, 10.0, -3.0), (1.0, 0.0, 0.0, 1.0, 5.0, 6.0)) m(a, b, c, d, e, f)"
R.shared("o12_25_affine_compose", f"select DBL(m.a * n.a + m.b * n.c) as a, DBL(m.a * n.b + m.b * n.d) as b, DBL(m.c * n.a + m.d * n.c) as c, DBL(m.c * n.b + m.d * n.d) as d, DBL(m.e * n.a + m.f * n.c + n.e) as e, DBL(m.e * n.b + m.f * n.d + n.f) as f from {_MAT} cross join {_MAT.replace(' m(', ' n(')}")
R.shared("o12_26_affine_invert", f"select round(DBL(d) / DBL(a * d - b * c), 6) as a, round(0e0 - DBL(b) / DBL(a * d - b * c), 6) as b, round(0e0 - DBL(c) / DBL(a * d - b * c), 6) as c, round(DBL(a) / DBL(a * d - b * c), 6) as d from {_MAT}")

# confidence
_one("o9_87_apply_verdict", _values("v, verdict, l", "(5e-1, 'inconsistent', 9e-1)", "(95e-2, 'inconsistent', 9e-1)", "(5e-1, 'consistent', 9e-1)", "(7e-1, 'uncertain', 1e-1)"), "v, verdict, l", "lowered_confidence", "confidence", x="v", v="DBL(v)", verdict="verdict", l="DBL(l)", floor="0.9")
_one("o9_43_severity", both("select distinct span_id, confidence from @text_spans where confidence is not null"), "span_id", "severity", "severity", x="confidence", cer="(1 - confidence) / 10", conf="confidence")
_one("o12_5_decide", both("select distinct span_id, confidence from @text_spans"), "span_id", "decision", "decision", x="confidence", conf="confidence")
R.shared("o12_4_engine_calibration", "select span_id, round(greatest(0.0, power(confidence, 1.3)), 6) as calibrated from @S s where confidence is not null")
R.shared("o12_10_route_for", "select span_id, case when engine = '' then 'layer' when confidence < 0.5 then 'strong' when RL(text, '[Ѐ-ӿ]') then 'cyrillic' else 'fast' end as route from @S s where text is not null")
R.shared("o6_7_review_risk", "select span_id, round((case when review then 1e0 else 5e-1 end) + 3e-1 * (1 - coalesce(confidence, 0e0)), 4) as risk from @S s")
R.shared("o1_27_page_text_from_ocr", "select span_id, round(x * 72 / 300, 4) as x, round(y * 72 / 300, 4) as y, text from @S s")
R.shared("o4_3_throughput_mb_s", "select doc_id, round(size_bytes / 1e6 / 25e-1, 6) as mb_s from @D d where size_bytes is not null")
R.shared("o13_16_progress_fraction", "select doc_id, round(case when size_bytes > 0 then DBL(byte_cursor) / size_bytes else 0.0 end, 6) as fraction from @D d")
_COLLAPSED = "trim(RR({x}, '(?U)\\\\s+', ' '))"
R.pair("o9_37_character_error_rate", f"select edit_id, round(case when a = '' then case when b = '' then 0e0 when b <> '' then 1e0 end else DBL(levenshtein(a, b)) / length(a) end, 6) as cer from (select edit_id, {bind(_COLLAPSED, x='text_before')} as a, {bind(_COLLAPSED, x='text_after')} as b from @J j) t where a is not null", None)
R.shared("o9_35_levenshtein", "select a.x as a, b.x as b, LONG(levenshtein(a.x, b.x)) as d from (select distinct white as x from @facets where RL(white, '^[A-Z][a-z]+, [A-Z][.]$')) a join (select distinct white as x from @facets where RL(white, '^[A-Z][a-z]+, [A-Z][a-z]+$')) b on substr(a.x, 1, 3) = substr(b.x, 1, 3)")
R.shared("o15_12_merged_props", "select span_id, coalesce(font, 'BodyA-Roman') as font, coalesce(font_size, 10.0) as font_size from @S s")
R.shared("o15_29_is_specified", "select span_id, (font is not null) as font_set, (confidence is not null) as confidence_set from @S s")
