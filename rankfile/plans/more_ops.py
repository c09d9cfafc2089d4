"""Further operators: scans and sinks, board checks, alignment, repair, configuration-like tables."""

from __future__ import annotations

import difflib
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType

from ..functions.board import Board, is_legal_position
from ..functions.dialect import bind
from ..functions.scalars import SAN, TEMPLATES
from ..operators import movetext
from ..operators.graph import components
from ..operators.metrics import edit_distance, lcs_length
from ..operators.tokens import _CORE, _SAN
from ..session import fresh
from ..sources.pgn import PgnSource
from .registry import FENS, MOVES, TEXTS, TOKENS, WORDS, Registry, for_spark

R = Registry()
S, P = R.shared, R.pair

# scans and sinks
S("o1_1_source", "select doc_id, uri, title, kind, size_bytes, content_key from @D d")
S("o1_9_game_units", "select n.node_id, n.scope, f.white, f.black, f.eco, f.year, f.result from @N n join @F f on n.node_id = f.node_id where n.scope in ('headers', 'mainline', 'variations', 'comments')")
S("o1_49_book_pgn", "select h.doc_id, h.node_id, h.text || chr(10) || chr(10) || m.text as pgn from @N h join @N m on h.doc_id = m.doc_id and m.ordinal = h.ordinal + 1 and m.scope = 'mainline' where h.scope = 'headers' and h.text like '[%'")


def _pgn_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games written as a file in the shared folder and read back by the data source."""
    path = fresh(spark, "games")
    spark.sql(for_spark("select h.text || chr(10) || chr(10) || m.text || chr(10) as value from @N h join @N m on h.doc_id = m.doc_id and m.ordinal = h.ordinal + 1 and m.scope = 'mainline' where h.scope = 'headers' and h.text like '[%' and m.text <> ''", sf_dir)).write.mode("overwrite").text(path)
    spark.dataSource.register(PgnSource)
    return spark.read.format("pgn").load(path.removeprefix("file://") + "/part-*").select("white", "black", "eco", "year", "result", F.length("movetext").alias("chars"))


R.plan("o1_13_pgn_source", _pgn_round_trip)
R.plan("o1_42_game_from_pgn", lambda s, d: movetext.moves(s.read.parquet(f"{d}/nodes.parquet")).groupBy("node_id").agg(F.count("*").alias("moves")))

# query pieces
P("o2_49_document_regions", "select node_id, pos as i, part from (select node_id, posexplode(ALL(text, '[(][^()]*[)]')) as (pos, part) from @N n where scope = 'variations' and text <> '') t", "select node_id, unnest(range(len(l)))::int as i, unnest(l) as part from (select node_id, ALL(text, '[(][^()]*[)]') as l from @N n where scope = 'variations' and text <> '') t")

# joins and alignment
R.plan("o3_14_disjoint_set", lambda s, d: components(s.read.parquet(f"{d}/text_spans.parquet").select(F.col("span_id").alias("id")).distinct(), s.sql(for_spark("select a.span_id as a, b.span_id as b from @S a join @S b on a.doc_id = b.doc_id and a.page = b.page and b.line_no = a.line_no", d)).where("a < b")), "select span_id as id, min(span_id) over (partition by doc_id, page, line_no) as label from (select distinct span_id, doc_id, page, line_no from @text_spans) t")
S("o3_16_review_match", "select a.span_id, max(b.span_id) as decided from @S a join @S b on a.doc_id = b.doc_id and a.page = b.page and b.review and a.span_id <> b.span_id and least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) > 0 group by a.span_id")
S("o3_20_facet_candidates", "select doc_id, kind || '|' || coalesce(stratum, '') as k1, kind as k2, '*' as k3 from @D d")
S("o7_1_candidate", "select node_id, 1 as score, (text like '%Nxd5%') as exact, false as collision from @N n where text like '%d5%'")


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(StringType())
def _aligned(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b):
        x, y = (x or "").split(), (y or "").split()
        flags = ["0"] * len(y)
        for i, j, n in difflib.SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks():
            flags[j : j + n] = ["1"] * n
        out.append("".join(flags))
    return pd.Series(out, dtype="object")


def _journal(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/edit_journal.parquet").dropDuplicates(["edit_id"])


R.plan("o12_3_agreement_ratio", lambda s, d: _journal(s, d).select("edit_id", F.round(_ratio("text_before", "text_after"), 6).alias("ratio")))
R.plan("o4_26_pairs_from_alignment", lambda s, d: _journal(s, d).select("edit_id", _aligned("text_before", "text_after").alias("correct")))


@F.pandas_udf(DoubleType())
def _order(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(list(x), list(y)) / len(x) if len(x) else 1.0 for x, y in zip(a, b)], dtype="float64")


def _reading_order(s: SparkSession, d: str) -> DataFrame:
    sp = s.read.parquet(f"{d}/text_spans.parquet").dropDuplicates(["span_id"]).where("y is not null")
    page = sp.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("line_no", "span_no", "span_id"))).alias("a"), F.array_sort(F.collect_list(F.struct("y", "x", "span_id"))).alias("b"))
    return page.select("doc_id", "page", F.round(_order(F.transform("a", lambda r: r["span_id"]), F.transform("b", lambda r: r["span_id"])), 6).alias("accuracy"))


R.plan("o7_5_reading_order_accuracy", _reading_order)

# tokens and text
_WORDCORE = _CORE.replace("(c,", "(x,")
P("o8_4_san_of", f"select x, EX({_WORDCORE}, '^(?:[0-9]+[.]+)?({_SAN}[+#]?)[^0-9A-Za-z]*$', 1) as san from ({WORDS[0]}) w", f"select x, EX({_WORDCORE}, '^(?:[0-9]+[.]+)?({_SAN}[+#]?)[^0-9A-Za-z]*$', 1) as san from ({WORDS[1]}) w")
P("o8_5_as_move", f"select x, EX(x, '^({_SAN})', 1) as move, substr(x, length(EX(x, '^({_SAN})', 1)) + 1) as tail from ({TOKENS[0]}) w", f"select x, EX(x, '^({_SAN})', 1) as move, substr(x, length(EX(x, '^({_SAN})', 1)) + 1) as tail from ({TOKENS[1]}) w")
_DEC = "replace(replace(replace(replace(replace(replace({e}, 'k_', 'K'), 'q_', 'Q'), 'r_', 'R'), 'b_', 'B'), 'n_', 'N'), 'o_', 'O')"
_ENC = "replace(replace(replace(replace(replace(replace(x, 'K', 'k_'), 'Q', 'q_'), 'R', 'r_'), 'B', 'b_'), 'N', 'n_'), 'O', 'o_')"
P("o8_12_decode_token", f"select x, {_DEC.replace('{e}', _ENC)} as decoded from ({MOVES[0]}) m", f"select x, {_DEC.replace('{e}', _ENC)} as decoded from ({MOVES[1]}) m")
P("o9_2_move_tokens", f"select node_id, JOIN(ALL(x, '{SAN}'), ' ') as moves from ({TEXTS[0]}) t", f"select node_id, JOIN(ALL(x, '{SAN}'), ' ') as moves from ({TEXTS[1]}) t")


@F.pandas_udf(LongType())
def _word_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else 0 if x == y else edit_distance(x.split(), y.split()) for x, y in zip(a, b)], dtype="Int64")


def _levenshtein_words(s: SparkSession, d: str) -> DataFrame:
    """Words to replace, add or drop over the whole texts."""
    return s.sql(for_spark("select * from @J j", d)).select("edit_id", _word_distance("text_before", "text_after").alias("d"))


R.plan("o9_36_levenshtein_words", _levenshtein_words)
S("o9_51_is_mangled_move", "select span_id, RL(text, '(^| )[0-9]+[.]+[^ ]*[@0l][^ ]*[a-h][1-8]') as mangled from @S s where text is not null")
S("o9_52_is_unsupported_move", "select a.item_id, (a.lang = 'en' and RL(a.text, '[0-9][.]+[DTSAC][a-h]?x?[a-h][1-8]')) as unsupported from @A a where a.text is not null and a.lang is not null")
P("o9_61_book_lexicon", "select doc_id, count(distinct w) as words from (select doc_id, explode(regexp_extract_all(lower(text), '(?:\\\\p{L}\\\\p{M}*){6,}', 0)) as w from @N n where text <> '') t group by doc_id", "select doc_id, count(distinct w) as words from (select doc_id, unnest(regexp_extract_all(lower(text), '(?:\\p{L}\\p{M}*){6,}')) as w from @N n where text <> '') t group by doc_id")
P("o9_68_from_language", f"select x, translate(g, 'KDTLS', 'KQRBN') as san from (select x, translate(x, 'QRBN', 'DTLS') as g from ({MOVES[0]}) m) t", f"select x, translate(g, 'KDTLS', 'KQRBN') as san from (select x, translate(x, 'QRBN', 'DTLS') as g from ({MOVES[1]}) m) t")
S("o9_81_inline_plain_text", "select node_id, trim(RR(text, '[ \n]+', ' ')) as plain from @N n where scope = 'captions' and text is not null")
R.plan("o9_83_json_object", lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", movetext._make(movetext.first_json_object)(F.concat(F.lit("said: "), "props", F.lit(" and more"))).alias("object")), "select event_id, props as object from @events")
P("o9_84_validate_schema", "select event_id, from_json(props, 'k bigint').k as k from @events", "select event_id, cast(json_extract(props, '$.k') as bigint) as k from @events")

# boards and repair


@F.pandas_udf(BooleanType())
def _legal(x: pd.Series) -> pd.Series:
    return x.map(is_legal_position)


R.plan("o10_20_is_legal_position", lambda s, d: s.sql(for_spark(FENS[0], d)).select("x", _legal("x").alias("legal")))
R.plan("o10_19_validate_fen_legal", lambda s, d: s.sql(for_spark(FENS[0], d)).select("x", F.when(_legal("x"), F.split_part("x", F.lit(" "), F.lit(1))).alias("placement")))

LOCALES = {"en": "KQRBN", "de": "KDTLS", "es": "RDTAC", "fr": "RDTFC", "pt": "RDTBC"}  # fixed values: piece letters


def candidates(token: str) -> list[str]:
    """Readings of a token as SAN: as printed, with misread glyphs mended, and by each language's letters."""
    core = token.rstrip("!?,;.")
    plain = re.sub(r"^[0oO]-[0oO](-[0oO])?", lambda m: "O-O-O" if m.group(1) else "O-O", core).replace(":", "x")
    out = [plain, plain.translate(str.maketrans("l|S", "115"))]
    out += [plain[:1].translate(str.maketrans(v, "KQRBN")) + plain[1:] for v in LOCALES.values()]
    return list(dict.fromkeys(out))


def _repair(batches):
    for batch in batches:
        cols: list[list] = [[], [], [], []]
        for node, text in zip(*(batch.column(i).to_pylist() for i in range(2))):
            board, legal, mended, printed = Board(), 0, 0, 0
            for kind, _, _, t in movetext.tokenize(text):
                if kind not in ("move", "other"):
                    continue
                printed += 1
                found = next(((c, b) for c in candidates(t) for b in [board.play(c)] if b is not None), None)
                if found is None:
                    break
                legal, mended, board = legal + 1, mended + (found[0] != t.rstrip("!?,;.")), found[1]
            for c, x in zip(cols, (node, legal, mended, round(legal / printed, 6) if printed else 1.0)):
                c.append(x)
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.float64()))], names=["node_id", "legal", "mended", "confidence"])


def _repaired(s: SparkSession, d: str) -> DataFrame:
    n = s.read.parquet(f"{d}/nodes.parquet").where("scope = 'mainline' and text <> ''").select("node_id", "text").distinct()
    return n.mapInArrow(_repair, "node_id long, legal int, mended int, confidence double")


R.plan("o11_16_analyze_all", lambda s, d: movetext.moves(s.read.parquet(f"{d}/nodes.parquet")).groupBy("node_id", "path").agg(F.count("*").alias("moves"), F.min("ply").alias("from_ply")))
R.plan("o11_26_pgn_tree", lambda s, d: movetext.moves(s.read.parquet(f"{d}/nodes.parquet")).groupBy("node_id", "depth").agg(F.count("*").alias("moves")))
S("o11_19_apply_edits", "select node_id, substr(text, 1, 10) || '[..]' || substr(text, 21) as edited from @N n where length(text) > 40 and scope = 'comments'")
S("o11_22_enclosing_delimiter", "select node_id, INT(instr(text, '(')) as opens, INT(length(text) - instr(REV(text), ')') + 1) as closes from @N n where scope = 'variations' and text like '%(%)%'")
S("o11_30_decode_cipher", "select edit_id, translate(text_before, '♔♕♖♗♘', 'KQRBN') as decoded from @J j")
S("o11_31_cipher_settled", "select engine, p.p as symbol, count(*) as support from @S s cross join (values ('♔'),('♕'),('♖'),('♗'),('♘')) p(p) where instr(s.text, p.p) > 0 group by engine, p.p having count(*) >= 1")
S("o11_32_cipher_proven", "select p.p as symbol, count(distinct doc_id) as books from @S s cross join (values ('♔'),('♕'),('♖'),('♗'),('♘')) p(p) where instr(s.text, p.p) > 0 group by p.p having count(distinct doc_id) >= 2")

# layout, maintenance, tables of the model
S("o12_12_ink_coverage", "select doc_id, page, round(sum(w * h) / (DBL(max(x + w) - min(x)) * DBL(max(y + h) - min(y))), 5) as covered from @S s group by doc_id, page")
S("o15_19_hashed_ids", "select doc_id, SHA(uri) as id from @D d")
S("o16_1_node_tags", "select distinct scope as tag from @nodes")
S("o16_2_visit", "select scope as tag, count(*) as visited from @N n group by scope")
S("o16_9_audit_log", "select edit_id, batch, applied_at from @J j where applied_at is not null")
