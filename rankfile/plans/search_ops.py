"""Queries on the stored index, with SQL that reads the texts and moves by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import SAN
from ..operators import index as store
from ..operators.index import opened
from ..operators.positions import any_of, find_position, hash_number
from ..operators.predicates import MaterialSignature, MoveQuery, PositionPattern, annotation, compiled, move_glob, rank_squares, squares
from ..operators.search import Query, bm25, encoded, matching, parse_boolean, search, split_query, with_snippets
from ..operators.tokens import TOKENS, tokens
from ..session import fresh
from .registry import Registry, for_spark

R = Registry()
E4, D4 = "rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR", "rnbqkbnr/pppppppp/8/8/3P4/8/PPP1PPPP/RNBQKBNR"
_EDGE = "[^0-9a-zà-ɏѐ-ӿ]"


def _word(w: str, text: str = "n.text") -> str:
    return f"regexp_matches(lower({text}), '(^|{_EDGE}){w}({_EDGE}|$)')"


def _move(san: str, text: str = "n.text") -> str:
    return f"regexp_matches({text}, '(^|\\s)[(\\[{{<«\"]*(\\d+\\.+)?{san}[+#]?[^0-9A-Za-zÀ-ɏЀ-ӿ\\s]*(\\s|$)')"


_LIB = "select n.node_id, n.doc_id, n.ordinal from @N n join @D d on n.doc_id = d.doc_id left join @F f on n.node_id = f.node_id where "


def _ask(q: Query, *columns: str):
    return lambda spark, sf_dir: search(opened(spark, sf_dir), q).select(*(columns or ("node_id", "doc_id", "ordinal")))


R.plan("o2_2_search", _ask(Query(text='queen "dark squares"', scope="all", limit=None)), _LIB + f"n.scope = 'all' and {_word('queen')} and {_word('dark' + _EDGE + '+squares')}")
R.plan("o2_21_user_text", _ask(Query(text="knight NOT queen OR Nxd5", limit=None)), _LIB + f"(({_word('knight')} and not {_word('queen')}) or {_move('Nxd5')})")
R.plan("o2_1_query", _ask(Query(player="mitri", eco="B", year_min=1900, year_max=1999, limit=None)), _LIB + "(lower(f.white) like '%mitri%' or lower(f.black) like '%mitri%') and regexp_matches(f.eco, '^(?:B)') and f.year between 1900 and 1999")
_PAGE = ("node_id", "doc_id", "ordinal", "total", "truncated")
R.plan("o6_3_result_page", _ask(Query(scope="captions", offset=10, limit=10), *_PAGE), "select *, total > 20 as truncated from (select node_id, doc_id, ordinal, count(*) over () as total from (select distinct n.node_id, n.doc_id, n.ordinal from @nodes n join @library d on n.doc_id = d.doc_id where n.scope = 'captions') x) t order by doc_id, ordinal, node_id limit 10 offset 10")


def _pieces(s: SparkSession, d: str) -> DataFrame:
    """The match expression of a typed query: its pieces with their tokens."""
    rows = []

    def walk(t: tuple, path: str) -> None:
        if t[0] in ("and", "or", "not"):
            rows.append((path, t[0], ""))
            walk(t[1], path + "0")
            walk(t[2], path + "1")
        else:
            rows.append((path, t[0], " ".join([t[1]] if isinstance(t[1], str) else t[1])))

    walk(encoded(s, parse_boolean('Nxd5 OR "Black Queen" AND rook NOT O-O')), "r")
    return s.createDataFrame(rows, "path string, op string, tokens string")


R.plan("o2_23_fts_expression", _pieces, "select * from (values ('r', 'or', ''), ('r0', 'term', 'n_xd5 n_xd5+ n_xd5#'), ('r1', 'and', ''), ('r10', 'phrase', 'black queen'), ('r11', 'not', ''), ('r110', 'term', 'rook'), ('r111', 'term', 'o_-o_ o_-o_+ o_-o_#')) t(path, op, tokens)")
R.plan("o2_22_split_query", lambda s, d: s.createDataFrame(list(enumerate(f"{k}:{x}" for k, x in split_query('a "b c" NOT d OR "e f'))), "i int, piece string"), "select * from (values (0, 'word:a'), (1, 'phrase:b c'), (2, 'operator:NOT'), (3, 'word:d'), (4, 'operator:OR'), (5, 'phrase:e f')) t(i, piece)")


# moves and boards
_ROWS = f"(select node_id, unnest(range(1, len(l) + 1))::int as ply, unnest(l) as san from (select node_id, regexp_extract_all(text, '{SAN}') as l from @N n where scope = 'mainline' and text <> '') s)"


def _moves(q: MoveQuery):
    return lambda s, d: opened(s, d).table("moves").where(q.column()).select("node_id", "ply", "san").distinct()


R.plan("o2_25_search_moves", _moves(MoveQuery(piece="R", is_capture=True, min_ply=10, max_ply=40, turn=True, mainline_only=True)), f"select distinct * from {_ROWS} m where san like 'R%x%' and ply between 10 and 40 and ply % 2 = 1")
R.plan("o2_28_move_query", _moves(MoveQuery(pattern="Q*", to_square="d5", is_check=True, is_mate=False, turn=False, mainline_only=True)), f"select distinct * from {_ROWS} m where regexp_matches(san, '^Q.*d5[+]$') and ply % 2 = 0")
R.plan("o2_35_compile_move_pattern", _moves(MoveQuery(pattern="N*d5", mainline_only=True)), f"select distinct * from {_ROWS} m where regexp_matches(san, '^N.*d5[+#]?$')")
R.plan("o2_37_annotation_query", lambda s, d: opened(s, d).table("moves").where(annotation("?").column()).select("node_id", "i", "san").distinct())
R.plan("o2_12_filter_move", _ask(Query(move="N*xd5", limit=None), "node_id"), "select distinct n.node_id from @nodes n join @library d on n.doc_id = d.doc_id where len(list_filter(string_split_regex(n.text, '\\s+'), lambda c: regexp_matches(regexp_replace(regexp_replace(c, '^\\d+\\.+', ''), '[!?.,;:)]+$', ''), '^N.*xd5[+#]?$'))) > 0")
R.plan("o2_36_compile_pattern", lambda s, d: opened(s, d).table("nodes").where("scope = 'captions'").where(F.col("text").rlike(compiled(r"\b(?:Kd|Rg)[1-8]\b"))).select("node_id").distinct(), "select distinct node_id from @nodes where scope = 'captions' and regexp_matches(text, '(^|[^0-9A-Za-z_])(Kd|Rg)[1-8]([^0-9A-Za-z_]|$)')")

_FIRST = f"(select distinct node_id, doc_id, regexp_extract(text, '^1[.] ?({SAN})', 1) as san from @nodes where scope = 'mainline' and text <> '')"
_PUSH = PositionPattern(placement="rnbqkbnr/pppppppp/8/8/*/8/*/RNBQKBNR", turn=False, requires={"e1": "K"}, forbids={"e2": "p"})


def _fen(pos: DataFrame) -> DataFrame:
    return pos.withColumn("fen", F.concat_ws(" ", "placement", F.when(F.col("white_to_move"), "w").otherwise("b")))


R.plan("o2_13_filter_board", _ask(Query(position_pattern=_PUSH, limit=None), "node_id"), f"select distinct f.node_id from {_FIRST} f join @library d on f.doc_id = d.doc_id where regexp_matches(san, '^[a-h]4$')")
R.plan("o2_26_search_positions", lambda s, d: _fen(opened(s, d).table("positions")).where(_PUSH.column("fen")).select("node_id", "ply").distinct(), f"select node_id, 1 as ply from {_FIRST} f where regexp_matches(san, '^[a-h]4$')")
R.plan("o2_39_position_matches", lambda s, d: _fen(opened(s, d).table("positions")).select("node_id", "ply", PositionPattern(placement="rnbqkbnr/pppppppp/8/8/4P3/8/PPPP?PPP/RNBQKBNR").column("fen").alias("fits")).where("ply = 1").distinct(), f"select node_id, 1 as ply, (san = 'e4') as fits from {_FIRST} f where regexp_matches(san, '^([a-h][34]|N[acfh]3)$')")
R.plan("o2_14_placements_of", lambda s, d: opened(s, d).table("positions").groupBy("node_id").agg(F.count("*").alias("placements"), F.countDistinct("placement").alias("different"), F.max("ply").alias("last_ply")))
R.plan("o2_42_material_matches", lambda s, d: _fen(opened(s, d).table("positions")).where(MaterialSignature.parse("KQRRBBNNPPPPPPP v KQRRBBNNPPPPPPP").column("fen")).select("node_id", "ply").distinct())
R.plan("o2_43_opposite_bishops", lambda s, d: _fen(opened(s, d).table("positions")).where(MaterialSignature(opposite_bishops=True, max_pawns=16).column("fen")).select("node_id", "ply").distinct())
R.plan("o2_41_material_signature", lambda s, d: s.createDataFrame([(x, m.white, m.black) for x in ("KRPvKR", "k v K", "NBK vs. K") for m in [MaterialSignature.parse(x)]], "spec string, white string, black string"), "select * from (values ('KRPvKR', 'KRP', 'KR'), ('k v K', 'K', 'K'), ('NBK vs. K', 'KBN', 'K')) t(spec, white, black)")
R.plan("o2_40_expand_rank", lambda s, d: s.createDataFrame([(x, rank_squares(x)) for x in ("8", "r?b*", "p1P5", "9", "pp")], "rank string, squares string"), "select * from (values ('8', '........'), ('r?b*', 'r?b?????'), ('p1P5', 'p.P.....'), ('9', null), ('pp', null)) t(rank, squares)")
_FOUND = ("node_id", "doc_id", "ply", "exact")
R.plan("o3_5_position_lookup", lambda s, d: find_position(opened(s, d).keyed("positions", "zobrist", [hash_number(E4)]), E4).select(*_FOUND), f"select node_id, doc_id, 1 as ply, true as exact from {_FIRST} f where san = 'e4'")
R.plan("o3_6_any_of", lambda s, d: any_of(opened(s, d).keyed("positions", "zobrist", [hash_number(E4), hash_number(D4)]), [E4, D4]).groupBy("placement").agg(F.countDistinct("node_id").alias("games"), F.countDistinct("doc_id").alias("documents")), f"select case san when 'e4' then '{E4}' else '{D4}' end as placement, count(distinct node_id) as games, count(distinct doc_id) as documents from {_FIRST} f where san in ('e4', 'd4') group by san")
R.plan("o3_7_documents_containing", lambda s, d: find_position(opened(s, d).keyed("positions", "zobrist", [hash_number(D4)]), D4).where("exact").select("doc_id").distinct(), f"select distinct doc_id from {_FIRST} f where san = 'd4'")
R.plan("o6_4_exact_first", lambda s, d: find_position(opened(s, d).keyed("positions", "zobrist", [hash_number(D4)]), D4).select(*_FOUND).limit(30), f"select node_id, doc_id, 1 as ply, true as exact from {_FIRST} f where san = 'd4' order by doc_id, node_id limit 30")
R.plan("o4_9_position_count", lambda s, d: opened(s, d).table("positions").agg(F.count("*").alias("n")))
R.plan("o1_15_pgn_positions", lambda s, d: opened(s, d).table("positions").select("node_id", "doc_id", "ply", "placement", "white_to_move", "zobrist"))
R.plan("o2_48_build_move_index", lambda s, d: opened(s, d).table("moves").select("node_id", "i", "path", "ply", "san", F.array_join("nags", " ").alias("nags"), "before", "after"))
R.plan("o10_2_hash_placement", lambda s, d: opened(s, d).table("positions").select("placement", "zobrist").distinct().withColumn("squares", squares("placement")).where(F.col("zobrist") != F.conv(F.substring(F.sha2("squares", 256), 1, 15), 16, 10).cast("long")).select("placement"), "select '' as placement where false")


# full text
def _rounded(df: DataFrame) -> DataFrame:
    return df.select("node_id", (F.floor(F.col("score") * 1e4 + 0.5) / 1e4).alias("score"))


def _scores(s: SparkSession, d: str, text: str) -> DataFrame:
    index = opened(s, d)
    tree = encoded(s, parse_boolean(text))
    return _rounded(bm25(index, tree).join(matching(index, tree), "node_id", "left_semi"))


def _bm25_sql(counts: dict[str, str], every: bool) -> str:
    """counts: name of a form and the SQL that counts it in a text. Only the lengths come from the tokens."""
    sums = " + ".join(f"coalesce(greatest(1e-6, ln((docs - df_{k} + 5e-1) / (df_{k} + 5e-1))) * c_{k} * 22e-1 / (c_{k} + 12e-1 * (25e-2 + 75e-2 * n / avglen)), 0e0)" for k in counts)
    return (
        f"with base as (select node_id, len({TOKENS.replace('{x}', 'text')}) as n, {', '.join(f'{q} as c_{k}' for k, q in counts.items())} from (select distinct node_id, text from @nodes where text is not null and text <> '') d), "
        f"st as (select count(*) filter (n > 0) as docs, avg(n) filter (n > 0) as avglen, {', '.join(f'count(*) filter (c_{k} > 0) as df_{k}' for k in counts)} from base) "
        f"select node_id, floor(({sums}) * 1e4 + 5e-1) / 1e4 as score from base cross join st where {(' and ' if every else ' or ').join(f'c_{k} > 0' for k in counts)}"
    )


def _count(w: str) -> str:
    return f"len(list_filter(string_split_regex(lower(text), '{_EDGE}+'), lambda t: t = '{w}'))"


R.plan("o8_13_bm25", lambda s, d: _scores(s, d, "queen initiative"), _bm25_sql({"queen": _count("queen"), "initiative": _count("initiative")}, True))
R.plan("o6_1_fts_top_k", lambda s, d: _scores(s, d, "Rook OR bishop").orderBy(F.desc("score"), "node_id").limit(100), _bm25_sql({"rook": _count("rook"), "bishop": _count("bishop")}, False) + " order by score desc, node_id limit 100")


def _token_lists(s: SparkSession, d: str) -> DataFrame:
    n = s.read.parquet(f"{d}/nodes.parquet").where("scope in ('all', 'comments', 'mainline') and text <> ''").select("node_id", "text").distinct()
    return n.select("node_id", F.array_join(tokens("text"), " ").alias("tokens"))


R.plan("o8_3_emit", _token_lists, f"select node_id, array_to_string({TOKENS.replace('{x}', 'text')}, ' ') as tokens from (select distinct node_id, text from @nodes where scope in ('all', 'comments', 'mainline') and text <> '') d")
R.plan("o8_9_query_tokens", lambda s, d: s.sql("select '12.Nxd5!? and the Queen' as text").select(F.array_join(tokens("text"), " ").alias("tokens")), "select '12.n_xd5 n_xd5 and the queen' as tokens")
_CAPTIONS = "select distinct node_id, text from @nodes where scope = 'captions' and text <> ''"
R.plan("o8_1_tokens", lambda s, d: s.sql(for_spark(_CAPTIONS, d)).select("node_id", F.posexplode(tokens("text")).alias("pos", "token")))
R.plan("o8_2_encode", lambda s, d: s.sql(for_spark(_CAPTIONS, d)).select("node_id", F.array_join(tokens("text"), " ").alias("encoded")), f"select node_id, array_to_string({TOKENS.replace('{x}', 'text')}, ' ') as encoded from ({_CAPTIONS}) c")
R.plan("o8_7_match_phrase", lambda s, d: matching(opened(s, d), encoded(s, parse_boolean('"the dark squares"'))), f"select distinct node_id from @nodes where {_word(_EDGE.join(['the+', 'dark+', 'squares']).replace('+', '', 3).replace(_EDGE, _EDGE + '+'), 'text')}")
R.plan("o2_15_move_prefilter", lambda s, d: matching(opened(s, d), ("prefix", "n_x")), "select distinct node_id from @nodes where regexp_matches(text, '(^|\\s)[(\\[{<«\"]*(\\d+\\.+)?Nx[a-h][1-8][+#]?[^0-9A-Za-zÀ-ɏЀ-ӿ\\s]*(\\s|$)')")
R.plan("o2_18_snippet", lambda s, d: with_snippets(opened(s, d), search(opened(s, d), Query(text="initiative", scope="comments", limit=None)), "initiative").select("node_id", "first_at", "snippet"), f"select node_id, p::int as first_at, regexp_replace(substr(text, greatest(p - 60, 1), 130), '\\s+', ' ', 'g') as snippet from (select distinct n.node_id, n.text, case when instr(n.text, 'initiative') > 0 then instr(n.text, 'initiative') else instr(lower(n.text), 'initiative') end as p from @nodes n join @library d on n.doc_id = d.doc_id where n.scope = 'comments' and {_word('initiative')}) t")
R.plan("o2_20_as_hit", _ask(Query(text="initiative", limit=None), "node_id", "uri", "kind", "page", "scope", "white", "black"), f"select n.node_id, d.uri, d.kind, n.page, n.scope, f.white, f.black from @N n join @D d on n.doc_id = d.doc_id left join @F f on n.node_id = f.node_id where {_word('initiative')}")


# the index itself
def _meta(s: SparkSession, d: str) -> DataFrame:
    index = opened(s, d)
    return s.createDataFrame(sorted((k, v) for k, v in store.read_meta(s, index.folder).items() if k in ("documents", "nodes", "indexed", "schema", "tokenizer", "hash")), "key string, value string")


def _upsert(s: SparkSession, d: str) -> DataFrame:
    """Keys set twice: the later value stands, other keys stay."""
    folder = fresh(s, "meta")
    lib = s.read.parquet(f"{d}/library.parquet")
    store.write_meta(s, folder, {"rows": str(lib.count()), "kinds": str(lib.select("kind").distinct().count())})
    store.write_meta(s, folder, {"rows": str(lib.select("doc_id").distinct().count())})
    return s.createDataFrame(sorted(store.read_meta(s, folder).items()), "key string, value string")


def _stats(s: SparkSession, d: str) -> DataFrame:
    x = opened(s, d).stats()
    return s.createDataFrame([(x["documents"], x["nodes"], x["positions"])], "documents long, nodes long, positions long")


def _ratio(s: SparkSession, d: str) -> DataFrame:
    x = opened(s, d).stats()
    return s.createDataFrame([(x["index_bytes"], x["corpus_bytes"], x["index_bytes"] / max(x["corpus_bytes"], 1))], "index_bytes long, corpus_bytes long, ratio double")


R.plan("o1_18_connect", lambda s, d: store.connect(s, d, opened(s, d).folder, create=False, read_only=True).table("postings").agg(F.countDistinct("node_id").alias("nodes")), f"select count(*) as nodes from (select distinct node_id from @nodes where text is not null and text <> '' and len({TOKENS.replace('{x}', 'text')}) > 0) t")
R.plan("o1_19_read_meta", _meta, f"select 'documents' as key, count(distinct doc_id)::varchar as value from @library union all select 'nodes', count(distinct node_id)::varchar from @nodes union all select 'indexed', count(*)::varchar from (select distinct node_id from @nodes where text <> '' and len({TOKENS.replace('{x}', 'text')}) > 0) t union all select unnest(['schema', 'tokenizer', 'hash']), '1'")
R.plan("o1_20_write_meta", _upsert, "select 'rows' as key, count(distinct doc_id)::varchar as value from @library union all select 'kinds', count(distinct coalesce(kind, '?'))::varchar from @library")
R.plan("o4_1_index_stats", lambda s, d: _stats(s, d).select("documents", "nodes"), "select count(distinct doc_id) as documents, (select count(distinct node_id) from @nodes) as nodes from @library")
R.plan("o4_2_index_ratio", _ratio)
R.plan("o1_21_database_bytes", lambda s, d: s.createDataFrame([(t, store.bytes_under(s, f"{d}/{t}.parquet")) for t in (*store.TABLES, "absent")], "name string, bytes long"))


# which tables an index must have
R.plan("o7_2_required_minus_present", lambda s, d: s.createDataFrame([(t,) for t in ("postings", "positions", "moves", "meta", "vectors") if not store.exists(s, f"{opened(s, d).folder}/{t}")], "missing string"), "select 'vectors' as missing")
_ = move_glob
