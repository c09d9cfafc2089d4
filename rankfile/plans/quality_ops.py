"""Queries of prose quality, languages and dictionaries. The SQL builds the lexicons and counts by itself."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.board import Board
from ..functions.dialect import bind
from ..functions.scalars import TEMPLATES
from ..operators import quality as q
from ..session import written
from .registry import Registry, for_duck

R = Registry()


def _authored(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/authored.parquet")


def _lexicons(s: SparkSession, d: str) -> DataFrame:
    return q.lexicons(_authored(s, d), "item_id", "lang", "text")


def _nodes(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/nodes.parquet").where("scope in ('all', 'comments') and text <> ''").select("node_id", "doc_id", "text").distinct()


def _signals(s: SparkSession, d: str) -> DataFrame:
    """Signals of the prose nodes, judged in their own language or that of their document."""
    own = written(q.signals(_nodes(s, d), "node_id", "text", _lexicons(s, d)), "signals")
    own = own.join(_nodes(s, d).select(F.col("node_id").alias("key"), "doc_id").distinct(), "key")
    docs = q.document_languages(own, "doc_id").select("doc_id", F.col("code").alias("doc_code"))
    return written(q.plausible(q.prose_language(own.join(docs, "doc_id", "left"), F.col("doc_code"))), "signals")


# the same in SQL
_CORE = "regexp_replace(regexp_replace(c, '^[(\\[{«„“\"''‘]+', ''), '[)\\]}»”\"''’.,;:]+$', '')"
_NOTATION = q.NOTATION.replace("'", "''")


def _words_sql(relation: str, keys: str) -> str:
    prose = f"array_to_string(list_filter(list_transform(string_split_regex(text, '\\s+'), lambda c: {_CORE}), lambda c: c <> '' and not regexp_matches(c, '{_NOTATION}')), ' ')"
    return f"select {keys}, unnest(regexp_extract_all(lower({prose}), '(?:\\p{{L}}\\p{{M}}*){{2,}}')) as word from {relation}"


_CODED = f"(select distinct item_id, {for_duck(bind(TEMPLATES['language_code'], x='lang'))} as code, text from @authored)"
_LEX = f"(select code, word, n from (select *, max(rate) over (partition by word) as top from (select *, n / sum(n) over (partition by code) as rate from (select code, word, count(*) as n, count(distinct item_id) as items from ({_words_sql(_CODED + ' a', 'item_id, code')}) w where code in ('de', 'en', 'es', 'fr', 'pt', 'ru') group by code, word) c) r) t where items >= 2 and rate >= 25e-2 * top)"
_N = "(select distinct node_id, doc_id, text from @nodes where scope in ('all', 'comments') and text <> '')"
_HITS = f"(select node_id, doc_id, count(*) as judged, {', '.join(f'''count(*) filter (word in (select word from {_LEX} l where code = '{k}')) as h_{k}''' for k in q.LANGS)} from ({_words_sql(_N + ' n', 'node_id, doc_id')}) w group by node_id, doc_id)"
R.plan("o9_60_lexicon_for", lambda s, d: _lexicons(s, d).groupBy("code").agg(F.count("*").alias("words"), F.sum("n").alias("occurrences")), f"select code, count(*) as words, sum(n)::bigint as occurrences from {_LEX} l group by code")
R.plan("o9_46_dictionary_hit_rate", lambda s, d: q.signals(_nodes(s, d), "node_id", "text", _lexicons(s, d)).where("judged > 0").select(F.col("key").alias("node_id"), "judged", *(F.col(f"hits_{k}").alias(f"h_{k}") for k in q.LANGS)), f"select node_id, judged, {', '.join(f'h_{k}' for k in q.LANGS)} from {_HITS} h")


def _ranked_sql(source: str, key: str) -> str:
    pairs = ", ".join(f"('{k}', h_{k}, {i})" for i, k in enumerate(q.LANGS))
    return f"(select {key}, judged, arg_max(code, (h, -i)) as best, max(h) / judged as top, (list_sort(list(h), 'DESC'))[2] / judged as second from (select {key}, judged, u.code, u.h, u.i from {source} h, lateral (values {pairs}) u(code, h, i)) x group by {key}, judged)"


R.plan("o9_63_detect_prose_language", lambda s, d: q.prose_language(q.signals(_nodes(s, d), "node_id", "text", _lexicons(s, d))).where("judged > 0").select(F.col("key").alias("node_id"), "code", F.round("share", 6).alias("share"), "confident"), f"select node_id, case when judged >= 12 and top - second >= 8e-2 then best end as code, floor(top * 1e6 + 5e-1) / 1e6 as share, judged >= 12 and top - second >= 8e-2 as confident from {_ranked_sql(_HITS, 'node_id')} r")
_DOC_HITS = f"(select doc_id, sum(judged)::bigint as judged, {', '.join(f'sum(h_{k})::bigint as h_{k}' for k in q.LANGS)} from {_HITS} h group by doc_id)"
R.plan("o9_64_document_language", lambda s, d: q.document_languages(q.signals(_nodes(s, d), "node_id", "text", _lexicons(s, d)).join(_nodes(s, d).select(F.col("node_id").alias("key"), "doc_id").distinct(), "key").where("judged > 0"), "doc_id").select("doc_id", "code", F.round("share", 6).alias("share")), f"select doc_id, case when judged >= 12 and top - second >= 8e-2 then best end as code, floor(top * 1e6 + 5e-1) / 1e6 as share from {_ranked_sql(_DOC_HITS, 'doc_id')} r")

_ROUND = lambda *cs: [F.round(c, 6).alias(c) for c in cs]
R.plan("o9_39_measure_text", lambda s, d: _signals(s, d).select(F.col("key").alias("node_id"), "chars", "chunks", "judged", *_ROUND("hit_rate", "nonword_ratio", "ngram_plausibility", "implausible_ratio", "notation_ratio")))


def _errors(s: SparkSession, d: str) -> DataFrame:
    x = _signals(s, d)
    return q.estimated_error(x.join(q.book_baselines(x, "doc_id"), "doc_id", "left"), F.col("baseline")).select(F.col("key").alias("node_id"), *_ROUND("cer", "cer_confidence"))


R.plan("o9_40_estimate_cer", _errors)
R.plan("o9_41_text_plausibility", lambda s, d: q.text_plausibility(_signals(s, d)).select(F.col("key").alias("node_id"), *_ROUND("plausibility")))
R.plan("o9_49_nonword_ratio", lambda s, d: _signals(s, d).select(F.col("key").alias("node_id"), *_ROUND("nonword_ratio")))
R.plan("o9_55_ngram_plausibility", lambda s, d: _signals(s, d).select(F.col("key").alias("node_id"), *_ROUND("ngram_plausibility")))
R.plan("o4_23_document_baseline", lambda s, d: q.book_baselines(_signals(s, d), "doc_id").select("doc_id", *_ROUND("baseline")))
R.plan("o9_42_assess_result", lambda s, d: q.estimated_error(_signals(s, d)).select(F.col("key").alias("node_id"), q.severity("cer", "cer_confidence").alias("severity"), F.array_compact(F.array(F.when(F.col("cer") > 0.02, "error rate"), F.when(F.col("nonword_ratio") > 0.1, "words"), F.when(F.col("implausible_ratio") > 0.02, "characters"))).alias("reasons")).select("node_id", "severity", F.array_join("reasons", ", ").alias("reasons")))


def _bigram_lp(s: SparkSession, d: str) -> DataFrame:
    return q.bigrams(_lexicons(s, d)).select("pair", F.round("lp", 6).alias("lp"))


R.plan("o9_54_ngram_log_probability", _bigram_lp, f"with p as (select substr(w, i, 2) as pair, n from (select '^' || word || '$' as w, n, unnest(range(1, length(word) + 2)) as i from {_LEX} l) x), c as (select pair, sum(n) as n from p group by pair) select pair, floor(log2((n + 1) / (sum(n) over (partition by substr(pair, 1, 1)) + count(*) over (partition by substr(pair, 1, 1)) + 1)) * 1e6 + 5e-1) / 1e6 as lp from c")

# notation
_PIECES = [f"('{k}', '{p}', {i})" for i, (k, p) in enumerate(q.PIECES.items())]
R.plan("o9_65_notation_convention", lambda s, d: _nodes(s, d).withColumn("c", q.convention("text")).where("c is not null").select("node_id", "c.locale", F.round("c.share", 6).alias("share"), "c.moves").distinct(), f"select node_id, arg_max(k, (n, -i)) as locale, floor(max(n) / any_value(len(l)) * 1e6 + 5e-1) / 1e6 as share, any_value(len(l))::int as moves from (select node_id, l, u.k, u.i, len(list_filter(l, lambda c: contains(u.p, c))) as n from (select distinct node_id, regexp_extract_all(text, '(?:^|[^\\p{{L}}\\d])([A-ZКФЛС])[a-h]?[1-8]?x?[a-h][1-8]', 1) as l from {_N} n) x, lateral (values {', '.join(_PIECES)}) u(k, p, i)) y group by node_id having max(n) > 0")
_TO_EN = {k: str.maketrans(p, ("KQRN" if k == "ru" else "KQRBN")[: len(p)]) for k, p in q.PIECES.items() if k != "ru"} | {"ru": str.maketrans("ФЛСК", "QRBN")}


def _legal(batches):
    """Legal moves from the start of each game, read with each locale's letters."""
    from ..operators.movetext import tokenize

    for batch in batches:
        rows = []
        for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sans = [x for kind, _, _, x in tokenize(text) if kind in ("move", "other")]
            for i, (locale, table) in enumerate(_TO_EN.items()):
                board, n = Board(), 0
                for x in sans:
                    x = x.replace("Кр", "K") if locale == "ru" else x
                    board = board.play(x[:1].translate(table) + x[1:].translate(table if "=" in x else {}))
                    if board is None:
                        break
                    n += 1
                rows.append((node, locale, n, len(sans), -i))
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()))], names=["node_id", "locale", "legal", "moves", "i"])


def _locale(s: SparkSession, d: str) -> DataFrame:
    """The locale whose letters keep most moves of a game legal, and its lead; null without a lead of one move."""
    games = s.read.parquet(f"{d}/nodes.parquet").where("scope = 'mainline' and text <> ''").select("node_id", "text").distinct()
    per = games.mapInArrow(_legal, "node_id long, locale string, legal int, moves int, i int")
    top = F.reverse(F.array_sort(F.collect_list(F.struct("legal", "i", "locale"))))  # six a game
    g = per.groupBy("node_id", "moves").agg(top.alias("t"))
    return g.select("node_id", "moves", F.col("t")[0]["legal"].alias("legal"), F.when(F.col("t")[0]["legal"] > F.col("t")[1]["legal"], F.col("t")[0]["locale"]).alias("locale"))


R.plan("o9_66_detect_language", _locale)

# dictionaries
# A small dictionary with rules of affixes, to show each kind.
_ENTRIES = [("move", "SDG"), ("attack", "SDGR"), ("check", "SDGR"), ("study", "YU"), ("castle", "SDGU"), ("queen", "S"), ("open", "DGSU"), ("rook", "S")]
_RULES = [("S", "suffix", "", "s", "[^sy]"), ("Y", "suffix", "y", "ies", "[^aeiou]y"), ("D", "suffix", "", "ed", "[^ey]"), ("D", "suffix", "e", "ed", "e"), ("G", "suffix", "", "ing", "[^e]"), ("G", "suffix", "e", "ing", "e"), ("R", "suffix", "", "er", "[^e]"), ("U", "prefix", "", "un", "."), ("U", "prefix", "", "re", "[a-z]")]


def _dictionary(s: SparkSession) -> DataFrame:
    return q.affixed(s.createDataFrame(_ENTRIES, "word string, flags string"), s.createDataFrame(_RULES, "flag string, kind string, strip string, `add` string, condition string"))


def _tokens(s: SparkSession, d: str) -> DataFrame:
    return _nodes(s, d).select(F.explode(F.regexp_extract_all("text", F.lit(r"(?:\p{L}\p{M}*){2,}"), F.lit(0))).alias("token")).distinct()


_FORMS = "moves move moved moving attack attacks attacked attacking attacker check checks checked checking checker study studies unstudy restudy unstudies restudies castle castles castled castling uncastle recastle uncastles recastles uncastled recastled uncastling recastling queen queens open opens opened opening unopen reopen unopens reopens unopened reopened unopening reopening rook rooks".split()
_IN = ", ".join(f"('{w}')" for w in sorted(_FORMS))
R.plan("o9_62_is_word", lambda s, d: q.is_word(_tokens(s, d), "token", _dictionary(s)).where("known").select("token"), f"select distinct token from (select unnest(regexp_extract_all(text, '(?:\\p{{L}}\\p{{M}}*){{2,}}')) as token from {_N} n) t where token in (select w from (values {_IN}) f(w)) or lower(token) in (select w from (values {_IN}) f(w))")


def _known(s: SparkSession, d: str) -> DataFrame:
    """How each word of the prose is known: in a lexicon, in the dictionary, or by a lexicon's word without its ending."""
    w = written(q.words(_nodes(s, d), "node_id", "text").select("word").distinct(), "words")
    lex = _lexicons(s, d).select(F.col("word").alias("stem")).distinct()
    direct = w.join(lex, F.col("word") == F.col("stem"), "left_semi").select("word", F.lit(1).alias("how"))
    listed = w.join(_dictionary(s), "word", "left_semi").select("word", F.lit(2).alias("how"))
    ends = F.explode(F.filter(F.array(*[F.when(F.col("word").endswith(e), F.expr(f"substring(word, 1, length(word) - {len(e)})")) for e in ("s", "es", "en", "er", "ed", "ing", "os", "as")]), lambda x: F.length(x) >= 4))
    stemmed = w.select("word", ends.alias("cut")).join(lex, F.col("cut") == F.col("stem"), "left_semi").select("word", F.lit(3).alias("how"))
    how = direct.unionByName(listed).unionByName(stemmed).groupBy("word").agg(F.min("how").alias("how"))
    name = F.when(F.col("how") == 1, "lexicon").when(F.col("how") == 2, "dictionary").when(F.col("how") == 3, "ending").otherwise("unknown")
    return w.join(how, "word", "left").select("word", name.alias("how"))


_WORDS = f"(select distinct word from ({_words_sql(_N + ' n', 'node_id')}) x)"
_STEMS = " or ".join(f"(ends_with(word, '{e}') and length(word) >= {4 + len(e)} and substr(word, 1, length(word) - {len(e)}) in (select word from {_LEX} l))" for e in ("s", "es", "en", "er", "ed", "ing", "os", "as"))
R.plan("o9_47_known", _known, f"select word, case when word in (select word from {_LEX} l) then 'lexicon' when word in (select w from (values {_IN}) f(w)) then 'dictionary' when {_STEMS} then 'ending' else 'unknown' end as how from {_WORDS} w")
