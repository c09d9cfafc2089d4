"""Queries of notation in text: squares, demands of pages, moves in order, words of neighbouring lines, origin of characters."""

from __future__ import annotations

import json
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import SAN, call
from ..operators import movetext
from ..operators.evaluation import best_matches
from ..operators.index import opened
from .registry import TABLES, Registry

R = Registry()
_CAP = "(select distinct node_id, doc_id, page, text from @nodes where scope = 'captions' and text <> '')"


def _captions(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/nodes.parquet").where("scope = 'captions' and text <> ''").select("node_id", "doc_id", "page", "text").distinct()


# the squares a text names, in order, without repeats, at most four
R.plan("o9_86_square_names", lambda s, d: _captions(s, d).select("node_id", F.array_join(F.slice(F.array_distinct(F.filter(F.transform(F.split("text", "[^A-Za-z0-9]+"), lambda w: F.lower(w)), lambda w: w.rlike("^[a-h][1-8]$"))), 1, 4), " ").alias("squares")), f"select node_id, array_to_string(list_transform(list_filter(list_transform(range(1, len(l) + 1), lambda i: struct_pack(w := l[i], i := i)), lambda x: list_position(l, x.w) = x.i), lambda x: x.w)[1:4], ' ') as squares from (select node_id, list_filter(list_transform(string_split_regex(text, '[^A-Za-z0-9]+'), lambda w: lower(w)), lambda w: regexp_matches(w, '^[a-h][1-8]$')) as l from {_CAP} c) t")
_WHITE, _BLACK = "White to|Weiß am|Juegan las blancas|Jogam as brancas|Ход белых|Trait aux blancs", "Black (?:to|must)|Schwarz am|Juegan las negras|Jogam as pretas|Ход чёрных|Trait aux noirs"


def _context(s: SparkSession, d: str) -> DataFrame:
    side = F.when(F.col("text").rlike(_WHITE), "white").when(F.col("text").rlike(_BLACK), "black")
    return _captions(s, d).select("node_id", "doc_id", "page", call("mate_in", x="text").alias("mate"), side.alias("side"))


def _page_scope(s: SparkSession, d: str) -> DataFrame:
    """What all captions of a page that say it agree on; null where they don't."""
    one = lambda c: F.when(F.countDistinct(c) == 1, F.min(c)).alias(f"page_{c}")
    return _context(s, d).groupBy("doc_id", "page").agg(one("mate"), one("side"))


_SIDE = f"case when regexp_matches(text, '{_WHITE}') then 'white' when regexp_matches(text, '{_BLACK}') then 'black' end"
_MATE = "coalesce(try_cast(nullif(regexp_extract(lower(text), '(?:mate in|matt in|mat en|mate em) ([0-9]+)', 1), '') as int), try_cast(nullif(regexp_extract(text, '(?:^|[^0-9A-Za-z] ?)#([0-9]+)$', 1), '') as int))"
_CTX = f"(select node_id, doc_id, page, {_MATE} as mate, {_SIDE} as side from {_CAP} c)"
_SCOPE = f"(select doc_id, page, case when count(distinct mate) = 1 then min(mate) end as page_mate, case when count(distinct side) = 1 then min(side) end as page_side from {_CTX} c group by doc_id, page)"
R.plan("o9_5_page_stipulation", _page_scope, f"select * from {_SCOPE} s")


def _filled(s: SparkSession, d: str) -> DataFrame:
    """A caption's own context, its gaps filled by its page's."""
    p = _page_scope(s, d).select(F.col("doc_id").alias("d"), F.col("page").alias("p"), "page_mate", "page_side")
    c = _context(s, d)
    return c.join(p, (c["doc_id"] == p["d"]) & c["page"].eqNullSafe(p["p"])).select("node_id", F.coalesce("mate", "page_mate").alias("mate"), F.coalesce("side", "page_side").alias("side"))


R.plan("o9_9_apply_page_scope", _filled, f"select node_id, coalesce(mate, page_mate) as mate, coalesce(side, page_side) as side from {_CTX} c join {_SCOPE} s on s.doc_id = c.doc_id and s.page is not distinct from c.page")
R.plan("o9_6_parse_context", lambda s, d: _context(s, d).join(_captions(s, d).select("node_id", call("caption_label", x="text").alias("label"), call("after_move", x="text").alias("after_move")), "node_id").select("node_id", "label", "after_move", "mate", "side"), f"select c.node_id, regexp_extract(text, '^([^0-9]*[0-9]+)', 1) as label, try_cast(nullif(regexp_extract(text, '(?:After|Nach|Après|Tras|Após|После) ([0-9]+)[.]', 1), '') as int) as after_move, mate, side from {_CTX} c join {_CAP} t on t.node_id = c.node_id")

# moves of a text in the order of a walk: a move, then the variations that leave before it, then the next
R.plan("o5_18_move_order", lambda s, d: opened(s, d).table("moves").select("node_id", F.col("i").alias("rank"), "san"), f"select node_id, unnest(range(len(l)))::int as rank, unnest(l) as san from (select node_id, regexp_extract_all(text, '{SAN}') as l from (select distinct node_id, text from @nodes where scope in ('mainline', 'variations') and text <> '') n) t")
R.plan("o1_10_move_depth", lambda s, d: movetext.moves(s.read.parquet(f"{d}/nodes.parquet")).select("node_id", F.col("i").alias("pos"), "depth"))


def _promoted(rows):
    for batch in rows:
        ids, out = [], []
        for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            moves = movetext.parse(text)[0]
            path = next((m["path"] for m in moves if m["path"]), None)
            if path is not None:
                ids.append(node)
                out.append(movetext.to_text(sorted(movetext.promote(moves, tuple(path[:2])), key=lambda m: (len(m["path"]), m["path"], m["ply"]))))
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["node_id", "movetext"])


R.plan("o11_23_promote_variation", lambda s, d: s.read.parquet(f"{d}/nodes.parquet").where("scope in ('mainline', 'variations') and text like '%(%'").select("node_id", "text").distinct().mapInArrow(_promoted, "node_id long, movetext string"))


def _words_of_lines(s: SparkSession, d: str) -> DataFrame:
    """Spans of a line matched one to one with those of the next, by the share they have in common across less a twentieth per
    edit between their texts."""
    sp = s.read.parquet(f"{d}/text_spans.parquet").where("x is not null and w > 0").dropDuplicates(["span_id"])
    a, b = (sp.select("doc_id", "page", (F.col("line_no") + k).alias("line"), F.col("span_id").alias(f"{n}_id"), F.col("x").alias(f"{n}_l"), (F.col("x") + F.col("w")).alias(f"{n}_r"), F.col("text").alias(f"{n}_t")) for n, k in (("a", 1), ("b", 0)))
    share = (F.least("a_r", "b_r") - F.greatest("a_l", "b_l")) / F.least(F.col("a_r") - F.col("a_l"), F.col("b_r") - F.col("b_l"))
    near = a.join(b, ["doc_id", "page", "line"]).withColumn("share", share).where("share > 0.3")
    scored = near.withColumn("score", F.col("share") - 0.05 * F.coalesce(F.levenshtein("a_t", "b_t"), F.lit(0)))
    return best_matches(scored, "a_id", "b_id", "score").select(F.col("a_id").alias("s1"), F.col("b_id").alias("s2"))


R.plan("o3_9_pair_words", _words_of_lines)


def origins(text: str) -> tuple[str, list[int]]:
    """A text with compatible forms, one kind of dash and quotes and single blanks, and for each of its characters the place
    in the text it comes from."""
    out, at, blank = [], [], True
    for i, c in enumerate(text):
        for x in unicodedata.normalize("NFKC", c).translate(str.maketrans("–—−‐‑‘’“”", "-----''\"\"")):
            if x.isspace():
                if blank:
                    continue
                x = " "
            blank = x == " "
            out.append(x)
            at.append(i)
    while out and out[-1] == " ":
        out.pop()
        at.pop()
    return "".join(out), at


def _mapped(batches):
    for batch in batches:
        pairs = [origins(t) for t in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.list_(pa.int32()))], names=["node_id", "text", "origins"])


R.plan("o11_9_normalize_with_mapping", lambda s, d: s.read.parquet(f"{d}/nodes.parquet").where("scope in ('all', 'comments') and text <> ''").select("node_id", "text").distinct().mapInArrow(_mapped, "node_id long, text string, origins array<int>").select("node_id", "text", F.size("origins").alias("chars"), F.element_at("origins", -1).alias("last")))

_KINDS = {"string": "string", "bigint": "integer", "int": "integer", "double": "number", "boolean": "boolean", "timestamp": "string"}


def _schemas(s: SparkSession, d: str) -> DataFrame:
    """A JSON schema of each table: an object with a property a column, null allowed."""
    rows = []
    for t in TABLES:
        props = {c: {"type": ["array" if k.startswith("array") else _KINDS.get(k, k), "null"]} for c, k in s.read.parquet(f"{d}/{t}.parquet").dtypes}
        rows.append((t, json.dumps({"type": "object", "properties": props}, sort_keys=True)))
    return s.createDataFrame(rows, "name string, schema string")


R.plan("o9_85_json_schema_for", _schemas)
