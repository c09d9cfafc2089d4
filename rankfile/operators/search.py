"""Corpus search on the stored index: boolean full text with BM25, positions, moves, and one conjunctive query.

Every part of a query narrows a set of node ids that comes from the index (postings of its tokens, positions of its
hash, moves); the sets are joined to the nodes by semi-joins beside the filters that reach the scan, and ids are
made distinct last. Texts are read for the filters that need them and for the snippets of the page asked for.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .index import Index, opened
from .positions import find_position, hash_number
from .predicates import MaterialSignature, MoveQuery, PositionPattern, QueryError, compiled, move_glob
from .tokens import _SAN, tokens

FEW = 10_000  # hits whose ids are broadcast to read their texts
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6  # fixed values of the ranking function


# --- boolean text: ("term", [forms]), ("phrase", [tokens]), ("prefix", token), ("and" | "or" | "not", left, right)


def split_query(text: str) -> list[tuple[str, str]]:
    """(kind, piece): phrases (an unclosed one ends with the text), brackets, the words AND, OR, NOT, and other words."""
    out = []
    for m in re.finditer(r'"([^"]*)"?(\*?)|([()])|([^\s()"]+)', text):
        if m.group(1) is not None:
            out.append(("prefix" if m.group(2) else "phrase", m.group(1)))
        elif m.group(3):
            out.append(("bracket", m.group(3)))
        else:
            w = m.group(4)
            out.append(("operator", w) if w in ("AND", "OR", "NOT") else ("prefix", w[:-1]) if w.endswith("*") and len(w) > 1 else ("word", w))
    return out


def parse_boolean(text: str, raw: bool = False) -> tuple | None:
    """A query as a tree: NOT binds before AND, AND before OR, neighbours are joined by AND. Brackets and prefixes count in
    raw expressions only; elsewhere they are part of words. NOT needs something before it. None if it asks for nothing."""
    pieces = split_query(text) if raw else [p for p in split_query(re.sub(r"[()]", " ", text))]
    at = 0

    def peek():
        return pieces[at] if at < len(pieces) else ("end", "")

    def take():
        nonlocal at
        at += 1
        return pieces[at - 1]

    def primary():
        kind, x = take()
        if kind == "bracket" and x == "(":
            inner = either()
            if take_if("bracket", ")") is None:
                raise QueryError(f"bracket isn't closed in {text!r}")
            return inner
        if kind in ("operator", "bracket"):
            raise QueryError(f"{x} needs something before it in {text!r}")
        return (kind if raw or kind != "prefix" else "word", x)

    def take_if(kind: str, x: str):
        return take() if peek() == (kind, x) else None

    def without():
        left = primary()
        while take_if("operator", "NOT"):
            if peek()[0] == "end":
                raise QueryError(f"NOT needs something after it in {text!r}")
            left = ("not", left, primary())
        return left

    def both():
        left = without()
        while peek()[0] not in ("end",) and peek() not in (("operator", "OR"), ("bracket", ")")):
            if take_if("operator", "AND") and peek()[0] == "end":
                raise QueryError(f"AND needs something after it in {text!r}")
            left = ("and", left, without())
        return left

    def either():
        left = both()
        while take_if("operator", "OR"):
            left = ("or", left, both())
        return left

    if not pieces:
        return None
    tree = either()
    if at < len(pieces):
        raise QueryError(f"bracket isn't opened in {text!r}")
    return tree


def _leaves(tree: tuple | None) -> list[tuple]:
    return [] if tree is None else [tree] if tree[0] in ("word", "phrase", "prefix") else [x for t in tree[1:] for x in _leaves(t)]


def encoded(spark: SparkSession, tree: tuple | None) -> tuple | None:
    """The tree with the pieces' tokens: terms with their forms (a bare move also with check and mate), phrases of
    several tokens, prefixes. A piece without a token asks for nothing."""
    pieces = sorted({x for _, x in _leaves(tree)})
    if not pieces:
        return tree
    row = spark.sql("select " + ", ".join(f":p{i} as p{i}" for i in range(len(pieces))), {f"p{i}": p for i, p in enumerate(pieces)}).select(*[tokens(f"p{i}").alias(f"p{i}") for i in range(len(pieces))]).first()
    toks = dict(zip(pieces, row))

    def walk(t: tuple) -> tuple | None:
        if t[0] in ("and", "or", "not"):
            left, right = walk(t[1]), walk(t[2])
            return left if right is None else right if left is None and t[0] != "not" else None if left is None else (t[0], left, right)
        found = toks[t[1]]
        if not found:
            return None
        if t[0] == "prefix" and len(found) == 1:
            return ("prefix", found[0])
        if len(found) == 1:
            bare = t[0] == "word" and re.fullmatch(_SAN, t[1]) is not None
            return ("term", [found[0], *(found[0] + c for c in "+#" if bare)])
        return ("phrase", list(found))

    return walk(tree) if tree else None


def occurrences(index: Index, leaf: tuple) -> DataFrame:
    """(node_id, n, tf): the nodes that hold a leaf, their length, how often they hold it."""
    if leaf[0] == "prefix":
        hit = index.table("postings").where(F.col("token").startswith(leaf[1]))
    else:
        hit = index.keyed("postings", "token", sorted(set(leaf[1])))
    if leaf[0] == "phrase":
        places = index.spark.createDataFrame(list(enumerate(leaf[1])), "i int, token string")
        hit = hit.join(F.broadcast(places), "token").select("node_id", "n", (F.col("pos") - F.col("i")).alias("base"), "i").distinct()
        hit = hit.groupBy("node_id", "n", "base").agg(F.count("*").alias("k")).where(F.col("k") == len(leaf[1]))
    return hit.groupBy("node_id", "n").agg(F.count("*").alias("tf"))


def matching(index: Index, tree: tuple) -> DataFrame:
    """(node_id) of the nodes that satisfy a tree."""
    if tree[0] in ("term", "phrase", "prefix"):
        return occurrences(index, tree).select("node_id").distinct()
    left, right = matching(index, tree[1]), matching(index, tree[2])
    if tree[0] == "or":
        return left.unionByName(right).distinct()
    return left.join(right, "node_id", "left_semi" if tree[0] == "and" else "left_anti")


def _positive(tree: tuple) -> list[tuple]:
    if tree[0] == "not":
        return _positive(tree[1])
    return [x for t in tree[1:] for x in _positive(t)] if tree[0] in ("and", "or") else [tree]


def bm25(index: Index, tree: tuple) -> DataFrame:
    """(node_id, score) by BM25 over all nodes, summed over the forms of the tree's terms and its phrases."""
    docs, length = index.texts()
    leaves = [("term", [f]) for t in _positive(tree) if t[0] == "term" for f in t[1]] + [t for t in _positive(tree) if t[0] != "term"]
    parts = [occurrences(index, leaf).withColumn("leaf", F.lit(i)) for i, leaf in enumerate(leaves)]
    occ = reduce(DataFrame.unionByName, parts)
    df = occ.groupBy("leaf").agg(F.count("*").alias("df"))  # a row a leaf
    idf = F.greatest(F.lit(IDF_FLOOR), F.log((F.lit(float(docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.lit(length)))
    return occ.join(F.broadcast(df), "leaf").groupBy("node_id").agg(F.sum(score).alias("score"))


# --- the conjunctive query


@dataclass(frozen=True)
class Query:
    """One conjunctive query; every field is optional. Results come in document order unless by_score."""

    text: str | None = None
    match: str | None = None
    regex: str | None = None
    scope: str | None = None
    move: MoveQuery | str | None = None
    position: str | None = None
    position_pattern: PositionPattern | None = None
    material: MaterialSignature | str | None = None
    eco: str | None = None
    player: str | None = None
    year_min: int | None = None
    year_max: int | None = None
    annotation: str | None = None
    documents: tuple[str, ...] = ()
    stratum: str | None = None
    include_collisions: bool = True
    limit: int | None = 50
    offset: int = 0
    by_score: bool = False

    def __post_init__(self) -> None:
        if self.text is not None and self.match is not None:
            raise QueryError("text and match exclude each other")
        if self.limit is not None and self.limit < 1 or self.offset < 0:
            raise QueryError("limit must be at least 1, offset at least 0")


def text_tree(spark: SparkSession, q: Query) -> tuple | None:
    """The encoded tree of the text or raw expression, and of the annotation beside it."""
    source = q.text if q.text is not None else q.match
    tree = encoded(spark, parse_boolean(source, raw=q.match is not None)) if source else None
    if q.annotation:
        mark = ("term", [q.annotation])
        tree = mark if tree is None else ("and", tree, mark)
    return tree


def chunks(text: str) -> Column:
    """The printed chunks of a text as bare moves: without number, marks and closing signs."""
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"^\d+\.+", ""), r"[!?.,;:)]+$", "")
    return F.transform(F.split(text, r"\s+"), bare)


def _candidates(index: Index, q: Query, tree: tuple | None) -> list[DataFrame]:
    """Sets of node ids that a hit must be in."""
    out = [matching(index, tree)] if tree else []
    if isinstance(q.move, MoveQuery):
        out.append(index.table("moves").where(q.move.column()).select("node_id").distinct())
    boards = [p for p in (q.position_pattern, MaterialSignature.parse(q.material) if isinstance(q.material, str) else q.material) if p is not None]
    if boards:
        fen = F.concat_ws(" ", "placement", F.when(F.col("white_to_move"), "w").otherwise("b"))
        out.append(index.table("positions").withColumn("fen", fen).where(reduce(Column.__and__, (p.column("fen") for p in boards))).select("node_id").distinct())
    return out


def search(index: Index, q: Query) -> DataFrame:
    """The hits: node_id, doc_id, uri, title, kind, scope, page, ordinal, white, black, eco, year, result, score,
    position_exact, collisions, snippet; total counts all of them, truncated tells that the page does not end the list.

    A predicate on facets drops nodes without facets; year_max leaves out the unknown year 0; % and _ in a player are
    literal. A hit's score is its BM25 if words were asked for, else 1 or 0 by the exactness of its position.
    """
    spark = index.spark
    tree = text_tree(spark, q)
    n = index.table("nodes")
    if q.scope and q.scope != "all scopes":
        n = n.where(F.col("scope") == q.scope)
    if q.regex:
        n = n.where(F.col("text").rlike(compiled(q.regex)))
    if isinstance(q.move, str):
        pattern = move_glob(q.move)
        n = n.where(F.exists(chunks("text"), lambda c: c.rlike(pattern)))
    d = index.table("library").select("doc_id", "uri", "title", "kind", "stratum").dropDuplicates(["doc_id"])
    if q.stratum is not None:
        d = d.where(F.col("stratum") == q.stratum)
    if q.documents:
        d = d.where(F.col("uri").isin(list(q.documents)))
    f = index.table("facets").select("node_id", "white", "black", "eco", "year", "result")
    if q.player:
        like = "%" + re.sub(r"([%_\\])", r"\\\1", q.player) + "%"
        f = f.where(F.col("white").ilike(like) | F.col("black").ilike(like))
    if q.eco:
        f = f.where(F.col("eco").rlike(f"^(?:{compiled(q.eco)})"))
    if q.year_min is not None:
        f = f.where(F.col("year") >= q.year_min)
    if q.year_max is not None:
        f = f.where((F.col("year") <= q.year_max) & (F.col("year") > 0))
    faceted = any(x is not None for x in (q.player, q.eco, q.year_min, q.year_max))
    hits = n.select("node_id", "doc_id", "scope", "page", "ordinal").distinct()
    for ids in _candidates(index, q, tree):
        hits = hits.join(ids, "node_id", "left_semi")
    if q.position is not None:
        found = find_position(index.keyed("positions", "zobrist", [hash_number(q.position)]), q.position, None, q.include_collisions)
        hits = hits.join(found.groupBy("node_id").agg(F.max("exact").alias("position_exact"), F.array_sort(F.collect_set(F.when(~F.col("exact"), F.col("placement")))).alias("collisions")), "node_id")
    else:
        hits = hits.withColumn("position_exact", F.lit(None).cast("boolean")).withColumn("collisions", F.array().cast("array<string>"))
    hits = hits.join(d, "doc_id").join(f.dropDuplicates(["node_id"]), "node_id", "inner" if faceted else "left")
    if tree:
        hits = hits.join(bm25(index, tree), "node_id", "left").fillna(0.0, ["score"])
    else:
        hits = hits.withColumn("score", F.when(F.col("position_exact"), 1.0).otherwise(0.0))
    total = hits.agg(F.count("*").alias("total"))
    order = [*([F.desc("score")] if q.by_score else []), "doc_id", "ordinal", "node_id"]
    page = hits.orderBy(*order)
    page = page.offset(q.offset) if q.offset else page
    page = page.limit(q.limit) if q.limit is not None else page
    out = page.crossJoin(F.broadcast(total))  # one row
    beyond = F.lit(False) if q.limit is None else F.col("total") > q.offset + q.limit
    return out.select("node_id", "doc_id", "uri", "title", "kind", "scope", "page", "ordinal", "white", "black", "eco", "year", "result", "score", "position_exact", "collisions", "total", beyond.alias("truncated")).orderBy(*order)


def with_snippets(index: Index, hits: DataFrame, needle: str, width: int = 60) -> DataFrame:
    """hits with first_at (0: not found) and snippet: the place of a word in the text, as written or in any case, and the
    text around it with single spaces."""
    few = hits.count() <= FEW
    ids = hits.select("node_id").distinct()
    t = index.table("nodes").select("node_id", "text").join(F.broadcast(ids) if few else ids, "node_id", "left_semi").dropDuplicates(["node_id"])
    at = F.when(F.instr("text", needle) > 0, F.instr("text", needle)).otherwise(F.instr(F.lower("text"), needle.lower()))
    s = F.regexp_replace(F.expr(f"substring(text, greatest(first_at - {width}, 1), {2 * width + len(needle)})"), r"\s+", " ")
    return hits.join(t.withColumn("first_at", at).select("node_id", "first_at", s.alias("snippet")), "node_id", "left")
