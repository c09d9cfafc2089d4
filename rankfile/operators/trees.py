"""Document trees as tables: a row a node, with its path; units of a tree; exports and their scans; page ranges.

A library document is the root. Its headings, paragraphs and figures are children in order; a game is a child that holds
its header, main line, variations and comments. A path is the list of places from the root down, so the order of paths
is the reading order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..extensions import EXPORTERS, Exporter, Migration, Migrations

#: The tag of a node by its scope outside games, and the parts of a game.
TAGS = {"headers": "heading", "all": "paragraph", "captions": "figure"}
PARTS = {"headers": "header", "mainline": "mainline", "variations": "variation", "comments": "comment"}


def tree(nodes: DataFrame) -> DataFrame:
    """(doc_id, path, depth, tag, node_id, text) of every node and of the games and documents that hold them.

    A header that opens with a bracket starts a game, and moves and comments up to the next other node belong to it;
    without a header before them they hang on the document. Repeated rows count once.
    """
    n = nodes.select("node_id", "doc_id", "scope", "ordinal", "text").dropDuplicates(["node_id"])
    order = Window.partitionBy("doc_id").orderBy("ordinal", "node_id")
    opens = (F.col("scope") == "headers") & F.coalesce(F.col("text").startswith("["), F.lit(False))
    part = opens | F.col("scope").isin("mainline", "variations", "comments")
    n = n.withColumn("mark", F.when(opens, F.col("ordinal")).when(~part, F.lit(-1)))
    n = n.withColumn("game", F.when(part, F.last("mark", True).over(order.rowsBetween(Window.unboundedPreceding, 0))).otherwise(-1))
    inside = F.col("game") >= 0
    tag = lambda table: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col("scope")]
    leaf = n.select("doc_id", F.when(inside, F.array("game", F.col("ordinal") + 1)).otherwise(F.array("ordinal")).alias("path"), F.when(inside, tag(PARTS)).otherwise(F.coalesce(tag(TAGS), tag(PARTS))).alias("tag"), "node_id", "text")
    games = n.where(inside & opens).select("doc_id", F.array("game").alias("path"), F.lit("game").alias("tag"), F.lit(None).cast("long").alias("node_id"), F.lit(None).cast("string").alias("text"))
    roots = n.select("doc_id").distinct().select("doc_id", F.array().cast("array<long>").alias("path"), F.lit("document").alias("tag"), F.lit(None).cast("long").alias("node_id"), F.lit(None).cast("string").alias("text"))
    every = leaf.unionByName(games).unionByName(roots)
    return every.select("doc_id", "path", F.size("path").alias("depth"), "tag", "node_id", "text")


def units(t: DataFrame) -> DataFrame:
    """(doc_id, path, node_id, scope, text): what is indexed of a tree. Containers are not, their parts are."""
    scopes = {v: k for k, v in TAGS.items()} | {v: k for k, v in PARTS.items()}
    scope = F.create_map(*[F.lit(x) for kv in scopes.items() for x in kv])[F.col("tag")]
    return t.where(F.col("tag").isin(list(scopes))).select("doc_id", "path", "node_id", scope.alias("scope"), "text")


def parent_path(path: str = "path") -> Column:
    return F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0)))


def children(t: DataFrame) -> DataFrame:
    """(doc_id, parent, path, place, tag): every node but the roots under its parent, with its place among the siblings."""
    w = Window.partitionBy("doc_id", "parent").orderBy("path")
    return t.where("depth > 0").withColumn("parent", parent_path()).select("doc_id", "parent", "path", F.row_number().over(w).alias("place"), "tag", "node_id")


def transformed(t: DataFrame, drop: list[str], splice: list[str], rename: dict[str, str]) -> DataFrame:
    """The tree without the nodes of some tags and all under them, with the children of others in their place, and tags
    renamed. A spliced node's children keep their paths' order."""
    gone = t.where(F.col("tag").isin(drop)).select("doc_id", F.col("path").alias("gone"))
    under = t.join(gone, (t["doc_id"] == gone["doc_id"]) & (F.slice(t["path"], 1, F.size("gone")) == F.col("gone")) & (F.slice(t["path"], 1, 1) == F.slice("gone", 1, 1)), "left_anti")
    out = under.where(~F.col("tag").isin(splice))
    tag = F.col("tag")
    for a, b in rename.items():
        tag = F.when(F.col("tag") == a, b).otherwise(tag)
    return out.withColumn("tag", tag)


# --- payloads and their migrations


def dumped(t: DataFrame, version: int = 3) -> Column:
    """A node as a JSON object; null fields are left out."""
    return F.to_json(F.struct(F.lit(version).alias("version"), "tag", F.col("node_id").alias("id"), "path", "text"))


PAYLOAD = "version int, tag string, kind string, id long, path array<long>, body string, text string"


def _renamed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"tag": F.coalesce("tag", "kind"), "kind": F.lit(None).cast("string"), "version": F.lit(2)})


def _text(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"text": F.coalesce("text", "body"), "body": F.lit(None).cast("string"), "version": F.lit(3)})


MIGRATIONS = Migrations()
MIGRATIONS.add(Migration(1, _renamed, "kind became tag"))
MIGRATIONS.add(Migration(2, _text, "body became text"))


def loaded(lines: DataFrame, column: str = "value") -> DataFrame:
    """Payloads of any version read from JSON, at the current one: (tag, id, path, text). What is no object has nulls."""
    rows = lines.select(F.from_json(column, PAYLOAD).alias("p")).select("p.*")
    known = rows.where(F.col("version").isin([*MIGRATIONS.steps, MIGRATIONS.current]))
    return MIGRATIONS.migrate(known, "version").select("tag", "id", "path", "text")


# --- exports

_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"))
_TAG = {"heading": "h2", "paragraph": "p", "figure": "figcaption"}


def escaped(c: Column) -> Column:
    for a, b in _ESCAPES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescaped(c: Column) -> Column:
    for a, b in reversed(_ESCAPES):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


class JsonLines(Exporter):
    keeps = ("doc_id", "ordinal", "node_id", "tag", "text")

    def write(self, rows: DataFrame, path: str) -> None:
        rows.select(*self.keeps).write.mode("overwrite").json(path)

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        return spark.read.schema("doc_id long, ordinal long, node_id long, tag string, text string").json(path)


class Html(Exporter):
    """One element a line: its name tells the tag, or a class does; ids stand in attributes. Null texts are left out."""

    keeps = ("doc_id", "ordinal", "node_id", "tag", "text")

    def write(self, rows: DataFrame, path: str) -> None:
        name = F.coalesce(F.create_map(*[F.lit(x) for kv in _TAG.items() for x in kv])[F.col("tag")], F.lit("div"))
        line = F.concat(F.lit("<"), name, F.lit(' class="'), "tag", F.lit('" data-at="'), F.concat_ws("/", "doc_id", "ordinal", "node_id"), F.lit('">'), escaped(F.col("text")), F.lit("</"), name, F.lit(">"))
        rows.where("text is not null").select(line.alias("value")).write.mode("overwrite").text(path)

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        pattern = r'^<(\w+) class="(\w+)" data-at="(\d+)/(-?\d+)/(\d+)">(.*)</\1>$'
        lines = spark.read.text(path).where(F.col("value").rlike(r'^<(\w+) class="'))
        part = lambda k: F.regexp_extract("value", pattern, k)
        return lines.select(part(3).cast("long").alias("doc_id"), part(4).cast("long").alias("ordinal"), part(5).cast("long").alias("node_id"), part(2).alias("tag"), unescaped(part(6)).alias("text"))


class PlainText(Exporter):
    """The texts alone, a paragraph a line; line breaks inside become blanks."""

    keeps = ()

    def write(self, rows: DataFrame, path: str) -> None:
        rows.where("text is not null").select(F.regexp_replace("text", r"\s*\n\s*", " ").alias("value")).write.mode("overwrite").text(path)

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        null = F.lit(None)
        return spark.read.text(path).select(null.cast("long").alias("doc_id"), null.cast("long").alias("ordinal"), null.cast("long").alias("node_id"), null.cast("string").alias("tag"), F.col("value").alias("text"))


for _name, _kind in (("jsonl", JsonLines), ("html", Html), ("text", PlainText)):
    EXPORTERS.register(_name, _kind)


def export(rows: DataFrame, path: str, form: str) -> None:
    """Write rows in a registered form."""
    EXPORTERS.get(form).write(rows, path)


def read_back(spark: SparkSession, path: str, form: str) -> DataFrame:
    return EXPORTERS.get(form).read(spark, path)


def losses(before: DataFrame, after: DataFrame, form: str) -> DataFrame:
    """(format, field, lost, declared): nodes whose field did not come back, and whether the form says so. Forms that keep no
    id are compared by their texts."""
    keeps = EXPORTERS.get(form).keeps
    if "node_id" not in keeps:
        n = before.where("text is not null").count()
        return before.sparkSession.createDataFrame([(form, c, n, True) for c in ("doc_id", "ordinal", "node_id", "tag")], "format string, field string, lost long, declared boolean")
    b = after.select("node_id", F.lit(True).alias("there"), *(F.col(c).alias(f"new_{c}") for c in ("doc_id", "ordinal", "tag", "text")))
    both = before.join(b, "node_id", "left")
    sums = both.agg(*(F.count_if(~F.col(c).eqNullSafe(F.col(f"new_{c}")) | F.col("there").isNull()).alias(c) for c in ("doc_id", "ordinal", "tag", "text")))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("lost")) for c in ("doc_id", "ordinal", "tag", "text")]))
    return sums.select(cells.alias("c")).select(F.lit(form).alias("format"), "c.field", "c.lost", (~F.col("c.field").isin(list(keeps))).alias("declared"))


# --- page ranges


def described(pages: str) -> Column:
    """An array of page indices from 0 as the shortest text of ranges from 1: 1-3,7."""
    s = F.array_sort(F.array_distinct(pages))
    step = lambda acc, p: F.when(
        (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["b"] == p - 1), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["a"].alias("a"), p.alias("b"))))
    ).otherwise(F.concat(acc, F.array(F.struct(p.alias("a"), p.alias("b")))))
    runs = F.aggregate(s, F.array().cast("array<struct<a:int,b:int>>"), step)
    return F.array_join(F.transform(runs, lambda r: F.when(r["a"] == r["b"], (r["a"] + 1).cast("string")).otherwise(F.concat_ws("-", r["a"] + 1, r["b"] + 1))), ",")


def page_range(text: str, count: str) -> Column:
    """Ranges from 1 as a sorted array of indices from 0 within the count; pieces that are no range or lie beyond are left out."""
    pieces = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p.rlike(r"^\d+(-\d+)?$"))
    ends = lambda p: (F.regexp_extract(p, r"^(\d+)", 1).cast("int"), F.regexp_extract(p, r"(\d+)$", 1).cast("int"))
    one = lambda p: F.sequence(F.least(*ends(p)) - 1, F.greatest(*ends(p)) - 1)
    return F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(pieces, one)), lambda i: (i >= 0) & (i < F.col(count)))))
