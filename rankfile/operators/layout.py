"""Page layout: columns and gutters, reading order, tables, running furniture, placement.

Boxes are (doc_id, page, id, line_no, x, y, w, h, text). What can be told from counts of covered bins is told by
aggregates and windows over the bins of a page; the cuts of the reading order recurse, so they work on a page at a time.
A page is the largest group that is held at once. Boxes with a null coordinate are left out.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 4.0  # points of a bin
LEAST_GAP, LEAST_LINES = 12.0, 3  # width of a gutter, lines that have to stand on either side of it
COVER = 0.1  # share of a page's lines that may cross a gutter


def _boxes(d: DataFrame) -> DataFrame:
    return d.where("x is not null and y is not null and w > 0 and h > 0")


def gutters(d: DataFrame) -> DataFrame:
    """(doc_id, page, left, right): inner runs of bins that at most COVER of the lines cover, as wide as LEAST_GAP or wider, with
    LEAST_LINES lines on either side."""
    b = _boxes(d).select("doc_id", "page", "line_no", "x", "w")
    page = Window.partitionBy("doc_id", "page")
    span = b.groupBy("doc_id", "page").agg(F.floor(F.min("x") / BIN).cast("int").alias("lo"), F.ceil(F.max(F.col("x") + F.col("w")) / BIN).cast("int").alias("hi"), F.countDistinct("line_no").alias("lines"))
    covered = b.select("doc_id", "page", "line_no", F.explode(F.sequence(F.floor(F.col("x") / BIN).cast("int"), F.ceil((F.col("x") + F.col("w")) / BIN).cast("int") - 1)).alias("bin")).distinct()
    n = covered.groupBy("doc_id", "page", "bin").agg(F.count("*").alias("n"))
    every = span.select("*", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("bin")).join(n, ["doc_id", "page", "bin"], "left").fillna(0, ["n"])
    free = every.where(F.col("n") <= COVER * F.col("lines"))
    isle = F.col("bin") - F.row_number().over(page.orderBy("bin"))
    runs = free.withColumn("isle", isle).groupBy("doc_id", "page", "isle").agg(F.min("bin").alias("a"), (F.max("bin") + 1).alias("z"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    runs = runs.where((F.col("a") > F.col("lo")) & (F.col("z") < F.col("hi")) & ((F.col("z") - F.col("a")) * BIN >= LEAST_GAP)).select("doc_id", "page", (F.col("a") * BIN).alias("left"), (F.col("z") * BIN).alias("right"))
    sides = runs.join(b, ["doc_id", "page"]).groupBy("doc_id", "page", "left", "right").agg(F.countDistinct(F.when(F.col("x") + F.col("w") <= F.col("left") + BIN, F.col("line_no"))).alias("l"), F.countDistinct(F.when(F.col("x") >= F.col("right") - BIN, F.col("line_no"))).alias("r"))
    return sides.where((F.col("l") >= LEAST_LINES) & (F.col("r") >= LEAST_LINES)).select("doc_id", "page", "left", "right")


def columns(d: DataFrame) -> DataFrame:
    """(doc_id, page, id, column): the column of each box, by the gutters left of its middle; 1 on a page without gutters."""
    b = _boxes(d).select("doc_id", "page", "id", (F.col("x") + F.col("w") / 2).alias("middle"))
    g = gutters(d).select("doc_id", "page", "left")
    return b.join(g, ["doc_id", "page"], "left").groupBy("doc_id", "page", "id").agg((F.count_if(F.col("middle") > F.col("left")) + 1).alias("column"))


def _cut(boxes: list[tuple], gap_x: float, gap_y: float) -> list[tuple]:
    """Boxes (x, y, right, bottom, id) in reading order: cut at the widest free band, across first where it is as wide."""
    if len(boxes) < 2:
        return boxes

    def widest(lo: int, hi: int) -> tuple[float, float]:
        best, reach = (0.0, 0.0), None
        for b in sorted(boxes, key=lambda b: (b[lo], b[hi])):
            if reach is not None and b[lo] - reach > best[0]:
                best = (b[lo] - reach, (b[lo] + reach) / 2)
            reach = b[hi] if reach is None else max(reach, b[hi])
        return best

    (wx, ax), (wy, ay) = widest(0, 2), widest(1, 3)
    if wx >= gap_x and wx / gap_x >= wy / gap_y:
        return _cut([b for b in boxes if b[2] <= ax], gap_x, gap_y) + _cut([b for b in boxes if b[2] > ax], gap_x, gap_y)
    if wy >= gap_y:
        return _cut([b for b in boxes if b[3] <= ay], gap_x, gap_y) + _cut([b for b in boxes if b[3] > ay], gap_x, gap_y)
    return sorted(boxes, key=lambda b: (b[1], b[0], b[4]))


def _order(key: tuple, t: pa.Table) -> pa.Table:
    boxes = sorted(zip(*(t.column(c).to_pylist() for c in ("x", "y", "r", "b", "id"))))
    heights = sorted(b[3] - b[1] for b in boxes)
    gap = max(heights[len(heights) // 2], 1.0)
    ids = [b[4] for b in _cut(boxes, LEAST_GAP, gap)]
    n = len(ids)
    return pa.table({"doc_id": pa.array([key[0].as_py()] * n, pa.int64()), "page": pa.array([key[1].as_py()] * n, pa.int32()), "id": pa.array(ids, pa.int64()), "rank": pa.array(range(1, n + 1), pa.int64())})


def reading_order(d: DataFrame) -> DataFrame:
    """(doc_id, page, id, rank): the boxes of each page in the order of recursive cuts along free bands."""
    b = _boxes(d).select("doc_id", "page", "id", "x", "y", (F.col("x") + F.col("w")).alias("r"), (F.col("y") + F.col("h")).alias("b")).dropDuplicates(["id"])
    return b.groupBy("doc_id", "page").applyInArrow(_order, "doc_id long, page int, id long, rank long")


CELL = 12  # characters of a table's cell, in the median; no cell has more than twice that
ROWS = 3  # rows of a table


def table_rows(d: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, cells, chars): lines of two short cells or more."""
    line = _boxes(d).where("text <> ''").groupBy("doc_id", "page", "line_no").agg(F.count("*").alias("cells"), F.expr("percentile(length(text), 0.5)").alias("middle"), F.max(F.length("text")).alias("most"), F.sum(F.length("text")).alias("chars"))
    return line.where((F.col("cells") >= 2) & (F.col("middle") <= CELL) & (F.col("most") <= 2 * CELL)).select("doc_id", "page", "line_no", "cells", "chars")


def tables(d: DataFrame) -> DataFrame:
    """(doc_id, page, first, last, rows, cells): runs of ROWS or more lines of a page that follow each other as rows."""
    r = table_rows(d)
    isle = F.col("line_no") - F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("line_no"))
    g = r.withColumn("isle", isle).groupBy("doc_id", "page", "isle").agg(F.min("line_no").alias("first"), F.max("line_no").alias("last"), F.count("*").alias("rows"), F.max("cells").alias("cells"))
    return g.where(F.col("rows") >= ROWS).select("doc_id", "page", "first", "last", "rows", "cells")


def fingerprint(text: str) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(text), r"\d+", "#"), r"\s+", " "))


def margins(d: DataFrame) -> DataFrame:
    """(doc_id, page, id, line_no, text, band): boxes of the first and last line of each page."""
    page = Window.partitionBy("doc_id", "page")
    e = d.where("text <> '' and line_no is not null").withColumn("top", F.min("line_no").over(page)).withColumn("bottom", F.max("line_no").over(page))
    return e.where("line_no = top or line_no = bottom").select("doc_id", "page", "id", "line_no", "text", F.when(F.col("line_no") == F.col("top"), "header").otherwise("footer").alias("band"))


LEAST_PAGES, LEAST_SHARE = 3, 0.25  # fixed values: pages, and share of the pages, on which a margin line repeats


def furniture(d: DataFrame) -> DataFrame:
    """(doc_id, print, pages): margin lines, digits masked, that stand on enough pages of their document."""
    votes = margins(d).select("doc_id", "page", fingerprint("text").alias("print")).distinct().groupBy("doc_id", "print").agg(F.count("*").alias("votes"))
    pages = d.groupBy("doc_id").agg(F.countDistinct("page").alias("pages"))
    return votes.join(pages, "doc_id").where(F.col("votes") >= F.greatest(F.lit(LEAST_PAGES), F.floor(F.col("pages") * LEAST_SHARE))).select("doc_id", "print", F.col("votes").alias("pages"))


def classified(d: DataFrame) -> DataFrame:
    """(id, kind) of margin boxes: page number by its form, header or footer by repetition, else body."""
    number = F.regexp_replace(F.col("text"), r"[^0-9A-Za-z]", " ")
    m = margins(d).withColumn("print", fingerprint("text")).join(furniture(d).select("doc_id", "print", F.lit(True).alias("repeats")), ["doc_id", "print"], "left")
    kind = F.when(F.lower(F.trim(number)).rlike("^([0-9]{1,4}|[ivxlcdm]+)$"), "page number").when(F.col("repeats"), F.col("band")).otherwise("body")
    return m.select("id", kind.alias("kind"))


def analyzed(d: DataFrame) -> DataFrame:
    """(doc_id, page, boxes, lines, columns, tables, furniture) of every page, in two passes: what repeats in a document is
    counted before its pages are told apart."""
    key = ["doc_id", "page"]
    base = _boxes(d).groupBy(*key).agg(F.countDistinct("id").alias("boxes"), F.countDistinct("line_no").alias("lines"))
    g = gutters(d).groupBy(*key).agg((F.count("*") + 1).alias("columns"))
    t = tables(d).groupBy(*key).agg(F.count("*").alias("tables"))
    f = classified(d).where("kind <> 'body'").join(d.select("id", *key).distinct(), "id").groupBy(*key).agg(F.countDistinct("id").alias("furniture"))
    return base.join(g, key, "left").join(t, key, "left").join(f, key, "left").fillna(1, ["columns"]).fillna(0, ["tables", "furniture"])


def documents(pages: DataFrame) -> DataFrame:
    """(doc_id, pages, columns, tables, furniture): the layout of each document, with the most common number of columns."""
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.mode("columns", True).alias("columns"), F.sum("tables").alias("tables"), F.sum("furniture").alias("furniture"))
