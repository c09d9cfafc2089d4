"""Text cut off by field limits or during transfer (problem 9).

Per source and text column the lengths of the values are counted in characters and in bytes. A length that holds far
more values than its neighbourhood is a spike, left by a limit of that source. Two verdicts follow:

* `limit`: the value stands at a spike of its source and column and has no terminal punctuation: no sentence end,
  result of a game, closing bracket or year. A mark added at the cut is no terminal punctuation, nor is the point of a
  bare move number, nor the glyph of an annotated move in a line of moves.
* `transfer`: the value stands at no spike, as a broken transfer stops at any length, and closes in no form of its
  kind: the terminal forms, or a signature or an entry of a list.

Null and empty values are no cases and in no histogram. A null source is a source of its own. Repeated rows count once
per key in `cut_texts`' result and every time in the histograms. Ties: every length over the bound is a spike. A
value of any length is read whole. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NEAR = 50  # lengths on either side that make the neighbourhood
LEAST = 5  # texts at a spike at least
TIMES = 6.0  # times the neighbourhood's mean

# Closing forms.
RESULT = r"(?:^|[\s.])(?:1-0|0-1|1/2-1/2|½-½|\*)$"
MARK = r"(?:\.\.\.|…|\[…\]|\(…\)|\[cut\]|>>|->)$"
SENTENCE = r"[.!?]['\"»”’)\]]*$"
MOVE_NUMBER = r"(?:^|[\s(])\d{1,3}\.$"
ANNOTATED = r"(?:^|[\s.])(?:[KQRBNDTSLCFAPКФЛС]|Кр)?[a-h]?[1-8]?x?[a-h][1-8](?:=[A-ZА-Я])?[+#]?[!?]+$"
PLACE_DATE = r"^[^\n]{2,60}, \d{4}$"
SIGNATURE = r"^\s*[—–-]{1,2} ?\p{Lu}[\p{L}.' -]+$"
PLACE = r"\([^()]+\)$"
ENTRY = r"^\s*(?:\d+[.)]|[-*•])\s+\S.*(?:\s\d{4}|\s\d+\.\d|\s\d+½|\s½|\))$"


def endings(df: DataFrame, key: str, source: str, *texts: str) -> DataFrame:
    """(key, source, field, chars, bytes, ending) of every value: how it closes, '' where it closes in no form."""
    one = df.select(F.col(key).alias("key"), F.col(source).alias("source"), F.explode(F.array(*[F.struct(F.lit(t).alias("field"), F.col(t).alias("text")) for t in texts])).alias("v")).select("key", "source", "v.*")
    d = one.where("text <> ''").select("key", "source", "field", F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), F.regexp_replace("text", r"[\s\x{200b}\x{feff}]+$", "").alias("t"))
    line = F.element_at(F.split("t", "\n"), -1)
    kind = (
        F.when(line.rlike(RESULT), "result")
        .when(line.rlike(MARK), "")
        .when(line.rlike(MOVE_NUMBER), "")
        .when(line.rlike(ANNOTATED), "")
        .when(line.rlike(SENTENCE) & ~line.rlike(ENTRY), "sentence")
        .when(line.rlike(ENTRY), "entry")
        .when(line.rlike(PLACE), "place")
        .when(line.rlike(SIGNATURE), "signature")
        .when(line.rlike(PLACE_DATE), "date")
        .otherwise("")
    )
    return d.select("key", "source", "field", "chars", "bytes", kind.alias("ending"))


def spikes(ends: DataFrame) -> DataFrame:
    """(source, field, unit, length, n): lengths at which the values of a source's column heap up."""
    long = ends.select("source", "field", F.explode(F.create_map(F.lit("chars"), F.col("chars"), F.lit("bytes"), F.col("bytes"))).alias("unit", "length"))
    hist = long.groupBy("source", "field", "unit", "length").agg(F.count("*").alias("n"))
    w = Window.partitionBy("source", "field", "unit").orderBy("length").rangeBetween(-NEAR, NEAR)  # a row a length
    mean = (F.sum("n").over(w) - F.col("n")) / F.lit(2.0 * NEAR)
    return hist.withColumn("mean", mean).where((F.col("n") >= LEAST) & (F.col("n") > TIMES * F.col("mean") + 3 * F.sqrt("mean") + 2)).select("source", "field", "unit", "length", "n")


TERMINAL = ("sentence", "result", "place", "date")  # what a value at a limit must end in to be whole
CLOSING = (*TERMINAL, "signature", "entry")  # what one at any other length may end in


def cut_texts(df: DataFrame, key: str, source: str, *texts: str) -> DataFrame:
    """Every value with (key, source, field, chars, bytes, ending, at_spike, verdict, cut); verdict: limit, transfer or whole."""
    ends = endings(df, key, source, *texts)
    sp = spikes(ends)
    out = ends
    for unit in ("chars", "bytes"):
        s = sp.where(F.col("unit") == unit).select(F.col("source").alias("s"), F.col("field").alias("f"), F.col("length").alias("l"), F.lit(True).alias(f"spike_{unit}"))
        out = out.join(s, F.col("source").eqNullSafe(F.col("s")) & (F.col("field") == F.col("f")) & (F.col(unit) == F.col("l")), "left").drop("s", "f", "l")
    at = F.coalesce("spike_chars", "spike_bytes", F.lit(False))
    verdict = F.when(at, F.when(F.col("ending").isin(*TERMINAL), "whole").otherwise("limit")).when(F.col("ending").isin(*CLOSING), "whole").otherwise("transfer")
    return out.select("key", "source", "field", "chars", "bytes", "ending", at.alias("at_spike"), verdict.alias("verdict"), (verdict != "whole").alias("cut"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id of the documents that were cut."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return cut_texts(docs, "doc_id", "source", "text").where("cut").select(F.col("key").alias("doc_id")).distinct()


def _rates(c: DataFrame) -> DataFrame:
    n = F.count("*")
    return c.groupBy("source").agg(
        n.alias("documents"), F.count_if("cut").alias("cut_documents"), F.count_if(F.col("verdict") == "limit").alias("at_limit"), F.count_if(F.col("verdict") == "transfer").alias("in_transfer"),
        F.count_if("at_spike").alias("at_spike"), F.round(F.count_if("cut") / n, 4).alias("cut_share"),
    )


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: documents, cut documents by verdict, documents at a spike, share of cut ones."""
    return _rates(cut_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "source", "text"))


def p9_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limits of the sources: source, unit, length, how many documents stand there."""
    ends = endings(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "source", "text")
    return spikes(ends).select("source", "unit", "length", "n")


def _duck_kinds() -> str:
    rules = [(RESULT, "result"), (MARK, ""), (MOVE_NUMBER, ""), (ANNOTATED, "")]
    q = lambda p: p.replace("'", "''")
    first = " ".join(f"when regexp_matches(line, '{q(p)}') then '{k}'" for p, k in rules)
    rest = " ".join(f"when regexp_matches(line, '{q(p)}') then '{k}'" for p, k in ((ENTRY, "entry"), (PLACE, "place"), (SIGNATURE, "signature"), (PLACE_DATE, "date")))
    return f"case {first} when regexp_matches(line, '{q(SENTENCE)}') and not regexp_matches(line, '{q(ENTRY)}') then 'sentence' {rest} else '' end"


_ENDS = f"select doc_id, source, chars, bytes, {_duck_kinds()} as ending from (select doc_id, source, length(text) as chars, strlen(text) as bytes, list_extract(string_split(regexp_replace(text, '[\\s]+$', ''), chr(10)), -1) as line from documents where text <> '') t"
_HEAPS = (
    "select source, unit, length, n from (select source, unit, length, n, (sum(n) over (partition by source, unit order by length range between 50 preceding and 50 following) - n) / 100.0 as m from "
    "(select source, 'c' as unit, chars as length, count(*) as n from ends group by all union all select source, 'b', bytes, count(*) from ends group by all) h) w where n >= 5 and n > 6 * m + 3 * sqrt(m) + 2"
)
_JUDGED = (
    f"with ends as ({_ENDS}), sp as ({_HEAPS}), f as (select e.*, exists (select 1 from sp where sp.source is not distinct from e.source and ((unit = 'c' and sp.length = e.chars) or (unit = 'b' and sp.length = e.bytes))) as at_s from ends e), "
    "g as (select doc_id, source, at_s, (at_s and ending not in ('sentence', 'result', 'place', 'date')) as lim, (not at_s and ending = '') as tra from f) "
)
SQL = {
    "p9_found": _JUDGED + "select distinct doc_id from g where lim or tra",
    "p9_rates": _JUDGED
    + "select source, count(*) as documents, cast(sum((lim or tra)::int) as bigint) as cut_documents, cast(sum(lim::int) as bigint) as at_limit, cast(sum(tra::int) as bigint) as in_transfer, cast(sum(at_s::int) as bigint) as at_spike, "
    "round(sum((lim or tra)::int)::double / count(*), 4) as cut_share from g group by source",
    "p9_limits": f"with ends as ({_ENDS}), sp as ({_HEAPS}) select source, case unit when 'c' then 'chars' else 'bytes' end as unit, length::int as length, n from sp",
}
