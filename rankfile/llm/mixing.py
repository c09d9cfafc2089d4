"""Mixing sources to target weights (problem 8).

Sizes are tokens of a public tokenizer. Documents fall into cells (source, language, topic). Iterative proportional
fitting rakes one weight per cell (the expected number of copies of each of its documents) to the marginals: the
target shares of the sources, and the corpus' own shares of languages and topics. No weight exceeds its source's
`max_repeats`; a last step meets the source marginals exactly by raising the weights under that cap. The total is
the largest one at which every source with documents can meet its share, unless given.

Documents are then sampled by these calibrated weights, systematically: within a source, in the order of size, the
running sum of weights is cut at whole numbers, which gives each document the floor or the ceiling of its weight as
copies. Large sources are split into buckets by the hash of the key, each of about BUCKET documents, so no source
is ever one task, and each bucket is off by one document at most.

Sources without a target and documents without a source are left out (copies 0). Targeted sources without documents
get no tokens, are reported with actual share 0, and their share is spread over the others in proportion. Null or
empty texts have 0 tokens and are left out. A label that names no language is the language 'und'. A repeated key counts
once. As the last step meets the sources, languages and topics are met up to a residual, which `marginals` reports.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written
from .language import label_code

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
BUCKET = 20_000
STEPS = 100
#: Fixed value: the public word pattern of this family of vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _count_tokens(path: str):
    def f(batches):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        enc = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) for t in batch.column("text").to_pylist()]
            keep = [batch.column(c) for c in batch.schema.names if c != "text"]
            yield pa.record_batch([*keep, pa.array(n, pa.int64())], names=[*(c for c in batch.schema.names if c != "text"), "tokens"])

    return f


def topic(text: str):
    """list, game, questions or article, by the text's lines."""
    t = F.col(text)
    return (
        F.when(t.rlike(r"(?m)^\d+[.)] \S.*\n\d+[.)] \S"), "list")
        .when(t.rlike(r"\d+\.\S+ \S+ \d+\.\S+ \S+ \d+\.\S+"), "game")
        .when(t.rlike(r"(?m)(\?\s*$|^(Answer|Lösung|Solución|Solution|Solução|Ответ):)"), "questions")
        .otherwise("article")
    )


def sized(docs: DataFrame, key: str, source: str, lang: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, source, lang, topic, tokens), one row a key, of the documents with text and source."""
    d = docs.where(F.col(text).isNotNull() & (F.col(text) != "") & F.col(source).isNotNull())
    d = d.select(F.col(key).alias("key"), F.col(source).alias("source"), F.coalesce(label_code(lang), F.lit("und")).alias("lang"), topic(text).alias("topic"), F.col(text).alias("text"))
    d = d.mapInArrow(_count_tokens(tokenizer), "key long, source string, lang string, topic string, tokens long")
    return d.groupBy("key").agg(*(F.min(c).alias(c) for c in ("source", "lang", "topic", "tokens")))


def rake(cells: list[tuple[str, str, str, int]], share: dict[str, float], cap: dict[str, int], total: float | None = None) -> tuple[dict[tuple[str, str, str], float], float]:
    """(weight of each cell, total tokens aimed at). cells: (source, lang, topic, tokens) of targeted sources."""
    cells = [c for c in cells if c[3] > 0 and share.get(c[0], 0) > 0 and cap.get(c[0], 0) > 0]
    if not cells:
        return {}, 0.0
    size = np.array([c[3] for c in cells], float)
    most = np.array([cap[c[0]] for c in cells], float)
    dims = [np.array([c[k] for c in cells]) for k in range(3)]
    have = {s: size[dims[0] == s].sum() for s in set(dims[0])}
    there = sum(share[s] for s in have)
    room = min(cap[s] * n / (share[s] / there) for s, n in have.items())
    total = room if total is None else min(total, room)
    goals = [{s: total * share[s] / there for s in have}, *({v: total * size[d == v].sum() / size.sum() for v in set(d)} for d in dims[1:])]
    w = np.minimum(total / size.sum(), most)
    for _ in range(STEPS):
        for d, goal in zip(dims[::-1], goals[::-1]):
            for v, g in goal.items():
                m = d == v
                w[m] = np.minimum(w[m] * g / max((w[m] * size[m]).sum(), 1e-12), most[m])
    for s, g in goals[0].items():  # meet the source exactly, raising the weights under the cap
        m = dims[0] == s
        low, high = 0.0, most[m].max() / max(w[m].min(), 1e-12)
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if (np.minimum(mid * w[m], most[m]) * size[m]).sum() < g else (low, mid)
        w[m] = np.minimum(high * w[m], most[m])
    return {c[:3]: float(x) for c, x in zip(cells, w)}, float(total)


def mixture(docs: DataFrame, targets: DataFrame, key: str, source: str, lang: str, text: str, total: float | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, source, lang, topic, tokens, weight, copies) of every document of a targeted source."""
    spark = docs.sparkSession
    goals = {r[0]: (float(r[1]), int(r[2])) for r in targets.where("source is not null and target_share > 0").select("source", "target_share", F.coalesce("max_repeats", F.lit(1))).collect()}
    d = written(sized(docs, key, source, lang, text, tokenizer).join(F.broadcast(targets.select("source").distinct()), "source", "left_semi"), "p8-sized")
    cells = d.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).collect()  # targets x languages x topics
    weights, _ = rake([(r["source"], r["lang"], r["topic"], r["tokens"]) for r in cells], {s: g[0] for s, g in goals.items()}, {s: g[1] for s, g in goals.items()}, total)
    count: dict[str, int] = {}
    for r in cells:
        count[r["source"]] = count.get(r["source"], 0) + r["n"]
    rows = [(*c, w, max(1, round(count[c[0]] / BUCKET))) for c, w in weights.items()] or [("", "", "", 0.0, 1)]
    table = spark.createDataFrame(rows, "source string, lang string, topic string, weight double, buckets int")
    d = d.join(F.broadcast(table), ["source", "lang", "topic"], "left").fillna({"weight": 0.0, "buckets": 1})
    d = d.withColumn("bucket", F.pmod(F.xxhash64("key"), F.col("buckets")))
    w = Window.partitionBy("source", "bucket").orderBy("tokens", "key").rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum("weight").over(w)
    copies = F.floor(run + 0.5 + 1e-9) - F.floor(run - F.col("weight") + 0.5 + 1e-9)
    return d.select("key", "source", "lang", "topic", "tokens", "weight", copies.cast("int").alias("copies"))


def shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """Per targeted source: target share, documents, documents used, copies, the most of one document, tokens, actual share."""
    per = mix.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("copies") > 0).alias("used"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"), F.sum(F.col("copies") * F.col("tokens")).alias("tokens"))
    t = targets.select("source", "target_share", "max_repeats").distinct().join(per, "source", "left").fillna(0, ["documents", "used", "copies", "most_copies", "tokens"])
    all_tokens = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # a row a targeted source
    return t.withColumn("actual_share", F.when(all_tokens > 0, F.round(F.col("tokens") / all_tokens, 6)).otherwise(F.lit(0.0)))


def marginals(mix: DataFrame) -> DataFrame:
    """Per language and topic: its share of the tokens of the targeted sources (the wanted one), of the mixture, and
    what is left between them. An empty mixture has shares of 0."""
    long = mix.select("tokens", "copies", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in ("lang", "topic")])).alias("v")).select("tokens", "copies", "v.*")
    per = long.groupBy("dimension", "value").agg(F.sum("tokens").alias("there"), F.sum(F.col("copies") * F.col("tokens")).alias("tokens"))
    w = Window.partitionBy("dimension")  # a row a language or topic
    wanted, actual = (F.round(F.coalesce(F.try_divide(F.col(c), F.sum(c).over(w)), F.lit(0.0)), 6) for c in ("there", "tokens"))
    return per.select("dimension", "value", "tokens", wanted.alias("wanted_share"), actual.alias("actual_share")).withColumn("residual", F.round(F.col("actual_share") - F.col("wanted_share"), 6))


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/mix_targets.parquet")


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, tokens, copies of the documents in the mixture."""
    docs, targets = _tables(spark, sf_dir)
    return mixture(docs, targets, "doc_id", "source", "lang", "text").where("copies > 0").select(F.col("key").alias("doc_id"), "source", "tokens", "copies")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of every source of mix_targets."""
    docs, targets = _tables(spark, sf_dir)
    return shares(mixture(docs, targets, "doc_id", "source", "lang", "text"), targets)


def p8_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted and actual shares of languages and topics, and their residuals."""
    docs, targets = _tables(spark, sf_dir)
    return marginals(mixture(docs, targets, "doc_id", "source", "lang", "text"))
