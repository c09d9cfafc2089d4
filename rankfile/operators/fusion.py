"""Several readings of one region: which engine's to take, and one text out of all of them, token by token.

A reading is (region, source, level, score, text). Readings of a region are few, so a region is one group. Null texts are
no readings; a region with one reading is that reading.
"""

from __future__ import annotations

import difflib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of confidence, plausibility and agreement; the score that ends the cascade; readings asked for at most.
WEIGHTS = (0.45, 0.35, 0.20)
ENOUGH, TRIES = 0.75, 3


def score(confidence: Column, plausibility: Column, agreement: Column) -> Column:
    """Weighted mean of the terms that are there; null without any."""
    terms = list(zip(WEIGHTS, (confidence, plausibility, agreement)))
    total = sum((F.when(t.isNotNull(), w).otherwise(0.0) for w, t in terms), F.lit(0.0))
    return F.try_divide(sum((F.coalesce(w * t, F.lit(0.0)) for w, t in terms), F.lit(0.0)), F.nullif(total, F.lit(0.0)))


def arbitrated(readings: DataFrame) -> DataFrame:
    """(region, source, score, asked): of the readings in the order of their levels, the first that scores ENOUGH, else the best
    of the first TRIES; asked counts the readings up to it. Ties go to the earlier level, then to the name."""
    order = Window.partitionBy("region").orderBy("level", "source")
    r = readings.where("text is not null").withColumn("i", F.row_number().over(order)).where(F.col("i") <= TRIES)
    r = r.withColumn("first", F.min(F.when(F.col("score") >= ENOUGH, F.col("i"))).over(Window.partitionBy("region")))
    best = F.row_number().over(Window.partitionBy("region").orderBy(F.desc_nulls_last("score"), "i"))
    asked = F.coalesce("first", F.max("i").over(Window.partitionBy("region")))
    return r.withColumn("b", best).withColumn("asked", asked).where("i = first or (first is null and b = 1)").select("region", "source", "score", "asked")


def folded(token: str) -> str:
    return token.lower().strip(".,;:!?()[]").translate(str.maketrans("‐‑–—−0", "-----o"))


def fuse(readings: list[tuple[str, float, str]]) -> list[tuple[str, int, int, bool]]:
    """(token, readings that have it, readings asked, disputed) along the best-scored reading (source, score, text): at each of
    its tokens the aligned tokens of the others vote with their scores; it keeps its own unless they outweigh it."""
    ordered = sorted(readings, key=lambda r: (-r[1], r[0]))
    if not ordered:
        return []
    anchor = ordered[0][2].split()
    votes: list[list[tuple[str, float]]] = [[(t, ordered[0][1])] for t in anchor]
    keys = [folded(t) for t in anchor]
    for _, weight, text in ordered[1:]:
        other = text.split()
        for op, a, b, c, d in difflib.SequenceMatcher(None, keys, [folded(t) for t in other], autojunk=False).get_opcodes():
            if op == "equal" or op == "replace" and b - a == d - c:
                for k in range(b - a):
                    votes[a + k].append((other[c + k], weight))
    out = []
    for own, vote in zip(anchor, votes):
        sums: dict[str, float] = {}
        for t, w in vote:
            sums[folded(t)] = sums.get(folded(t), 0.0) + w
        best = max(sums, key=lambda f: (sums[f], f == folded(own)))
        token = own if best == folded(own) else next(t for t, _ in vote if folded(t) == best)
        out.append((token, sum(folded(t) == best for t, _ in vote), len(vote), len(sums) > 1))
    return out


def _fused(key: tuple, t: pa.Table) -> pa.Table:
    rows = fuse([(s, w or 0.0, x) for s, w, x in zip(*(t.column(c).to_pylist() for c in ("source", "score", "text")))])
    n = len(rows)
    return pa.table({"region": pa.array([key[0].as_py()] * n, pa.int64()), "i": pa.array(range(n), pa.int32()), "token": pa.array([r[0] for r in rows], pa.string()), "votes": pa.array([r[1] for r in rows], pa.int32()), "readings": pa.array([r[2] for r in rows], pa.int32()), "disputed": pa.array([r[3] for r in rows], pa.bool_())})


def fused(readings: DataFrame) -> DataFrame:
    """(region, i, token, votes, readings, disputed) of every region."""
    r = readings.where("text is not null").select("region", "source", "score", "text").dropDuplicates(["region", "source"])
    return r.groupBy("region").applyInArrow(_fused, "region long, i int, token string, votes int, readings int, disputed boolean")


def fusion_summary(tokens: DataFrame) -> DataFrame:
    """(region, tokens, disputed, agreement): counts of a region's tokens, and the mean share of readings behind them."""
    return tokens.groupBy("region").agg(F.count("*").alias("tokens"), F.count_if("disputed").alias("disputed"), F.round(F.avg(F.col("votes") / F.col("readings")), 6).alias("agreement"))
