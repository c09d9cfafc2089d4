"""Distances of sequences, which no single expression gives, inside Arrow functions. Empty inputs have the value the
docstring names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType


def edit_distance(a: list, b: list) -> int:
    """Edit distance of two sequences."""
    if len(a) < len(b):
        a, b = b, a
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        back, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            back, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, back + (x != y))
    return row[-1]


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        back = 0
        for j, y in enumerate(b, 1):
            back, row[j] = row[j], back + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@F.pandas_udf(DoubleType())
def word_error_rate(hypothesis: pd.Series, reference: pd.Series) -> pd.Series:
    """Word edits per word of the reference; an empty reference gives 0 or 1."""
    out = []
    for h, r in zip(hypothesis, reference):
        x, y = (h or "").split(), (r or "").split()
        out.append(edit_distance(x, y) / len(y) if y else float(bool(x)))
    return pd.Series(out, dtype="float64")


@F.pandas_udf(DoubleType())
def line_accuracy(hypothesis: pd.Series, reference: pd.Series) -> pd.Series:
    """Common subsequence of lines per line of the reference; 1 without any."""
    out = []
    for h, r in zip(hypothesis, reference):
        x, y = ([" ".join(line.split()) for line in (t or "").split("\n") if line.strip()] for t in (h, r))
        out.append(lcs_length(x, y) / len(y) if y else 1.0)
    return pd.Series(out, dtype="float64")


@F.pandas_udf(IntegerType())
def common_subsequence(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(list(x or ""), list(y or "")) for x, y in zip(a, b)], dtype="int32")


def _journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/edit_journal.parquet").dropDuplicates(["edit_id"])


def wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _journal(spark, sf_dir).select("edit_id", F.round(word_error_rate("text_after", "text_before"), 6).alias("wer"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _journal(spark, sf_dir).select("edit_id", F.round(line_accuracy("text_after", "text_before"), 6).alias("line_accuracy"))


def lcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = spark.read.parquet(f"{sf_dir}/facets.parquet").select("white", "black").distinct()
    return f.select("white", "black", common_subsequence("white", "black").alias("lcs"))


QUERIES = {"o9_38_word_error_rate": wer, "o7_4_line_exact_accuracy": lines, "o7_3_lcs_length": lcs}
