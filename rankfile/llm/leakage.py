"""Evaluation texts leaking into training text (problem 7).

The normalised runs of `run` words of all test items form a set of 64-bit hashes. The set is broadcast if it is
under MAX_BROADCAST hashes (its size is counted first), and every corpus text is scanned in one pass, without a
shuffle: the hashes of its word windows are looked up in the set and each hit is verified on the words. A larger
set is joined by hash instead, with the same result: the windows' hashes are shuffled, and only windows that hit are
read again and verified.

Null and empty texts, and items shorter than the run, are in no pair. A repeated row, or a passage that stands
several times in a text, counts once. If several items share a run, each of them is reported.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from .words import WORD, run_hashes, run_owner, word_hashes, word_spans

RUN = 10
SPOTS = 1_000_000  # leaked windows that are broadcast to be cut out, 8 MB; more are joined by document
MAX_BROADCAST = 4_000_000  # hashes; 32 MB


def _item_runs(run: int):
    """(hash, item_id, words joined by a space) of every run of an item."""

    def f(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            hashes, ends = word_hashes(texts)
            at, owner = run_owner(ends, run, len(hashes))
            keys = run_hashes(hashes, run)[at].view(np.int64) if len(at) else np.empty(0, np.int64)
            words = [w for t in texts for w in (WORD.findall(t.lower()) if t else ())]
            yield pa.record_batch([pa.array(keys), pa.array([ids[i] for i in owner], pa.int64()), pa.array([" ".join(words[i : i + run]) for i in at], pa.string())], names=["hash", "item_id", "words"])

    return f


def _scan(run: int, known):
    """(doc_id, start, hash) for each window of a text whose hash is known; all windows if known is None."""

    def f(batches):
        table = known.value if known is not None else None
        for batch in batches:
            hashes, ends = word_hashes(batch.column(1).to_pylist())
            at, owner = run_owner(ends, run, len(hashes))
            if not len(at):
                continue
            keys = run_hashes(hashes, run)[at]
            if table is not None:
                place = np.minimum(np.searchsorted(table, keys), len(table) - 1)
                hit = table[place] == keys if len(table) else np.zeros(len(keys), bool)
                at, owner, keys = at[hit], owner[hit], keys[hit]
            yield pa.record_batch([batch.column(0).take(pa.array(owner)), pa.array(at - ends[owner], pa.int64()), pa.array(keys.view(np.int64))], names=["doc_id", "start", "hash"])

    return f


def _said(run: int):
    """(doc_id, start, words joined by a space) of the windows of a text that are asked for."""

    def f(batches):
        for batch in batches:
            ids, firsts, said = [], [], []
            for doc, text, starts in zip(*(batch.column(k).to_pylist() for k in range(3))):
                words = WORD.findall(text.lower())
                for s in starts:
                    if s + run <= len(words):
                        ids.append(doc)
                        firsts.append(s)
                        said.append(" ".join(words[s : s + run]))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(firsts, pa.int64()), pa.array(said, pa.string())], names=["doc_id", "start", "words"])

    return f


def _starts(hits: DataFrame) -> DataFrame:
    """(doc_id, starts): the windows of each document, as many as its own words at most."""
    return hits.groupBy("doc_id").agg(F.sort_array(F.collect_set("start")).alias("starts"))


def _with_starts(docs: DataFrame, hits: DataFrame, how: str) -> DataFrame:
    """(doc_id, text, starts): documents beside their windows; few windows are broadcast, so that no text is shuffled."""
    spots = written(_starts(hits), "p7-starts")
    few = (spots.agg(F.sum(F.size("starts"))).first()[0] or 0) <= SPOTS
    return docs.join(F.broadcast(spots) if few else spots, "doc_id", how).select("doc_id", "text", "starts")


def leaks(docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str, run: int = RUN) -> DataFrame:
    """(doc_id, item_id, start): each window of a document, by its first word, that stands in an item."""
    spark = docs.sparkSession
    it = items.select(F.col(item_key).cast("long"), F.col(item_text)).where(F.col(item_text).isNotNull())
    runs = it.mapInArrow(_item_runs(run), "hash long, item_id long, words string").distinct()
    size = runs.count()
    known = None
    if size <= MAX_BROADCAST:
        keys = np.unique(np.array([r[0] for r in runs.select("hash").distinct().collect()], np.int64).view(np.uint64))
        known = spark.sparkContext.broadcast(keys)
    d = docs.select(F.col(doc_key).cast("long").alias("doc_id"), F.col(doc_text).alias("text")).where("doc_id is not null and text <> ''")
    hits = d.mapInArrow(_scan(run, known), "doc_id long, start long, hash long")
    if known is None:
        hits = hits.join(runs.select("hash").distinct(), "hash", "left_semi")
    said = _with_starts(d, hits, "inner").mapInArrow(_said(run), "doc_id long, start long, words string")
    return said.join(runs.select("words", "item_id").distinct(), "words").select("doc_id", "item_id", "start").distinct()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id: documents that share a run of ten words with an evaluation item."""
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/eval_items.parquet")
    return leaks(docs, "doc_id", "text", items, "item_id", "text").select("doc_id", "item_id").distinct()


def _cut_out(run: int):
    def f(batches):
        for batch in batches:
            ids, texts, starts = (batch.column(k).to_pylist() for k in range(3))
            clean, gone = [], []
            for t, ss in zip(texts, starts):
                if not ss or not t:
                    clean.append(t)
                    gone.append(0)
                    continue
                at = word_spans(t)
                covered = sorted({k for s in ss for k in range(s, min(s + run, len(at)))})
                parts, last = [], 0
                i = 0
                while i < len(covered):
                    j = i
                    while j + 1 < len(covered) and covered[j + 1] == covered[j] + 1:
                        j += 1
                    parts.append(t[last : at[covered[i]][0]])
                    last = at[covered[j]][1]
                    i = j + 1
                clean.append("".join([*parts, t[last:]]))
                gone.append(len(covered))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(clean, pa.string()), pa.array(gone, pa.int64())], names=["doc_id", "text", "words_removed"])

    return f


def without_leaks(docs: DataFrame, doc_key: str, doc_text: str, found: DataFrame, run: int = RUN) -> DataFrame:
    """(doc_id, text, words_removed): documents with the leaked spans taken out; others as they are. Rows that repeat
    an id with another text lose the spans of that id's texts."""
    d = docs.select(F.col(doc_key).cast("long").alias("doc_id"), F.col(doc_text).alias("text"))
    return _with_starts(d, found, "left").mapInArrow(_cut_out(run), "doc_id long, text string, words_removed long")


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item that leaks: suite, documents, windows."""
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/eval_items.parquet")
    found = leaks(docs, "doc_id", "text", items, "item_id", "text").groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("windows"))
    return found.join(items.select("item_id", "suite").distinct(), "item_id").select("item_id", "suite", "documents", "windows")


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its leaked spans: doc_id, md5 of the clean text, words removed."""
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/eval_items.parquet")
    found = written(leaks(docs, "doc_id", "text", items, "item_id", "text"), "p7-found")
    return without_leaks(docs, "doc_id", "text", found).select("doc_id", F.md5("text").alias("text_md5"), "words_removed")


_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
SQL = {
    "p7_found": f"with i as (select item_id, w, unnest(range(1, len(w) - 8)) as k from (select item_id, {_WORDS} as w from eval_items) a), d as (select doc_id, w, unnest(range(1, len(w) - 8)) as k from (select doc_id, {_WORDS} as w from documents) b) "
    "select distinct d.doc_id, i.item_id from (select distinct doc_id, array_to_string(w[k:k+9], ' ') as r from d) d join (select distinct item_id, array_to_string(w[k:k+9], ' ') as r from i) i on d.r = i.r",
}
