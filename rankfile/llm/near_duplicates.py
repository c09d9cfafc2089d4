"""Near-duplicate records with small edits (problem 3).

Every record is a set of runs of `shingle` consecutive words. A run's 64-bit hash is a positional byte: the high 56
bits are the position, the low 8 bits the byte that stands there, so a set is a sparse string of bytes. An inverted
index lists, for each positional byte, the sets that hold it. Count filtering tallies the positional bytes that a pair
shares in the index and keeps the pairs that reach the minimum their similarity guarantees; kept pairs are verified
on the texts.

What keeps the index small and the result whole:

* Exact copies (equal sets) are one set; they never meet in the index.
* The positional bytes of a set are ordered from rare to common by a frequency sketch of bounded size. Two sets of
  sizes n <= m with Jaccard >= t share at least o = ceil(t (n + m) / (1 + t)) bytes, and o >= ceil(t m) >= ceil(t n).
  The k-th byte they share, in that order, has a rank under n - o + k in the one and under m - o + k in the other. So
  among the first n - ceil(tn) + MATCHES bytes of every set, which alone are indexed, such a pair shares at least
  min(MATCHES, o): the guaranteed minimum of the tally. A byte that the sketch counts once occurs in no other set and
  is not indexed.
* An entry carries its rank, the set's size and a bitmap of the whole set. The k-th shared byte, of ranks i and j,
  leaves at most min(n - i, m - j) shared ones, which for k <= MATCHES is over o - MATCHES; meetings under that, and
  meetings whose bitmaps prove fewer than o shared bytes, are not tallied. Both bounds are exact.
* A byte that the sketch counts more than BLOCK times is split: its sets fall into blocks by their id, and each pair of
  blocks is a key of its own, so that no task holds more than two blocks of one byte.

Null or empty texts and texts under `min_words` words are in no pair and in no group. Repeated rows of a key count
once; if a key comes with several texts, each text counts as that key's. Ties need no rule: all pairs at or over the
threshold are kept. Extra columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from ..session import written
from .words import mixed, run_hashes, run_owner, word_hashes

SLICES = 64
MAX_BITS = 26  # the frequency sketch has at most 2^26 counters, of one byte each when it is sent around
MATCHES = 2  # the tally's guaranteed minimum
BLOCK = 4096  # sets of one byte that are joined with each other at once
BITMAP = 256  # bits of a set's bitmap, in longs b0..b3
FEW = 200_000  # ids of candidates that are broadcast, 1.6 MB; more are joined by shuffle


def _i64(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint64).view(np.int64)


class Sets:
    """The run sets of the texts of a batch that have enough words: rows, and flat sorted hashes cut by `cuts`."""

    def __init__(self, texts: list, shingle: int, min_words: int):
        hashes, ends = word_hashes(texts)
        at, owner = run_owner(ends, shingle, len(hashes))
        enough = np.diff(ends) >= max(min_words, shingle)
        keep = enough[owner]
        at, owner = at[keep], owner[keep]
        runs = run_hashes(hashes, shingle)[at]
        order = np.lexsort((runs, owner))
        runs, owner = runs[order], owner[order]
        if len(runs):
            first = np.ones(len(runs), bool)
            first[1:] = (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1])
            runs, owner = runs[first], owner[first]
        self.rows, starts = np.unique(owner, return_index=True)
        self.runs, self.cuts = runs, np.append(starts, len(runs)).astype(np.int64)
        self.n = np.diff(self.cuts)
        if len(self.rows):
            total = np.add.reduceat(mixed(runs), self.cuts[:-1]) * np.uint64(0x9E3779B97F4A7C15)
            self.ids = _i64(mixed(total + self.n.astype(np.uint64)))
        else:
            self.ids = np.empty(0, np.int64)

    def only(self, keep: np.ndarray) -> None:
        """Leave the sets for which keep holds."""
        self.runs = self.runs[np.repeat(keep, self.n)]
        self.rows, self.ids, self.n = self.rows[keep], self.ids[keep], self.n[keep]
        self.cuts = np.concatenate([[0], np.cumsum(self.n)]).astype(np.int64)


def _unseen(ids: np.ndarray, seen: set[int]) -> np.ndarray:
    new = np.zeros(len(ids), bool)
    for k, i in enumerate(ids.tolist()):
        if i not in seen:
            seen.add(i)
            new[k] = True
    return new


MOST = 31 << 14  # the largest count a byte tells


def _told(n: np.ndarray) -> np.ndarray:
    """Counts as bytes that keep their order: exact under 32, then with 5 significant bits, up to MOST."""
    n = np.minimum(n, MOST).astype(np.int64)
    e = np.maximum(np.frexp(n.astype(float))[1] - 5, 0)
    return (16 * e + (n >> e)).astype(np.uint8)


def _count(told: np.ndarray) -> np.ndarray:
    """The least count that a byte tells."""
    c = told.astype(np.int64)
    e = np.maximum(c // 16 - 1, 0)
    return (c - 16 * e) << e


def _sketch_pass(shingle: int, min_words: int, bits: int):
    """Rows (key, set_id) for membership, and compressed slices of the partition's counts in blob."""
    names = ["key", "set_id", "slice", "blob"]

    def run(batches):
        counts, seen = np.zeros(1 << bits, np.uint16), set()
        for batch in batches:
            s = Sets(batch.column(1).to_pylist(), shingle, min_words)
            if not len(s.rows):
                continue
            k = len(s.rows)
            yield pa.record_batch([batch.column(0).take(pa.array(s.rows)), pa.array(s.ids), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
            s.only(_unseen(s.ids, seen))
            at, n = np.unique(s.runs >> np.uint64(64 - bits), return_counts=True)
            counts[at] = np.minimum(counts[at].astype(np.int64) + n, 65535).astype(np.uint16)
        width = (1 << bits) // SLICES
        for i in range(SLICES):
            part = counts[i * width : (i + 1) * width]
            if part.any():
                yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([i], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=names)

    return run


def _merge_slices(key: tuple, rows: pa.Table) -> pa.Table:
    """Sum of one slice's counts, as bytes. A group holds one compressed slice per scan task."""
    total = None
    for blob in rows.column("blob"):
        x = np.frombuffer(zlib.decompress(blob.as_py()), np.uint16).astype(np.uint32)
        total = x if total is None else np.minimum(total + x, np.uint32(MOST))
    return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "blob": pa.array([zlib.compress(_told(total).tobytes(), 1)], pa.binary())})


OFF, HIGH, RANK = 1 << 30, 1 << 29, (1 << 29) - 1  # of n_rank's low half: entry of two blocks, from the higher of them, rank


def _cells(runs: np.ndarray, ids: np.ndarray, counts: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, key, flags): an entry's keys in the index. A byte of many sets has a key for each pair of their blocks;
    two sets meet once, under the key of their blocks."""
    blocks = -(-counts // block)
    of = np.repeat(np.arange(len(runs)), blocks)
    other = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    own = (ids[of].view(np.uint64) % blocks[of].astype(np.uint64)).astype(np.int64)
    cell = (np.minimum(own, other) << 20 | np.maximum(own, other)).astype(np.uint64)
    split = blocks[of] > 1
    key = np.where(split, mixed(runs[of] + cell * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)), runs[of])
    return of, key, np.where(split & (own != other), OFF, 0) | np.where(split & (own > other), HIGH, 0)


def _index_pass(shingle: int, min_words: int, bits: int, t: float, block: int, sketch):
    def run(batches):
        width = (1 << bits) // SLICES
        freq, seen = np.zeros(1 << bits, np.uint8), set()
        for i, blob in sketch.value.items():
            freq[i * width : (i + 1) * width] = np.frombuffer(zlib.decompress(blob), np.uint8)
        for batch in batches:
            s = Sets(batch.column(0).to_pylist(), shingle, min_words)
            s.only(_unseen(s.ids, seen))
            if not len(s.rows):
                continue
            df = freq[(s.runs >> np.uint64(64 - bits)).astype(np.int64)]
            least = np.ceil(t * s.n - 1e-9).astype(np.int64)
            able = np.add.reduceat((df > 1).astype(np.int64), s.cuts[:-1]) >= least  # else too few of its runs occur elsewhere
            df = df[np.repeat(able, s.n)]
            s.only(able)
            if not len(s.rows):
                continue
            longest = s.n - least[able] + MATCHES
            owner = np.repeat(np.arange(len(s.n)), s.n)
            bit = s.runs % np.uint64(BITMAP)
            one = np.uint64(1) << (bit & np.uint64(63))
            maps = [np.bitwise_or.reduceat(np.where(bit >> np.uint64(6) == k, one, np.uint64(0)), s.cuts[:-1]) for k in range(BITMAP // 64)]
            order = np.lexsort((s.runs, df, owner))
            rank = np.arange(len(order)) - s.cuts[owner]
            keep = (rank < longest[owner]) & (df[order] > 1)
            entry, key, flags = _cells(s.runs[order][keep], s.ids[owner[keep]], _count(df[order][keep]), block)
            of = owner[keep][entry]
            yield pa.record_batch([pa.array(_i64(key)), pa.array(s.ids[of]), pa.array((s.n[of] << 32) | flags | rank[keep][entry]), *(pa.array(_i64(m)[of]) for m in maps)], names=["byte", "set_id", "n_rank", "b0", "b1", "b2", "b3"])

    return run


def _verify_sets(shingle: int, min_words: int):
    """(set_id, the set as sorted hashes) of candidate texts."""

    def run(batches):
        for batch in batches:
            s = Sets(batch.column(0).to_pylist(), shingle, min_words)
            if len(s.rows):
                sets = [s.runs[i:j].tobytes() for i, j in zip(s.cuts[:-1], s.cuts[1:])]
                yield pa.record_batch([pa.array(s.ids), pa.array(sets, pa.binary())], names=["set_id", "runs"])

    return run


def _jaccard(t: float):
    @F.pandas_udf("double")
    def f(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both / (len(x) + len(y) - both))
        return pd.Series(out, dtype="float64")

    return f


def near_duplicates(df: DataFrame, key: str, text: str, similarity: float = 0.8, shingle: int = 5, min_words: int = 0, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(members(key, set_id): the copies, links(set_a, set_b, similarity): different sets that are alike).

    Every pair of different sets with a Jaccard similarity of `similarity` or more is in links, set_a < set_b.
    """
    spark = df.sparkSession
    src = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where("key is not null and text is not null and text <> ''")
    rows = df.count()
    bits = min(MAX_BITS, max(20, int(rows * 64).bit_length()))
    first = written(src.mapInArrow(_sketch_pass(shingle, min_words, bits), "key long, set_id long, slice int, blob binary"), "p3-sketch")
    members = first.where("set_id is not null").select("key", "set_id").distinct()
    merged = first.where("blob is not null").select("slice", "blob").groupBy("slice").applyInArrow(_merge_slices, "slice int, blob binary")
    sketch = spark.sparkContext.broadcast({r["slice"]: bytes(r["blob"]) for r in merged.collect()})  # at most 2^27 bytes
    index = src.select("text").mapInArrow(_index_pass(shingle, min_words, bits, similarity, block, sketch), "byte long, set_id long, n_rank long, b0 long, b1 long, b2 long, b3 long")
    index = index.repartition("byte").dropDuplicates(["byte", "set_id"])

    # a.n_rank holds the size in its high and flags and rank in its low half; least is the minimum of shared bytes
    na, nb, ra, rb = "shiftright(a.n_rank, 32)", "shiftright(b.n_rank, 32)", f"(a.n_rank & {RANK}L)", f"(b.n_rank & {RANK}L)"
    least = f"({similarity / (1 + similarity)!r}D * ({na} + {nb}) - 1e-9D)"
    met = index.alias("a").join(index.alias("b"), F.expr(f"a.byte = b.byte and a.set_id < b.set_id and ((a.n_rank & {OFF}L) = 0 or ((a.n_rank ^ b.n_rank) & {HIGH}L) <> 0)"))
    lacks = lambda x, y: " - ".join(f"bit_count({x}.b{k} & ~{y}.b{k})" for k in range(BITMAP // 64))
    able = met.where(F.expr(f"least({na} - {ra}, {nb} - {rb}) >= {least} - {MATCHES - 1} and {na} - {lacks('a', 'b')} >= {least} and {nb} - {lacks('b', 'a')} >= {least}"))
    tally = able.groupBy(F.col("a.set_id").alias("set_a"), F.col("b.set_id").alias("set_b")).agg(F.count("*").alias("shared"), F.max(F.expr(f"least({MATCHES}, ceil({least}))")).alias("guaranteed"))
    pairs = written(tally.where("shared >= guaranteed").select("set_a", "set_b"), "p3-pairs")
    wanted = pairs.select(F.explode(F.array("set_a", "set_b")).alias("set_id")).distinct()
    chosen = members.join(wanted, "set_id").groupBy("set_id").agg(F.min("key").alias("key")).select("key").distinct()
    chosen = written(chosen, "p3-chosen")
    if chosen.count() <= FEW:
        chosen = F.broadcast(chosen)
    texts = src.join(chosen, "key").select("text").mapInArrow(_verify_sets(shingle, min_words), "set_id long, runs binary").dropDuplicates(["set_id"])
    texts = written(texts, "p3-sets")
    a, b = (texts.select(F.col("set_id").alias(f"set_{x}"), F.col("runs").alias(f"runs_{x}")) for x in "ab")
    links = pairs.join(a, "set_a").join(b, "set_b").select("set_a", "set_b", _jaccard(similarity)("runs_a", "runs_b").alias("similarity"))
    return members, links.where(F.col("similarity") >= similarity - 1e-12)


COPIES = 64  # key_pairs lists the pairs of copies of a text up to this number of copies, and a star of them beyond


def key_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs of keys, smaller first: links between all keys of linked sets, and pairs within a copy group.

    A copy group of more than COPIES keys stands for itself through its smallest key: its other copies are
    linked to that key only, and links between different texts are stated for that key. `groups` has the membership of
    every key, so no link is lost.
    """
    sized = members.groupBy("set_id").agg(F.count("*").alias("n"), F.min("key").alias("rep"))
    small = members.join(sized.where(F.col("n") <= COPIES).select("set_id"), "set_id")
    big = sized.where(F.col("n") > COPIES)
    stars = members.join(big.select("set_id", "rep"), "set_id").where("key <> rep").select(F.col("rep").alias("a"), F.col("key").alias("b"))
    use = small.select("set_id", "key").unionByName(big.select("set_id", F.col("rep").alias("key")))
    multi = small.join(sized.where((F.col("n") > 1) & (F.col("n") <= COPIES)).select("set_id"), "set_id")
    inside = multi.alias("x").join(multi.alias("y"), F.expr("x.set_id = y.set_id and x.key < y.key")).select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))
    l, r = use.select(F.col("set_id").alias("set_a"), F.col("key").alias("a")), use.select(F.col("set_id").alias("set_b"), F.col("key").alias("b"))
    across = links.join(l, "set_a").join(r, "set_b").where("a <> b").select("a", "b")
    every = across.unionByName(inside).unionByName(stars)
    return every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """(key, class_id, group_id, copies, links), a row for every key and text of it that is long enough: the smallest
    key with the same text, the smallest key that a chain of links leads to, how often the text occurs, and how many
    other texts are linked to it."""
    sets = written(members.groupBy("set_id").agg(F.min("key").alias("class_id"), F.count("*").alias("copies")), "p3-classes")
    a, b = (sets.select(F.col("set_id").alias(f"set_{x}"), F.struct("class_id", F.col("set_id").alias("sid")).alias(x)) for x in "ab")
    edges = written(links.join(a, "set_a").join(b, "set_b").select("a", "b"), "p3-edges")  # a text is named by its key and itself
    ends = edges.select("a").unionByName(edges.select(F.col("b").alias("a"))).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("links"))
    ends = written(ends, "p3-ends")
    label = components(ends.select("id"), edges).join(ends, "id").select(F.col("id.sid").alias("set_id"), F.col("label.class_id").alias("group_id"), "links")
    out = members.join(sets, "set_id").join(label, "set_id", "left")
    return out.select("key", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))


def _nodes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes = spark.read.parquet(f"{sf_dir}/nodes.parquet").where("scope is null or scope <> 'headers'")
    return near_duplicates(nodes, "node_id", "text", similarity=0.55, shingle=3, min_words=30)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_a, node_b: nodes of at least 30 words that share 0.55 of their runs of three words."""
    return key_pairs(*_nodes(spark, sf_dir)).select(F.col("a").alias("node_a"), F.col("b").alias("node_b"))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of at least 30 words with its class of copies, its group and its number of links."""
    return groups(*_nodes(spark, sf_dir)).select(F.col("key").alias("node_id"), "class_id", "group_id", "copies", "links")


def p3_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of several nodes beside the facets of their games: nodes, texts, names of White, first and last year.
    Unknown years (null, 0) and null names are left out; groups without games have none."""
    g = p3_groups(spark, sf_dir)
    f = spark.read.parquet(f"{sf_dir}/facets.parquet").select("node_id", "white", F.expr("nullif(year, 0)").alias("year")).distinct()
    per = g.join(f, "node_id", "left").groupBy("group_id")
    return per.agg(F.countDistinct("node_id").alias("nodes"), F.countDistinct("class_id").alias("texts"), F.countDistinct("white").alias("whites"), F.min("year").alias("first_year"), F.max("year").alias("last_year")).where("nodes > 1")


SQL = {
    "p3_found": r"with n as (select distinct node_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from nodes where scope is null or scope <> 'headers'), "
    "s as (select distinct node_id, array_to_string(w[k:k+2], ' ') as g from (select node_id, w, unnest(range(1, len(w) - 1)) as k from n where len(w) >= 30) t), c as (select node_id, count(*) as k from s group by node_id), "
    "p as (select a.node_id as a, b.node_id as b, count(*) as both from s a join s b on a.g = b.g and a.node_id < b.node_id group by 1, 2) "
    "select p.a as node_a, p.b as node_b from p join c x on x.node_id = p.a join c y on y.node_id = p.b where p.both >= 0.55 * (x.k + y.k - p.both) - 1e-9",
}
