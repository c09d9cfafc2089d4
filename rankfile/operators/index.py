"""The stored index of a library: built once from its tables, looked up afterwards.

Four tables lie under one folder of the shared one: `postings` (token, node_id, pos, n: every token with its place and
its node's length), `moves` (every printed move, with the FENs around it), `positions` (zobrist, doc_id, node_id, ply,
white_to_move, placement) and `meta` (key, value). Postings and positions are partitioned by buckets of their key and
sorted by it, so a lookup reads one bucket, and in it the row groups whose bounds hold the key. A frequent token's rows are
spread over SPREAD files of its bucket.

The folder's name is a fingerprint of the source files and of the versions of schema, tokenizer and hash: tables that
changed get a new index, and an index of other versions is stale. Nothing is held on the driver but meta.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from .positions import move_index, placements
from .tokens import tokens

BUCKETS = 32
SPREAD = 2
VERSIONS = {"schema": "1", "tokenizer": "1", "hash": "1"}
TABLES = ("nodes", "library", "facets")


class IndexMissing(FileNotFoundError):
    """There is no index where one was asked for."""


class IndexStale(ValueError):
    """The index was written by another version of the schema, the tokenizer or the hash."""


SCHEMAS = {"postings": "token string, node_id long, pos int, n int, bucket int", "positions": "zobrist long, doc_id long, node_id long, ply int, white_to_move boolean, placement string, bucket int"}


def bucket_of(key: str) -> Column:
    """Bucket of a token or hash: by checksum of its text."""
    return (F.crc32(F.col(key).cast("string")) % BUCKETS).cast("int")


def read_meta(spark: SparkSession, folder: str) -> dict[str, str]:
    return {r["key"]: r["value"] for r in spark.read.schema("key string, value string").json(f"{folder}/meta").collect()}  # a few rows


def write_meta(spark: SparkSession, folder: str, values: dict[str, str]) -> None:
    """Set keys; others stay."""
    old = read_meta(spark, folder) if exists(spark, f"{folder}/meta") else {}
    spark.createDataFrame(sorted((old | values).items()), "key string, value string").coalesce(1).write.mode("overwrite").json(f"{folder}/meta")


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def bytes_under(spark: SparkSession, path: str) -> int:
    """Size of a file or folder; 0 if it isn't there."""
    if not exists(spark, path):
        return 0
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return int(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength())


_META: dict[str, dict[str, str]] = {}


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    source: str
    folder: str

    def table(self, name: str) -> DataFrame:
        """A source table or a stored one."""
        if name in SCHEMAS:
            return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}")
        return self.spark.read.parquet(f"{self.source}/{name}.parquet" if name in TABLES else f"{self.folder}/{name}")

    def keyed(self, name: str, key: str, values: list) -> DataFrame:
        """The rows of a stored table whose key is one of the values; reads their buckets only."""
        folders = [f"{self.folder}/{name}/bucket={b}" for b in sorted({zlib.crc32(str(v).encode()) % BUCKETS for v in values})]
        folders = [f for f in folders if exists(self.spark, f)]
        if not folders:
            return self.table(name).where("false").drop("bucket")
        rows = self.spark.read.schema(SCHEMAS[name]).option("basePath", f"{self.folder}/{name}").parquet(*folders)
        return rows.where(F.col(key).isin(values)).drop("bucket")

    def texts(self) -> tuple[int, float]:
        """Nodes with text, and their mean number of tokens."""
        meta = self.meta()
        return int(meta["indexed"]), int(meta["tokens"]) / max(int(meta["indexed"]), 1)

    def meta(self) -> dict[str, str]:
        if self.folder not in _META:
            _META[self.folder] = read_meta(self.spark, self.folder)
        return _META[self.folder]

    def stats(self) -> dict[str, int]:
        """documents, nodes, tokens, positions, bytes of the index and of its sources."""
        meta = self.meta()
        own = {k: int(meta[k]) for k in ("documents", "nodes", "indexed", "tokens", "positions")}
        return own | {"index_bytes": bytes_under(self.spark, self.folder), "corpus_bytes": sum(bytes_under(self.spark, f"{self.source}/{t}.parquet") for t in TABLES)}


def fingerprint(spark: SparkSession, source: str) -> str:
    """Names, sizes and times of change of the files under the source tables; no content is read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    keys = []
    for t in TABLES:
        p = jvm.org.apache.hadoop.fs.Path(f"{source}/{t}.parquet")
        files = p.getFileSystem(conf).listFiles(p, True)
        while files.hasNext():
            f = files.next()
            keys.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return hashlib.sha256("|".join([source, *sorted(keys), *VERSIONS.values()]).encode()).hexdigest()[:24]


def postings(nodes: DataFrame) -> DataFrame:
    """(token, node_id, pos, n) of the nodes with text; a repeated row counts once."""
    t = nodes.where("text is not null and text <> ''").select("node_id", "text").distinct().select("node_id", tokens("text").alias("t"))
    return t.select("node_id", F.size("t").alias("n"), F.posexplode("t").alias("pos", "token")).select("token", "node_id", "pos", "n")


def _store(df: DataFrame, key: str, path: str) -> None:
    spread = F.pmod(F.xxhash64("node_id"), F.lit(SPREAD))
    df.withColumn("bucket", bucket_of(key)).repartition(BUCKETS * SPREAD, "bucket", spread).sortWithinPartitions("bucket", key).write.mode("overwrite").partitionBy("bucket").parquet(path)


def build(spark: SparkSession, source: str, folder: str) -> Index:
    """Write the tables of the index, meta last: a folder without meta is no index."""
    nodes = spark.read.parquet(f"{source}/nodes.parquet")
    _store(postings(nodes), "token", f"{folder}/postings")
    move_index(nodes).write.mode("overwrite").parquet(f"{folder}/moves")
    index = Index(spark, source, folder)
    _store(placements(index.table("moves")), "zobrist", f"{folder}/positions")
    per = index.table("postings").agg(F.countDistinct("node_id").alias("indexed"), F.count("*").alias("tokens")).first()
    counts = {"documents": index.table("library").agg(F.countDistinct("doc_id")).first()[0], "nodes": nodes.agg(F.countDistinct("node_id")).first()[0], "indexed": per["indexed"], "tokens": per["tokens"], "positions": index.table("positions").count()}
    write_meta(spark, folder, VERSIONS | {k: str(v) for k, v in counts.items()})
    return index


def connect(spark: SparkSession, source: str, folder: str, create: bool = True, read_only: bool = False) -> Index:
    """The index in a folder. A missing one is built if `create` allows it; one of other versions is an error, never empty
    results, and is built anew only by `build`."""
    if not exists(spark, f"{folder}/meta"):
        if read_only or not create:
            raise IndexMissing(folder)
        return build(spark, source, folder)
    meta = read_meta(spark, folder)
    wrong = {k: meta.get(k) for k, v in VERSIONS.items() if meta.get(k) != v}
    if wrong:
        raise IndexStale(f"{folder}: {wrong}, this is {VERSIONS}")
    return Index(spark, source, folder)


_OPEN: dict[str, Index] = {}


def opened(spark: SparkSession, source: str) -> Index:
    """The index of a source's present files, in the shared folder; built on the first call. The folder's name holds the
    versions and the files' fingerprint, so an index that this process has opened needs no second check."""
    folder = f"{shared_dir(spark)}/index-{fingerprint(spark, source)}"
    if folder not in _OPEN or _OPEN[folder].spark is not spark:
        _OPEN[folder] = connect(spark, source, folder)
    return _OPEN[folder]
