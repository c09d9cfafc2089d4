"""Positions: replay of games into tables of moves and placements, hashes, lookup with an exact recheck.

A game starts at the FEN of its header node, else at the usual position, and is replayed up to its first illegal move;
moves after that keep their row, without a placement. Null and empty texts give no rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.board import START, Board
from ..functions.scalars import call
from ..session import spread
from . import movetext

DIGITS = 15  # hexadecimal digits of a hash: 60 bits


def placement_hash(placement: str) -> Column:
    """Hash of a column of placements: the head of the SHA-256 of the 64 squares. Side, castling, clocks don't count."""
    return F.conv(F.substring(F.sha2(call("board64", x=placement), 256), 1, DIGITS), 16, 10).cast("long")


def hash_number(placement: str) -> int:
    """The same hash of one placement or FEN."""
    squares = re.sub(r"[1-8]", lambda m: "." * int(m.group()), placement.split(" ")[0].replace("/", ""))
    return int(hashlib.sha256(squares.encode()).hexdigest()[:DIGITS], 16)


def replayed(text: str | None, fen: str = START) -> list[dict]:
    """The moves of a text (main line and variations) with the FEN before and after each, None after an illegal move."""
    moves, _ = movetext.parse(text)
    boards: dict[tuple, Board | None] = {}
    first = moves[0]["ply"] if moves else 1
    out = []
    for m in moves:
        path, ply = tuple(m["path"]), m["ply"]
        at = (path, ply - 1)
        if at not in boards:  # the first move of a line: where its parent stood before the move it replaces
            boards[at] = (Board(fen) if not path and ply == first else None) if not path else boards.get((path[:-2], ply - 1))
        before = boards[at]
        after = boards[path, ply] = before.play(m["san"]) if before else None
        out.append(m | {"before": before.fen() if before else None, "after": after.fen() if after else None})
    return out


_FIELDS = (("node_id", pa.int64()), ("doc_id", pa.int64()), ("i", pa.int32()), ("path", pa.string()), ("depth", pa.int32()), ("ply", pa.int32()), ("san", pa.string()), ("nags", pa.list_(pa.string())), ("comment", pa.string()), ("before", pa.string()), ("after", pa.string()))
MOVES = "node_id long, doc_id long, i int, path string, depth int, ply int, san string, nags array<string>, comment string, before string, after string"


def _move_rows(batches):
    for batch in batches:
        rows = []
        for node, doc, text, fen in zip(*(batch.column(k).to_pylist() for k in range(4))):
            for i, m in enumerate(replayed(text, fen or START)):
                rows.append((node, doc, i, "/".join(map(str, m["path"])), len(m["path"]) // 2, m["ply"], m["san"], m["nags"], m["comment"], m["before"], m["after"]))
        yield pa.record_batch([pa.array(c, t) for c, (_, t) in zip(zip(*rows) if rows else [[]] * len(_FIELDS), _FIELDS)], names=[n for n, _ in _FIELDS])


def move_index(nodes: DataFrame) -> DataFrame:
    """(MOVES) of main lines and variations. A main line takes the FEN of the header node before it."""
    play = nodes.where("scope in ('mainline', 'variations') and text <> ''").select("node_id", "doc_id", "ordinal", "scope", "text")
    heads = nodes.where("scope = 'headers' and text like '%[FEN \"%'").select("doc_id", (F.col("ordinal") + 1).alias("ordinal"), F.lit("mainline").alias("scope"), call("start_fen", x="text").alias("fen")).dropDuplicates(["doc_id", "ordinal"])
    return spread(play.join(heads, ["doc_id", "ordinal", "scope"], "left").select("node_id", "doc_id", "text", "fen")).distinct().mapInArrow(_move_rows, MOVES)


def placements(moves: DataFrame) -> DataFrame:
    """(zobrist, doc_id, node_id, ply, white_to_move, placement) after each legal move of the main lines."""
    part = F.split_part("after", F.lit(" "), F.lit(1))
    own = moves.where("after is not null and depth = 0").select("doc_id", "node_id", "ply", call("white_to_move", x="after").alias("white_to_move"), part.alias("placement"))
    return own.select(placement_hash("placement").alias("zobrist"), "*")


def positions(nodes: DataFrame) -> DataFrame:
    """(node_id, doc_id, ply, placement, white_to_move, zobrist) of the main lines."""
    return placements(move_index(nodes.where("scope in ('mainline', 'headers')"))).select("node_id", "doc_id", "ply", "placement", "white_to_move", "zobrist")


def find_position(pos: DataFrame, placement: str, white_to_move: bool | None = None, include_collisions: bool = True) -> DataFrame:
    """Rows whose hash equals the placement's, with `exact` told by the placement itself; exact ones first."""
    wanted = placement.split(" ")[0]
    hit = pos.where(F.col("zobrist") == hash_number(wanted)).withColumn("exact", F.col("placement") == wanted)
    if not include_collisions:
        hit = hit.where("exact")
    if white_to_move is not None:
        hit = hit.where(F.col("white_to_move") == white_to_move)
    return hit.orderBy(F.desc("exact"), "doc_id", "node_id", "ply")


def any_of(pos: DataFrame, wanted: list[str]) -> DataFrame:
    """Rows of any of the placements, exact ones only."""
    parts = sorted({w.split(" ")[0] for w in wanted})
    return pos.where(F.col("zobrist").isin([hash_number(w) for w in parts]) & F.col("placement").isin(parts))


def legality(moves: DataFrame) -> DataFrame:
    """(node_id, printed, legal, first_illegal): moves of each main line, legal ones from the start, and the move that isn't."""
    own = moves.where("depth = 0").groupBy("node_id")
    return own.agg(F.count("*").alias("printed"), F.count("after").alias("legal"), F.min_by(F.when(F.col("after").isNull(), F.col("san")), F.when(F.col("after").isNull(), F.col("i"))).alias("first_illegal"))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/nodes.parquet")


def illegal_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legality(move_index(_nodes(spark, sf_dir).where("scope in ('mainline', 'headers')")))


QUERIES = {"o11_1_legality": illegal_games}
