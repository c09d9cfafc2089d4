"""Games from printed text: legal readings of a token, repair of a game under each locale, segments and their games.

A token's readings are its forms with misread glyphs mended and its piece letter taken in a locale; the board decides which
of them is legal. A game is replayed once per locale, and the locale with the most legal moves stands; a token that has
several legal readings is a dispute, one that has none ends the game unless a later token fits. Null and empty texts
give no rows. Work is a row at a time inside Arrow batches, as each move needs the board of the one before.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.board import START, Board
from ..session import spread
from .movetext import tokenize
from .quality import PIECES

#: Piece letters of a locale as the letters of SAN, and glyphs that are read for others in a move.
LETTERS = {k: dict(zip(p, "KQRBN")) for k, p in PIECES.items() if k != "ru"} | {"ru": {"Ф": "Q", "Л": "R", "С": "B", "К": "N"}}
GLYPHS = {"l": "1", "I": "1", "|": "1", "O": "0", "o": "0", "S": "5", "€": "e", "é": "e", "с": "c", "е": "e", "а": "a", "х": "x", "×": "x", ":": "x", "B": "8", "Z": "2", "G": "6"}
FIGURINES = str.maketrans("♔♕♖♗♘♚♛♜♝♞", "KQRBNKQRBN")


def readings(token: str, locale: str = "en") -> list[tuple[str, float]]:
    """(SAN, confidence) of what a token may be, as printed first; each mended glyph costs a tenth, another locale's letter nothing."""
    core = token.translate(FIGURINES).rstrip("!?,;.")
    core = re.sub(r"^\d+\.+", "", core)
    if re.fullmatch(r"[0OoОо]-[0OoОо](?:-[0OoОо])?[+#]?", core):
        return [("O-O-O" if core.count("-") == 2 else "O-O", 1.0)]
    if locale == "ru" and core.startswith("Кр"):
        head, rest = "K", core[2:]
    else:
        head, rest = (LETTERS.get(locale, {}).get(core[:1], ""), core[1:]) if core[:1] in LETTERS.get(locale, {}) else ("", core)
    out = [(head + rest.replace(":", "x").replace("×", "x"), 1.0)]
    mended = "".join(GLYPHS.get(c, c) if not (i == len(rest) - 1 and c in "QRBN") else c for i, c in enumerate(rest))
    cost = sum(a != b for a, b in zip(rest, mended))
    if cost:
        out.append((head + mended, max(0.1, 1.0 - 0.1 * cost)))
    if not head and core[:1].isalpha() and core[:1].upper() == core[:1]:
        out += [(p + core[1:], 0.5) for p in "KQRBN" if p != core[:1]]
    return list(dict.fromkeys(out))


def resolved(token: str, board: Board, locale: str = "en") -> list[tuple[str, float, Board]]:
    """The legal readings of a token on a board, surest first; readings that lead to one position are one."""
    seen, out = set(), []
    for san, sure in sorted(readings(token, locale), key=lambda x: -x[1]):
        after = board.play(san)
        if after is not None and after.fen() not in seen:
            seen.add(after.fen())
            out.append((san, sure, after))
    return out


def repaired(text: str | None, locale: str = "en", fen: str = START) -> list[tuple[int, str, str | None, float, int]]:
    """(i, printed, SAN or None, confidence, legal readings) of the moves of a main line up to the first that has none."""
    board, out, depth = Board(fen), [], 0
    for kind, _, _, t in tokenize(text):
        depth += (kind == "open") - (kind == "close")
        if kind not in ("move", "other") or depth > 0:
            continue
        found = resolved(t, board, locale)
        if not found:
            out.append((len(out), t, None, 0.0, 0))
            break
        san, sure, board = found[0]
        out.append((len(out), t, san, sure if len(found) == 1 else sure * 0.8, len(found)))
    return out


def _pass(batches):
    for batch in batches:
        rows = []
        for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            tries = [(k, repaired(text, k)) for k in PIECES]
            legal = lambda r: sum(x[2] is not None for x in r)
            best, own = max(tries, key=lambda x: (legal(x[1]), sum(y[3] for y in x[1]), -list(PIECES).index(x[0])))
            second = max((legal(r) for k, r in tries if k != best), default=0)
            rows += [(node, best, legal(own) - second, *x) for x in own]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.int32()))], names=["node_id", "locale", "lead", "i", "printed", "san", "confidence", "readings"])


def repairs(games: DataFrame) -> DataFrame:
    """(node_id, locale, lead, i, printed, san, confidence, readings) of the best locale's moves of each game (node_id, text)."""
    return spread(games.select("node_id", "text").distinct()).mapInArrow(_pass, "node_id long, locale string, lead int, i int, printed string, san string, confidence double, readings int")


def invention() -> Column:
    """Whether a repaired move is another than the printed one: more than its marks, castling and capture signs changed."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"^\d+\.+", ""), r"[!?,;.+#:x×-]", ""), "0", "O")
    return F.coalesce(plain("printed") != plain("san"), F.lit(False))


def numbered(sans: str, fen: str = "fen") -> Column:
    """An array of moves as text, numbered from the FEN's move number, with N... where Black begins."""
    black = F.coalesce(F.split_part(F.col(fen), F.lit(" "), F.lit(2)) == "b", F.lit(False))
    first = F.coalesce(F.expr(f"try_cast(split_part({fen}, ' ', 6) as int)"), F.lit(1))
    ply = lambda i: i + black.cast("int")
    one = lambda x, i: F.when(ply(i) % 2 == 0, F.concat((first + F.floor(ply(i) / 2)).cast("string"), F.lit(". "), x)).when(i == 0, F.concat(first.cast("string"), F.lit("... "), x)).otherwise(x)
    return F.array_join(F.transform(sans, one), " ")


def lineage(label: str) -> Column:
    """The labels from the root down to an outline label: B1.2 is B, B1, B1.2."""
    cuts = F.filter(F.sequence(F.lit(1), F.length(label)), lambda i: (i == F.length(label)) | (F.substr(F.col(label), i + 1, F.lit(1)) == ".") | (F.substr(F.col(label), i, F.lit(1)).rlike("[A-Z]") & F.substr(F.col(label), i + 1, F.lit(1)).rlike(r"\d")))
    return F.when(F.length(label) > 0, F.transform(cuts, lambda i: F.substr(F.col(label), F.lit(1), i))).otherwise(F.array().cast("array<string>"))


def segments(nodes: DataFrame) -> DataFrame:
    """(doc_id, game, first, last): the games of each document as ranges of ordinals, from a header on to the next one."""
    heads = nodes.where("scope = 'headers' and text like '[%'").select("doc_id", "ordinal").distinct()
    ends = nodes.groupBy("doc_id").agg(F.max("ordinal").alias("end"))
    order = Window.partitionBy("doc_id").orderBy("ordinal")
    s = heads.select("doc_id", F.row_number().over(order).alias("game"), F.col("ordinal").alias("first"), (F.lead("ordinal").over(order) - 1).alias("next"))
    return s.join(ends, "doc_id").select("doc_id", "game", "first", F.coalesce("next", "end").alias("last"))


def segment_at(s: DataFrame, cursors: DataFrame) -> DataFrame:
    """(doc_id, position, game) of the game that holds each position (doc_id, position); positions outside of games have none."""
    hit = cursors.join(s, "doc_id").where("position between first and last").select("doc_id", "position", "game")
    return cursors.join(hit, ["doc_id", "position"], "left")
