"""Predicates of moves and boards, as columns over a table of moves or placements.

A placement's 64 squares are a string of eight ranks, rank 8 first ('.' for an empty square); every predicate is a
comparison of single characters, a pattern, or a count over it, so all of them run inside Catalyst.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import call

ORDER = "KQRBNP"  # fixed value: order of the pieces in a material name


class QueryError(ValueError):
    """A query that can't be read."""


def compiled(pattern: str) -> str:
    """The pattern, if it is one in both Python and Java; an error that names it otherwise."""
    try:
        re.compile(re.sub(r"\(\?<([A-Za-z]\w*)>", r"(?P<\1>", pattern))
    except re.error as e:
        raise QueryError(f"pattern {pattern!r}: {e}") from e
    return pattern


def move_glob(spec: str) -> str:
    """A move pattern with * and ? as an anchored regex, check marks optional; re: passes a regex through."""
    if spec.startswith("re:"):
        return f"^(?:{compiled(spec[3:])})$"
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in spec)
    return f"^{body}" + ("" if spec.rstrip("*?")[-1:] in ("+", "#") else "[+#]?") + "$"


def rank_squares(rank: str) -> str | None:
    """A rank pattern as eight characters: digits are empty squares, ? any, * the rest of them any; None if it has not eight."""
    out = ""
    for c in rank:
        out += "." * int(c) if c.isdigit() else "?" * (8 - len(out)) if c == "*" else c
    return out if len(out) == 8 else None


def squares(fen: str) -> Column:
    return call("board64", x=f"split_part({fen}, ' ', 1)")


def _square(board: Column, name: str) -> Column:
    if not re.fullmatch("[a-h][1-8]", name):
        raise QueryError(f"no square: {name!r}")
    return F.substring(board, (8 - int(name[1])) * 8 + ord(name[0]) - 96, 1)


@dataclass(frozen=True)
class PositionPattern:
    """Side to move, pieces that squares must or must not hold, and a placement with ? and * for anything."""

    placement: str | None = None
    turn: bool | None = None
    requires: dict[str, str] = field(default_factory=dict)
    forbids: dict[str, str] = field(default_factory=dict)

    def column(self, fen: str) -> Column:
        """False for a null or empty FEN, and for a pattern that has not eight ranks of eight squares."""
        b = squares(fen)
        c = F.coalesce(F.col(fen) != "", F.lit(False))
        if self.turn is not None:
            c &= call("white_to_move", x=fen) == self.turn
        for name, piece in self.requires.items():
            c &= _square(b, name) == piece
        for name, piece in self.forbids.items():
            c &= _square(b, name) != piece
        if self.placement is not None:
            ranks = [rank_squares(r) for r in self.placement.split("/")]
            if len(ranks) != 8 or None in ranks:
                return F.lit(False)
            c &= b.rlike("^" + "".join("." if x == "?" else f"[{x}]" for r in ranks for x in r) + "$")
        return c


def canonical_material(side: str) -> str:
    return "".join(sorted((c for c in side.upper() if c in ORDER), key=ORDER.index))


@dataclass(frozen=True)
class MaterialSignature:
    """Exact pieces of a side (empty: any), bounds on the pawns of both, bishops of opposite colours."""

    white: str = ""
    black: str = ""
    opposite_bishops: bool | None = None
    max_pawns: int | None = None
    min_pawns: int | None = None

    @classmethod
    def parse(cls, spec: str) -> MaterialSignature:
        m = re.fullmatch(r"\s*(.*?)\s*[vV]s?\.?\s*(.*)", spec)
        if not m:
            raise QueryError(f"material {spec!r} needs a v between the sides")
        return cls(canonical_material(m.group(1)), canonical_material(m.group(2)))

    def column(self, fen: str) -> Column:
        b = squares(fen)
        count = lambda p: F.length(b) - F.length(F.replace(b, F.lit(p), F.lit("")))
        c = F.coalesce(F.col(fen) != "", F.lit(False))
        for side, case in ((self.white, str.upper), (self.black, str.lower)):
            if side:
                for p in ORDER:
                    c &= count(case(p)) == side.count(p)
        pawns = count("P") + count("p")
        if self.max_pawns is not None:
            c &= pawns <= self.max_pawns
        if self.min_pawns is not None:
            c &= pawns >= self.min_pawns
        if self.opposite_bishops is not None:
            c &= opposite_bishops(b) == self.opposite_bishops
        return c


def opposite_bishops(board: Column) -> Column:
    """One bishop a side, on squares of different colours."""
    colour = lambda p: (F.instr(board, p) - 1 + F.floor((F.instr(board, p) - 1) / 8)) % 2
    one = lambda p: F.length(board) - F.length(F.replace(board, F.lit(p), F.lit(""))) == 1
    return one("B") & one("b") & (colour("B") != colour("b"))


@dataclass(frozen=True)
class MoveQuery:
    """What a move must be; every field is optional."""

    pattern: str | None = None
    piece: str | None = None
    to_square: str | None = None
    is_capture: bool | None = None
    is_check: bool | None = None
    is_mate: bool | None = None
    promotion: str | None = None
    turn: bool | None = None
    nag: str | None = None
    min_ply: int | None = None
    max_ply: int | None = None
    mainline_only: bool = False
    position: PositionPattern | None = None
    material: MaterialSignature | None = None

    def column(self) -> Column:
        """Over a table of moves (san, ply, nags, depth, after)."""
        c = F.lit(True)
        if self.pattern is not None:
            c &= F.col("san").rlike(move_glob(self.pattern))
        for value, name in ((self.piece, "piece"), (self.to_square, "to_square"), (self.is_capture, "is_capture"), (self.is_check, "is_check"), (self.is_mate, "is_mate"), (self.promotion, "promotion")):
            if value is not None:
                c &= call(name, x="san") == value
        if self.turn is not None:
            c &= (F.col("ply") % 2 == 1) == self.turn
        if self.nag is not None:
            c &= F.array_contains("nags", self.nag)
        if self.min_ply is not None:
            c &= F.col("ply") >= self.min_ply
        if self.max_ply is not None:
            c &= F.col("ply") <= self.max_ply
        if self.mainline_only:
            c &= F.col("depth") == 0
        if self.position is not None:
            c &= self.position.column("after")
        if self.material is not None:
            c &= self.material.column("after")
        return c


def annotation(glyph: str) -> MoveQuery:
    return MoveQuery(nag=glyph)
