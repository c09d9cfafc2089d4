"""A chess board for replaying move text: move generation, legality, SAN, FEN. Used inside Arrow functions."""

from __future__ import annotations

import re

START = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"
_KNIGHT = ((1, 2), (2, 1), (2, -1), (1, -2), (-1, -2), (-2, -1), (-2, 1), (-1, 2))
_KING = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))
_SLIDES = {"b": _KING[1::2], "r": _KING[0::2], "q": _KING}
_MOVE = re.compile(r"([KQRBN])?([a-h])?([1-8])?x?([a-h])([1-8])(?:=?([QRBN]))?[+#!?]*$")


class Board:
    """squares[8 * rank + file], a1 first; '' is empty."""

    def __init__(self, fen: str = START):
        part = fen.split()
        self.squares = [""] * 64
        r, f = 7, 0
        for c in part[0]:
            if c == "/":
                r, f = r - 1, 0
            elif c.isdigit():
                f += int(c)
            else:
                self.squares[8 * r + f] = c
                f += 1
        self.white = len(part) < 2 or part[1] != "b"
        self.castling = part[2] if len(part) > 2 and part[2] != "-" else ""
        self.passant = part[3] if len(part) > 3 and part[3] != "-" else ""

    def placement(self) -> str:
        rows = []
        for r in range(7, -1, -1):
            row = "".join(x or "." for x in self.squares[8 * r : 8 * r + 8])
            rows.append(re.sub(r"\.+", lambda m: str(len(m.group())), row))
        return "/".join(rows)

    def fen(self) -> str:
        return f"{self.placement()} {'w' if self.white else 'b'} {self.castling or '-'} {self.passant or '-'}"

    def copy(self) -> Board:
        b = Board.__new__(Board)
        b.squares, b.white, b.castling, b.passant = self.squares[:], self.white, self.castling, self.passant
        return b

    def attacked(self, at: int, by_white: bool) -> bool:
        r, f = divmod(at, 8)
        own = (lambda c: c.upper()) if by_white else (lambda c: c.lower())

        def on(rr: int, ff: int) -> str:
            return self.squares[8 * rr + ff] if 0 <= rr < 8 and 0 <= ff < 8 else ""

        back = -1 if by_white else 1
        if any(on(r + back, f + d) == own("p") for d in (-1, 1)):
            return True
        if any(on(r + a, f + b) == own("n") for a, b in _KNIGHT) or any(on(r + a, f + b) == own("k") for a, b in _KING):
            return True
        for a, b in _KING:
            rr, ff = r + a, f + b
            while 0 <= rr < 8 and 0 <= ff < 8:
                p = self.squares[8 * rr + ff]
                if p:
                    if p in (own("q"), own("r" if a * b == 0 else "b")):
                        return True
                    break
                rr, ff = rr + a, ff + b
        return False

    def in_check(self, white: bool) -> bool:
        king = "K" if white else "k"
        return king in self.squares and self.attacked(self.squares.index(king), not white)

    def reaches(self, at: int, to: int) -> bool:
        """Whether the piece at a square can move to another, but for checks to its king."""
        p, target = self.squares[at], self.squares[to]
        if target and target.isupper() == p.isupper():
            return False
        (r, f), (rr, ff) = divmod(at, 8), divmod(to, 8)
        dr, df = rr - r, ff - f
        kind = p.lower()
        if kind == "p":
            step = 1 if p.isupper() else -1
            if df == 0:
                return not target and (dr == step or dr == 2 * step and r == (1 if step > 0 else 6) and not self.squares[at + 8 * step])
            return abs(df) == 1 and dr == step and (bool(target) or "abcdefgh"[ff] + str(rr + 1) == self.passant)
        if kind == "n":
            return (dr, df) in _KNIGHT
        if kind == "k":
            return (dr, df) in _KING
        if not (dr == 0 or df == 0 or abs(dr) == abs(df)):
            return False
        a, b = (dr > 0) - (dr < 0), (df > 0) - (df < 0)
        if (a, b) not in _SLIDES[kind]:
            return False
        while (r + a, f + b) != (rr, ff):
            r, f = r + a, f + b
            if self.squares[8 * r + f]:
                return False
        return True

    def after(self, at: int, to: int, promotion: str = "") -> Board:
        b = self.copy()
        p = b.squares[at]
        name = "abcdefgh"[to % 8] + str(to // 8 + 1)
        if p.lower() == "p" and name == self.passant and at % 8 != to % 8:
            b.squares[to + (-8 if p == "P" else 8)] = ""
        if p.lower() == "k" and abs(at - to) == 2:
            rook, home = (at + 3, at + 1) if to > at else (at - 4, at - 1)
            b.squares[home], b.squares[rook] = b.squares[rook], ""
        b.squares[to], b.squares[at] = (promotion or p), ""
        b.passant = "abcdefgh"[at % 8] + str((at // 8 + to // 8) // 2 + 1) if p.lower() == "p" and abs(at - to) == 16 else ""
        for sq, right in ((0, "Q"), (7, "K"), (56, "q"), (63, "k")):
            if sq in (at, to):
                b.castling = b.castling.replace(right, "")
        if p.lower() == "k":
            b.castling = "".join(c for c in b.castling if c.isupper() != p.isupper())
        b.white = not self.white
        return b

    def _castle(self, long: bool) -> Board | None:
        home = 4 if self.white else 60
        right = ("Q" if long else "K") if self.white else ("q" if long else "k")
        if right not in self.castling or self.squares[home] != ("K" if self.white else "k"):
            return None
        free = (1, 2, 3) if long else (5, 6)
        pass_ = (2, 3, 4) if long else (4, 5, 6)
        if any(self.squares[home - 4 + i] for i in free) or any(self.attacked(home - 4 + i, not self.white) for i in pass_):
            return None
        return self.after(home, home - 2 if long else home + 2)

    def play(self, san: str) -> Board | None:
        """The board after a move in SAN, None if no single legal move fits it."""
        core = san.rstrip("+#!?")
        if core.replace("0", "O") in ("O-O", "O-O-O"):
            return self._castle(core.count("-") == 2)
        m = _MOVE.match(core)
        if not m:
            return None
        kind, file, rank, tf, tr, promotion = m.groups()
        to = 8 * (int(tr) - 1) + "abcdefgh".index(tf)
        want = (kind or "P") if self.white else (kind or "P").lower()
        last = want.lower() == "p" and tr in "18"
        found = []
        for at in range(64):
            if self.squares[at] == want and (not file or "abcdefgh"[at % 8] == file) and (not rank or at // 8 + 1 == int(rank)) and at != to and self.reaches(at, to):
                piece = (promotion or "Q") if last else ""
                b = self.after(at, to, piece if self.white or not piece else piece.lower())
                if not b.in_check(self.white):
                    found.append(b)
        return found[0] if len(found) == 1 else None


def replay(sans: list[str], fen: str = START) -> list[str]:
    """The FEN after each move, up to the first that isn't legal."""
    b, out = Board(fen), []
    for s in sans:
        b = b.play(s)
        if b is None:
            break
        out.append(b.fen())
    return out


def is_legal_position(fen: str) -> bool:
    """One king each, no pawns on the edge, the side that moved not in check."""
    b = Board(fen)
    n = b.squares.count
    return n("K") == n("k") == 1 and n("P") <= 8 and n("p") <= 8 and not any(x.lower() == "p" for x in b.squares[:8] + b.squares[56:]) and not b.in_check(not b.white)
