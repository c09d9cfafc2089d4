"""Words and word runs as hashed numpy arrays, for Arrow batches.

A word is a run of letters and digits in lower case; everything else separates words.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np

WORD = re.compile(r"[^\W_]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Words of a text; null and empty give none."""
    return WORD.findall(text.lower()) if text else []


def word_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) in the text itself of the words of its lower case, which may be longer than the text."""
    low = text.lower()
    spans = [m.span() for m in WORD.finditer(low)]
    if len(low) == len(text):
        return spans
    at = np.repeat(np.arange(len(text)), [len(c.lower()) for c in text])
    return [(int(at[a]), int(at[b - 1]) + 1) for a, b in spans]


_BASE = 0x9E3779B97F4A7C15
_tables: dict[str, np.ndarray] = {}


def by_code(name: str, f, kind=bool) -> np.ndarray:
    """f of every code point; worked out once in a process for the planes in use, and the default elsewhere."""
    if name not in _tables:
        out = np.zeros(0x110000, kind) if kind is bool else np.arange(0x110000, dtype=kind)
        for a, b in PLANES:
            out[a:b] = np.fromiter((f(chr(i)) for i in range(a, b)), kind, b - a)
        _tables[name] = out
    return _tables[name]


#: Code points that are letters, digits, spaces or marks at all; beyond them nothing is either.
PLANES = ((0, 0x33480), (0xE0000, 0xE0200))


def _alnum() -> np.ndarray:
    return by_code("alnum", str.isalnum)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, and of its inverse."""
    if len(_tables.get("pow", ())) < n:
        for name, x in (("pow", _BASE), ("inv", pow(_BASE, -1, 1 << 64))):
            a = np.full(max(n, 1 << 16), x, np.uint64)
            a[0] = 1
            _tables[name] = np.cumprod(a, dtype=np.uint64)
    return _tables["pow"][:n], _tables["inv"][:n]


def word_hashes(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(a 64-bit hash of every word, index of the first word of every text with a closing end).

    Works on all characters of the batch at once: the hash of a word is the difference of prefix sums of
    its code points times powers of the base, brought to exponent zero.
    """
    low = [t.lower() if t else "" for t in texts]
    code = np.frombuffer("\0".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(code):
        return np.empty(0, np.uint64), np.zeros(len(low) + 1, np.int64)
    inside = _alnum()[code].astype(np.int8)
    edge = np.diff(inside, prepend=np.int8(0), append=np.int8(0))
    starts, stops = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    power, inverse = _powers(len(code))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * power, dtype=np.uint64)])
    hashes = mixed((total[stops] - total[starts]) * inverse[starts] + (stops - starts).astype(np.uint64))
    bounds = np.cumsum([0] + [len(t) + 1 for t in low])
    return hashes, np.searchsorted(starts, bounds).astype(np.int64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every input bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


def run_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words that starts at a position, as long as the words minus n - 1.

    Runs that cross the end of a text are the caller's to leave out (see run_starts).
    """
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out = out * _ODD + hashes[k : len(hashes) - n + 1 + k]
    return mixed(out)


def run_owner(ends: np.ndarray, n: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(starting positions of runs within one text, index of that text)."""
    lens = np.diff(ends)
    owner = np.repeat(np.arange(len(lens)), lens)
    if total < n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    owner = owner[: total - n + 1]
    at = np.nonzero(np.arange(total - n + 1) + n <= ends[1:][owner])[0]
    return at, owner[at]
