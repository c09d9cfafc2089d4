"""Game files as a Python data source: byte ranges of large files become partitions, one row a game.

spark.dataSource.register(PgnSource); spark.read.format("pgn").load(path). A game starts at a "[" that opens the
file or follows a blank line; a partition reads the games that start in its range, and reads on to the end of the
last one. Nothing is held but one block and one game. Bytes that aren't UTF-8 are replaced.
"""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK = 1 << 20
_START = re.compile(rb"(?:^|\n[ \t]*\r?\n)[ \t]*(?=\[)")
_HEADER = re.compile(r'\[(\w+) "([^"]*)"\]')
SCHEMA = "uri string, byte_start long, byte_len long, white string, black string, eco string, year int, result string, headers map<string,string>, movetext string"


def year_of(date: str) -> int:
    return int(date[:4]) if date[:4].isdigit() else 0


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def games(path: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the games that start in [start, end)."""
    with open(path, "rb") as f:
        at = max(0, start - 3)  # the blank line before a game may end in the range before
        f.seek(at)
        carry, eof = b"", False
        while True:
            block = f.read(BLOCK)
            eof = not block
            carry += block
            cuts = [m.end() for m in _START.finditer(carry) if m.start() > 0 or at + m.end() == 0 or m.group().startswith(b"\n")]
            for a, b in zip(cuts, [*cuts[1:], len(carry) if eof else None]):
                if b is None or at + a >= end:
                    break
                if at + a >= start:
                    yield at + a, carry[a:b]
            if eof or (cuts and at + cuts[-1] >= end):
                return
            if cuts:
                keep = max(0, cuts[-1] - 3)
                at, carry = at + keep, carry[keep:]


def row(path: str, offset: int, raw: bytes) -> tuple:
    text = raw.decode("utf-8", "replace").strip()
    h = dict(_HEADER.findall(text))
    body = re.sub(r"^(?:\s*\[[^\n]*\]\s*(?:\n|$))+", "", text).strip()
    return path, offset, len(raw), h.get("White"), h.get("Black"), h.get("ECO"), year_of(h.get("Date", "")), h.get("Result", "*"), h, body


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("partitionBytes", 64 << 20))

    def partitions(self) -> list[Range]:
        files = sorted(glob.glob(os.path.join(self.path, "*.pgn"))) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        return [Range(p, s, min(s + self.size, n)) for p in files for n in [os.path.getsize(p)] for s in range(0, n, self.size)]

    def read(self, partition: Range) -> Iterator[tuple]:
        for offset, raw in games(partition.path, partition.start, partition.end):
            yield row(partition.path, offset, raw)


class PgnSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pgn"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
