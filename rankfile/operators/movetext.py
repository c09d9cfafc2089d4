"""Move text as a table of moves: tokens, variations as paths, and back to text.

A move's path lists, from the main line down, the ply at which each variation leaves and its number there; the empty
path is the main line. Unclosed and surplus brackets, and tokens that are no moves, are kept as issues: no text makes
the parser fail. Null and empty texts give no rows.
"""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.scalars import SAN
from ..session import spread

_TOKEN = re.compile(r"\{[^}]*\}?|;[^\n]*|\(|\)|\$\d+|(?:1-0|0-1|1/2-1/2|\*)(?!\S)|\d+\.(?:\.\.)?|[^\s(){};]+")
_MOVE = re.compile(f"(?:{SAN})[!?]*")


def tokenize(text: str | None) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, token): comment, open, close, nag, result, number, move, other."""
    out = []
    for m in _TOKEN.finditer(text or ""):
        t = m.group()
        kind = "comment" if t[0] in "{;" else "open" if t == "(" else "close" if t == ")" else "nag" if t[0] == "$" else "result" if t in ("1-0", "0-1", "1/2-1/2", "*") else "number" if re.fullmatch(r"\d+\.(?:\.\.)?", t) else "move" if _MOVE.fullmatch(t) else "other"
        out.append((kind, m.start(), m.end(), t))
    return out


def parse(text: str | None) -> tuple[list[dict], list[tuple[int, str]]]:
    """(moves in printed order with path, ply, san, nags, comment; issues by place)."""
    moves, issues = [], []
    stack: list[tuple[tuple, int]] = []
    path, ply = (), 0
    used: dict[tuple, int] = {}
    for kind, start, _, t in tokenize(text):
        if kind == "move":
            ply += 1
            moves.append({"path": path, "ply": ply, "san": t.rstrip("!?"), "nags": [x for x in [t[len(t.rstrip("!?")) :]] if x], "comment": ""})
        elif kind == "number" and not moves and not stack:
            ply = 2 * int(t.split(".")[0]) - (1 if "..." in t else 2)
        elif kind == "number" and (not moves or moves[-1]["path"] != path):
            ply = 2 * int(t.split(".")[0]) - (1 if "..." in t else 2)
        elif kind == "nag" and moves:
            moves[-1]["nags"].append(t)
        elif kind == "comment" and moves:
            moves[-1]["comment"] = (moves[-1]["comment"] + " " + t.strip("{};").strip()).strip()
        elif kind == "open":
            stack.append((path, ply))
            leave = (path, ply)
            used[leave] = used.get(leave, 0) + 1
            path, ply = (*path, ply, used[leave]), ply - 1
        elif kind == "close":
            if stack:
                path, ply = stack.pop()
            else:
                issues.append((start, "unopened bracket"))
        elif kind == "other":
            issues.append((start, "no move: " + t[:20]))
    issues += [(len(text or ""), "unclosed bracket")] * len(stack)
    return moves, issues


def to_text(moves: list[dict]) -> str:
    """Numbered text of parsed moves, variations in brackets after the move they replace."""
    lines: dict[tuple, list[dict]] = {}
    for m in moves:
        lines.setdefault(tuple(m["path"]), []).append(m)

    def line(path: tuple) -> str:
        out, fresh = [], True
        for m in lines.get(path, []):
            n = (m["ply"] + 1) // 2
            if m["ply"] % 2 or fresh:
                out.append(f"{n}." if m["ply"] % 2 else f"{n}...")
            out.append(m["san"] + "".join(x for x in m["nags"] if x[0] != "$"))
            out += [x for x in m["nags"] if x[0] == "$"]
            if m["comment"]:
                out.append("{" + m["comment"] + "}")
            subs = sorted(p for p in lines if len(p) == len(path) + 2 and p[: len(path)] == path and p[-2] == m["ply"])
            out += [f"({line(p)})" for p in subs]
            fresh = bool(subs or m["comment"])
        return " ".join(out)

    return line(())


def promote(moves: list[dict], path: tuple) -> list[dict]:
    """The moves with a variation of the main line made the main line, and the old one its variation."""
    at = path[0]
    out = []
    for m in moves:
        p = tuple(m["path"])
        if p[:2] == path[:2]:
            p = p[2:]
        elif not p and m["ply"] >= at:
            p = path[:2]
        elif p and p[0] >= at and p[:2] != path[:2] and p[0] > at:
            p = (*path[:2], *p)
        out.append(m | {"path": p})
    return out


def labels(moves: list[dict]) -> list[str]:
    """Outline label of each variation in printed order: A, B, A1, A1.1."""
    seen: dict[tuple, str] = {(): ""}
    children: dict[str, int] = {}
    out = []
    for m in moves:
        p = tuple(m["path"])
        if p not in seen:
            parent = seen.get(p[:-2], "")
            children[parent] = k = children.get(parent, 0) + 1
            seen[p] = chr(64 + min(k, 26)) if not parent else f"{parent}{k}" if parent.isalpha() else f"{parent}.{k}"
            out.append(seen[p])
    return out


def unbalanced(text: str | None) -> list[tuple[int, str]]:
    """(place, character) of brackets without a partner."""
    pairs, stack, out = {")": "(", "]": "[", "}": "{"}, [], []
    for i, c in enumerate(text or ""):
        if c in "([{":
            stack.append((i, c))
        elif c in pairs:
            if stack and stack[-1][1] == pairs[c]:
                stack.pop()
            else:
                out.append((i, c))
    return sorted(out + stack)


def first_json_object(text: str | None) -> str | None:
    """The first balanced JSON object in free text, null if there is none."""
    decoder = json.JSONDecoder()
    for m in re.finditer(r"\{", text or ""):
        try:
            value, end = decoder.raw_decode(text, m.start())
        except ValueError:
            continue
        if isinstance(value, dict):
            return text[m.start() : end]
    return None


def normal(text: str | None) -> str | None:
    """NFKC, one kind of dash and quotes, castling with letters, single spaces."""
    if text is None:
        return None
    t = unicodedata.normalize("NFKC", text).translate(str.maketrans("–—−‐‘’“”", "----''\"\""))
    return re.sub(r"\s+", " ", re.sub(r"\b0-0(-0)?\b", lambda m: m.group().replace("0", "O"), t)).strip()


def folded(text: str | None) -> str | None:
    """Lower case without accents, dashes plain, single spaces."""
    if text is None:
        return None
    t = unicodedata.normalize("NFKD", text.replace("ß", "ss"))
    return re.sub(r"\s+", " ", "".join("-" if c in "–—−" else c for c in t if not unicodedata.combining(c))).strip().lower()


def _make(f):
    @F.pandas_udf(StringType())
    def g(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return g


def _rows(batches):
    for batch in batches:
        cols: list[list] = [[] for _ in range(7)]
        for node, text in zip(*(batch.column(i).to_pylist() for i in range(2))):
            for i, m in enumerate(parse(text)[0]):
                for c, x in zip(cols, (node, i, "/".join(map(str, m["path"])), len(m["path"]) // 2, m["ply"], m["san"], m["comment"])):
                    c.append(x)
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()))], names=["node_id", "i", "path", "depth", "ply", "san", "comment"])


def moves(nodes: DataFrame) -> DataFrame:
    """(node_id, i, path, depth, ply, san, comment): every printed move of main lines and variations."""
    n = nodes.where("scope in ('mainline', 'variations') and text <> ''").select("node_id", "text").distinct()
    return spread(n).mapInArrow(_rows, "node_id long, i int, path string, depth int, ply int, san string, comment string")


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/nodes.parquet")


def _map(f, scope: str, out: str):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        n = _nodes(spark, sf_dir).where(f"scope in ({scope}) and text <> ''").select("node_id", "text").distinct()
        return n.select("node_id", _make(f)("text").alias(out))

    return q


def _outline(text: str) -> str:
    return " ".join(labels(parse(text)[0]))


def _again(text: str) -> str:
    """same if the text's moves survive being printed and parsed again."""
    first = parse(text)[0]
    again = parse(to_text(first))[0]
    return "same" if [(m["path"], m["ply"], m["san"]) for m in sorted(first, key=lambda m: (m["path"], m["ply"]))] == [(m["path"], m["ply"], m["san"]) for m in sorted(again, key=lambda m: (m["path"], m["ply"]))] else "differs"


_PLAY = "'mainline', 'variations'"
QUERIES = {
    "o11_7_tolerant_parser": lambda s, d: moves(_nodes(s, d)),
    "o5_19_move_entries": lambda s, d: moves(_nodes(s, d)).groupBy("node_id").agg(F.count("*").alias("moves"), F.max("depth").alias("depth"), F.max("ply").alias("last_ply")),
    "o11_8_pgn_tokens": _map(lambda t: " ".join(k for k, *_ in tokenize(t)), _PLAY, "kinds"),
    "o11_17_roundtrip": _map(_again, _PLAY, "verdict"),
    "o1_41_game_to_pgn": _map(lambda t: to_text(parse(t)[0]), _PLAY, "movetext"),
    "o11_20_renumber": _map(lambda t: to_text(parse(t)[0]), "'variations'", "movetext"),
    "o11_24_outline": _map(_outline, _PLAY, "labels"),
    "o11_21_check_balance": _map(lambda t: str(len(unbalanced(t))), _PLAY + ", 'comments'", "unbalanced"),
    "o9_1_normalise": _map(normal, "'captions', 'comments'", "normal"),
    "o9_3_fold": _map(folded, "'captions', 'comments'", "folded"),
}
