"""Query registry: one entry per operator, built from expression templates and shared relational plans."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.dialect import bind, duck, spark_sql
from ..functions.scalars import SAN, TEMPLATES

TABLES = "library nodes facets text_spans authored language_scores edit_journal documents eval_items mix_targets region nation customer supplier part orders lineitem events embeddings".split()

#: Relations of distinct rows, as the tables hold exact duplicate rows: table, key, columns.
SHORT = {
    "@N": ("nodes", "node_id", "doc_id scope page ordinal byte_start byte_len text"),
    "@D": ("library", "doc_id", "uri title kind stratum size_bytes content_key state byte_cursor node_count"),
    "@F": ("facets", "node_id", "doc_id white black eco year result"),
    "@S": ("text_spans", "span_id", "doc_id page line_no span_no text x y w h font font_size confidence engine review"),
    "@A": ("authored", "item_id", "lang text"),
    "@L": ("language_scores", "item_id", "code score piece_hits piece_misses lexicon_hits"),
    "@J": ("edit_journal", "edit_id", "batch doc_id node_id text_before text_after applied_at undone"),
}


def _short(text: str) -> str:
    """Relations by their short names: the rows that differ in the key or in a column the text names, so that no text is
    shuffled by a query that doesn't read it. A text that selects a star gets all columns."""
    names = set(re.findall(r"\w+", text))
    star = re.search(r"(?:select|,)\s+(?:\w+\.)?\*", text) is not None
    for k, (table, key, columns) in SHORT.items():
        # language_scores and edits of one key may differ in any column, so their rows are told apart by all of them
        own = [c for c in columns.split() if star or c in names or k in ("@L", "@J")]
        text = re.sub(re.escape(k) + r"\b", f"(select distinct {', '.join([key, *own])} from @{table})", text)
    return text


def for_spark(text: str, sf_dir: str) -> str:
    return re.sub(r"@(\w+)", lambda m: f"parquet.`{sf_dir}/{m.group(1)}.parquet`" if m.group(1) in TABLES else m.group(0), spark_sql(_short(text)))


def for_duck(text: str) -> str:
    return re.sub(r"@(\w+)", lambda m: m.group(1) if m.group(1) in TABLES else m.group(0), duck(_short(text)))


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def shared(self, key: str, text: str) -> None:
        """A plan whose SQL holds in both dialects."""
        self.pair(key, text, text)

    def pair(self, key: str, spark_text: str, duck_text: str | None) -> None:
        self.queries[key] = lambda spark, sf_dir, t=spark_text: spark.sql(for_spark(t, sf_dir))
        if duck_text is not None:
            self.sql[key] = for_duck(duck_text)

    def plan(self, key: str, f: Callable[[SparkSession, str], DataFrame], duck_text: str | None = None) -> None:
        """A plan built with the DataFrame API."""
        self.queries[key] = f
        if duck_text is not None:
            self.sql[key] = for_duck(duck_text)

    def scalar(self, key: str, relation: tuple[str, str], keep: str, name: str, out: str, spark_args: dict[str, str] | None = None, **args: str) -> None:
        """A scalar function over a relation: the kept columns and the function's value."""
        args = {"x": "x"} | args
        t = TEMPLATES[name]
        self.pair(key, f"select {keep}, {bind(t, **(args | (spark_args or {})))} as {out} from ({relation[0]}) r", f"select {keep}, {bind(t, **args)} as {out} from ({relation[1]}) r")


def _values(name: str, *rows: str) -> tuple[str, str]:
    text = "select * from (values " + ", ".join(rows) + f") t({name})"
    return text, text


def both(text: str) -> tuple[str, str]:
    return text, text


MOVES = (
    f"select distinct x from (select explode(ALL(text, '{SAN}')) as x from @nodes where scope in ('mainline', 'variations'))",
    f"select distinct unnest(ALL(text, '{SAN}')) as x from @nodes where scope in ('mainline', 'variations')",
)
TOKENS = (
    "select distinct x from (select explode(SPLIT(text, '[ ]+')) as x from @nodes where scope in ('mainline', 'variations')) where x <> ''",
    "select distinct x from (select unnest(SPLIT(text, '[ ]+')) as x from @nodes where scope in ('mainline', 'variations')) where x <> ''",
)
WORDS = (
    "select distinct x from (select explode(SPLIT(text, '[ \n]+')) as x from @nodes where scope in ('all', 'comments')) where x <> ''",
    "select distinct x from (select unnest(SPLIT(text, '[ \n]+')) as x from @nodes where scope in ('all', 'comments')) where x <> ''",
)
HEADERS = both("select distinct node_id, text as x from @nodes where scope = 'headers' and text like '[%'")
TEXTS = both("select distinct node_id, text as x from @nodes where scope in ('all', 'comments') and text <> ''")
COMMENTS = both("select distinct node_id, text as x from @nodes where scope = 'comments' and text <> ''")
CAPTIONS = both("select distinct node_id, text as x from @nodes where scope = 'captions' and text <> ''")
LINES = both("select distinct span_id, text as x from @text_spans where text <> ''")
LABELS = both("select distinct lang as x from @authored")
_SPECIAL = (
    "('rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1'), ('8/8/8/4k3/8/3K4/4P3/8 b - - 3 60'), ('r1bqkbnr/pppp1ppp/2n5/4p3/2B1P3/5N2/PPPP1PPP/RNBQK2R b KQkq - 3 3'), "
    "('8/5k2/8/8/8/8/1RK5/8 w - - 0 1'), ('k7/8/1K6/8/8/8/8/7R w'), ('4k3/8/8/3pP3/8/8/8/4K3 w - d6 0 2'), ('8/8/8/8/8/8/8/8'), ('kb6/8/8/8/8/8/8/KB6 w - - 0 9')"
)
_RUNS = " || '/' || ".join(TEMPLATES["run_length"].replace("{x}", f"substr(b, {1 + 8 * k}, 8)") for k in range(8))
#: Boards of every kind: the 64 hexadecimal digits of each caption's hash as its 64 squares, and a few positions of games.
FENS = both(
    f"select x from (select distinct {_RUNS} || case when h < '8' then ' w' else ' b' end || ' - - 0 1' as x from (select substr(SHA(text), 1, 1) as h, translate(SHA(text), '0123456789abcdef', 'PNBRQKpnbrqk....') as b from @nodes where scope = 'captions' and text <> '') t) u union select x from (values {_SPECIAL}) v(x)"
)
