"""Scalar functions as expression templates.

A template is SQL over named arguments in braces, with a few macros where dialects differ, and no backslashes
(character classes instead). It runs inside Catalyst as built-in expressions; `duck` gives the text that an oracle
can run.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPARK = {"PAIR": "named_struct('k', {0}, 'b', {1})", "TRIPLE": "named_struct('k', {0}, 'b', {1}, 'm', {2})", "LIST": "array({0})", "MAP": "transform({0}, {1} -> {2})", "FILTER": "filter({0}, {1} -> {2})", "NONE": "cast(array() as array<string>)", "RND": "(floor(({0}) * 1e{1} + 5e-1) / 1e{1})", "RL": "regexp_like({0}, {1})", "RR": "regexp_replace({0}, {1}, {2})", "SPLIT": "split({0}, {1})", "EL": "try_element_at({0}, {1})", "SIZE": "size({0})", "SHA": "sha2({0}, 256)", "ALL": "regexp_extract_all({0}, {1}, 0)", "EX": "regexp_extract({0}, {1}, {2})", "STR": "cast({0} as string)", "INT": "cast({0} as int)", "LONG": "cast({0} as bigint)", "JOIN": "array_join({0}, {1})", "TRYINT": "try_cast({0} as int)", "CODE": "ascii({0})", "HEXINT": "cast(conv({0}, 16, 10) as int)", "DBL": "cast({0} as double)", "REV": "reverse({0})"}
_DUCK = {"PAIR": "struct_pack(k := {0}, b := {1})", "TRIPLE": "struct_pack(k := {0}, b := {1}, m := {2})", "LIST": "[{0}]", "MAP": "list_transform({0}, lambda {1}: {2})", "FILTER": "list_filter({0}, lambda {1}: {2})", "NONE": "cast([] as varchar[])", "RND": "(floor(({0}) * 1e{1} + 5e-1) / 1e{1})", "RL": "regexp_matches({0}, {1})", "RR": "regexp_replace({0}, {1}, {2}, 'g')", "SPLIT": "string_split_regex({0}, {1})", "EL": "list_extract({0}, {1})", "SIZE": "cast(len({0}) as int)", "SHA": "sha256({0})", "ALL": "regexp_extract_all({0}, {1})", "EX": "regexp_extract({0}, {1}, {2})", "STR": "cast({0} as varchar)", "INT": "cast({0} as int)", "LONG": "cast({0} as bigint)", "JOIN": "array_to_string({0}, {1})", "TRYINT": "try_cast({0} as int)", "CODE": "ascii({0})", "HEXINT": "cast(('0x' || {0}) as int)", "DBL": "cast({0} as double)", "REV": "reverse({0})"}


def _arguments(text: str, at: int) -> tuple[list[str], int]:
    """The arguments of a call whose opening bracket is at `at`, and the place after its closing one."""
    depth, quoted, start, out = 0, False, at + 1, []
    for i in range(at, len(text)):
        c = text[i]
        if c == "'":
            quoted = not quoted
        elif not quoted:
            if c in "([":
                depth += 1
            elif c in ")]":
                depth -= 1
                if not depth:
                    return [*out, text[start:i].strip()], i + 1
            elif c == "," and depth == 1:
                out.append(text[start:i].strip())
                start = i + 1
    raise ValueError(f"unclosed call in {text}")


def _render(text: str, macros: dict[str, str]) -> str:
    out, i = "", 0
    while i < len(text):
        if text[i] == "'":
            j = text.index("'", i + 1)
            out, i = out + text[i : j + 1], j + 1
            continue
        m = re.match(r"([A-Z]+)\(", text[i:])
        if m and m.group(1) in macros and (i == 0 or not (text[i - 1].isalnum() or text[i - 1] == "_")):
            args, i = _arguments(text, i + len(m.group(1)))
            if m.group(1) == "LIST":
                out += macros["LIST"].replace("{0}", ", ".join(_render(a, macros) for a in args))
                continue
            out += macros[m.group(1)].format(*(_render(a, macros) for a in args))
        else:
            out, i = out + text[i], i + 1
    return out


def _rounded(text: str) -> str:
    """Engines round ties of doubles differently; the same arithmetic rounds alike."""
    return re.sub(r"\bround\(", "RND(", text)


def bind(template: str, **args: str) -> str:
    for k, v in args.items():
        template = template.replace("{" + k + "}", v)
    return template


def spark_sql(template: str, **args: str) -> str:
    out = _render(_rounded(bind(template, **args)), _SPARK)
    for a, b in (("[[][", "\\\\[["), ("[[]", "\\\\["), ("[]]", "\\\\]"), ("[^]]", "[^\\\\]]")):  # Java wants brackets escaped
        out = out.replace(a, b)
    return out


def duck(template: str, **args: str) -> str:
    return _render(_rounded(bind(template, **args)), _DUCK)


def column(template: str, **args: str) -> Column:
    return F.expr(spark_sql(template, **args))
