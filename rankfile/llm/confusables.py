"""Visually identical text with different characters (problem 4).

skeleton(text): decompose, replace every character by its prototype from the look-alike table, decompose again.
Texts that print alike have equal skeletons; skeleton_groups groups the originals by it.

Of the texts of one skeleton one is the consistent form: full-width and styled letters, joined forms, odd spaces and
hyphens are the plain characters, invisible characters are gone, accents are joined to their letters, and in a word
(or the name of a square) of mixed scripts each letter is the prototype, by the skeleton's table, in the script that
the whole word can be written in. Words wholly in Cyrillic, a Cyrillic piece letter before a Latin square in Russian
text, quotes, dashes, bullets, fractions, figurines stay. A text is a case if it has its form's skeleton, but is
not its form.

Null gives null and is in no group; an empty text is its own form. Repeated rows count once per key. Whole texts
are processed, of any length.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The look-alike table, each Latin prototype with the letters of other scripts that print like it.
LOOK_ALIKES = """
a а α ⍺
c с ϲ ⲥ
d ԁ
e е ҽ
f ք
g ց
h һ հ Ꮒ
i і Ꭵ
j ј ϳ
l ӏ
n ո
o о ο օ ⲟ ჿ ס
p р ρ ⍴ ⲣ
q ԛ գ զ
s ѕ
u ս υ
v ѵ ν
w ԝ ѡ ա
x х
y у ү γ ყ
A А Α Ꭺ ᗅ
B В Β Ᏼ ᗷ
C С Ϲ Ꮯ Ⲥ
D Ꭰ ᗞ
E Е Ε Ꭼ
F Ϝ ᖴ
G Ԍ Ꮐ
H Н Η Ꮋ Ⲏ
I І Ι Ӏ Ⲓ
J Ј Ϳ Ꭻ
K К Κ Ꮶ Ⲕ
L Ꮮ ᒪ
M М Μ Ϻ Ꮇ Ⲙ
N Ν Ⲛ
O О Ο Օ Ⲟ
P Р Ρ Ꮲ Ⲣ
Q Ԛ ⵕ
R Ꭱ Ꮢ ᖇ
S Ѕ Տ Ꮪ
T Т Τ Ꭲ Ⲧ
U Ս ᑌ
V Ѵ Ꮩ
W Ԝ Ꮃ
X Х Χ Ⲭ
Y У Υ Ү Ꮍ Ⲩ
Z Ζ Ꮓ Ⲍ
"""
TO_LATIN = {c: row[0] for row in LOOK_ALIKES.split("\n") if row for c in row.split()[1:]}
TO_CYRILLIC = {v: k for k, v in TO_LATIN.items() if "\u0400" <= k <= "\u045f"}
# What only the skeleton makes equal, as these characters are in order where they stand: letters of the
# same script, and plain characters that print like each other.
SAME_SCRIPT = {"ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i", "ɪ": "i", "ᴄ": "c", "ᴏ": "o", "ᴑ": "o", "ꜱ": "s", "ᴜ": "u", "ʋ": "u", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ʏ": "y", "ǀ": "l", "ƽ": "s", "З": "3", "Ʒ": "3", "б": "6", "г": "r"}
PLAIN_ALIKE = {"0": "O", "1": "l", "I": "l", "|": "l", "m": "rn"}
# Characters that print nothing, and hyphens that print like "-".
INVISIBLE = "".join(map(chr, (0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, *range(0x200B, 0x2010), *range(0x2060, 0x2065), 0xFE0E, 0xFE0F, 0xFEFF)))
HYPHENS = "".join(map(chr, (0x2010, 0x2011, 0x2043, 0x2212, 0xFE63)))

_PLAIN = {ord(c): None for c in INVISIBLE} | {ord(c): "-" for c in HYPHENS}
_PLAIN |= {c: unicodedata.normalize("NFKC", chr(c)) for r in ((0xFB00, 0xFB07), (0xFF01, 0xFFEF), (0x1D400, 0x1D800), (0x2460, 0x2500), (0x2102, 0x214A)) for c in range(*r) if unicodedata.normalize("NFKC", chr(c)) != chr(c) and c != 0x2116}
_PLAIN |= {c: " " for c in range(0xA0, 0x3001) if unicodedata.category(chr(c)) == "Zs"}

#: Java pattern: a text without such a character is its own consistent form.
_RANGES = ((0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000), (0xFB00, 0xFB06), (0xFF01, 0xFFEE), (0x2102, 0x2115), (0x2117, 0x2149), (0x2460, 0x24FF), (0x1D400, 0x1D7FF))
_FAR = "".join(sorted(c for c in TO_LATIN if not "\u0370" <= c <= "\u052f"))  # the table's letters beyond Greek and Cyrillic
_SCRIPTS = ((0x370, 0x58F), (0x5D0, 0x5EA), (0x10D0, 0x10FF), (0x13A0, 0x167F), (0x2374, 0x237A), (0x2C80, 0x2D7F))  # the other scripts of the table


def _ranges(points: set[int]) -> str:
    """Code points as a character class of as few ranges as there are."""
    p = sorted(points)
    starts = [x for k, x in enumerate(p) if not k or p[k - 1] != x - 1]
    ends = [x for k, x in enumerate(p) if k + 1 == len(p) or p[k + 1] != x + 1]
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(starts, ends))


SUSPECT = "[\\p{M}" + _ranges({c for a, b in (*_RANGES, *_SCRIPTS) for c in range(a, b + 1)} | {ord(c) for c in INVISIBLE + HYPHENS}) + "]"

_WORD = re.compile(r"[^\W_]+")
_GREEK, _CYR, _LAT = "\\u0370-\\u03ff", "\\u0400-\\u052f", "A-Za-z\\u00c0-\\u024f"
_OTHER = re.compile(f"[{_GREEK}{_CYR}{_FAR}]")
_LATIN = re.compile(f"[{_LAT}]")
_PIECE = re.compile(r"(?:Кр|[КФЛС])(?=[a-h]?[1-8]?x?[a-h][1-8]$)")  # fixed values: piece letters of Russian notation
_SQUARE = re.compile(r"(?:Кр|[КФЛСKQRBNDTCSLFAP])?(?:[a-hасе][1-8]?|[1-8])?[xх]?[a-hасе][1-8]")
_CYRILLIC_WORD = re.compile(rf"(?<![^\W_])[{_CYR}]{{3,}}(?![^\W_])")
_LATIN_WORD = re.compile(rf"(?<![^\W_])[{_LAT}]{{3,}}(?![^\W_])")


def _one_script(word: str, russian: bool) -> str:
    if not _OTHER.search(word):
        return word
    head = _PIECE.match(word) if russian else None
    if head:
        return word
    if _SQUARE.fullmatch(word):
        cut = 0
        if russian and word[0] in "КФЛС":
            cut = 2 if word.startswith("Кр") else 1
        return word[:cut] + "".join(TO_LATIN.get(c, c) for c in word[cut:])
    if not _LATIN.search(word) and not re.search(f"[{_GREEK}]", word):
        return word
    latin = "".join(TO_LATIN.get(c, c) for c in word)
    if not _OTHER.search(latin):
        return latin
    other = "".join(TO_CYRILLIC.get(c, c) for c in word)
    return word if _LATIN.search(other) else other


def consistent(text: str | None) -> str | None:
    """The one form of a text; null stays null."""
    if text is None:
        return None
    out = unicodedata.normalize("NFC", text.translate(_PLAIN))
    if _OTHER.search(out):
        russian = len(_CYRILLIC_WORD.findall(out)) >= len(_LATIN_WORD.findall(out))
        out = _WORD.sub(lambda m: _one_script(m.group(), russian), out)
    return out


_PROTOTYPE = {ord(k): v for k, v in (TO_LATIN | SAME_SCRIPT).items()} | _PLAIN
_ALIKE = str.maketrans(PLAIN_ALIKE)


def skeleton_of(text: str | None) -> str | None:
    """Decomposed, every character by its prototype, decomposed again."""
    if text is None:
        return None
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(_PROTOTYPE).translate(_ALIKE))


def other_form(text: str | None) -> str | None:
    """The consistent form of a text that has its skeleton but isn't it; null for a text in order."""
    form = consistent(text)
    return form if form != text and skeleton_of(form) == skeleton_of(text) else None


@F.pandas_udf(StringType())
def _consistent(s: pd.Series) -> pd.Series:
    return s.map(consistent, na_action="ignore")


@F.pandas_udf(StringType())
def skeleton(s: pd.Series) -> pd.Series:
    return s.map(skeleton_of, na_action="ignore")


@F.pandas_udf(StringType())
def _other_form(s: pd.Series) -> pd.Series:
    return s.map(other_form, na_action="ignore")


def with_consistent_form(df: DataFrame, text: str, out: str = "form") -> DataFrame:
    """df with its one form; only rows that hold a suspect character go through Python."""
    held = F.col(text).rlike(SUSPECT)
    return df.where(held).withColumn(out, _consistent(text)).unionByName(df.where(~held | F.col(text).isNull()).withColumn(out, F.col(text)))


def changed(df: DataFrame, text: str) -> DataFrame:
    """The rows that share the skeleton of their consistent form and are not it, with it in `form`. Rows without a
    suspect character are their form."""
    return df.where(F.col(text).rlike(SUSPECT)).withColumn("form", _other_form(text)).where(F.col("form").isNotNull())


def skeleton_groups(df: DataFrame, text: str) -> DataFrame:
    """(skeleton_md5, forms, records, example): groups of different originals with one skeleton."""
    plain: Column = F.col(text).rlike("^[\\x20-\\x7e\\s]*$")  # ASCII needs no decomposition
    rows = df.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(text).alias("t"))
    keyed = rows.where(plain).select("t", F.replace(F.translate("t", "01I|", "Olll"), F.lit("m"), F.lit("rn")).alias("k")).unionByName(rows.where(~plain).select("t", skeleton("t").alias("k")))
    forms = keyed.groupBy(F.md5("k").alias("skeleton_md5"), F.md5("t").alias("form_md5")).agg(F.count("*").alias("n"), F.min(F.substring("t", 1, 60)).alias("e"))
    return forms.groupBy("skeleton_md5").agg(F.count("*").alias("forms"), F.sum("n").alias("records"), F.min("e").alias("example")).where("forms > 1")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = spark.read.parquet(f"{sf_dir}/nodes.parquet").select(F.lit("node").alias("rec_kind"), F.col("node_id").alias("rec_id"), "text")
    spans = spark.read.parquet(f"{sf_dir}/text_spans.parquet").select(F.lit("span").alias("rec_kind"), F.col("span_id").alias("rec_id"), "text")
    return nodes.unionByName(spans)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_kind, rec_id of the nodes and spans that were not in one consistent form."""
    return changed(_records(spark, sf_dir), "text").select("rec_kind", "rec_id").distinct()


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one consistent form of each record that was not in it: rec_kind, rec_id, form, skeleton_md5."""
    return changed(_records(spark, sf_dir), "text").select("rec_kind", "rec_id", "form", F.md5(skeleton("text")).alias("skeleton_md5")).distinct()


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of different texts of nodes and spans that print alike."""
    return skeleton_groups(_records(spark, sf_dir), "text")
