"""Noise in text from scanned pages (problem 2).

Three repairs, each of which names the records it applies to:

* misread: words are grouped by a skeleton that makes confusable glyphs equal (e/c, o/0, l/1/i, s/5, rn/m, cl/d,
  ...). The frequent forms of a word's group may be what it was. One that a neighbour supports (the two often stand
  together) goes before the others; it must be TIMES as frequent as the word, or twice that if no neighbour supports
  it, and half in a span that its engine is not SURE of. Words under four letters need a neighbour's support, unless
  they hold a digit. The number before a move is read alike, among the numbers of its skeleton.
* furniture: page numbers by their form; running heads by masking digits, squares and rare words in the lines that
  close no sentence and hold no move: a masked line that stands on HEADS pages or paragraphs of one document is a head,
  wherever its place and form don't speak against it.
* hyphen: a word split at a line's end. The halves are joined unless the word occurs with its own hyphen inside
  lines and the joined form doesn't.

The repaired lines are reflowed into paragraphs; the lines of pages follow each other by SQL windows.

Counts are taken over all paragraphs, comments and spans. A form is frequent from LEAST occurrences on, at every size.
Up to MAX_WORDS frequent words and MAX_PAIRS pairs are broadcast; beyond that every record gets the entries that its own
words ask for, by joins, with the same result. Heads are joined to their records. Null and empty texts have no fault
and repair to themselves. Repeated rows count once per key in the results. A word that fits two forms equally takes
the first in the alphabet. A null confidence is sure.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..session import written
from . import prose
from .confusables import consistent
from .words import _alnum, _powers, mixed

LEAST = 20  # occurrences that make a form frequent
TIMES = 20  # times as frequent as the word it replaces
SURE = 0.8  # confidence from which a span is as good as a paragraph
HEADS = 2  # pages or paragraphs of a document that make a masked line a running head
MAX_WORDS = MAX_PAIRS = 1_000_000  # entries that are broadcast
FLAGS = 1_000_000  # records with a head that are broadcast

# Glyphs read for each other, as prototypes of single glyphs, and as pairs read for one.
LATIN = str.maketrans("c@0f1l596h", "eaotiisgbb")
CYRILLIC = str.maketrans("0нъ38649щfc", "оиьзвб" + "чдш" + "fc")
JOINED = (("rn", "m"), ("cl", "d"), ("ii", "u"), ("vv", "w"), ("h", "li"), ("ь1", "ы"), ("1i", "h"))
_TOKEN = re.compile(r"[\w@]+")
_CYR = re.compile("[\\u0400-\\u04ff]")
_MOVE = re.compile(r"(?:кр|[kqrbndtcslfaкфлсp])?[a-h]?[1-8]?x?[a-h][1-8](?:[qrbnkdtcslfaфлкс])?|[oо0](?:-?[oо0]){1,2}|\d+\w?|[a-e]\d\d|\d+(?:st|nd|rd|th|o|a|e|er|ª|º|я|й)")
_NUMBER = re.compile(r"(?<![^\W_])(?=[\dlIO|]*[lIO|])(?=[\dlIO|]*\d)[\dlIO|]{2,3}\.{1,3}(?=[^\s\d.])|(?<![^\W_])[lI]\.{1,3}(?=[KQRBNDTCSLFA]?[a-h]?x?[a-h][1-8])")
_PAGE = re.compile(r"[\W_]*(?:(?:p|pp|page|pag|pág|s|seite|стр|с)\.?\s*)?(?:\d{1,4}|[ivxlc]{1,6}|[IVXLC]{1,6})[\W_]*")
_PAGED = re.compile(r"^\d{1,4}\s{2,}(?=\S)|(?<=\S)\s{2,}\d{1,4}$")
_SPLIT = re.compile(r"([^\W\d_]+)(-|¬|­)(\s*\n\s*|\s+)([^\W\d_]+)")
_END = re.compile(r"([^\W\d_]+)(-|¬|­)\s*$")


def single(w: str) -> str:
    """Skeleton of a word: every glyph by its prototype."""
    return w.translate(CYRILLIC) if _CYR.search(w) else w.translate(LATIN)


def variants(w: str) -> list[str]:
    """The skeletons a word may have, with joined glyphs read as one or as two."""
    out = [single(w)]
    for two, one in JOINED:
        at = w.find(two)
        while at >= 0:
            out.append(single(w[:at] + one + w[at + len(two) :]))
            at = w.find(two, at + 1)
        if w.count(two) > 1:
            out.append(single(w.replace(two, one)))
    return list(dict.fromkeys(out))


def _counts(batches):
    """Partial counts of words (w), of pairs of neighbouring words by hash, and of words with an inner hyphen."""
    words: Counter = Counter()
    pairs: Counter = Counter()
    for batch in batches:
        texts = [(t or "").lower() for t in batch.column(0).to_pylist()]
        code = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = (_alnum()[code] | (code == 64)).astype(np.int8)
        edge = np.diff(inside, prepend=np.int8(0), append=np.int8(0))
        a, b = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
        if not len(a):
            continue
        h = _word_hash(code, a, b)
        keys, first, n = np.unique(h, return_index=True, return_counts=True)
        joined = "\0".join([*texts, ""])
        for i, k in zip(first.tolist(), n.tolist()):
            words[joined[a[i] : b[i]]] += k
        near = (a[1:] - b[:-1]) == 1
        p, n = np.unique(_pair(h[:-1], h[1:])[near], return_counts=True)
        for x, k in zip(p.tolist(), n.tolist()):
            pairs[x] += k
        for t in texts:
            if "-" in t:
                words.update("-" + w for w in re.findall(r"(?<![\w-])[^\W\d_]+-[^\W\d_]{2,}(?![\w-])", t))
        if len(pairs) > 2_000_000:
            yield _table(words, pairs)
            words, pairs = Counter(), Counter()
    yield _table(words, pairs)


def _table(words: Counter, pairs: Counter) -> pa.RecordBatch:
    n = len(words)
    return pa.record_batch([pa.array([*words, *[None] * len(pairs)], pa.string()), pa.array(np.array([*[0] * n, *pairs], np.uint64).view(np.int64)), pa.array([*words.values(), *pairs.values()], pa.int64())], names=["word", "pair", "n"])


def _word_hash(code: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    power, inverse = _powers(len(code))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * power, dtype=np.uint64)])
    return mixed((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64))


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(left * np.uint64(0x9E3779B97F4A7C15) + right)


def _hash_one(w: str) -> np.ndarray:
    code = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _word_hash(code, np.array([0]), np.array([len(code)]))


class Lexicon:
    """Frequent words by skeleton, frequent numbers, frequent pairs, words with an inner hyphen."""

    def __init__(self, words: dict[str, int], pairs: set[int]):
        self.compounds = {w[1:] for w in words if w[0] == "-"}
        self.n = {w: k for w, k in words.items() if w[0] != "-" and "@" not in w and not any(c.isdigit() for c in w)}
        self.numbers = {single(w): w for w in words if w.isdigit() and len(w) <= 3}  # a skeleton has one number
        self.pairs = pairs
        self.forms: dict[str, list[tuple[int, str]]] = {}
        for w in sorted(self.n):
            self.forms.setdefault(single(w), []).append((self.n[w], w))
        self.cache: dict[str, list[tuple[int, str]]] = {}
        self.hashes: dict[str, np.uint64] = {}

    def candidates(self, w: str) -> list[tuple[int, str]]:
        """(count, form) of the frequent forms in a word's groups, but itself; most frequent first."""
        if w not in self.cache:
            if len(self.cache) > 300_000:
                self.cache.clear()
            found = {d: n for s in variants(w) for n, d in self.forms.get(s, ()) if d != w}
            self.cache[w] = sorted(((n, d) for d, n in found.items()), key=lambda x: (-x[0], x[1]))
        return self.cache[w]

    def form(self, w: str) -> str | None:
        """The most frequent form that is TIMES as frequent as a word."""
        return next((d for n, d in self.candidates(w)[:1] if n >= TIMES * max(self.n.get(w, 0), 1)), None)

    def _h(self, w: str) -> np.ndarray:
        if w not in self.hashes:
            if len(self.hashes) > 300_000:
                self.hashes.clear()
            self.hashes[w] = _hash_one(w)
        return self.hashes[w]

    def together(self, a: str, b: str) -> bool:
        return bool(a and b) and int(_pair(self._h(a), self._h(b))[0]) in self.pairs

    def read(self, w: str, left: str, right: str, sure: bool = True) -> str | None:
        """What a word was, if it was misread."""
        low = w.lower()
        if _MOVE.fullmatch(low):
            return None
        found = self.candidates(low)
        if not found:
            return None
        need = (TIMES if sure else TIMES / 2) * max(self.n.get(low, 0), 1)
        near = next((d for n, d in found if n >= need and (self.together(left, d) or self.together(d, right))), None)
        if near:
            return near
        alone = len(low) >= 4 or "@" in low or any(c.isdigit() for c in low)
        return found[0][1] if alone and found[0][0] >= 2 * need else None


def _frequent(texts: DataFrame, text: str) -> DataFrame:
    """(word, pair, n) of the frequent words and pairs of all rows' texts; a word with its own hyphen needs three."""
    raw = texts.select(text).where(F.col(text).isNotNull() & (F.col(text) != ""))
    counts = raw.mapInArrow(_counts, "word string, pair long, n long").groupBy("word", "pair").agg(F.sum("n").alias("n"))
    return written(counts.where((F.col("n") >= LEAST) | ((F.col("n") >= 3) & F.col("word").startswith("-"))), "p2-counts")


def lexicon(counts: DataFrame) -> Lexicon | None:
    """The lexicon as one object, None if it is over the bounds of a broadcast."""
    words, pairs = counts.where("word is not null"), counts.where("word is null")
    if words.count() > MAX_WORDS or pairs.count() > MAX_PAIRS:
        return None
    return Lexicon({r[0]: r[1] for r in words.select("word", "n").collect()}, {_unsigned(r[0]) for r in pairs.select("pair").collect()})


def _unsigned(x: int) -> int:
    return x & 0xFFFFFFFFFFFFFFFF


def _asked(text: str) -> tuple[list[str], list[str]]:
    """(words, skeletons) that the reading of a text may ask a lexicon for."""
    text = plain_of(text)
    words = {m.group().lower() for m in _TOKEN.finditer(text)}
    for m in _SPLIT.finditer(text):
        words |= {(m.group(1) + m.group(4)).lower(), f"-{m.group(1)}-{m.group(4)}".lower()}
    words |= {w.replace("|", "1") for w in words}
    return sorted(words), sorted({s for w in words if w[0] != "-" for s in variants(w)} | {_digits(m.group()) for m in _NUMBER.finditer(text)})


def _ask_pass(batches):
    for batch in batches:
        keys, asked, kinds = [], [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for kind, names in enumerate(_asked(text or "")):
                keys += [key] * len(names)
                asked += names
                kinds += [kind] * len(names)
        yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(asked, pa.string()), pa.array(kinds, pa.int32())], names=["lex_key", "name", "kind"])


def _pair_pass(batches):
    """(lex_key, pair) of the neighbours that a text's candidates would have."""
    for batch in batches:
        keys, pairs = [], []
        for key, text, words, ns in zip(*(batch.column(k).to_pylist() for k in range(4))):
            lx = Lexicon(dict(zip(words, ns)), set())
            ms = list(_TOKEN.finditer(plain_of(text)))
            near = set()
            for a, b in zip(ms, ms[1:]):
                if a.end() + 1 == b.start():
                    x, y = a.group().lower(), b.group().lower()
                    near |= {int(_pair(lx._h(x), lx._h(d))[0]) for _, d in lx.candidates(y)} | {int(_pair(lx._h(d), lx._h(y))[0]) for _, d in lx.candidates(x)}
            keys += [key] * len(near)
            pairs += near
        yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(np.array(pairs, np.uint64).view(np.int64))], names=["lex_key", "pair"])


@F.pandas_udf(StringType())
def _skeleton(w: pd.Series) -> pd.Series:
    return w.map(single)


def _with_entries(df: DataFrame, text: str, counts: DataFrame) -> DataFrame:
    """df with the entries of the lexicon that its texts ask for: lex_words, lex_ns, lex_pairs."""
    df = written(df.withColumn("lex_key", F.xxhash64(text)), "p2-rows")
    texts = df.select("lex_key", F.col(text).alias("lex_text")).dropDuplicates(["lex_key"])
    words = counts.where("word is not null").select("word", "n")
    named = words.select(F.col("word").alias("name"), F.lit(0).alias("kind"), F.array(F.struct("word", "n")).alias("e"))
    grouped = words.where("not startswith(word, '-')").groupBy(_skeleton("word").alias("name")).agg(F.collect_list(F.struct("word", "n")).alias("e"))  # words of one skeleton are few
    asked = texts.mapInArrow(_ask_pass, "lex_key long, name string, kind int")
    got = asked.join(named.unionByName(grouped.withColumn("kind", F.lit(1))), ["name", "kind"]).groupBy("lex_key").agg(F.array_distinct(F.flatten(F.collect_list("e"))).alias("e"))
    got = written(got.select("lex_key", F.col("e.word").alias("lex_words"), F.col("e.n").alias("lex_ns")), "p2-asked")
    pairs = texts.join(got, "lex_key").select("lex_key", "lex_text", "lex_words", "lex_ns").mapInArrow(_pair_pass, "lex_key long, pair long")
    near = pairs.join(counts.where("word is null").select("pair"), "pair").groupBy("lex_key").agg(F.collect_set("pair").alias("lex_pairs"))
    return df.join(got, "lex_key", "left").join(near, "lex_key", "left").drop("lex_key")


def _lexicons(batch: pa.RecordBatch, lex):
    """The lexicon of each row of a batch: the broadcast one, or its own entries."""
    if lex is not None:
        return [lex.value] * batch.num_rows
    rows = zip(*(batch.column(c).to_pylist() for c in ("lex_words", "lex_ns", "lex_pairs")))
    return [Lexicon(dict(zip(w or (), n or ())), {_unsigned(x) for x in p or ()}) for w, n, p in rows]


def capital(word: str, like: str) -> str:
    return word.upper() if like.isupper() and len(like) > 1 else word[:1].upper() + word[1:] if like[:1].isupper() else word


def _digits(w: str) -> str:
    return single(w.lower().rstrip(".").replace("|", "1"))


def misreadings(text: str, lex: Lexicon, skip: list[tuple[int, int]] = (), sure: bool = True) -> list[tuple[int, int, str]]:
    """(start, end, what it was) of the misread words and move numbers; spans in skip are left out."""
    out: list[tuple[int, int, str]] = []
    free = lambda at: not any(s <= at < e for s, e in skip)
    for m in _NUMBER.finditer(text):
        number = lex.numbers.get(_digits(m.group()))
        if number and free(m.start()):
            out.append((m.start(), m.end(), number + "." * m.group().count(".")))
    taken = {s for s, *_ in out}
    ms = list(_TOKEN.finditer(text))
    for i, m in enumerate(ms):
        if m.start() in taken or not free(m.start()):
            continue
        left = ms[i - 1].group().lower() if i and ms[i - 1].end() + 1 == m.start() else ""
        right = ms[i + 1].group().lower() if i + 1 < len(ms) and m.end() + 1 == ms[i + 1].start() else ""
        was = lex.read(m.group(), left, right, sure)
        if was is not None:
            out.append((m.start(), m.end(), capital(was, m.group())))
    return sorted(out)


def plain_of(text: str) -> str:
    """The consistent form, with a soft hyphen at a line's end kept as a mark of a split word."""
    return consistent(text.replace("­\n", "¬\n")) if re.search(r"[^\x00-\x7f]", text) else text


def split_words(text: str, lex: Lexicon) -> list[tuple[int, int, str]]:
    """(start, end, joined word) of the words split at a line's end."""
    out = []
    for m in _SPLIT.finditer(text):
        a, mark, gap, b = m.groups()
        if not b[0].islower() or len(a) < 2 and mark == "-":
            continue
        low, whole = f"{a}{b}".lower(), f"{a}-{b}".lower()
        if mark == "-" and (whole in lex.compounds or len(a) < 2) and low not in lex.n:
            continue
        out.append((m.start(), m.end(), a + b))
    return out


def masked(line: str, lex: Lexicon) -> str:
    """A line with page numbers off, digits and squares masked, and words that aren't frequent masked."""
    core = _PAGED.sub("", line.strip())
    out = []
    for w in _TOKEN.findall(core.lower()):
        s = "#" if w.isdigit() or _PAGE.fullmatch(w) else "§" if re.fullmatch(r"[a-h][1-8]", w) else w if w in lex.n else lex.form(w) or "*"
        out.append(s)
    return " ".join(out)


def may_head(line: str) -> bool:
    """Whether a line can be a running head: short, starts like a title, closes no sentence, holds no move."""
    s = _PAGED.sub("", line.strip())
    return 3 <= len(s) <= 60 and (s[0].isupper() or s[0].isdigit()) and not re.search(r"[.,;:!?¬\-­…)]$", s) and not re.search(r"\d\.+\S|\.\s+\S+\s+\S+.*\.\s|[|\t]|\.{4}", s) and sum(c.isalpha() for c in s) >= 3


def is_page_number(line: str) -> bool:
    return bool(_PAGE.fullmatch(line.strip())) and bool(line.strip())


def furniture(lines: list[str], lex: Lexicon, heads: set[str]) -> list[bool]:
    """Which lines of a text are running heads or page numbers. A head must be masked to one of `heads`; without a page
    number or capitals it must leave room for the first word of the line after it."""
    out = [is_page_number(x) for x in lines]
    if len(lines) == 1:
        return [False]
    width = max((len(x.rstrip()) for x, f in zip(lines, out) if not f), default=0)
    for i, x in enumerate(lines):
        if out[i] or not heads or not may_head(x) or masked(x, lex) not in heads:
            continue
        nxt = next((y for y, f in zip(lines[i + 1 :], out[i + 1 :]) if not f and y.strip()), None)
        fits = nxt is not None and len(x.strip()) + 1 + len(nxt.split()[0]) + 3 <= width
        out[i] = fits or i < len(lines) - 1 and (bool(_PAGED.search(x.strip())) or x.strip().isupper())
    return out


def _edited(text: str, edits: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for s, e, w in sorted(edits):
        out += [text[at:s], w]
        at = e
    return "".join([*out, text[at:]])


def repair_node(text: str, lex: Lexicon, heads: set[str]) -> tuple[str, list[str]]:
    """(the text as continuous paragraphs, its faults)."""
    lines = plain_of(text).split("\n")
    gone = furniture(lines, lex, heads)
    body = "\n".join(x for x, g in zip(lines, gone) if not g)
    cuts = split_words(body, lex)
    wrong = misreadings(body, lex, [(s, e) for s, e, _ in cuts])
    joined = [(s, e, w, misreadings(w, lex)) for s, e, w in cuts]
    faults = ["furniture"] * any(gone) + ["hyphen"] * bool(cuts) + ["misread"] * bool(wrong or any(bad for *_, bad in joined))
    edits = wrong + [(s, e, _edited(w, bad)) for s, e, w, bad in joined]
    return re.sub(r"[ \t]*\n[ \t]*", " ", _edited(body, edits)).strip(), faults


def repair_span(r: dict, lex: Lexicon, heads: set[str]) -> tuple[str, list[str]]:
    """(the text of a span, '' for furniture; its faults). r holds what page_lines gives."""
    text, faults = r["text"], []
    plain = consistent(text.rstrip().removesuffix("­")) + ("¬" if text.rstrip().endswith("­") else "")
    at, top, bottom = (r[c] if r[c] is not None else -9 for c in ("line_no", "top", "bottom"))
    own_line = r["back_line"] != r["line_no"] and r["next_line"] != r["line_no"]
    if own_line and r["line_no"] is not None and (at <= top + 1 or at >= bottom - 1):
        if is_page_number(plain) or at <= top + 1 and heads and may_head(plain) and masked(plain, lex) in heads:
            return "", ["furniture"]
    sure = r["confidence"] is None or r["confidence"] >= SURE
    cut = _END.search(plain) if r["next_line"] != r["line_no"] else None
    if cut:
        after = consistent(r["next_text"]) if r["next_text"] else ""
        second = None if not after or is_page_number(after) or may_head(after) else re.match(r"\s*([^\W\d_]+)", after)
        half, rest = cut.group(1), second.group(1) if second else ""
        low, whole = (half + rest).lower(), f"{half}-{rest}".lower()
        own = cut.group(2) == "-" and (len(half) < 2 or second is not None and (not rest[0].islower() or whole in lex.compounds and low not in lex.n))
        if not own:
            faults.append("hyphen")
            bad = misreadings(low, lex, sure=sure) if second else []
            if any(s < len(half) and w[: len(half)].lower() != half.lower() for s, _, w in bad):
                faults.append("misread")
    wrong = misreadings(plain, lex, [(cut.start(), cut.end())] if cut else [], sure)
    if wrong and "misread" not in faults:
        faults.append("misread")
    return _edited(plain, wrong), faults


def _scan_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/library.parquet").where("stratum = 'scan'").select("doc_id").distinct()


def _all_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nodes.parquet").where("scope in ('all', 'comments')").select("text")
    return n.unionByName(spark.read.parquet(f"{sf_dir}/text_spans.parquet").select("text"))


def page_lines(spans: DataFrame) -> DataFrame:
    """Spans with what stands around them on their page, by windows: first and last line, next line, ends its line."""
    d = spans.dropDuplicates(["span_id"])
    page = Window.partitionBy("doc_id", "page")
    order = page.orderBy("line_no", "span_no", "span_id")
    return d.select(
        "span_id", "doc_id", "page", "line_no", "span_no", "text", "confidence",
        F.min("line_no").over(page).alias("top"), F.max("line_no").over(page).alias("bottom"),
        F.lead("text").over(order).alias("next_text"), F.lead("line_no").over(order).alias("next_line"),
        F.lag("line_no").over(order).alias("back_line"),
    )


_FIXED = "rec_kind string, rec_id long, text string, faults array<string>"


def _fixed(kind: str, rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([kind] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.list_(pa.string()))], names=["rec_kind", "rec_id", "text", "faults"])


def _span_pass(lex):
    def f(batches):
        for batch in batches:
            rows = []
            for r, lx in zip(batch.to_pylist(), _lexicons(batch, lex)):
                rows.append((r["span_id"], *(repair_span(r, lx, set(r["heads"] or ())) if r["text"] else (r["text"], []))))
            yield _fixed("span", rows)

    return f


def _node_pass(lex, models):
    def f(batches):
        for batch in batches:
            ids, texts, heads = (batch.column(c).to_pylist() for c in ("node_id", "text", "heads"))
            if not texts:
                continue
            x, lang = prose.text_stats(texts)
            d2 = np.full(len(texts), np.inf)
            for k, (mean, white) in models.items():
                m = (lang == k) | (lang < 0)
                if m.any():
                    d2[m] = np.minimum(d2[m], prose._distance(x[m], mean, white)[0])
            yield _fixed("node", [(i, *repair_node(t, lx, set(h or ()))) for i, t, h, d, lx in zip(ids, texts, heads, d2, _lexicons(batch, lex)) if d <= prose.CUT])

    return f


def _head_pass(lex, node: bool):
    """(doc_id, place, rec_id, mask) of the lines that may be heads."""

    def f(batches):
        for batch in batches:
            out: list[tuple] = []
            for doc, place, rec, t, lx in zip(*(batch.column(i).to_pylist() for i in range(4)), _lexicons(batch, lex)):
                for line in {x for x in plain_of(t).split("\n") if may_head(x)} if node else [x for x in [consistent(t)] if may_head(x)]:
                    mask = masked(line, lx)
                    if mask.count("*") < 2:
                        out.append((doc, place, rec, mask))
            yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "place", "rec_id", "mask"])

    return f


def _with_heads(rows: DataFrame, key: str, flags: DataFrame) -> DataFrame:
    """rows with their masked heads in `heads`; few flags are broadcast, so that no text is shuffled."""
    mine = flags.groupBy(F.col("rec_id").alias(key)).agg(F.collect_set("mask").alias("heads"))  # the lines of one record
    return rows.join(F.broadcast(mine) if flags.count() <= FLAGS else mine, key, "left")


def repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_kind, rec_id, text, faults) of the prose paragraphs and the spans of scanned documents."""
    scan = _scan_docs(spark, sf_dir)
    counts = _frequent(_all_texts(spark, sf_dir), "text")
    found = lexicon(counts)
    lex = spark.sparkContext.broadcast(found) if found else None
    at = spark.read.parquet(f"{sf_dir}/text_spans.parquet")
    if "confidence" not in at.columns:
        at = at.withColumn("confidence", F.lit(None).cast("double"))
    spans = written(page_lines(at.join(scan, "doc_id", "left_semi")), "p2-lines")
    nodes = spark.read.parquet(f"{sf_dir}/nodes.parquet").where("scope = 'all' and text is not null").join(scan, "doc_id", "left_semi").select("doc_id", "node_id", "text").where(F.col("text").rlike(r"\S"))
    stats = written(prose.statistics(nodes, "node_id", "text"), "p2-stats")
    if lex is None:
        spans = written(_with_entries(spans.withColumn("lex_in", F.concat_ws("\n", "text", "next_text")), "lex_in", counts), "p2-lines")
        nodes = written(_with_entries(nodes, "text", counts), "p2-nodes")
    own = [] if lex else ["lex_words", "lex_ns", "lex_pairs"]
    # a head stands in several pages or paragraphs of one document
    schema = "doc_id long, place long, rec_id long, mask string"
    tops = spans.where("line_no <= top + 1 and text <> ''").select("doc_id", F.xxhash64("doc_id", "page").alias("place"), F.col("span_id").alias("rec_id"), "text", *own).mapInArrow(_head_pass(lex, False), schema)
    lines = nodes.where(F.col("text").contains("\n")).select("doc_id", F.col("node_id").alias("place"), F.col("node_id").alias("rec_id"), "text", *own).mapInArrow(_head_pass(lex, True), schema)
    may = written(tops.withColumn("kind", F.lit("span")).unionByName(lines.withColumn("kind", F.lit("node"))), "p2-heads")
    heads = may.groupBy("mask", "doc_id").agg(F.countDistinct("kind", "place").alias("n")).where(F.col("n") >= HEADS).select("mask").distinct()
    flags = written(may.join(heads, "mask").select("kind", "rec_id", "mask").distinct(), "p2-flags")
    models = prose.fit(stats)
    out = _with_heads(spans, "span_id", flags.where("kind = 'span'")).mapInArrow(_span_pass(lex), _FIXED)
    if models:
        out = out.unionByName(_with_heads(nodes, "node_id", flags.where("kind = 'node'")).mapInArrow(_node_pass(lex, models), _FIXED))
    return out


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_kind, rec_id, fault of the faulty nodes and spans of scanned documents."""
    return repaired(spark, sf_dir).select("rec_kind", "rec_id", F.explode("faults").alias("fault")).distinct()


def p2_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repaired text of every prose paragraph of a scanned document: node_id, text."""
    return repaired(spark, sf_dir).where("rec_kind = 'node'").select(F.col("rec_id").alias("node_id"), "text").distinct()


_ENDS = r"[.!?:…][\"'»”’)\]]*\s*$"
_JOIN = r"(\p{L})(?:-|¬) +(?=\p{Ll})"


def paragraphs(fixed: DataFrame, at: DataFrame) -> DataFrame:
    """(doc_id, page, para, spans, text): the repaired spans of each page as paragraphs. fixed: span_id, text; at:
    span_id, doc_id, page, line_no, span_no.

    A line opens a paragraph if the one before it closes a sentence and is shorter than SHORT of the page's widest. A
    page's first paragraph belongs to the last one of the page before it, if that closes no sentence; it is joined to it
    unless it is its page's only one.
    """
    page = Window.partitionBy("doc_id", "page")
    order = page.orderBy("line_no", "span_no", "span_id")
    d = fixed.where("text <> ''").join(at, "span_id")
    back = F.lag("text").over(order)
    d = d.withColumn("opens", (F.coalesce(back.rlike(_ENDS), F.lit(False)) & (F.length(back) < SHORT * F.max(F.length("text")).over(page)) & F.col("text").rlike(r"^\W*[\p{Lu}\d]")).cast("int"))
    d = d.withColumn("para", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "span_no", "span_id", "text"))), lambda s: s["text"]), " ")
    p = d.groupBy("doc_id", "page", "para").agg(F.count("*").alias("spans"), F.regexp_replace(joined, _JOIN, "$1").alias("text"))  # the lines of a page
    p = written(p.withColumn("last", F.max("para").over(page)), "p2-paragraphs")
    first = p.where("para = 0 and last > 0").select("doc_id", (F.col("page") - 1).alias("page"), F.col("spans").alias("more_spans"), F.col("text").alias("more"))
    open_ = p.where("para = last").where(~F.col("text").rlike(_ENDS)).join(first, ["doc_id", "page"])
    tails = open_.select("doc_id", "page", "para", "more_spans", "more")
    moved = tails.select("doc_id", (F.col("page") + 1).alias("page"), F.lit(0).cast("long").alias("para"))
    out = p.join(tails, ["doc_id", "page", "para"], "left").join(moved, ["doc_id", "page", "para"], "left_anti")
    text = F.regexp_replace(F.concat_ws(" ", "text", "more"), _JOIN, "$1")
    return out.select("doc_id", "page", "para", (F.col("spans") + F.coalesce("more_spans", F.lit(0))).alias("spans"), text.alias("text"))


SHORT = 0.85


def p2_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraphs of every scanned page: doc_id, page, para, spans, text."""
    fixed = repaired(spark, sf_dir).where("rec_kind = 'span'").select(F.col("rec_id").alias("span_id"), "text").dropDuplicates(["span_id"])
    at = spark.read.parquet(f"{sf_dir}/text_spans.parquet").select("span_id", "doc_id", "page", "line_no", "span_no").dropDuplicates(["span_id"])
    return paragraphs(fixed, at)
