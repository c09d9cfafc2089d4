"""Missing or wrong language labels, and texts that mix languages (problem 6).

Word-first backoff: a word the model knows is scored by its log frequency in each language; an unseen word falls
back to its character n-grams, from FIRST characters down to one, taking the longest that are known. The scores of
a sentence's words add up; a sentence takes its best language, consecutive sentences of one language make a
segment, and the confidence is the best language's share of the softmax of the scores, at a temperature that is fitted
to the sentences of a fifth of the rows, which the model it is fitted with has not seen.

The model is fitted here, on at most FIT_ROWS rows a language whose label names it, chosen by the smallest hash of
their key; it is fitted again on the sentences of those rows that the first fit assigns to the row's label, which
drops wrong labels and foreign sentences. Everything else covers all rows.

An older detector's codes are an unreliable hint: they decide only for a text in one language whose confidence is
under LOW.

Null, empty and letterless texts have no language: no segment, no case. A repeated row counts once; a key with several
texts has the segments of each. Labels are read in any code form (EN, eng, en-GB, English). Ties of scores go to the
language first in LANGS, ties of hints to the code first in the alphabet.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LANGS = ("en", "de", "es", "pt", "ru", "fr")
FIT_ROWS = 1500
FIRST = 5
FLOOR = 6.0  # nats by which one word can speak against a language
HEATS = tuple(2.0**k for k in range(-4, 5))  # temperatures tried
LOW = 0.5  # confidence under which a hint decides
MARGIN = 7.0  # nats by which a sentence must prefer its language to the main one to count as another
# Other codes and names of the languages.
FORMS = {
    "en": "en eng english englisch inglés", "de": "de deu ger german deutsch", "es": "es spa spanish español castellano",
    "pt": "pt por portuguese português", "ru": "ru rus russian русский", "fr": "fr fra fre french français",
}

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"»”')\]]*\s+|\s+[—–|/]\s+|\n+")


def label_code(label: str) -> Column:
    """The language a label names, null if it names none."""
    low = F.lower(F.trim(F.col(label)))
    head = F.regexp_extract(low, r"^([^-_]+)", 1)
    out = F.lit(None).cast("string")
    for code, forms in FORMS.items():
        out = F.when(low.isin(*forms.split()) | head.isin(*forms.split()[:3]), code).otherwise(out)
    return out


def sentences(text: str) -> list[tuple[int, str]]:
    """(start, sentence) of the pieces of a text; joined with what separates them they are the text."""
    out, at = [], 0
    for m in _SENTENCE.finditer(text):
        if m.end() < len(text) and text[m.end()].islower() and "\n" not in m.group() and text[m.start() - 1] in ".!?…":
            continue  # an annotated move or an abbreviation, not the end of a sentence
        if "\n" not in m.group() and len(_WORD.findall(text[at : m.start()])) < 4 and re.search(r"\d\S*[!?]+$", text[at : m.start()]):
            continue  # an opening phrase with an annotated move
        if text[at : m.start()].strip():
            out.append((at, text[at : m.start()]))
        at = m.end()
    if text[at:].strip():
        out.append((at, text[at:]))
    return out


class Model:
    """Log frequencies of words and of character n-grams in each language."""

    def __init__(self, rows: list[tuple[str, str]]):
        words = {k: Counter() for k in LANGS}
        for code, text in rows:
            words[code].update(_WORD.findall(text.lower()))
        n = {k: sum(c.values()) or 1 for k, c in words.items()}
        both = Counter()
        for c in words.values():
            both.update(c)
        seen = {w for w, k in both.items() if k >= 3}
        self.words = {w: tuple(math.log((words[k][w] + 0.05) / (n[k] + 0.05 * len(seen))) for k in LANGS) for w in seen}
        grams = {k: Counter() for k in LANGS}
        for k, c in words.items():
            for w, x in c.items():
                for g in self._grams(w):
                    grams[k][g] += min(x, 20)
        total = {k: Counter() for k in LANGS}
        for k, c in grams.items():
            for g, x in c.items():
                total[k][len(g)] += x
        known = Counter()
        for c in grams.values():
            known.update(c)
        self.grams = {g: tuple(math.log((grams[k][g] + 0.5) / (total[k][len(g)] + 50)) for k in LANGS) for g, x in known.items() if x >= 5}
        self.cache: dict[str, tuple] = {}
        self.heat = 1.0

    @staticmethod
    def _grams(word: str):
        w = f"<{word}>"
        for n in range(1, FIRST + 1):
            for i in range(len(w) - n + 1):
                yield w[i : i + n]

    def word(self, w: str) -> tuple:
        found = self.cache.get(w)
        if found is None:
            found = self.words.get(w)
            if found is None:
                found = self._backoff(w)
            top = max(found)
            found = tuple(max(x - top, -FLOOR) for x in found)
            if len(self.cache) < 200_000:
                self.cache[w] = found
        return found

    def _backoff(self, word: str) -> tuple:
        w, i, sums, n = f"<{word}>", 0, [0.0] * len(LANGS), 0
        while i < len(w):
            for k in range(min(FIRST, len(w) - i), 0, -1):
                g = self.grams.get(w[i : i + k])
                if g:
                    sums = [a + b for a, b in zip(sums, g)]
                    n += 1
                    i += k
                    break
            else:
                i += 1
        return tuple(0.5 * x / max(n, 1) for x in sums)

    def score(self, text: str) -> tuple[list[float], int]:
        """(score of each language, number of words)."""
        ws = _WORD.findall(text.lower())
        sums = [0.0] * len(LANGS)
        for w in ws:
            if len(w) > 1:
                sums = [a + b for a, b in zip(sums, self.word(w))]
        return sums, len(ws)


def _agreeing(model: Model, rows: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The sentences of labelled texts that the model assigns to their label."""
    out = []
    for code, t in rows:
        for _, s in sentences(t):
            sc, n = model.score(s)
            if n and LANGS[max(range(len(LANGS)), key=sc.__getitem__)] == code:
                out.append((code, s))
    return out


def _heat(rows: list[tuple[str, str]]) -> float:
    """The temperature at which a model of four fifths of the sentences gives the others the least log loss."""
    held = [x for i, x in enumerate(rows) if i % 5 == 0]
    model = Model([x for i, x in enumerate(rows) if i % 5])
    scored = [(LANGS.index(code), *model.score(s)) for code, s in held]
    loss = lambda heat: -sum(math.log(max(_shares(sc, n, heat)[k], 1e-12)) for k, sc, n in scored)
    return min(HEATS, key=lambda h: (loss(h), h)) if scored else 1.0


def fit(df: DataFrame, key: str, label: str, text: str) -> Model:
    """The model, from at most FIT_ROWS labelled rows a language."""
    rows = df.select(F.col(key).alias("k"), label_code(label).alias("code"), F.col(text).alias("t")).where("code is not null and t is not null and k is not null")
    first = F.dense_rank().over(Window.partitionBy("code").orderBy(F.xxhash64("k"), "k"))  # each task passes on its first FIT_ROWS keys a language
    got = {(r["code"], r["k"], r["t"]) for r in rows.select("code", "k", "t", first.alias("i")).where(F.col("i") <= FIT_ROWS).collect()}
    rows = [(code, t) for code, _, t in sorted(got)]
    kept = _agreeing(Model(rows), rows)
    model = Model(kept or rows)
    model.heat = _heat(kept)
    return model


def _shares(scores: list[float], words: int, heat: float) -> list[float]:
    best, t = max(scores), heat * max(1.0, math.sqrt(words))
    e = [math.exp((x - best) / t) for x in scores]
    return [x / sum(e) for x in e]


def segment(model: Model, text: str) -> list[tuple[str, float, int, int]]:
    """(code, confidence, start, end) of each segment of a text."""
    scored = [(s, t, *model.score(t)) for s, t in sentences(text)]
    if not any(n for *_, n in scored):
        return []
    total = [sum(x) for x in zip(*(sc for _, _, sc, _ in scored))]
    main = max(range(len(LANGS)), key=total.__getitem__)
    votes = Counter()
    for _, _, sc, n in scored:
        if n:
            votes[max(range(len(LANGS)), key=sc.__getitem__)] += n
    if votes:
        main = max(votes, key=lambda k: (votes[k], total[k]))
    out: list[list] = []
    for s, t, sc, n in scored:
        best = max(range(len(LANGS)), key=sc.__getitem__)
        if best != main and (n < 4 or sc[best] - sc[main] < MARGIN):
            best = main
        if out and out[-1][0] == best:
            out[-1][1] = [a + b for a, b in zip(out[-1][1], sc)]
            out[-1][2] += n
            out[-1][4] = s + len(t)
        else:
            out.append([best, sc, n, s, s + len(t)])
    return [(LANGS[b], _shares(sc, n, model.heat)[b], s, e) for b, sc, n, s, e in out]


def _segment_pass(model):
    def f(batches):
        m = model.value
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i, (code, c, s, e) in enumerate(segment(m, text)):
                    for col, x in zip(cols, (key, i, code, c, s, e)):
                        col.append(x)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32()))], names=["key", "segment", "code", "confidence", "start", "end"])

    return f


def segments(df: DataFrame, key: str, label: str, text: str) -> DataFrame:
    """(key, segment, code, confidence, start, end) of every text with letters."""
    model = df.sparkSession.sparkContext.broadcast(fit(df, key, label, text))  # bounded by FIT_ROWS
    src = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("t")).where("key is not null and t <> ''")
    return src.mapInArrow(_segment_pass(model), "key long, segment int, code string, confidence double, start int, end int").distinct()


def languages(df: DataFrame, key: str, label: str, text: str, hints: DataFrame | None = None) -> DataFrame:
    """(key, label_code, hint, codes, confidence): the languages of every text beside the one its label names and the
    one that is hinted at. hints: (key, code, score), where the code of the highest score is the hint."""
    seg = segments(df, key, label, text).groupBy("key").agg(F.sort_array(F.collect_set("code")).alias("codes"), F.min("confidence").alias("confidence"))
    labels = df.select(F.col(key).cast("long").alias("key"), label_code(label).alias("label_code")).groupBy("key").agg(F.min("label_code").alias("label_code"))
    out = seg.join(labels, "key")
    if hints is None:
        return out.select("key", "label_code", F.lit(None).cast("string").alias("hint"), "codes", "confidence")
    best = hints.select(F.col("key").cast("long").alias("key"), label_code("code").alias("hint"), "score").where("hint is not null and score is not null")
    best = best.groupBy("key").agg(F.min_by("hint", F.struct(-F.col("score"), "hint")).alias("hint"))
    weak = (F.size("codes") == 1) & (F.col("confidence") < LOW) & F.col("hint").isNotNull()
    return out.join(best, "key", "left").select("key", "label_code", "hint", F.when(weak, F.array("hint")).otherwise(F.col("codes")).alias("codes"), "confidence")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = spark.read.parquet(f"{sf_dir}/authored.parquet")
    hints = spark.read.parquet(f"{sf_dir}/language_scores.parquet").select(F.col("item_id").alias("key"), "code", "score")
    return languages(a, "item_id", "lang", "text", hints)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, code: languages of the items whose label is missing, no language or wrong, and of mixed items."""
    found = _items(spark, sf_dir).where(F.col("label_code").isNull() | (F.size("codes") > 1) | (F.col("codes")[0] != F.col("label_code")))
    return found.select(F.col("key").alias("item_id"), F.explode("codes").alias("code"))


def p6_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item's languages and confidence, beside its label and the older detector's hint."""
    return _items(spark, sf_dir).select(F.col("key").alias("item_id"), "label_code", "hint", F.array_join("codes", ",").alias("codes"), F.round("confidence", 4).alias("confidence"))


def p6_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment of every authored item with its language and confidence."""
    a = spark.read.parquet(f"{sf_dir}/authored.parquet")
    return segments(a, "item_id", "lang", "text").select(F.col("key").alias("item_id"), "segment", "code", F.round("confidence", 4).alias("confidence"), "start", "end")
