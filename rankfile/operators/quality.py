"""Quality of recognised prose without the true text: lexicons, languages, plausibility, an estimate of the error rate.

Texts are taken apart once into words; what is asked of a word (the languages that know it, how plausible its letters
follow each other, whether it can be a word at all) is worked out per different word and joined back. Null and empty
texts have no rows. Notation is no evidence about prose and is left out of every word figure.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import call
from ..session import written

LANGS = ("de", "en", "es", "fr", "pt", "ru")
LEAST_ITEMS, LEAST_SHARE = 2, 0.25  # texts a word needs, and share of its best language's frequency
# Evidence a language needs, the levels of clean text, the mean length of a word, how much damage shows.
MIN_TOKENS, MARGIN = 12, 0.08
CLEAN_HITS, CLEAN_NGRAMS, WORD_LENGTH, SHOWN = 0.55, 0.97, 5.0, 0.55
WORDS = r"(?:\p{L}\p{M}*){2,}"
NOTATION = r"^(?:\d+\.*)?(?:[KQRBNDTSLCFAPКФЛСp♔♕♖♗♘♙♚♛♜♝♞♟]?[a-h]?[1-8]?[x:]?[a-h][1-8](?:=?[QRBNDTSLCA])?|[0Oo]-[0Oo](?:-[0Oo])?)?[+#!?=±∓∞]*$|^(?:1-0|0-1|1/2-1/2|½-½)$"


def chunks(text: str) -> Column:
    """The chunks between blanks, without signs at either end but those of moves."""
    return F.filter(F.transform(F.split(text, r"(?U)\s+"), lambda c: F.regexp_replace(c, r"^[(\[{«„“\"'‘]+|[)\]}»”\"'’.,;:]+$", "")), lambda c: c != "")


def words(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, word): the words of two letters or more, in lower case, of the chunks that are no notation."""
    return _words(df.where(F.col(text) != "").select(F.col(key).alias("key"), chunks(text).alias("chunk_list")))


def _words(d: DataFrame) -> DataFrame:
    prose = F.filter("chunk_list", lambda c: ~c.rlike(NOTATION))
    return d.select("key", F.explode(F.regexp_extract_all(F.lower(F.array_join(prose, " ")), F.lit(WORDS), F.lit(0))).alias("word"))


def lexicons(items: DataFrame, key: str, label: str, text: str) -> DataFrame:
    """(code, word, n): the words of each language, from texts whose label names it. Labels may be wrong and texts mixed, so
    a word needs LEAST_ITEMS texts and LEAST_SHARE of the relative frequency it has in its best language."""
    d = items.select(key, call("language_code", x=label).alias("code"), text).where(F.col("code").isin(*LANGS)).distinct()
    w = words(d.select(F.struct(key, "code").alias("k"), text), "k", text).select(F.col("key.code").alias("code"), F.col(f"key.{key}").alias("item"), "word")
    n = w.groupBy("code", "word").agg(F.count("*").alias("n"), F.countDistinct("item").alias("items"))
    total = n.groupBy("code").agg(F.sum("n").alias("total"))  # a row a language
    rate = F.col("n") / F.col("total")
    n = n.join(F.broadcast(total), "code").withColumn("rate", rate).withColumn("top", F.max("rate").over(Window.partitionBy("word")))
    return n.where((F.col("items") >= LEAST_ITEMS) & (F.col("rate") >= LEAST_SHARE * F.col("top"))).select("code", "word", "n")


def bigrams(lexicon: DataFrame) -> DataFrame:
    """(pair, lp): log2 probability of a letter after another, word ends included, over all lexicons, one added to each pair."""
    p = lexicon.select(F.concat(F.lit("^"), "word", F.lit("$")).alias("w"), "n")
    p = p.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substr("w", i, F.lit(2)))).alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n"))
    first = F.substring("pair", 1, 1)
    w = Window.partitionBy(first)  # the pairs of one letter
    return p.select("pair", F.log2((F.col("n") + 1) / (F.sum("n").over(w) + F.count("*").over(w) + 1)).alias("lp"))


UNSEEN = -12.0  # log2 probability of a pair that no lexicon has


def known_words(found: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, codes, lp, odd) of the different words: the languages that know them, the mean log2 probability of their pairs,
    and whether they can't be words (letters of two scripts, or four consonants and more without a vowel)."""
    w = found.select("word").distinct()
    codes = lexicon.groupBy("word").agg(F.sort_array(F.collect_set("code")).alias("codes"))  # six at most
    marked = F.concat(F.lit("^"), "word", F.lit("$"))
    pairs = w.select("word", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda i: F.substr(marked, i, F.lit(2)))).alias("pair"))
    lp = pairs.join(F.broadcast(bigrams(lexicon)), "pair", "left").groupBy("word").agg(F.avg(F.coalesce("lp", F.lit(UNSEEN))).alias("lp"))
    odd = (F.col("word").rlike(r"\p{IsLatin}") & F.col("word").rlike(r"\p{IsCyrillic}")) | F.col("word").rlike("^[bcdfghjklmnpqrstvwxzбвгджзклмнпрстфхцчшщ]{4,}$")
    return w.join(codes, "word", "left").join(lp, "word").select("word", F.coalesce("codes", F.array().cast("array<string>")).alias("codes"), "lp", odd.alias("odd"))


def signals(df: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """(key, chars, chunks, notation_ratio, implausible_ratio, odd_chunks, judged, hits_<lang>, odd_words, lp, clean_lp) of
    every text. clean_lp is the mean of lp over the lexicons' words."""
    lexicon = written(lexicon, "lexicons")
    d = df.where(F.col(text) != "").select(F.col(key).alias("key"), F.col(text).alias("text")).distinct().withColumn("chunk_list", chunks("text"))
    d = written(d, "chunks")  # taken apart once
    c = F.col("chunk_list")
    own = d.select(
        "key", F.length(F.regexp_replace("text", r"(?U)\s", "")).alias("chars"), F.size(c).alias("chunks"),
        F.coalesce(F.try_divide(F.size(F.filter(c, lambda x: x.rlike(NOTATION))), F.size(c)), F.lit(0.0)).alias("notation_ratio"),
        F.size(F.filter(c, lambda x: ~x.rlike(NOTATION) & x.rlike(r"\p{L}\d+\p{L}|\p{L}\p{L}\d|\d\p{L}\p{L}"))).alias("odd_chunks"),
        (F.length(F.regexp_replace("text", r"[\p{L}\p{M}\p{N}\s.,;:!?()\[\]+=#/½♔-♟«»„“”‘’'\"–—…*-]", "")) / F.length("text")).alias("implausible_ratio"),
    )
    w = written(_words(d.select("key", "chunk_list")), "words")
    table = known_words(w, lexicon)
    per = w.join(table, "word").groupBy("key").agg(F.count("*").alias("judged"), F.count_if("odd").alias("odd_words"), F.avg("lp").alias("lp"), *(F.count_if(F.array_contains("codes", k)).alias(f"hits_{k}") for k in LANGS))
    clean = known_words(lexicon.select("word"), lexicon).agg(F.avg("lp").alias("clean_lp"))  # one row
    return own.join(per, "key", "left").fillna(0, ["judged", "odd_words", *(f"hits_{k}" for k in LANGS)]).crossJoin(F.broadcast(clean))


def prose_language(s: DataFrame, hint: Column | None = None) -> DataFrame:
    """s with code, share, margin, confident: the language that knows most of the judged words, by how much it leads, and
    whether there are enough words and lead. Otherwise the code is the hint, null without one. Ties go to the first of LANGS."""
    rate = F.array(*[F.struct(F.coalesce(F.try_divide(f"hits_{k}", "judged"), F.lit(0.0)).alias("rate"), F.lit(-i).alias("i"), F.lit(k).alias("code")) for i, k in enumerate(LANGS)])
    order = F.sort_array(rate, False)
    sure = (F.col("judged") >= MIN_TOKENS) & (order[0]["rate"] - order[1]["rate"] >= MARGIN)
    return s.withColumns({"code": F.when(sure, order[0]["code"]).otherwise(hint if hint is not None else F.lit(None)), "share": order[0]["rate"], "margin": order[0]["rate"] - order[1]["rate"], "confident": sure})


def document_languages(s: DataFrame, doc: str) -> DataFrame:
    """(doc, code, share, margin, confident) over the words of all of a document's texts."""
    return prose_language(s.groupBy(doc).agg(F.sum("judged").alias("judged"), *(F.sum(f"hits_{k}").alias(f"hits_{k}") for k in LANGS))).select(doc, "code", "share", "margin", "confident")


def plausible(s: DataFrame) -> DataFrame:
    """s with hit_rate, nonword_ratio and ngram_plausibility (0 at pairs no lexicon has, 1 at the lexicons' own mean)."""
    hits = reduce(lambda acc, k: F.when(F.col("code") == k, F.col(f"hits_{k}")).otherwise(acc), LANGS, F.greatest(*(f"hits_{k}" for k in LANGS)))
    ngram = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("lp") - UNSEEN) / (F.col("clean_lp") - UNSEEN)))
    seen = F.col("odd_words") + F.col("odd_chunks")
    return s.withColumns({"hit_rate": F.coalesce(F.try_divide(hits, "judged"), F.lit(0.0)), "nonword_ratio": F.coalesce(F.least(F.lit(1.0), F.try_divide(seen, F.col("judged") + F.col("odd_chunks"))), F.lit(0.0)), "ngram_plausibility": F.coalesce(ngram, F.lit(1.0))})


def _per_character(damaged: Column) -> Column:
    """Error rate of characters at which this share of words of the mean length is damaged."""
    return 1 - F.pow(1 - F.least(F.lit(0.999), F.greatest(F.lit(0.0), damaged)), 1 / WORD_LENGTH)


def estimated_error(s: DataFrame, baseline: Column | None = None) -> DataFrame:
    """s with cer and cer_confidence. baseline: the hit rate of clean pages of the same book, if it is known."""
    tokens, ngram = _per_character(F.col("nonword_ratio") / SHOWN), _per_character((CLEAN_NGRAMS - F.col("ngram_plausibility")) / CLEAN_NGRAMS)
    cer = tokens + 0.5 * F.greatest(F.lit(0.0), ngram - tokens)
    if baseline is not None:
        weight = 0.5 * F.least(F.lit(1.0), F.col("judged") / 48)
        fall = _per_character((baseline - F.col("hit_rate")) / baseline)
        cer = F.when(baseline > 0.05, (1 - weight) * cer + weight * fall).otherwise(cer)
    cer = F.least(F.lit(1.0), cer + F.col("implausible_ratio") * (1 - cer))
    sure = F.least(F.lit(1.0), F.col("judged") / 24) * F.least(F.lit(1.0), F.col("chars") / 40) * F.when(F.col("notation_ratio") > 0.5, F.greatest(F.lit(0.0), 2 - 2 * F.col("notation_ratio"))).otherwise(1.0)
    return s.withColumns({"cer": F.when(F.col("chars") > 0, cer).otherwise(0.0), "cer_confidence": F.when(F.col("chars") > 0, sure).otherwise(0.0)})


def text_plausibility(s: DataFrame) -> DataFrame:
    """s with plausibility: 0 to 1, real language or notation."""
    evidence = F.least(F.lit(1.0), F.col("judged") / 24)
    lexical = evidence * F.least(F.lit(1.0), F.col("hit_rate") / CLEAN_HITS) + (1 - evidence) * F.col("ngram_plausibility")
    score = (0.6 * lexical + 0.4 * F.col("ngram_plausibility")) * (1 - F.col("implausible_ratio")) * (1 - 0.5 * F.col("nonword_ratio"))
    w = F.least(F.lit(1.0), 2 * (F.col("notation_ratio") - 0.5))
    return s.withColumn("plausibility", F.when(F.col("chars") == 0, 0.0).when(F.col("notation_ratio") > 0.5, (1 - w) * score + w * F.greatest(score, F.lit(0.65))).otherwise(score))


def book_baselines(s: DataFrame, doc: str) -> DataFrame:
    """(doc, baseline): the 80th percentile of the hit rate over its texts of 24 judged words or more, of documents with three."""
    enough = s.where("judged >= 24").groupBy(doc)
    return enough.agg(F.count("*").alias("n"), F.expr("percentile(hit_rate, 0.8)").alias("baseline")).where("n >= 3").select(doc, "baseline")


# Severities by error rate and confidence.
def severity(cer: str, confidence: str) -> Column:
    return F.when((F.col(cer) > 0.02) | (F.col(confidence) < 0.45), "bad").when((F.col(cer) > 0.005) | (F.col(confidence) < 0.80), "attention").otherwise("ok")


# --- notation

PIECES = {"en": "KQRBN", "de": "KDTLS", "es": "RDTAC", "fr": "RDTFC", "pt": "RDTBC", "ru": "КФЛС"}  # fixed values: piece letters


def convention(text: str, prose: Column | None = None) -> Column:
    """struct(locale, share, moves): the locale whose letters open most of the piece moves of a text; ties go to the locale of
    its prose, then to the first of PIECES. Null without piece moves."""
    heads = F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\d])([A-ZКФЛС])[a-h]?[1-8]?x?[a-h][1-8]"), F.lit(1))
    count = lambda letters: F.size(F.filter(heads, lambda c: F.lit(letters).contains(c)))
    scored = F.array(*[F.struct(count(p).alias("n"), (F.lit(1) if prose is None else F.coalesce((prose == k).cast("int"), F.lit(0))).alias("own"), F.lit(-i).alias("i"), F.lit(k).alias("locale")) for i, (k, p) in enumerate(PIECES.items())])
    best = F.array_max(scored)
    return F.when((F.size(heads) > 0) & (best["n"] > 0), F.struct(best["locale"].alias("locale"), (best["n"] / F.size(heads)).alias("share"), F.size(heads).alias("moves")))


# --- dictionaries with affixes


def affixed(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """(word): every form of a dictionary. entries: word, flags (each character names rules); rules: flag, kind (suffix or
    prefix), strip, add, condition (a pattern at that end). A suffix and a prefix may apply together."""
    e = entries.select("word", F.explode_outer(F.split("flags", "")).alias("flag"), "flags")

    def apply(base: DataFrame, kind: str) -> DataFrame:
        r = F.broadcast(rules.where(F.col("kind") == kind))
        d = base.join(r, "flag")
        fits = F.expr("rlike(word, concat(condition, '$'))" if kind == "suffix" else "rlike(word, concat('^', condition))")
        held = F.expr("endswith(word, strip)" if kind == "suffix" else "startswith(word, strip)")
        core = F.expr("substring(word, 1, length(word) - length(strip))" if kind == "suffix" else "substring(word, length(strip) + 1)")
        form = F.concat(core, "add") if kind == "suffix" else F.concat(F.col("add"), core)
        return d.where(fits & held).select(form.alias("word"), "flags")

    suffixed = apply(e, "suffix")
    again = suffixed.select("word", F.explode(F.split("flags", "")).alias("flag"), "flags")
    parts = [entries.select("word"), suffixed.select("word"), apply(e, "prefix").select("word"), apply(again, "prefix").select("word")]
    return reduce(DataFrame.unionByName, parts).distinct()


def is_word(tokens: DataFrame, word: str, forms: DataFrame) -> DataFrame:
    """tokens with known: the word, its lower case, or its capital form is in the dictionary."""
    f = forms.select(F.col("word").alias("_form")).distinct()
    t = tokens.withColumn("_tries", F.array_distinct(F.array(F.col(word), F.lower(word), F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.expr(f"substring({word}, 2)"))))))
    hit = t.select(word, F.explode("_tries").alias("_form")).join(f, "_form", "left_semi").select(F.col(word).alias("_hit")).distinct()
    return t.drop("_tries").join(hit, F.col(word) == F.col("_hit"), "left").withColumn("known", F.col("_hit").isNotNull()).drop("_hit")
