"""Per-document statistics of text quality and a verdict prose or not (problem 1).

Fourteen statistics are computed for every text, in one pass over all characters of a batch. For each language (by
its common words) the mean and covariance of prose are estimated robustly, on all rows: start from the quartiles,
then twice keep the rows near the centre and take their mean and covariance (concentration steps, the covariance
scaled up for the rows that were left out). A text's outlierness is its Mahalanobis distance from its language's
prose. The deviations from the mean are whitened by the root of the inverse correlation, which keeps each component
as near to its statistic as it can be; the squares of the components are the statistics' contributions, none is
negative, and they add up to the squared distance. For statistics that only speak against prose in one direction
(fewer common words, more symbols) a component in the other direction is zero. A text in no known language is
compared with every language and keeps the smallest distance.

Null, empty and blank texts get no row. Languages with under MIN_ROWS rows use the pooled prose. Repeated rows
each get their row. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from .words import _powers, by_code, mixed

# Common words of each language.
COMMON = {
    "en": "the of and to in a is that for as was with be by on not but at are this from or an which were there if so its about into than when after because where while since without any every against under over only once more such other can will would has have had been no out up two just here most very",
    "de": "der die das und in zu den von ist mit auf für im nicht ein eine dem des sich auch als an nach wie aus bei es doch weil denn ohne wird nur noch gegen jede zwei trotz unter über aber oder wenn so zum zur hat war",
    "es": "el la de que y en los las un una del al con por para se no es como más pero su lo sin tras desde sobre muy donde cuando ha toda contra todo bajo dos hasta entre también ya fue este esta son sin mucho",
    "pt": "o a de que e em os as um uma do da no na com por para se não é como mais mas seu dos das após desde sobre ao à pelo sem toda todo sob dois até entre também já foi este esta são muito contra",
    "fr": "le la les de des et en un une du au que qui dans pour par sur pas est avec plus mais ne se son sans après depuis aux toute comme rien contre tout sous deux entre aussi très été cette ces où très il elle n d l",
    "ru": "и в на не что с по как к из у за от но это для при после же так то а бы все весь всё без под над перед ещё его году года был была два две уже или раз нет где когда ли чем при обоих всем",
}
LANGS = tuple(COMMON)
STATS = ("log_words", "word_length", "common_share", "symbol_share", "line_end_share", "title_share", "number_share", "single_share", "vowelless_share", "odd_word_share", "distinct_share", "leader_share", "item_share", "accent_share")
#: +1: only more is against prose, -1: only less is, 0: both.
SIDE = np.array([0, 0, -1, 1, -1, 1, 1, 1, 1, 1, -1, 1, 1, 1])
#: The smallest standard deviation taken for a statistic, so that near-constant ones don't decide alone.
FLOOR = np.array([1.0, 0.9, 0.08, 0.03, 0.25, 0.10, 0.06, 0.06, 0.05, 0.05, 0.12, 0.015, 0.12, 0.06])
MIN_ROWS = 200
SHRINK = 0.2  # share by which the estimated correlations are drawn to zero
#: Squared distance beyond which a text is no prose. Of normal deviations, where each of the ten one-sided statistics
#: counts half the time, 98 of 100 lie within (a mixture of chi-square distributions of 4 to 14 degrees of freedom).
CUT = 20.0
RESCALE = 1.02  # covariance of all normal rows, of that of the rows within CUT

_tables: dict = {}


def _lower(c: str) -> int:
    low = c.lower()
    return ord(low) if len(low) == 1 else ord(c)


def _known() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the common words, and the set of their languages as bits."""
    if "known" not in _tables:
        bits: dict[int, int] = {}
        for k, lang in enumerate(LANGS):
            for w in COMMON[lang].split():
                h = int(_hash(np.array([ord(c) for c in w], np.uint32), np.array([0]), np.array([len(w)]))[0])
                bits[h] = bits.get(h, 0) | 1 << k
        keys = np.array(sorted(bits), np.uint64)
        _tables["known"] = keys, np.array([bits[int(k)] for k in keys], np.int64)
    return _tables["known"]


def _hash(code: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    power, inverse = _powers(len(code))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * power, dtype=np.uint64)])
    return mixed((total[stops] - total[starts]) * inverse[starts] + (stops - starts).astype(np.uint64))


def text_stats(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(statistics, one row a text; index of its language, -1 unknown). Words are runs of letters and digits."""
    n = len(texts)
    code = np.frombuffer("\n".join(texts + [""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts])
    low = by_code("lower", _lower, np.uint32)[code]
    alpha, digit = by_code("alpha", str.isalpha)[code], by_code("digit", str.isdigit)[code]
    upper, space = by_code("upper", str.isupper)[code], by_code("space", str.isspace)[code]
    vowel = by_code("vowel", lambda c: c in "aeiouyаеёиоуыэюя" or (ord(c) > 191 and c.isalpha() and c.lower() == c and ord(c) < 0x250))[low]
    fine = by_code("fine", lambda c: c in ".,;:!?'\"()-–—…¬«»„“”’+#=/½")[code]
    sums = {k: np.concatenate([[0], np.cumsum(v)]) for k, v in (("digit", digit), ("upper", upper), ("vowel", vowel))}
    inside = (alpha | digit).astype(np.int8)
    edge = np.diff(inside, prepend=np.int8(0), append=np.int8(0))
    a, b = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    doc = np.searchsorted(ends, a, "right")
    per = lambda m: np.bincount(doc[m] if m.dtype == bool else doc, None if m.dtype == bool else m, n).astype(float)
    length = b - a
    digits, uppers, vowels = (sums[k][b] - sums[k][a] for k in ("digit", "upper", "vowel"))
    word = (digits == 0) & (length >= 2)
    h = _hash(low, a, b) if len(a) else np.empty(0, np.uint64)
    keys, bits = _known()
    place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    langs = np.where(keys[place] == h, bits[place], 0)
    hits = np.stack([per((langs >> k & 1) == 1) for k in range(len(LANGS))], 1)
    lang = np.where(hits.max(1) > 0, hits.argmax(1), -1)
    words, every = per(word), np.maximum(per(np.ones(len(a), bool)), 1)
    some = np.maximum(words, 1)
    ours = (langs >> np.maximum(lang, 0)[doc] & 1 == 1) & (lang[doc] >= 0)
    where = np.searchsorted(ends, np.arange(len(code)), "right")
    where = np.minimum(where, n - 1)
    of = lambda m: np.bincount(where[m], None, n).astype(float)
    ink = np.maximum(of(~space), 1)
    # lines: the last character that is not a space before each line end
    nl = np.nonzero(code == 10)[0]
    last = np.maximum.accumulate(np.where(space, -1, np.arange(len(code))))
    prev = np.concatenate([[-1], nl[:-1]])
    real = last[nl] > prev
    stop = by_code("stop", lambda c: c in ".!?;:,…")[code]
    nl_doc = np.minimum(np.searchsorted(ends, nl, "right"), n - 1)
    lines = np.maximum(np.bincount(nl_doc[real], None, n), 1)
    closed = np.bincount(nl_doc[real], stop[last[nl]][real].astype(float), n)
    first = np.minimum.accumulate(np.where(space, len(code), np.arange(len(code)))[::-1])[::-1]  # next character that is no space
    head = first[prev + 1][real]
    after = np.minimum.accumulate(np.where(digit, len(code), np.arange(len(code)))[::-1])[::-1]
    bullet = by_code("bullet", lambda c: c in "-–—*•·‣▪◦+>»o")[code]
    limit = len(code) - 1
    number = digit[head] & np.isin(code[np.minimum(after[head], limit)], (41, 46)) & space[np.minimum(after[head] + 1, limit)]
    box = (code[head] == 91) & np.isin(code[np.minimum(head + 2, limit)], (93,))  # "[ ]"
    item = np.bincount(nl_doc[real], ((bullet[head] & space[np.minimum(head + 1, limit)]) | box | number).astype(float), n)
    same = np.zeros(len(code), bool)
    same[3:] = (code[3:] == code[2:-1]) & (code[3:] == code[1:-2]) & (code[3:] == code[:-3]) & ~space[3:]
    pair = np.unique(np.stack([doc[word].astype(np.uint64), h[word]]), axis=1) if word.any() else np.empty((2, 0), np.uint64)
    distinct = np.bincount(pair[0].astype(np.int64), None, n)
    title = word & (uppers == 1) & upper[a] & (length >= 3) if len(a) else word
    out = np.stack(
        [
            np.log1p(words),
            per(np.where(word, length, 0).astype(float)) / some,
            np.minimum(per(ours) / some, 1),
            of(~(alpha | digit | space | fine)) / ink,
            closed / lines,
            per(title) / some,
            per((digits == length) & ~((length == 1) & (code[a] == 48))) / every,  # a lone 0 is part of castling
            per((length == 1) & (langs == 0) & (digits == 0)) / every,
            per(word & (vowels == 0) & (length >= 3) & (uppers < length)) / some,
            per((digits > 0) & (digits < length) & (length >= 7)) / every,
            np.where(words > 0, distinct / some, 1.0),
            of(same) / ink,
            item / lines,
            of(by_code("accent", lambda c: c.isalpha() and 0xC0 <= ord(c) < 0x250)[code]) / np.maximum(of(alpha), 1),
        ],
        1,
    )
    out[words == 0, 5] = 1.0
    return out, lang


def _stats_pass(batches):
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1).to_pylist()
        if not texts:
            continue
        x, lang = text_stats(texts)
        yield pa.record_batch([keys, pa.array(lang.astype(np.int32)), *(pa.array(np.ascontiguousarray(x[:, k])) for k in range(len(STATS)))], names=["key", "lang", *STATS])


def statistics(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, lang, every statistic) of the texts that are neither null nor blank."""
    src = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull() & F.col("text").rlike(r"\S"))
    return src.mapInArrow(_stats_pass, "key long, lang int, " + ", ".join(f"{s} double" for s in STATS))


def _distance(x: np.ndarray, mean: np.ndarray, white: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared distances, contributions): squares of the whitened deviations that speak against prose."""
    z = (x - mean) @ white
    c = np.where(((SIDE > 0) & (z < 0)) | ((SIDE < 0) & (z > 0)), 0.0, z) ** 2
    return c.sum(1), c


def _scored(models: dict[int, tuple[np.ndarray, np.ndarray]]):
    def f(batches):
        for batch in batches:
            lang = batch.column("lang").to_numpy()
            x = np.stack([batch.column(s).to_numpy() for s in STATS], 1)
            d2, c = np.full(len(x), np.inf), np.zeros_like(x)
            for k, (mean, white) in models.items():
                m = (lang == k) | (lang < 0)
                if m.any():
                    d, cc = _distance(x[m], mean, white)
                    less = d < d2[m]
                    at = np.nonzero(m)[0][less]
                    d2[at], c[at] = d[less], cc[less]
            yield pa.record_batch([*(batch.column(n) for n in ("key", "lang", *STATS)), pa.array(d2), pa.array(list(c), pa.list_(pa.float64()))], names=["key", "lang", *STATS, "distance2", "contributions"])

    return f


_SCHEMA = "key long, lang int, " + ", ".join(f"{s} double" for s in STATS) + ", distance2 double, contributions array<double>"


def _moments(rows: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Per language (n, mean, covariance), from one aggregation of sums and products; -9 is the pool."""
    k = len(STATS)
    aggs = [F.count("*").alias("n"), *(F.sum(s).alias(f"s{i}") for i, s in enumerate(STATS))]
    aggs += [F.sum(F.col(STATS[i]) * F.col(STATS[j])).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)]
    found: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
    for r in rows.groupBy("lang").agg(*aggs).collect():  # a row a language
        s = np.array([r[f"s{i}"] for i in range(k)])
        p = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        found[r["lang"]] = (r["n"], s, p)
    pool = tuple(sum(v[i] for v in found.values()) for i in range(3)) if found else (0, np.zeros(k), np.zeros((k, k)))
    out = {}
    for lang, (n, s, p) in {**found, -9: pool}.items():
        if n:
            mean = s / n
            out[lang] = (n, mean, p / n - np.outer(mean, mean))
    return out


def _whitening(cov: np.ndarray) -> np.ndarray:
    """Matrix that whitens deviations: they are divided by their standard deviation (at least FLOOR) and multiplied by
    the root of the inverse correlation, which is shrunk by SHRINK towards none."""
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    values, axes = np.linalg.eigh((1 - SHRINK) * cov / np.outer(sd, sd) + SHRINK * np.eye(len(sd)))
    return np.diag(1 / np.maximum(sd, FLOOR)) @ (axes / np.sqrt(np.maximum(values, 1e-6))) @ axes.T


def fit(stats: DataFrame, steps: int = 2) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per language (mean, whitening matrix) of prose, over all rows."""
    quart = stats.where("lang >= 0").groupBy("lang").agg(F.count("*").alias("n"), *(F.percentile_approx(s, [0.25, 0.5, 0.75], 1000).alias(s) for s in STATS)).collect()
    n = sum(r["n"] for r in quart)
    models, big = {}, [r for r in quart if r["n"] >= MIN_ROWS] or quart
    for k in range(len(LANGS)):
        own = [r for r in quart if r["lang"] == k and r["n"] >= MIN_ROWS]
        use = own or big
        if not use or not n:
            return {}
        w = np.array([r["n"] for r in use], float)
        q = np.average([[list(r[s]) for s in STATS] for r in use], axis=0, weights=w)
        sd = np.maximum((q[:, 2] - q[:, 0]) / 1.349, FLOOR)
        models[k] = (q[:, 1], np.diag(1 / sd))
    for _ in range(steps):
        near = stats.where("lang >= 0").mapInArrow(_scored(models), _SCHEMA).where(F.col("distance2") <= CUT)
        found = _moments(near)
        for k in range(len(LANGS)):
            use = found.get(k) if k in found and found[k][0] >= MIN_ROWS else found.get(-9)
            if use:
                models[k] = (use[1], _whitening(use[2] * RESCALE))
    return models


def outlierness(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, lang, statistics, distance2, contributions, prose) of every text that is not blank."""
    stats = written(statistics(df, key, text), "p1-stats")
    models = fit(stats)
    if not models:
        return stats.withColumns({"distance2": F.lit(0.0), "contributions": F.array(*[F.lit(0.0)] * len(STATS)), "prose": F.lit(False)}).where("false")
    return stats.mapInArrow(_scored(models), _SCHEMA).withColumn("prose", F.col("distance2") <= CUT)


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/nodes.parquet").where("scope = 'all'")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id of the paragraphs that are lists, tables or junk."""
    return outlierness(paragraphs(spark, sf_dir), "node_id", "text").where("not prose").select(F.col("key").alias("node_id")).distinct()


def p1_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph's language, statistics, distance, each statistic's contribution (c_...) and verdict."""
    o = outlierness(paragraphs(spark, sf_dir), "node_id", "text").dropDuplicates(["key"])
    lang = F.element_at(F.array(*[F.lit(c) for c in LANGS], F.lit(None).cast("string")), F.when(F.col("lang") >= 0, F.col("lang") + 1).otherwise(-1))
    parts = [F.round(F.col("contributions")[i], 4).alias(f"c_{s}") for i, s in enumerate(STATS)]
    return o.select(F.col("key").alias("node_id"), lang.alias("lang"), *(F.round(s, 6).alias(s) for s in STATS), F.round("distance2", 4).alias("distance2"), *parts, "prose")
