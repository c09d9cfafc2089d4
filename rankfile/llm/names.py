"""Variant spellings of names typed by people (problem 5).

Distinct spellings are parsed into surname and given name, or into the name of a club. Surnames and clubs are blocked
by phonetic codes of their sorted tokens, and by their letters with as many deleted as `alike` forgives, so that no
pair that it accepts is left without a common key. Within the blocks they are compared with Jaro-Winkler, where an edit
distance checks what that accepts, and given names with Jaro-Winkler plus a nickname table; the accepted pairs are
clustered by connected components. A block's pairs are bounded by length and distance inside the join, and spread over
all cores before they are compared.

A given name in full decides: two spellings that both have one are linked only if these agree (equal up to a typo,
nickname, abbreviation). Spellings with an initial only, or without a given name, don't link persons to each
other; they join the one person of a like surname that they fit, and if they fit several persons, none of them.

Null, blank and placeholder names (?, NN, N.N., unknown) are no names. Repeated rows count once. Ties: a spelling
that fits two persons equally well joins neither.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from ..operators.graph import components
from ..session import written

SURNAME = 0.89  # Jaro-Winkler from which surnames or club names are alike
ONE_EDIT = 0.85  # the same for names one edit apart
TWO_EDITS = 8  # letters from which two edits are forgiven
GIVEN = 0.92

# Nicknames of given names, titles, words of club names.
NICKNAMES = {
    "alexander": "alex sasha sascha xander alec alejandro aleksandr", "antonio": "toni tony tonio anton", "aurel": "aurelio aurelius", "benjamin": "ben benny benja",
    "charles": "charlie chuck charley carlos karl", "dmitri": "dima mitya dimitri dmitry", "eduardo": "edu lalo eddie", "edward": "ed ned ted eddie teddy",
    "elizabeth": "liz beth lizzie betty eliza elisabeth lisa", "francisco": "paco pancho curro fran", "friedrich": "fritz fred friedel freddy", "greta": "gretel gretchen",
    "guillermo": "memo guille", "heinrich": "heinz heiner hein", "henri": "riri henry", "ignacio": "nacho", "irene": "rena reni", "james": "jim jimmy jamie",
    "johannes": "hans hannes johann jan", "jose": "pepe chepe", "katherine": "kate kitty kathy katie cathy kat", "leopold": "leo poldi", "ludwig": "lutz luis wiggerl lu",
    "margaret": "meg maggie peggy margie", "mikhail": "misha mischa michail", "nikolai": "kolya nick kolja nikolay", "oskar": "ossi oscar", "paul": "paulie pavel pauli",
    "quentin": "quent quin", "richard": "dick rick rich ricky", "robert": "bob rob bobby bert", "roman": "roma romka", "susanne": "susi susan sanne suse", "theodore": "ted teddy theo", "ursula": "uschi ulla ursel",
    "viktor": "vitya vic victor vik", "vladimir": "volodya vova vlad", "wilhelmina": "mina minnie willa wilma", "william": "bill will billy willy liam", "xavier": "xavi javi javier",
    "yevgeny": "zhenya evgeny eugene jewgeni yevgeni", "zoltan": "zoli",
}
TITLES = set("gm im fm wgm wim wfm cm nm dr prof mr mrs ms herr frau sr sra don".split())
SUFFIXES = set("jr jun junior sen senior ii iii".split())
CLUB = re.compile(r"\b(chess\s+club|ch\.?\s+club|schach-?\s?klub|schach-?\s?club|schachverein|club\s+(?:de\s+)?ajedrez|club\s+d\W?\s*echecs|cercle\s+d\W?\s*echecs(\s+de)?|clube\s+de\s+xadrez|шахматный\s+клуб)\b")
SHORT_CLUB = re.compile(r"^((?:sk|cc|ca|ce|sv|sc|cx)\.?|c\s?\.\s?a\s?\.?|c\s?\.\s?e\s?\.?|c\s?\.\s?c\s?\.?|s\s?\.\s?k\s?\.?)\s+(?P<a>\S.*)$|^(?P<b>.*\S)\s+((?:sk|cc|ca|ce|sv)\.?|c\.\s?[cae]\.?|s\.\s?k\.?)$")
PLACEHOLDER = re.compile(r"^[\s?.*\-_/,]*$|^(nn|n\s?n|unknown|unbekannt|anon|anonymous|desconocido|inconnu|n\s?/\s?a|none|null)$")
_FORMAL: dict[str, set[str]] = {}
for _name, _nicks in NICKNAMES.items():
    for _n in (_name, *_nicks.split()):
        _FORMAL.setdefault(_n, set()).add(_name)


def plain(s: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c)).replace("ß", "ss").replace("ø", "o").replace("ł", "l")


def parse(name: str | None) -> tuple[str, str, str, str] | None:
    """(kind, surname or club, given, suffix) of a spelling; None for null, blank and placeholders."""
    if name is None:
        return None
    s = re.sub(r"\s+", " ", plain(name)).strip()
    if PLACEHOLDER.match(s) or PLACEHOLDER.match(s.replace(".", "").strip()):
        return None
    club = CLUB.search(s)
    if club:
        rest = re.sub(r"\W+", " ", s[: club.start()] + " " + s[club.end() :])
        return "club", " ".join(w for w in rest.split() if w not in ("the", "de", "la", "el", "der", "di", "of")), "", ""
    short = SHORT_CLUB.match(s)
    if short:
        rest = re.sub(r"\W+", " ", short.group("a") or short.group("b"))
        return "club", " ".join(w for w in rest.split() if w not in ("the", "de", "la", "el", "der")), "", ""
    suffix = ""
    head, comma, tail = s.partition(",")
    clean = lambda x: [w for w in re.findall(r"[^\W\d_][^\s,()]*", x) if w.strip(".'") not in TITLES]
    a, b = clean(head), clean(tail)
    for part in (a, b):
        for w in [w for w in part if w.strip(".'") in SUFFIXES]:
            suffix = "jr" if w.strip(".'") in ("jr", "jun", "junior", "ii") else "sr"
            part.remove(w)
    if comma and a and b:
        return "person", " ".join(a), " ".join(b), suffix
    words = a + b
    if not words:
        return None
    if len(words) == 1:
        return "person", words[0].strip("."), "", suffix
    first, last = words[0], words[-1]
    known = lambda w: w.strip(".") in _FORMAL or len(w.strip(".")) <= 1 or (w.endswith(".") and len(w) <= 5)
    if known(last) and not known(first):
        return "person", " ".join(words[:-1]), last, suffix
    return "person", " ".join(words[1:]), first, suffix


def jaro_winkler(a: str, b: str) -> float:
    """Similarity of 0 to 1 of two strings."""
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    reach = max(max(n, m) // 2 - 1, 0)
    free = [True] * m
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(m, i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                left.append(c)
                break
    k = len(left)
    if not k:
        return 0.0
    right = [c for c, f in zip(b, free) if not f]
    swaps = sum(x != y for x, y in zip(left, right)) / 2
    jaro = (k / n + k / m + (k - swaps) / k) / 3
    prefix = 0
    while prefix < min(4, n, m) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def formal(given: str) -> tuple[set[str], str]:
    """(the formal names a given name may stand for, its class: full, short, initial, none)."""
    g = given.strip().split(" ")[0] if given.strip() else ""
    bare = g.strip(".'")
    if not bare:
        return set(), "none"
    if len(bare) == 1:
        return {bare}, "initial"
    if bare in _FORMAL and not g.endswith("."):
        return _FORMAL[bare], "full"
    if g.endswith(".") or len(bare) <= 3:
        return {bare}, "short"
    return {bare}, "full"


def same_given(a: str, b: str) -> bool:
    """Whether two given names can be one person's: equal up to a typo, nickname, abbreviation or initial."""
    x, kx = formal(a)
    y, ky = formal(b)
    if "none" in (kx, ky):
        return True
    if kx == ky == "full":
        return bool(x & y) or any(jaro_winkler(p, q) >= GIVEN and p[0] == q[0] for p in x for q in y)
    spell = lambda s, raw: s | {raw.strip(" .'").split(" ")[0]}
    return any(p.startswith(q) or q.startswith(p) for p in spell(x, a) for q in spell(y, b))


# Classes of consonants, Latin, Cyrillic and Greek; h, vowels and signs are silent.
_CLASS = {c: k for k, cs in {"1": "bfpvwбвпфβπφ", "2": "cgjkqsxzгжзксхцчшщγζκξσςχ", "3": "dtдтδτθ", "4": "lлλ", "5": "mnмнμν", "6": "rрρ"}.items() for c in cs}
_SILENT = set("aeiouyhаеёиоуыэюяйьъαεηιουω")


def phonetic(token: str) -> str:
    """Classes of the consonants, equal neighbours once; silent letters have none, letters of other scripts are their own."""
    out = ""
    for c in token:
        k = _CLASS.get(c) or ("" if c in _SILENT or not c.isalpha() else c)
        if k and (not out or out[-1] != k):
            out += k
    return out


def squeezed(surname: str) -> str:
    """The letters that `alike` compares."""
    return surname.replace(" ", "").replace("'", "")


def codes(kind: str, surname: str) -> list[str]:
    """Blocking keys: the phonetic code of the sorted tokens, whole and with one class deleted; and the squeezed
    letters, whole and with one deleted, from TWO_EDITS letters on with two. Texts n edits or swaps apart are equal
    after n deletions in each, so all pairs that `alike` accepts share one of these."""
    p = "".join(phonetic(t) for t in sorted(re.findall(r"[^\W\d_]+", surname)))
    k = kind[0]
    ends = [f"{k}={w}" for w in ([p] if p else []) + [p[:i] + p[i + 1 :] for i in range(len(p)) if len(p) >= 4]]
    x = squeezed(surname)
    near = last = {x}
    for _ in range(0 if len(x) < 4 else 2 if len(x) >= TWO_EDITS else 1):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        near = near | last
    return list(dict.fromkeys([*ends, *(f"{k}~{w}" for w in sorted(near))]))


def alike(a: str, b: str) -> bool:
    """Whether two surnames (or club names) are one up to typos."""
    if a == b:
        return True
    x, y = squeezed(a), squeezed(b)
    if x == y:
        return True
    if abs(len(x) - len(y)) > 2 or min(len(x), len(y)) < 4:
        return False
    near = jaro_winkler(x, y)
    if near < ONE_EDIT:
        return False
    apart = edits(x, y)
    return apart <= 1 or apart == 2 and near >= SURNAME and min(len(x), len(y)) >= TWO_EDITS


def edits(a: str, b: str) -> int:
    """Edit distance with swaps of neighbours."""
    back, prev, cur = [], list(range(len(b) + 1)), []
    for i, c in enumerate(a, 1):
        cur = [i]
        for j, d in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (c != d)))
            if i > 1 and j > 1 and c == b[j - 2] and a[i - 2] == d:
                cur[j] = min(cur[j], back[j - 2] + 1)
        back, prev = prev, cur
    return prev[-1]


_PARSED = StructType([StructField("kind", StringType()), StructField("surname", StringType()), StructField("given", StringType()), StructField("full", BooleanType())])


@F.pandas_udf(_PARSED)
def _parse(names: pd.Series) -> pd.DataFrame:
    rows = []
    for n in names:
        p = parse(n)
        rows.append((None, None, None, False) if p is None or not p[1] else (p[0], p[1], p[2], p[0] == "club" or formal(p[2])[1] == "full"))
    return pd.DataFrame(rows, columns=["kind", "surname", "given", "full"])


@F.pandas_udf(ArrayType(StringType()))
def _codes(kind: pd.Series, surname: pd.Series) -> pd.Series:
    return pd.Series([codes(k, s) for k, s in zip(kind, surname)], dtype=object)


@F.pandas_udf(BooleanType())
def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([alike(x, y) for x, y in zip(a, b)], dtype=bool)


@F.pandas_udf(BooleanType())
def _same_given(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([same_given(x, y) for x, y in zip(a, b)], dtype=bool)


def name_clusters(names: DataFrame, name: str) -> DataFrame:
    """(name, entity): each spelling that is a name, and the smallest spelling of its person or club."""
    wide = names.sparkSession.sparkContext.defaultParallelism
    spellings = names.select(F.col(name).alias("id")).where("id is not null").distinct().repartition(wide)
    parsed = written(spellings.withColumn("p", _parse("id")).where("p.kind is not null").select("id", "p.*"), "p5-names")
    surnames = written(parsed.select("kind", "surname").distinct().repartition(wide).withColumn("code", F.explode(_codes("kind", "surname"))), "p5-codes")
    a, b = (surnames.select("kind", "code", F.col("surname").alias(f"surname_{x}"), F.translate("surname", " '", "").alias(f"letters_{x}")) for x in "ab")
    may = "surname_a < surname_b and abs(length(letters_a) - length(letters_b)) <= 2 and levenshtein(letters_a, letters_b, 4) >= 0"  # two swaps are four edits
    pairs = written(a.join(b, ["kind", "code"]).where(may).select("kind", "surname_a", "surname_b").distinct(), "p5-pairs")
    near = pairs.repartition(wide).where(_alike("surname_a", "surname_b"))
    equal = parsed.select("kind", F.col("surname").alias("surname_a"), F.col("surname").alias("surname_b")).distinct()
    near = written(near.unionByName(equal), "p5-surnames")
    a = parsed.select("kind", *(F.col(c).alias(f"{c}_a") for c in ("id", "surname", "given", "full")))
    b = parsed.select("kind", *(F.col(c).alias(f"{c}_b") for c in ("id", "surname", "given", "full")))
    pairs = near.join(a, ["kind", "surname_a"]).join(b, ["kind", "surname_b"]).where("id_a < id_b or surname_a <> surname_b")
    links = written(pairs.where(_same_given("given_a", "given_b")).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "full_a", "full_b"), "p5-links")
    persons = components(parsed.where("full").select("id"), links.where("full_a and full_b"))
    loose = links.where("full_a <> full_b").select(F.when(F.col("full_a"), F.col("b")).otherwise(F.col("a")).alias("id"), F.when(F.col("full_a"), F.col("a")).otherwise(F.col("b")).alias("to"))
    fits = loose.join(persons.select(F.col("id").alias("to"), "label"), "to").groupBy("id").agg(F.min("label").alias("label"), F.countDistinct("label").alias("n"))
    fits = written(fits, "p5-fits")
    joined = fits.where("n = 1").select("id", "label")
    rest = parsed.where("not full").select("id").join(fits.select("id"), "id", "left_anti")
    r = rest.select(F.col("id").alias("a")), rest.select(F.col("id").alias("b"))
    others = components(rest, links.where("not full_a and not full_b").join(r[0], "a", "left_semi").join(r[1], "b", "left_semi"))
    alone = fits.where("n > 1").select("id", F.col("id").alias("label"))
    return persons.unionByName(joined).unionByName(others).unionByName(alone).select(F.col("id").alias("name"), F.col("label").alias("entity"))


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = spark.read.parquet(f"{sf_dir}/facets.parquet")
    return f.select(F.col("white").alias("name")).unionByName(f.select(F.col("black").alias("name")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name_a, name_b: different spellings of one person or club."""
    c = name_clusters(_typed(spark, sf_dir), "name")
    a, b = c.select("entity", F.col("name").alias("name_a")), c.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b")


def p5_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name's entity: name, entity, spellings of that entity."""
    c = name_clusters(_typed(spark, sf_dir), "name")
    return c.join(c.groupBy("entity").agg(F.count("*").alias("spellings")), "entity").select("name", "entity", "spellings")
