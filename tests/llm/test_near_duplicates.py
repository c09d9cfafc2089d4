"""Similarity join against brute force, and its edge cases."""

import random

from rankfile.llm.near_duplicates import groups, key_pairs, near_duplicates
from rankfile.llm.words import WORD, run_hashes, word_hashes, words_of

SCHEMA = "key long, text string"


def brute(rows, t, n, least):
    sets = {}
    for k, x in rows:
        w = words_of(x)
        if k is not None and len(w) >= max(least, n):
            sets.setdefault(k, set()).add(frozenset(zip(*(w[i:] for i in range(n)))))
    out = set()
    for a in sets:
        for b in sets:
            if a < b and any(len(x & y) / len(x | y) >= t for x in sets[a] for y in sets[b]):
                out.add((a, b))
    return out


def texts(n=60, seed=3):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(n):
        w = [r.choice(vocab) for _ in range(40)]
        rows.append((k, " ".join(w)))
        for j in range(r.randrange(3)):
            v = list(w)
            for _ in range(r.randrange(6)):
                v[r.randrange(len(v))] = r.choice(vocab)
            if r.random() < 0.3:
                v = v[20:] + v[:20]
            rows.append((1000 * (j + 1) + k, " ".join(v)))
    return rows


def found(spark, rows, t, n, least=0, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    return {tuple(r) for r in key_pairs(*near_duplicates(df, "key", "text", t, n, least, **options)).collect()}


def test_same_as_brute_force(spark):
    rows = texts()
    for t, n in ((0.55, 3), (0.8, 5)):
        assert found(spark, rows, t, n, 10) == brute(rows, t, n, 10)
    assert found(spark, rows, 0.55, 3, 10, block=2) == brute(rows, 0.55, 3, 10)


def test_groups_name_every_key(spark):
    rows = [*texts(), *((5000 + k, "a b c d e f g h i j k l") for k in range(90)), (6000, "a b c d e f g h i j k"), (7000, None), (7001, "too short")]
    want = brute(rows, 0.55, 3, 10)
    got = {r.key: r for r in groups(*near_duplicates(spark.createDataFrame(rows, SCHEMA), "key", "text", 0.55, 3, 10)).collect()}
    assert set(got) == {k for k, x in rows if x and len(words_of(x)) >= 10}
    group = {k: k for k in got}
    for _ in range(20):
        for a, b in want:
            group[a] = group[b] = min(group[a], group[b])
    assert {k: r.group_id for k, r in got.items()} == group and {got[5000 + k].class_id for k in range(90)} == {5000}
    assert got[5000].copies == 90 and got[5000].links == 1 and got[6000].links == 1 and got[6000].group_id == 5000


def test_nulls_empties_repeats_and_clashing_columns(spark):
    long = " ".join(f"x{i}" for i in range(5000))
    rows = [(1, None), (2, ""), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, "A, b; c-d e F!"), (5, "a b"), (6, long), (7, long + " end")]
    df = spark.createDataFrame([(k, x, k, "z", 1) for k, x in rows], "key long, text string, set_id long, byte string, n int")
    assert {tuple(r) for r in key_pairs(*near_duplicates(df, "key", "text", 0.8, 5)).collect()} == {(3, 4), (6, 7)}


def test_empty_table(spark):
    assert found(spark, [], 0.8, 5) == set()


def test_large_copy_group_keeps_every_key(spark):
    rows = [(k, "one two three four five six seven") for k in range(200)] + [(999, "one two three four five six eight nine ten eleven twelve")]
    pairs = found(spark, rows, 0.8, 5)
    assert {b for _, b in pairs} == set(range(1, 200)) and {a for a, _ in pairs} == {0}


def test_word_hashes_follow_words():
    xs = ["Éa b2", None, "", "b2 éA", "ß ẞ 12 日本"]
    h, ends = word_hashes(xs)
    flat = [w for x in xs for w in words_of(x)]
    assert len(h) == len(flat) and list(ends) == [0, 2, 2, 2, 4, 8]
    assert all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(len(flat)))
    assert len(run_hashes(h, 3)) == len(flat) - 2 and WORD.findall("a_b") == ["a", "b"]
