"""Names, languages, leaks, mixtures."""

import pytest

from rankfile.llm import language, leakage, mixing, names


def test_parse_and_compare():
    assert names.parse("GM Petrov, Ivan (jr)")[:3] == ("person", "petrov", "ivan") and names.parse("N.N.") is None and names.parse(" ") is None and names.parse(None) is None
    assert names.parse("Kolya Petrov")[1:3] == ("petrov", "kolya") and names.parse("The Riga Chess Club") == ("club", "riga", "", "")
    assert names.same_given("kolya", "nikolai") and names.same_given("n.", "nikolai") and not names.same_given("nikolai", "oskar")
    assert names.alike("drobidagrir", "drobidarir") and not names.alike("drobidagrir", "pestobunin")
    assert names.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4) and names.edits("abcd", "abdc") == 1 and names.alike("minuumuzin", "mnumuzin") and not names.alike("rossi", "rossini")
    assert names.phonetic("иванов") == names.phonetic("ivanov") == "151" and names.phonetic("ao") == "" and names.phonetic("山田") == "山田"


def test_clusters(spark):
    rows = ["Drobidagrir, Nikolai", "Kolya Drobidagrir", "DROBIDAGRIR, NIKOLAI", "Drobidarir, Nikolai", "Drobidagrir, Oskar", "N. Drobidagrir", "Drobidagrir", "SK Rigamost", "Schachklub Rigamost", "?", None, "", "Drobidagrir, Oskar"]
    df = spark.createDataFrame([(n, "x") for n in rows], "name string, label string")
    c = {r.name: r.entity for r in names.name_clusters(df, "name").collect()}
    one = {c[n] for n in rows[:4]} | {c["N. Drobidagrir"]}
    assert len(one) == 1 and c["Drobidagrir, Oskar"] not in one and c["Drobidagrir"] == "Drobidagrir"
    assert c["SK Rigamost"] == c["Schachklub Rigamost"] and not {"?", None, ""} & set(c)
    assert names.name_clusters(df.limit(0), "name").count() == 0


def test_blocks_lose_no_pair_to_brute_force(spark):
    """Edits in the middle of a consonant code, swaps, short codes, spaces and other scripts."""
    rows = [
        "Hesevazusson Edward", "Edward Hestevazusson", "Misha Kragozuan", "Mikhail Kragozuran", "Mikimokrunen, Wilhelmina", "Mikimorkunen, Wilhelmina", "Noel, Paul", "Noevl, Paul", "Aurio, Irene", "Aurgio, Irene",
        "Иванов, Paul", "Иваннов, Paul", "O'Brien, Paul", "OBrien, Paul", "La Cruzada, Paul", "Lacruzada, Paul", "Karbotilumen, Greta", "Karvotliumen, Greta", "Li, Paul", "Lo, Paul", "SK Rigamost", "SK Rigamsot", "Rigamost, Paul", "Минуумузин, Paul", "Мнумузин, Paul",
    ]
    parsed = [(n, names.parse(n)) for n in rows]
    pairs = [(a, b, p, q) for i, (a, p) in enumerate(parsed) for b, q in parsed[i + 1 :] if p[0] == q[0] and names.alike(p[1], q[1]) and names.same_given(p[2], q[2])]
    assert len(pairs) == 11 and all(set(names.codes(*p[:2])) & set(names.codes(*q[:2])) for _, _, p, q in pairs)
    c = {r.name: r.entity for r in names.name_clusters(spark.createDataFrame([(n,) for n in rows], "name string"), "name").collect()}
    assert all(c[a] == c[b] for a, b, _, _ in pairs) and c["Li, Paul"] != c["Lo, Paul"] and c["SK Rigamost"] != c["Rigamost, Paul"]


def test_components_of_a_long_path(spark):
    n = 40
    nodes = spark.createDataFrame([(f"{i:03}",) for i in range(n)] + [("zzz",)], "id string")
    edges = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(n - 1)], "a string, b string")
    got = {r.id: r.label for r in names.components(nodes, edges).collect()}
    assert {v for k, v in got.items() if k != "zzz"} == {"000"} and got["zzz"] == "zzz"


EN = ["The rook on the open file was better than the bishop and the game went on.", "After this move the queen is lost because the king cannot leave the corner."]
DE = ["Der Turm auf der offenen Linie war besser als der Läufer und die Partie ging weiter.", "Nach diesem Zug ist die Dame verloren, weil der König die Ecke nicht verlassen kann."]


def test_languages(spark):
    rows = [(i, "en" if i % 2 else "English", EN[i % 2] + f" {EN[(i + 1) % 2]}") for i in range(40)] + [(100 + i, "deu", DE[i % 2] + " " + DE[(i + 1) % 2]) for i in range(40)]
    rows += [(500, "de", EN[0]), (501, None, DE[0]), (502, "en", EN[0] + " " + DE[0] + " " + EN[1]), (503, "en", None), (504, "xx", ""), (505, "en", "12.Nf3! 13.0-0"), (1, "en", EN[1] + f" {EN[0]}")]
    df = spark.createDataFrame([(k, l, t, "q") for k, l, t in rows], "item_id long, lang string, text string, code string")
    got = {r.key: (list(r.codes), r.label_code) for r in language.languages(df, "item_id", "lang", "text").collect()}
    assert got[500] == (["en"], "de") and got[501] == (["de"], None) and got[502][0] == ["de", "en"] and 503 not in got and 504 not in got
    assert all(got[i] == (["en"], "en") for i in range(40))
    hints = spark.createDataFrame([(501, "DE", 0.9), (501, "en", 0.2), (502, "xx", 1.0), (500, None, 1.0), (500, "ger", None)], "key long, code string, score double")
    again = {r.key: r for r in language.languages(df, "item_id", "lang", "text", hints).collect()}
    assert again[501].hint == "de" and again[502].hint is None and again[500].hint is None and {k: list(r.codes) for k, r in again.items()} == {k: c for k, (c, _) in got.items()}
    assert all(0 < r.confidence <= 1 for r in again.values())
    seg = language.segments(df, "item_id", "lang", "text").where("key = 502").orderBy("segment").collect()
    assert [s.code for s in seg] == ["en", "de", "en"] and all(0 < s.confidence <= 1 for s in seg)


def test_leaks(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, f"start {item.upper()} end"), (2, "one two three four five six seven eight nine"), (3, None), (4, ""), (5, "x " * 20_000 + item.replace(" ", ", ")), (1, f"start {item.upper()} end")]
    d = spark.createDataFrame([(k, t, 7) for k, t in docs], "doc_id long, text string, item_id long")
    i = spark.createDataFrame([(7, item), (8, item + " twelve"), (9, None), (10, "too short")], "item_id long, text string")
    found = leakage.leaks(d, "doc_id", "text", i, "item_id", "text")
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 7), (1, 8), (5, 7), (5, 8)}
    clean = {r.doc_id: (r.text, r.words_removed) for r in leakage.without_leaks(d, "doc_id", "text", found).collect()}
    odd = "İİ İx " + item + " İ end"
    turned = {r.doc_id: (r.text, r.words_removed) for r in leakage.without_leaks(d.limit(0).union(spark.createDataFrame([(8, odd, 7)], d.schema)), "doc_id", "text", leakage.leaks(spark.createDataFrame([(8, odd, 7)], d.schema), "doc_id", "text", i, "item_id", "text")).collect()}
    assert turned == {8: ("İİ İx  İ end", 11)}
    assert clean[1] == ("start  end", 11) and clean[3] == (None, 0) and clean[2][1] == 0
    assert leakage.leaks(d, "doc_id", "text", i.limit(0), "item_id", "text").count() == 0


def test_large_item_set_is_joined(spark, monkeypatch):
    monkeypatch.setattr(leakage, "MAX_BROADCAST", 0)
    d = spark.createDataFrame([(1, "a b c d e f g h i j k")], "doc_id long, text string")
    i = spark.createDataFrame([(7, "b c d e f g h i j k")], "item_id long, text string")
    assert [tuple(r) for r in leakage.leaks(d, "doc_id", "text", i, "item_id", "text").collect()] == [(1, 7, 1)]


def test_raking_meets_the_shares():
    cells = [("a", "en", "x", 1000), ("a", "de", "x", 500), ("b", "en", "y", 200), ("b", "de", "x", 300), ("c", "en", "x", 4000)]
    w, total = mixing.rake(cells, {"a": 0.5, "b": 0.3, "c": 0.1, "gone": 0.1}, {"a": 1, "b": 3, "c": 1, "gone": 1})
    size = {s: sum(w[c[:3]] * c[3] for c in cells if c[0] == s) for s in "abc"}
    assert sum(size.values()) == pytest.approx(total) and size["a"] / total == pytest.approx(0.5 / 0.9) and size["b"] / total == pytest.approx(0.3 / 0.9)
    assert all(x <= {"a": 1, "b": 3, "c": 1}[c[0]] + 1e-9 for c, x in w.items()) and mixing.rake([], {}, {}) == ({}, 0.0)


def test_mixture(spark):
    docs = [(i, "a" if i % 3 else "b", "en" if i % 2 else None, f"word{i} and some more text. " * (1 + i % 4)) for i in range(300)] + [(900, None, "en", "no source"), (901, "a", "en", None), (902, "zz", "en", "no target"), (1, "a", "en", "word1 and some more text. " * 2)]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, source string, lang string, text string, tokens int")
    t = spark.createDataFrame([("a", 0.4, 1), ("b", 0.5, 3), ("none", 0.1, 1)], "source string, target_share double, max_repeats int")
    m = mixing.mixture(d, t, "doc_id", "source", "lang", "text")
    assert m.groupBy("key").count().where("count > 1").isEmpty() and m.where("copies > 3 or (source = 'a' and copies > 1) or copies < 0").isEmpty()
    s = {r.source: r.actual_share for r in mixing.shares(m, t).collect()}
    assert abs(s["a"] - 0.4 / 0.9) < 0.02 and abs(s["b"] - 0.5 / 0.9) < 0.02 and s["none"] == 0
    left = mixing.marginals(m).collect()
    assert {r.dimension for r in left} == {"lang", "topic"} and all(abs(r.residual - (r.actual_share - r.wanted_share)) < 1e-5 for r in left) and abs(sum(r.actual_share for r in left) - 2) < 1e-4
    assert mixing.marginals(m.limit(0)).count() == 0
    assert mixing.shares(mixing.mixture(d.limit(0), t, "doc_id", "source", "lang", "text"), t).count() == 3
