"""One form of look-alike text; statistics of prose; scans; endings."""

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankfile.llm import scans
from rankfile.llm.confusables import LOOK_ALIKES, changed, consistent, other_form, skeleton_groups, skeleton_of, with_consistent_form
from rankfile.llm.prose import STATS, outlierness, text_stats
from rankfile.llm.truncation import cut_texts


def test_forms():
    assert consistent("ｎｏｗ \U0001d41a\U0001d41b ﬁn") == "now ab fin"
    assert consistent("a​b c‑d") == "ab c-d"
    assert consistent("été") == "été"
    assert consistent("brеаk") == "break"
    assert consistent("инициaтивы") == "инициативы"
    for same in ("После 12.Крe5 Фd4 позиция", "½ … “x” – ♔e4", "Ïîñëå", None, ""):
        assert consistent(same) == same


def test_skeletons_of_look_alikes():
    """Texts that print alike have one skeleton, in every script of the table; the form has the text's skeleton."""
    for row in LOOK_ALIKES.strip().split("\n"):
        assert len({skeleton_of(c) for c in row.split()}) == 1
    for a, b in (("օne", "one"), ("Ꭺt", "At"), ("ɑt", "at"), ("dıg", "dig"), ("Ӏight", "light"), ("O-O", "0-0"), ("Il1|", "llll"), ("modem", "rnodern"), ("ｏ\u200bｎｅ", "one"), ("é", "e\u0301")):
        assert skeleton_of(a) == skeleton_of(b)
    assert skeleton_of("one") != skeleton_of("two") and other_form("оne") == "one" and other_form("шаx") == "шах" and other_form("0-0 mate") is None and other_form("Ꭺt") == "At"


@given(st.text(max_size=60))
@settings(max_examples=150, deadline=None)
def test_forms_are_stable(x):
    assert consistent(consistent(x)) == consistent(x)
    assert skeleton_of(skeleton_of(x)) == skeleton_of(x)


def test_form_columns(spark):
    df = spark.createDataFrame([(1, "bеd", "k"), (2, "bed", "k"), (3, None, "k"), (4, "", "k"), (4, "", "k")], "id long, text string, form string")
    assert [r.id for r in changed(df.drop("form"), "text").collect()] == [1]
    assert {r.id: r.out for r in with_consistent_form(df, "text", "out").collect()} == {1: "bed", 2: "bed", 3: None, 4: ""}
    g = skeleton_groups(df, "text").collect()
    assert [(r.forms, r.records) for r in g] == [(2, 2)]
    assert skeleton_groups(df.limit(0), "text").count() == 0


def test_statistics():
    x, lang = text_stats(["The rook and the king are on the board, and the pawn is lost.", "1) Abc\n2) Def\n3) Ghi", "", "~~~~ #### |||| ~~~~"])
    s = {n: x[:, i] for i, n in enumerate(STATS)}
    assert lang[0] == 0 and s["common_share"][0] > 0.4 and s["item_share"][1] == 1.0 and s["symbol_share"][3] > 0.5


def test_outliers(spark):
    prose = ["The queen and the rook are on the open file, and it is not easy to see how the king gets out of there by force.", "After that the knight was lost, but the pawn on the side of the queen is still a danger for the whole position."]
    rows = [(i, prose[i % 2].replace("rook", f"rook{'s' * (i % 3)}")) for i in range(400)] + [(1000, "1;Abc;0;1\n2;Def;1;0\n3;Ghi;1;1"), (1001, None), (1002, "  "), (1003, "x" * 50_000)]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "node_id long, text string, lang int")
    o = {r.key: r for r in outlierness(df, "node_id", "text").collect()}
    assert set(o) == set(range(400)) | {1000, 1003}
    assert not o[1000].prose and not o[1003].prose and all(o[k].prose for k in range(400))
    assert all(abs(sum(r.contributions) - r.distance2) < 1e-6 * max(1, r.distance2) and min(r.contributions) >= 0 for r in o.values())
    assert outlierness(df.limit(0), "node_id", "text").count() == 0


def _lexicon():
    words = {w: 500 for w in "moves queen the break after with from side open".split()} | {"-half-open": 9, "half": 40}
    return scans.Lexicon(words | {str(i): 30 for i in range(60)}, set())


def test_scan_repairs():
    lex = _lexicon()
    assert [x[2] for x in scans.misreadings("thc movcs brcak frorn l6.Bd2 Nf3", lex)] == ["moves", "break", "from", "16."]
    assert scans.split_words("half-\nopen and bre-\nak or the que¬\nen", lex)[0][2] == "break"
    text, faults = scans.repair_node("With the queen after the bre-\nak from the open side of it, then\n[19]\nthe movcs from the side", lex, set())
    assert text == "With the queen after the break from the open side of it, then the moves from the side" and faults == ["furniture", "hyphen", "misread"]
    assert scans.repair_node("", lex, set()) == ("", [])
    assert scans.is_page_number("- 12 -") and scans.is_page_number("xiv") and not scans.is_page_number("12 moves")


def test_context_and_confidence_decide():
    """A supported form goes before a more frequent one and needs half the odds; so does a word of a doubtful span."""
    words = {"ease": 900, "case": 40, "moves": 500, "the": 9000, "in": 9000, "cose": 30}
    pair = lambda a, b: int(scans._pair(scans._hash_one(a), scans._hash_one(b))[0])
    lex = scans.Lexicon(words, {pair("the", "case")})
    assert lex.read("casc", "the", "") == "case" and lex.read("casc", "in", "") == "ease"
    assert lex.read("casc", "", "") == "ease" and scans.Lexicon({"case": 30}, set()).read("casc", "", "") is None
    assert scans.Lexicon({"case": 30}, set()).read("casc", "", "", sure=False) == "case"
    assert scans.Lexicon(words, set()).read("tbe", "", "") is None and scans.Lexicon({}, set()).read("m0ves", "", "") is None
    assert scans.misreadings("l6.Bd2", scans.Lexicon({"16": 30}, set())) == [(0, 3, "16.")] and scans.misreadings("l6.Bd2", scans.Lexicon({}, set())) == []
    lines = ["The text of a page that fills its line", "The Endgame on a5", "goes on with the next line, as it does"]
    assert scans.furniture(lines, lex, {scans.masked(lines[1], lex)}) == [False, True, False] and not any(scans.furniture(lines, lex, set()))


def test_paragraphs_go_across_lines_and_pages(spark):
    rows = [(1, 1, 1, "It was a long game that the whole hall could fol-"), (2, 1, 2, "low to its end."), (3, 1, 3, "The next one began, and it"), (4, 2, 1, "was drawn."), (5, 2, 2, "Then the last round of the tournament was played at once"), (6, 2, 3, "")]
    fixed = spark.createDataFrame([(k, t) for k, *_, t in rows], "span_id long, text string")
    at = spark.createDataFrame([(k, 9, p, n, 1) for k, p, n, _ in rows], "span_id long, doc_id long, page int, line_no int, span_no int")
    got = {(r.page, r.para): (r.spans, r.text) for r in scans.paragraphs(fixed, at).collect()}
    assert got == {(1, 0): (2, "It was a long game that the whole hall could follow to its end."), (1, 1): (2, "The next one began, and it was drawn."), (2, 1): (1, "Then the last round of the tournament was played at once")}


def test_scan_counts():
    b = pa.record_batch([pa.array(["a b a", None, "", "half-open"])], names=["t"])
    out = [x for t in scans._counts([b]) for x in zip(t["word"].to_pylist(), t["n"].to_pylist()) if x[0]]
    assert dict(out) == {"a": 2, "b": 1, "half": 1, "open": 1, "-half-open": 1}


def test_cut_texts(spark):
    whole = ["It ends well.", "1.e4 e5 1-0", "so it was.\n— Petrov", "so.\nParis, 1900", "1. Abc 2000\n2. Def (Rom)", "so it was.\n(Rom)"]
    cut = ["It ends in the mid", "1.e4 e5 2.Nf3", "The game went on…", "1.e4 e5 2.", "then (Ro", "1.e4 e5 2.Nf3!"]
    rows = [(i, "s", t) for i, t in enumerate(whole)] + [(100 + i, None, t) for i, t in enumerate(cut)] + [(300 + i, "lim", ("1. Abc 2000\n" * 9)[:90] + f"\n12. Na{i} 1.0"[:10]) for i in range(40)] + [(900, "s", None), (901, "s", "")]
    df = spark.createDataFrame([(k, s, t, 5) for k, s, t in rows], "doc_id long, source string, text string, chars int")
    got = {r.key: r.cut for r in cut_texts(df, "doc_id", "source", "text").collect()}
    assert not any(got[i] for i in range(len(whole))) and all(got[100 + i] for i in range(len(cut)))
    assert 900 not in got and 901 not in got
    lim = {r.key: r.verdict for r in cut_texts(df, "doc_id", "source", "text").where("source = 'lim'").collect()}
    assert set(lim.values()) == {"limit"} and len(lim) == 40  # entries that close in form, but stand at the source's limit
    two = cut_texts(df.withColumn("title", F.lit("Whole.")), "doc_id", "source", "text", "title")
    assert {(r.field, r.n) for r in two.groupBy("field").agg(F.count("*").alias("n")).collect()} == {("text", len(got)), ("title", len(rows))}
    assert cut_texts(df.limit(0), "doc_id", "source", "text").count() == 0


def test_scans_end_to_end(spark, tmp_path, monkeypatch):
    """Null keys, texts and line numbers, repeated rows, extra columns, and a table without scans."""
    d = str(tmp_path)
    prose = "With the queen after the break from the open side of it, then the moves from the side of the board. "
    nodes = [(i, 1, "all", prose * 2 + f"Word{i} ends it.", 5) for i in range(250)] + [(900, 1, "all", "With the queen after the bre-\nak from the side, then the m0ves.", 5), (901, 1, "all", None, 5), (902, 1, "all", "", 5), (None, 1, "all", prose, 5), (903, None, None, prose, 5)]
    spark.createDataFrame(nodes, "node_id long, doc_id long, scope string, text string, faults int").write.parquet(f"{d}/nodes.parquet")
    spans = [(1, 1, 1, 1, 1, "12"), (2, 1, 1, 2, 1, "After the moves from the brc-"), (3, 1, 1, 3, 1, "ak of the side"), (3, 1, 1, 3, 1, "ak of the side"), (4, 1, None, None, None, None), (5, None, 1, 1, 1, "x"), (6, 1, 1, 4, 1, "")]
    spark.createDataFrame(spans, "span_id long, doc_id long, page int, line_no int, span_no int, text string").write.parquet(f"{d}/text_spans.parquet")
    spark.createDataFrame([(1, "scan"), (1, "scan"), (2, None)], "doc_id long, stratum string").write.parquet(f"{d}/library.parquet")
    got = {(r.rec_kind, r.rec_id, r.fault) for r in scans.p2_found(spark, d).collect()}
    assert {("node", 900, "hyphen"), ("node", 900, "misread"), ("span", 1, "furniture"), ("span", 2, "hyphen")} <= got and not any(k[1] in range(250) for k in got if k[0] == "node")
    assert scans.p2_pages(spark, d).count() == 1
    nodes = {r.node_id: r.text for r in scans.p2_nodes(spark, d).collect()}
    assert "break from the side" in nodes[900] and "moves" in nodes[900] and set(nodes) == {*range(250), 900, None}
    monkeypatch.setattr(scans, "MAX_WORDS", 0)  # every record gets its own entries of the lexicon
    monkeypatch.setattr(scans, "FLAGS", 0)
    assert {(r.rec_kind, r.rec_id, r.fault) for r in scans.p2_found(spark, d).collect()} == got
    monkeypatch.undo()
    spark.createDataFrame([(7, "book")], "doc_id long, stratum string").write.mode("overwrite").parquet(f"{d}/library.parquet")
    assert scans.p2_found(spark, d).count() == 0
