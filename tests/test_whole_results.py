"""Queries over whole tables and texts, against brute force on fixtures."""

import datetime
import json
import random
import re

import pytest

from rankfile.operators.metrics import edit_distance
from rankfile.plans import all_queries, all_sql


def rows_of(spark, path, query, **tables):
    """Rows of a query over tables of (rows, schema)."""
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return all_queries()[query](spark, str(path)).collect()


JOURNAL = "edit_id long, batch string, doc_id long, node_id long, text_before string, text_after string, applied_at timestamp, undone boolean"


def journal():
    """Long texts in two scripts with one late change, short ones, empty ones, nulls, a repeated row."""
    r = random.Random(5)
    words = "ладья пешка rook Läufer échec мат 1.e4 слон".split()
    out = []
    for i in range(24):
        before = [r.choice(words) for _ in range(r.choice([3, 40, 120]))]
        after = list(before)
        for _ in range(i % 4):
            after[-1 - r.randrange(3)] = r.choice(["ферзь", "queen", ""])
        out.append((i, " ".join(before), "\n".join(after) if i % 5 == 0 else " ".join(after)))
    out += [(90, "", ""), (91, "", "x"), (92, "ход", ""), (93, None, "x"), (94, "x", None)]
    rows = [(k, "b", 1, 1, a, b, datetime.datetime(2024, 1, 1), k % 2 == 0) for k, a, b in out]
    return [*rows, rows[0]], out


def test_distances_cover_whole_texts(spark, tmp_path):
    rows, texts = journal()
    both = {k: (a, b) for k, a, b in texts if a is not None and b is not None}
    assert max(len(a) for a, _ in both.values()) > 400
    got = {r.edit_id: r.d for r in rows_of(spark, tmp_path, "o9_36_levenshtein_words", edit_journal=(rows, JOURNAL))}
    assert got == {k: None if k in (93, 94) else edit_distance(both[k][0].split(), both[k][1].split()) for k, _, _ in texts}
    got = {r.edit_id: r.cer for r in rows_of(spark, tmp_path, "o9_37_character_error_rate")}
    flat = {k: (" ".join(a.split()), " ".join(b.split())) for k, (a, b) in both.items()}
    want = {k: edit_distance(a, b) / len(a) if a else float(bool(b)) for k, (a, b) in flat.items()}
    assert set(got) == set(want) | {94} and got[94] is None and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    got = {r.undone: (r.distance, r.chars) for r in rows_of(spark, tmp_path, "o4_29_measure_group")}
    for side in (True, False):
        mine = [(a, b) for k, a, b in texts if (k % 2 == 0) == side]
        assert got[side] == (sum(edit_distance(a, b) for a, b in mine if a is not None and b is not None), sum(len(a) for a, _ in mine if a is not None))


NODES = "node_id long, doc_id long, scope string, page int, ordinal long, byte_start long, byte_len long, text string"


def test_lexicons_hold_every_word(spark, tmp_path):
    texts = ["The initiative passed, initiative and Attack; König überlegte länger", "Первая инициатива, фигура ladder", "short ones only", "", None, "1.e4 initiative_attack2pressure"]
    nodes = [(i, i % 2, "all", 1, i, 0, 1, t) for i, t in enumerate(texts)]
    want = {d: {w for i, t in enumerate(texts) if i % 2 == d for w in re.findall(r"[^\W\d_]{6,}", (t or "").lower())} for d in (0, 1)}
    got = {r.doc_id: r.words for r in rows_of(spark, tmp_path, "o9_61_book_lexicon", nodes=([*nodes, nodes[0]], NODES))}
    assert got == {d: len(w) for d, w in want.items()} and got == {0: 5, 1: 7}
    labels = [("en", "en"), ("EN", "en"), ("eng", "en"), ("en-GB", "en"), ("German", "de"), ("es-MX", "es"), ("Portuguese", "pt"), ("fra", "fr"), ("xx", None), ("ru-RU", "ru"), ("", None), (None, None)]
    text = ["The rook, the bishop", "Läufer schlägt école", "слон и ладья", None, "don't 12.Nf3"]
    rows = [(k, lang, "n", f"{text[k % 5]} {lang}" if text[k % 5] else None) for k, (lang, _) in enumerate(labels)]
    rows_of(spark, tmp_path, "o9_60_lexicon_for", authored=([*rows, rows[0]], "item_id long, lang string, notation string, text string"))
    items, count, total = {}, {}, {}
    for (_, code), (k, *_, t) in zip(labels, rows):
        for w in re.findall(r"[^\W\d_]{2,}", (t or "").lower()) if code else ():
            items.setdefault((code, w), set()).add(k)
            count[code, w] = count.get((code, w), 0) + 1
            total[code] = total.get(code, 0) + 1
    rate = {cw: n / total[cw[0]] for cw, n in count.items()}
    top = {w: max(r for (_, v), r in rate.items() if v == w) for _, w in rate}
    kept = {(c, w): n for (c, w), n in count.items() if len(items[c, w]) >= 2 and rate[c, w] >= 0.25 * top[w]}
    got = {r.code: (r.words, r.occurrences) for r in all_queries()["o9_60_lexicon_for"](spark, str(tmp_path)).collect()}
    assert got == {c: (sum(k[0] == c for k in kept), sum(n for k, n in kept.items() if k[0] == c)) for c in {k[0] for k in kept}} and got


def test_clean_text_covers_every_paragraph(spark, tmp_path):
    texts = ["the posi-\ntion is won", "Stel-\n lung, пози-\nция, él-\névation", "Ruy-\nLopez and 1-\n0", "one  line", "a-\nb-\nc\nd", "", None]
    want = ["the position is won", "Stellung, позиция, élévation", "Ruy- Lopez and 1- 0", "one line", "abc d", "", None]
    nodes = [(i, 1, "all", 1, i, 0, 1, t) for i, t in enumerate(texts)] + [(99, 1, "comments", 1, 99, 0, 1, "no-\nne")]
    got = {r.node_id: r.clean for r in rows_of(spark, tmp_path, "o9_12_clean_pdf_text", nodes=([*nodes, nodes[0]], NODES))}
    assert got == dict(enumerate(want))


def test_moves_have_no_cap_or_stride(spark, tmp_path):
    line = " ".join(f"{i}.Nf3 Nf6" for i in range(1, 31))
    texts = [(1, "mainline", 1, line), (2, "mainline", 900, "1.e4 e5"), (3, "variations", 3, "(1.d4 d5 (1...Nf6 2.c4) 2.c4) (1.c4)"), (4, "mainline", 4, None), (5, "comments", 5, "1.e4")]
    nodes = [(k, 1, scope, 1, o, 0, 1, t) for k, scope, o, t in texts]
    got = rows_of(spark, tmp_path, "o15_20_mainline", nodes=([*nodes, nodes[0]], NODES))
    assert sorted((r.node_id, r.ply, r.san) for r in got) == [(1, i, "Nf3" if i % 2 else "Nf6") for i in range(1, 61)] + [(2, 1, "e4"), (2, 2, "e5")]
    want = {}
    for k, scope, _, t in texts:
        if t and scope != "comments":
            at = [m.start() for m in re.finditer(r"[KQRBN]?[a-h][1-8]", t)]
            want |= {(k, i): max(t[:p].count("(") - t[:p].count(")"), 0) for i, p in enumerate(at)}
    assert {(r.node_id, r.pos): r.depth for r in rows_of(spark, tmp_path, "o1_10_move_depth")} == want and set(want.values()) == {0, 1, 2}


def test_lines_near_by_radius(spark, tmp_path):
    r = random.Random(3)
    boxes = [(k, 1, 1 + k % 2, r.uniform(0, 300), r.uniform(0, 200), r.choice([0.0, 40.0, 90.0]), 12.0) for k in range(60)] + [(90, 1, 1, None, 10.0, 20.0, 12.0), (91, 2, 1, 10.0, 10.0, 20.0, 12.0)]
    schema = "span_id long, doc_id long, page int, line_no int, span_no int, text string, x double, y double, w double, h double, font string, font_size double, confidence double, engine string, review boolean"
    rows = [(k, d, p, 7, 1, "t", x, y, w, h, None, None, None, "", False) for k, d, p, x, y, w, h in boxes]
    want = {}
    for k, d, p, x, y, w, h in boxes:
        for m, e, q, u, v, s, t in boxes:
            if k == m or (d, p) != (e, q) or x is None or u is None:
                continue
            dx, dy = max(u - x - w, x - u - s, 0), max(v - y - h, y - v - t, 0)
            share = lambda a, b, c, f: max(0, min(b, f) - max(a, c)) / min(b - a, f - c) if min(b - a, f - c) > 0 else 0
            tall = (dy > 0 or dx == 0) and share(x, x + w, u, u + s) >= 0.25
            if (tall or (dx > 0 and share(y, y + h, v, v + t) >= 0.25)) and (dx * dx + dy * dy) ** 0.5 <= 60:
                want[k, m] = (dx * dx + dy * dy) ** 0.5
    got = {(r.anchor, r.near_id): r.distance for r in rows_of(spark, tmp_path, "o3_12_lines_near", text_spans=([*rows, rows[0]], schema))}
    assert set(got) == set(want) and len(want) > 50 and all(got[k] == pytest.approx(want[k], abs=1e-4) for k in want)


def test_json_and_diff_of_every_row(spark, tmp_path):
    names = [("Müller, J", "O'Kelly", 1950), ('Said "Bob", A', "Back\\slash\ttab", 0), ("Иванов", None, None)]
    facets = [(i, 1, w, b, "B90", y, "1-0") for i, (w, b, y) in enumerate(names)]
    got = rows_of(spark, tmp_path, "o1_50_structural_json", facets=([*facets, facets[0]], "node_id long, doc_id long, white string, black string, eco string, year int, result string"))
    assert {r.node_id: json.loads(r.js) for r in got} == {i: {"white": w, "black": b, "year": y} for i, (w, b, y) in enumerate(names)}
    at = datetime.datetime(2024, 1, 1)
    edits = [(1, "b", 1, 1, "a", "a", at, False), (2, "b", 1, 2, "a", "c", at, False), (11, "b", 1, 3, "a", "c", at, True)]
    got = {r.node_id: r.change for r in rows_of(spark, tmp_path, "o3_17_semantic_diff", edit_journal=(edits, JOURNAL))}
    assert got == {1: "same", 2: "changed", 3: "added"}


def test_overlap_of_boxes_without_width(spark, tmp_path):
    import duckdb

    inf = float("inf")
    boxes = [(54.0, 258.0), (315.0, 0.0), (60.0, 0.0), (60.0, 0.0), (60.0, -0.0), (50.0, -4.0), (None, 0.0), (None, 1e-12), (None, None), (54.0, None), (100.0, 33.3), (float("nan"), 7.0), (0.0, inf), (-inf, 9.0)]
    rows = [(100 * line + i, 1, 1, line, x, 0.0, w, 12.0) for line, found in enumerate([boxes, boxes[::-1]]) for i, (x, w) in enumerate(found)]
    spans = ([*rows, rows[0]], "span_id long, doc_id long, page int, line_no int, x double, y double, w double, h double")
    got = {(r.s1, r.s2): r.share for r in rows_of(spark, tmp_path, "o12_22_horizontal_overlap", text_spans=spans)}
    db = duckdb.connect()
    db.sql(f"create view text_spans as select * from '{tmp_path}/text_spans.parquet/*.parquet'")
    want = {(a, b): share for a, b, share in db.sql(all_sql()["o12_22_horizontal_overlap"]).fetchall()}
    assert len(got) == 14 * 13 and {k: repr(x) for k, x in got.items()} == {k: repr(x) for k, x in want.items()}
    assert repr(got[0, 1]) == "nan" and got[0, 10] == 1 and got[0, 6] == inf and got[0, 7] > 1e13 and got[8, 9] is None
