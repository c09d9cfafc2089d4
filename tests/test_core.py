"""Boards, search, sources, streams, edits, metrics; every core query on the smallest tables."""

import json
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from rankfile.functions.board import Board, is_legal_position, replay
from rankfile.functions.dialect import duck, spark_sql
from rankfile.operators import catalogue, edits, evaluation, fusion, index, layout, metrics, movetext, positions, quality, repair, trees
from rankfile.operators.ordered import ranked
from rankfile.operators.predicates import MaterialSignature, MoveQuery, PositionPattern, QueryError, move_glob
from rankfile.operators.search import Query, bm25, encoded, matching, parse_boolean, search
from rankfile.operators.tokens import tokens
from rankfile.sources.pgn import PgnSource, games
from rankfile.streaming import ingest

SF = "/root/testdata/sf0.001"


def test_replay():
    fens = replay("e4 e5 Nf3 Nc6 Bb5 a6 O-O".split())
    assert len(fens) == 7 and fens[-1].startswith("r1bqkbnr/1ppp1ppp/p1n5/1B2p3/4P3/5N2/PPPP1PPP/RNBQ1RK1 b kq")
    assert len(replay("e4 e5 Nf6".split())) == 2 and replay(["e4", "d5", "exd5", "e5", "dxe6"])[-1].startswith("rnbqkbnr/ppp2ppp/4P3/8")
    assert Board("4k3/P7/8/8/8/8/8/4K3 w - -").play("a8=N").placement().startswith("N3k3") and Board("4k3/8/8/8/4r3/8/4B3/4K3 w - -").play("Bd3") is None
    assert is_legal_position("4k3/8/8/8/8/8/8/4K3 w") and not is_legal_position("4k3/8/8/8/8/8/4r3/8 w") and not is_legal_position("4k3/4R3/8/8/8/8/8/4K3 w")


def test_hash_is_a_function_of_the_placement(spark):
    same = ["8/8/8/4k3/8/3K4/4P3/8", "8/8/8/4k3/8/3K4/4P3/8 b - - 3 60", "44/8/8/4k3/8/3K4/4P3/8"]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in [*same, "8/8/8/8/8/8/8/8"]], "p string").select(positions.placement_hash("split_part(p, ' ', 1)")).collect()]
    assert len(set(got[:3])) == 1 and got[3] != got[0] and got[:2] == [positions.hash_number(p) for p in same[:2]]


def test_tokens(spark):
    forms = "Nf3 O-O O-O-O 1.e4 12...Nf6 Qxd5+ e8=Q# exd5 Nbd7 N3xd5 Ne2xd4 Rxf7+ 1-0 0-1 1/2-1/2".split()
    got = [r[0] for r in spark.createDataFrame([(x,) for x in forms], "x string").select(tokens("x")).collect()]
    assert all(len(g) == (2 if x[0].isdigit() and "." in x else 1) for x, g in zip(forms, got)) and got[3] == ["1.e4", "e4"] and got[5] == ["q_xd5+"]


NODES = "node_id long, doc_id long, scope string, page int, ordinal long, text string"
GAME = '[White "A"]\n[FEN "4k3/8/8/8/8/8/4P3/4K3 w - - 0 1"]'


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    """A library with a stored index: paragraphs, a game from a FEN, a usual game, repeated rows, nulls, other columns."""
    d = str(tmp_path_factory.mktemp("library"))
    texts = ["the Bxc4 game", "the bxc4 game", "queen and rook", "dark squares everywhere", None, "", "He played 1.Nxd5+ and Nxd5?? again"]
    nodes = [(i, 1, "all", i, i, x) for i, x in enumerate(texts)] + [(0, 1, "all", 0, 0, texts[0])]
    nodes += [(20, 2, "headers", 1, 0, GAME), (21, 2, "mainline", 1, 1, "1.e4 Kd7 2.e5 Nf3"), (22, 2, "headers", 1, 2, '[White "B"]'), (23, 2, "mainline", 1, 3, "1.e4 e5 2.Nf3! (2.c3 d5) Nc6 3.Bb5")]
    spark.createDataFrame([(*n, "x") for n in nodes], NODES + ", token string").write.parquet(f"{d}/nodes.parquet")
    spark.createDataFrame([(1, "u", "t", "text", "scan"), (2, "v", None, "pgn", "base"), (2, "v", None, "pgn", "base")], "doc_id long, uri string, title string, kind string, stratum string").write.parquet(f"{d}/library.parquet")
    spark.createDataFrame([(0, "A%b", "C", "B90", 0, "*"), (23, "B", "Karl", "C60", 1990, "1-0")], "node_id long, white string, black string, eco string, year int, result string").write.parquet(f"{d}/facets.parquet")
    return index.build(spark, d, f"{d}/index")


def test_search_on_the_stored_index(spark, library):
    hit = lambda q: {r.node_id for r in matching(library, encoded(spark, parse_boolean(q))).collect()}
    assert hit("Bxc4") == {0} and hit("bxc4") == {1} and hit('"dark squares" OR queen') == {2, 3} and hit("the NOT Bxc4") == {1} and hit('"squares dark"') == set() and hit("Nxd5") == {6}
    raw = lambda q: {r.node_id for r in matching(library, encoded(spark, parse_boolean(q, raw=True))).collect()}
    assert raw("(queen OR dark) AND squ*") == {3} and raw("gam* NOT bxc4") == {0}
    for wrong in ("NOT x", "a NOT", "a AND"):
        with pytest.raises(QueryError):
            parse_boolean(wrong)
    with pytest.raises(QueryError):
        parse_boolean("(a", raw=True)
    assert parse_boolean("") is None and parse_boolean("a OR b c")[0] == "or" and move_glob("N*xd5") == "^N.*xd5[+#]?$"
    ids = lambda **k: [r.node_id for r in search(library, Query(**k)).collect()]
    assert ids(text="game") == [0, 1] and ids(player="a%") == [0] and ids(year_max=2000) == [23] and ids(year_min=0) == [0, 23] and ids(stratum="base", scope="mainline") == [21, 23]
    assert ids(scope="all", offset=1, limit=2) == [1, 2] and ids(match="gam*") == [0, 1] and ids(move="Nxd*") == [6] and ids(annotation="??") == [6] and ids(eco="B", documents=("u",)) == [0]
    assert ids(move=MoveQuery(piece="B", to_square="b5", mainline_only=True)) == [23] and ids(move=MoveQuery(pattern="c3", nag=None, min_ply=3)) == [23] and ids(move=MoveQuery(nag="!")) == [23]
    page = search(library, Query(scope="all", limit=3)).collect()
    assert [(r.total, r.truncated) for r in page] == [(7, True)] * 3
    best = search(library, Query(text="Nxd5 OR game", by_score=True)).collect()
    assert best[0].score >= best[-1].score > 0 and {r.node_id for r in best} == {0, 1, 6}
    with pytest.raises(QueryError):
        Query(text="a", match="b")
    assert bm25(library, encoded(spark, parse_boolean("queen"))).count() == 1


def test_positions_of_the_stored_index(spark, library):
    after = "4k3/8/8/8/4P3/8/8/4K3"
    found = positions.find_position(library.keyed("positions", "zobrist", [positions.hash_number(after)]), after).collect()
    assert [(r.node_id, r.ply, r.exact, r.white_to_move) for r in found] == [(21, 1, True, False)]
    forged = library.table("positions").drop("bucket").unionByName(spark.createDataFrame([(positions.hash_number(after), 9, 99, 1, True, "8/8/8/8/8/8/8/8")], "zobrist long, doc_id long, node_id long, ply int, white_to_move boolean, placement string"))
    both = positions.find_position(forged, after).collect()
    assert [r.exact for r in both] == [True, False] and positions.find_position(forged, after, include_collisions=False).count() == 1 and positions.find_position(forged, after, white_to_move=True).count() == 1
    ids = lambda **k: {r.node_id for r in search(library, Query(**k)).collect()}
    assert ids(position=after) == {21} and ids(material="KPvK") == {21} and ids(material=MaterialSignature(min_pawns=16)) == {23}
    assert ids(position_pattern=PositionPattern(turn=False, requires={"e4": "P"}, forbids={"e8": "k"})) == set() and ids(position_pattern=PositionPattern(placement="4k*/8/8/8/4P3/8/8/????K3")) == {21}
    assert {(r.node_id, r.ply) for r in library.table("moves").where(MoveQuery(position=PositionPattern(requires={"b5": "B"})).column()).collect()} == {(23, 5)}
    line = {r.san: r for r in library.table("moves").where("node_id = 23").collect()}
    assert line["c3"].before == line["Nf3"].before and line["d5"].depth == 1 and line["d5"].after and line["Nf3"].nags == ["!"]
    assert {r.node_id: (r.printed, r.legal, r.first_illegal) for r in positions.legality(library.table("moves")).collect()} == {21: (4, 3, "Nf3"), 23: (5, 5, None)}


def test_index_is_found_missing_or_stale(spark, library, tmp_path):
    with pytest.raises(index.IndexMissing):
        index.connect(spark, library.source, f"{tmp_path}/none", create=False)
    with pytest.raises(index.IndexMissing):
        index.connect(spark, library.source, f"{tmp_path}/none", read_only=True)
    index.write_meta(spark, f"{tmp_path}/old", index.VERSIONS | {"tokenizer": "0"})
    with pytest.raises(index.IndexStale):
        index.connect(spark, library.source, f"{tmp_path}/old")
    assert index.connect(spark, library.source, library.folder, create=False).stats()["documents"] == 2 and index.bytes_under(spark, f"{tmp_path}/none") == 0


def test_pgn_source(spark, tmp_path):
    r = random.Random(2)
    text = "\n\n".join(f'[Event "{i}"]\n[White "A{i}"]\n[Black "B"]\n[Date "19{i % 90 + 10}.01.01"]\n[Result "1-0"]\n\n1.e4 {"e5 " * r.randrange(1, 60)}1-0' for i in range(200))
    p = tmp_path / "x.pgn"
    p.write_text(text)
    whole = [g for _, g in games(str(p), 0, len(text))]
    assert len(whole) == 200
    for size in (100, 1777, 10**6):
        assert [g for s in range(0, len(text), size) for _, g in games(str(p), s, min(s + size, len(text)))] == whole
    spark.dataSource.register(PgnSource)
    df = spark.read.format("pgn").option("partitionBytes", "3000").load(str(p))
    assert df.count() == 200 and df.where("white = 'A7' and year = 1917 and movetext like '1.e4%'").count() == 1


def test_stream(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    doc = lambda uri, text, at: json.dumps({"uri": uri, "kind": "text", "text": text, "indexed_at": at})
    (src / "a.json").write_text(doc("a", "x\n\n \n\ny", "2024-01-01T00:00:00") + "\n" + doc("b", "z", "2024-01-01T00:00:00"))
    ingest.start_ingest(spark, str(src), out, str(tmp_path / "cp")).awaitTermination()
    (src / "b.json").write_text(doc("a", "new", "2024-01-02T00:00:00"))
    ingest.start_ingest(spark, str(src), out, str(tmp_path / "cp")).awaitTermination()
    assert {(r.uri, r.text) for r in ingest.current_units(spark, out).collect()} == {("a", "new"), ("b", "z")}
    found = spark.createDataFrame([("a", "other"), ("c", "k")], "uri string, content_key string")
    assert {r.uri for r in ingest.needs_reindex(found, ingest.catalogue(spark, out)).collect()} == {"a", "c"}


def test_edits(spark):
    n = spark.createDataFrame([(1, 1, "all", "ab b ab"), (2, 1, "all", None), (3, 1, "all", "c"), (4, 1, "all", "")], "node_id long, doc_id long, scope string, text string")
    m = edits.matches(n, "a(b)", "$1x").collect()
    assert [(r.node_id, r.start, r.end, r.match, r.becomes) for r in m] == [(1, 0, 2, "ab", "bx"), (1, 5, 7, "ab", "bx")] and edits.matches(n, "b", limit=2).count() == 2
    with pytest.raises(QueryError):
        edits.matches(n, "(")
    p = edits.plan(n, "a(b)", "$1x")
    new, journal, skipped = edits.apply(n, p, "b1")
    assert {r.node_id: r.text for r in new.collect()} == {1: "bx b bx", 2: None, 3: "c", 4: ""} and skipped.count() == 0
    half = p.withColumn("accepted", F.col("i") == 1)
    assert [r.text_after for r in edits.preview(n, half).collect()] == ["ab b bx"]
    assert [r.node_id for r in edits.apply(n.withColumn("text", F.lit("zz")), p, "b1")[2].collect()] == [1]
    second, j2, _ = edits.apply(new, edits.plan(new, "bx", "q"), "b2")
    both = journal.unionByName(j2)
    assert [r.batch for r in edits.undoable(both).collect()] == ["b2"]
    old, marked = edits.undo(second, both, "b2")
    assert {r.node_id: r.text for r in old.collect()} == {r.node_id: r.text for r in new.collect()} and [r.batch for r in edits.undoable(marked).collect()] == ["b1"]


def test_metrics():
    assert metrics.edit_distance("kitten", "sitting") == 3 and metrics.lcs_length("abcde", "ace") == 3


def test_evaluation(spark):
    pairs = [(1, "s", "1.e4 e5 2.Nf3", "1.e4 e5 2.Nf6 Nc6", 0.9), (2, "s", "plain text", "plain text", 0.5), (3, "t", "", "noise", 0.9), (4, "t", "lost", None, None), (5, "t", "abcd", "abcx", 0.9)]
    r = evaluation.rows(spark.createDataFrame(pairs, "k long, s string, t string, f string, c double"), "k", "s", "t", "f", "c")
    got = {x.key: x for x in r.collect()}
    assert (got[1].moves_truth, got[1].moves_kept, got[1].moves_missing, got[1].moves_invented) == (3, 2, 1, 2) and got[2].cer == 0 and got[3].control and got[4].cer == 1 and got[5].cer == 0.25
    s = evaluation.summary(r).collect()[0]
    assert (s.n, s.answered, s.controls, s.control_false_positives, s.abstained, s.review, s.accepted_wrong, s.moves_kept, s.cer_median) == (4, 3, 1, 1, 1, 1, 2, 2, round(sorted(x.cer for x in got.values() if x.answered and not x.control)[1], 5))
    g = {x.gate: x.passed for x in evaluation.gates(r, r).where("stratum is null or stratum = 's'").collect()}
    assert not g["move accuracy"] and g["cer_mean against the baseline"] and not g["invented moves"]
    rng = random.Random(4)
    conf = [(i, round(rng.random(), 3), 0.0, "g") for i in range(400)]
    conf = [(i, c, float(rng.random() < c), e) for i, c, _, e in conf] + [(900, None, 1.0, "g"), (901, 0.5, 1.0, "few")]
    d = spark.createDataFrame(conf, "k long, c double, ok double, g string").withColumn("correct", F.col("ok") == 1)
    bins = {}
    for _, c, ok, e in conf:
        if c is not None:
            bins.setdefault(min(int(c * 10), 9), []).append((c, ok))
    want = sum(abs(sum(c - ok for c, ok in v)) for v in bins.values()) / sum(map(len, bins.values()))
    assert evaluation.calibration(d, "c", "correct").collect()[0].ece == pytest.approx(want, abs=1e-9)
    auc = [(a, b) for a in conf if a[1] is not None and a[2] for b in conf if b[1] is not None and not b[2]]
    assert evaluation.auroc(d, "correct", "c").collect()[0].auc == pytest.approx(sum((a[1] > b[1]) + 0.5 * (a[1] == b[1]) for a, b in auc) / len(auc), abs=1e-9)
    fit = evaluation.isotonic(d, "c", "ok", "g").orderBy("g", "x").collect()
    assert {x.g for x in fit} == {"g"} and 2 <= len(fit) <= 13 and all(a.y <= b.y for a, b in zip(fit, fit[1:]))
    level, steps = {}, []  # pooling adjacent violators, on the same bins
    for _, c, ok, e in conf:
        if c is not None and e == "g":
            level.setdefault(int(c * 100 + 0.5), []).append(ok)
    for i in sorted(level):
        steps.append([sum(level[i]), len(level[i])])
        while len(steps) > 1 and steps[-2][0] * steps[-1][1] >= steps[-1][0] * steps[-2][1]:
            top = steps.pop()
            steps[-1] = [steps[-1][0] + top[0], steps[-1][1] + top[1]]
    assert {x.y for x in fit} <= {round(a / b, 6) for a, b in steps} and fit[-1].y == round(steps[-1][0] / steps[-1][1], 6)
    b = evaluation.bootstrap(d, "k", "c", "g").where("g = 'g'").collect()[0]
    assert b.low < b.mean < b.high and b.high - b.low < 0.15 and b.n == 400
    cal = {x.k: x.calibrated for x in evaluation.interpolated(d, "c", evaluation.isotonic(d, "c", "ok", "g"), "g").collect()}
    assert cal[901] == 0.5 and all(0 <= v <= 1 for k, v in cal.items() if k < 400)


def test_matching_is_greedy_by_score(spark):
    r = random.Random(8)
    pairs = [(a, b, round(r.random(), 2)) for a in range(12) for b in range(12) if r.random() < 0.5]
    free, want = sorted(pairs, key=lambda p: (-p[2], p[0], p[1])), set()
    while free:
        a, b, s = free[0]
        want.add((a, b, s))
        free = [p for p in free if p[0] != a and p[1] != b]
    assert {tuple(x) for x in evaluation.best_matches(spark.createDataFrame(pairs, "a long, b long, s double"), "a", "b", "s").collect()} == want
    box = "page int, id long, x double, y double, w double, h double"
    t = spark.createDataFrame([(1, 1, 0.0, 0.0, 2.0, 2.0), (1, 2, 5.0, 5.0, 1.0, 1.0)], box)
    f = spark.createDataFrame([(1, 7, 0.0, 0.0, 2.0, 2.0), (1, 8, 0.0, 0.5, 2.0, 2.0), (2, 9, 0.0, 0.0, 1.0, 1.0)], box)
    assert {x.page: (x.truth, x.found, x.matched, x.precision) for x in evaluation.region_scores(t, f, "page").collect()} == {1: (2, 2, 1, 0.5), 2: (0, 1, 0, 0.0)}


def test_ranks_of_all_rows(spark):
    rows = [(i * 7 % 100, i) for i in range(100)]
    got = ranked(spark.createDataFrame(rows, "k long, v long"), ["k"], "r").collect()
    assert all(x.r == x.k + 1 for x in got)
    run = {x.k: x.s for x in ranked(spark.createDataFrame(rows, "k long, v long"), ["k"], "s", "v").collect()}
    total = 0
    for k, v in sorted(rows):
        total += v
        assert run[k] == total


def test_catalogue(spark):
    src = lambda keys: spark.createDataFrame(sorted(keys.items()), "uri string, content_key string")
    units = spark.createDataFrame([(u, o, "x" * 10) for u in "abc" for o in range(4)], "uri string, ordinal int, text string")
    none = units.limit(0)
    keys = {"a": "1", "b": "2", "c": "3"}
    known, stored = catalogue.ingest(catalogue.empty(spark), none, src(keys), units, budget=55)
    assert {r.uri: (r.state, r.cursor) for r in known.collect()} == {"a": ("complete", 4), "b": ("partial", 2), "c": ("pending", 0)} and stored.count() == 6
    assert {r.uri: r.action for r in catalogue.actions(known, src(keys | {"a": "9", "d": "4"})).collect()} == {"a": "restart", "b": "resume", "c": "restart", "d": "start"}
    again, every = catalogue.ingest(known, stored, src(keys), units)
    assert {r.uri: (r.state, r.nodes) for r in again.collect()} == {u: ("complete", 4) for u in "abc"} and every.count() == 12
    assert catalogue.needs_reindex(again, src(keys)).count() == 0 and {r.uri for r in catalogue.needs_reindex(again, src(keys | {"b": "x"})).collect()} == {"b"}
    failed = catalogue.mark_failed(again, spark.createDataFrame([("b", "bad"), ("z", "gone")], "uri string, error string"))
    assert {r.uri: (r.state, r.nodes, r.error) for r in failed.where("error is not null").collect()} == {"b": ("failed", 4, "bad"), "z": ("failed", 0, "gone")}
    left, kept = catalogue.remove(again, every, src({"a": "1"}))
    assert {r.uri for r in left.collect()} == {"b", "c"} and kept.count() == 8
    assert {r.state: r.documents for r in catalogue.progress(known, units.groupBy("uri").agg(F.sum(F.length("text")).alias("bytes"))).collect()} == {"complete": 1, "partial": 1, "pending": 1}


def test_trees(spark, tmp_path):
    rows = [(1, 1, "headers", 0, "Title"), (2, 1, "all", 1, "a <b> & \"c\"\nd"), (3, 1, "headers", 2, '[White "A"]'), (4, 1, "mainline", 3, "1.e4"), (5, 1, "comments", 4, None), (6, 1, "captions", 5, "fig"), (7, 1, "comments", 6, "loose"), (2, 1, "all", 1, "a <b> & \"c\"\nd")]
    n = spark.createDataFrame(rows, "node_id long, doc_id long, scope string, ordinal long, text string")
    t = trees.tree(n)
    assert {r.node_id: (list(r.path), r.tag) for r in t.where("node_id is not null").collect()} == {1: ([0], "heading"), 2: ([1], "paragraph"), 3: ([2, 3], "header"), 4: ([2, 4], "mainline"), 5: ([2, 5], "comment"), 6: ([5], "figure"), 7: ([6], "comment")}
    assert {(r.node_id, r.scope) for r in trees.units(t).collect()} == {(r[0], r[2]) for r in rows}
    assert [r.place for r in trees.children(t).where("size(parent) = 1").orderBy("place").collect()] == [1, 2, 3]
    assert {r.tag for r in trees.transformed(t, ["game"], [], {"comment": "note"}).collect()} == {"document", "heading", "paragraph", "figure", "note"}
    x = n.select("doc_id", "ordinal", "node_id", F.lit("paragraph").alias("tag"), "text").distinct()
    for form, back in (("jsonl", 7), ("html", 6), ("text", 6)):
        trees.export(x, f"{tmp_path}/{form}", form)
        assert trees.read_back(spark, f"{tmp_path}/{form}", form).count() == back
    assert {r.text for r in trees.read_back(spark, f"{tmp_path}/html", "html").collect()} == {r[4] for r in rows if r[4] is not None}
    old = spark.createDataFrame([('{"version":1,"kind":"figure","id":1,"body":"b"}',), ('{"version":2,"tag":"p","id":2,"body":"c"}',), ('{"version":3,"tag":"p","id":3}',), ("[]",), ('{"version":9}',)], "value string")
    assert {r.id: (r.tag, r.text) for r in trees.loaded(old).collect()} == {1: ("figure", "b"), 2: ("p", "c"), 3: ("p", None)}
    with pytest.raises(ValueError):
        trees.MIGRATIONS.plan(4)
    p = spark.createDataFrame([([4, 0, 1, 2, 6],), ([],)], "pages array<int>").withColumn("count", F.lit(6)).withColumn("r", trees.described("pages"))
    assert [(r.r, list(r.back)) for r in p.withColumn("back", trees.page_range("r", "count")).collect()] == [("1-3,5,7", [0, 1, 2, 4]), ("", [])]


def test_quality(spark):
    en = "the king and the queen stand on the open file while the rook is lost in the corner of the board"
    de = "der turm und die dame stehen auf der offenen linie und der läufer ist in der ecke verloren gegangen"
    items = spark.createDataFrame([(i, "en" if i % 2 else "German", en if i % 2 else de) for i in range(8)] + [(90, None, "x"), (91, "en", None)], "item_id long, lang string, text string")
    lex = quality.lexicons(items, "item_id", "lang", "text")
    assert {r.code for r in lex.collect()} == {"en", "de"} and lex.where("word = 'king' and code = 'en'").count() == 1
    n = spark.createDataFrame([(1, en), (2, de), (3, "thc kinq wxcvbn qu33n " * 6), (4, "1.e4 e5 2.Nf3 Nc6"), (5, ""), (6, None)], "k long, t string")
    s = quality.plausible(quality.prose_language(quality.signals(n, "k", "t", lex)))
    got = {r.key: r for r in quality.text_plausibility(quality.estimated_error(s)).collect()}
    assert set(got) == {1, 2, 3, 4} and (got[1].code, got[2].code, got[3].code) == ("en", "de", None) and got[4].judged == 0 and got[4].notation_ratio == 1
    assert got[3].cer > 0.05 > got[1].cer and got[1].plausibility > got[3].plausibility and got[4].plausibility >= 0.65
    c = spark.createDataFrame([("Nach Sf3 und Txe5 kam Lb5",), ("Qxd5 Rb1",), ("no moves",)], "t string").select(quality.convention("t").alias("c")).collect()
    assert [r.c and r.c.locale for r in c] == ["de", "en", None]
    forms = quality.affixed(spark.createDataFrame([("try", "YU")], "word string, flags string"), spark.createDataFrame([("Y", "suffix", "y", "ies", "[^aeiou]y"), ("U", "prefix", "", "re", ".")], "flag string, kind string, strip string, `add` string, condition string"))
    assert {r.word for r in forms.collect()} == {"try", "tries", "retry", "retries"}
    known = quality.is_word(spark.createDataFrame([("Tries",), ("tryed",)], "w string"), "w", forms).collect()
    assert {r.w: r.known for r in known} == {"Tries": True, "tryed": False}


def test_repair(spark):
    assert [x[2] for x in repair.repaired("1.e4 e5 2.Sf3 Sc6 3.Lb5", "de")] == ["e4", "e5", "Nf3", "Nc6", "Bb5"] and repair.repaired(None) == []
    assert [x[2] for x in repair.repaired("1.el4 e5")] == [None] and [x[2] for x in repair.repaired("1.e4 e5 2.Nf3 Nc6 3.Bc4 Nf6 4.0-0")][-1] == "O-O"
    assert [x[2] for x in repair.repaired("1.d4 dS 2.c4")] == ["d4", "d5", "c4"]
    g = {r.i: r for r in repair.repairs(spark.createDataFrame([(1, "1.e4 e5 2.Cf3 Cc6"), (2, None), (3, "")], "node_id long, text string")).collect()}
    assert {r.locale for r in g.values()} <= {"es", "fr", "pt"} and [g[i].san for i in range(4)] == ["e4", "e5", "Nf3", "Nc6"]
    d = spark.createDataFrame([(["e5", "Nf3", "Nc6"], "x b - - 0 3"), (["e4"], None), ([], "x w")], "l array<string>, fen string")
    assert [r[0] for r in d.select(repair.numbered("l")).collect()] == ["3... e5 4. Nf3 Nc6", "1. e4", ""]
    inv = spark.createDataFrame([("Nf3!", "Nf3"), ("0-0", "O-O"), ("1.el4", "e4"), ("Sf3", "Nf3")], "printed string, san string").select(repair.invention()).collect()
    assert [r[0] for r in inv] == [False, False, True, True]
    n = spark.createDataFrame([(1, o, "headers" if o in (2, 5) else "all", "[x" if o in (2, 5) else "t") for o in range(8)], "doc_id long, ordinal long, scope string, text string")
    s = repair.segments(n)
    assert {(r.game, r["first"], r["last"]) for r in s.collect()} == {(1, 2, 4), (2, 5, 7)}
    assert {r.position: r.game for r in repair.segment_at(s, spark.createDataFrame([(1, p) for p in (0, 3, 7)], "doc_id long, position long")).collect()} == {0: None, 3: 1, 7: 2}


def test_layout(spark):
    box = "doc_id long, page int, id long, line_no int, x double, y double, w double, h double, text string"
    two = [(1, 1, 100 * c + i, i, 50.0 + 250 * c, 40.0 + 14 * i, 200.0, 10.0, f"line {i}") for c in (0, 1) for i in range(1, 9)] + [(1, 1, 900, None, None, 1.0, 1.0, 1.0, None)]
    d = spark.createDataFrame(two, box)
    assert [(r.left >= 248, r.right <= 300) for r in layout.gutters(d).collect()] == [(True, True)] and {(r.id // 100, r.column) for r in layout.columns(d).collect()} == {(0, 1), (1, 2)}
    order = [r.id for r in layout.reading_order(d).orderBy("rank").collect()]
    assert order == [*range(1, 9), *range(101, 109)]
    rows = [(2, 1, 10 * i + k, i, 50.0 + 60 * k, 20.0 * i, 40.0, 10.0, "12") for i in range(1, 5) for k in range(3)]
    assert [(r["first"], r["last"], r.rows, r.cells) for r in layout.tables(spark.createDataFrame(rows, box)).collect()] == [(1, 4, 4, 3)]
    heads = [(3, p, 10 * p + k, k, 1.0, 1.0, 9.0, 9.0, t) for p in range(1, 5) for k, t in enumerate([f"Chapter {p}", "body of the page", str(p)])]
    kinds = {r.id: r.kind for r in layout.classified(spark.createDataFrame(heads, box)).collect()}
    assert kinds[10] == "header" and kinds[12] == "page number" and 11 not in kinds
    assert layout.documents(layout.analyzed(d)).collect()[0].columns == 2


def test_fusion(spark):
    out = fusion.fuse([("a", 0.5, "the quccn moves"), ("b", 0.4, "the queen moves"), ("c", 0.3, "the queen moves now")])
    assert [t for t, *_ in out] == ["the", "queen", "moves"] and [d for *_, d in out] == [False, True, False] and fusion.fuse([]) == []
    r = spark.createDataFrame([(1, "a", 1, 0.2, "x"), (1, "b", 2, 0.9, "y"), (1, "c", 3, 0.95, "z"), (2, "a", 1, 0.2, "x"), (2, "b", 2, None, "y"), (3, "a", 1, 0.9, None)], "region long, source string, level int, score double, text string")
    assert {x.region: (x.source, x.asked) for x in fusion.arbitrated(r).collect()} == {1: ("b", 2), 2: ("a", 2)}
    assert {x.region: x.tokens for x in fusion.fusion_summary(fusion.fused(r)).collect()} == {1: 1, 2: 1}


def test_movetext():
    text = "1.e4 e5 (1...c5 2.Nf3 (2.c3 d5) 2...d6) 2.Nf3! {good} Nc6 $4 *"
    got, issues = movetext.parse(text)
    assert not issues and [(m["san"], m["ply"], len(m["path"]) // 2) for m in got] == [("e4", 1, 0), ("e5", 2, 0), ("c5", 2, 1), ("Nf3", 3, 1), ("c3", 3, 2), ("d5", 4, 2), ("d6", 4, 1), ("Nf3", 3, 0), ("Nc6", 4, 0)]
    assert movetext.to_text(got) == "1. e4 e5 (1... c5 2. Nf3 (2. c3 d5) 2... d6) 2. Nf3! {good} 2... Nc6 $4" and movetext.labels(got) == ["A", "A1"]
    assert movetext.parse("1.e4 ) (")[1] == [(5, "unopened bracket"), (8, "unclosed bracket")] and movetext.parse(None) == ([], []) and movetext.parse("")[0] == []
    up = movetext.promote(got, got[2]["path"])
    assert [m["san"] for m in up if not m["path"]] == ["e4", "c5", "Nf3", "d6"] and movetext.unbalanced("a(b]c") == [(1, "("), (3, "]")]
    assert movetext.first_json_object('x {bad} {"a": {"b": 1}} y') == '{"a": {"b": 1}}' and movetext.first_json_object("none") is None
    assert movetext.normal("0-0–x  ﬁ") == "O-O-x fi" and movetext.folded("Étüde ß") == "etude ss" and movetext.normal(None) is None


def test_dialects():
    assert spark_sql("RL({x}, '^[[]a')", x="t") == "regexp_like(t, '^\\\\[a')" and duck("EL(SPLIT({x}, ' '), 2)", x="t") == "list_extract(string_split_regex(t, ' '), 2)"


def test_origins_and_pages(spark, tmp_path):
    from rankfile.plans import all_queries
    from rankfile.plans.text_ops import origins

    text, at = origins(" ﬁn –  x\u00a0y ")
    assert text == "fin - x y" and len(at) == len(text) and at[:3] == [1, 1, 2] and at == sorted(at) and origins("") == ("", [])
    caps = [(1, 1, "captions", 7, "Position 3. White to play, mate in 2"), (2, 1, "captions", 7, "Diagram 4"), (3, 1, "captions", 8, "mate in 2"), (4, 1, "captions", 8, "mate in 3"), (5, 1, "captions", 9, None), (1, 1, "captions", 7, "Position 3. White to play, mate in 2")]
    spark.createDataFrame([(*c, i) for i, c in enumerate(caps)], "node_id long, doc_id long, scope string, page int, text string, ordinal long").write.parquet(f"{tmp_path}/nodes.parquet")
    q = all_queries()
    assert {r.page: (r.page_mate, r.page_side) for r in q["o9_5_page_stipulation"](spark, str(tmp_path)).collect()} == {7: (2, "white"), 8: (None, None)}
    assert {r.node_id: (r.mate, r.side) for r in q["o9_9_apply_page_scope"](spark, str(tmp_path)).collect()} == {1: (2, "white"), 2: (2, "white"), 3: (2, None), 4: (3, None)}


def test_every_core_query_runs(spark):
    """All of them, on the smallest tables, several at a time."""
    from rankfile.plans import all_queries, all_sql

    assert set(all_sql()) <= set(all_queries())
    index.opened(spark, SF)  # built once
    run = lambda item: (item[0], item[1](spark, SF).count())
    with ThreadPoolExecutor(6) as pool:
        done = dict(pool.map(run, sorted(all_queries().items())))
    assert len(done) == len(all_queries())
