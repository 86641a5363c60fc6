"""The gate, containers, titles by size: made rows, each with what is wrong with it."""

import base64
import hashlib
import json

from pyspark.sql import functions as F

from quire.operators import containers as K
from quire.operators import gate as G
from quire.operators import joins as J
from quire.operators import page as P
from quire.operators import sequence as S


def found(report):
    return sorted((r.owner, r.severity, r.rule, r.detail) for r in report.collect())


def test_lead(spark):
    good = "g" * 30
    rows = [("a", (good, ["x", "y"])), ("b", None), ("c", (None, ["x", " ", "y"])), ("d", (" short ", ["x"])), ("e", (good + '"', ['q"', 'r"'])), ("f", (good, None))]
    got = found(G.lead(spark.createDataFrame(rows, "section_id string, lead struct<gist: string, focus: array<string>>")))
    assert got == [
        ("c", "error", "FOCUS_BLANK", "2"), ("c", "error", "GIST_MISSING", ""), ("d", "error", "FOCUS_COUNT", "1"), ("d", "error", "GIST_SHORT", "5"),
        ("e", "warning", "STRAIGHT_QUOTE", "focus"), ("e", "warning", "STRAIGHT_QUOTE", "focus"), ("e", "warning", "STRAIGHT_QUOTE", "gist"), ("f", "error", "FOCUS_COUNT", "-1"),
    ]


def test_graph(spark):
    nodes = spark.createDataFrame([("s", "v", "a", "l", "h", "mechanism", ["q"]), ("s", "v", "a", "l", None, "mechanism", ["q"]), ("s", "v", "b", "l", "h", "none", [])], "section_id string, view string, id string, label string, short string, cluster string, evidence array<string>")
    assert found(G.nodes(nodes)) == [("s", "error", "CLUSTER", "v/b none"), ("s", "error", "NODE_ID", "v|a"), ("s", "error", "NODE_SHORT", "v/a"), ("s", "warning", "NODE_EVIDENCE", "v/b")]
    schema = "section_id string, view string, `from` string, `to` string, rel string, label string, polarity string, origin string, evidence array<string>"
    edges = spark.createDataFrame([("s", "v", "a", "b", "促进", "l", "promote", "sentence", ["q"]), ("s", "w", "a", None, "x", "", None, "y", None)], schema)
    assert found(G.edges(edges, nodes)) == [("s", "error", r, "w/a") for r in ("EDGE_EVIDENCE", "EDGE_FROM", "EDGE_LABEL", "EDGE_TO", "ORIGIN", "POLARITY", "REL")]
    assert found(G.edges(edges.limit(0), nodes)) == []


def test_matrix_and_tracks(spark):
    cols = spark.createDataFrame([("s", "v", "c1", "l"), ("s", "v", "c2", ""), ("s", "x", "c", "l")], "section_id string, view string, id string, label string")
    rows = spark.createDataFrame([("s", "v", "r1", "l", None), ("s", "v", "r2", "l", "odd")], "section_id string, view string, id string, label string, cluster string")
    cells = spark.createDataFrame([("s", "v", "r1", "c1", "na", []), ("s", "v", "r1", "c2", "more", ["q"]), ("s", "v", "r2", "c1", "up", None), ("s", "v", "r2", "c9", "up", ["q"])], "section_id string, view string, row string, col string, mark string, evidence array<string>")
    assert found(G.matrix(cols, rows, cells)) == [
        ("s", "error", "CELL", "v/r2/c2"), ("s", "error", "CELL_COL", "v/r2/c9"), ("s", "error", "COL_NAME", "v/c2"), ("s", "error", "MARK", "v/r1/c2 more"), ("s", "error", "MATRIX", "x"), ("s", "error", "ROW_CLUSTER", "v/r2 odd"), ("s", "warning", "CELL_EVIDENCE", "v/r2/c1"),
    ]
    tracks = spark.createDataFrame([("s", "v", "t", "l", None, ["q"]), ("s", "v", "u", None, None, None)], "section_id string, view string, id string, label string, cluster string, evidence array<string>")
    segments = spark.createDataFrame([("s", "v", "t", "a", "itam", 1.0, None), ("s", "v", "t", "b", "odd", 0.0, None), ("s", "v", "t", "c", "brs", None, ["q"])], "section_id string, view string, track string, label string, kind string, len double, evidence array<string>")
    assert found(G.tracks(tracks, segments)) == [("s", "error", "KIND", "v/t/b"), ("s", "error", "LENGTH", "v/t/b"), ("s", "error", "LENGTH", "v/t/c"), ("s", "error", "SEGMENTS", "v/u"), ("s", "error", "TRACK_NAME", "v/u")]


def test_containers(spark):
    text = b"payload"
    sha = hashlib.sha256(text).hexdigest()
    man = lambda **k: json.dumps({"format": "Q", "version": 1, "pid": "p", "pdf": {"pages": 2}, "payload": {"text": {"bytes": 7, "sha256": sha}}} | k).encode()
    files = spark.createDataFrame([(i, f"/d/n{i}.a.b", b"%PDF- x Q.m", 2, 4) for i in range(5)] + [(9, "plain.pdf", b"%PDF-", 1, None)], "owner int, path string, content binary, pages int, dests int")
    payloads = [(i, "text", text) for i in range(5)] + [(0, "Q.m", man()), (1, "Q.m", man(version="1", pid=None)), (2, "Q.m", b"{"), (3, "Q.m", man(payload={"text": {"sha256": "00"}}, pdf={"pages": 7}))]
    payloads = spark.createDataFrame(payloads, "owner int, name string, content binary")
    got = {r.owner: (r.reason, r.version, r.pid, r.entries) for r in K.identified(files, payloads, "Q.m", "Q").collect()}
    assert got == {0: (None, 1, "p", 2), 1: (None, None, "n1", 2), 2: ("format", None, "n2", 2), 3: (None, 1, "p", 2), 4: ("manifest", None, "n4", 1), 9: ("marker", None, "plain", 0)}
    was = spark.createDataFrame([(0, 3, 4), (1, None, 5)], "owner int, pages int, dests int")
    assert found(K.verified(files, payloads, "Q.m", "Q", ("text",), was)) == [
        ("0", "error", "PAGES_CHANGED", "2"), ("1", "error", "DESTS", "4"), ("1", "error", "VERSION", ""), ("2", "error", "FORMAT", ""), ("2", "error", "VERSION", ""), ("3", "error", "HASH", "text"), ("3", "error", "MANIFEST_PAGES", "7"), ("9", "error", "MISSING", "text"),
    ]
    assert ("0", "error", "CAPS", str(7 + len(man()))) in found(K.verified(files, payloads, "Q.m", "Q", ("text",), total=20))
    assert spark.range(1).select(K.image_url(F.lit(b"\x01\x02"), F.lit("x.JPEG")).alias("a"), K.image_url(F.lit(b""), None, F.lit("t/u"))).first()[:] == ("data:image/jpeg;base64,AQI=", "data:t/u;base64,")


def test_title_by_size(spark):
    rows = []

    def page(doc, number, *lines):
        for text, size, y in lines:
            rows.append((doc, number, len(rows), 1, text, size, 60.0, y, 500.0, 800.0, 600.0))

    body = [("some words of the running text", 10.0, 400.0 + 12 * i) for i in range(5)]
    title = [("A long title of granulocyte-", 20.0, 100.0), ("monocyte things and antitumor", 20.0, 122.0), ("potency", 20.0, 144.0)]
    page(1, 1, *title, *body)
    page(2, 1, *body)  # the second page stands in
    page(2, 2, *title, *body)
    page(3, 1, ("2.1 A numbered heading of it", 20.0, 100.0), ("that goes on a bit longer", 20.0, 122.0), *body)
    page(4, 1, *[(t, 14.0, y) for t, _, y in title], *body)  # not large enough beside 10 points
    page(5, 1, *[(t, s, y + 500) for t, s, y in title], *body)  # too low
    page(6, 1, ("abcd1_grabs of typesetting", 20.0, 100.0), ("and one line of words", 20.0, 200.0), *body)  # one line
    got = P.title_by_size(spark.createDataFrame(rows, "doc_id int, page int, pos int, block int, text string, size double, x0 double, y0 double, x1 double, height double, width double"))
    whole = "A long title of granulocyte-monocyte things and antitumor potency"
    assert sorted(map(tuple, got.collect())) == [(1, whole), (2, whole)]


def test_blocks_of_short_quotes(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 2)
    texts = spark.createDataFrame([(1, "one two three"), (2, "four"), (3, None)], "doc_id int, text string")
    quotes = spark.createDataFrame([(1, "wo thr"), (2, "four"), (3, ""), (4, "e"), (5, "x"), (6, None)], "quote_id int, quote string")
    assert sorted(map(tuple, J.contains_join(texts, quotes).collect())) == [(1, 1), (1, 4), (2, 2)]
    grid = spark.createDataFrame([(r, c) for r in range(3) for c in range(5)], "r int, c int")
    assert sorted(map(tuple, J.missing_cells(grid, grid, grid.where("(r + c) % 2 = 0"), "r", "c").collect())) == [(r, c) for r in range(3) for c in range(5) if (r + c) % 2]
    assert J.missing_cells(grid, grid.limit(0), grid, "r", "c").count() == 0


def test_upper_median(spark):
    rows = spark.createDataFrame([("a", x) for x in (5, 1, 4, 2)] + [("b", 7), ("b", None), ("b", 9), ("b", 9)], "k string, v int")
    assert sorted(map(tuple, S.upper_median(rows, ["k"], "v", "m").collect())) == [("a", 4), ("b", 9)]


def test_image_addresses_have_one_line(spark):
    content = [bytes(range(256)) * 3, b"x" * 57, b"x" * 58, b"", None]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(content)], "i int, c binary").select("i", K.image_url(F.col("c")).alias("u"))
    expected = {i: None if c is None else "data:image/png;base64," + base64.b64encode(c).decode() for i, c in enumerate(content)}
    assert {r.i: r.u for r in rows.collect()} == expected
