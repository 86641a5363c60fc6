"""Roles of lines, heading blocks and sections of made documents."""

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import roles as R
from quire.operators import sections as C

LINE = "doc_id int, page int, pos int, text string, font string, size double, x0 double, y0 double, x1 double, y1 double, height double"
PROSE = "this is some running prose of the paper that goes on and on and"


def paper(headings, pages=6):
    """Pages of twenty lines of prose with a running head and a printed number; headings: page -> [(text, font, x1)]."""
    rows = []

    def add(page, text, font, size, y, x1=300.0):
        rows.append((1, page, len(rows), text, font, size, 50.0, y, x1, y + 10, 800.0))

    for p in range(1, pages + 1):
        add(p, f"{p} Journal of Things", "Run", 8.0, 20.0)
        y = 120.0
        for text, font, x1 in headings.get(p, ()):
            add(p, text, font, 12.0, y, x1)
            y += 12 if font == "Head-Bold" else 24
        for i in range(20):
            add(p, PROSE + (" ends." if i == 19 else ""), "Body", 10.0, y + 12 + 12 * i)
        add(p, str(100 + p), "Num", 9.0, 780.0)
    return rows


HEADS = {1: [("Introduction to all of it", "Head", 300.0)], 2: [("RESULTS OF THE WORK", "Head", 300.0), ("A finding that is long enough to be", "Head-Bold", 300.0), ("wrapped here", "Head-Ital", 120.0)], 4: [("Another finding", "Head-Bold", 300.0)], 5: [("Methods", "Head", 300.0)]}


def test_roles(spark):
    got = R.font_roles(spark.createDataFrame(paper(HEADS), LINE)).groupBy("font").agg(F.collect_set("role").alias("r"), F.max("leading").alias("l")).collect()
    assert {r.font: r.r for r in got} == {"Run": ["running"], "Num": ["pagenum"], "Body": ["prose"], "Head": ["head"], "Head-Bold": ["head"], "Head-Ital": ["head"]}
    assert {r.l for r in got} == {12.0}


def test_blocks_and_sections(spark):
    lines = spark.createDataFrame(paper(HEADS), LINE)
    blocks = R.in_body(R.heading_blocks(R.font_roles(lines))).orderBy("block").collect()
    assert [(b.title, b.level, b.part) for b in blocks] == [
        ("Introduction to all of it", 2, "front"), ("RESULTS OF THE WORK", 1, "body"), ("A finding that is long enough to be wrapped here", 2, "body"), ("Another finding", 2, "body"), ("Methods", 2, "excluded"),
    ]
    got = R.sectionize(lines).orderBy("section").collect()
    assert [(r.section, r.title, r.parent, r.first_page, r.last_page, r.pdf_first, r.pdf_last, r.fallback) for r in got] == [
        (1, "A finding that is long enough to be wrapped here", "RESULTS OF THE WORK", 102, 103, 2, 3, False), (2, "Another finding", "RESULTS OF THE WORK", 104, 104, 4, 4, False),
    ]
    # 40 lines of prose in the first, 20 in the second, nothing of headings, running heads or numbers
    assert [r.body.count("running prose") for r in got] == [40, 20] and not any("Journal" in r.body or "wrapped" in r.body for r in got)


def test_pages_in_place_of_headings(spark):
    got = R.sectionize(spark.createDataFrame(paper({}), LINE)).orderBy("section").collect()
    assert [(r.pdf_first, r.pdf_last, r.first_page, r.fallback) for r in got] == [(1, 2, 1, True), (2, 3, 2, True), (3, 4, 3, True), (4, 5, 4, True), (5, 6, 5, True), (6, 6, 6, True)]
    assert [r.body.count("running prose") for r in got] == [21, 20, 20, 20, 20, 19]


def test_stubs_flow_on(spark):
    """A section of nine lines (under 900 characters) goes to the front of the next, its title is kept; ids are told apart."""
    rows, n = [], 0
    for title, count in (("INTRODUCTION", 20), ("A short part of it", 9), ("Another longer part", 20), ("Another longer part!", 20)):
        for text, font, size in [(title, "H", 14.0)] + [(PROSE + ".", "Body", 10.0)] * count:
            rows.append((1, 1, n, text, font, size, 50.0, 130.0 + 5 * n, 300.0, 134.0 + 5 * n, 2000.0))
            n += 1
    got = R.sectionize(spark.createDataFrame(rows, LINE)).orderBy("section").collect()
    assert [(r.id, r.merged, r.body.count("running prose")) for r in got] == [("another-longer-part", ["A short part of it"], 29), ("another-longer-part-2", [], 20)]


def test_odd_lines(spark):
    assert R.sectionize(spark.createDataFrame([], LINE)).count() == 0
    odd = [(1, 1, 0, None, None, None, None, None, None, None, None), (1, 1, 1, "", "F", 9.0, 0.0, 0.0, 0.0, 0.0, 800.0), (2, None, 0, "alone", "F", 9.0, 0.0, 300.0, 9.0, 310.0, 800.0)]
    rows = spark.createDataFrame(odd, LINE).withColumn("ROLE", F.lit("x"))
    assert {(r.doc_id, r.pos): r.role for r in R.font_roles(rows).collect()} == {(1, 0): "symbol", (1, 1): "symbol", (2, 0): "head"}
    assert R.sectionize(rows).count() == 0


def test_keys_and_levels(spark):
    heads = ["1) Introduction", "2.1: Results", "II) Discussion.", "4 °C for long", "C. elegans", "1.5-fold", "2D cells", "(Results)", "Results", "引言", "ABC", "AB", "2.1 Results"]
    rows = spark.createDataFrame([(h,) for h in heads], "h string")
    assert [r[0] for r in rows.select(T.heading_key(F.col("h"))).collect()] == ["INTRODUCTION", "RESULTS", "DISCUSSION", "4 °C FOR LONG", "ELEGANS", "1.5-FOLD", "2D CELLS", "(RESULTS)", "RESULTS", "引言", "ABC", "AB", "RESULTS"]
    assert [r[0] for r in rows.select(C.level(F.col("h"))).collect()] == [1, 2, 1, 2, 2, 2, 2, 2, 1, 2, 1, 2, 2]
