"""Hand-made cases of the operators that have no SQL, and edge cases of those that have."""

import duckdb
import numpy as np
import oracle
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire import vocab
from quire.functions import adapter
from quire.functions import text as T
from quire.operators import layout as L
from quire.operators import repair as R
from quire.operators import sections as C
from quire.operators import sequence as S
from quire.operators import validate as V
from quire.operators import joins as J
from quire.plans import registry
from quire.sources import files
from quire.streaming import jobs


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c")).alias("v")).first().v


@pytest.mark.parametrize("text, want", [
    ("See (Fig. 2b). Conversely, no.", ["See (Fig. 2b). ", "Conversely, no."]), ("CD19.28Z is 0.98 now. Yes", ["CD19.28Z is 0.98 now. ", "Yes"]), ("No. A. B. end.", ["No. A. B. end."]),
    ("", [""]), ("What?! Yes.", ["What?! ", "Yes."]), ("no end", ["no end"]),
])
def test_sentences(spark, text, want):
    assert one(spark, text, T.sentences) == want


@pytest.mark.parametrize("text, want", [
    ("phosphor-\n ylation BRS/\n PRS", "phosphorylation BRS/PRS"), ("a (Au et al., 2018) b", "a b"), ("\u0001x­y​z −5", "xy z -5"), ("ﬁne ﬂow — “q”", 'fine flow -- "q"'), ("IFN-g CD3e", "IFN-γ CD3ε"), (None, None),
])
def test_clean(spark, text, want):
    assert one(spark, text, T.clean) == want


def test_chunks_keep_the_text(spark):
    text = "".join(f"Sentence number {i} is here. " for i in range(520))
    found = one(spark, text, T.chunks)
    assert "".join(found) == text and 3 <= len(found) <= 4
    assert one(spark, "short.", T.chunks) == ["short."]


def test_stub_merge(spark):
    df = spark.createDataFrame([(["a" * 300, "b" * 500, "c" * 200, "d" * 1000, "e" * 100],)], "x array<string>")
    assert [len(s) for s in df.select(S.merged_stubs(F.col("x")).alias("v")).first().v] == [1002, 1000, 100]


def test_queries_of_the_matrix_see_smaller_ids(spark):
    from quire.plans import registry

    got = {(r.a, r.b): r.cosine for r in registry.queries()["grf_04_cosine_whole"](spark, "/root/testdata/sf0.001").collect()}
    assert any(b < a for a, b in got) and all(got[b, a] == c for (a, b), c in got.items() if b % 50 == 0)


def test_whole_turns_are_titles(spark):
    from quire.plans import registry

    sf = "/root/testdata/sf0.001"
    turns = {"1 " + r.text for r in spark.read.parquet(f"{sf}/conversations.parquet").where("role = 'user'").collect()}
    titles = {r.title for r in registry.queries()["sec_04_sections"](spark, sf).collect()}
    assert titles <= turns and max(map(len, titles)) > 62


def test_anchors_meet_every_line_of_their_document(spark):
    lines = spark.createDataFrame([("d", 1, 0, "x", "body"), ("d", 1, 1, "Results:", "body"), ("d", 2, 2, "1. Introduction", "head"), ("d", 2, 3, "Introduction", "body"), ("d", 2, 4, None, "body")], "doc_id string, page int, pos int, text string, role string")
    asked = spark.createDataFrame([("d", 1, "Results", 1)], "doc_id string, anchor_id int, title string, page int")
    assert [tuple(r) for r in C.best_lines(asked, lines.drop("role")).collect()] == [("d", 1, 1, 65)]


def test_found_lines(spark):
    lines = spark.createDataFrame([("d", 1, 0, "x", "body"), ("d", 1, 1, "Results:", "body"), ("d", 2, 2, "1. Introduction", "head"), ("d", 2, 3, "We show", "body"), ("d", 2, 4, None, "body")], "doc_id string, page int, pos int, text string, role string")
    anchors = [("d", 1, "introduction", "Introduction", 2, 40), ("d", 2, "L3| We show... that", None, 0, None), ("d", 3, None, "nothing", 2, 2), ("d", 4, "4 Results: what", "", 1, None), ("d", 5, "we show it", None, None, 3)]
    got = C.found_lines(spark.createDataFrame(anchors, "doc_id string, anchor_id int, anchor string, title string, page int, anchor_line int"), lines)
    assert {r.anchor_id: (r.pos, r.score) for r in got.collect()} == {1: (2, 60 + 40 + 25 + 15 + 10), 2: (3, 120), 3: (2, 25 + 15 + 30), 4: (1, 40 + 15), 5: (3, 40 + 30)}


def test_positions_with_gaps_copies_and_nulls(spark, tmp_path):
    import oracle
    from quire.plans import registry

    ids = [7, 9, 9, 30, 31, 1000, None, 2, 5_000_000_000]
    docs = spark.createDataFrame([(i, f"text {n}", str(n % 3)) for n, i in enumerate(ids)], "doc_id long, text string, lang string")
    got = S.positions(docs, "doc_id", 4).collect()
    assert sorted(r.up for r in got) == sorted(r.down for r in got) == list(range(1, 10))
    known = [r for r in sorted(got, key=lambda r: r.up) if r.doc_id is not None]
    assert [r.doc_id for r in known] == sorted(i for i in ids if i is not None) and all(r.up + r.down == 9 for r in known)
    docs.where("doc_id > 0").dropDuplicates(["doc_id"]).coalesce(1).toPandas().to_parquet(tmp_path / "documents.parquet")
    assert oracle.differences(registry.queries()["jn_19_by_position"](spark, str(tmp_path)), oracle.views(str(tmp_path)), registry.oracle_sql()["jn_19_by_position"]) == ""


def test_levels(spark):
    assert [one(spark, t, C.level) for t in ("1 Introduction", "2.1 Results", "2D cultures", "Results", "IMPORTANT")] == [1, 2, 2, 1, 1]


def test_sections(spark):
    body = "This sentence is repeated to be long enough. " * 4
    lines = [("Title", False), ("1 Introduction", True), (body, False), ("2 Results", True), ("2.1 First", True), (body, False), ("2.2 Short", True), ("x", False), ("References", True), (body, False)]
    df = spark.createDataFrame([("d", i, t, h) for i, (t, h) in enumerate(lines)], "doc_id string, pos int, text string, heading boolean")
    got = {r.title: (r.level, r.parent, r.container) for r in C.sections(df).collect()}
    assert got == {"1 Introduction": (1, None, False), "2 Results": (1, None, True), "2.1 First": (2, "2 Results", False)}


def test_line_number_column(spark):
    rows = [("d", 1, i, str(i), 10.0) for i in range(8)] + [("d", 1, 20 + i, "text of the page", 40.0) for i in range(8)] + [("d", 2, i, str(i * 50), 10.0) for i in range(8)] + [("d", 2, 30, "text", 40.0)]
    got = C.line_number_column(spark.createDataFrame(rows, "doc_id string, page int, pos int, text string, x0 double")).collect()
    assert {r.page for r in got} == {1} and len(got) == 8


SOURCE = "The receptor FcRγ binds strongly to the ligand, and “this” is a long sentence that goes on for quite some while until it ends here. Another one follows."


@pytest.mark.parametrize("quote, tier", [
    ("binds strongly to the ligand", "exact"), ('and "this" is a  long sentence', "folded"), ("receptor FcRV binds STRONGLY", "loose"), ("", "lost"), (None, "lost"), ("tiny!", "lost"),
    ("long sentence that goes on for quite some while until it ends, as nobody ever said", "run"), ("nothing of the kind was ever written anywhere", "lost"),
])
def test_repair(quote, tier):
    fixed, how = R.repair(quote, SOURCE)
    assert how == tier and (how == "lost" or fixed in SOURCE)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab γv“\"-–\n", min_size=0, max_size=80), st.text(alphabet="ab γv“\"-–\n", max_size=80))
def test_repair_is_verbatim_or_nothing(quote, source):
    fixed, how = R.repair(quote, source)
    assert fixed == quote if how == "lost" else fixed in source


def test_contains_join(spark):
    texts = spark.createDataFrame([(1, "a b c d e f g"), (2, "xa b c d e fx"), (3, None), (4, "short")], "doc_id int, text string")
    quotes = spark.createDataFrame([(1, "a b c d e f"), (2, "hort"), (3, ""), (4, None), (5, "c d")], "quote_id int, quote string")
    assert {tuple(r) for r in J.contains_join(texts, quotes).collect()} == {(1, 1), (2, 1), (4, 2), (1, 5), (2, 5)}


def test_a_long_chain_is_no_cycle(spark):
    e = spark.createDataFrame([("g", i, i + 1) for i in range(104)] + [("h", 1, 2), ("h", 2, 1)], "owner string, a int, b int")
    assert {tuple(r) for r in V.cycles(e, "owner", "a", "b").collect()} == {("h", 1), ("h", 2)}


def test_cycles_and_rules(spark):
    e = spark.createDataFrame([("g", "a", "b"), ("g", "b", "c"), ("g", "c", "a"), ("h", "a", "b")], "owner string, a string, b string")
    assert {tuple(r) for r in V.cycles(e, "owner", "a", "b").collect()} == {("g", "a"), ("g", "b"), ("g", "c")}
    nodes = spark.createDataFrame([("g", "a"), ("g", "b"), ("h", "a")], "owner string, id string")
    assert {(r.owner, r.detail) for r in V.dangling(e, nodes, "owner", "b", "id", "TO").collect()} == {("g", "c"), ("h", "b")}
    assert vocab.relations(spark).count() == 29


def test_layout():
    d = np.array([[0, 1, 1], [1, 0, 1], [1, 1, 0]], float)
    xy, stress = L.smacof(d)
    assert stress < 1e-6 and np.allclose(np.linalg.norm(xy[0] - xy[1]), 1, atol=1e-3)


def test_adapter_retries_alone(spark):
    calls = {"n": 0}

    def client(prompt, mood="calm"):
        if "bad" in prompt:
            raise ValueError("no")
        return prompt + mood

    adapter.register("mine", client)
    rows = spark.createDataFrame([(1, "good"), (2, "bad")], "id int, prompt string")
    got = {r.id: (r.reply, r.error) for r in adapter.answered(rows, name="mine", mood="!", unknown=3).collect()}
    assert got == {1: ("good!", None), 2: (None, "no")} and calls["n"] == 0


def test_sources(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s/a.json").write_text('{"id": "a", "title": "A", "level": 1}')
    (tmp_path / "a.txt").write_text("the text\nof a")
    assert files.sections(spark, str(tmp_path / "s"), str(tmp_path / "a.txt")).first().sourceText == "the text\nof a"
    (tmp_path / "up").mkdir()
    for name, content in (("ok.pdf", b"%PDF-1.7"), ("no.pdf", b"hello"), ("x.txt", b"%PDF-"), ("e.pdf", b"")):
        (tmp_path / "up" / name).write_bytes(content)
    assert {r.path.rsplit("/", 1)[1]: r.status for r in files.uploads(spark, str(tmp_path / "up")).collect()} == {"ok.pdf": "ok", "no.pdf": "magic", "x.txt": "extension"}
    out = str(tmp_path / "out")
    files.write_entities(spark.createDataFrame([("p", 1), ("q", 1)], "paper_id string, v int"), out, "paper_id")
    files.write_entities(spark.createDataFrame([("q", 2)], "paper_id string, v int"), out, "paper_id")
    assert {(r.paper_id, r.v) for r in spark.read.parquet(out).collect()} == {("p", 1), ("q", 2)}


def test_streams(spark, tmp_path):
    chunks = [("j", 1, "10 %\r2"), ("j", 2, "0 %\nsome ERROR\npart"), ("j", 3, "ial\n")]
    spark.createDataFrame(chunks, "job_id string, seq int, chunk string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("job_id string, seq int, chunk string").parquet(str(tmp_path / "in"))
    q = jobs.lines(stream).writeStream.format("memory").queryName("lines").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.line, r.pct) for r in spark.table("lines").collect()} == {("10 %", 10), ("20 %", 20), ("some ERROR", None)}
    rows = spark.readStream.schema("job_id string, seq int, chunk string").parquet(str(tmp_path / "in"))
    q = jobs.incremental(rows, str(tmp_path / "t"), str(tmp_path / "c2"), ["seq"], lambda b: b.select("seq", F.length("chunk").alias("n")))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "t/v0")).count() == 3


def test_headings_that_are_no_addresses(spark, tmp_path):
    heads = ["Results", "ask a.b@mail1.example.com now", "Table 2 | Cells", "HTTP://x.org", "http\u017f://x.org", "www.x.org", "see www.x.org", "Article", "Article\n", "Article\r", "", "h" * 120, "h" * 121, None]
    spark.createDataFrame([(i, None, None if h is None else f"<h1 class=a>{h}</h1>") for i, h in enumerate(heads)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name, kept in (("flt_02_junk_headings", {0, 1, 2, 6, 7, 8, 9, 10, 11}), ("flt_02_junk_headings_whole", {0, 6, 9, 10, 11})):
        frame = registry.queries()[name](spark, str(tmp_path))
        assert {r.page_id for r in frame.collect()} == kept
        assert oracle.differences(frame, con, registry.oracle_sql()[name]) == ""


def test_similarity_of_copies(spark):
    """Copies are named, not paired: the cosines are those of all pairs."""
    texts = ["red bolt", "red bolt", "Red Bolt", "blue bolt", "red bolt", "", "", " ", "ring", "blue bolt", None]
    nodes = spark.createDataFrame([("v", i, t) for i, t in enumerate(texts)] + [("w", i, "red bolt") for i in range(40)] + [(None, 1, "x"), (None, 2, "x")], "view string, node int, text string").select("view", "node", L.node_text(F.col("text")).alias("text"))
    every = {(r.view, r.a, r.b): round(r.cosine, 9) for r in L.similarity(L.tfidf(nodes, "view", "node"), "view", "node").collect()}
    got = L.text_similarity(nodes, "view", "node").collect()
    assert {(r.view, r.a, r.b) for r in got if r.copy} == {("v", 0, 1), ("v", 0, 4), ("v", 3, 9)} | {("w", 0, i) for i in range(1, 40)}
    first = {(v, n): n for v, k in (("v", len(texts)), ("w", 40)) for n in range(k)} | {(r.view, r.b): r.a for r in got if r.copy}
    pairs = {(r.view, r.a, r.b): round(r.cosine, 9) for r in got if not r.copy}
    assert set(pairs) == {("v", 0, 2), ("v", 0, 3), ("v", 2, 3), ("v", 0, 8), ("v", 2, 8)}
    for (v, a, b), c in every.items():
        x, y = sorted((first[v, a], first[v, b]))
        assert c == pytest.approx(1.0 if x == y else pairs[v, x, y], abs=1e-8)


def test_layout_of_classes(spark):
    """Every node is drawn, from distances of classes; the drawing is that of all pairs, and its starts are tasks."""
    kinds = [0, 1, 0, 2, 1, 0, 3]
    m = np.array([[0.45, 0.7, 0.8, 1.0], [0.7, 0.45, 0.9, 1.0], [0.8, 0.9, 0.45, 0.6], [1.0, 1.0, 0.6, 1.0]])
    d = m[np.ix_(kinds, kinds)] * (1 - np.eye(len(kinds)))
    nodes = spark.createDataFrame([("v", 10 + i, 100 + k) for i, k in enumerate(kinds)] + [("w", 1, 1), ("w", 2, 2)], "view string, node int, kind int")
    pairs = spark.createDataFrame([("v", 100 + a, 100 + b, float(m[a, b])) for a in range(4) for b in range(a, 4) if m[a, b] < 1], "view string, a int, b int, distance double")
    frame = L.placed(nodes, pairs, "view", "node", kind="kind")
    plain = spark.createDataFrame([("v", 10 + a, 10 + b, float(d[a, b])) for a in range(7) for b in range(a + 1, 7)], "view string, a int, b int, distance double")
    xy, _ = L.smacof(d)
    want = ((xy - xy.min(axis=0)) / (xy.max(axis=0) - xy.min(axis=0)) * [1500.0, 1000.0]).round(1)
    for f in (frame, L.placed(nodes, plain, "view", "node")):
        got = {(r.view, r.node): (r.x, r.y) for r in f.collect()}
        assert set(got) == {("v", 10 + i) for i in range(7)}
        assert np.allclose([got["v", 10 + i] for i in range(7)], want, atol=0.11)


def test_scaling_by_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    p, kind = rng.normal(size=(9, 3)), rng.integers(0, 9, 70)
    m, x = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2)) + 0.3, rng.normal(size=(70, 2))
    whole, stress = L.descended(m, kind, x)
    monkeypatch.setattr(L, "BLOCK", 500)
    for held in (3000, 10):
        monkeypatch.setattr(L, "HELD", held)
        xy, s = L.descended(m, kind, x)
        assert s == pytest.approx(stress, rel=1e-6) and np.allclose(xy, whole, atol=1e-4)


def test_scaling_looks_up_kinds(monkeypatch):
    """Many points of few kinds: what is wanted of them is looked up by kinds, not by pairs; rounds are those of the formula, also where points begin at one place."""
    class Counted(np.ndarray):
        looked = 0

        def __getitem__(self, at):
            got = super().__getitem__(at)
            Counted.looked += np.size(got)
            return np.asarray(got)

    rng, n, rounds = np.random.default_rng(4), 400, 4
    m = np.array([[0.45, 0.7, 0.8, 1.0], [0.7, 0.45, 0.9, 1.0], [0.8, 0.9, 0.45, 0.6], [1.0, 1.0, 0.6, 0.45]])
    kind, x = rng.integers(0, 4, n), rng.normal(size=(n, 2))
    x[7] = x[8] = x[9]
    monkeypatch.setattr(L, "BLOCK", 512)
    monkeypatch.setattr(L, "HELD", 10)
    xy, stress = L.descended(m.view(Counted), kind, x, rounds)
    assert Counted.looked < rounds * n * n / 4
    d = m[np.ix_(kind, kind)] * (1 - np.eye(n))
    for _ in range(rounds):
        r = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        t = np.divide(d, r, out=np.zeros_like(d), where=r > 1e-12)
        x, want = (t.sum(axis=1)[:, None] * x - t @ x) / n, ((r - d) ** 2).sum() / 2
    assert stress == pytest.approx(want, rel=1e-10) and np.allclose(xy, x, atol=1e-12)
