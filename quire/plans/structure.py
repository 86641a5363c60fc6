"""Queries of composites: sections, repair, location, layout, graphs, jobs, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import adapter
from quire.functions import text as T
from quire.operators import layout as L
from quire.operators import locate as P
from quire.operators import repair as R
from quire.operators import sections as C
from quire.operators import sequence as S
from quire.operators import validate as V
from quire.plans.base import Plans, load
from quire.sources import files
from quire.streaming import jobs

plans = Plans()


def _paged(spark, d):
    """Documents' lines, ten to a page."""
    return S.lines(load(spark, d, "documents")).select("doc_id", (F.col("pos") / 10).cast("int").alias("page"), "pos", F.col("line").alias("text"))


@plans.add("sec_running_lines", r"WITH l AS (SELECT doc_id, unnest(range(len(x))) // 10 AS page, trim(unnest(x)) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)), p AS (SELECT doc_id, count(DISTINCT page) AS pages FROM l GROUP BY doc_id), s AS (SELECT doc_id, regexp_replace(t, '\d+', '#', 'g') AS mask, count(DISTINCT page) AS n FROM l WHERE length(t) BETWEEN 1 AND 220 GROUP BY 1, 2) SELECT doc_id, mask, n FROM s JOIN p USING (doc_id) WHERE n >= greatest(3.0, 0.25 * least(pages, 25))")
def _(spark, d):
    return C.running_lines(_paged(spark, d))


@plans.add("sec_04_sections")
def _(spark, d):
    """Conversations as documents: a user's whole turn is a numbered heading, what follows is its text."""
    c = load(spark, d, "conversations").withColumn("heading", F.col("role") == "user")
    lines = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.when(F.col("heading"), F.concat(F.lit("1 "), "text")).otherwise(F.col("text")).alias("text"), "heading")
    return C.sections(lines).select("doc_id", "section", "title", "level", "parent", "container", "chars")


@plans.add("win_17_page_sections")
def _(spark, d):
    rows = _paged(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "page", "text"))).alias("l"))
    cut = rows.select("doc_id", F.posexplode(C.page_sections(F.transform("l", lambda x: F.struct(x["page"].alias("page"), x["text"].alias("text"))))).alias("section", "lines"))
    return cut.select("doc_id", "section", F.size("lines").alias("n"))


@plans.add("jn_03_anchors", """WITH l AS (SELECT doc_id, unnest(range(len(x))) AS pos, lower(unnest(x)) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
k AS (SELECT doc_id, pos, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS k FROM l), a AS (SELECT doc_id, k AS a FROM k WHERE pos = 1 AND k <> ''),
s AS (SELECT doc_id, pos, CASE WHEN k = a THEN 60 WHEN starts_with(k, a) OR starts_with(a, k) THEN 40 ELSE 0 END + CASE WHEN pos // 10 = 0 THEN 20 WHEN pos // 10 = 1 THEN 8 ELSE 0 END + CASE WHEN length(k) <= 120 THEN 5 ELSE 0 END AS score FROM k JOIN a USING (doc_id) WHERE k <> '')
SELECT doc_id, doc_id AS anchor_id, CAST(arg_max(pos, (score, -pos)) AS BIGINT) AS pos, max(score) AS score FROM s WHERE score >= 45 GROUP BY doc_id""")
def _(spark, d):
    lines = _paged(spark, d)
    anchors = lines.where("pos = 1").select("doc_id", F.col("doc_id").alias("anchor_id"), F.col("text").alias("title"), F.col("page"))
    return C.best_lines(anchors, lines).withColumn("pos", F.col("pos").cast("long"))


@plans.add("jn_03_located", """WITH l AS (SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
k AS (SELECT doc_id, pos, trim(regexp_replace(lower(x), '\\s+', ' ', 'g')) AS k FROM l), f AS (SELECT * FROM k WHERE pos = 1 AND k <> ''),
a AS (SELECT doc_id, 0 AS n, substr(k, 1, 20) AS a, '' AS h FROM f UNION ALL SELECT doc_id, 1, '', '1. ' || k FROM f UNION ALL SELECT doc_id, 2, '1. ' || k, '' FROM f UNION ALL SELECT doc_id, 3, substr(k, 6, 30), substr(k, 1, 12) FROM f),
b AS (SELECT doc_id, n, trim(regexp_replace(CASE WHEN starts_with(trim(a), 'l') AND contains(a, '|') THEN trim(substr(a, strpos(a, '|') + 1)) ELSE trim(a) END, '(…|\\.\\.\\.).*$', '', 's')) AS a, trim(h) AS h FROM a),
s AS (SELECT doc_id, n, pos, CASE WHEN a = '' THEN 0 WHEN k = a THEN 120 WHEN starts_with(k, a) THEN 85 WHEN contains(k, a) THEN 60 WHEN length(k) >= 4 AND contains(a, k) THEN 40 ELSE 0 END
+ CASE WHEN h = '' THEN 0 WHEN k = h THEN 100 WHEN starts_with(k, h) THEN 70 WHEN contains(k, h) THEN 40 ELSE 0 END
+ CASE WHEN pos // 10 + 1 = 1 THEN 15 ELSE 0 END + CASE WHEN pos = 1 THEN 30 WHEN abs(pos - 1) <= 3 THEN 20 WHEN abs(pos - 1) <= 40 THEN 10 ELSE 0 END AS score FROM k JOIN b USING (doc_id))
SELECT doc_id, n AS anchor_id, CAST(arg_max(pos, (score, -pos)) AS BIGINT) AS pos, max(score) AS score FROM s WHERE score >= 45 GROUP BY doc_id, n""")
def _(spark, d):
    """Second lines as anchors that are cut, numbered, or cut on both sides with a title of their own."""
    lines = _paged(spark, d).withColumn("page", F.col("page") + 1)
    k, cut = T.structure_key(F.col("text")), lambda low, n: F.substring("k", low, n)
    made = F.array(*[F.struct(F.lit(n).alias("anchor_id"), a.alias("anchor"), t.alias("title")) for n, a, t in (
        (0, cut(1, 20), F.lit("")), (1, F.lit(""), F.concat(F.lit("1. "), "k")), (2, F.concat(F.lit("1. "), "k"), F.lit("")), (3, cut(6, 30), cut(1, 12)),
    )])
    second = lines.where("pos = 1").select("doc_id", "page", F.col("pos").alias("anchor_line"), k.alias("k")).where("k <> ''")
    anchors = second.select("doc_id", "page", "anchor_line", F.inline(made))
    return C.found_lines(anchors, lines.withColumn("role", F.lit("body"))).withColumn("pos", F.col("pos").cast("long"))


@plans.add("jn_04_phrases", """WITH t AS (SELECT page_id, unnest(range(len(x))) AS pos, unnest(x) AS w FROM (SELECT page_id, list_filter(string_split(trim(regexp_replace(lower(regexp_replace(html, '<[^>]*>', ' ', 'g')), '[^a-z]+', ' ', 'g')), ' '), lambda v: v <> '') AS x FROM pages)),
r AS (SELECT page_id, pos, w, lead(w) OVER (PARTITION BY page_id ORDER BY pos) AS v FROM t),
q AS (SELECT * FROM (VALUES (1, 'the', 'the'), (2, 'of', 'the'), (3, 'thing', 'the')) x(phrase_id, a, b)),
h AS (SELECT phrase_id, page_id, pos, row_number() OVER (PARTITION BY phrase_id, page_id ORDER BY pos) AS n FROM r JOIN q ON (w = a OR (length(a) > 4 AND starts_with(w, a)) OR (length(w) > 4 AND starts_with(a, w))) AND (v = b OR (length(v) > 4 AND starts_with(b, v))))
SELECT phrase_id, page_id AS page, pos FROM h WHERE n <= 3""")
def _(spark, d):
    words = F.filter(F.split(F.trim(F.regexp_replace(F.lower(F.regexp_replace("html", "<[^>]*>", " ")), "[^a-z]+", " ")), " "), lambda w: w != "")
    tokens = load(spark, d, "pages").select(F.col("page_id").alias("page"), F.posexplode(words).alias("pos", "token")).withColumn("pos", F.col("pos").cast("long"))
    phrases = spark.createDataFrame([(1, ["the", "the"]), (2, ["of", "the"]), (3, ["thing", "the"])], "phrase_id int, words array<string>")
    return P.find_runs(tokens, phrases)


@plans.add("win_11_hyphen_pairs")
def _(spark, d):
    words = F.transform(F.split("text", r"\s+"), lambda w, i: F.when(i % 5 < 2, F.concat(F.left(w, F.lit(3)), F.lit("-"))).otherwise(w))
    tokens = load(spark, d, "conversations").select("conv_id", "turn", F.posexplode(words).alias("pos", "token"))
    return S.hyphen_pairs(tokens, ["conv_id", "turn"], "token", "pos").select("conv_id", "turn", "pos", "merged")


@plans.add("win_16_rects", "SELECT user_id, min(x0) AS x0, max(x1) AS x1, count(*) AS n FROM (SELECT user_id, x0, x1, sum(b) OVER (PARTITION BY user_id ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT *, CASE WHEN coalesce(x0 - lag(x1) OVER (PARTITION BY user_id ORDER BY x0, x1) > 2.5, true) THEN 1 ELSE 0 END AS b FROM (SELECT DISTINCT user_id, round(value, 2) AS x0, round(value, 2) + 1 AS x1 FROM events))) GROUP BY user_id, i")
def _(spark, d):
    e = load(spark, d, "events").select("user_id", F.round("value", 2).alias("x0")).distinct().select("user_id", "x0", (F.col("x0") + 1).alias("x1"), F.lit(0.0).alias("y0"), F.lit(1.0).alias("y1"))
    out = P.joined_rects(e, ["user_id"])
    # how many went into each
    inside = e.select("user_id", F.col("x0").alias("p")).join(out.select("user_id", "x0", "x1"), "user_id").where("p between x0 and x1")
    return inside.groupBy("user_id", "x0", "x1").agg(F.count(F.lit(1)).alias("n"))


@plans.add("qf_01_repair")
def _(spark, d):
    """Benchmark passages misquoted in three ways against the documents that hold them."""
    from quire.operators.joins import contains_join

    docs, items = load(spark, d, "documents"), load(spark, d, "benchmark")
    found = contains_join(docs, items.select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote")))
    pairs = found.join(docs.select("doc_id", "text"), "doc_id").join(items.select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote")), "quote_id")
    kind = F.col("doc_id") % 3
    wrong = F.when(kind == 0, F.replace("quote", F.lit(" "), F.lit("  "))).when(kind == 1, F.upper("quote")).otherwise(F.concat("quote", F.lit(" and what was never said")))
    out = R.repaired(pairs.select("doc_id", "quote_id", wrong.alias("quote"), "text"), "quote", "text")
    return out.select("doc_id", "quote_id", "tier", F.contains("text", "repaired").alias("verbatim"))


@plans.add("qf_05_changed")
def _(spark, d):
    return plans.queries["qf_01_repair"](spark, d).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


def _nodes(spark, d):
    """Parts as concepts: a view for every brand and range of sizes."""
    view = F.concat("p_brand", F.lit("/"), F.floor(F.col("p_size") / 10).cast("string"))
    return load(spark, d, "part").select(view.alias("view"), F.col("p_partkey").alias("node"), L.node_text(F.col("p_name"), F.col("p_type")).alias("text"))


@plans.add("grf_02_tfidf", """WITH w AS (SELECT p_brand || '/' || (p_size // 10) AS view, p_partkey AS node, ' ' || unnest(string_split_regex(lower(p_name || ' ' || p_type), '\\s+')) || ' ' AS w FROM part),
g AS (SELECT view, node, substr(w, i, k) AS gram FROM (SELECT view, node, w, k, unnest(range(1, length(w) - k + 2)) AS i FROM w, (VALUES (2), (3), (4)) n(k) WHERE length(w) > k)),
t AS (SELECT view, node, gram, count(*) AS tf FROM g GROUP BY ALL), n AS (SELECT p_brand || '/' || (p_size // 10) AS view, count(*) AS n FROM part GROUP BY 1), f AS (SELECT view, gram, count(*) AS df FROM t GROUP BY ALL),
x AS (SELECT t.view, node, gram, tf * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS w FROM t JOIN f USING (view, gram) JOIN n ON n.view = t.view)
SELECT view, node, gram, round(w / sqrt(sum(w * w) OVER (PARTITION BY view, node)), 6) AS weight FROM x""")
def _(spark, d):
    return L.tfidf(_nodes(spark, d), "view", "node").withColumn("weight", F.round("weight", 6))


@plans.add("grf_04_text_similarity", r"""WITH p AS (SELECT p_brand || '/' || (p_size // 10) AS view, p_partkey AS node, coalesce(p_name, '') || ' ' || coalesce(p_type, '') AS text FROM part),
k AS (SELECT view, text, min(node) AS node, count(*) AS m FROM p GROUP BY ALL), w AS (SELECT view, node, m, ' ' || unnest(string_split_regex(lower(text), '\s+')) || ' ' AS w FROM k),
g AS (SELECT view, node, m, substr(w, i, k) AS gram FROM (SELECT view, node, m, w, k, unnest(range(1, length(w) - k + 2)) AS i FROM w, (VALUES (2), (3), (4)) n(k) WHERE length(w) > k)),
t AS (SELECT view, node, m, gram, count(*) AS tf FROM g GROUP BY ALL), n AS (SELECT view, count(*) AS n FROM p GROUP BY view), f AS (SELECT view, gram, sum(m) AS df FROM t GROUP BY ALL),
x AS (SELECT t.view, node, gram, tf * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS w FROM t JOIN f USING (view, gram) JOIN n ON n.view = t.view), u AS (SELECT view, node, gram, w / sqrt(sum(w * w) OVER (PARTITION BY view, node)) AS w FROM x)
SELECT a.view, a.node AS a, b.node AS b, round(sum(a.w * b.w), 6) AS cosine, false AS copy FROM u a JOIN u b ON a.view = b.view AND a.gram = b.gram AND a.node < b.node GROUP BY ALL
UNION ALL SELECT p.view, k.node, p.node, 1.0, true FROM p JOIN k USING (view, text) WHERE p.node <> k.node AND regexp_matches(text, '\S')""")
def _(spark, d):
    return L.text_similarity(_nodes(spark, d), "view", "node").withColumn("cosine", F.round("cosine", 6))


def _edges(spark, d):
    """Every order is a view: its parts and their suppliers (negative numbers) are the nodes."""
    return load(spark, d, "lineitem").select(F.col("l_orderkey").alias("view"), (-F.col("l_suppkey") - 1).alias("a"), F.col("l_partkey").alias("b"))


@plans.add("grf_05_topology", """WITH e AS (SELECT l_orderkey AS v, -l_suppkey - 1 AS a, l_partkey AS b FROM lineitem), u AS (SELECT v, a AS n, b AS m FROM e UNION SELECT v, b, a FROM e), k AS (SELECT v, n, count(*) AS k FROM u GROUP BY v, n),
c AS (SELECT x.v, x.n AS a, y.n AS b, count(*) AS c FROM u x JOIN u y ON x.v = y.v AND x.m = y.m AND x.n < y.n GROUP BY ALL), q AS (SELECT v, a, b, count(*) AS e FROM e GROUP BY ALL)
SELECT v AS view, a, b, round(least(1.0, coalesce(c, 0) / (x.k + y.k - coalesce(c, 0))::DOUBLE + 0.5 * coalesce(e, 0)), 6) AS topo FROM c FULL JOIN q USING (v, a, b) JOIN k x USING (v) JOIN k y USING (v) WHERE x.n = a AND y.n = b""")
def _(spark, d):
    return L.topology(_edges(spark, d), "view", "a", "b").withColumn("topo", F.round("topo", 6))


@plans.add("grf_07_layout")
def _(spark, d):
    """Distances are those of different texts; every node is drawn, copies apart as their texts are (cosine 1)."""
    nodes = _nodes(spark, d)
    each, kinds = L.classes(nodes, "view", "node")
    near = L.similarity(L.tfidf(kinds, "view", "node", members="members", rows="rows"), "view", "node")
    near = near.unionByName(each.where("worded AND view IS NOT NULL AND node = kind").select("view", F.col("kind").alias("a"), F.col("kind").alias("b"), F.lit(1.0).alias("cosine")))
    none = near.select("view", "a", "b", F.lit(0.0).alias("topo")).limit(0)
    return L.placed(each, L.distances(near, none, "view"), "view", "node", kind="kind")


@plans.add("grf_10_adjacency", "SELECT l_orderkey AS view, -l_suppkey - 1 AS a, l_partkey AS b FROM lineitem UNION SELECT l_orderkey, l_partkey, -l_suppkey - 1 FROM lineitem")
def _(spark, d):
    e = _edges(spark, d)
    return e.unionByName(e.select("view", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


@plans.add("val_03_cycles", "SELECT 'g' AS owner, unnest([3, 4, 5, 6]) AS node")
def _(spark, d):
    e = spark.createDataFrame([("g", 1, 2), ("g", 2, 3), ("g", 3, 4), ("g", 4, 5), ("g", 5, 3), ("g", 5, 6), ("h", 1, 2)], "owner string, a int, b int")
    return V.cycles(e, "owner", "a", "b")


@plans.add("val_03_table_cycles", """WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS owner, l_suppkey % 5 AS a, l_partkey % 5 AS b FROM lineitem),
r AS (SELECT owner, a, b FROM e UNION SELECT r.owner, r.a, e.b FROM r JOIN e ON e.owner = r.owner AND e.a = r.b)
SELECT DISTINCT x.owner, y.b AS node FROM r x JOIN r y ON y.owner = x.owner AND y.a = x.a WHERE x.a = x.b""")
def _(spark, d):
    """Every order is a graph of its lines: what a cycle leads to, its own nodes included."""
    e = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("owner"), (F.col("l_suppkey") % 5).alias("a"), (F.col("l_partkey") % 5).alias("b"))
    return V.cycles(e, "owner", "a", "b")


@plans.add("val_02_lead", "SELECT CAST(doc_id AS VARCHAR) AS owner, CASE WHEN length(text) < 100 THEN 'error' ELSE 'warning' END AS severity, CASE WHEN length(text) < 100 THEN 'GIST_SHORT' ELSE 'ASCII_QUOTE' END AS rule, CASE WHEN length(text) < 100 THEN CAST(length(text) AS VARCHAR) ELSE '' END AS detail FROM documents WHERE length(text) < 100 OR contains(text, '\"')")
def _(spark, d):
    docs = load(spark, d, "documents")
    short = V.broken(docs, "doc_id", F.length("text") < 100, "error", "GIST_SHORT", F.length("text"))
    return short.unionByName(V.broken(docs.where(F.length("text") >= 100), "doc_id", F.contains("text", F.lit('"')), "warning", "ASCII_QUOTE", F.lit("")))


@plans.add("val_06_domain", "SELECT CAST(l_orderkey AS VARCHAR) AS owner, 'error' AS severity, 'LENGTH' AS rule, CAST(l_linenumber AS VARCHAR) AS detail FROM lineitem WHERE l_discount <= 0 UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'error', 'KIND', l_linestatus FROM lineitem WHERE l_linestatus NOT IN ('O')")
def _(spark, d):
    l = load(spark, d, "lineitem")
    return V.broken(l, "l_orderkey", F.col("l_discount") <= 0, "error", "LENGTH", F.col("l_linenumber")).unionByName(V.enum(l, "l_orderkey", "l_linestatus", ["O"], "KIND"))


@plans.add("val_12_stale", "SELECT l.doc_id FROM labels l JOIN documents d USING (doc_id) WHERE NOT contains(d.text, 'the') OR l.quality = 0")
def _(spark, d):
    """Cached results that no longer hold against the current text."""
    j = load(spark, d, "labels").join(load(spark, d, "documents"), "doc_id")
    return j.where(~F.contains("text", F.lit("the")) | (F.col("quality") == 0)).select("doc_id")


@plans.add("src_13_caps", "SELECT source, doc_id FROM (SELECT source, doc_id, sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id) AS s FROM documents WHERE strlen(text) <= 20000) WHERE s <= 60000")
def _(spark, d):
    return files.within_caps(load(spark, d, "documents"), "source", "doc_id", F.octet_length("text"), 20_000, 60_000).select("source", "doc_id")


@plans.add("snk_03_versions", "SELECT doc_id, 0 AS version FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, CASE WHEN quality = 1 THEN 1 ELSE 0 END FROM labels")
def _(spark, d):
    base = load(spark, d, "labels").select("doc_id", "quality").withColumn("version", F.lit(0))
    new = base.where("quality = 1").drop("version")
    return files.versioned(base, new, ["doc_id"]).select("doc_id", "version")


@plans.add("str_01_states", "SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS state, round(least(100, greatest(0, max(value))), 4) AS progress, count(*) AS steps FROM events GROUP BY user_id")
def _(spark, d):
    e = load(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("kind"), "ts", "event_id", F.col("value").alias("pct"))
    return jobs.state(e, order=F.struct("ts", "event_id")).withColumn("progress", F.round("progress", 4))


@plans.add("ann_01_cached_calls", "SELECT doc_id, '{\"items\": [], \"chars\": ' || length(text) || '}' AS reply, doc_id IN (SELECT doc_id FROM labels) AS was_cached FROM documents")
def _(spark, d):
    """Only what the cache lacks is asked; the stub answers."""
    docs = load(spark, d, "documents").select("doc_id", F.col("text").alias("prompt"))
    had = load(spark, d, "labels").select("doc_id").distinct()
    cache = docs.join(had, "doc_id").select("doc_id", F.concat(F.lit('{"items": [], "chars": '), F.length("prompt").cast("string"), F.lit("}")).alias("reply"))
    found, _cache = adapter.cached(docs, cache, ["doc_id"], "reply", name="stub")
    return found.join(had.withColumn("had", F.lit(True)), "doc_id", "left").select("doc_id", "reply", F.coalesce("had", F.lit(False)).alias("was_cached"))


@plans.add("txt_31_structure_key", r"SELECT page_id, lower(trim(regexp_replace(url, '\s+', ' ', 'g'))) AS k FROM pages")
def _(spark, d):
    return load(spark, d, "pages").select("page_id", T.structure_key(F.col("url")).alias("k"))
