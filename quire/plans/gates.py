"""Queries of the gate, of containers, and of titles by size: rows of the test tables stand for nodes, edges, cells, payloads and lines; SQL builds the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import vocab
from quire.operators import containers as K
from quire.operators import gate as G
from quire.operators import page as P
from quire.operators import sequence as S
from quire.plans.base import Plans, load

plans = Plans()

_NONE = "array<string>"


def _evidence(when):
    return F.when(when, F.array().cast(_NONE)).otherwise(F.array(F.lit("q")))


@plans.add("val_01_nodes", """WITH n AS (SELECT c_nationkey AS s, c_mktsegment || '/' || (c_custkey // 2) AS p, c_custkey // 2 AS id, c_mktsegment AS v, CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE c_name END AS short, ['mechanism', 'application', 'conclusion', 'other', NULL][c_custkey % 5 + 1] AS cluster, c_custkey % 3 = 0 AS bare FROM customer)
SELECT CAST(s AS VARCHAR) AS owner, 'error' AS severity, 'NODE_SHORT' AS rule, p AS detail FROM n WHERE short = ' ' UNION ALL SELECT CAST(s AS VARCHAR), 'error', 'NODE_CLUSTER', p FROM n WHERE cluster IS NULL
UNION ALL SELECT CAST(s AS VARCHAR), 'error', 'CLUSTER', concat_ws(' ', p, cluster) FROM n WHERE cluster IS NULL OR cluster = 'other' UNION ALL SELECT CAST(s AS VARCHAR), 'warning', 'NODE_EVIDENCE', p FROM n WHERE bare
UNION ALL SELECT CAST(s AS VARCHAR), 'error', 'NODE_ID', v || '|' || id FROM n GROUP BY s, v, id HAVING count(*) = 2""")
def _(spark, d):
    k = F.col("c_custkey")
    cluster = F.get(F.array(*[F.lit(c) for c in (*vocab.CLUSTERS, "other")]), (k % 5).cast("int"))
    return G.nodes(load(spark, d, "customer").select(
        F.col("c_nationkey").alias("section_id"), F.col("c_mktsegment").alias("view"), F.floor(k / 2).alias("id"), F.col("c_name").alias("label"), F.when(k % 7 == 0, " ").otherwise(F.col("c_name")).alias("short"), cluster.alias("cluster"), _evidence(k % 3 == 0).alias("evidence"),
    ))


@plans.add("val_01_edges", """WITH e AS (SELECT o_custkey % 50 AS s, o_orderpriority AS v, o_orderkey % 40 AS a, o_custkey % 40 AS b, CASE WHEN o_orderkey % 3 = 0 THEN 'odd' ELSE '促进' END AS rel, o_orderkey % 5 = 0 AS bad, o_orderpriority || '/' || (o_orderkey % 40) || '->' || (o_custkey % 40) AS p FROM orders)
SELECT CAST(s AS VARCHAR) AS owner, 'error' AS severity, 'REL' AS rule, p AS detail FROM e WHERE rel = 'odd' UNION ALL SELECT CAST(s AS VARCHAR), 'error', 'POLARITY', p FROM e WHERE bad UNION ALL SELECT CAST(s AS VARCHAR), 'error', 'EDGE_FROM', p FROM e WHERE a >= 30
UNION ALL SELECT CAST(s AS VARCHAR), 'error', 'EDGE_TO', p FROM e WHERE b >= 30 UNION ALL SELECT CAST(s AS VARCHAR), 'error', 'EDGE', v || '|' || a || '|' || b || '|' || rel FROM (SELECT s, v, a, b, rel, unnest(range(1, count(*))) FROM e GROUP BY s, v, a, b, rel)""")
def _(spark, d):
    o, k = load(spark, d, "orders"), F.col("o_orderkey")
    edges = o.select(
        (F.col("o_custkey") % 50).alias("section_id"), F.col("o_orderpriority").alias("view"), (k % 40).alias("from"), (F.col("o_custkey") % 40).alias("to"), F.when(k % 3 == 0, "odd").otherwise("促进").alias("rel"), F.lit("x").alias("label"),
        F.when(k % 5 != 0, "promote").alias("polarity"), F.lit("sentence").alias("origin"), F.array(F.lit("q")).alias("evidence"),
    )
    known = edges.select("section_id", "view").distinct().withColumn("id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(29).cast("long"))))
    return G.edges(edges, known)


@plans.add("val_02_leads", """WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS owner, doc_id % 6 AS n, regexp_replace(left(text, CAST(doc_id % 50 AS INTEGER)), '^\\s+|\\s+$', '', 'g') AS g, contains(left(text, CAST(doc_id % 50 AS INTEGER)), '"') AS q FROM documents WHERE text IS NOT NULL)
SELECT owner, 'error' AS severity, 'GIST_MISSING' AS rule, '' AS detail FROM l WHERE g = '' UNION ALL SELECT owner, 'error', 'GIST_SHORT', CAST(length(g) AS VARCHAR) FROM l WHERE length(g) BETWEEN 1 AND 29
UNION ALL SELECT owner, 'error', 'FOCUS_COUNT', CAST(n AS VARCHAR) FROM l WHERE n NOT BETWEEN 2 AND 4 UNION ALL SELECT owner, 'warning', 'STRAIGHT_QUOTE', 'gist' FROM l WHERE q UNION ALL SELECT owner, 'error', 'FOCUS_BLANK', '3' FROM l WHERE n IN (3, 4)""")
def _(spark, d):
    n = F.col("doc_id") % 6
    focus = F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: F.when(i == 3, " ").otherwise("p"))
    focus = F.when(n == 0, F.array().cast(_NONE)).otherwise(focus)
    docs = load(spark, d, "documents").where("text is not null")
    return G.lead(docs.select(F.col("doc_id").alias("section_id"), F.struct(F.left("text", (F.col("doc_id") % 50).cast("int")).alias("gist"), focus.alias("focus")).alias("lead")))


@plans.add("val_05_matrix", """WITH c AS (SELECT c_custkey % 20 AS s, CAST(c_nationkey AS VARCHAR) AS r, c_mktsegment AS col, ['same', 'up', 'na', NULL][c_custkey % 4 + 1] AS mark, c_custkey % 3 = 0 AS bare FROM customer), r AS (SELECT DISTINCT s, r FROM c), k AS (SELECT DISTINCT s, col FROM c WHERE col <> 'BUILDING')
SELECT CAST(r.s AS VARCHAR) AS owner, 'error' AS severity, 'CELL' AS rule, 'v/' || r.r || '/' || k.col AS detail FROM r JOIN k USING (s) WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.s = r.s AND c.r = r.r AND c.col = k.col)
UNION ALL SELECT CAST(s AS VARCHAR), 'error', 'MARK', 'v/' || r || '/' || col FROM c WHERE mark IS NULL AND col <> 'BUILDING' UNION ALL SELECT CAST(s AS VARCHAR), 'warning', 'CELL_EVIDENCE', 'v/' || r || '/' || col FROM c WHERE bare AND mark IS DISTINCT FROM 'na' AND col <> 'BUILDING'
UNION ALL SELECT CAST(s AS VARCHAR), 'error', 'CELL_COL', 'v/' || r || '/' || col FROM c WHERE col = 'BUILDING'""")
def _(spark, d):
    k = F.col("c_custkey")
    cells = load(spark, d, "customer").select(
        (k % 20).alias("section_id"), F.lit("v").alias("view"), F.col("c_nationkey").cast("string").alias("row"), F.col("c_mktsegment").alias("col"), F.get(F.array(*[F.lit(m) for m in ("same", "up", "na")]), (k % 4).cast("int")).alias("mark"), _evidence(k % 3 == 0).alias("evidence"),
    )
    named = lambda c: cells.select("section_id", "view", F.col(c).alias("id"), F.lit("x").alias("label"), F.lit(None).cast("string").alias("cluster")).distinct()
    return G.matrix(named("col").where("id <> 'BUILDING'").drop("cluster"), named("row"), cells)


@plans.add("val_06_tracks", """WITH t AS (SELECT o_custkey % 50 AS s, o_orderkey AS id, o_orderkey % 4 = 0 AS bare FROM orders), g AS (SELECT l_orderkey AS id, l_linenumber AS n, ['plain', 'itam', 'odd'][l_linenumber % 3 + 1] AS kind, l_discount AS len, l_linenumber % 2 = 0 AS bare FROM lineitem WHERE l_orderkey % 10 > 0)
SELECT CAST(s AS VARCHAR) AS owner, 'error' AS severity, 'SEGMENTS' AS rule, 'v/' || id AS detail FROM t WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT CAST(s AS VARCHAR), 'error', 'KIND', 'v/' || id || '/' || n FROM g JOIN t USING (id) WHERE kind = 'odd'
UNION ALL SELECT CAST(s AS VARCHAR), 'error', 'LENGTH', 'v/' || id || '/' || n FROM g JOIN t USING (id) WHERE len <= 0 UNION ALL SELECT CAST(s AS VARCHAR), 'warning', 'SEGMENT_EVIDENCE', 'v/' || id || '/' || n FROM g JOIN t USING (id) WHERE g.bare AND t.bare""")
def _(spark, d):
    o = load(spark, d, "orders").select((F.col("o_custkey") % 50).alias("section_id"), F.lit("v").alias("view"), F.col("o_orderkey").alias("id"), F.lit("x").alias("label"), F.lit(None).cast("string").alias("cluster"), _evidence(F.col("o_orderkey") % 4 == 0).alias("evidence"))
    n = F.col("l_linenumber")
    l = load(spark, d, "lineitem").where("l_orderkey % 10 > 0").select(
        F.col("l_orderkey").alias("track"), n.cast("string").alias("label"), F.get(F.array(F.lit("plain"), F.lit("itam"), F.lit("odd")), (n % 3).cast("int")).alias("kind"), F.col("l_discount").alias("len"), _evidence(n % 2 == 0).alias("evidence"),
    )
    return G.tracks(o, l.join(o.select("section_id", "view", F.col("id").alias("track")), "track"))


def _containers(spark, d):
    """A container for every document: two payloads, a manifest, one in some number of which is wrong."""
    n = F.col("doc_id")
    docs = load(spark, d, "documents").where("doc_id is not null and text is not null").dropDuplicates(["doc_id"]).select("doc_id", "text")
    files = docs.select(
        n.alias("owner"), F.concat(F.lit("/a/p"), n.cast("string"), F.lit(".x.pdf")).alias("path"), F.when(n % 17 == 0, 0).otherwise(3).alias("pages"), F.lit(5).alias("dests"),
        F.encode(F.concat(F.when(n % 19 == 0, "PK").otherwise("%PDF-1.7"), F.when(n % 23 == 0, "").otherwise(" Q.manifest ")), "UTF-8").alias("content"),
    )
    sha = F.when(n % 5 == 0, "00").otherwise(F.sha2(F.col("text").cast("binary"), 256))
    manifest = F.concat(
        F.lit('{"format": "'), F.when(n % 7 == 0, "R").otherwise("Q"), F.lit('", "version": '), F.when(n % 11 == 0, '"one"').otherwise("1"), F.when(n % 3 == 0, "").otherwise(F.concat(F.lit(', "pid": "i'), n.cast("string"), F.lit('"'))),
        F.lit(', "pdf": {"pages": '), F.when(n % 13 == 0, "4").otherwise("3"), F.lit('}, "payload": {"text": {"sha256": "'), sha, F.lit('"}}}'),
    )
    pay = docs.select(n.alias("owner"), F.explode(F.array(
        F.struct(F.lit("text").alias("name"), F.col("text").cast("binary").alias("content")), F.struct(F.when(n % 4 == 0, "spare").otherwise("graph").alias("name"), F.lit("g").cast("binary").alias("content")),
        F.struct(F.when(n % 29 == 0, "other").otherwise("Q.manifest").alias("name"), manifest.cast("binary").alias("content")),
    )).alias("p")).select("owner", "p.*")
    return files, pay


@plans.add("src_08_identified", """SELECT doc_id AS owner, CASE WHEN doc_id % 19 = 0 THEN 'magic' WHEN doc_id % 23 = 0 THEN 'marker' WHEN doc_id % 17 = 0 THEN 'pages' WHEN doc_id % 29 = 0 THEN 'manifest' WHEN doc_id % 7 = 0 THEN 'format' END AS reason, CASE WHEN doc_id % 29 > 0 AND doc_id % 11 > 0 THEN 1 END AS version,
CASE WHEN doc_id % 3 = 0 OR doc_id % 29 = 0 THEN 'p' ELSE 'i' END || doc_id AS pid, CASE WHEN doc_id % 17 = 0 THEN 0 ELSE 3 END AS pages, CAST(3 AS BIGINT) AS entries FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL""")
def _(spark, d):
    return K.identified(*_containers(spark, d), "Q.manifest", "Q")


@plans.add("val_11_verified", """WITH d AS (SELECT doc_id AS n, CAST(doc_id AS VARCHAR) AS owner FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
SELECT owner, 'error' AS severity, 'PAGES' AS rule, '' AS detail FROM d WHERE n % 17 = 0 UNION ALL SELECT owner, 'error', 'MISSING', 'graph' FROM d WHERE n % 4 = 0 UNION ALL SELECT owner, 'error', 'FORMAT', 'R' FROM d WHERE n % 7 = 0 AND n % 29 > 0
UNION ALL SELECT owner, 'error', 'VERSION', '' FROM d WHERE n % 11 = 0 AND n % 29 > 0 UNION ALL SELECT owner, 'error', 'MANIFEST_PAGES', CASE WHEN n % 13 = 0 THEN '4' ELSE '3' END FROM d WHERE n % 29 > 0 AND (n % 13 = 0) <> (n % 17 = 0) OR n % 29 > 0 AND n % 13 = 0 AND n % 17 = 0
UNION ALL SELECT owner, 'error', 'HASH', 'text' FROM d WHERE n % 5 = 0 AND n % 29 > 0 UNION ALL SELECT owner, 'error', 'DESTS', '5' FROM d WHERE n % 31 = 0""")
def _(spark, d):
    files, pay = _containers(spark, d)
    was = files.select("owner", F.lit(None).cast("int").alias("pages"), F.when(F.col("owner") % 31 == 0, 6).otherwise(5).alias("dests"))
    return K.verified(files, pay, "Q.manifest", "Q", ("text", "graph"), was)


@plans.add("ano_03_baseline", "SELECT doc_id AS owner, 3 AS pages, 5 AS dests, count(c.turn) FILTER (c.role = 'user') AS ours, count(c.turn) FILTER (c.role <> 'user') AS external FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) LEFT JOIN conversations c ON conv_id = doc_id GROUP BY doc_id")
def _(spark, d):
    files = load(spark, d, "documents").where("doc_id is not null").select(F.col("doc_id").alias("owner"), F.lit(3).alias("pages"), F.lit(5).alias("dests")).distinct()
    return K.baseline(files, load(spark, d, "conversations").select(F.col("conv_id").alias("owner"), F.col("role").alias("author")), "user")


@plans.add("udf_07_images", "SELECT page_id, 'data:image/' || CASE page_id % 3 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'webp' ELSE 'png' END || ';base64,' || to_base64(encode(url)) AS address FROM pages")
def _(spark, d):
    k = F.col("page_id") % 3
    p = load(spark, d, "pages")
    return p.select("page_id", K.image_url(F.col("url").cast("binary"), F.when(k == 0, "/a/b.JPG").when(k == 1, "c.webp").otherwise("d")).alias("address"))


@plans.add("top_07_titles")
def _(spark, d):
    """The first lines of a document are its title, in a larger size, two to three of them."""
    n = F.col("pos")
    base = S.lines(load(spark, d, "documents"))
    big = n < 2 + F.col("doc_id") % 2
    lines = base.select(
        "doc_id", (F.floor(n / 40) + 1).alias("page"), "pos", F.floor(n / 10).alias("block"), F.col("line").alias("text"), F.when(big, 18.0).otherwise(10.0).alias("size"), F.lit(60.0).alias("x0"), F.lit(500.0).alias("x1"), (60.0 + n % 40 * 18).alias("y0"), F.lit(800.0).alias("height"), F.lit(600.0).alias("width"),
    )
    return P.title_by_size(lines)
