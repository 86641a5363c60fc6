"""Queries of the rules that make sections of bare lines. The test tables have no pages: lines of documents get fonts, sizes and boxes by their places, ten to a page; SQL builds the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import roles as R
from quire.operators import sequence as S
from quire.plans.base import Plans, load

plans = Plans()

_LINES = """l AS (SELECT doc_id, CAST(pos // 10 + 1 AS INTEGER) AS page, pos, CASE WHEN pos % 10 = 9 AND doc_id % 2 = 0 THEN CAST(pos // 10 + 1 AS VARCHAR) ELSE text END AS text,
CASE WHEN pos % 10 = 9 THEN 'foot' WHEN pos % 5 = 0 THEN 'head-bold' WHEN pos % 7 = 3 THEN 'note' ELSE 'body' END AS font, CASE WHEN pos % 5 = 0 THEN 12.0 WHEN pos % 7 = 3 THEN 8.0 ELSE 10.0 END AS size,
50.0 AS x0, CASE WHEN pos % 10 = 9 THEN 760.0 ELSE 40.0 + (pos % 10) * 12 END AS y0, 800.0 AS height, least(length(text), 60) * 5 + 50.0 AS x1
FROM (SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)))"""


def _lines(spark, d):
    n = F.col("pos")
    page = F.floor(n / 10).cast("int") + 1
    base = S.lines(load(spark, d, "documents"))
    y0 = F.when(n % 10 == 9, 760.0).otherwise(40.0 + (n % 10) * 12)
    return base.select(
        "doc_id", page.alias("page"), "pos", F.when((n % 10 == 9) & (F.col("doc_id") % 2 == 0), page.cast("string")).otherwise(F.col("line")).alias("text"),
        F.when(n % 10 == 9, "foot").when(n % 5 == 0, "head-bold").when(n % 7 == 3, "note").otherwise("body").alias("font"), F.when(n % 5 == 0, 12.0).when(n % 7 == 3, 8.0).otherwise(10.0).alias("size"),
        F.lit(50.0).alias("x0"), y0.alias("y0"), (50.0 + F.least(F.length("line"), F.lit(60)) * 5).alias("x1"), (y0 + 10).alias("y1"), F.lit(800.0).alias("height"),
    )


@plans.add("sec_01_roles", rf"""WITH {_LINES}, t AS (SELECT *, y0 + 10 AS y1, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM l),
n AS (SELECT *, regexp_full_match(t, '\d{{1,4}}') AND y0 > height * 0.93 AS num FROM t),
g AS (SELECT doc_id, font, size, sum(length(t)) AS c, min(pos) AS p FROM n WHERE NOT num GROUP BY ALL), b AS (SELECT doc_id, arg_max(font, (c, -p)) AS bf, arg_max(size, (c, -p)) AS bs FROM g GROUP BY doc_id),
f AS (SELECT doc_id, font, sum(length(t)) / count(*) AS cpl FROM n WHERE NOT num GROUP BY ALL), q AS (SELECT doc_id, max(page) AS pages FROM n GROUP BY doc_id),
m AS (SELECT doc_id, regexp_replace(t, '\d+', '#', 'g') AS mask, count(DISTINCT page) AS seen FROM n WHERE NOT num AND (y0 < 96 OR y0 > 680) AND length(t) BETWEEN 1 AND 220 GROUP BY ALL),
c AS (SELECT n.*, bf, bs, CASE WHEN num THEN 'pagenum' WHEN t = '' THEN 'symbol' WHEN (y0 < 96 OR y0 > 680) AND length(t) <= 220 AND seen >= greatest(3.0, 0.25 * least(pages, 25)) THEN 'running'
  WHEN cpl < 4 THEN CASE WHEN length(t) <= 3 THEN 'panel' ELSE 'symbol' END WHEN size < bs - 0.8 THEN 'small' WHEN length(t) <= 120 AND regexp_matches(t, '{T.JUNK_HEADING}') THEN 'junk' END AS clear
  FROM n LEFT JOIN f USING (doc_id, font) LEFT JOIN b USING (doc_id) JOIN q USING (doc_id) LEFT JOIN m ON m.doc_id = n.doc_id AND m.mask = regexp_replace(t, '\d+', '#', 'g')),
p AS (SELECT *, lag(page) OVER w AS pp, lag(y0) OVER w AS py0, lag(y1) OVER w AS py1, lag(font) OVER w AS pf, lag(size) OVER w AS ps FROM c WINDOW w AS (PARTITION BY doc_id, num ORDER BY pos)),
d AS (SELECT doc_id, list_sort(list(y0 - py0)) AS a, list_sort(list(greatest(0.0, y0 - py1))) AS w FROM p WHERE clear IS NULL AND font = bf AND size = bs AND pp = page GROUP BY doc_id),
e AS (SELECT doc_id, coalesce(nullif(a[len(a) // 2 + 1], 0), 11.0) AS ld0, coalesce(nullif(w[len(w) // 2 + 1], 0), 2.5) AS ws FROM d),
o AS (SELECT *, lead(page) OVER v AS np, lead(y0) OVER v AS ny, lead(x0) OVER v AS nx0, lead(x1) OVER v AS nx1, coalesce(ld0, 11.0) AS ld, coalesce(ws, 2.5) AS wh FROM p LEFT JOIN e USING (doc_id) WHERE clear IS NULL WINDOW v AS (PARTITION BY doc_id, font, size ORDER BY pos)),
k AS (SELECT doc_id, font, size, CASE WHEN avg(coalesce(np = page AND ny - y0 < ld * 1.45 AND least(x1, nx1) - greatest(x0, nx0) >= (x1 - x0) * 0.4 AND NOT regexp_matches(t, '[.!?:]$'), false)::INT) < 0.55
  AND avg((NOT coalesce(pp = page AND pf = font AND ps = size, false) OR y0 - py1 > wh + ld * 0.8 * 0.5)::INT) > 0.5 AND max(length(t)) >= 4 THEN 'head' ELSE 'prose' END AS kind FROM o GROUP BY ALL)
SELECT doc_id, coalesce(clear, kind) AS role, count(*) AS n FROM c LEFT JOIN k USING (doc_id, font, size) GROUP BY ALL""")
def _(spark, d):
    return R.font_roles(_lines(spark, d)).groupBy("doc_id", "role").agg(F.count(F.lit(1)).alias("n"))


@plans.add("sec_02_blocks")
def _(spark, d):
    return R.in_body(R.heading_blocks(R.font_roles(_lines(spark, d)))).select("doc_id", "block", "last", "level", "page", "part", "fake")


@plans.add("sec_06_sectionized")
def _(spark, d):
    return R.sectionize(_lines(spark, d)).drop("body")


@plans.add("sec_07_preferred", """SELECT conv_id AS doc_id, turn AS section, 'model' AS by, NULL AS reason FROM conversations WHERE conv_id % 3 > 0 AND role <> 'user'
UNION ALL SELECT conv_id, turn, 'rules', CASE WHEN conv_id % 2 = 0 THEN 'no answer' END FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations m WHERE m.conv_id = c.conv_id AND m.conv_id % 3 > 0 AND m.role <> 'user')""")
def _(spark, d):
    """A model has told the sections of two documents in three."""
    c = load(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("section"), "role")
    failed = c.where("doc_id % 2 = 0").select("doc_id", F.lit("no answer").alias("reason"))
    return R.preferred(c.where("doc_id % 3 > 0 and role <> 'user'").drop("role"), c.drop("role"), failed)
