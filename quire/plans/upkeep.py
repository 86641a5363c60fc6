"""Queries of smaller projections, gates and upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire import vocab
from quire.functions import text as T
from quire.plans.base import Plans, load

plans = Plans()


@plans.add("snk_08_whitelist", "SELECT event_id FROM events WHERE event_type IN ('view', 'click') AND json_valid(props)")
def _(spark, d):
    """Overrides are taken for listed names only, and only if they parse."""
    e = load(spark, d, "events")
    return e.where(F.col("event_type").isin("view", "click") & F.try_parse_json("props").isNotNull()).select("event_id")


@plans.add("snk_06_highlights", "SELECT kind, count(*) AS seen, count(*) FILTER (ok) AS wrote FROM (SELECT 'items' AS kind, l_quantity > 0 AND l_tax > 0 AS ok FROM lineitem UNION ALL SELECT 'marks', o_totalprice > 1000 FROM orders) GROUP BY kind")
def _(spark, d):
    """Two differently keyed inputs, one sink: what was written and what was skipped."""
    items = load(spark, d, "lineitem").select(F.lit("items").alias("kind"), ((F.col("l_quantity") > 0) & (F.col("l_tax") > 0)).alias("ok"))
    marks = load(spark, d, "orders").select(F.lit("marks").alias("kind"), (F.col("o_totalprice") > 1000).alias("ok"))
    return items.unionByName(marks).groupBy("kind").agg(F.count(F.lit(1)).alias("seen"), F.count_if("ok").alias("wrote"))


@plans.add("txt_46_near_edge", "SELECT l_orderkey, l_linenumber, l_quantity / 50 <= 0.12 OR l_quantity / 50 >= 0.85 AS edge FROM lineitem")
def _(spark, d):
    y = F.col("l_quantity") / 50
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ((y <= 0.12) | (y >= 0.85)).alias("edge"))


@plans.add("txt_52_defaults", "SELECT p_partkey, coalesce(nullif(p_type, ''), p_name) AS short, coalesce(nullif(p_brand, 'Brand#1'), 'mechanism') AS cluster FROM part")
def _(spark, d):
    return load(spark, d, "part").select(
        "p_partkey", F.coalesce(F.nullif("p_type", F.lit("")), "p_name").alias("short"), F.coalesce(F.nullif("p_brand", F.lit("Brand#1")), F.lit(vocab.CLUSTERS[0])).alias("cluster"),
    )


@plans.add("flt_09_subtree", "SELECT conv_id, turn FROM (SELECT *, last_value(CASE WHEN role = 'system' THEN 1 WHEN role = 'user' THEN 0 END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS inside FROM conversations) WHERE coalesce(inside, 0) = 0")
def _(spark, d):
    """A removed heading takes the deeper ones after it along, up to the next of its level."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    inside = F.last(F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 0), ignorenulls=True).over(w)
    return load(spark, d, "conversations").withColumn("inside", inside).where(F.coalesce("inside", F.lit(0)) == 0).select("conv_id", "turn")


@plans.add("flt_13_marks", "SELECT vec_id, len(list_filter(embedding, lambda x: x > 0)) AS n FROM embeddings WHERE len(list_filter(embedding, lambda x: x > 0)) > 30")
def _(spark, d):
    n = F.size(F.filter("embedding", lambda x: x > 0))
    return load(spark, d, "embeddings").select("vec_id", n.cast("long").alias("n")).where("n > 30")


@plans.add("ag_04_fragments", "SELECT source, round(avg(CASE WHEN regexp_matches(line, '^[a-z]') THEN 1.0 ELSE 0.0 END), 6) AS ratio FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY source")
def _(spark, d):
    lines = load(spark, d, "documents").select("source", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("source").agg(F.round(F.avg(F.when(F.col("line").rlike("^[a-z]"), 1.0).otherwise(0.0)), 6).alias("ratio"))


@plans.add("ag_12_view_sizes", "SELECT o_orderkey AS view, count(l_orderkey) AS nodes FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def _(spark, d):
    l = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("view")).agg(F.count(F.lit(1)).alias("nodes"))
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("view")).join(l, "view", "left").select("view", F.coalesce("nodes", F.lit(0)).alias("nodes"))


@plans.add("ag_17_digest", "SELECT lang, count(*) AS sections, sum(n_chars) AS chars, count(DISTINCT source) AS sources, max(n_chars) AS longest, count(*) FILTER (n_chars < 600) AS short FROM documents GROUP BY lang")
def _(spark, d):
    return load(spark, d, "documents").groupBy("lang").agg(
        F.count(F.lit(1)).alias("sections"), F.sum("n_chars").alias("chars"), F.countDistinct("source").alias("sources"), F.max("n_chars").alias("longest"), F.count_if(F.col("n_chars") < 600).alias("short"),
    )


@plans.add("ag_18_gate", "SELECT count(*) FILTER (n_chars >= 120) AS passed, count(*) FILTER (n_chars < 120) AS failed FROM documents")
def _(spark, d):
    ok = F.col("n_chars") >= 120
    return load(spark, d, "documents").agg(F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"))


@plans.add("jn_08_annotations", "SELECT c.conv_id, c.turn, d.source FROM conversations c JOIN documents d ON d.doc_id = c.conv_id")
def _(spark, d):
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("conv_id"), "source")
    return load(spark, d, "conversations").join(docs, "conv_id").select("conv_id", "turn", "source")


@plans.add("jn_09_titles", "SELECT c.conv_id, c.turn, coalesce(d.source, c.role) || ' p.' || CAST(c.turn AS VARCHAR) AS ref FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id AND d.lang = 'en'")
def _(spark, d):
    docs = load(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("conv_id"), "source")
    return load(spark, d, "conversations").join(docs, "conv_id", "left").select("conv_id", "turn", T.source_ref(F.coalesce("source", "role"), F.col("turn")).alias("ref"))


@plans.add("jn_12_sentence_lookup", "SELECT d.doc_id, min(c.doc_id) AS hit FROM (SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS k FROM documents) d JOIN (SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS k FROM documents JOIN labels USING (doc_id)) c ON c.k = d.k AND d.k <> '' GROUP BY d.doc_id")
def _(spark, d):
    """First cached text with the same identity key; an empty key never hits. Keys meet as hashes, grouped before the join."""
    docs = load(spark, d, "documents").select("doc_id", T.identity_key(F.col("text")).alias("k")).where("k <> ''").select("doc_id", F.sha2(F.col("k").cast("binary"), 256).alias("k"))
    known = docs.join(load(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi").groupBy("k").agg(F.min("doc_id").alias("hit"))
    return docs.join(known, "k").select("doc_id", "hit")


@plans.add("jn_24_override", "SELECT s.s_suppkey, coalesce(c.c_name, s.s_name) AS title FROM supplier s LEFT JOIN customer c ON c.c_custkey = s.s_suppkey AND c.c_acctbal > 0")
def _(spark, d):
    c = load(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("s_suppkey"), "c_name")
    return load(spark, d, "supplier").join(c, "s_suppkey", "left").select("s_suppkey", F.coalesce("c_name", "s_name").alias("title"))


@plans.add("top_02_page_order", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text), turn) AS place FROM conversations")
def _(spark, d):
    w = Window.partitionBy("conv_id").orderBy(F.length("text"), "turn")
    return load(spark, d, "conversations").select("conv_id", "turn", F.row_number().over(w).cast("long").alias("place"))


@plans.add("top_06_newest", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS newest FROM events GROUP BY user_id")
def _(spark, d):
    return load(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("newest"))


@plans.add("set_05_merged", "SELECT doc_id FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id FROM labels WHERE quality = 0")
def _(spark, d):
    return load(spark, d, "documents").where("lang = 'en'").select("doc_id").unionByName(load(spark, d, "labels").where("quality = 0").select("doc_id"))
