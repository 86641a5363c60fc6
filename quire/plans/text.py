"""Queries of scalar text functions and segmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import sequence as S
from quire.plans.base import Plans, load

plans = Plans()

# The test texts are clean already: dirt is put in, in both engines, before cleaning.
_DIRTY = "replace(replace(replace(replace(text, ' the ', ' (Au et al., 2018) the '), 'fi', 'ﬁ'), ' de ', '-\n de—'), ' of ', ' −of­\u0001 “IL2”/ \n')"


def _sql_clean(c: str) -> str:
    """The cleaning chain for the oracle, from the same fixed values."""
    for a, b in (("ﬁ", "fi"), ("ﬂ", "fl"), ("’", "''"), ("‘", "''"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "--"), ("´", "''"), ("́", "")):
        c = f"replace({c}, '{a}', '{b}')"
    c = rf"regexp_replace(regexp_replace({c}, '-\s*\n\s*', '', 'g'), '/\s*\n\s*', '/', 'g')"
    c = f"regexp_replace({c}, '{T.CITATION}', '', 'g')"
    c = rf"regexp_replace({c}, '[\x00-\x08\x0b-\x1f\x7f-\x{{9f}}]', ' ', 'g')"
    c = f"replace(replace({c}, '­', ''), '−', '-')"
    c = rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"
    for a, b in T.GREEK:
        c = f"replace({c}, '{a}', '{b}')"
    return c


def _sql_sentences(c: str) -> str:
    mark = "chr(1)"
    abbreviations = "|".join(T.ABBREVIATIONS)
    c = rf"regexp_replace({c}, '([.!?]+)(\s+|$)', '\1\2' || {mark}, 'g')"
    for _ in range(2):
        c = rf"regexp_replace({c}, '(?i)(^|[\s(\x01])((?:{abbreviations})\.\s*)\x01', '\1\2', 'g')"
    for _ in range(2):
        c = rf"regexp_replace({c}, '(^|[\s\x01])([A-Z]\.\s*)\x01', '\1\2', 'g')"
    return f"list_filter(string_split({c}, {mark}), lambda x: length(x) > 0)"


@plans.add("txt_01_clean", f"SELECT doc_id, {_sql_clean(_DIRTY)} AS cleaned FROM documents")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", T.clean(F.expr(_DIRTY.replace("\\", "\\\\"))).alias("cleaned"))


@plans.add("txt_04_heal", r"SELECT doc_id, length(regexp_replace(regexp_replace(replace(replace(text, ' a', '- " + "\n" + r" a'), ' b', '/ " + "\n" + r"b'), '-\s*\n\s*', '', 'g'), '/\s*\n\s*', '/', 'g')) AS n FROM documents")
def _(spark, d):
    dirty = F.replace(F.replace("text", F.lit(" a"), F.lit("- \n a")), F.lit(" b"), F.lit("/ \nb"))
    return load(spark, d, "documents").select("doc_id", F.length(T.heal_lines(dirty)).cast("long").alias("n"))


@plans.add("txt_11_greek", "SELECT page_id, replace(replace(replace(url || ' CD3e IFN-g', 'CD3e', 'CD3ε'), 'IFN-g', 'IFN-γ'), 'IL2', 'IL-2') AS t FROM pages")
def _(spark, d):
    return load(spark, d, "pages").select("page_id", T.greek(F.concat("url", F.lit(" CD3e IFN-g"))).alias("t"))


@plans.add("txt_12_join_lines", f"SELECT doc_id, {_sql_clean('array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> chr(39) || chr(39)), chr(10))'.replace('chr(39) || chr(39)', chr(39) * 2))} AS body FROM documents")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", T.joined(F.split("text", "\n")).alias("body"))


@plans.add("txt_13_label", r"SELECT conv_id, turn, regexp_replace('Abstract: ' || text, '(?i)^(abstract|summary)\s*[:：]\s*', '') AS body FROM conversations")
def _(spark, d):
    return load(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace(F.concat(F.lit("Abstract: "), "text"), r"(?i)^(abstract|summary)\s*[:：]\s*", "").alias("body"))


@plans.add("txt_14_title", r"SELECT conv_id, turn, nullif(substr(trim(regexp_replace(text, '[\x00-\x20\x7f]+', ' ', 'g')), 1, 300), '') AS title FROM conversations")
def _(spark, d):
    return load(spark, d, "conversations").select("conv_id", "turn", T.title_of(F.col("text")).alias("title"))


@plans.add("txt_15_note", "SELECT doc_id, left(concat_ws(chr(10), nullif(left(text, 120), ''), nullif(left(source, 400), ''), nullif(left(lang, 300), '')), 900) AS note FROM documents")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", T.note(F.col("text"), F.col("source"), F.col("lang")).alias("note"))


@plans.add("txt_20_sentences", f"SELECT doc_id, unnest(range(len(s))) AS pos, unnest(s) AS sentence FROM (SELECT doc_id, {_sql_sentences('text')} AS s FROM documents)")
def _(spark, d):
    found = load(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    return found.withColumn("pos", F.col("pos").cast("long"))


_SAFE = r"""list_filter(string_split(array_to_string(list_transform(string_split(regexp_replace(text, '([.!?]["'')\]]?\s+)([A-Z0-9(])', '\1' || chr(1) || '\2', 'g'), chr(1)),
  lambda p: p || CASE WHEN regexp_matches(regexp_replace(p, '\s*["'')\]]*\s*[.!?]["'')\]]*\s*$', ''), '[,;]\s*(19|20)[0-9]{2}$')
    OR regexp_matches(replace(lower(regexp_extract(regexp_replace(p, '\s*["'')\]]*\s*[.!?]["'')\]]*\s*$', ''), '([A-Za-z0-9.]+)$', 1)), '.', ''), '^([a-z]|%s|)$') THEN '' ELSE chr(1) END), ''), chr(1)),
  lambda x: regexp_replace(x, '\s+', '', 'g') <> '')""" % "|".join(T.SHORT_WORDS)


@plans.add("txt_21_safe_sentences", f"SELECT doc_id, unnest(range(len(s))) AS pos, unnest(s) AS sentence FROM (SELECT doc_id, CASE WHEN len(f) > 0 THEN f ELSE [text] END AS s FROM (SELECT doc_id, text, {_SAFE} AS f FROM documents))")
def _(spark, d):
    found = load(spark, d, "documents").select("doc_id", F.posexplode(T.safe_sentences(F.col("text"))).alias("pos", "sentence"))
    return found.withColumn("pos", F.col("pos").cast("long"))


@plans.add("txt_22_chunks")
def _(spark, d):
    found = load(spark, d, "documents").select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("pos", "chunk"))
    return found.select("doc_id", "pos", F.length("chunk").alias("chars"))


@plans.add("txt_24_variants", r"SELECT p_partkey, array_to_string(list_filter(list_transform(string_split_regex(p_name || ' / ' || p_brand, '\s*/\s*'), lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g')), lambda x: x <> ''), '|') AS v FROM part")
def _(spark, d):
    return load(spark, d, "part").select("p_partkey", F.array_join(T.variants(F.concat("p_name", F.lit(" / "), "p_brand")), "|").alias("v"))


@plans.add("txt_25_lines", "SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def _(spark, d):
    return S.lines(load(spark, d, "documents")).withColumn("pos", F.col("pos").cast("long"))


@plans.add("txt_30_heading_key", r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(upper(trim(regexp_replace('2.1 ' || url || ' .', '\s+', ' ', 'g'))), '^\d+(\.\d+)*\.?\s+', ''), '^[IVX]+\.\s+', ''), '[.:]+$', '') AS k FROM pages")
def _(spark, d):
    return load(spark, d, "pages").select("page_id", T.heading_key(F.concat(F.lit("2.1 "), "url", F.lit(" ."))).alias("k"))


@plans.add("txt_32_locator_key", r"SELECT doc_id, trim(regexp_replace(replace(replace(replace(replace(replace(lower(text), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '[^a-z0-9\-+/ ]', '', 'g')) AS k FROM documents")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", T.locator_key(F.col("text")).alias("k"))


@plans.add("txt_34_loose_fold", f"SELECT page_id, lower(translate(trim(regexp_replace(url || ' FcRγ αCD22', '\\s+', ' ', 'g')), '{T.LOOSE_FROM}', '{T.LOOSE_TO}')) AS k FROM pages")
def _(spark, d):
    return load(spark, d, "pages").select("page_id", T.loose_fold(F.concat("url", F.lit(" FcRγ αCD22"))).alias("k"))


@plans.add("txt_35_identity_key", "SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS k FROM documents")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", T.identity_key(F.col("text")).alias("k"))


@plans.add("txt_36_phrase_key", r"SELECT doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS k FROM documents")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", T.phrase_key(F.col("text")).alias("k"))


@plans.add("txt_37_flat", r"SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM conversations")
def _(spark, d):
    return load(spark, d, "conversations").select("conv_id", "turn", T.squeezed(F.col("text")).alias("flat"))


@plans.add("txt_38_slug", "SELECT page_id, coalesce(nullif(trim(left(trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-'), 48), '-'), ''), 'sec') AS slug FROM pages")
def _(spark, d):
    return load(spark, d, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


@plans.add("txt_39_template", r"SELECT page_id, regexp_replace(url, '\d+', '#', 'g') AS t FROM pages")
def _(spark, d):
    return load(spark, d, "pages").select("page_id", T.template(F.col("url")).alias("t"))


@plans.add("txt_40_level", r"SELECT o_orderkey, CASE WHEN n = '' THEN 0 WHEN contains(n, '.') THEN 2 ELSE 1 END AS level FROM (SELECT o_orderkey, regexp_extract(h, '^(\d+(?:\.\d+)*)\.?\s+[A-Za-z]', 1) AS n FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '2 Methods' WHEN 1 THEN '2.1 Results' WHEN 2 THEN '2D cultures' ELSE o_orderpriority END AS h FROM orders))")
def _(spark, d):
    k = F.col("o_orderkey") % 4
    h = F.when(k == 0, "2 Methods").when(k == 1, "2.1 Results").when(k == 2, "2D cultures").otherwise(F.col("o_orderpriority"))
    return load(spark, d, "orders").select("o_orderkey", T.number_level(h).alias("level"))


@plans.add("txt_42_family", "SELECT a.p_partkey, starts_with(x, y) OR starts_with(y, x) AS same FROM (SELECT p_partkey, lower(split_part(p_type, ' ', 1)) AS x, lower(split_part(p_name, ' ', 1)) AS y FROM part) a")
def _(spark, d):
    x, y = F.lower(F.substring_index("p_type", " ", 1)), F.lower(F.substring_index("p_name", " ", 1))
    return load(spark, d, "part").select("p_partkey", (F.startswith(x, y) | F.startswith(y, x)).alias("same"))


@plans.add("txt_44_plausible", r"SELECT doc_id, count(*) FILTER (length(trim(line)) >= 12 AND len(regexp_extract_all(line, '[A-Za-z]{3,}')) >= 2) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id")
def _(spark, d):
    return S.lines(load(spark, d, "documents")).groupBy("doc_id").agg(F.count_if(T.plausible_line(F.col("line"))).alias("n"))


@plans.add("txt_45_junk_title", r"SELECT page_id, length(t) < 8 OR lower(t) LIKE '%.pdf' OR regexp_matches(t, '^[\d\W_]+$') OR lower(t) IN ('untitled', 'title', 'document', 'no title') OR len(regexp_extract_all(t, '[A-Za-z]{2,}')) < 2 AS junk FROM (SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS t FROM pages)")
def _(spark, d):
    t = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return load(spark, d, "pages").select("page_id", T.junk_title(t).alias("junk"))


@plans.add("txt_47_refused", "SELECT conv_id, turn, contains(t, '无法确定') OR contains(t, '不完整') OR contains(t, '截断') OR contains(t, '片段') OR contains(t, '不是一个完整的') OR contains(t, '不是完整的') AS refused FROM (SELECT conv_id, turn, concat_ws(' ', text, CASE turn % 4 WHEN 0 THEN '无法确定' WHEN 1 THEN '抱歉' WHEN 2 THEN '这是片段' ELSE role END) AS t FROM conversations)")
def _(spark, d):
    k = F.col("turn") % 4
    other = F.when(k == 0, "无法确定").when(k == 1, "抱歉").when(k == 2, "这是片段").otherwise(F.col("role"))
    return load(spark, d, "conversations").select("conv_id", "turn", T.refused(F.col("text"), other).alias("refused"))


@plans.add("txt_48_chat_url", r"SELECT page_id, CASE WHEN b = '' THEN '' WHEN b LIKE '%/chat/completions' THEN b WHEN regexp_matches(b, '/v\d+[a-z]*$') THEN b || '/chat/completions' ELSE b || '/v1/chat/completions' END AS url FROM (SELECT page_id, regexp_replace(trim(CASE page_id % 4 WHEN 0 THEN ' / ' WHEN 1 THEN url || '/v4/' WHEN 2 THEN url || '/chat/completions' ELSE url END), '/+$', '') AS b FROM pages)")
def _(spark, d):
    k = F.col("page_id") % 4
    base = F.when(k == 0, " / ").when(k == 1, F.concat("url", F.lit("/v4/"))).when(k == 2, F.concat("url", F.lit("/chat/completions"))).otherwise(F.col("url"))
    return load(spark, d, "pages").select("page_id", T.chat_url(base).alias("url"))


@plans.add("txt_49_masked", "SELECT c_custkey, CASE WHEN length(c_name) > 14 THEN left(c_name, 7) || '…' || right(c_name, 4) ELSE '…' END AS m FROM customer")
def _(spark, d):
    return load(spark, d, "customer").select("c_custkey", T.masked(F.col("c_name")).alias("m"))


@plans.add("txt_50_content_type", r"SELECT page_id, CASE lower(regexp_extract(u, '\.([A-Za-z0-9]+)$', 1)) WHEN 'pdf' THEN 'application/pdf' WHEN 'json' THEN 'application/json' WHEN 'html' THEN 'text/html' WHEN 'css' THEN 'text/css' WHEN 'js' THEN 'text/javascript' WHEN 'png' THEN 'image/png' ELSE 'application/octet-stream' END AS t FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u FROM pages)")
def _(spark, d):
    return load(spark, d, "pages").select("page_id", T.content_type(F.regexp_replace("url", "[?#].*$", "")).alias("t"))


@plans.add("txt_51_json", "SELECT event_id, props AS j FROM events")
def _(spark, d):
    kind = F.col("event_id") % 4
    reply = (
        F.when(kind == 0, F.col("props")).when(kind == 1, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\nDone.")))
        .when(kind == 2, F.concat(F.lit("It is {so} "), "props", F.lit(" as asked, not {\"b\": 1}."))).otherwise(F.concat(F.lit("It is "), "props", F.lit(" as asked.")))
    )
    return load(spark, d, "events").select("event_id", F.trim(T.extract_json(reply), F.lit("\n ")).alias("j"))


@plans.add("txt_53_source_ref", r"SELECT page_id, regexp_replace(url || ' p.' || CAST(page_id AS VARCHAR), '\s*p\.\s*\d+\s*$', '') AS title, url || ' p.' || CAST(page_id AS VARCHAR) AS ref FROM pages")
def _(spark, d):
    ref = T.source_ref(F.col("url"), F.col("page_id"))
    return load(spark, d, "pages").select("page_id", F.regexp_replace(ref, r"\s*p\.\s*\d+\s*$", "").alias("title"), ref.alias("ref"))


@plans.add("txt_54_safe_id", r"SELECT page_id, regexp_matches(u, '^[A-Za-z0-9][A-Za-z0-9._\-]*$') AND length(u) <= 120 AND NOT contains(u, '..') AS ok FROM (SELECT page_id, replace(regexp_replace(url, '^[a-z]+://', ''), '/', '.') AS u FROM pages)")
def _(spark, d):
    return load(spark, d, "pages").select("page_id", T.safe_id(F.translate(F.regexp_replace("url", "^[a-z]+://", ""), "/", ".")).alias("ok"))


@plans.add("txt_55_sha256", "SELECT doc_id, sha256(text) AS h FROM documents")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))


@plans.add("src_03_metadata", r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1) AS heading, coalesce(nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), ''), nullif(trim(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1)), ''), url) AS best FROM pages")
def _(spark, d):
    title, heading = F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.regexp_extract("html", "<h1[^>]*>([^<]*)</h1>", 1)
    best = F.coalesce(F.nullif(F.trim(title), F.lit("")), F.nullif(F.trim(heading), F.lit("")), F.col("url"))
    return load(spark, d, "pages").select("page_id", title.alias("title"), heading.alias("heading"), best.alias("best"))
