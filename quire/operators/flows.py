"""Flows that ask a model: what is cached isn't asked again, replies go through a gate, and what it turns down is asked again with the reasons.

Each round of questions is one pass over the rows that are still open. Its replies are settled (a checkpoint where the session has a folder for
them, else persisted) before anything looks at them, so no question is asked twice because a plan is read twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import adapter
from quire.functions import text as T
from quire.operators import validate as V

# Kinds of annotations; how often a chunk, and a section, is asked for; how many characters an annotation may have.
TYPES = ("术语", "搭配", "动词", "逻辑", "句式")
ANNOTATE_ATTEMPTS, EXTRACT_ATTEMPTS = 4, 3
SHORTEST, LONGEST = 3, 60
ITEMS = "items array<struct<text: string, type: string, zh: string, tip: string, quote: string>>"
VIEWS = "titleZh string, lead struct<gist: string, focus: array<string>>, views array<string>"


def settled(rows: DataFrame) -> DataFrame:
    return rows.checkpoint() if rows.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else rows.persist()


def stripped(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")


def gated(items: DataFrame, keys: list[str], source: str = "source", order: str = "pos") -> DataFrame:
    """items (text, type, source) with reason: ``form`` (length or type), ``not verbatim`` (not in the source, nor with white space squeezed), ``repeated``
    (as one before it of the same keys, whatever the case) or ``ok``. Nulls count as empty."""
    t = stripped(F.col("text"))
    form = F.length(t).between(SHORTEST, LONGEST) & stripped(F.col("type")).isin(*TYPES)
    inside = F.contains(F.col(source), t) | F.contains(T.squeezed(F.col(source)), T.squeezed(t))
    first = F.when(~form, "form").when(~F.coalesce(inside, F.lit(False)), "not verbatim").otherwise("ok")
    rank = F.row_number().over(Window.partitionBy(*keys, "_first", F.lower("text")).orderBy(order))
    out = items.withColumns({c: stripped(F.col(c)) for c in ("text", "type", "zh", "tip", "quote") if c in items.columns}).withColumn("_first", first)
    return out.withColumn("reason", F.when((F.col("_first") == "ok") & (rank > 1), "repeated").otherwise(F.col("_first"))).drop("_first")


def annotate(sections: DataFrame, client: str = "stub", head: str = "", attempts: int = ANNOTATE_ATTEMPTS, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """sections: section_id, title, first_page, last_page, text -> (items, report).

    Long texts are asked for chunk by chunk; a chunk of which nothing passes the gate is asked for again with the reasons, at most ``attempts`` times. Items of a
    section are merged in order, the first of equal ones stays. Sections that ``cache`` (items of an earlier run) has are taken from there. report: section_id, parts,
    n_items, n_repeated, failed (parts without items).
    """
    todo = sections if cache is None else sections.join(cache.select("section_id").distinct(), "section_id", "left_anti")
    chunk = T.chunks(F.col("text"))
    parts = todo.where("text is not null").select("section_id", "title", "first_page", "last_page", F.size(chunk).alias("parts"), F.posexplode(chunk).alias("part", "source"))
    several = F.when(F.col("parts") > 1, F.format_string(" (part %d of %d)", F.col("part") + 1, F.col("parts"))).otherwise("")
    prompt = F.concat(F.lit(head), F.lit("\n\n## "), F.coalesce("title", F.lit("")), several, F.format_string(", pages %s-%s\n\n", F.col("first_page").cast("string"), F.col("last_page").cast("string")), F.col("source"))
    left, found = settled(parts.withColumn("prompt", prompt)), None
    for attempt in range(1, attempts + 1):
        asked = settled(adapter.answered(left, "prompt", client, attempts=1))
        said = asked.select("section_id", "part", "source", F.posexplode(F.from_json(T.extract_json(F.col("reply")), ITEMS)["items"]).alias("pos", "i")).select("section_id", "part", "source", "pos", "i.*")
        judged = settled(gated(said, ["section_id", "part"]))
        good = judged.where("reason = 'ok'").drop("source", "reason")
        found = good if found is None else found.unionByName(good)
        if attempt == attempts:
            break
        why = judged.groupBy("section_id", "part").agg(F.count_if(F.col("reason") == "ok").alias("n"), *(F.count_if(F.col("reason") == r).alias(r) for r in ("form", "not verbatim", "repeated")))
        again = asked.join(why, ["section_id", "part"], "left").where(F.coalesce("n", F.lit(0)) == 0)
        reasons = F.concat_ws("; ", *(F.when(F.col(r) > 0, F.concat(F.lit(f"{r}: "), F.col(f"`{r}`").cast("string"))) for r in ("form", "not verbatim", "repeated")))
        # a call that failed is made again as it was
        more = F.when(F.col("reply").isNull(), "").otherwise(F.concat(F.lit("\n\nNothing of the last answer could be used. "), reasons, F.lit("\nCopy passages of the text as they are, and answer in JSON alone.")))
        left = settled(again.select(*[c for c in left.columns if c != "prompt"], F.concat("prompt", more).alias("prompt")))
        if left.isEmpty():
            break
    rank = F.row_number().over(Window.partitionBy("section_id", F.lower(T.squeezed(F.col("text")))).orderBy("part", "pos"))
    ranked = settled(found.withColumn("_rank", rank))
    items = ranked.where("_rank = 1").drop("_rank")
    counts = ranked.groupBy("section_id").agg(F.count_if(F.col("_rank") == 1).alias("n_items"), F.count_if(F.col("_rank") > 1).alias("n_repeated"), F.countDistinct("part").alias("_done"))
    report = parts.groupBy("section_id").agg(F.max("parts").alias("parts")).join(counts, "section_id", "left").select(
        "section_id", "parts", F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("n_repeated", F.lit(0)).alias("n_repeated"), (F.col("parts") - F.coalesce("_done", F.lit(0))).alias("failed"),
    )
    if cache is not None:
        items = items.unionByName(cache, allowMissingColumns=True)
    return items, report


def enriched(items: DataFrame, hits: DataFrame, sections: DataFrame, journal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(located items, lost items). hits: section_id, text, page, rects; the first hit of an item is its place. journal: page, journal_page; a page
    that isn't there has the section's first page. source_ref names the page of the document, never the journal's."""
    first = hits.groupBy("section_id", "text").agg(F.min_by(F.struct("page", "rects"), "page").alias("h"))
    at = items.join(first, ["section_id", "text"], "left")
    with_page = at.where("h is not null").withColumns({"page": F.col("h.page"), "rects": F.col("h.rects")}).drop("h")
    out = with_page.join(journal.select("page", "journal_page"), "page", "left").join(sections.select("section_id", "title", "first_page"), "section_id", "left")
    located = out.withColumn("journal_page", F.coalesce("journal_page", "first_page")).withColumn("source_ref", T.source_ref(F.col("title"), F.col("page"))).drop("title", "first_page")
    return located, at.where("h is null").drop("h")


def translate(requests: DataFrame, sentences: DataFrame, terms: DataFrame, client: str = "stub", head: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """requests: id, text, sentence; sentences: en, zh; terms: term, example, zh -> (answers, new sentences, new terms).

    A request is answered from the caches only if its sentence is there and its term is there for that very sentence (a term "A / B" stands for either, one without
    an example for none). Others are asked; answers by which the model says that the selection is no whole word or sentence are handed on and not cached.
    answers: id, sentence_zh, term_zh, cached, refused. Without a sentence the text is its own.
    """
    key = lambda c: F.nullif(T.identity_key(F.col(c)), F.lit(""))
    rows = requests.withColumn("sentence", F.coalesce("sentence", "text")).withColumns({"_s": key("sentence"), "_t": key("text")})
    known = sentences.select(key("en").alias("_s"), F.col("zh").alias("_szh")).where("_s is not null").groupBy("_s").agg(F.min("_szh").alias("_szh"))
    bound = terms.select(F.explode(T.variants(F.col("term"))).alias("_t"), T.identity_key(F.col("example")).alias("_s"), F.col("zh").alias("_tzh")).where("_s <> ''").groupBy("_t", "_s").agg(F.min("_tzh").alias("_tzh"))
    looked = rows.join(known, "_s", "left").join(bound, ["_s", "_t"], "left")
    hit = F.col("_szh").isNotNull() & F.col("_tzh").isNotNull()
    from_cache = looked.where(hit).select("id", F.col("_szh").alias("sentence_zh"), F.col("_tzh").alias("term_zh"), F.lit(True).alias("cached"), F.lit(False).alias("refused"))
    prompt = F.concat(F.lit(head), F.lit("\n\n## Selected\n"), "text", F.lit("\n\n## Sentence\n"), "sentence")
    asked = settled(adapter.answered(looked.where(~hit).withColumn("prompt", prompt), "prompt", client))
    got = F.from_json(T.extract_json(F.col("reply")), "sentenceZh string, termZh string, warn string")
    said = asked.withColumns({"sentence_zh": stripped(got["sentenceZh"]), "term_zh": stripped(got["termZh"]), "refused": T.refused(stripped(got["termZh"]), stripped(got["warn"]))})
    answers = from_cache.unionByName(said.select("id", "sentence_zh", "term_zh", F.lit(False).alias("cached"), "refused"))
    kept = said.where(~F.col("refused"))
    new_sentences = kept.where("sentence_zh <> '' and _szh is null").groupBy("_s").agg(F.min_by(F.struct(F.col("sentence").alias("en"), F.col("sentence_zh").alias("zh")), "id").alias("x")).select("x.*")
    new_terms = kept.where("term_zh <> '' and _tzh is null").groupBy("_s", "_t").agg(F.min_by(F.struct(F.col("text").alias("term"), F.col("sentence").alias("example"), F.col("term_zh").alias("zh")), "id").alias("x")).select("x.*")
    return answers, new_sentences, new_terms


def lead_problem(lead: Column) -> Column:
    """What is wrong with a section's lead, or null: a gist of 30 characters and 2 to 4 points are asked for; points beyond the fourth are cut before."""
    gist = F.length(stripped(lead["gist"]))
    return F.when(F.coalesce(gist, F.lit(0)) == 0, "lead is missing").when(gist < 30, "gist is too short").when(~F.coalesce(F.size(F.slice(lead["focus"], 1, 4)) >= 2, F.lit(False)), "focus needs 2 to 4 points")


def extract(sections: DataFrame, check: Callable[[DataFrame], DataFrame] | None = None, client: str = "stub", head: str = "", attempts: int = EXTRACT_ATTEMPTS) -> tuple[DataFrame, DataFrame]:
    """sections: section_id, title, text -> (accepted, failed).

    A section may have as many views as its length allows (``validate.budget``). A reply without views, or one that was cut off, halves that for the next
    attempt; a bad lead and the errors of ``check`` (replies -> owner, severity, rule, detail) go into the next prompt. accepted: section_id, title_zh, lead, views, attempt;
    failed: section_id, errors (of the last attempt, 25 at most).
    """
    budget_nodes, budget_views = V.budget(F.length("text"), F.size(T.sentences(F.col("text"))))
    base = sections.where("text is not null").withColumns({"nodes": budget_nodes, "n_views": budget_views, "errors": F.array().cast("array<string>")})
    left, accepted = settled(base), None
    for attempt in range(1, attempts + 1):
        scale = F.format_string("\n\nAt most %d views of at most %d nodes.\n\n", F.col("n_views").cast("int"), F.col("nodes").cast("int"))
        complaint = F.when(F.size("errors") > 0, F.concat(F.lit("\n\nThe last answer was turned down:\n- "), F.array_join("errors", "\n- "))).otherwise("")
        asked = settled(adapter.answered(left.withColumn("prompt", F.concat(F.lit(head), F.coalesce("title", F.lit("")), scale, F.col("text"), complaint)), "prompt", client, attempts=1))
        value = T.extract_json(F.col("reply"))
        got = asked.withColumn("_j", F.when(F.startswith(value, F.lit("{")), F.from_json(value, VIEWS))).withColumn("lead", F.col("_j.lead").withField("focus", F.slice("_j.lead.focus", 1, 4)))
        got = settled(got.withColumns({"views": F.col("_j.views"), "title_zh": stripped(F.col("_j.titleZh"))}).drop("_j"))
        empty = F.coalesce(F.size("views"), F.lit(0)) <= 0
        first = F.when(F.col("reply").isNull(), F.concat(F.lit("call failed: "), F.coalesce("error", F.lit("")))).when(value.isNull(), "no JSON in the answer").when(empty, "views are empty").otherwise(lead_problem(F.col("lead")))
        judged = got.withColumns({"_first": first, "_cut": value.isNull() | empty})
        if check:
            rank = F.row_number().over(Window.partitionBy("owner").orderBy("rule", "detail"))
            wrong = check(got.where(~empty)).where("severity = 'error'").withColumn("_r", rank).where("_r <= 25").groupBy("owner").agg(F.sort_array(F.collect_list(F.concat_ws(": ", "rule", "detail"))).alias("_checked"))
            judged = judged.join(wrong.withColumnRenamed("owner", "section_id"), "section_id", "left")
        else:
            judged = judged.withColumn("_checked", F.lit(None).cast("array<string>"))
        errors = F.when(F.col("_first").isNotNull(), F.array("_first")).otherwise(F.coalesce("_checked", F.array().cast("array<string>")))
        judged = settled(judged.withColumn("errors", errors))
        good = judged.where(F.size("errors") == 0).select("section_id", "title_zh", "lead", "views", F.lit(attempt).alias("attempt"))
        accepted = good if accepted is None else accepted.unionByName(good)
        fewer = F.when(F.col("_cut"), F.greatest(F.lit(1), F.floor(F.col("n_views") / 2).cast("int"))).otherwise(F.col("n_views").cast("int"))
        left = settled(judged.where(F.size("errors") > 0).select(*[c for c in base.columns if c not in ("n_views", "errors")], fewer.alias("n_views"), "errors"))
        if left.isEmpty():
            break
    return accepted, left.select("section_id", "errors")


def skeleton(sections: DataFrame) -> DataFrame:
    """What stands for a section that has no analysis: no views, no lead, and a flag that says so."""
    return sections.select("section_id", "title", "text", F.array().cast("array<string>").alias("views"), F.lit(None).cast("struct<gist: string, focus: array<string>>").alias("lead"), F.lit(True).alias("missing"))


def whole(sections: DataFrame, cache: DataFrame, stale: Column, check=None, client: str = "stub", head: str = "") -> tuple[DataFrame, DataFrame]:
    """All sections of a document: what the cache (section_id, title_zh, lead, views, attempt, text) has and is not stale is taken from there, others are extracted, and
    those that fail have their skeleton. Returns (one row per section with missing, failed)."""
    valid = cache.where(~F.coalesce(stale, F.lit(True))).select("section_id", "title_zh", "lead", "views", "attempt")
    todo = sections.join(valid.select("section_id"), "section_id", "left_anti")
    new, failed = extract(todo, check, client, head)
    have = valid.unionByName(new)
    out = sections.join(have, "section_id", "left")
    return out.withColumn("missing", F.col("views").isNull()).withColumn("views", F.coalesce("views", F.array().cast("array<string>"))), failed
