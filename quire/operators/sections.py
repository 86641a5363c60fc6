"""From ordered lines to sections: roles, headings, body, fallbacks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import text as T

# Fixed values
START = ("SUMMARY", "ABSTRACT", "INTRODUCTION")
BODY = ("RESULTS", "RESULTS AND DISCUSSION", "DISCUSSION", "CONCLUSION", "CONCLUSIONS", "SUMMARY AND CONCLUSIONS")
END = (
    "STAR+METHODS", "STAR METHODS", "EXPERIMENTAL PROCEDURES", "METHODS", "REFERENCES", "ACKNOWLEDGMENTS", "ACKNOWLEDGEMENTS", "SUPPLEMENTAL INFORMATION", "AUTHOR CONTRIBUTIONS",
    "DECLARATION OF INTERESTS", "RESOURCE AVAILABILITY", "KEY RESOURCES TABLE", "LEAD CONTACT", "EXPERIMENTAL MODEL AND SUBJECT DETAILS", "METHOD DETAILS",
    "QUANTIFICATION AND STATISTICAL ANALYSIS", "ONLINE METHODS", "MATERIALS AND METHODS", "SUPPLEMENTARY INFORMATION", "SUPPLEMENTAL FIGURES", "SUPPLEMENTAL TABLES", "FIGURE LEGENDS",
)
#: Where a text without headings ends: methods may stand before results, so they are no end there.
HARD_END = (
    "REFERENCES", "ACKNOWLEDGMENTS", "ACKNOWLEDGEMENTS", "SUPPLEMENTAL INFORMATION", "SUPPLEMENTARY INFORMATION", "SUPPLEMENTAL FIGURES", "SUPPLEMENTAL TABLES", "FIGURE LEGENDS",
    "AUTHOR CONTRIBUTIONS", "DECLARATION OF INTERESTS", "RESOURCE AVAILABILITY", "KEY RESOURCES TABLE", "LEAD CONTACT",
)
MIN_BODY = 120


def running_lines(lines: DataFrame, doc: str = "doc_id", page: str = "page", text: str = "text") -> DataFrame:
    """Digit-masked texts that recur on at least max(3, a quarter of the pages up to 25): headers and footers."""
    mask = T.template(F.trim(text))
    pages = lines.groupBy(doc).agg(F.countDistinct(page).alias("pages"))
    seen = lines.where(F.length(F.trim(text)).between(1, 220)).select(doc, page, mask.alias("mask")).distinct().groupBy(doc, "mask").agg(F.count(F.lit(1)).alias("n"))
    return seen.join(pages, doc).where(F.col("n") >= F.greatest(F.lit(3.0), 0.25 * F.least(F.col("pages"), F.lit(25)))).select(doc, "mask", "n")


def line_number_column(lines: DataFrame, doc: str = "doc_id", page: str = "page", pos: str = "pos", text: str = "text", x: str = "x0") -> DataFrame:
    """Lines of a manuscript's line-number column: digits only, left of the text by 6, at least 5 to a page, 60 % of steps from 1 to 3."""
    body = lines.where(~F.col(text).rlike(r"^\s*\d+\s*$")).groupBy(doc, page).agg(F.min(x).alias("left"))
    digits = lines.where(F.col(text).rlike(r"^\s*\d{1,6}\s*$")).join(body, [doc, page]).where(F.col(x) <= F.col("left") - 6)
    value = F.trim(text).cast("int")
    step = value - F.lag(value).over(Window.partitionBy(doc, page).orderBy(pos))
    good = digits.withColumn("step", step).groupBy(doc, page).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("step").isNull(), None).otherwise(F.col("step").between(1, 3).cast("double"))).alias("share"))
    return digits.join(good.where("n >= 5 and share >= 0.6"), [doc, page], "left_semi").select(doc, page, pos)


def level(text: Column) -> Column:
    """A dotted number is 2; words of the body's great parts are 1, as is a plain number, or three letters and more that are all capitals; else 2."""
    number = T.number_level(text)
    letters = F.regexp_replace(text, r"\P{L}", "")
    capitals = (F.length(letters) >= 3) & ~letters.rlike(r"[^\p{Lu}]")
    return F.when(number == 2, 2).when((number == 1) | T.heading_key(text).isin(*BODY) | capitals, 1).otherwise(2)


def is_end(text: Column, words=END) -> Column:
    """Whether a heading is one of the words, or begins with one and a space. ``words``: END, or HARD_END for texts without headings."""
    key = T.heading_key(text)
    return reduce(lambda a, e: a | (key == e) | F.startswith(key, F.lit(e + " ")), words, F.lit(False))


def sections(lines: DataFrame, doc: str = "doc_id", pos: str = "pos", text: str = "text", heading: str = "heading") -> DataFrame:
    """Sections of documents whose heading lines are marked: the text between a heading and the next, from the first start (or level-1) heading to the first end heading.

    Columns: doc, section (from 1), title, level, parent, container, body, chars. Headings that stand directly before a deeper one and
    have no text are containers; bodies under ``MIN_BODY`` characters are dropped unless they are containers.
    """
    w = Window.partitionBy(doc).orderBy(pos)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("level", F.when(F.col(heading), level(F.col(text)))).withColumn("_key", F.when(F.col(heading), T.heading_key(F.col(text))))
    start = F.col(heading) & (F.col("_key").isin(*START) | (F.col("level") == 1)) & ~is_end(F.col(text))
    begun = F.max(start.cast("int")).over(so_far) == 1
    ended = F.coalesce(F.max(F.when(F.col(heading) & is_end(F.col(text)), 1)).over(so_far), F.lit(0)) == 1
    body = marked.withColumn("_in", begun & ~ended).where("_in").withColumn("section", F.sum(F.col(heading).cast("int")).over(so_far))
    grouped = body.groupBy(doc, "section").agg(
        F.max(F.when(F.col(heading), F.col(text))).alias("title"), F.max("level").alias("level"), T.joined(F.transform(F.array_sort(F.collect_list(F.when(~F.col(heading), F.struct(pos, text)))), lambda x: x[text])).alias("body"),
    )
    v = Window.partitionBy(doc).orderBy("section")
    parent = F.last(F.when(F.col("level") == 1, F.col("title")), ignorenulls=True).over(v.rowsBetween(Window.unboundedPreceding, -1))
    out = grouped.withColumn("parent", F.when(F.col("level") > 1, parent)).withColumn("container", F.coalesce(F.lead("level").over(v) > F.col("level"), F.lit(False)) & (F.length("body") == 0))
    return out.withColumn("chars", F.length("body")).where(F.col("container") | (F.col("chars") >= MIN_BODY))


def page_sections(lines: Column, least: int = 3) -> Column:
    """Without headings: lines (structs of page and text, in order) cut where the page changes once ``least`` are held; the line that changes
    the page still belongs to what is cut."""
    start = F.struct(F.array().cast("array<array<string>>").alias("out"), F.array().cast("array<string>").alias("now"), F.lit(None).cast("int").alias("page"))

    def step(a: Column, x: Column) -> Column:
        now = F.array_append(a["now"], x["text"])
        cut = a["page"].isNotNull() & (a["page"] != x["page"]) & (F.size(a["now"]) >= least)
        return F.when(cut, F.struct(F.array_append(a["out"], now).alias("out"), F.array().cast("array<string>").alias("now"), x["page"].cast("int").alias("page"))).otherwise(
            F.struct(a["out"].alias("out"), now.alias("now"), x["page"].cast("int").alias("page")),
        )

    return F.aggregate(lines, start, step, lambda a: F.when(F.size(a["now"]) > 0, F.array_append(a["out"], a["now"])).otherwise(a["out"]))


def best_lines(anchors: DataFrame, lines: DataFrame, least: int = 45) -> DataFrame:
    """For every anchor (doc_id, anchor_id, title, page) the line with the best additive score, the first of equals, if it reaches ``least``.

    Equal keys 60, one a prefix of the other 40, same page 20, next page 8, short line 5. An anchor is compared with every line of its document;
    lines and anchors without text meet nothing.
    """
    a = anchors.withColumn("_k", T.structure_key(F.col("title"))).where("_k <> ''")
    l = lines.withColumn("_l", T.structure_key(F.col("text"))).where("_l <> ''").withColumnRenamed("page", "_page")
    score = (
        F.when(F.col("_k") == F.col("_l"), 60).when(F.startswith("_k", F.col("_l")) | F.startswith("_l", F.col("_k")), 40).otherwise(0)
        + F.when(F.col("page") == F.col("_page"), 20).when(F.abs(F.col("page") - F.col("_page")) == 1, 8).otherwise(0) + F.when(F.length("_l") <= 120, 5).otherwise(0)
    )
    return _best(a.join(l, "doc_id").withColumn("score", score), least)


def found_lines(anchors: DataFrame, lines: DataFrame, least: int = 45) -> DataFrame:
    """For every anchor (doc_id, anchor_id, anchor, title, page, anchor_line) the line (doc_id, page, pos, text, role) with the best score, the first of equals, if it reaches ``least``.

    The line is the anchor 120, begins with it 85, holds it 60, or (from 4 characters on) is held by it 40; is the title 100, begins with it 70, holds it 40; is a
    heading (role head) 25; same page 15; the anchor's line 30, at most 3 away 20, at most 40 away 10. An anchor may begin with its line's mark
    (L123|) and end in an ellipsis; what is null or empty gives nothing, nor does page 0.
    """
    plain = T.structure_key(F.col("anchor"))
    plain = F.when(F.startswith(plain, F.lit("l")), F.trim(F.regexp_replace(plain, r"^[^|]*\|", ""))).otherwise(plain)
    plain = F.trim(F.regexp_replace(plain, r"(?s)(…|\.\.\.).*$", ""))
    a = anchors.select("doc_id", "anchor_id", F.coalesce(plain, F.lit("")).alias("_a"), F.coalesce(T.structure_key(F.col("title")), F.lit("")).alias("_t"), F.col("page").alias("_page"), "anchor_line")
    l = lines.withColumn("_l", F.coalesce(T.structure_key(F.col("text")), F.lit("")))
    far = F.abs(F.col("pos") - F.col("anchor_line"))
    score = (
        F.when(F.col("_a") == "", 0).when(F.col("_l") == F.col("_a"), 120).when(F.startswith("_l", F.col("_a")), 85).when(F.contains("_l", F.col("_a")), 60)
        .when((F.length("_l") >= 4) & F.contains("_a", F.col("_l")), 40).otherwise(0)
        + F.when(F.col("_t") == "", 0).when(F.col("_l") == F.col("_t"), 100).when(F.startswith("_l", F.col("_t")), 70).when(F.contains("_l", F.col("_t")), 40).otherwise(0)
        + F.when(F.col("role") == "head", 25).otherwise(0) + F.when((F.col("_page") != 0) & (F.col("page") == F.col("_page")), 15).otherwise(0)
        + F.when(far == 0, 30).when(far <= 3, 20).when(far <= 40, 10).otherwise(0)
    )
    return _best(a.join(l, "doc_id").withColumn("score", score), least)


def _best(scored: DataFrame, least: int) -> DataFrame:
    best = scored.where(F.col("score") >= least).groupBy("doc_id", "anchor_id").agg(F.max_by(F.struct("pos", "score"), F.struct("score", -F.col("pos"))).alias("b"))
    return best.select("doc_id", "anchor_id", "b.pos", "b.score")
