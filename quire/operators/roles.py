"""From bare lines to sections by rules alone: roles of lines by font and place, blocks of headings, and what to do where there are none.

A table of lines has doc_id, page (from 1), pos (reading order, unique in a document), text, font, size, a box x0, y0, x1, y1, and the page's height; null texts are empty,
other columns stay. Every step is a window within a document over the one shuffle by doc_id, so nothing is larger than a document's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import text as T
from quire.operators import page as P
from quire.operators import sections as C
from quire.operators import sequence as S
from quire.operators.flows import settled

# The edges of a page, where its number is, a repeated line's length; characters a line of symbols; how much smaller small print is; the shares by
# which headings are told from prose; how much shorter the rest of a wrapped heading is; lengths of sections; leading and white space where none can be measured.
EDGE_TOP, EDGE_BOTTOM, NUMBER_FROM, REPEATED_MOST = 0.12, 0.85, 0.93, 220
SYMBOL_CPL, PANEL_MOST, SMALLER, JUNK_MOST = 4.0, 3, 0.8, 120
FRAGMENTS, SPACED, WS_RATIO, HEAD_LEAST, SHRINK = 0.55, 0.5, 1.8, 4, 0.99
COVER_LEAST, PAGE_LINES, PAGE_LEAST, STUB = 0.5, 3, 800, 900
LEADING, WHITE = 11.0, 2.5


def _text() -> Column:
    return F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")


def same_face(a: Column, b: Column) -> Column:
    """Whether two fonts are one apart from weight and slope: what stands before the hyphen of one begins with that of the other; a null or empty ``a`` is like none."""
    x, y = (F.lower(F.split(F.coalesce(c, F.lit("")), "-")[0]) for c in (a, b))
    return (x != "") & (F.startswith(x, y) | F.startswith(y, x))


def font_roles(lines: DataFrame) -> DataFrame:
    """lines with role (pagenum, symbol, panel, running, small, junk, head, prose), journal (the number printed at the page's foot, on its line), leading (of the
    document's body) and cpl (characters a line of the font). Columns of these names are replaced.

    The body is the font and size with most characters, the first of equals. What is left open by place, font, size and wording is decided for each font
    and size as a whole: a heading has white space above it and does not run on into the next line.
    """
    doc = Window.partitionBy("doc_id")
    group, font = Window.partitionBy("doc_id", "font", "size"), Window.partitionBy("doc_id", "font")
    near = F.coalesce((F.col("y0") < F.col("height") * EDGE_TOP) | (F.col("y0") > F.col("height") * EDGE_BOTTOM), F.lit(False))
    low = F.coalesce(F.col("_t").rlike(r"^\d{1,4}$") & (F.col("y0") > F.col("height") * NUMBER_FROM), F.lit(False))
    lowest = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(F.col("_low").desc(), F.col("y0").desc(), "pos"))
    x = lines.drop("role", "journal", "leading", "cpl").withColumn("_t", _text()).withColumn("_low", low)
    x = x.withColumn("journal", F.when(F.col("_low") & (lowest == 1), F.col("_t").cast("int"))).withColumn("_num", F.col("journal").isNotNull())
    own = F.when(~F.col("_num"), F.length("_t"))
    x = x.withColumn("_chars", F.sum(own).over(group)).withColumn("_first", F.min(F.when(~F.col("_num"), F.col("pos"))).over(group)).withColumn("cpl", F.sum(own).over(font) / F.count(own).over(font))
    best = F.max(F.when(~F.col("_num"), F.struct("_chars", -F.col("_first"), F.col("font").alias("f"), F.col("size").alias("s")))).over(doc)
    mask = F.when(near & ~F.col("_num") & F.length("_t").between(1, REPEATED_MOST), T.template(F.col("_t")))
    x = x.withColumn("_best", best).withColumn("_pages", F.max("page").over(doc)).withColumn("_mask", mask)
    x = x.withColumn("_seen", F.size(F.collect_set("page").over(Window.partitionBy("doc_id", "_mask"))))
    often = F.col("_mask").isNotNull() & (F.col("_seen") >= F.greatest(F.lit(3.0), 0.25 * F.least(F.col("_pages"), F.lit(25))))
    clear = (
        F.when(F.col("_num"), "pagenum").when(F.col("_t") == "", "symbol").when(often, "running")
        .when(F.col("cpl") < SYMBOL_CPL, F.when(F.length("_t") <= PANEL_MOST, "panel").otherwise("symbol"))
        .when(F.col("size") < F.col("_best.s") - SMALLER, "small").when((F.length("_t") <= JUNK_MOST) & T.junk_heading(F.col("_t")), "junk")
    )
    # the line above and the next one of the same kind, page numbers left out
    before = F.lag(F.struct("page", "y0", "y1", "font", "size")).over(Window.partitionBy("doc_id", "_num").orderBy("pos"))
    x = x.withColumn("_clear", clear).withColumn("_open", F.col("_clear").isNull()).withColumn("_p", before)
    together = F.col("_p.page") == F.col("page")
    body = F.col("_open") & F.col("font").eqNullSafe(F.col("_best.f")) & F.col("size").eqNullSafe(F.col("_best.s")) & together
    x = x.withColumn("_lead", F.when(body, F.col("y0") - F.col("_p.y0"))).withColumn("_white", F.when(body, F.greatest(F.lit(0.0), F.col("y0") - F.col("_p.y1"))))
    for name, into, default in (("_lead", "leading", LEADING), ("_white", "_ws", WHITE)):
        rank = F.when(F.col(name).isNotNull(), F.row_number().over(Window.partitionBy("doc_id", F.col(name).isNull()).orderBy(name)))
        x = x.withColumn("_r", rank).withColumn(into, F.max(F.when(F.col("_r") == F.floor(F.count(name).over(doc) / 2) + 1, F.col(name))).over(doc))
        x = x.withColumn(into, F.coalesce(F.nullif(into, F.lit(0.0)), F.lit(default)))
    kind = Window.partitionBy("doc_id", "font", "size", "_open")
    x = x.withColumn("_n", F.lead(F.struct("page", "x0", "x1", "y0")).over(kind.orderBy("pos")))
    both = F.least("x1", "_n.x1") - F.greatest("x0", "_n.x0")
    on = (F.col("_n.page") == F.col("page")) & (F.col("_n.y0") - F.col("y0") < F.col("leading") * P.NEAR) & (both >= (F.col("x1") - F.col("x0")) * P.OVERLAP) & ~F.col("_t").rlike(r"[.!?:]$")
    same = together & F.col("_p.font").eqNullSafe(F.col("font")) & F.col("_p.size").eqNullSafe(F.col("size"))
    white = ~F.coalesce(same, F.lit(False)) | (F.col("y0") - F.col("_p.y1") > F.col("_ws") + F.col("leading") * (WS_RATIO - 1.0) * 0.5)
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    head = (share(on).over(kind) < FRAGMENTS) & (share(white).over(kind) > SPACED) & (F.max(F.length("_t")).over(kind) >= HEAD_LEAST)
    role = F.coalesce("_clear", F.when(head, "head").otherwise("prose"))
    return x.withColumn("role", role).select(*[c for c in lines.columns if c.lower() not in ("role", "journal", "leading", "cpl")], "role", "journal", "leading", "cpl")


def heading_blocks(lines: DataFrame) -> DataFrame:
    """doc_id, block (the place of its first line), last (that of its last), title, level, page, first_text, font, cpl, wraps: headings, each whole.

    A line goes on the heading line before it where it stands just below on the same page in the same column, in the same face, and is shorter. ``wraps``: its
    first line stands below a heading line in the same way, whatever its face and length.
    """
    doc = Window.partitionBy("doc_id").orderBy("pos")
    kept = lines.withColumn("_t", _text())
    # the line above, whatever its role, without page numbers
    above = F.lag(F.struct("page", "role", "x0", "x1", "y0")).over(Window.partitionBy("doc_id", F.col("role") == "pagenum").orderBy("pos"))
    h = kept.withColumn("_a", above).where("role = 'head' and _t <> ''").withColumn("_p", F.lag(F.struct("page", "x0", "x1", "y0", "font")).over(doc))

    def below(p: str, least: float) -> Column:
        dy = F.col("y0") - F.col(f"{p}.y0")
        both = F.least("x1", f"{p}.x1") - F.greatest("x0", f"{p}.x0")
        narrow = F.least(F.col("x1") - F.col("x0"), F.col(f"{p}.x1") - F.col(f"{p}.x0"))
        return (F.col(f"{p}.page") == F.col("page")) & (dy > least) & (dy < F.col("leading") * P.NEAR) & (both > narrow * P.OVERLAP)

    goes_on = below("_p", 0.0) & (F.col("x1") - F.col("x0") < (F.col("_p.x1") - F.col("_p.x0")) * SHRINK) & same_face(F.col("font"), F.col("_p.font"))
    wraps = F.coalesce((F.col("_a.role") == "head") & below("_a", 0.5), F.lit(False))
    marked = S.islands(h.withColumn("_wraps", wraps).withColumn("_on", F.coalesce(goes_on, F.lit(False))), ["doc_id"], ~F.col("_on"), "_block", "pos")
    first = lambda c: F.min_by(c, "pos")
    whole = T.squeezed(F.array_join(F.array_sort(F.collect_list(F.struct("pos", "_t")))["_t"], " "))
    out = marked.groupBy("doc_id", "_block").agg(
        F.min("pos").alias("block"), F.max("pos").alias("last"), whole.alias("title"), first("page").alias("page"), first("_t").alias("first_text"), first("font").alias("font"), first("cpl").alias("cpl"), first("_wraps").alias("wraps"),
    )
    return out.drop("_block").withColumn("level", C.level(F.col("title")))


def in_body(blocks: DataFrame) -> DataFrame:
    """blocks with part: front, body or excluded (from the first heading that ends the body), and fake: null, inline (half a sentence) or label (of a figure)."""
    so_far = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    key, whole = T.heading_key(F.col("title")), Window.partitionBy("doc_id")
    x = blocks.withColumn("_start", F.min(F.when(key.isin(*C.START) | (F.col("level") == 1), F.col("block"))).over(whole))
    ends = C.is_end(F.col("title")) & (F.col("block") >= F.coalesce("_start", "block"))
    x = x.withColumn("_ended", F.max(ends.cast("int")).over(so_far) == 1)
    part = F.when(F.col("_ended"), "excluded").when(F.col("block") >= F.col("_start"), "body").otherwise("front")
    t = F.col("first_text")
    first = F.left(t, F.lit(1))
    half = first.rlike(r"^\p{Ll}") | ((F.instr(F.lit(P.HEAD_PUNCT), first) > 0) & (t != "")) | t.rlike("^[0-9]+[a-z]")
    fake = F.when((F.col("cpl") < P.LABEL_CPL) | ~t.rlike("[A-Za-z0-9]"), "label").when(~F.col("wraps") & half, "inline")
    return x.withColumn("part", part).withColumn("fake", F.when(F.col("part") == "body", fake)).drop("_start", "_ended")


def journal_pages(lines: DataFrame) -> DataFrame:
    """doc_id, page, journal: printed page numbers of lines with role pagenum; those of a document with three or more are left out as a whole unless four fifths of their steps are from 1 to 5."""
    one = lines.where("role = 'pagenum' and journal <> 0").groupBy("doc_id", "page").agg(F.min_by("journal", "pos").alias("journal"))
    step = F.col("journal") - F.lag("journal").over(Window.partitionBy("doc_id").orderBy("page"))
    doc = Window.partitionBy("doc_id")
    x = one.withColumn("_s", step).withColumn("_n", F.count(F.lit(1)).over(doc)).withColumn("_good", F.avg(F.when(F.col("_s").isNotNull(), F.col("_s").between(1, 5).cast("int"))).over(doc))
    return x.where((F.col("_n") < 3) | (F.col("_good") >= 0.8)).select("doc_id", "page", "journal")


def _by_pages(prose: DataFrame) -> DataFrame:
    """prose (doc_id, attempt, pos, page, text) with section: cut at a line on another page than the one before, once PAGE_LINES are held; short rests are left out."""
    key = ["doc_id", "attempt"]
    w = Window.partitionBy(*key).orderBy("pos")
    x = prose.withColumn("_i", F.row_number().over(w)).withColumn("_turn", F.col("page") != F.lag("page").over(w))
    # only the places where pages turn are carried along
    turns = x.where("_turn").groupBy(*key).agg(F.array_sort(F.collect_list("_i")).alias("_turns"))
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0))
    cuts = F.aggregate("_turns", F.array().cast("array<int>"), lambda a, i: F.when(i - last(a) >= PAGE_LINES, F.array_append(a, i)).otherwise(a))
    x = x.join(turns.select(*key, cuts.alias("_cuts")), key, "left")
    x = x.withColumn("section", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_i"))), F.lit(0)) + 1).withColumn("_ends", F.coalesce(last(F.col("_cuts")), F.lit(0)))
    v, whole = Window.partitionBy(*key, "section"), Window.partitionBy(*key)
    chars = F.sum(F.length("text") + 1)
    x = x.withColumn("_n", F.count(F.lit(1)).over(v)).withColumn("_c", chars.over(v) - 1).withColumn("_all", chars.over(whole) - 1).withColumn("_closed", F.max("_i").over(v) <= F.col("_ends"))
    return x.where((F.col("_all") >= PAGE_LEAST) & (F.col("_n") >= PAGE_LINES) & (F.col("_closed") | (F.col("_c") >= PAGE_LEAST))).select(*key, "pos", "page", "text", "section")


def sectionize(lines: DataFrame) -> DataFrame:
    """doc_id, section (from 1), id, title, level, parent, first_page, last_page (printed ones where they can be trusted), pdf_first, pdf_last, body, chars, merged (titles that flowed in), fallback.

    Headings from the first start (or level 1) to the first that ends the body, without false ones; level-1 headings above deeper ones have no section of their own. Where
    less than half of the prose is covered by sections, pages make them: up to the hard end, else (where that gives fewer than two) up to the last one, else all.
    Sections under 120 characters go, of equal titles the longest stays, and one under STUB flows into the next. Documents without text give no rows.
    """
    doc = Window.partitionBy("doc_id")
    roles = settled(font_roles(lines)).select("doc_id", "page", "pos", F.coalesce("text", F.lit("")).alias("text"), "font", "x0", "y0", "x1", "y1", "role", "journal", "leading", "cpl")
    blocks = in_body(heading_blocks(roles))
    order = Window.partitionBy("doc_id").orderBy("block")
    kept = blocks.where("part = 'body' and fake is null").withColumn("_next", F.lead("level").over(order)).withColumn("container", F.coalesce((F.col("level") == 1) & (F.col("_next") > 1), F.lit(False)))
    top = F.last(F.when(F.col("level") == 1, F.col("title")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    kept = kept.withColumn("_top", top).withColumn("parent", F.when(T.heading_key(F.col("_top")) != T.heading_key(F.col("title")), F.col("_top")).otherwise("")).withColumn("parent", F.coalesce("parent", F.lit("")))
    end = F.min(F.when(F.col("part") == "excluded", F.col("block")))
    hard = C.is_end(F.col("title"), C.HARD_END)
    low = blocks.withColumn("_low", F.coalesce(F.min(F.when((F.col("part") == "body") & F.col("fake").isNull(), F.col("block"))).over(doc), F.lit(-1)))
    bounds = low.groupBy("doc_id").agg(F.max("_low").alias("low"), end.alias("end"), F.min(F.when(hard & (F.col("block") >= F.col("_low")), F.col("block"))).alias("hard"), F.max(F.when(hard, F.col("block"))).alias("hardest"))

    # every line knows the heading it stands below, and lines of false headings get their roles
    fakes = blocks.where("fake is not null").select("doc_id", F.col("block").alias("_f"), F.col("last").alias("_fl"), "fake")
    heads = kept.select("doc_id", F.col("block").alias("pos"), F.struct("block", "last", "title", "level", "parent", "container", F.col("page").alias("at")).alias("_h"))
    so_far = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    x = roles.join(heads, ["doc_id", "pos"], "left").join(fakes.select("doc_id", F.col("_f").alias("pos"), "_fl", "fake"), ["doc_id", "pos"], "left").join(bounds, "doc_id", "left")
    x = x.withColumn("_h", F.last("_h", ignorenulls=True).over(so_far)).withColumn("_fk", F.last(F.when(F.col("fake").isNotNull(), F.struct("_fl", "fake")), ignorenulls=True).over(so_far))
    mend = (F.col("role") == "head") & (F.col("pos") <= F.col("_fk._fl"))
    x = x.withColumn("role", F.when(mend, F.when(F.col("_fk.fake") == "inline", "prose").otherwise("panel")).otherwise(F.col("role")))
    before_end = F.coalesce(F.col("pos") < F.col("end"), F.lit(True))
    held = F.coalesce(before_end & F.col("role").isin("prose", "symbol") & (F.col("pos") > F.col("_h.last")) & ~F.col("_h.container"), F.lit(False))
    scope = (F.col("role") == "prose") & (F.col("pos") >= F.coalesce("low", F.lit(-1))) & F.coalesce(F.col("pos") < F.coalesce("end", "hard"), F.lit(True))
    x = settled(x.withColumn("_held", held).withColumn("_cover", F.avg(F.when(scope, F.col("_held").cast("int"))).over(doc)))

    # pages in place of headings
    tail = F.coalesce("hard", "end")
    tries = F.array(F.struct(F.lit(1).alias("attempt"), tail.alias("tail")), F.struct(F.lit(2).alias("attempt"), F.when(F.col("hardest") > F.coalesce(tail, F.lit(-1)), F.col("hardest")).otherwise(F.lit(-1)).alias("tail")), F.struct(F.lit(3).alias("attempt"), F.lit(None).cast("int").alias("tail")))
    poor = x.where((F.col("role") == "prose") & (F.col("_cover") < COVER_LEAST)).select("doc_id", "pos", "page", "text", F.explode(tries).alias("_a"))
    poor = poor.where(F.coalesce(F.col("pos") < F.col("_a.tail"), F.lit(True))).select("doc_id", F.col("_a.attempt").alias("attempt"), "pos", "page", "text")
    cut = _by_pages(poor)
    n = lambda k: F.coalesce(F.countDistinct(F.when(F.col("attempt") == k, F.col("section"))), F.lit(0))
    counts = cut.groupBy("doc_id").agg(n(1).alias("_n1"), n(2).alias("_n2"))
    choice = F.when((F.col("_n1") < 2) & (F.col("_n2") > F.col("_n1")), 2).when(F.col("_n1") > 0, 1).otherwise(3)
    chosen = cut.join(counts.select("doc_id", choice.alias("attempt")), ["doc_id", "attempt"], "left_semi")
    at = Window.partitionBy("doc_id", "section")
    lo, hi = F.min("page").over(at), F.max("page").over(at)
    paged = chosen.withColumn("_lo", lo).withColumn("_hi", hi).select(
        "doc_id", "pos", "page", "text", F.col("section").cast("long").alias("_s"), F.format_string("第 %d–%d 页", "_lo", "_hi").alias("title"), F.lit(2).alias("level"), F.lit("").alias("parent"), F.col("_lo").alias("at"), F.lit(True).alias("fallback"),
    )
    own = x.where("_held").join(chosen.select("doc_id").distinct(), "doc_id", "left_anti").select(
        "doc_id", "pos", "page", "text", F.col("_h.block").cast("long").alias("_s"), F.col("_h.title").alias("title"), F.col("_h.level").alias("level"), F.col("_h.parent").alias("parent"), F.col("_h.at").alias("at"), F.lit(False).alias("fallback"),
    )
    both = own.unionByName(paged)

    # printed pages, texts, and what is too short or there twice
    printed = journal_pages(roles)
    both = both.join(printed, ["doc_id", "page"], "left").join(printed.select("doc_id", F.col("page").alias("at"), F.col("journal").alias("_at")), ["doc_id", "at"], "left")
    shown = F.when(F.col("fallback"), F.col("page")).otherwise(F.coalesce("journal", "page"))
    shown_at = F.when(F.col("fallback"), F.col("at")).otherwise(F.coalesce("_at", "at"))
    whole = T.joined(F.array_sort(F.collect_list(F.struct("pos", "text")))["text"])
    texts = both.groupBy("doc_id", "_s", "title", "level", "parent", "fallback").agg(
        F.least(F.min(shown), F.min(shown_at)).alias("first_page"), F.greatest(F.max(shown), F.max(shown_at)).alias("last_page"),
        F.least(F.min("page"), F.min("at")).alias("pdf_first"), F.greatest(F.max("page"), F.max("at")).alias("pdf_last"), whole.alias("body"),
    ).withColumn("chars", F.length("body")).where(F.col("chars") >= C.MIN_BODY)
    texts = S.first_wins(texts.withColumn("_k", T.heading_key(F.col("title"))), ["doc_id", "_k"], F.col("chars").desc(), F.col("_s"))

    # stubs flow on: only lengths are carried along
    sizes = texts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("_s", "chars"))).alias("_all"))
    start = F.struct(F.array().cast("array<int>").alias("g"), F.lit(1).alias("now"), F.lit(0).alias("held"))

    def step(a: Column, s: Column) -> Column:
        held = F.when(a["held"] > 0, a["held"] + 1).otherwise(0) + s["chars"]
        full = held >= STUB
        return F.struct(F.array_append(a["g"], a["now"]).alias("g"), (a["now"] + full.cast("int")).alias("now"), F.when(full, 0).otherwise(held).alias("held"))

    groups = sizes.select("doc_id", F.explode(F.arrays_zip(F.col("_all._s").alias("_s"), F.aggregate("_all", start, step, lambda a: a["g"]).alias("section")))).select("doc_id", "col.*")
    rows = texts.join(groups, ["doc_id", "_s"]).groupBy("doc_id", "section").agg(
        F.max_by(F.struct("title", "level", "parent", "last_page", "pdf_last", "fallback"), "_s").alias("_l"), F.min("first_page").alias("first_page"), F.min("pdf_first").alias("pdf_first"),
        F.array_sort(F.collect_list(F.struct("_s", "title", "body"))).alias("_all"),
    )
    merged = F.expr("slice(_all.title, 1, size(_all) - 1)")
    out = rows.select("doc_id", "section", "_l.*", "first_page", "pdf_first", F.array_join(F.col("_all.body"), " ").alias("body"), merged.alias("merged")).withColumn("chars", F.length("body"))
    return S.numbered(out, T.slug(F.col("title")), ["doc_id"], "section").select(
        "doc_id", "section", "id", "title", "level", "parent", "first_page", "last_page", "pdf_first", "pdf_last", "body", "chars", "merged", "fallback",
    )


def contents(blocks: DataFrame) -> DataFrame:
    """doc_id, block, title, level, page, part of all headings that are none of the false ones: the table of contents and what was left out."""
    return blocks.where("fake is null and part <> 'front'").select("doc_id", "block", "title", "level", "page", "part")


def preferred(model: DataFrame, rules: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """Sections of documents as a model tells them, else as rules do: the columns that both have, with by (model or rules) and reason (why the model's are not there, of
    ``failures``: doc_id, reason; the first in order of several)."""
    shared = [c for c in rules.columns if c in model.columns]
    none = F.lit(None).cast("string")
    told = model.select(*shared, F.lit("model").alias("by"), none.alias("reason"))
    rest = rules.select(*shared).join(model.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("by", F.lit("rules"))
    if failures is None:
        return told.unionByName(rest.withColumn("reason", none))
    return told.unionByName(rest.join(failures.groupBy("doc_id").agg(F.min("reason").alias("reason")), "doc_id", "left"))
