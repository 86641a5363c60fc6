"""Text as Column -> Column functions: cleaning, segmentation, keys, tests. All but one step of ``extract_json`` stays in the JVM."""

from __future__ import annotations

import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values ----------------------------------------------------------------
#: Greek letters that lose their shape in extraction, in the order in which they are put back.
GREEK = (
    ("CD3e", "CD3ε"), ("CD3d", "CD3δ"), ("CD3g", "CD3γ"), ("CD3z", "CD3ζ"),
    ("IFN-g", "IFN-γ"), ("TNF-a", "TNF-α"), ("TGF-b", "TGF-β"), ("IL2", "IL-2"),
    ("TCRab", "TCRαβ"), ("a-hCD3", "α-hCD3"), ("a-CD3", "α-CD3"),
    ("PLCg1", "PLCγ1"), ("Plcg1", "Plcγ1"),
    ("εd,", "εδ,"), ("εg,", "εγ,"), ("and zz", "and ζζ"),
)
#: A citation in parentheses that ends in a year.
CITATION = r"\s*\(([^()]*?(?:19|20)\d\d[a-z]?(?:;[^()]*)?)\)"
CONTROL = r"[\x00-\x08\x0b-\x1f\x7f-\x9f]"
INVISIBLE = "[​-‏  ‪-‮⁠﻿]"
BLANKS = "   "
#: Abbreviations after which a full stop ends no sentence.
ABBREVIATIONS = ("Fig", "Figs", "Table", "Tables", "Suppl", "Supp", "Ref", "Refs", "No", "vs", "approx", "et al", r"e\.g", r"i\.e", "Dr", "Mr", "Ms", "St", "Sec", "Eq")
#: Look-alikes folded to one Latin letter before a quotation is looked for.
LOOSE_FROM = "γΓαΑβΒδΔεΕζΖηΗθΘιΙκΚλΛμΜνΝξΞπΠρΡσΣςτΤυΥφΦχΧψΨωΩ"
LOOSE_TO = "vvaabbddeezznnttiikklluuvnxxppppsssttuyffxxyyww"
#: Quotation marks and dashes that count as one; ligatures.
MARKS_FROM, MARKS_TO = "‘’‚‛“”„‐‑‒–—―−", "''''\"\"\"-------"
LIGATURES = (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"))
#: Words by which a model says that what was selected is no whole word or sentence.
REFUSALS = ("无法确定", "不完整", "截断", "片段", "不是一个完整的", "不是完整的")
#: Before a full stop: abbreviations that end no sentence, when texts are cut for a model.
SHORT_WORDS = ("al", "eg", "ie", "vs", "fig", "figs", "eq", "no", "cf", "approx", "ref", "refs", "dr", "mr", "mrs", "ms", "prof", "st", "etc", "vol", "sec", "suppl", "ca", "resp")
#: Numbers in front of headings, and what has to follow them.
NUMBER, ROMAN, BEFORE = r"^(\d{1,2}(?:\.\d{1,2}){0,3})[.:\)]?\s+", r"^([IVXLC]{1,6})[.:\)]\s+", "(?=[A-Za-z(一-鿿])"
#: Titles that are none; headings that are none: addresses, a journal's own labels, captions.
JUNK_TITLES = ("untitled", "title", "document", "no title")
ADDRESS = r"(?i)^(https?://|www\.)"
JUNK_HEADING = r"(?i)^(https?://|www\.|doi:|check for updates$|download|share|cite this article|correspondence|reprints|permissions|article$|review article$|perspective$)|[\w.\-]+@[\w.\-]+\.\w+|^(fig|figure|table|box|scheme|extended data|supplementary)\s*\.?\s*\d|^please cite this article|^this article is protected|^downloaded from|^provided by|^see discussions|^article in press"
TYPES = {"pdf": "application/pdf", "json": "application/json", "html": "text/html", "css": "text/css", "js": "text/javascript", "png": "image/png"}


# Cleaning --------------------------------------------------------------------

def heal_lines(c: Column) -> Column:
    """A word cut by a hyphen at the line's end is whole again; a slash there takes its continuation without a space."""
    return F.regexp_replace(F.regexp_replace(c, r"-\s*\n\s*", ""), r"/\s*\n\s*", "/")


def greek(c: Column) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), GREEK, c)


def clean(c: Column) -> Column:
    """The one cleaning that both sources and quotations go through."""
    c = F.replace(F.replace(c, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))
    c = F.replace(F.translate(c, "’‘“”–´́", "''\"\"-'"), F.lit("—"), F.lit("--"))
    c = F.regexp_replace(heal_lines(c), CITATION, "")
    c = F.regexp_replace(F.translate(F.regexp_replace(c, CONTROL, " "), "­", ""), INVISIBLE, " ")
    c = F.translate(c, BLANKS + "−", "   -")
    return greek(F.trim(F.regexp_replace(c, r"\s+", " ")))


def joined(lines: Column) -> Column:
    """Physical lines as running text."""
    kept = F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return clean(F.array_join(kept, "\n"))


# Segmentation ----------------------------------------------------------------

def sentences(c: Column) -> Column:
    """Array of sentences; white space after a sentence stays with it. Ends are marked, marks after abbreviations and initials are
    taken away, and the text is split at what is left."""
    mark = "\u0001"
    c = F.regexp_replace(c, r"([.!?]+)(\s+|$)", f"$1$2{mark}")
    c = F.regexp_replace(c, rf"(?i)(?<=^|[\s({mark}])((?:{'|'.join(ABBREVIATIONS)})\.\s*){mark}", "$1")
    c = F.regexp_replace(c, rf"(?<=^|[\s{mark}])([A-Z]\.\s*){mark}", "$1")
    found = F.filter(F.split(c, mark, -1), lambda s: F.length(s) > 0)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("")))


def variants(term: Column) -> Column:
    """What a term like "A / B" stands for, as identity keys."""
    return F.filter(F.transform(F.split(term, r"\s*/\s*"), identity_key), lambda x: x != "")


def safe_sentences(c: Column) -> Column:
    """Array of sentences that are surely some: an end is followed by a capital, a digit or an opening parenthesis, and doesn't stand after an
    abbreviation, a single letter or a citation's year. White space after a sentence stays with it, blank ones are left out; a text without any is one."""
    mark = "\u0001"
    parts = F.split(F.regexp_replace(c, r"""([.!?]["')\]]?\s+)(?=[A-Z0-9(])""", f"$1{mark}"), mark, -1)

    def ends(part: Column) -> Column:
        before = F.regexp_replace(part, r"""\s*["')\]]*\s*[.!?]["')\]]*\s*$""", "")
        word = F.translate(F.lower(F.regexp_extract(before, r"([A-Za-z0-9.]+)$", 1)), ".", "")
        return ~(before.rlike(r"[,;]\s*(?:19|20)\d{2}$") | (word == "") | word.isin(*SHORT_WORDS) | word.rlike("^[a-z]$"))

    # the last part ends the text, whatever it is
    whole = F.array_join(F.transform(parts, lambda p: F.concat(p, F.when(ends(p), mark).otherwise(""))), "")
    found = F.filter(F.split(whole, mark, -1), lambda x: F.regexp_replace(x, r"\s+", "") != "")
    return F.when(F.size(found) > 0, found).otherwise(F.array(c))


def chunks(c: Column, cut: int = 6000, target: int = 4000) -> Column:
    """Sentences put together to n = ceil(length / target) chunks (2 at least): each but the last is cut once it has an n-th of the text, and a last one under half
    of that goes to the one before it. A text up to ``cut`` is one chunk. Only places are carried along, the text is cut at the end."""
    n = F.greatest(F.lit(2), F.ceil(F.length(c) / target).cast("int"))
    want = F.length(c) / n
    ends = F.aggregate(safe_sentences(c), F.array().cast("array<int>"), lambda a, x: F.array_append(a, F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + F.length(x)))

    def places(ends: Column) -> Column:
        """Where chunks end."""
        last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0))
        step = lambda a, _: F.concat(a, F.slice(F.filter(ends, lambda e: e - last(a) >= want), 1, 1))
        found = F.aggregate(F.sequence(F.lit(1), n - 1), F.array().cast("array<int>"), step)
        end = F.element_at(ends, -1)
        return F.transform(F.array(F.struct(found.alias("f"), end.alias("e"))), lambda x: F.when(last(x["f"]) == x["e"], x["f"]).when(
            (F.size(x["f"]) > 0) & (x["e"] - last(x["f"]) < 0.5 * want), F.array_append(F.slice(x["f"], 1, F.size(x["f"]) - 1), x["e"]),
        ).otherwise(F.array_append(x["f"], x["e"])))[0]

    # an array of one, so that places are worked out once
    cuts = F.transform(F.array(ends), places)[0]
    return F.when(F.length(c) <= cut, F.array(c)).otherwise(
        F.flatten(F.transform(F.array(cuts), lambda x: F.transform(x, lambda e, i: F.substring(c, F.when(i > 0, F.get(x, i - 1)).otherwise(0) + 1, e - F.when(i > 0, F.get(x, i - 1)).otherwise(0))))),
    )


# Keys (deliberately different from each other) -------------------------------

def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def heading_key(c: Column) -> Column:
    """Upper case without a number, arabic or roman, in front (a letter or parenthesis follows it), and without full stops and colons behind."""
    c = F.upper(squeezed(c))
    c = F.regexp_replace(F.regexp_replace(c, NUMBER + BEFORE, ""), ROMAN + BEFORE, "")
    return F.regexp_replace(c, r"[.:]+$", "")


def structure_key(c: Column) -> Column:
    return F.lower(clean(c))


def locator_key(c: Column) -> Column:
    c = reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), LIGATURES, F.lower(c))
    return F.trim(F.regexp_replace(c, r"[^a-z0-9\-+/ ]", ""))


def strict_fold(c: Column) -> Column:
    c = reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), LIGATURES, F.translate(c, MARKS_FROM, MARKS_TO))
    return squeezed(F.regexp_replace(c, r"[\x00-\x08\x0b-\x1f\x7f-\x9f­​-‏⁠﻿]", ""))


def loose_fold(c: Column) -> Column:
    return F.lower(F.translate(strict_fold(c), LOOSE_FROM, LOOSE_TO))


def identity_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def phrase_key(c: Column) -> Column:
    return F.lower(squeezed(c))


def slug(c: Column, most: int = 48, default: str = "sec") -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.left(s, F.lit(most)), "^-+|-+$", ""), F.lit("")), F.lit(default))


def template(c: Column) -> Column:
    return F.regexp_replace(c, r"\d+", "#")


# Tests and small projections --------------------------------------------------

def number_level(c: Column) -> Column:
    """1 for "2 Title", 2 for "2.1 Title", 0 without a number."""
    n = F.regexp_extract(c, NUMBER + BEFORE, 1)
    return F.when(n == "", 0).when(F.contains(n, F.lit(".")), 2).otherwise(1)


def plausible_line(c: Column) -> Column:
    return (F.length(F.trim(c)) >= 12) & (F.size(F.regexp_extract_all(c, F.lit("[A-Za-z]{3,}"), F.lit(0))) >= 2)


def junk_title(c: Column) -> Column:
    t = F.trim(F.coalesce(c, F.lit("")))
    return (F.length(t) < 8) | F.lower(t).endswith(".pdf") | t.rlike(r"^[\d\W_]+$") | F.lower(t).isin(*JUNK_TITLES) | (F.size(F.regexp_extract_all(t, F.lit("[A-Za-z]{2,}"), F.lit(0))) < 2)


#: Case is that of all letters (a long s is an s), and $ comes before a last line feed alone.
_ANY_CASE = "(?ud)"


def address(c: Column) -> Column:
    return c.rlike(_ANY_CASE + ADDRESS)


def junk_heading(c: Column) -> Column:
    return c.rlike(_ANY_CASE + JUNK_HEADING)


def refused(a: Column, b: Column) -> Column:
    both = F.concat_ws(" ", a, b)
    return reduce(lambda x, w: x | F.contains(both, F.lit(w)), REFUSALS, F.lit(False))


def chat_url(c: Column) -> Column:
    """The address of a chat endpoint; nothing stays nothing."""
    base = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), "/+$", "")
    return (
        F.when(base == "", "").when(base.endswith("/chat/completions"), base).when(base.rlike(r"/v\d+[a-z]*$"), F.concat(base, F.lit("/chat/completions")))
        .otherwise(F.concat(base, F.lit("/v1/chat/completions")))
    )


def masked(c: Column) -> Column:
    return F.when(F.length(c) > 14, F.concat(F.left(c, F.lit(7)), F.lit("…"), F.right(c, F.lit(4)))).otherwise("…")


def content_type(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for p in TYPES.items() for x in p])
    return F.coalesce(F.element_at(known, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))), F.lit("application/octet-stream"))


def title_of(c: Column) -> Column:
    return F.nullif(F.left(F.trim(F.regexp_replace(F.regexp_replace(c, CONTROL, " "), r"\s+", " ")), F.lit(300)), F.lit(""))


def safe_id(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z0-9][A-Za-z0-9._\-]*$") & (F.length(c) <= 120) & ~F.contains(c, F.lit(".."))


def source_ref(title: Column, page: Column) -> Column:
    return F.concat(title, F.lit(" p."), page.cast("string"))


def note(text: Column, meaning: Column, tip: Column) -> Column:
    """Up to three lines, each cut to its length, and all of them to 900."""
    parts = [F.nullif(F.left(x, F.lit(n)), F.lit("")) for x, n in ((text, 120), (meaning, 400), (tip, 300))]
    return F.left(F.concat_ws("\n", *parts), F.lit(900))


def _first_value(texts: pd.Series) -> pd.Series:
    decoder = json.JSONDecoder()

    def one(text: str | None) -> str | None:
        for m in re.finditer(r"[{\[]", text or ""):
            try:
                return text[m.start() : decoder.raw_decode(text, m.start())[1]]
            except ValueError:
                pass
        return None

    return texts.map(one)


def extract_json(c: Column) -> Column:
    """A JSON value in a reply: all of it, what stands in a fence, or the first object or array that can be decoded; null if there is none.

    Where a value that begins somewhere ends, no built-in function tells: texts without the first two, and only those, go through Arrow.
    """
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)

    def ok(x: Column) -> Column:
        # the parser overlooks what follows a value; within two kinds of brackets it can't
        listed, named = F.concat(F.lit("["), x, F.lit("]")), F.concat(F.lit('{"v":'), x, F.lit("}"))
        return F.when((F.trim(x) != "") & F.try_parse_json(listed).isNotNull() & F.try_parse_json(named).isNotNull(), x)

    plain = F.coalesce(ok(c), ok(fenced))
    return F.coalesce(plain, F.pandas_udf(_first_value, "string")(F.when(plain.isNull(), c)))
