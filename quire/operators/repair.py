"""Near-miss quotations are mapped to exact spans of their source.

Tiers: literal; folded (marks, dashes, ligatures, white space); folded without case and Greek; between the quotation's head and tail; the longest run of at
least ``LONGEST`` characters from either end. What comes out is always a substring of the source, or the quotation as it was. Quotations
under ``SHORTEST`` characters are never guessed. Null quotations and sources give outcome "lost"; an empty quotation is one too.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

SHORTEST, LONGEST, HEAD, TAIL, STRETCH = 10, 40, 40, 30, 1.6
_MARKS = dict(zip(T.MARKS_FROM, T.MARKS_TO, strict=True)) | dict(T.LIGATURES)
_LOOSE = dict(zip(T.LOOSE_FROM, T.LOOSE_TO, strict=True))
_HIDDEN = {chr(c) for c in [*range(0, 9), *range(11, 32), *range(127, 160), 0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF]}


def folded(text: str, loose: bool = False) -> tuple[str, list[int]]:
    """The folded text, and for each of its characters where it comes from."""
    out: list[str] = []
    at: list[int] = []
    for i, c in enumerate(text):
        if c in _HIDDEN:
            continue
        if c.isspace():
            if out and out[-1] != " ":
                out.append(" ")
                at.append(i)
            continue
        for x in _MARKS.get(c, c):
            out.append(_LOOSE.get(x, x).lower() if loose else x)
            at.append(i)
    return "".join(out), at


def _whole(source: str, start: int, end: int) -> str:
    """A span widened or narrowed to whole words at its ends."""
    while start < end and start > 0 and source[start - 1].isalnum() and source[start].isalnum():
        start += 1
    while end > start and end < len(source) and source[end - 1].isalnum() and source[end].isalnum():
        end -= 1
    return source[start:end].strip()


def repair(quote: str | None, source: str | None) -> tuple[str | None, str]:
    """The repaired quotation and by which tier."""
    if not quote or not source:
        return quote, "lost"
    if quote in source:
        return quote, "exact"
    if len(quote) < SHORTEST:
        return quote, "lost"
    for loose, name in ((False, "folded"), (True, "loose")):
        text, at = folded(source, loose)
        q = folded(quote, loose)[0].strip()
        if len(q) < SHORTEST:
            continue
        k = text.find(q)
        if k >= 0:
            return source[at[k] : at[k + len(q) - 1] + 1], name
        i = text.find(q[:HEAD])
        j = text.find(q[-TAIL:], i) if i >= 0 else -1
        if i >= 0 and j >= 0 and j + min(TAIL, len(q)) - i <= STRETCH * len(q):
            return source[at[i] : at[j + len(q[-TAIL:]) - 1] + 1], "anchored"
    best: tuple[int, int, int] | None = None
    for from_start in (True, False):
        # the longest prefix (suffix) that occurs: whether one of length n does is monotonic in n
        low, high = 0, len(q)
        while low < high:
            n = (low + high + 1) // 2
            if (q[:n] if from_start else q[-n:]) in text:
                low = n
            else:
                high = n - 1
        if low >= LONGEST and (best is None or low > best[0]):
            k = text.find(q[:low] if from_start else q[-low:])
            best = low, at[k], at[k + low - 1] + 1
    if best:
        span = _whole(source, best[1], best[2])
        if len(span) >= LONGEST:
            return span, "run"
    return quote, "lost"


def repaired(rows: DataFrame, quote: str, source: str) -> DataFrame:
    """rows with repaired and tier. Literal hits never leave the JVM's side of the plan as work: their tier is settled at the first test."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pairs = [repair(q, s) for q, s in zip(b[quote], b[source], strict=True)]
            yield b.assign(repaired=[p[0] for p in pairs], tier=[p[1] for p in pairs])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", repaired string, tier string"
    hit = F.coalesce((F.col(quote) != "") & F.contains(F.col(source), F.col(quote)), F.lit(False))
    exact = rows.where(hit).withColumn("repaired", F.col(quote)).withColumn("tier", F.lit("exact"))
    return exact.unionByName(rows.where(~hit).mapInPandas(run, schema))
