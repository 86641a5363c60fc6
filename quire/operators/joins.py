"""Joins that the data model needs beyond plain equi-joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of the anchor by which a quotation is looked up.
ANCHOR = 3
#: Rows that are broadcast at once, at most; more are dealt into blocks of about so many.
BLOCK = 20_000


def _anchor_words(c):
    return F.filter(F.split(c, r"[ \n]"), lambda w: w != "")


def _blocks(rows: DataFrame, *keys: str) -> list[DataFrame]:
    """rows as parts that may be broadcast: their count is taken first."""
    n = -(-rows.count() // BLOCK)
    part = F.pmod(F.xxhash64(*keys), F.lit(max(n, 1)))
    return [rows] if n == 1 else [rows.where(part == i) for i in range(n)]


def contains_join(texts: DataFrame, quotes: DataFrame, text: str = "text", quote: str = "quote", key: str = "doc_id", quote_key: str = "quote_id") -> DataFrame:
    """(key, quote_key) of every text that contains a quotation literally.

    A quotation's inner words (its first and last may be cut) stand in the text in the same order, so ``ANCHOR`` of them are an equi-join key; what is found
    is verified literally. Quotations too short for an anchor are compared with every text, a counted block of them at a time; empty ones never match.
    """
    words = _anchor_words(F.col(quote))
    q = quotes.select(F.col(quote_key), F.col(quote).alias("_quote")).withColumn("_words", _anchor_words(F.col("_quote"))).where("_quote <> ''")
    long_ = q.where(F.size("_words") >= ANCHOR + 2).withColumn("_anchor", F.array_join(F.slice("_words", 2, ANCHOR), " "))
    t = texts.select(F.col(key), F.col(text).alias("_text"))
    w = _anchor_words(F.col("_text"))
    starts = F.when(F.size("_words") >= ANCHOR, F.sequence(F.lit(1), F.size("_words") - (ANCHOR - 1))).otherwise(F.array().cast("array<int>"))
    grams = t.select(key, w.alias("_words")).select(key, F.explode(F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice("_words", i, ANCHOR), " ")))).alias("_anchor"))
    # keys only are shuffled; texts come back for the few candidates
    candidates = grams.join(long_.select(quote_key, "_anchor"), "_anchor").select(key, quote_key).distinct()
    found = candidates.join(long_.select(quote_key, "_quote"), quote_key).join(t, key).where(F.contains("_text", F.col("_quote"))).select(key, quote_key)
    short = q.where(F.size("_words") < ANCHOR + 2)
    for block in _blocks(short.select(quote_key, "_quote"), quote_key, "_quote"):
        found = found.unionByName(t.join(F.broadcast(block), F.contains(F.col("_text"), F.col("_quote"))).select(key, quote_key))
    return found.distinct()


def nearest(left: DataFrame, right: DataFrame, words_left: str, words_right: str, key: str, other: str) -> DataFrame:
    """For every left row the right row that shares most words (the smallest key of equals; score 0 gives the smallest of all)."""
    a = left.select(key, F.explode(F.array_distinct(words_left)).alias("_w"))
    b = right.select(other, F.explode(F.array_distinct(words_right)).alias("_w"))
    score = a.join(b, "_w").groupBy(key, other).agg(F.count(F.lit(1)).alias("score"))
    best = score.groupBy(key).agg(F.max_by(F.struct(other, "score"), F.struct("score", -F.col(other))).alias("_best"))
    smallest = right.agg(F.min(other).alias("_least"))
    return left.select(key).join(best, key, "left").crossJoin(F.broadcast(smallest)).select(
        key, F.coalesce(F.col(f"_best.{other}"), F.col("_least")).alias(other), F.coalesce("_best.score", F.lit(0)).alias("score"),
    )


def diff(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows that one side lacks or that differ: keys, outcome (added, removed, changed)."""
    x, y = a.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_in_a")), b.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    both = x.join(y, keys, "full_outer")
    outcome = F.when(F.col("_in_b").isNull(), "removed").when(F.col("_in_a").isNull(), "added").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return both.select(*keys, outcome.alias("outcome")).where("outcome is not null")


def upsert(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """base with new's rows in place of those with the same keys."""
    return base.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def missing_cells(rows: DataFrame, cols: DataFrame, cells: DataFrame, row: str, col: str) -> DataFrame:
    """Pairs of a row and a column without a cell: the grid is as large as the result has to be complete. Columns are counted; they are broadcast in blocks."""
    r, have = rows.select(row).distinct(), cells.select(row, col)
    parts = _blocks(cols.select(col).distinct(), col) or [cols.select(col).where("false")]
    return reduce(DataFrame.unionByName, [r.join(F.broadcast(p)).join(have, [row, col], "left_anti") for p in parts])


def ordered(known: DataFrame, wanted: DataFrame, key: str, place: str, want: str) -> DataFrame:
    """known in the order that was asked for; what wasn't asked for keeps its order behind it."""
    return known.join(wanted, key, "left").select(key, F.struct(F.col(want).isNull(), F.coalesce(want, place)).alias("_o")).select(key, F.col("_o.col1").alias("behind"), F.col("_o.col2").alias("place"))
