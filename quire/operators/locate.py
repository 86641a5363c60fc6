"""Phrases on pages: runs of tokens found in runs of tokens, and their rectangles joined row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def token_like(a: Column, b: Column) -> Column:
    """Equal, or one a beginning of the other and longer than 4 characters."""
    return (a == b) | ((F.length(b) > 4) & F.startswith(a, b)) | ((F.length(a) > 4) & F.startswith(b, a))


def find_runs(tokens: DataFrame, phrases: DataFrame, page: str = "page", most: int = 3) -> DataFrame:
    """phrase_id, page, pos of up to ``most`` hits a page. tokens: page, pos, token; phrases: phrase_id, words array.

    The first five characters of the first word (or all of a shorter one) are the key of the join; the other words are compared in place.
    """
    longest = phrases.agg(F.max(F.size("words")).alias("n"))
    w = Window.partitionBy(page).orderBy("pos")
    n = longest.first()["n"] or 0
    row = tokens.withColumn("run", F.array(*[F.lead("token", k).over(w) for k in range(n)])) if n else tokens.withColumn("run", F.array("token"))
    keyed = row.withColumn("_k", F.explode(F.array_distinct(F.array("token", F.left("token", F.lit(5))))))
    first = F.element_at("words", 1)
    wanted = phrases.where(F.size("words") > 0).withColumn("_k", F.explode(F.array_distinct(F.array(first, F.left(first, F.lit(5))))))
    ok = F.forall(F.sequence(F.lit(1), F.size("words")), lambda i: F.coalesce(token_like(F.element_at("run", i), F.element_at("words", i)), F.lit(False)))
    hits = keyed.join(wanted, "_k").where(ok).select("phrase_id", page, "pos").distinct()
    order = Window.partitionBy("phrase_id", page).orderBy("pos")
    return hits.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def joined_rects(rects: DataFrame, keys: list[str], gap: float = 2.5) -> DataFrame:
    """Rectangles (x0, y0, x1, y1) of one row (equal rounded y0) with gaps up to ``gap`` become one."""
    row = [*keys, "_row"]
    w = Window.partitionBy(*row).orderBy("x0")
    marked = rects.withColumn("_row", F.round("y0", 0)).withColumn("_new", F.coalesce(F.col("x0") - F.lag("x1").over(w) > gap, F.lit(True)).cast("int"))
    island = marked.withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*row, "_i").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).drop("_row", "_i")
