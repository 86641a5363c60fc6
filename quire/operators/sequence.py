"""Order-sensitive operators: windows, islands, folds, first- and best-wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _over(keys: list[str], *order) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Physical lines with their place from 0."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def first_wins(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(_over(keys, *order))).where("_n = 1").drop("_n")


def numbered(rows: DataFrame, base: Column, keys: list[str], *order, name: str = "id") -> DataFrame:
    """Repeats of a slug get -2, -3, ... in order."""
    n = F.row_number().over(Window.partitionBy(*keys, base).orderBy(*order))
    return rows.withColumn(name, F.when(n == 1, base).otherwise(F.concat(base, F.lit("-"), n.cast("string"))))


def carried(rows: DataFrame, keys: list[str], value: Column, when: Column, name: str, *order) -> DataFrame:
    """The last value for which ``when`` held, up to the row before."""
    frame = _over(keys, *order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(F.when(when, value), ignorenulls=True).over(frame))


def islands(rows: DataFrame, keys: list[str], breaks: Column, name: str, *order) -> DataFrame:
    """A running number that goes up wherever ``breaks`` holds."""
    w = _over(keys, *order)
    return rows.withColumn(name, F.sum(F.when(breaks, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def hyphen_pairs(tokens: DataFrame, keys: list[str], token: str, order: str) -> DataFrame:
    """Tokens that end in a hyphen are joined with the next one, in pairs that don't overlap: within a run of such tokens those in odd places start a pair."""
    w = _over(keys, order)
    t = F.col(token)
    ends = t.endswith("-") & (F.length(t) > 1)
    marked = tokens.withColumn("_ends", ends).withColumn("_next", F.lead(token).over(w))
    run = islands(marked, keys, ~F.col("_ends"), "_run", order)
    # a run is a token that doesn't end in a hyphen and the hyphen-enders after it
    place = F.row_number().over(_over([*keys, "_run"], order))
    lead = F.when(F.first("_ends").over(_over([*keys, "_run"], order)), place).otherwise(place - 1)
    placed = run.withColumn("_odd", F.col("_ends") & (lead % 2 == 1) & F.col("_next").isNotNull())
    taken = F.coalesce(F.lag("_odd").over(w), F.lit(False))
    return (
        placed.withColumn("_taken", taken).where(~F.col("_taken"))
        .withColumn("merged", F.when(F.col("_odd"), F.concat(F.expr(f"left({token}, length({token}) - 1)"), F.col("_next"))).otherwise(t))
        .drop("_ends", "_next", "_run", "_odd", "_taken")
    )


def merged_stubs(items: Column, least: int = 900) -> Column:
    """Strings of an array put together until they are long enough; a short last one stays."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("now"))

    def step(a: Column, s: Column) -> Column:
        now = F.when(a["now"] == "", s).otherwise(F.concat(a["now"], F.lit(" "), s))
        return F.when(F.length(now) >= least, F.struct(F.array_append(a["out"], now).alias("out"), F.lit("").alias("now"))).otherwise(F.struct(a["out"].alias("out"), now.alias("now")))

    return F.aggregate(items, start, step, lambda a: F.when(a["now"] == "", a["out"]).otherwise(F.array_append(a["out"], a["now"])))


def upper_median(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """keys, name: the element in the middle of each group, the upper one of two; nulls don't count. Values are counted before they are shuffled, so a group is as large as its different values."""
    return rows.groupBy(*keys).agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{value}` DESC)").alias(name))


def argmax(rows: DataFrame, keys: list[str], value: str, *best) -> DataFrame:
    """The value whose ``best`` tuple is greatest in each group."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*best)).alias(value))


def positions(rows: DataFrame, by: str, buckets: int = 64) -> DataFrame:
    """rows with their places from 1 in the order of a number: up, and down from the greatest; nulls come last in both.

    Rows are ranked within ranges of values, and a range begins where the counts of those before it end, so no window spans the table.
    The rows of one value are in one range; their order among themselves is that of a hash.
    """
    cuts = sorted(set(rows.approxQuantile(by, [k / buckets for k in range(1, buckets)], 0.001)))
    bucket = F.when(F.col(by).isNull(), len(cuts) + 1).otherwise(sum((F.when(F.col(by) > c, 1).otherwise(0) for c in cuts), F.lit(0)))
    dealt = rows.withColumn("_bucket", bucket)
    known, base = 0, []
    for r in sorted(dealt.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"), F.count(by).alias("known")).collect()):
        base.append((r["_bucket"], sum(n for _, _, n in base), r["n"]))
        known += r["known"]
    before = reduce(lambda c, b: c.when(F.col("_bucket") == b[0], b[1]), base, F.when(F.lit(False), 0))
    up = F.row_number().over(Window.partitionBy("_bucket").orderBy(by, F.xxhash64(*rows.columns))) + before
    return dealt.withColumn("up", up.cast("long")).withColumn("down", F.when(F.col(by).isNull(), F.col("up")).otherwise(known + 1 - F.col("up"))).drop("_bucket")
