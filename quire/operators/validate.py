"""The gate: every rule is a query for its violations, and a report is their union: (owner, severity, rule, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def broken(rows: DataFrame, owner: str, when: Column, severity: str, rule: str, detail: Column) -> DataFrame:
    return rows.where(when).select(F.col(owner).cast("string").alias("owner"), F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))


def enum(rows: DataFrame, owner: str, column: str, allowed, rule: str) -> DataFrame:
    """Values outside an enumeration; null is outside."""
    return broken(rows, owner, ~F.coalesce(F.col(column).isin(*allowed), F.lit(False)), "error", rule, F.coalesce(column, F.lit("")))


def duplicates(rows: DataFrame, owner: str, keys: list[str], rule: str) -> DataFrame:
    """One error for every repetition."""
    counted = rows.groupBy(owner, *keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    each = counted.withColumn("_", F.explode(F.sequence(F.lit(2), F.col("n").cast("int"))))
    return broken(each, owner, F.lit(True), "error", rule, F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))


def dangling(edges: DataFrame, nodes: DataFrame, owner: str, end: str, node: str, rule: str) -> DataFrame:
    """Edge ends that name no node of the same owner; a missing end is one too."""
    known = nodes.select(owner, F.col(node).alias(end)).distinct()
    lost = edges.select(owner, end).join(known, [owner, end], "left_anti")  # a null end meets nothing, so it stays
    return broken(lost, owner, F.lit(True), "error", rule, F.coalesce(F.col(end).cast("string"), F.lit("")))


def cycles(edges: DataFrame, owner: str, a: str, b: str) -> DataFrame:
    """(owner, node) on or behind a cycle: nodes without an incoming edge are peeled off until none is left or nothing changes.

    Each round is one semi-join; as many rounds as the longest path is long. Give the session a folder for checkpoints: without one the
    plan grows with every round.
    """
    left = edges.select(owner, F.col(a).alias("a"), F.col(b).alias("b")).distinct()
    count = left.count()
    while count:
        into = left.select(owner, F.col("b").alias("a")).distinct()
        left = left.join(into, [owner, "a"], "left_semi")
        left = left.checkpoint() if edges.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else left
        now = left.count()
        if now == count:
            break
        count = now
    return left.select(owner, F.col("a").alias("node")).unionByName(left.select(owner, F.col("b").alias("node"))).distinct()


def totals(violations: DataFrame) -> DataFrame:
    """Errors and warnings per owner, and over all (owner null)."""
    return violations.rollup("owner").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))


def budget(chars: Column, n_sentences: Column) -> tuple[Column, Column]:
    """How many nodes and views a section may have."""
    nodes = F.greatest(F.lit(3), F.least(F.lit(14), n_sentences))
    views = F.when((chars < 1600) | (n_sentences < 10), 1).when(chars < 6000, F.when(n_sentences >= 22, 3).otherwise(2)).otherwise(6)
    return nodes, views
