"""Connected components over DataFrames of links, and the splitting of groups into blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import dropped, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest member) for every node that has an edge to another.

    Alternating large-star and small-star steps: every round hooks all larger neighbours of a node, then all smaller ones, to its
    smallest neighbour, so the number of rounds grows with the logarithm of the longest chain. Minima are aggregated
    before they are shuffled; a hub's edges are joined by AQE's skew handling. Each round is a table in the shared folder. No edges: no rows.
    """
    now = stored(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        now, old = stored(small, "edges"), now
        dropped(old)
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == mark:
            break
        mark = found
    tops = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)


def forest(n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Of links between 0 .. n-1, as few as hold the same components together."""
    parent = list(range(n))
    kept = []
    for i, j in zip(left.tolist(), right.tolist(), strict=True):
        x, y = i, j
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((i, j))
    return kept


def paired_blocks(rows: DataFrame, keys: list[str], weight: str, most: int) -> DataFrame:
    """rows, each once for every pair of blocks that its block is in, with columns block_x, block_y (x <= y) and own_block.

    A group (rows of equal keys) whose weights add up to more than ``most`` is split evenly, by a hash of the whole row, into
    blocks; a unit of work is a pair of blocks, so no task ever holds more than two of them, however large a group
    is. Most groups are one block, and their rows stay as they are.
    """
    large = rows.groupBy(*keys).agg(F.sum(weight).alias("_weight")).where(F.col("_weight") > most).select(*keys, F.ceil(F.col("_weight") / most).cast("int").alias("_blocks"))
    return split(rows.join(large, keys, "left"), keys, F.coalesce("_blocks", F.lit(1))).drop("_blocks")


def split(rows: DataFrame, keys: list[str], blocks: Column) -> DataFrame:
    """rows, each once for every pair of blocks that its block is in, as ``paired_blocks`` has them; blocks: how many the row's group is split into."""
    columns = [c for c in rows.columns if c not in keys and not c.startswith("_")]
    counted = rows.withColumn("_blocks", blocks)
    own = counted.withColumn("own_block", F.pmod(F.xxhash64(*columns), F.col("_blocks")).cast("int"))
    spread = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return spread.withColumn("block_x", F.least("own_block", "_other")).withColumn("block_y", F.greatest("own_block", "_other")).drop("_blocks", "_other")


def by_group(rows: DataFrame, keys: list[str], work: Callable[[pa.Table], pa.RecordBatch | None], schema: str, parts: int) -> DataFrame:
    """work on the rows of each group of equal keys. Groups must be of bounded size (see paired_blocks); one at a time is in memory."""
    names = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            columns = [b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in names]
            change = np.zeros(b.num_rows, bool)
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
            first = tuple(c[0] for c in columns)
            for n, (low, high) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if rest and (n > 0 or first != last):
                    if out := work(pa.Table.from_batches(rest)):
                        yield out
                    rest = []
                rest.append(b.slice(low, high - low))
            last = tuple(c[-1] for c in columns)
        if rest and (out := work(pa.Table.from_batches(rest))):
            yield out

    return rows.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
