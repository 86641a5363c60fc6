"""Embedding near-duplicates by an inverted multi-index.

Unit vectors are halved; each half has a codebook of its own (k-means), and pairs of codewords are the cells of a product grid. Every vector is
indexed in one cell. A query visits cells in ascending order of the sum of its halves' bounds (the order in which the multi-sequence algorithm
yields them) and stops where that sum exceeds the squared distance of a link; what it finds is verified by cosine in double precision. The bound of
a half: whoever lives with codeword c is on c's side of the plane between c and the query's own codeword o, so no nearer to the query than that plane,
(d(x, c)^2 - d(x, o)^2) / (2 |c - o|). No cell that can hold a link is left out, so links are exact, whatever the codebooks.
A pair in different cells is compared once, in the later one, and counts for both.

Only vectors of equal label and length are compared. Vectors that are null, zero, or hold null or non-finite components, and those with a null label, link with
nothing and are components of their own. Equal vectors are one class (their cosine is 1), so a vector that fills a third of the table is compared
once. Large cells are split into blocks over many tasks. Rows are told apart by vec_id alone when components are named: rows that repeat a vec_id
have one component. An empty table gives an empty result; extra columns are ignored.

Bounds of the fit, which settles what is cheap and never what is found: ``SAMPLE`` classes train the codebooks, ``QUERIES`` of them settle how many codewords
there are; every class is indexed and queried. Where vectors have no clusters nearly all cells are visited, and the work is that of all pairs of a label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import pick, stored, width
from quire.llm.graph import by_group, components, forest

COSINE, SAMPLE, QUERIES, BLOCK = 0.93, 20_000, 400, 2000
#: What a visit costs in comparisons. Slack of the bound, far above what rounding can add; codewords nearer than NEAR give no bound.
VISIT, SLACK, NEAR = 500, 1e-6, 1e-4


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; they are scaled by their largest component first, so that squares neither overflow nor vanish."""
    with np.errstate(under="ignore"):
        scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
        return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


class Grid:
    """Codebooks of the two halves, and the squared distance within which cells are visited."""

    def __init__(self, first: np.ndarray, second: np.ndarray, reach: float):
        self.books, self.reach = (first, second), reach
        self.gaps = [np.sqrt(np.maximum(self.distances(book, book), 0)) for book in self.books]

    @staticmethod
    def trained(sample: np.ndarray, codewords: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
        half = sample.shape[1] // 2
        books = []
        for k, part in enumerate((sample[:, :half], sample[:, half:])):
            rng = np.random.default_rng(k)
            book = part[rng.choice(len(part), min(codewords, len(part)), replace=False)].copy()
            for _ in range(rounds):
                own = Grid.distances(part, book).argmin(axis=1)
                sums = np.zeros_like(book)
                np.add.at(sums, own, part)
                n = np.bincount(own, minlength=len(book))
                book[n > 0] = sums[n > 0] / n[n > 0, None]
            # equal codewords would be cells of nothing
            books.append(np.unique(book, axis=0) if part.shape[1] else book[:1])
        return books[0], books[1]

    @staticmethod
    def distances(part: np.ndarray, book: np.ndarray) -> np.ndarray:
        return (part**2).sum(axis=1)[:, None] - 2 * part @ book.T + (book**2).sum(axis=1)[None, :]

    def far(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = len(self.books[0][0])
        return self.distances(vectors[:, :half], self.books[0]), self.distances(vectors[:, half:], self.books[1])

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        one, two = self.far(vectors)
        return one.argmin(axis=1) * len(self.books[1]) + two.argmin(axis=1)

    def least(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each half, the squared distance below which no vector that lives with a codeword can be."""
        out = []
        for far, gap in zip(self.far(vectors), self.gaps, strict=True):
            own = far.argmin(axis=1)
            between = gap[own]
            margin = (far - far[np.arange(len(far)), own][:, None]) / (2 * np.maximum(between, NEAR))
            out.append(np.where(between > NEAR, np.maximum(margin, 0), 0) ** 2)
        return out[0], out[1]

    def visited(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a vector's number and a cell that can hold a link of it."""
        one, two = self.least(vectors)
        row, cell = [], []
        for at in range(0, len(vectors), step := max(1, 4_000_000 // (one.shape[1] * two.shape[1]))):
            r, a, b = np.nonzero(one[at : at + step, :, None] + two[at : at + step, None, :] <= self.reach)
            row.append(at + r)
            cell.append(a * two.shape[1] + b)
        return np.concatenate(row), np.concatenate(cell)


def _array(column, dim: int) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dim).astype(np.float64)


def near_vectors(rows: DataFrame, cosine: float = COSINE, key: str = "vec_id", label: str = "label", vector: str = "embedding") -> tuple[DataFrame, list[dict]]:
    """vec_id, n_links, component_id, kept for every row; and per vector length the codewords and the visits of a vector, as the sample has them; recall is 1 by the bound."""
    base = pick(rows, key, label, vector).select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    sound = F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    # 0.0 + x: minus zero is zero
    plain = F.transform("vector", lambda x: x + F.lit(0.0))
    # two hashes stand for a class from here on, so that vectors are shuffled no oftener than they are compared
    node, check = F.xxhash64("label", "vector").alias("node"), F.xxhash64(F.lit(5), "vector", "label").alias("check")
    known = base.where(F.coalesce(sound, F.lit(False))).select("vec_id", "label", plain.alias("vector"))
    classes = known.groupBy("label", "vector").agg(F.min("vec_id").alias("lead"), F.count(F.lit(1)).alias("copies"))
    classes = stored(classes.select("*", F.size("vector").alias("dim"), node, check), "vectors")
    parts = width(base)
    links, edges, told = [], [], []
    for dim, n, most in sorted((r["dim"], r["n"], r["most"]) for r in classes.groupBy("dim", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("dim").agg(F.sum("c").alias("n"), F.max("c").alias("most")).collect()):
        found, info = _links(classes.where(F.col("dim") == dim), dim, most, cosine, parts)
        links.append(found.where("links > 0").select("node", "links"))
        edges.append(found.where("links = 0").select(F.col("node").alias("a"), F.col("other").alias("b")))
        told.append(info | {"dim": dim, "classes": n})
    if not links:
        none = base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
        return none, told
    for other in links[1:]:
        links[0] = links[0].unionByName(other)
    for other in edges[1:]:
        edges[0] = edges[0].unionByName(other)
    joined = components(edges[0])
    class_of = joined.join(classes.select("node", "lead"), "node").groupBy("component").agg(F.min("lead").alias("component_id")).join(joined, "component").select("node", "component_id")
    per_class = (
        classes.select("node", "check", "lead", "copies").join(links[0].groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(class_of, "node", "left")
        .select("node", "check", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "lead").alias("component_id"))
    )
    rows_ = base.withColumn("vector", F.when(F.coalesce(sound, F.lit(False)), plain)).select("vec_id", F.when(F.col("vector").isNotNull(), node).alias("node"), F.when(F.col("vector").isNotNull(), check).alias("check"))
    whole = rows_.join(per_class, ["node", "check"], "left")
    return whole.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"),
    ), told


def _links(classes: DataFrame, dim: int, most: int, cosine: float, parts: int) -> tuple[DataFrame, dict]:
    """node, links, other: link counts (links > 0), and links that hold components together (links = 0)."""
    order = F.xxhash64("node", F.lit(3))
    sample = classes.select("node", "label", "vector").orderBy(order, "node").limit(SAMPLE).toPandas()
    vectors = unit(np.stack([np.asarray(v, np.float64) for v in sample["vector"]]))
    # |x - y|^2 = 2 - 2 cosine of unit vectors
    reach = 2 - 2 * cosine + SLACK
    # no more cells than give about 32 classes of the largest label to each; of 1, 2, 4, ... codewords those with the least work, as the sample shows it
    best, codewords = None, 1
    while codewords <= min(256, max(2, round((most / 32) ** 0.5))):
        tried = Grid(*Grid.trained(vectors, codewords), reach)
        share = np.bincount(tried.cells(vectors)) / len(vectors)
        row, cell = tried.visited(vectors[:QUERIES])
        queries = min(QUERIES, len(vectors))
        work = (VISIT * len(row) + most * np.where(cell < len(share), share[np.minimum(cell, len(share) - 1)], 0).sum()) / queries
        if best is None or work < best[0]:
            best = work, tried, len(row) / queries
        codewords *= 2
    _, grid, visits = best

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each class, a row for the cell it lives in and every later one that it visits."""
        for b in batches:
            # so many at a time as memory holds
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                x = unit(_array(part.column(2), dim))
                own = grid.cells(x)
                row, cell = grid.visited(x)
                later = cell > own[row]
                row, cell = np.concatenate([np.arange(len(x)), row[later]]), np.concatenate([own, cell[later]])
                lives = np.arange(len(row)) < len(x)
                for low in range(0, len(row), 10_000):
                    r = row[low : low + 10_000]
                    vectors_ = pa.FixedSizeListArray.from_arrays(pa.array(x[r].ravel()), dim).cast(pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(1).take(pa.array(r)), pa.array(cell[low : low + 10_000].astype(np.int32)), pa.array(lives[low : low + 10_000]), part.column(0).take(pa.array(r)), part.column(3).take(pa.array(r)), vectors_],
                        names=["label", "cell", "lives", "node", "copies", "vector"],
                    )

    placed = stored(classes.select("node", "label", "vector", "copies").mapInArrow(place, "label string, cell int, lives boolean, node long, copies long, vector array<double>"), "cells")
    # a large cell: its dwellers and its visitors are each cut into blocks, and every pair of blocks is a unit of work
    size = placed.groupBy("label", "cell").agg(F.count_if("lives").alias("n_in"), F.count(F.lit(1)).alias("n_all")).where(f"n_all > {BLOCK}")
    size = size.select("label", "cell", F.greatest(F.lit(1), F.ceil(F.col("n_in") / BLOCK)).cast("int").alias("ins"), F.ceil(F.col("n_all") / BLOCK).cast("int").alias("alls"))
    cut = placed.join(size, ["label", "cell"], "left").withColumn("ins", F.coalesce("ins", F.lit(1))).withColumn("alls", F.coalesce("alls", F.lit(1)))
    number = F.pmod(F.xxhash64("node"), F.lit(1 << 30))
    dwell = cut.where("lives").withColumn("block_in", (number % F.col("ins")).cast("int")).withColumn("block_all", F.explode(F.sequence(F.lit(0), F.col("alls") - 1))).withColumn("side", F.lit(0))
    visit = cut.withColumn("block_all", (number % F.col("alls")).cast("int")).withColumn("block_in", F.explode(F.sequence(F.lit(0), F.col("ins") - 1))).withColumn("side", F.lit(1))
    units = dwell.unionByName(visit).drop("ins", "alls")

    def link(table: pa.Table) -> pa.RecordBatch | None:
        side = table.column("side").to_numpy()
        d, v = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(d) or not len(v):
            return None
        x = _array(table.column("vector"), dim)
        node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        lives = table.column("lives").to_numpy(zero_copy_only=False)
        p, q = [], []
        for at in range(0, len(v), 1000):
            # products in double precision; of each pair the same sum from either side
            i, j = np.nonzero(x[v[at : at + 1000]] @ x[d].T >= cosine - 1e-9)
            p.append(v[at + i])
            q.append(d[j])
        p, q = np.concatenate(p), np.concatenate(q)
        keep = node[p] != node[q]
        p, q = p[keep], q[keep]
        low, high = np.where(node[p] < node[q], p, q), np.where(node[p] < node[q], q, p)
        sure = np.concatenate([np.einsum("ij,ij->i", x[low[k : k + 100_000]], x[high[k : k + 100_000]]) >= cosine for k in range(0, len(p), 100_000)]) if len(p) else np.zeros(0, bool)
        p, q = p[sure], q[sure]
        if not len(p):
            return None
        # the visitor counts the dweller; one from an earlier cell is not visited in turn, so the dweller's count is settled here, too
        guest = ~lives[p]
        links = np.bincount(p, copies[q], len(node)) + np.bincount(q[guest], copies[p[guest]], len(node))
        seen_ = np.flatnonzero(links)
        number_ = {n: k for k, n in enumerate(dict.fromkeys(node.tolist()))}
        names = list(number_)
        kept = forest(len(names), np.array([number_[n] for n in node[p].tolist()]), np.array([number_[n] for n in node[q].tolist()]))
        a, b = [names[i] for i, _ in kept], [names[j] for _, j in kept]
        return pa.RecordBatch.from_arrays(
            [pa.array([*node[seen_].tolist(), *a], pa.int64()), pa.array([*links[seen_].astype(np.int64).tolist(), *[0] * len(a)], pa.int64()), pa.array([*node[seen_].tolist(), *b], pa.int64())], names=["node", "links", "other"],
        )

    found = by_group(units, ["label", "cell", "block_in", "block_all"], link, "node long, links long, other long", parts)
    return stored(found, "vector-links"), {"codewords": len(grid.books[0]), "cells": len(grid.books[0]) * len(grid.books[1]), "visits": visits, "recall": 1.0}


def op7_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))[0]


#: All pairs of a label; components by closure. For small tables.
ORACLE_SQL = f"""WITH RECURSIVE e AS (SELECT row_number() OVER () AS r, vec_id, CAST(label AS VARCHAR) AS label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ok AS (SELECT * FROM e WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.r AS a, b.r AS b, b.vec_id FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r
  WHERE CASE WHEN len(a.v) = len(b.v) THEN list_cosine_similarity(a.v, b.v) >= {COSINE} ELSE false END),
reach AS (SELECT DISTINCT a AS s, a AS t FROM l UNION SELECT s, b FROM reach JOIN l ON a = t),
low AS (SELECT s, min(vec_id) AS component_id FROM reach JOIN e ON r = t GROUP BY s),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(coalesce(component_id, vec_id) = vec_id, false) AS kept
FROM e LEFT JOIN n ON a = r LEFT JOIN low ON s = r"""
