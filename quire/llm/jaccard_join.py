"""N-gram Jaccard join: links between documents whose sets of word 5-grams have a Jaccard similarity of 0.8 or more.

1. Documents with equal shingle sets form a class; from here on only classes are compared.
2. MinHash signatures (``HASHES`` values) are cut into bands of ``ROWS`` values; classes that share a band are candidates. A pair at the threshold
   shares none with probability (1 - 0.8 ** ROWS) ** (HASHES / ROWS), 5e-8.
3. Bayesian pruning: MinHash values of a pair are compared ``STEP_`` at a time. With m of n equal and a flat prior, similarity is Beta(m + 1, n - m + 1); when
   its mass at or over the threshold falls below ``TOLERANCE``, the pair is dropped. What remains forms clusters.
4. Within a cluster all pairs go through the same pruning, and those left are verified exactly from their shingle sets.

No pair is ever a row: a task holds two blocks of a bucket or cluster, compares them as matrices, and hands on link counts per class and
the few links that hold components together. Large buckets and clusters are split into blocks over many tasks.

Words are those of ``common.Words``. A document of 1 to 4 words has one shingle, all its words. A document without words (null, empty) links with
nothing. Repeated rows are copies of each other; rows that share a doc_id share its fate. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import Words, mix, pick, steps, stored, width, word_hashes
from quire.llm.graph import by_group, components, forest, paired_blocks, split

SHINGLE, THRESHOLD = 5, 0.8
HASHES, ROWS, STEP_, TOLERANCE = 128, 4, 32, 1e-6
#: Members of a bucket's block; shingles of a cluster's block.
BUCKET_BLOCK, CLUSTER_BLOCK = 1000, 400_000


def shingle_sets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, ascending within it, and the borders between documents."""
    key = mix(word_hashes(words.dictionary))[words.codes] if len(words.dictionary) else np.zeros(0, np.uint64)
    n = words.counts
    width_ = np.minimum(n, SHINGLE)
    per = np.where(n > 0, n - width_ + 1, 0)
    first = words.first[:-1]
    doc = np.repeat(np.arange(len(n)), per)
    at = np.repeat(first - (np.cumsum(per) - per), per) + np.arange(int(per.sum()))
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(SHINGLE):
            inside = j < width_[doc]
            out = np.where(inside, out * np.uint64(0x9E3779B97F4A7C15) + key[np.minimum(at + j, max(len(key) - 1, 0))] if len(key) else out, out)
    out = mix(out, 3)
    order = np.lexsort((out, doc))
    out, doc = out[order], doc[order]
    fresh = np.ones(len(out), bool)
    fresh[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    out, doc = out[fresh], doc[fresh]
    return out, np.searchsorted(doc, np.arange(len(n) + 1))


def set_keys(sets: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set (0 for an empty one)."""
    out = []
    for seed in (5, 6):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(sets, seed), dtype=np.uint64)])
        total = sums[cuts[1:]] - sums[cuts[:-1]]
        out.append(np.where(np.diff(cuts) > 0, mix(total + np.diff(cuts).astype(np.uint64), seed), np.uint64(0)).view(np.int64))
    return out[0], out[1]


_rng = np.random.default_rng(20240229)
_TIMES = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_PLUS = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


def signatures(sets: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """MinHash values, a row of HASHES for each set that isn't empty."""
    start = cuts[:-1][np.diff(cuts) > 0]
    if not len(start):
        return np.zeros((0, HASHES), np.uint32)
    x = (sets >> np.uint64(32)).astype(np.uint32) ^ sets.astype(np.uint32)
    out = np.empty((len(start), HASHES), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(HASHES):
            out[:, k] = np.minimum.reduceat((x + _PLUS[k]) * _TIMES[k], start)
    return out


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(n, m): of n compared values at least m must be equal, or the posterior of reaching the threshold is below the tolerance."""
    grid = np.linspace(0, 1, 20_001)
    out = []
    for n in range(STEP_, HASHES + 1, STEP_):
        for m in range(n + 1):
            with np.errstate(divide="ignore", invalid="ignore"):
                log = m * np.log(grid) + (n - m) * np.log1p(-grid) if 0 < m < n else (n * np.log1p(-grid) if m == 0 else n * np.log(grid))
            log = np.nan_to_num(log, nan=-np.inf, neginf=-1e300)
            mass = np.exp(log - log.max())
            if mass[grid >= threshold - 1e-12].sum() / mass.sum() >= tolerance:
                out.append((n, m))
                break
    return out


_LEAST = least_matches()


def survivors(a: np.ndarray, b: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b; within a if b is None) that incremental comparison does not rule out."""
    other = a if b is None else b
    left, right = [], []
    block = max(1, 4_000_000 // (STEP_ * max(1, len(other))))
    n, m = _LEAST[0]
    for at in range(0, len(a), block):
        same = (a[at : at + block, None, :n] == other[None, :, :n]).sum(axis=2, dtype=np.int16)
        i, j = np.nonzero(same >= m)
        i += at
        if b is None:
            i, j = i[i < j], j[i < j]
        left.append(i)
        right.append(j)
    i, j = np.concatenate(left), np.concatenate(right)
    for n, m in _LEAST[1:]:
        keep = np.concatenate([(a[i[k : k + 50_000], :n] == other[j[k : k + 50_000], :n]).sum(axis=1) >= m for k in range(0, len(i), 50_000)]) if len(i) else np.zeros(0, bool)
        i, j = i[keep], j[keep]
    return i, j


def overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets i and j, exactly."""
    if len(i) < 4 * len(sets):
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    # many pairs of few sets: matrix products over the shingles that at least two of them have
    number, where, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = count[where] > 1
    place, owner = (np.cumsum(count > 1) - 1)[where[shared]], owner[shared]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    total, wide = np.zeros((len(sets), len(sets)), np.float32), int(place[-1]) + 1 if len(place) else 0
    for at in range(0, wide, 4096):
        part = slice(*np.searchsorted(place, [at, at + 4096]))
        m = np.zeros((len(sets), min(4096, wide - at)), np.float32)
        m[owner[part], place[part] - at] = 1
        total += m @ m.T
    return total[i, j].astype(np.int64)


def _binary(rows: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * rows.itemsize).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def described(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, node and check (hashes of the shingle set; node is null without words), n_shingles, signature."""
    base = pick(docs, key, text).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in steps(b):
                sets, cuts = shingle_sets(Words(part.column(1)))
                one, two = set_keys(sets, cuts)
                n = np.diff(cuts)
                sig = signatures(sets, cuts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(one, mask=n == 0), pa.array(two), pa.array(n), _binary(sig.ravel(), np.concatenate([[0], np.cumsum(n > 0)]) * HASHES)],
                    names=["doc_id", "node", "check", "n_shingles", "signature"],
                )

    return base.mapInArrow(run, "doc_id long, node long, check long, n_shingles long, signature binary")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray | None]:
    """Rows of block_x, and those of block_y if that is another block."""
    x, y = table.column("block_x")[0].as_py(), table.column("block_y")[0].as_py()
    own = table.column("own_block").to_numpy()
    return (np.flatnonzero(own == x), None) if x == y else (np.flatnonzero(own == x), np.flatnonzero(own == y))


def _pairs(table: pa.Table, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one, two = _sides(table)
    i, j = survivors(sig[one], None if two is None else sig[two])
    return one[i], (one if two is None else two)[j]


def clusters(classes: DataFrame, parts: int) -> DataFrame:
    """node, component over all pairs of classes that share a band and survive pruning (verification comes later)."""

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, HASHES).astype(np.uint64)
            out = np.zeros((len(sig), HASHES // ROWS), np.uint64)
            with np.errstate(over="ignore"):
                for r in range(ROWS):
                    out = out * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::ROWS]
                out = mix(out + np.arange(HASHES // ROWS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64).ravel()), pa.array(np.repeat(b.column(0).to_numpy(), HASHES // ROWS))], names=["band", "node"])

    # counts are combined before they are shuffled; a band that many classes share is split by the join's skew handling, then into blocks
    keys = stored(classes.select("node", "signature").mapInArrow(bands, "band long, node long"), "bands")
    counted = keys.groupBy("band").agg(F.count(F.lit(1)).alias("_weight")).where("_weight > 1")
    found = keys.join(counted, "band")
    blocks = split(found, ["band"], F.ceil(F.col("_weight") / BUCKET_BLOCK).cast("int")).drop("_weight")
    full = blocks.join(classes.select("node", "signature"), "node")

    def link(table: pa.Table) -> pa.RecordBatch | None:
        node = table.column("node").to_numpy()
        i, j = _pairs(table, _matrix(table.column("signature")))
        kept = forest(len(node), i, j)
        if kept:
            a, b = np.array(kept).T
            return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])
        return None

    return components(by_group(full, ["band", "block_x", "block_y"], link, "a long, b long", parts))


def jaccard_links(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, class_id (smallest doc_id of its component of links), n_links (other rows linked directly, copies included), kept (doc_id = class_id)."""
    base = pick(docs, key, text).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts = width(base)
    rows = stored(described(base, "doc_id", "text"), "signatures")
    some = rows.where("node is not null")
    classes = stored(some.groupBy("node", "check", "n_shingles", "signature").agg(F.min("doc_id").alias("lead"), F.count(F.lit(1)).alias("copies")), "classes")
    near = stored(clusters(classes, parts), "clusters")

    # shingle sets, for members of clusters only
    wanted = near.join(classes.select("node", "check", "copies", "signature", "lead", "n_shingles"), "node")
    texts = base.join(wanted, F.col("doc_id") == F.col("lead")).select("component", "node", "check", "copies", "signature", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in steps(b):
                own, cuts = shingle_sets(Words(part.column(5)))
                one, two = set_keys(own, cuts)
                # rows of the same doc_id with another text are not this class
                right = pa.array((one == part.column(1).to_numpy()) & (two == part.column(2).to_numpy()))
                columns = [*part.columns[:2], part.column(3), part.column(4), _binary(own, cuts), pa.array(np.diff(cuts))]
                yield pa.RecordBatch.from_arrays(columns, names=["component", "node", "copies", "signature", "shingles", "size"]).filter(right)

    members = stored(texts.mapInArrow(sets, "component long, node long, copies long, signature binary, shingles binary, size long"), "members")

    def verify(table: pa.Table) -> pa.RecordBatch | None:
        node = table.column("node").to_numpy()
        # equal rows of one doc_id bring a class twice
        table = table.take(np.unique(node, return_index=True)[1])
        node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        i, j = _pairs(table, _matrix(table.column("signature")))
        own = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        size = np.array([len(s) for s in own], np.int64)
        both = overlaps(own, i, j)
        # whole numbers: both / (all - both) >= 4 / 5
        up, down = _FRACTION
        link = both * (up + down) >= up * (size[i] + size[j])
        i, j = i[link], j[link]
        links = np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))
        kept = forest(len(node), i, j)
        a, b = np.array(kept, np.int64).reshape(-1, 2).T
        seen = np.flatnonzero(links)
        if not len(seen):
            return None
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([node[seen], node[a]])), pa.array(np.concatenate([links[seen].astype(np.int64), np.zeros(len(a), np.int64)])), pa.array(np.concatenate([node[seen], node[b]]))], names=["node", "links", "other"],
        )

    blocks = paired_blocks(members, ["component"], "size", CLUSTER_BLOCK)
    found = stored(by_group(blocks, ["component", "block_x", "block_y"], verify, "node long, links long, other long", parts), "links")
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    with_lead = joined.join(classes.groupBy("node").agg(F.min("lead").alias("lead")), "node")
    class_of = with_lead.groupBy("component").agg(F.min("lead").alias("class_id")).join(joined, "component").select("node", "class_id")
    per_class = (
        classes.groupBy("node").agg(F.min("lead").alias("lead"), F.sum("copies").alias("copies")).join(linked, "node", "left").join(class_of, "node", "left")
        .select("node", F.coalesce("class_id", "lead").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    return rows.select("doc_id", "node").join(per_class, "node", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.coalesce("class_id", "doc_id").eqNullSafe(F.col("doc_id"))).alias("kept"),
    )


#: The threshold as a fraction.
_FRACTION = (4, 5)
assert math.isclose(_FRACTION[0] / _FRACTION[1], THRESHOLD)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_links(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Sets of shingles joined shingle by shingle; classes by closure. For small tables.
ORACLE_SQL = r"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT r, array_to_string(list_slice(w, i, i + least(5, len(w)) - 1), ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
size AS (SELECT r, count(*) AS n FROM s GROUP BY r),
pairs AS (SELECT x.r AS a, y.r AS b, count(*) AS n FROM s x JOIN s y ON x.g = y.g AND x.r <> y.r GROUP BY x.r, y.r),
l AS MATERIALIZED (SELECT a, b FROM pairs JOIN size x ON x.r = a JOIN size y ON y.r = b WHERE 9 * pairs.n >= 4 * (x.n + y.n)),
reach AS (SELECT DISTINCT a AS s, a AS t FROM l UNION SELECT s, b FROM reach JOIN l ON a = t),
low AS (SELECT s, min(doc_id) AS class_id FROM reach JOIN d ON r = t GROUP BY s),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, coalesce(class_id, doc_id) IS NOT DISTINCT FROM doc_id AS kept
FROM d LEFT JOIN n ON a = r LEFT JOIN low ON low.s = r"""
