"""Toxicity by non-negative positive-unlabelled learning: confirmed toxic examples plus unlabelled text, no clean examples.

With class prior p, logistic loss l and score g, the risk is ``MISS p E_pos[l(g)] + max(0, E_unl[l(-g)] - p E_pos[l(-g)])``: the unlabelled text stands
for the negatives once the positives' share in it is taken off, and where a batch would make that difference negative, the step goes
the other way instead (so that a flexible model can't drive it below zero). A missed toxic text weighs as ``MISS`` clean ones. p is the toxic share
of the different labelled texts that may be learned from.

Features of a text are the presence of its words and of its words' first 4, 5 and 6 characters, each weighted by its rarity in the unlabelled text.
Those with enough support among the positives and not far commoner in unlabelled text than toxic texts are at all (at most ``FEATURES``) are kept,
whatever they say; numpy classifiers, linear in them, start from nearly zero with different seeds, minimise the risk by proximal steps (a
penalty on absolute weights leaves few of them), and are averaged. Presence, not means over words, so a few words in a very long text count as they do in a short one.

Bounds of the fit: ``POSITIVES`` different toxic texts and ``UNLABELLED`` different texts of any document outside the held-out fold, labelled or not, taken in the order of
a hash of the text. Scoring covers every row's whole text. Null and empty texts have no features and get the score of none; rows without a doc_id
are not learned from; labels that are null, without a document, or repeated (toxic if any says so) do no harm; with no toxic
example to learn from all scores are 0; an empty table gives an empty result; extra columns are kept by ``score``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import Memo, Words, pick, ragged, spelled, steps, stored, unused

POSITIVES, UNLABELLED, FEATURES, FOLDS = 4_000, 8_000, 15_000, 5
#: The least share of the positives that a feature must occur in, and how many times the class prior its share of the unlabelled text may be.
SUPPORT, COMMON = 0.008, 1.5
#: What a missed toxic text weighs, and the penalty on absolute weights (divided by the root of the number of positives).
MISS, PENALTY = 4.0, 0.0084
PREFIXES = (4, 5, 6)


def features_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers (uint32 hashes) of words: the word, and its first 4, 5, 6 characters where it is longer."""
    flat: list[int] = []
    lengths = []
    for w in words:
        text = w.decode(errors="replace")
        own = [zlib.crc32(w)] + [zlib.crc32(text[:k].encode(), k) for k in PREFIXES if len(text) >= k]
        flat += own
        lengths.append(len(own))
    return np.array(flat, np.uint32), np.array(lengths, np.int64)


def presence(words: Words, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, feature) pairs of a step, by document."""
    places = memo.places(words.dictionary.to_pylist())[words.codes]
    n = memo.length[places]
    found = memo.flat[ragged(memo.start[places], n)].astype(np.int64)
    doc = np.repeat(np.repeat(np.arange(len(words.counts)), words.counts), n)
    pairs = np.unique((doc << 32) | found)
    return pairs >> 32, pairs & 0xFFFFFFFF


class Model:
    """Weights of the kept features (ascending numbers), and a bias."""

    def __init__(self, number: np.ndarray, weight: np.ndarray, bias: float):
        self.number, self.weight, self.bias = number, weight, bias

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of each word, the positions of its kept features: for most words, none."""
        flat, lengths = features_of(words)
        if not len(self.number):
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.number, flat), len(self.number) - 1)
        ok = self.number[at] == flat
        ends = np.cumsum(lengths)
        sums = np.concatenate([[0], np.cumsum(ok)])
        return at[ok].astype(np.int32), sums[ends] - sums[ends - lengths]

    def scores(self, column: pa.Array, memo: Memo) -> np.ndarray:
        words = Words(column)
        doc, at = presence(words, memo)
        total = self.bias + np.bincount(doc, weights=self.weight[at] if len(at) else None, minlength=len(words.counts))
        return 1.0 / (1.0 + np.exp(-np.clip(total, -40, 40)))


def learnable(doc_id: Column) -> Column:
    """Whether labels of a row may be learned from: its doc_id isn't held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS != 0


def chosen(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, float]:
    """The rows to learn from (text, positive, at: a hash of the text), stored, and the class prior: the toxic share of the different labelled texts."""
    known = (
        pick(labels, key, "toxic").select(F.col(key).cast("long").alias("doc_id"), F.col("toxic").alias("toxic")).where("doc_id is not null and toxic is not null")
        .where(learnable(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    )
    base = pick(docs, key, text).select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where(learnable(F.col("doc_id")))
    # texts by their hashes: 16 bytes a row are shuffled
    hashed = base.select("doc_id", F.xxhash64("text").alias("at"))
    labelled = stored(hashed.join(known, "doc_id").groupBy("at").agg(F.max("toxic").alias("toxic")), "toxicity-labels")
    counts = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    order = [F.xxhash64("at", F.lit(7)), "at"]
    # both samples are bounded by the parameters; the second is drawn from all documents, whatever their labels
    pos = labelled.where("toxic = 1").orderBy(*order).limit(positives).select("at", F.lit(True).alias("positive"))
    unl = hashed.select("at").distinct().orderBy(*order).limit(unlabelled).select("at", F.lit(False).alias("positive"))
    rows = base.select(F.xxhash64("text").alias("at"), "text").join(F.broadcast(pos.unionByName(unl)), "at").dropDuplicates(["at", "positive"])
    return stored(rows.select("text", "positive", "at"), "toxicity-sample"), prior


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", starts: int = 2, epochs: int = 60) -> Model:
    """The classifier learned from docs and labels. epochs=0: as it starts, for comparison."""
    sample, prior = chosen(docs, labels, key=key, text=text)
    sizes = {r["positive"]: r["n"] for r in sample.groupBy("positive").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_unl = sizes.get(True, 0), sizes.get(False, 0)
    if not n_pos or not n_unl or prior <= 0:
        return Model(np.zeros(0, np.uint32), np.zeros(0), -40.0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(features_of, np.uint32)
        for b in batches:
            for part in steps(b):
                doc, feature = presence(Words(part.column(0)), memo)
                positive = part.column(1).to_numpy(zero_copy_only=False)[doc].astype(np.int64)
                number, where = np.unique(feature, return_inverse=True)
                n = np.bincount(where, minlength=len(number))
                of_pos = np.bincount(where, weights=positive, minlength=len(number)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(of_pos), pa.array(n - of_pos)], names=["feature", "pos", "unl"])

    kept = (
        sample.mapInArrow(count, "feature long, pos long, unl long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("unl").alias("unl"))
        .where(F.col("pos") >= max(5, round(SUPPORT * n_pos))).where(F.col("unl") <= COMMON * prior * n_unl)
        .orderBy(F.desc("pos"), "feature").limit(FEATURES).collect()  # at most FEATURES rows
    )
    kept = sorted((r["feature"], r["unl"]) for r in kept)
    if not kept:
        return Model(np.zeros(0, np.uint32), np.zeros(0), -40.0)
    number = np.array([f for f, _ in kept], np.int64).astype(np.uint32)
    rare = np.log((n_unl + 1) / (np.array([n for _, n in kept]) + 1))
    value = rare / max(rare.max(), 1e-9)
    empty = Model(number, np.zeros(len(number)), 0.0)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(empty.words, np.int32)
        for b in batches:
            for part in steps(b):
                doc, at = presence(Words(part.column(0)), memo)
                cuts = np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.ListArray.from_arrays(pa.array(cuts), pa.array(at.astype(np.int32)))], names=["positive", "at", "features"])

    # at most POSITIVES + UNLABELLED rows of kept features, in the order of the hash, so that shuffles don't matter
    found = sample.mapInArrow(rows, "positive boolean, at long, features array<int>").toArrow().combine_chunks().sort_by("at")
    pos, unl = (Rows.of(found.filter(x).column("features")) for x in (found.column("positive"), pa.compute.invert(found.column("positive"))))
    del found
    weights = [train(pos, unl, value, prior, seed, epochs) for seed in range(starts)]
    return Model(number, np.mean([w[:-1] for w in weights], axis=0) * value, float(np.mean([w[-1] for w in weights])))


class Rows:
    """Texts as lists of features: flat[cuts[i]:cuts[i + 1]] are text i's."""

    def __init__(self, lists: list[np.ndarray]):
        self.flat = np.concatenate([np.zeros(0, np.int32), *lists]).astype(np.int32)
        self.cuts = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])

    @classmethod
    def of(cls, column: pa.ChunkedArray) -> Rows:
        out = cls([])
        out.flat = column.combine_chunks().flatten().to_numpy().astype(np.int32)
        out.cuts = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(column).to_numpy(), dtype=np.int64)])
        return out

    def __len__(self) -> int:
        return len(self.cuts) - 1

    def part(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Features of some texts, the place of each one's text among them, and how many texts there are."""
        n = (self.cuts[1:] - self.cuts[:-1])[which]
        return self.flat[ragged(self.cuts[:-1][which], n)], np.repeat(np.arange(len(which)), n), len(which)


def loss(w: np.ndarray, part: tuple[np.ndarray, np.ndarray, int], value: np.ndarray, sign: int) -> tuple[float, np.ndarray]:
    """Mean of l(sign g) = log(1 + exp(-sign g)) over texts, and its gradient; g = w . features + bias (the last weight)."""
    at, owner, n = part
    z = sign * (w[-1] + np.bincount(owner, w[at] * value[at], n))
    slope = -sign / (1 + np.exp(np.clip(z, -40, 40))) / n
    return float(np.logaddexp(0, -z).mean()), np.append(np.bincount(at, slope[owner] * value[at], len(value)), slope.sum())


def risk(w: np.ndarray, pos: tuple, unl: tuple, value: np.ndarray, prior: float, miss: float = MISS) -> tuple[float, np.ndarray, bool]:
    """The non-negative risk, the gradient to step against, and whether the correction was below zero: then the step is against the
    reversed gradient of the correction, and the positives' part waits."""
    of_pos, grad_pos = loss(w, pos, value, 1)
    as_neg, grad_neg = loss(w, pos, value, -1)
    of_unl, grad_unl = loss(w, unl, value, -1)
    correction, grad = of_unl - prior * as_neg, grad_unl - prior * grad_neg
    if correction < 0:
        return miss * prior * of_pos, -grad, True
    return miss * prior * of_pos + correction, miss * prior * grad_pos + grad, False


def train(pos: Rows, unl: Rows, value: np.ndarray, prior: float, seed: int, epochs: int = 60, rate: float = 0.1, batches: int = 4) -> np.ndarray:
    """Weights and bias of one classifier: Adam with a falling rate on the non-negative risk; weights are drawn towards zero after each step."""
    rng = np.random.default_rng(seed)
    w = np.append(rng.normal(0, 1e-3, len(value)), 0.0)
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0
    batches, penalty = max(1, min(batches, len(pos))), PENALTY / max(1, len(pos)) ** 0.5
    for epoch in range(epochs):
        now = rate * (1 - epoch / epochs)
        for p, u in zip(np.array_split(rng.permutation(len(pos)), batches), np.array_split(rng.permutation(len(unl)), batches), strict=True):
            if not len(u):
                continue
            _, grad, _ = risk(w, pos.part(p), unl.part(u), value, prior)
            step += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            pace = now / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w = w - pace * m / (1 - 0.9**step)
            w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - pace[:-1] * penalty, 0)
    return w


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of docs, and last toxicity (double, 0 to 1; ``toxicity_2``, ... if there is such a column). The model (at most FEATURES numbers) goes with the tasks."""
    name = unused("toxicity", docs.columns)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(model.words, np.int32)
        for b in batches:
            for part in steps(b, text):
                scores = model.scores(part.column(place), memo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], names=[*part.schema.names, name])

    return docs.mapInArrow(run, spelled([*docs.schema, (name, "double")]))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels)
    base = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    # texts stay in the workers: what comes back is a score a row
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(model.words, np.int32)
        for b in batches:
            for part in steps(b):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(part.column(1), memo))], names=["doc_id", "score"])

    return base.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
