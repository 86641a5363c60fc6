"""Quality without hand labels: heuristic labellers vote, expectation-maximisation finds how far each can be trusted, and the
posterior labels train a hashed linear scorer.

Labellers look at one property each and say good (1), bad (0) or nothing (-1). Their accuracies per class and the share of good
documents come from EM over the counts of all vote patterns (3 ** labellers at most) over all documents. A sample of at most ``SAMPLE`` different texts, taken
evenly over patterns in the order of a hash of the text, then trains a logistic scorer, weighted by the posterior. Its features are hashed into ``BUCKETS``:
words, character trigrams of words (each as shares of the text's), and bins of the measures. A document's score is that scorer's, so it also ranks
documents on which all labellers are silent.

Null and empty texts have no features: every labeller is silent and the score is that of the bias alone, which keeps them; repeated rows get equal
scores, whatever their doc_id; empty tables give empty results; extra columns are kept by ``score`` as they are, and where one is called as the score,
the score gets a number behind its name. Whole texts are used.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import SPACE, Words, mix, pick, ragged, raw, spelled, steps, stored, table, unused

SAMPLE, BUCKETS, KEEP = 6_000, 1 << 12, 0.5
#: How much the text's own features weigh beside a bin of a measure.
SCALE = 12.0
#: Byte classes.
UPPER, LOWER_, DIGIT, PLAIN = table((65, 90)), table((97, 122)), table((48, 57)), table((9, 13), (32, 32), (39, 39), (44, 44), (46, 46))
OTHER = ~(table((0x80, 0xFF)) | UPPER | LOWER_ | DIGIT | PLAIN | SPACE)
MEASURES = ("words", "upper", "symbol", "digit", "again", "stutter", "variety", "length")


def measures(column: pa.Array, words: Words | None = None) -> np.ndarray:
    """A row of MEASURES for each text."""
    body, offsets = raw(column)
    n = np.diff(offsets)

    def share(inside: np.ndarray, of: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(of, 1)

    letters = share(UPPER[body] | LOWER_[body], np.ones_like(n))
    words = words or Words(column)
    count, first = words.counts.astype(np.float64), words.first
    doc = np.repeat(np.arange(len(n)), words.counts)
    same = np.zeros(len(doc), np.int64)
    same[1:] = (words.codes[1:] == words.codes[:-1]) & (doc[1:] == doc[:-1])
    # three words in a row that the same text has already had
    key = mix(words.codes.astype(np.uint64))
    with np.errstate(over="ignore"):
        three = mix(key[:-2] + key[1:-1] * np.uint64(3) + key[2:] * np.uint64(5) + doc[:-2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) if len(key) > 2 else np.zeros(0, np.uint64)
    inner = doc[:-2] == doc[2:] if len(key) > 2 else np.zeros(0, bool)
    own, where = doc[:-2][inner], three[inner]
    distinct = np.unique(where, return_index=True)[1]
    grams, fresh = np.bincount(own, minlength=len(n)), np.bincount(own[distinct], minlength=len(n))
    pair = np.unique(doc.astype(np.int64) * (len(words.dictionary) + 1) + words.codes)
    types = np.bincount(pair // (len(words.dictionary) + 1), minlength=len(n))
    sizes = np.diff(words.dictionary.buffers()[1] and np.frombuffer(words.dictionary.buffers()[1], np.int64)[: len(words.dictionary) + 1]) if len(words.dictionary) else np.zeros(0)
    spelled = np.concatenate([[0], np.cumsum(sizes[words.codes] if len(doc) else np.zeros(0))])
    stutter = np.bincount(doc, weights=same, minlength=len(n))
    return np.stack([
        count, share(UPPER[body], letters), share(OTHER[body], n), share(DIGIT[body], n), 1 - fresh / np.maximum(grams, 1) * (grams > 0) - (grams == 0),
        stutter / np.maximum(count, 1), types / np.maximum(np.sqrt(count), 1), (spelled[first[1:]] - spelled[first[:-1]]) / np.maximum(count, 1),
    ], axis=1)


#: name, measure, at least as many words, bad from, good up to (between them: silent).
LABELLERS = (
    ("shouting", "upper", 5, 0.5, 0.2),
    ("symbols", "symbol", 5, 0.06, 0.02),
    ("repetition", "again", 25, 0.5, 0.35),
    ("stutter", "stutter", 10, 0.3, 0.1),
    ("figures", "digit", 10, 0.6, 0.2),
    ("marks a word", "symbol", 20, 0.1, 0.04),
    ("long words", "length", 10, 30.0, 14.0),
)


def votes(m: np.ndarray) -> np.ndarray:
    """Of each text, each labeller's vote: 1 good, 0 bad, -1 silent."""
    out = np.full((len(m), len(LABELLERS)), -1, np.int8)
    for j, (_, name, words, bad, good) in enumerate(LABELLERS):
        x, enough = m[:, MEASURES.index(name)], m[:, 0] >= words
        out[enough & (x >= bad), j] = 0
        out[enough & (x < good), j] = 1
    return out


def patterns(v: np.ndarray) -> np.ndarray:
    return ((v.astype(np.int64) + 1) * 3 ** np.arange(v.shape[1])).sum(axis=1)


def unpacked(pattern: np.ndarray) -> np.ndarray:
    return (pattern[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1).astype(np.int8)


def em(pattern: np.ndarray, count: np.ndarray, rounds: int = 60) -> dict:
    """EM over vote patterns. Returns the share of good documents, hit[c, j] = P(vote good | class c, j speaks), and the posterior of each pattern.

    Starts from the majority; counts are smoothed as if each labeller had been right 4 times and wrong once in either class.
    """
    v = unpacked(pattern)
    said, good = v >= 0, v == 1
    bad_votes, good_votes = (v == 0).sum(axis=1), good.sum(axis=1)
    # one objection weighs more than silence or assent: heuristics for defects seldom fire by chance
    post = np.where(bad_votes > 0, 0.2 / np.maximum(bad_votes, 1), np.where(good_votes > 0, 0.95, 0.9))
    prior, hit = 0.9, None
    for _ in range(rounds):
        share = np.stack([1 - post, post]) * count
        prior = float((share[1].sum() + 9) / (count.sum() + 10)) if count.sum() else 0.9
        spoke = share @ said
        # in the bad class most labellers rightly see nothing wrong: each is right there at its own rate
        hit = (share @ good + np.array([[1.0], [4.0]])) / (spoke + 5.0)
        hit = np.clip(hit, 1e-3, 1 - 1e-3)
        like = [np.log(p) + np.where(said, np.where(good, np.log(hit[c]), np.log1p(-hit[c])), 0.0).sum(axis=1) for c, p in ((0, 1 - prior), (1, prior))]
        post = 1 / (1 + np.exp(np.clip(like[0] - like[1], -40, 40)))
    accuracy = hit is not None and [(name, float(hit[1, j]), float(1 - hit[0, j])) for j, (name, *_) in enumerate(LABELLERS)]
    return {"prior": prior, "hit": hit, "accuracy": accuracy, "posterior": dict(zip(pattern.tolist(), post.tolist(), strict=True))}


def bins(m: np.ndarray) -> np.ndarray:
    """Buckets of the measures of each text: two for each measure, a fine bin and a coarse one, so that rare values lean on their neighbours."""
    rows = []
    for j, name in enumerate(MEASURES):
        x = m[:, j]
        at = np.floor(np.log2(1 + x) * 2 if name in ("words", "length", "variety") else np.sqrt(np.clip(x, 0, 1)) * 20).astype(np.int64)
        salt = zlib.crc32(name.encode())
        rows.append(mix(at.astype(np.uint64) + np.uint64(salt)) % np.uint64(BUCKETS))
        rows.append(mix((at // 4).astype(np.uint64) + np.uint64(salt ^ 0xFFFF)) % np.uint64(BUCKETS))
    return np.stack(rows, axis=1).astype(np.int64)


class Spelling:
    """Hashed features of the distinct words of a step: each word's own bucket and those of its trigrams (with its borders)."""

    def __init__(self, words: Words):
        self.words = words
        spelled = words.dictionary.to_pylist()
        whole = np.frombuffer(b"\0" + b"\0".join(spelled) + b"\0", np.uint8).astype(np.uint64) if spelled else np.zeros(0, np.uint64)
        size = np.fromiter(map(len, spelled), np.int64, len(spelled))
        #: trigrams of a word of n bytes: n, the first of them with the border in front
        self.first = np.cumsum(size + 1) - (size + 1)
        self.size = size
        hashes = mix(whole[:-2] + whole[1:-1] * np.uint64(257) + whole[2:] * np.uint64(66049), 21) if len(whole) > 2 else np.zeros(0, np.uint64)
        self.trigram = (hashes % np.uint64(BUCKETS)).astype(np.int64)
        # words are told apart by the sum of their trigrams' hashes, each with its place
        own = ragged(self.first, size)
        place = own - np.repeat(self.first, size)
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes[own] + place.astype(np.uint64), 22), dtype=np.uint64)])
        ends = np.cumsum(size)
        self.word = (mix(sums[ends] - sums[ends - size], 23) % np.uint64(BUCKETS)).astype(np.int64)
        self.own = own

    def sums(self, weight: np.ndarray) -> np.ndarray:
        """Of each text, SCALE times the mean of weight over its words and, within them, their trigrams."""
        w, size = self.words, self.size
        total = np.concatenate([[0.0], np.cumsum(weight[self.trigram[self.own]])])
        ends = np.cumsum(size)
        each = weight[self.word] + (total[ends] - total[ends - size]) / np.maximum(size, 1)
        doc = np.repeat(np.arange(len(w.counts)), w.counts)
        return SCALE * np.bincount(doc, weights=each[w.codes] if len(doc) else None, minlength=len(w.counts)) / np.maximum(w.counts, 1)

    def rows(self) -> np.ndarray:
        """The features that ``sums`` weighs, as a dense row for each text."""
        w, out = self.words, np.zeros((len(self.words.counts), BUCKETS), np.float32)
        for d in range(len(w.counts)):
            codes, n = np.unique(w.codes[w.first[d] : w.first[d + 1]], return_counts=True)
            if len(codes):
                size = self.size[codes]
                at = np.concatenate([self.word[codes], self.trigram[ragged(self.first[codes], size)]])
                value = np.concatenate([n, np.repeat(n / size, size)])
                out[d] = np.bincount(at, value, BUCKETS) * (SCALE / n.sum())
        return out


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 150, rate: float = 0.05, least: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels over dense rows, full batches with Adam; the last weight is the bias."""
    w, m, v = (np.zeros(x.shape[1] + 1, np.float32) for _ in range(3))
    share = (weight / max(weight.sum(), 1e-9)).astype(np.float32)
    for step in range(1, epochs + 1):
        z = x @ w[:-1] + w[-1]
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y).astype(np.float32) * share
        grad = np.append(g @ x + least * w[:-1], g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w.astype(np.float64)


class Scorer:
    def __init__(self, weight: np.ndarray, labels: dict):
        self.weight, self.labels = weight, labels

    def both(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Scores, and the posteriors of the labellers' votes."""
        words = Words(column)
        m = measures(column, words)
        z = self.weight[bins(m)].sum(axis=1) + Spelling(words).sums(self.weight) + self.weight[-1]
        z = np.where(m[:, 0] > 0, z, max(self.weight[-1], 1.0))
        pattern, where = np.unique(patterns(votes(m)), return_inverse=True)
        known = np.array([self.labels["posterior"].get(int(k), self.labels["prior"]) for k in pattern], np.float64)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40))), known[where]

    def __call__(self, column: pa.Array) -> np.ndarray:
        return self.both(column)[0]


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Scorer:
    """One pass over all documents for votes (two numbers a row, stored) and counts of patterns; then one that reads the sample's texts."""
    base = pick(docs, text).select(F.col(text).alias("text"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in steps(b):
                found = patterns(votes(measures(part.column(1)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], names=["at", "pattern"])

    at = F.xxhash64(F.coalesce("text", F.lit("")), F.lit(11)).alias("at")
    seen = stored(base.select(at, "text").mapInArrow(look, "at long, pattern int"), "quality-votes")
    counted = seen.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()  # 3 ** labellers rows at most
    pattern, count = np.array([r["pattern"] for r in counted], np.int64), np.array([r["n"] for r in counted], np.float64)
    if not len(pattern):
        return Scorer(np.zeros(BUCKETS + 1), em(np.zeros(1, np.int64), np.zeros(1)))
    labels = em(pattern, count)
    # an equal part of the sample for every pattern: of its different texts, those with the least hashes. A task keeps that many of each before rows are shuffled
    each = max(1, SAMPLE // len(pattern))
    chance = {int(p): min(1.0, 50.0 * each / n) for p, n in zip(pattern, count, strict=True)}
    rates = F.create_map(*[F.lit(v) for pair in chance.items() for v in pair])
    part = seen.where((F.pmod(F.xxhash64("at"), F.lit(1 << 30)) / float(1 << 30)) < rates[F.col("pattern")]).distinct()
    taken = part.withColumn("r", F.row_number().over(Window.partitionBy("pattern").orderBy(F.xxhash64("at"), "at"))).where(F.col("r") <= each).select("at", "pattern")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # texts that are in the sample, each once
            for piece in steps(b):
                words = Words(piece.column(2))
                x = Spelling(words).rows()
                own = bins(measures(piece.column(2), words))
                np.add.at(x, (np.arange(len(x))[:, None], own), 1.0)
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())], names=["at", "pattern", "x"])

    # SAMPLE rows at most are broadcast
    sample = base.select(at, "text").join(F.broadcast(taken), "at").dropDuplicates(["at"]).select("at", "pattern", "text")
    rows = sample.mapInArrow(features, "at long, pattern int, x binary").toPandas().sort_values("at", kind="stable")
    if not len(rows):
        return Scorer(np.zeros(BUCKETS + 1), labels)
    x = np.frombuffer(b"".join(rows["x"]), np.float16).reshape(len(rows), BUCKETS).astype(np.float32)
    del rows["x"]
    y = np.array([labels["posterior"][p] for p in rows["pattern"]])
    # a pattern weighs as the square root of its documents: rare defects are still heard
    share = dict(zip(pattern.tolist(), np.sqrt(count).tolist(), strict=True))
    n = rows["pattern"].value_counts().to_dict()
    return Scorer(train(x, y, np.array([share[p] / n[p] for p in rows["pattern"]])), labels)


def score(docs: DataFrame, scorer: Scorer, name: str = "quality", text: str = "text") -> DataFrame:
    """All columns of docs, and last the scorer's score (0 to 1, higher: better) as ``name``, or as ``name_2``, ... if there is such a column."""
    name = unused(name, docs.columns)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in steps(b, text):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scorer(part.column(place)))], names=[*part.schema.names, name])

    return docs.mapInArrow(run, spelled([*docs.schema, (name, "double")]))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scorer = fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in steps(b):
                points, posterior = scorer.both(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(posterior), pa.array(points)], names=["doc_id", "posterior", "score"])

    base = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return base.mapInArrow(run, "doc_id long, posterior double, score double").withColumn("kept", F.col("score") >= KEEP)
