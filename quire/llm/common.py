"""Shared ground: tables in the cluster's shared folder, and vectorised splitting of Arrow text into words.

Every function that handles text here treats a null text as an empty one, whole texts are used whatever their length,
and sub-batches keep a worker's memory bounded by the largest single document, ``STEP`` bytes of others and the bytes a ``Memo`` may hold.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once in a Python worker (a longer document makes a step of its own).
STEP = 2_000_000
#: The same for work that is mostly a memory of words, and how many bytes such a memory may hold.
LONG_STEP, LARGE = 3_000_000, 128_000_000


# ---------------------------------------------------------------- shared folder

def shared_root(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``. A temporary one only where that is unset and driver and executors are one machine's."""
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quire-"))
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path for a table or folder; no two calls share one, so a rerun never reads an older run's files."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written as Parquet to the shared folder and read back: lineage ends here, executors may be lost."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete the files of a table that ``stored`` wrote, once nothing reads it any more."""
    context, path = df.sparkSession.sparkContext, getattr(df, "_stored", None)
    if path:
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def width(df: DataFrame) -> int:
    """Partitions for a shuffle of df's rows: the session's, or as many as the scan has when that is more."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def pick(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, by exact name where several differ in case alone; extra columns never get in the way."""
    if all(sum(c.lower() == name.lower() for name in df.columns) == 1 for c in columns):
        return df.select(*[F.col(f"`{c}`").alias(c) for c in columns])
    places = [df.columns.index(c) for c in columns]
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).select(*[F.col(f"c{i}").alias(c) for i, c in zip(places, columns, strict=True)])


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df and a column ``name``: a number that no other row has and that is the same whenever the rows are read again.

    A table of files has the place of each row in its file; what else comes is stored first.
    """
    if df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        try:
            where = df.select("*", F.col("_metadata.file_path").alias(f"{name}_path"), F.col("_metadata.row_index").alias(name))
        except AnalysisException:  # other files than Parquet's don't number their rows
            return stored(df.withColumn(name, F.monotonically_increasing_id()), "numbered")
        # a row for each file
        files = sorted(r[0] for r in where.select(f"{name}_path").distinct().collect())
        if len(files) < 2:
            return where.drop(f"{name}_path")
        order = df.sparkSession.createDataFrame(list(zip(files, range(len(files)), strict=True)), f"{name}_path string, {name}_file long")
        return where.join(F.broadcast(order), f"{name}_path").withColumn(name, F.col(f"{name}_file") * F.lit(1 << 40) + F.col(name)).drop(f"{name}_path", f"{name}_file")
    return stored(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


def unused(name: str, taken) -> str:
    """name, or name and the first number that makes it another than all that are taken (whatever their case)."""
    taken = {t.lower() for t in taken}
    tries = [name, *(f"{name}_{i}" for i in range(2, len(taken) + 3))]
    return next(t for t in tries if t.lower() not in taken)


def spelled(fields) -> str:
    """A schema as text; fields: Spark's own, or pairs of name and type."""
    pairs = [f if isinstance(f, tuple) else (f.name, f.dataType.simpleString()) for f in fields]
    return ", ".join(f"`{n.replace('`', '``')}` {kind}" for n, kind in pairs)


# ---------------------------------------------------------------- Arrow text as bytes

def steps(batch: pa.RecordBatch, text: str = "text", step: int = STEP) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``step`` bytes of text each."""
    column = batch.column(batch.schema.get_field_index(text))
    if not len(column):
        return
    ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        base = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + step, "right")))
        yield batch.slice(at, to - at)
        at = to
    tidy()


def tidy() -> None:
    """Give memory that is free again back to the machine: a worker serves many tasks, and its high-water mark would stay."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n+1 offsets (int64, from 0); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pa.compute.fill_null(column.cast(pa.large_string()), "")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if off is not None else np.zeros(1, np.int64)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True; a run never crosses a document's border."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    first, last = offsets[:-1], offsets[1:]
    full = last > first
    before[first[full]] = False
    after[last[full] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def coded(body: np.ndarray, inside: np.ndarray | None, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Words as codes into a dictionary of distinct byte strings. inside: what of body the words are made of (None: all)."""
    kept = np.ascontiguousarray(body if inside is None else body[inside])
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
    found = words.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False), found.dictionary


def table(*spans: tuple[int, int]) -> np.ndarray:
    """A lookup table over bytes: True within the spans (both ends included)."""
    out = np.zeros(256, bool)
    for low, high in spans:
        out[low : high + 1] = True
    return out


#: ASCII white space; bytes of words (digits, letters, all beyond ASCII); the lower case of A-Z.
SPACE = table((9, 13), (28, 32))
WORD = table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8) + 32 * ((np.arange(256) >= 65) & (np.arange(256) <= 90)).astype(np.uint8)


#: Fixed values, kinds of bytes: 1 ASCII letters, 2 digits, 3 printable ASCII marks, 4 the first byte of U+00C0 to U+00FF, 5 bytes that go on a character, 6 any others.
KIND = np.full(256, 6, np.uint8)
for _low, _high, _kind in ((0x21, 0x7E, 3), (0x30, 0x39, 2), (0x41, 0x5A, 1), (0x61, 0x7A, 1), (0xC3, 0xC3, 4), (0x80, 0xBF, 5)):
    KIND[_low : _high + 1] = _kind


def plain_runs(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which runs [start, end) of body are plain: printable ASCII without apostrophes and ``<|``, and letters of Latin-1; and the kind of each byte
    of body in which all letters of such runs are 1. How vocabularies divide plain runs depends on these kinds alone."""
    kind = KIND[body]
    odd = (kind == 6) | (body == 39)
    lead = np.flatnonzero(kind == 4)
    follow = np.minimum(lead + 1, len(body) - 1)
    # the two signs among the letters of Latin-1 are no letters
    letter = (kind[follow] == 5) & (body[follow] != 0x97) & (body[follow] != 0xB7)
    odd[lead[~letter]] = True
    on = kind == 5
    on[follow[letter]] = False
    odd |= on
    kind[lead[letter]] = kind[follow[letter]] = 1
    if len(body) > 1:
        odd[:-1] |= (body[:-1] == 60) & (body[1:] == 124)
    sums = np.concatenate([[0], np.cumsum(odd)])
    return sums[ends] == sums[starts], kind


class Words:
    """The words of a step: lower-cased (A-Z), runs of ``WORD`` bytes. codes[first[d]:first[d + 1]] are document d's."""

    def __init__(self, column: pa.Array):
        body, self.offsets = raw(column)
        body = LOWER[body]
        inside = WORD[body]
        starts, ends = runs(inside, self.offsets)
        self.codes, self.dictionary = coded(body, inside, starts, ends)
        self.first = np.searchsorted(starts, self.offsets)
        self.counts = np.diff(self.first)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices that lay out pieces [start, start + length) one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return shift + np.arange(total)


class Memo:
    """A memory of a pure function of byte strings whose values are pieces of one flat array, bounded in bytes.

    Strings live in two generations. One that is asked for moves to the younger; when that holds half of ``most`` bytes the older is forgotten and the
    younger takes its place, so what is in use stays. The strings of one call are always held together: memory is ``most`` and
    one step's own, however long single strings are. Results never depend on what is held.
    """

    #: Bytes that a string takes besides itself and its value: the object, its place in the dictionary, start and length.
    EACH = 170

    def __init__(self, make: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], dtype, most: int = 48_000_000):
        self.make, self.dtype, self.most = make, np.dtype(dtype), most
        self.clear()

    def clear(self) -> None:
        self._older: tuple[dict[bytes, int], np.ndarray, np.ndarray, np.ndarray] = ({}, np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self._begin()

    def _begin(self) -> None:
        self.at: dict[bytes, int] = {}
        self.flat, self.used, self.held = np.zeros(1 << 16, self.dtype), 0, 0
        self.start, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _put(self, words: list[bytes], flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        have, need = len(self.at), len(self.at) + len(words)
        while len(self.start) < need:
            self.start, self.length = np.concatenate([self.start, self.start * 0]), np.concatenate([self.length, self.length * 0])
        if len(self.flat) < self.used + len(flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(self.used, len(flat)) + len(flat), self.dtype)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.length[have:need] = lengths
        self.start[have:need] = self.used + np.cumsum(lengths) - lengths
        self.used += len(flat)
        self.at.update(zip(words, range(have, need), strict=True))
        self.held += self.EACH * len(words) + sum(map(len, words)) + flat.nbytes
        return np.arange(have, need)

    def places(self, words: list[bytes]) -> np.ndarray:
        """Where each of these distinct strings has its value: flat[start[place]:][:length[place]], until the next call."""
        if self.held > self.most // 2:
            self._older = self.at, self.flat, self.start, self.length
            self._begin()
        out = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
        for make in (False, True):
            missing = np.flatnonzero(out < 0)
            if not len(missing):
                break
            wanted = [words[i] for i in missing.tolist()] if len(missing) < len(words) else words
            if make:
                out[missing] = self._put(wanted, *self.make(wanted))
            elif self._older[0]:
                at, flat, start, length = self._older
                old = np.fromiter(map(at.get, wanted, repeat(-1)), np.int64, len(wanted))
                known = np.flatnonzero(old >= 0)
                if len(known):
                    old = old[known]
                    out[missing[known]] = self._put([wanted[i] for i in known.tolist()], flat[ragged(start[old], length[old])], length[old])
        return out


class Numbers:
    """A fixed mapping of 64-bit keys to places 0, 1, ... in the order given, as a table with open addressing that is read for many keys at once."""

    def __init__(self, keys: np.ndarray):
        keys = np.asarray(keys).astype(np.uint64)
        self.shift = np.uint64(64 - max(4, int(len(keys)).bit_length() + 2))
        self.mask = (1 << (64 - int(self.shift))) - 1
        self.keys, self.place = np.zeros(self.mask + 1, np.uint64), np.full(self.mask + 1, -1, np.int32)
        rest, at = np.arange(len(keys)), self._home(keys)
        self.probes = 0
        while len(rest):
            self.probes += 1
            free = self.place[at] < 0
            slots, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[slots], self.place[slots] = keys[rest[won]], rest[won]
            left = np.ones(len(rest), bool)
            left[won] = False
            rest, at = rest[left], (at[left] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key (of any shape), or -1."""
        shape, keys = keys.shape, keys.astype(np.uint64).ravel()
        at = self._home(keys)
        found = self.place[at]
        off = np.flatnonzero((self.keys[at] != keys) & (found >= 0))
        found[off] = -1
        at = at[off]
        while len(off):
            at = (at + 1) & self.mask
            place = self.place[at]
            same = self.keys[at] == keys[off]
            found[off[same]] = place[same]
            on = ~same & (place >= 0)
            off, at = off[on], at[on]
        return found.reshape(shape)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds) over uint64."""
    with np.errstate(over="ignore"):
        x = np.asarray(x).astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(dictionary: pa.Array) -> np.ndarray:
    """64-bit hashes of a dictionary's byte strings."""
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, dictionary.to_pylist()), np.uint64, len(dictionary))


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary file is, on whichever machine asks; an absolute name is taken as it is."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
