"""Benchmark decontamination: a prefix-filtered join of benchmark windows with documents, verified exactly.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased. A window is 10 consecutive words of an item, or all
words of a shorter one. A window occurs in a document only if all its 5-word shingles (single words, pairs, ... for windows
shorter than 5) do, each at its own place. So shingles are ordered by rarity, counted over all documents, and a window is looked up by
its rarest shingle alone: with containment 1 the necessary prefix is one shingle long. Where it stands in the document and where in the
window fix the window's start (positional bound), the document's ends bound it (length bound), and the candidate is then compared word by word.

Items are dealt into blocks of ``BLOCK`` bytes of text; each block becomes an index file in the shared folder, and a worker holds ``HELD``
blocks' indexes at most, so memory doesn't depend on how large the benchmark is. Documents never leave their task.

Null or wordless documents have no words and are clean; null or wordless items occur nowhere; repeated rows give repeated results;
repeated items count under each of their ids. Ids of items may be of any type and are told apart as strings; items without an id hit like others,
and all of them together are one item without a name. Empty tables give empty or clean results; ``contamination`` ignores extra columns, ``clean`` keeps them.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import Words, mix, pick, ragged, runs, shared_path, steps
from quire.llm.token_files import _fs

WINDOW, SHINGLE, BLOCK, HELD = 10, 5, 4_000_000, 4


def _save(folder: str, name: str, attempt: int, **arrays: np.ndarray) -> None:
    fs, root = _fs(folder)
    fs.create_dir(root)
    held = io.BytesIO()
    np.savez(held, **arrays)
    with fs.open_output_stream(f"{root}/{name}.{attempt}") as f:
        f.write(held.getvalue())
    fs.move(f"{root}/{name}.{attempt}", f"{root}/{name}")


def _load(folder: str, name: str) -> dict[str, np.ndarray] | None:
    fs, root = _fs(folder)
    if fs.get_file_info(f"{root}/{name}").type == pa.fs.FileType.NotFound:
        return None
    with fs.open_input_file(f"{root}/{name}") as f:
        return dict(np.load(io.BytesIO(f.read()), allow_pickle=False))


def shingles(ids: np.ndarray, k: int) -> np.ndarray:
    """64-bit keys of the k-word shingles that start at each place (the last k - 1 places have none)."""
    out = np.zeros(max(0, len(ids) - k + 1), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + len(out)].astype(np.uint64)
    return mix(out, k)


class Block:
    """The distinct windows of a block of items, as ids of the block's own words (1 on)."""

    def __init__(self, held: dict[str, np.ndarray]):
        self.words = pa.Array.from_buffers(pa.large_binary(), len(held["word_off"]) - 1, [None, pa.py_buffer(held["word_off"]), pa.py_buffer(held["word_data"])])
        self.held = held
        self.sizes = sorted({min(SHINGLE, int(n)) for n in held["length"]})

    @staticmethod
    def made(item_ids: list[str | None], column: pa.Array) -> dict[str, np.ndarray]:
        names = sorted({i for i in item_ids if i is not None})
        # the number of an item's name; -1: it has none
        number = {n: k for k, n in enumerate(names)} | {None: -1}
        words = Words(column)
        ids = words.codes.astype(np.int64) + 1
        rows, owner, lengths = [], [], []
        for d, n in enumerate(words.counts.tolist()):
            own = ids[words.first[d] : words.first[d + 1]]
            if n >= WINDOW:
                rows.append(np.lib.stride_tricks.sliding_window_view(own, WINDOW))
            elif n:
                rows.append(np.pad(own, (0, WINDOW - n))[None, :])
            else:
                continue
            owner.append(np.full(len(rows[-1]), number[item_ids[d]], np.int64))
            lengths.append(np.full(len(rows[-1]), min(n, WINDOW), np.int64))
        window = np.concatenate(rows) if rows else np.zeros((0, WINDOW), np.int64)
        owner = np.concatenate(owner) if rows else np.zeros(0, np.int64)
        length = np.concatenate(lengths) if rows else np.zeros(0, np.int64)
        distinct, of = np.unique(window, axis=0, return_inverse=True)
        pairs = np.unique(np.stack([of.ravel(), owner], axis=1), axis=0) if rows else np.zeros((0, 2), np.int64)
        size = np.zeros(len(distinct), np.int64)
        size[of.ravel()] = length
        _, off, data = words.dictionary.buffers()
        return {
            "window": distinct, "length": size, "items": pairs[:, 1], "item_first": np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1)),
            "word_off": np.frombuffer(off, np.int64)[: len(words.dictionary) + 1] if len(words.dictionary) else np.zeros(1, np.int64),
            "word_data": np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8),
            "name_off": np.concatenate([[0], np.cumsum([len(n.encode()) for n in names], dtype=np.int64)]), "name_data": np.frombuffer("".join(names).encode(), np.uint8),
        }

    def names(self) -> list[str | None]:
        """The names of the block's items; the last one is for those that have none."""
        whole, off = self.held["name_data"].tobytes(), self.held["name_off"].tolist()
        return [*(whole[a:z].decode() for a, z in zip(off[:-1], off[1:], strict=True)), None]

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each window, the keys at offsets 0, 1, ... (as a matrix) and which of them there are."""
        window, length = self.held["window"], self.held["length"]
        n = WINDOW - 1 + 1
        key, there = np.zeros((len(window), n), np.uint64), np.zeros((len(window), n), bool)
        for k in self.sizes:
            for size in range(k, WINDOW + 1) if k == SHINGLE else [k]:
                at = np.flatnonzero(length == size)
                for o in range(size - k + 1 if len(at) else 0):
                    key[at, o] = _row_keys(window[at, o : o + k], k)
                    there[at, o] = True
        return key, there

    def ids(self, words: Words) -> np.ndarray:
        """Of each word of a step of documents, its id in the block, or 0."""
        found = pa.compute.index_in(words.dictionary, value_set=self.words)
        return (pa.compute.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1)[words.codes]

    def places(self, words: Words, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Where shingles of k block words start, and their keys; none crosses a document's end."""
        ok = ids != 0
        run = ok.copy()
        for j in range(1, k):
            run[:-j] &= ok[j:]
            run[len(run) - j :] = False
        at = np.flatnonzero(run)
        doc_end = np.repeat(words.first[1:], words.counts)
        at = at[at + k <= doc_end[at]] if len(at) else at
        return at, _row_keys(ids[at[:, None] + np.arange(k)], k)


def _row_keys(rows: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(len(rows), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * np.uint64(0x9E3779B97F4A7C15) + rows[:, j].astype(np.uint64)
    return mix(out, k)


class Index:
    """A block's windows, each found by its rarest shingle."""

    def __init__(self, held: dict[str, np.ndarray]):
        self.block = Block(held)
        self.held = held
        self.names = self.block.names()

    @staticmethod
    def made(held: dict[str, np.ndarray], counted: dict[int, int]) -> dict[str, np.ndarray]:
        """counted: documents with each key (int64). A window with a shingle that no document has occurs nowhere and is left out."""
        block = Block(held)
        key, there = block.keys()
        known = np.array(sorted(counted), np.int64)
        number = np.array([counted[k] for k in known.tolist()], np.int64)
        where = np.searchsorted(known, key.view(np.int64)) if len(known) else np.zeros(key.shape, np.int64)
        hit = (known[np.minimum(where, len(known) - 1)] == key.view(np.int64)) if len(known) else np.zeros(key.shape, bool)
        df = np.where(hit, number[np.minimum(where, max(len(known) - 1, 0))] if len(known) else 0, 0)
        keep = np.flatnonzero((~there | (df > 0)).all(axis=1))
        rare = np.where(there, df, np.iinfo(np.int64).max)[keep].argmin(axis=1)
        entry_key, k = key[keep, rare], np.minimum(SHINGLE, held["length"][keep])
        order = np.lexsort((entry_key, k))
        return held | {"entry_key": entry_key[order], "entry_k": k[order], "entry_offset": rare[order], "entry_window": keep[order]}

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """All occurrences in a step of documents: where each starts (among the step's words), and which window it is."""
        starts, windows = [], []
        held = self.held
        ids = self.block.ids(words)
        for k in self.block.sizes:
            own = slice(*np.searchsorted(held["entry_k"], [k, k + 1]))
            keys = held["entry_key"][own]
            if not len(keys):
                continue
            at, found = self.block.places(words, ids, k)
            low, high = np.searchsorted(keys, found), np.searchsorted(keys, found, "right")
            some = high > low
            at, low, n = at[some], low[some], (high - low)[some]
            entry = ragged(low, n) + own.start
            window = held["entry_window"][entry]
            size = held["length"][window]
            place = np.repeat(at, n)
            start = place - held["entry_offset"][entry]
            doc = np.searchsorted(words.first, place, "right") - 1
            fits = (start >= words.first[doc]) & (start + size <= words.first[doc + 1])
            start, window, size = start[fits], window[fits], size[fits]
            for length in np.unique(size):
                part = np.flatnonzero(size == length)
                for cut in range(0, len(part), 500_000):
                    p = part[cut : cut + 500_000]
                    same = np.ones(len(p), bool)
                    for j in range(length):
                        same &= ids[start[p] + j] == held["window"][window[p], j]
                    starts.append(start[p][same])
                    windows.append(window[p][same])
        return (np.concatenate(starts), np.concatenate(windows)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


_held: dict[tuple[str, str], object] = {}


def _one(folder: str, name: str, kind: type):
    """HELD blocks in a worker's memory at most, those used last."""
    if (folder, name) in _held:
        _held[folder, name] = _held.pop((folder, name))
    else:
        while len(_held) >= HELD:
            del _held[next(iter(_held))]
        found = _load(folder, name)
        _held[folder, name] = found and kind(found)
    return _held[folder, name]


def index_items(items: DataFrame, docs: DataFrame, folder: str, key: str = "item_id", text: str = "text", doc_text: str = "text") -> int:
    """Write the index of every block of items to folder; returns the number of blocks.

    One pass over items, one counting pass over docs. Only counts of shingles that items have are shuffled.
    """
    base = pick(items, key, text).select(F.col(key).cast("string").alias("item_id"), F.col(text).alias("text"))
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // BLOCK))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, held = TaskContext.get(), [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            made = Block.made(table.column(0).to_pylist(), table.column(1).combine_chunks())
            _save(folder, f"block-{context.partitionId()}", context.taskAttemptId(), **made)
            yield pa.RecordBatch.from_pydict({"windows": [len(made["window"])]})

    # a block's items are what one task holds
    base.repartition(blocks, F.xxhash64("item_id", "text")).mapInArrow(write, "windows long").agg(F.sum("windows")).collect()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for part in steps(b):
                words = Words(part.column(0))
                for i in range(blocks):
                    block = _one(folder, f"block-{i}", Block)
                    if not block:
                        continue
                    if i not in sums:
                        key_, there = block.keys()
                        own = np.unique(key_[there])
                        sums[i] = own, np.zeros(len(own), np.int64)
                    own, total_ = sums[i]
                    ids = block.ids(words)
                    for k in block.sizes:
                        at, found = block.places(words, ids, k)
                        place = np.searchsorted(own, found)
                        ok = own[np.minimum(place, len(own) - 1)] == found
                        doc = np.searchsorted(words.first, at[ok], "right") - 1
                        once = np.unique(doc * len(own) + place[ok])
                        total_ += np.bincount(once % len(own), minlength=len(own))
        for i, (own, total_) in sums.items():
            some = total_ > 0
            yield pa.RecordBatch.from_arrays([pa.array(np.full(int(some.sum()), i, np.int32)), pa.array(own[some].view(np.int64)), pa.array(total_[some])], names=["block", "key", "docs"])

    counts = pick(docs, doc_text).mapInArrow(count, "block int, key long, docs long").groupBy("block", "key").agg(F.sum("docs").alias("docs"))

    def index(frame: pd.DataFrame) -> pd.DataFrame:
        i = int(frame["block"].iloc[0])
        held = _load(folder, f"block-{i}")
        made = Index.made(held, dict(zip(frame["key"].tolist(), frame["docs"].tolist(), strict=True)))
        _save(folder, f"index-{i}", TaskContext.get().taskAttemptId(), **made)
        return pd.DataFrame({"block": [i], "entries": [len(made["entry_key"])]})

    # a group is the counts of one block's shingles: at most as many as the block has words
    counts.groupBy("block").applyInPandas(index, "block int, entries long").agg(F.sum("entries")).collect()
    return blocks


def _found(folder: str, blocks: int, words: Words) -> tuple[np.ndarray, list[set[str | None]]]:
    """Which of a step's words are hit, and for each document the names of the items that occur in it."""
    edge = np.zeros(len(words.codes) + 1, np.int64)
    items: list[set[str | None]] = [set() for _ in range(len(words.counts))]
    for i in range(blocks):
        found = _one(folder, f"index-{i}", Index)
        if not found:
            continue
        start, window = found.find(words)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + found.held["length"][window], -1)
        doc = np.searchsorted(words.first, start, "right") - 1
        once = np.unique(np.stack([doc, window], axis=1), axis=0)
        first = found.held["item_first"]
        n = np.diff(first)[once[:, 1]]
        pairs = np.unique(np.stack([np.repeat(once[:, 0], n), found.held["items"][ragged(first[once[:, 1]], n)]], axis=1), axis=0)
        for d, k in pairs.tolist():
            items[d].add(found.names[k])
    return np.cumsum(edge[:-1]) > 0, items


def contamination(docs: DataFrame, folder: str, blocks: int, spans: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_hit, item_ids array<string> (sorted, null last), and with spans the hit word ranges
    array<struct<start, end>> (end exclusive, merged)."""
    base = pick(docs, key, text).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in steps(b):
                words = Words(part.column(1))
                hit, items = _found(folder, blocks, words)
                sums = np.concatenate([[0], np.cumsum(hit)])
                ids = [sorted(x, key=lambda n: (n is None, n or "")) for x in items]
                columns = [part.column(0), pa.array(words.counts.astype(np.int64)), pa.array(sums[words.first[1:]] - sums[words.first[:-1]]), pa.array(ids, pa.list_(pa.string()))]
                names = ["doc_id", "n_words", "n_hit", "item_ids"]
                if spans:
                    # document borders part spans: a window never crosses one, so a border inside a run is a new span
                    low, high = runs(hit, words.first)
                    first = np.searchsorted(low, words.first)
                    shift = words.first[np.searchsorted(words.first, low, "right") - 1]
                    structs = pa.StructArray.from_arrays([pa.array(low - shift), pa.array(high - shift)], names=["start", "end"])
                    columns.append(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), structs))
                    names.append("spans")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return base.mapInArrow(find, "doc_id long, n_words long, n_hit long, item_ids array<string>" + ", spans array<struct<start: long, end: long>>" * spans)


def clean(docs: DataFrame, folder: str, blocks: int, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, in which no window occurs. Each row is judged by its own text, whatever its id."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in steps(b, text):
                words = Words(part.column(place))
                hit, _ = _found(folder, blocks, words)
                sums = np.concatenate([[0], np.cumsum(hit)])
                yield part.filter(pa.array(sums[words.first[1:]] == sums[words.first[:-1]]))

    return docs.mapInArrow(run, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    joined = F.array_join("item_ids", ",")  # leaves nulls out
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(joined.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_path(spark, "benchmark")
    blocks = index_items(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), docs, folder)
    return digest(contamination(docs, folder, blocks, spans=False))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, s, s + least(10, len(w)) - 1), ' ') AS g, least(10, len(w)) AS n
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n),
g AS (SELECT r, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS g FROM pos),
occ AS (SELECT r, n, s, item_id FROM g JOIN win USING (n, g)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT r, n, s FROM occ)) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)"""
