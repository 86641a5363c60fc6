"""Token ids in Arrow stream files made of fixed-size lists: equal-length sequences and their masks, read without copying.

A shard is one file in the Arrow stream format. Its columns are ``ids`` (fixed_size_list<uint16 or uint32>[length]) and ``mask``
(fixed_size_list<bool>[length], false where the last sequence is padded). All its batches but the last hold ``BATCH``
sequences, so sequence i is row i % BATCH of batch i // BATCH, and a memory map gives it as a view. Beside it, a
second stream file says where each document lies (doc_id, start within the shard, n_tokens).

Documents go to shards by ranges of (doc_id, crc32 of the text), each document whole, followed by the end id. A null text is encoded as
an empty one (only the end id remains), null doc_ids come first, repeated rows are written as often as they come, an empty
table gives an empty result, and extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import LARGE, LONG_STEP, LOWER, Memo, coded, pick, plain_runs, ragged, raw, runs, shared_path, steps, stored, table, tokenizer_file, width

LENGTH, BATCH, END = 2048, 64, 1
#: Words per call of the library when unseen words are encoded together.
TOGETHER = 4000
#: Fixed value: the ASCII characters that this vocabulary's rules take for white space.
DROPPED = table((9, 13), (32, 32))
#: Fixed value: lower case of the second bytes of U+00C0 to U+00DE.
_LATIN = np.arange(256, dtype=np.uint8) + 32 * ((np.arange(256) >= 0x80) & (np.arange(256) <= 0x9E)).astype(np.uint8)
#: What the library's rules make one word of, in lower case.
_UNIT = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+|[0-9]|[!-&(-/:-@\[-`{-~]+")


class Encoder:
    """The library's ids of whole texts, each distinct word encoded once in a while.

    Only for vocabularies whose rules lower the case, drop white space, part letters from marks and single digits, and close each word with a
    piece of its own: then ids of a text are the ids of its words in turn. Plain words (see ``plain_runs``) are parted here, and the library's
    model gets many of them at a time; whatever else stands between white space goes through all of the library's rules.
    """

    def __init__(self, name: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(tokenizer_file(name), encoding="utf-8") as f:
            rules = json.load(f)
        self.library = Tokenizer.from_str(json.dumps(rules))
        #: the same model behind a division at white space alone
        only_space = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
        self.model = Tokenizer.from_str(json.dumps(rules | {"normalizer": None, "pre_tokenizer": only_space, "added_tokens": []}))
        end = rules["model"].get("end_of_word_suffix")
        if not end:
            raise ValueError("the vocabulary doesn't mark the ends of words")
        self.closes = np.zeros(self.library.get_vocab_size(with_added_tokens=True), bool)
        self.closes[[i for t, i in rules["model"]["vocab"].items() if t.endswith(end)]] = True
        self.memo = Memo(self._words, np.uint32, LARGE)

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        plain = np.fromiter((_UNIT.fullmatch(w) is not None for w in words), bool, len(words))
        lengths, parts = np.zeros(len(words), np.int64), []
        which = np.flatnonzero(plain)
        for at in range(0, len(which), TOGETHER):
            own = which[at : at + TOGETHER]
            ids = np.array(self.model.encode_batch_fast([b" ".join([words[i] for i in own.tolist()]).decode()], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            lengths[own] = np.diff(ends, prepend=0)
            parts.append((own, ids))
        for i in np.flatnonzero(~plain).tolist():
            ids = np.array(self.library.encode(words[i].decode(), add_special_tokens=False).ids, np.uint32)
            lengths[i] = len(ids)
            parts.append((np.array([i]), ids))
        starts, out = np.cumsum(lengths) - lengths, np.zeros(int(lengths.sum()), np.uint32)
        for own, ids in parts:
            out[ragged(starts[own], lengths[own])] = ids
        return out, lengths

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of a column of texts, and the count of ids of each."""
        body, offsets = raw(column)
        inside = ~DROPPED[body]
        starts, ends = runs(inside, offsets)
        plain, kind = plain_runs(body, starts, ends)
        own = ragged(starts[plain], (ends - starts)[plain])  # bytes of plain words
        low = body.copy()
        low[own] = LOWER[body[own]]
        second = own[body[own] >= 0x80]
        low[second] = _LATIN[body[second]]
        first = np.zeros(len(body), bool)
        first[own[1:]] = (kind[own[1:]] != kind[own[1:] - 1]) | (kind[own[1:]] == 2)
        first[starts] = True
        begin = np.flatnonzero(first)
        # a unit ends where the next one begins, or with its word
        stop = np.append(begin[1:], len(body))
        word = np.searchsorted(starts, begin, "right") - 1
        stop = np.minimum(stop, ends[word]) if len(begin) else begin
        codes, dictionary = coded(low, inside, begin, stop)
        places = self.memo.places(dictionary.to_pylist())[codes]
        lengths = self.memo.length[places]
        ids = self.memo.flat[ragged(self.memo.start[places], lengths)]
        total = np.concatenate([[0], np.cumsum(lengths)])
        return ids, np.diff(total[np.searchsorted(begin, offsets)])


_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """One encoder a worker process, whose memory of words outlives a task."""
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


# ---------------------------------------------------------------- files

#: How Arrow calls what Hadoop's file systems are called; a mounted store is a folder.
_SCHEMES = (("s3a://", "s3://"), ("s3n://", "s3://"), ("dbfs:/", "file:///dbfs/"), ("wasbs://", "abfss://"))


def _fs(uri: str) -> tuple[pa.fs.FileSystem, str]:
    for theirs, ours in _SCHEMES:
        if uri.startswith(theirs):
            uri = ours + uri[len(theirs) :]
    return pa.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Writer:
    """Packs ids into fixed-length sequences; memory is one batch of them. The file appears under its name only when whole."""

    def __init__(self, folder: str, shard: int, attempt: str, dtype: pa.DataType, length: int = LENGTH, pad: int = 0):
        self.fs, root = _fs(folder)
        self.fs.create_dir(root)
        self.final = [f"{root}/{kind}-{shard:06d}.arrow" for kind in ("tokens", "documents")]
        self.draft = [f"{p}.{attempt}" for p in self.final]
        self.length, self.pad, self.np = length, pad, dtype.to_pandas_dtype()
        self.schema = pa.schema([("ids", pa.list_(dtype, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.index = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.files = [self.fs.open_output_stream(p) for p in self.draft]
        self.out = [pa.ipc.new_stream(f, s) for f, s in zip(self.files, (self.schema, self.index), strict=True)]
        self.rest, self.written = np.zeros(0, self.np), 0

    def _put(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.out[0].write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        starts = self.written + np.cumsum(counts) - counts
        self.out[1].write_batch(pa.RecordBatch.from_arrays([doc_ids.cast(pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], schema=self.index))
        self.written += len(ids)
        self.rest = np.concatenate([self.rest, ids.astype(self.np)])
        block = self.length * BATCH
        whole = len(self.rest) // block * block
        for at in range(0, whole, block):
            self._put(self.rest[at : at + block], block)
        self.rest = self.rest[whole:].copy()

    def close(self) -> int:
        if len(self.rest):
            real = len(self.rest)
            size = -(-real // self.length) * self.length
            self._put(np.concatenate([self.rest, np.full(size - real, self.pad, self.np)]), real)
        for o, f, draft, final in zip(self.out, self.files, self.draft, self.final, strict=True):
            o.close()
            f.close()
            self.fs.move(draft, final)
        return self.written


def _open(folder: str, name: str) -> pa.RecordBatchReader:
    fs, root = _fs(folder)
    path = f"{root}/{name}"
    return pa.ipc.open_stream(pa.memory_map(path) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(path))


class Shard:
    """Random access to one token file. On a local or mounted file system nothing is copied until asked for."""

    def __init__(self, folder: str, shard: int):
        reader = _open(folder, f"tokens-{shard:06d}.arrow")
        self.length = reader.schema.field("ids").type.list_size
        self.batches = list(reader)

    def __len__(self) -> int:
        return (len(self.batches) - 1) * BATCH + self.batches[-1].num_rows if self.batches else 0

    def ids(self, batch: int) -> np.ndarray:
        """All ids of a batch, as a view of the file."""
        return self.batches[batch].column(0).flatten().to_numpy(zero_copy_only=True)

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """The i-th sequence as a view, and its mask."""
        at = i % BATCH * self.length
        return self.ids(i // BATCH)[at : at + self.length], self.batches[i // BATCH].column(1).flatten().slice(at, self.length)

    def tokens(self, start: int, count: int) -> np.ndarray:
        """ids [start, start + count), a view unless they cross batches."""
        block = self.length * BATCH
        parts = [self.ids(k)[max(0, start - k * block) : start + count - k * block] for k in range(start // block, -(-(start + count) // block))] if count else []
        return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint16), *parts])


# ---------------------------------------------------------------- DataFrame in, files out, DataFrame in

def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end: int = END, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write docs in ascending doc_id order; returns a row per shard: shard, n_docs, n_tokens, and start (ids in all shards before).

    One range shuffle of the texts; encoding and writing happen in the same task, so ids are never shuffled. A task that
    is run again writes the same file under the same name. What goes to the driver's side is a row per shard.
    """
    base = pick(docs, key, text).select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = base.withColumn("tie", F.crc32(F.col("text").cast("binary")))
    order = [F.asc_nulls_first("doc_id"), "tie", "text"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, encode = TaskContext.get(), encoder(tokenizer)
        kind = pa.uint16() if max(encode.library.get_vocab_size(with_added_tokens=True) - 1, end) < 1 << 16 else pa.uint32()
        writer, n = None, 0
        for b in batches:
            for part in steps(b, step=LONG_STEP):
                writer = writer or Writer(folder, context.partitionId(), str(context.taskAttemptId()), kind, length)
                ids, counts = encode(part.column(1))
                where = np.cumsum(counts)
                writer.add(part.column(0), np.insert(ids, where, end), counts + 1)
                n += part.num_rows
        if writer:
            yield pa.RecordBatch.from_pydict({"shard": pa.array([context.partitionId()], pa.int32()), "n_docs": [n], "n_tokens": [writer.close()]})

    written = (
        base.repartitionByRange(width(base), F.asc_nulls_first("doc_id"), F.col("tie")).sortWithinPartitions(*order)
        .select("doc_id", "text").mapInArrow(write, "shard int, n_docs long, n_tokens long")
    )
    # one small row per shard
    shards = stored(written, "token-shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.select("*", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))


def read_documents(shards: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 (of its ids as little-endian uint32), shard."""

    def read(batches):
        for b in batches:
            for shard, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                file = Shard(folder, shard)
                for docs in _open(folder, f"documents-{shard:06d}.arrow"):
                    starts, counts = docs.column(1).to_numpy(), docs.column(2).to_numpy()
                    crc = [zlib.crc32(file.tokens(s, n).astype("<u4").tobytes()) for s, n in zip(starts.tolist(), counts.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [docs.column(0), pa.array(starts + base), docs.column(2), pa.array(crc, pa.int64()), pa.array([shard] * len(crc), pa.int32())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32", "shard"],
                    )

    spread = shards.select("shard", "start").repartition(width(shards))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "tokens")
    return read_documents(write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, "word_bpe_49k.json"), folder)
