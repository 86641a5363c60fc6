"""SentencePiece encoding with seeded merge-dropout, and its lossless decoding, for merge-type vocabularies.

Candidate merges wait in an agenda, best score first (the leftmost of equals). When its turn comes, a candidate is skipped if a keyed hash of
(seed, doc_id, number of the unit in the text, place, piece) falls below ``dropout``; the same seed gives the same segmentation on any cluster and after any retry, another
seed another one. With dropout 0 ids are the library's own. Texts are taken apart into units where no piece of the vocabulary has the two
neighbouring characters side by side, so no merge ever crosses a border, and every occurrence of a unit has draws of its own. What comes of them depends on the
unit and on which of its candidates, in order of their turns, are skipped: the candidates of each distinct unit are worked out once and
remembered, and each distinct (unit, skipped turns) of a step once.

Characters without a piece become bytes, and so does U+2581 itself (which the library would decode to a space): decoding gives every text
back exactly. Null and empty texts have no ids; repeated rows with one doc_id get the same ids; a null doc_id counts as 0; empty
tables give empty results; extra columns are kept, and where one is called as a column of the result, the result's gets ``quire_`` in front. Whole texts are encoded, whatever their length.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import Memo, Numbers, coded, mix, pick, ragged, raw, spelled, steps, tokenizer_file, unused

DROPOUT, SEED = 0.1, 17
SPACE_MARK = "▁"
#: No candidate. Units longer than LONG characters are worked on alone; shorter ones have no more turns than a mask has bits (first candidates and two for each merge).
NONE, LONG = (1 << 31) - 1, 20
#: Symbols of units that are worked on together; bytes of text whose draws are.
TOGETHER, DRAWN = 150_000, 1_500_000
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


class Pieces:
    def __init__(self, name: str, dropout: float, seed: int):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(name))
        n = model.get_piece_size()
        self.bytes = {}
        spelled: list[bytes] = []
        scores: dict[str, tuple[float, int]] = {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                spelled.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                spelled.append(b"")
            else:
                scores[piece] = (-model.get_score(i), i)
                spelled.append(piece.replace(SPACE_MARK, " ").encode())
        if len(self.bytes) < 256:
            raise ValueError("the vocabulary has no pieces for single bytes: encoding would lose characters")
        #: piece -> (order among the scores, best first and equal for equals; id)
        order = {x: k for k, x in enumerate(sorted({x for x, _ in scores.values()}))}
        self.score = {p: (order[x], i) for p, (x, i) in scores.items()}
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_n = np.array([len(s) for s in spelled], np.int64)
        self.spelled_at = np.cumsum(self.spelled_n) - self.spelled_n
        self.below, self.seed = round(dropout * 2**16), seed
        #: bytes that some piece has side by side at the border of two characters
        self.glued = np.zeros((256, 256), bool)
        for p in self.score:
            each = [c.encode() for c in p.replace(SPACE_MARK, " ")]
            for x, y in zip(each, each[1:], strict=False):
                self.glued[x[-1], y[0]] = True
        self._pairs()
        self.memo = Memo(self._traced, np.int32)

    def unit(self, text: str, key: int) -> list[int]:
        """Ids of one unit. key: what its draws depend on. An agenda's entry is order << 40 | place of the left symbol."""
        score, below, push, pop = self.score, self.below, heapq.heappush, heapq.heappop
        symbols = [SPACE_MARK if c == " " else c if c != SPACE_MARK else "\0" + c for c in text]
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            found = score.get(symbols[i] + symbols[i + 1])
            if found:
                agenda.append(found[0] << 40 | i)
        heapq.heapify(agenda)
        while agenda:
            entry = pop(agenda)
            i = entry & 0xFFFFFFFFFF
            j = after[i]
            if j >= n or not symbols[i]:
                continue
            made = symbols[i] + symbols[j]
            found = score.get(made)
            if not found or found[0] != entry >> 40:
                continue  # one of the two has been merged otherwise meanwhile
            if below and (((key + i * 0x1E3779B1 ^ found[1] * 0x5EBCA6B) & 0x7FFFFFFF) * 0x2C1B3C6D >> 15) & 0xFFFF < below:
                continue
            symbols[i], symbols[j] = made, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = score.get(made + symbols[k])
                if found:
                    push(agenda, found[0] << 40 | i)
            b = before[i]
            if b >= 0:
                found = score.get(symbols[b] + made)
                if found:
                    push(agenda, found[0] << 40 | b)
        out: list[int] = []
        for s in symbols:
            if s:
                found = score.get(s)
                if found:
                    out.append(found[1])
                else:
                    out += [self.bytes[x] for x in s.lstrip("\0" if s != "\0" else "").encode()]
        return out

    def _pairs(self) -> None:
        """Tables for many units at once: symbols are piece ids, and ids from n on for characters without a piece."""
        n = len(self.spelled_n)
        self.letter = np.full(0x110000, -1, np.int32)  # code point -> symbol
        self.known = n  # symbols so far
        self.out_n, self.out_at, self.out = np.ones(n, np.int64), np.arange(n), np.arange(n)
        for p, (_, i) in self.score.items():
            if len(p) == 1 and p != SPACE_MARK:
                self.letter[ord(p)] = i
        self.letter[32] = self.score[SPACE_MARK][1]
        self._learn({ord(c) for p in self.score for c in p if c != SPACE_MARK and self.letter[ord(c)] < 0} | {0x2581})
        symbol = {p: i for p, (_, i) in self.score.items()}
        of = lambda t: symbol.get(t, int(self.letter[ord(t)]) if len(t) == 1 else -1)
        found = [(of(p[:k]) << 32 | of(p[k:]), order, i) for p, (order, i) in self.score.items() for k in range(1, len(p)) if of(p[:k]) >= 0 and of(p[k:]) >= 0]
        self.pair = Numbers(np.array([f[0] for f in found], np.int64))
        # the last one stands for no pair
        self.pair_order, self.pair_made = np.array([*(f[1] for f in found), NONE], np.int32), np.array([*(f[2] for f in found), 0], np.int32)

    def _learn(self, points) -> None:
        points = sorted(points)
        spelled = [[self.bytes[x] for x in chr(c).encode()] for c in points]
        self.letter[points] = np.arange(self.known, self.known + len(points))
        self.known += len(points)
        self.out_at = np.append(self.out_at, len(self.out) + np.cumsum([0, *map(len, spelled)])[:-1].astype(np.int64))
        self.out_n = np.append(self.out_n, np.array([len(x) for x in spelled], np.int64))
        self.out = np.append(self.out, np.array([i for x in spelled for i in x], np.int64))

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order (NONE: no such piece) and id of the piece that left and right make."""
        at = self.pair(left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64))
        return self.pair_order[at], self.pair_made[at]

    def skipped(self, keys: np.ndarray, place: np.ndarray, piece: np.ndarray) -> np.ndarray:
        return (((keys + place * 0x1E3779B1 ^ piece * 0x5EBCA6B) & 0x7FFFFFFF) * 0x2C1B3C6D >> 15) & 0xFFFF < self.below

    def many(self, points: np.ndarray, sizes: np.ndarray, skips: np.ndarray) -> tuple[np.ndarray, np.ndarray, list, list]:
        """unit() for many units, all of them a step at a time: each takes the best entry of its own agenda.

        points: a row of code points for each, the first sizes[row] of which count. skips: bit t is set if a unit skips in turn t.
        Returns flat ids, their counts, and for every turn the rows that had one and their candidates (place << 24 | piece).
        """
        if (self.letter[points] < 0).any():
            self._learn(set(points[self.letter[points] < 0].tolist()))
        rows, length = points.shape
        symbol = np.full((rows, length + 1), NONE, np.int32)  # from the end on
        symbol[:, :-1] = np.where(np.arange(length) < sizes[:, None], self.letter[points], NONE)
        after = np.tile(np.arange(1, length + 2, dtype=np.int32), (rows, 1))
        before = np.tile(np.arange(-1, length, dtype=np.int32), (rows, 1))
        order, made = np.full((rows, length), NONE, np.int32), np.zeros((rows, length), np.int32)
        if length > 1:
            order[:, :-1], made[:, :-1] = self._look(symbol[:, :-2], symbol[:, 1:-1])
        drops = bool(skips.any())
        going, turn, who, what = np.arange(rows), 0, [], []
        while True:
            now = order if len(going) == rows else order[going]
            i = now.argmin(axis=1)
            some = order[going, i] < NONE
            if not some.all():
                going, i = going[some], i[some]
            if not len(going):
                break
            piece = made[going, i]
            order[going, i] = NONE
            who.append(going)
            what.append((i << 24 | piece).astype(np.int32))
            r = going
            if drops:
                stays = (skips[going] >> np.uint64(turn)) & np.uint64(1) == 0
                r, i, piece = going[stays], i[stays], piece[stays]
            turn += 1
            j = after[r, i]
            k = after[r, j]
            symbol[r, i], symbol[r, j], after[r, i], before[r, k] = piece, -1, k, i
            order[r, np.minimum(j, length - 1)] = NONE
            b = before[r, i]
            left = b >= 0
            # to the right and to the left in one go
            one, two = np.concatenate([r, r[left]]), np.concatenate([i, b[left]])
            first, second = np.concatenate([piece, symbol[r[left], b[left]]]), np.concatenate([symbol[r, k], piece[left]])
            order[one, two], made[one, two] = self._look(first, second)
        left = symbol[:, :-1]
        stays = (left >= 0) & (left < NONE)
        flat = left[stays]
        n = self.out_n[flat]
        ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(stays.sum(axis=1))])]
        return self.out[ragged(self.out_at[flat], n)], np.diff(ends), who, what

    @staticmethod
    def _points(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Code points of units, one after another, and their counts."""
        whole = b"".join(units)
        starts = np.concatenate([[0], np.cumsum((np.frombuffer(whole, np.uint8) & 0xC0) != 0x80)])
        ends = np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))
        return np.frombuffer(whole.decode().encode("utf-32-le"), np.uint32), np.diff(starts[ends], prepend=0)

    def _run(self, points: np.ndarray, at: np.ndarray, sizes: np.ndarray, skips: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each unit (sizes code points from at on): the count of its ids, its ids, and all its candidates (place << 24 | piece), in one flat array; and how many numbers those are."""
        lengths, parts = np.zeros(len(at), np.int64), []
        by_size = np.argsort(sizes, kind="stable")
        low = 0
        while low < len(by_size):
            # units of like sizes together, the largest of them last
            high = low + max(1, TOGETHER // max(1, int(sizes[by_size[low]])))
            high = min(len(by_size), high, low + max(1, TOGETHER // max(1, int(sizes[by_size[min(high, len(by_size)) - 1]]))))
            own = by_size[low:high]
            size = max(1, int(sizes[own[-1]]))
            place = np.minimum(at[own][:, None] + np.arange(size), max(len(points) - 1, 0))
            ids, n, who, what = self.many(points[place], sizes[own], skips[own])
            row = np.concatenate([np.arange(len(own)), np.repeat(np.arange(len(own)), n), *who])
            value = np.concatenate([n.astype(np.int32), ids.astype(np.int32), *what])
            lengths[own] = np.bincount(row, minlength=len(own))
            parts.append((own, value[np.argsort(row, kind="stable")]))
            low = high
        starts, out = np.cumsum(lengths) - lengths, np.zeros(int(lengths.sum()), np.int32)
        for own, flat in parts:
            out[ragged(starts[own], lengths[own])] = flat
        return out, lengths

    def _traced(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        points, sizes = self._points(units)
        return self._run(points, np.cumsum(sizes) - sizes, sizes, np.zeros(len(units), np.uint64))

    def draws(self, units: list[bytes], codes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their counts of occurrences of distinct units, each with a key of its own: as unit() has them."""
        lengths, parts = np.zeros(len(codes), np.int64), []
        points, sizes = self._points(units)
        at = np.cumsum(sizes) - sizes
        long = sizes > LONG
        for x in np.flatnonzero(long[codes]).tolist():
            flat = np.array(self.unit(units[codes[x]].decode(), int(keys[x])), np.int32)
            lengths[x] = len(flat)
            parts.append((np.array([x]), flat))
        which, unit = np.flatnonzero(~long[codes]), np.flatnonzero(~long)
        node, after = (np.cumsum(~long) - 1)[codes[which]], np.zeros(len(which), np.int64)
        places = self.memo.places([units[x] for x in unit.tolist()] if len(unit) < len(units) else units)
        flat, start, length, mask = self.memo.flat, self.memo.start[places], self.memo.length[places], np.zeros(len(unit), np.uint64)
        while len(which):
            first = start[node]
            n = flat[first].astype(np.int64)
            begin = first + 1 + n + after
            turns = first + length[node] - begin if self.below else np.zeros(len(which), np.int64)
            came = flat[ragged(begin, turns)].astype(np.int64)
            hit = np.flatnonzero(self.skipped(np.repeat(keys[which], turns), came >> 24, came & 0xFFFFFF))
            ends = np.cumsum(turns)
            owner = np.searchsorted(ends, hit, "right")
            fresh = np.diff(owner, prepend=-1) > 0
            owner, hit = owner[fresh], hit[fresh]
            turn = hit - (ends - turns)[owner] + after[owner]
            done = np.ones(len(which), bool)
            done[owner] = False
            lengths[which[done]] = n[done]
            parts.append((which[done], flat[ragged(first[done] + 1, n[done])]))
            pairs, again = np.unique(node[owner] << 8 | turn, return_inverse=True)
            unit, mask = unit[pairs >> 8], mask[pairs >> 8] | np.uint64(1) << (pairs & 255).astype(np.uint64)
            flat, length = self._run(points, at[unit], sizes[unit], mask)
            start = np.cumsum(length) - length
            which, node, after = which[owner], again, turn + 1
        starts = np.cumsum(lengths) - lengths
        out = np.zeros(int(lengths.sum()), np.int32)
        for own, flat in parts:
            out[ragged(starts[own], lengths[own])] = flat
        return out, lengths

    def _units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units, each with a last byte that only serves to give it another key."""
        keys = np.fromiter((zlib.crc32(u, self.seed & 0xFFFFFFFF) for u in units), np.int64, len(units))
        return self.draws([u[:-1] for u in units], np.arange(len(units)), keys)

    def encode(self, column: pa.Array, doc_ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of texts, and the count of each."""
        column = pa.compute.fill_null(column, "").cast(pa.string())
        given = pa.compute.binary_length(column).to_numpy(zero_copy_only=False) > 0
        # the vocabulary's rule: a text that isn't empty gets a space in front
        body, offsets = raw(pa.compute.binary_join_element_wise(pa.scalar(" "), column, pa.scalar("")))
        start = np.zeros(len(body), bool)
        start[1:] = ~self.glued[body[:-1], body[1:]] & ((body[1:] & 0xC0) != 0x80)
        start[offsets[:-1]] = True
        starts = np.flatnonzero(start)
        codes, dictionary = coded(body, None, starts, np.append(starts[1:], len(body)))
        first = np.searchsorted(starts, offsets)
        per_doc = np.diff(first)
        nth = np.arange(len(starts)) - np.repeat(first[:-1], per_doc)
        keys = pa.compute.fill_null(doc_ids.cast(pa.int64()), 0).to_numpy(zero_copy_only=False).view(np.uint64)
        draw = (mix(np.repeat(mix(keys, self.seed), per_doc) + nth.astype(np.uint64)) >> np.uint64(33)).astype(np.int64)
        ids, lengths = self.draws(dictionary.to_pylist(), codes.astype(np.int64), draw)
        keep = np.repeat(given, per_doc)
        ids = ids[np.repeat(keep, lengths)]
        lengths = np.where(keep, lengths, 0)
        total = np.concatenate([[0], np.cumsum(lengths)])
        return ids, np.diff(total[first])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The texts of flat ids: what their pieces spell, without the space in front."""
        n = self.spelled_n[ids]
        body = self.spelled[ragged(self.spelled_at[ids], n)]
        ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])]
        drop = np.zeros(len(body), bool)
        drop[ends[:-1][counts > 0]] = True
        drop &= body == 32
        offsets = ends - np.concatenate([[0], np.cumsum(drop)])[ends]
        return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(body[~drop]))])


_pieces: dict[tuple[str, float, int], Pieces] = {}


def pieces(name: str, dropout: float, seed: int) -> Pieces:
    key = (name, dropout, seed)
    if key not in _pieces:
        _pieces.clear()
        _pieces[key] = Pieces(name, dropout, seed)
    return _pieces[key]


def encode(docs: DataFrame, model: str = "piece_bpe_32k.model", dropout: float = DROPOUT, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of docs but text, and ids array<int>, n_tokens, ids_crc32 (ids as little-endian uint32) and lossless: whether decoding gives the text."""
    kept = [f for f in docs.schema if f.name != text]
    taken = {f.name.lower() for f in kept}
    names = [n if n not in taken else unused(f"quire_{n}", taken) for n in ("ids", "n_tokens", "ids_crc32", "lossless")]
    schema = spelled([*kept, *zip(names, ("array<int>", "bigint", "bigint", "boolean"), strict=True)])
    at, key_at = docs.columns.index(text), docs.columns.index(key)
    others = [i for i, c in enumerate(docs.columns) if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = pieces(model, dropout, seed)
        for b in batches:
            for part in steps(b, text, DRAWN):
                ids, counts = of.encode(part.column(at), part.column(key_at))
                decoded = of.decode(ids, counts)
                same = pa.compute.equal(decoded, pa.compute.fill_null(part.column(at), "").cast(pa.large_string()).cast(pa.large_binary()))
                ends = np.concatenate([[0], np.cumsum(counts)])
                plain = ids.astype("<u4")
                crc = [zlib.crc32(plain[a:z].tobytes()) for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in others), lists, pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64()), same], names=[*(f.name for f in kept), *names],
                )

    return docs.mapInArrow(run, schema)


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return encode(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "n_tokens", "ids_crc32", "lossless")
