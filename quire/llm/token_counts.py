"""Exact token counts of every prefix of a text under byte-level BPE, by dynamic programming over prefixes.

The encoding of a piece's prefix of length i ends in exactly one token t such that t is a suffix of the prefix and the last token of the
encoding of what is before t may stand in front of t (the two stay two when merged on their own). So with ``last[i]``
known for all shorter prefixes, ``count[i] = count[i - len(t)] + 1``: one pass gives the count at every prefix, and a text cut anywhere is
counted without encoding it again. Pieces are the vocabulary's own pre-tokens; how a cut changes them (inside white space or a
contraction) is taken into account, and special strings count as the library's default has them: one token when whole, plain text when cut.

``prefix_counts`` stores the counts of all prefixes with each text's id, as differences of neighbours; ``cut`` reads such a table and answers where texts
have to be cut for any number of budgets, and ``counted`` how many tokens their first characters are, without the texts.

A null text is an empty one (no bytes, no tokens); repeated rows give repeated results; an empty table gives an empty
result; extra columns are ignored. Texts are never cut: very long ones only make a longer table.
"""

from __future__ import annotations

import json
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import LARGE, LONG_STEP, Memo, coded, pick, plain_runs, ragged, raw, steps, stored, table, tokenizer_file

LIMIT = 512
#: Fixed value: how this family of vocabularies splits text before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: ASCII white space, as this family of vocabularies has it.
BLANK = table((9, 13), (32, 32))
#: Fixed value: white space beyond ASCII.
WIDE_SPACE = "\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACES = {*WIDE_SPACE, *"\t\n\v\f\r "}
_WIDE = np.sort(np.array([int.from_bytes(c.encode(), "big") for c in WIDE_SPACE]))
_PIECES = regex.compile(PIECES)
#: What is one piece in any plain text: letters, digits or marks, with a space in front or not.
_PLAIN = regex.compile(r" ?(?:[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)")
#: Pieces and token pairs that are remembered by themselves.
HELD_PIECES, HELD_PAIRS = 50_000, 500_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    def __init__(self, name: str):
        with open(tokenizer_file(name), encoding="utf-8") as f:
            rules = json.load(f)
        letters = byte_letters()
        spell = lambda t: bytes(letters[c] for c in t)
        self.special = [t["content"] for t in rules["added_tokens"]]
        vocab = {spell(t): i for t, i in rules["model"]["vocab"].items() if t not in self.special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in rules["model"]["merges"]]
        # tokens are numbered by rank: single bytes first, then merges in order
        self.rank: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        self.parts: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.joined: dict[tuple[int, int], int] = {}
        for a, b in merges:
            left, right = self.rank[spell(a)], self.rank[spell(b)]
            made = self.rank.setdefault(spell(a) + spell(b), len(self.parts))
            self.joined[left, right] = made
            if made == len(self.parts):
                self.parts.append((left, right))
        assert len(self.rank) <= len(vocab), "tokens beyond the merges"
        self.longest = max(map(len, self.rank))
        #: ends[b]: lengths of tokens that end in byte b, longest first
        by_end: dict[int, set[int]] = {}
        for t in self.rank:
            by_end.setdefault(t[-1], set()).add(len(t))
        self.ends = [sorted(by_end.get(b, {1}), reverse=True) for b in range(256)]
        #: last two bytes -> lengths
        by_two: dict[bytes, set[int]] = {}
        for t in self.rank:
            if len(t) > 1:
                by_two.setdefault(t[-2:], set()).add(len(t))
        self.two = {k: sorted(v, reverse=True) for k, v in by_two.items()}
        self.fits: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, list[int]] = {}
        self.memo = Memo(self._chunks, np.int32, LARGE)

    def stay(self, a: int, b: int) -> bool:
        """Whether tokens a, b, side by side, are what merging their bytes gives: undo both from the inside, latest merge
        first, and see whether some merge across the border would have come before."""
        key = (a, b)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > HELD_PAIRS:
                self.fits.clear()
            joined, parts, before, known = self.joined, self.parts, 1 << 40, None
            while known is None:
                made = joined.get((a, b))
                if made is not None and made < before:
                    known = False
                elif a > b:
                    # a was made after b: what stood at the border before is a's right part
                    before, a = a, parts[a][1]
                    if a == before:
                        before, b = b + 1, parts[b][0]
                        if b + 1 == before:
                            known = True
                else:
                    before, b = b + 1, parts[b][0]
                    if b + 1 == before:
                        before, a = a, parts[a][1]
                        if a == before:
                            known = True
            self.fits[key] = known
        return known

    def piece(self, text: bytes, counts: list[int], last: list[int], held: int) -> None:
        """Extend counts and last (of the first ``held`` bytes of text) to all of text."""
        rank, two, stay = self.rank.get, self.two, self.stay
        for i in range(held, len(text)):
            for n in two.get(text[i - 1 : i + 1], ()) if i else ():
                if n > i + 1:
                    continue
                t = rank(text[i + 1 - n : i + 1])
                if t is not None and (n == i + 1 or stay(last[i - n], t)):
                    counts.append(counts[i - n] + 1 if n <= i else 1)
                    last.append(t)
                    break
            else:
                counts.append(counts[i - 1] + 1 if i else 1)
                last.append(text[i])

    def worked(self, pieces: list[str]) -> list[list[int]]:
        """Of each distinct piece, the counts of its prefixes of 1, 2, ... characters. They are worked out in sorted order: what a piece has in common
        with the one before it is not gone over again."""
        spelled = [p.encode() for p in pieces]
        out: list[list[int]] = [[]] * len(pieces)
        old, counts, last = b"", [], []
        for k in sorted(range(len(pieces)), key=spelled.__getitem__):
            text = spelled[k]
            same, most = 0, min(len(old), len(text))
            while same < most and old[same] == text[same]:
                same += 1
            del counts[same:], last[same:]
            self.piece(text, counts, last, same)
            # of the bytes, those that end a character
            out[k] = counts.copy() if len(pieces[k]) == len(text) else [c for c, after in zip(counts, [*text[1:], 0], strict=True) if after & 0xC0 != 0x80]
            old = text
        return out

    def learn(self, pieces: list[str]) -> None:
        if len(self.pieces) > HELD_PIECES:
            self.pieces.clear()
        self.pieces.update(zip(pieces, self.worked(pieces), strict=True))

    def of_piece(self, piece: str) -> list[int]:
        """Token counts of the prefixes of 1, 2, ... characters of one pre-token."""
        if piece not in self.pieces:
            self.learn([piece])
        return self.pieces[piece]

    def ordinary(self, text: str) -> list[int]:
        """Token counts of the prefixes of 1, 2, ... characters, special strings being plain text."""
        pieces = _PIECES.findall(text)
        if len(pieces) == 1 and "'" not in text:
            return self.of_piece(text) if text[-1] not in _SPACES or len(text) == 1 else [self.of_piece(text[:k])[-1] for k in range(1, len(text) + 1)]
        out: list[int] = []
        base = space_base = at = 0
        space_at = -1
        for piece in pieces:
            counts = self.of_piece(piece)
            first = piece[0]
            if first in _SPACES:
                # a cut inside a run of white space makes all of the run so far one piece
                blank = len(piece) if piece[-1] in _SPACES else 1
                if space_at < 0:
                    space_at, space_base = at, base
                out += [space_base + self.of_piece(text[space_at : k + 1])[-1] for k in range(at, at + blank)]
                out += [base + c for c in counts[blank:]]
                if blank < len(piece):
                    space_at = -1
            else:
                space_at = -1
                if first == "'" and len(piece) > 1 and piece[1].isalpha():
                    # a contraction that is cut is a quotation mark and letters
                    counts = [1, *(1 + self.of_piece(piece[1:k])[-1] for k in range(2, len(piece))), counts[-1]]
                out += [base + c for c in counts]
            base += counts[-1]
            at += len(piece)
        return out

    def prefixes(self, text: str) -> list[int]:
        """Token counts of the prefixes of 1, 2, ... characters of text, as the library's default has them."""
        if not any(s in text for s in self.special):
            return self.ordinary(text)
        out: list[int] = []
        split = regex.split("(" + "|".join(map(regex.escape, self.special)) + ")", text)
        base = 0
        for plain, special in zip(split[::2], [*split[1::2], ""], strict=True):
            counts = self.ordinary(plain + special[:-1])
            out += [base + c for c in counts]
            base += counts[len(plain) - 1] if plain else 0
            if special:
                base += 1
                out.append(base)
        return out

    def _chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [c.decode() for c in chunks]
        plain = [i for i, t in enumerate(texts) if _PLAIN.fullmatch(t)]
        each: list[list[int]] = [[]] * len(texts)
        for i, counts in zip(plain, self.worked([texts[i] for i in plain]), strict=True):
            each[i] = counts
        others = sorted({*range(len(texts))} - {*plain})
        known = self.pieces
        self.learn(list({p for i in others for p in _PIECES.findall(texts[i]) if p not in known}))
        for i in others:
            each[i] = self.prefixes(texts[i])
        lengths = np.fromiter(map(len, each), np.int64, len(each))
        return np.fromiter(chain.from_iterable(each), np.int32, int(lengths.sum())), lengths

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The table: counts of all prefixes of all texts, one after another, and the number of characters of each text.

        Texts are divided into chunks (white space and what follows it up to the next), since a cut in front of white space never
        changes the pieces on either side, and plain chunks behind a single space into their pieces; each distinct one is worked out once.
        """
        body, offsets = raw(column)
        space = spaces(body)
        start = np.zeros(len(body), bool)
        start[1:] = space[1:] & ~space[:-1]
        full = offsets[1:] > offsets[:-1]
        start[offsets[:-1][full]] = True
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(body))
        words = starts + (body[starts] == 32)
        plain, kind = plain_runs(body, words, ends)
        own = ragged(words[plain], (ends - words)[plain])
        inner = own[1:][(kind[own[1:]] != kind[own[1:] - 1]) & (np.diff(own) == 1)]
        start[inner] = True
        starts = np.flatnonzero(start)
        codes, dictionary = coded(body, None, starts, np.append(starts[1:], len(body)))
        places = self.memo.places(dictionary.to_pylist())[codes]
        lengths = self.memo.length[places]
        chunk_at = self.memo.start[places]
        counts = self.memo.flat[ragged(chunk_at, lengths)]
        total = self.memo.flat[chunk_at + lengths - 1] if len(places) else np.zeros(0, np.int32)
        first = np.searchsorted(starts, offsets)
        sums = np.concatenate([[0], np.cumsum(total, dtype=np.int64)])
        before = sums[:-1] - np.repeat(sums[first[:-1]], np.diff(first))  # tokens of the same text in front of the chunk
        counts = counts + np.repeat(before, lengths).astype(np.int32)
        chars = np.concatenate([[0], np.cumsum(lengths)])[first]
        return counts, np.diff(chars)


def spaces(body: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text are white space or part of it."""
    out = BLANK[body]
    for lead, size in (((0xC2, 0xC2), 2), ((0xE1, 0xE3), 3)):
        at = np.flatnonzero((body[: len(body) - size + 1] >= lead[0]) & (body[: len(body) - size + 1] <= lead[1]))
        if len(at):
            code = np.zeros(len(at), np.int64)
            for k in range(size):
                code = code << 8 | body[at + k]
            at = at[np.isin(code, _WIDE)]
            for k in range(size):
                out[at + k] = True
    return out


_counters: dict[str, PrefixCounter] = {}


def counter(name: str) -> PrefixCounter:
    if name not in _counters:
        _counters[name] = PrefixCounter(name)
    return _counters[name]


def deltas(counts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Counts of each text as bytes: the width of a number, then the differences of neighbours (the first from 0), little-endian."""
    step = np.diff(counts, prepend=0)
    first = ends[:-1][ends[1:] > ends[:-1]]
    step[first] = counts[first]
    wide = np.abs(step) > 127
    sums, small = np.concatenate([[0], np.cumsum(wide)]), step.astype(np.int8)
    return [b"\4" + step[a:z].astype("<i4").tobytes() if sums[z] > sums[a] else b"\1" + small[a:z].tobytes() for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def restored(stored_: bytes) -> np.ndarray:
    """The counts of a text's prefixes of 1, 2, ... characters."""
    return np.cumsum(np.frombuffer(stored_, np.int8 if stored_[0] == 1 else "<i4", offset=1), dtype=np.int64)


def prefix_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = LIMIT, keep: bool = True, key: str = "doc_id", text: str = "text", packed: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, fit_chars (length of the longest prefix within ``limit`` tokens all of whose shorter prefixes
    fit too), and with ``keep`` prefix_counts: the exact count at every prefix, in characters (array<int>; ``packed``: binary, see ``deltas``)."""
    base = pick(docs, key, text).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def count(batches):
        of = counter(tokenizer)
        for b in batches:
            for part in steps(b, step=LONG_STEP):
                _, offsets = raw(part.column(1))
                counts, chars = of(part.column(1))
                ends = np.concatenate([[0], np.cumsum(chars)])
                last = np.where(chars > 0, counts[np.maximum(ends[1:] - 1, 0)] if len(counts) else 0, 0)
                columns = [part.column(0), pa.array(np.diff(offsets)), pa.array(last.astype(np.int64)), pa.array(fits(counts, ends, limit))]
                names = ["doc_id", "n_bytes", "n_tokens", "fit_chars"]
                if keep:
                    columns.append(pa.array(deltas(counts, ends), pa.binary()) if packed else pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(counts)))
                    names.append("prefix_counts")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return base.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, fit_chars long" + (", prefix_counts " + ("binary" if packed else "array<int>")) * keep)


def fits(counts: np.ndarray, ends: np.ndarray, limit: int) -> np.ndarray:
    """Of each text (its counts are those from one of ends to the next), how many characters fit all of whose prefixes are within limit tokens."""
    over = np.flatnonzero(counts > limit)
    after = np.searchsorted(over, ends[:-1])
    stop = np.append(over, len(counts))[after]
    return np.minimum(stop, ends[1:]) - ends[:-1]


def _read(table: DataFrame, columns: str, answer) -> DataFrame:
    """answer(counts, ends) -> arrays, over the stored counts of a few texts at a time."""

    def run(batches):
        for b in batches:
            for part in steps(b, "prefix_counts"):
                each = [restored(x) for x in part.column(1).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, answer(np.concatenate(each), ends))], names=["doc_id", *(c.split()[0] for c in columns.split(", "))])

    return table.select("doc_id", "prefix_counts").mapInArrow(run, f"doc_id long, {columns}")


def cut(table: DataFrame, budgets: list[int]) -> DataFrame:
    """From packed prefix counts, without texts: doc_id, n_tokens, and for every budget chars_<budget>: how many characters stay within it, and
    tokens_<budget>: how many tokens those are. A text within its budget stays whole; one without characters has 0."""

    def answer(counts, ends):
        full = ends[1:] > ends[:-1]
        at = lambda n: np.where(n > 0, np.append(counts, 0)[np.maximum(ends[:-1] + n - 1, 0)], 0)
        out = [np.where(full, at(np.diff(ends)), 0)]
        for budget in budgets:
            n = fits(counts, ends, budget)
            out += [n, at(n)]
        return out

    return _read(table, ", ".join(["n_tokens long", *(f"chars_{k} long, tokens_{k} long" for k in budgets)]), answer)


def counted(table: DataFrame, chars: int) -> DataFrame:
    """From packed prefix counts, without texts: doc_id and tokens, the exact count of each text's first ``chars`` characters."""

    def answer(counts, ends):
        n = np.minimum(np.diff(ends), chars)
        return [np.where(n > 0, np.append(counts, 0)[np.maximum(ends[:-1] + n - 1, 0)], 0)]

    return _read(table, "tokens long", answer)


#: Budgets of the query.
BUDGETS = (128, 512, 2048)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of prefix counts is stored; n_tokens, and where each text is to be cut for every budget, are read from it."""
    table = stored(prefix_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), packed=True), "prefix-counts")
    sizes = "doc_id long, n_bytes long, n_tokens long, over_limit boolean" + "".join(f", chars_{k} long" for k in BUDGETS)

    def run(batches):
        for b in batches:
            for part in steps(b, "prefix_counts"):
                each = [restored(x) for x in part.column(2).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
                counts = np.concatenate(each)
                last = pa.array([int(x[-1]) if len(x) else 0 for x in each], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:2], last, pa.compute.greater(last, LIMIT), *(pa.array(fits(counts, ends, k)) for k in BUDGETS)], names=[x.split()[0] for x in sizes.split(", ")])

    return table.select("doc_id", "n_bytes", "prefix_counts").mapInArrow(run, sizes)
