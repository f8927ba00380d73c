"""BPE encoding with content-defined chunk reuse, and decoding.

A text is cut where a rolling hash of its last `WINDOW` bytes hits a mask, so equal passages of different
documents give equal chunks wherever they stand. Every chunk a worker has not met is encoded once and
its ids are kept by hash; later ones cost a look-up. Below the chunks lie pieces (a word, a mark, a line
end), kept in the same way, since most text shares no chunk but all text shares words.

Equality of hashes only finds a kept slice: its bytes are kept, too, and compared with the text each time.
A row with a slice that differs from what its hash finds is encoded by itself.

Joins are repaired: the pieces on both sides of every join of chunks are encoded again as one (each pair of
pieces once) and must agree with the ids they have apart. Cuts lie where the pre-tokenizer separates
whatever stands on either side (a lone space or line end between solid characters, or a letter or digit
before a mark), so they do; a row with a join that does not agree, and rows with wide Unicode spaces or added
tokens, take `repaired`, which cuts anywhere and encodes a growing window around each join again until its
ids agree with both chunks.

The stores of a worker are emptied when they reach `STORE` ids, so memory is bounded whatever the corpus;
nothing is shared between workers and nothing is lost with one. Tokens are those of the library's own
encode, without truncation or padding.

Edge cases: null and empty texts have no ids (n_tokens 0, hashes of no bytes); very long texts are one
block; repeated rows give equal rows; an empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

import bisect
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echofold.llm.vectext import HashTable, Slices, blocks, mixed

TOKENIZER = "byte_bpe_50k.json"
WINDOW, MASK, STORE = 24, 127, 8_000_000
_MARKS = np.zeros(256, bool)
_MARKS[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
_LETTER = np.zeros(256, np.uint8)
_LETTER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = 1
_BLANK = "\u0120"  # the byte-level sign of a blank
_SAFE = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z])")
_open: dict[str, Encoder] = {}


def _between(places: list[int], a: int, b: int) -> bool:
    i = bisect.bisect_left(places, a)
    return i < len(places) and places[i] <= b



def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _open:
        _open[path] = Encoder(path)
    return _open[path]


class Ragged:
    """Arrays of different lengths, one after the other, by number."""

    def __init__(self, kind: type) -> None:
        self.flat = np.zeros(1 << 16, kind)
        self.start, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.used = 0

    def add(self, numbers: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(numbers) and numbers[-1] >= len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.flat[self.used : self.used + len(flat)] = flat
        self.start[numbers] = self.used + np.cumsum(sizes) - sizes
        self.size[numbers] = sizes
        self.used += len(flat)

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(elements in a row, how many of each number)."""
        sizes = self.size[numbers]
        return sliced(self.flat, self.start[numbers], sizes), sizes


def sliced(flat: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[s : s + n] of all pairs, in a row."""
    if len(start) and (start[1:] == start[:-1] + sizes[:-1]).all():
        return flat[start[0] : start[-1] + sizes[-1]]
    at = np.repeat(start - (np.cumsum(sizes) - sizes), sizes)
    at += np.arange(len(at))
    return flat[at]


class Store:
    """Slice -> ids: found by hash, and right only if the bytes agree, too."""

    def __init__(self) -> None:
        self.table, self.ids, self.raw = HashTable(), Ragged(np.uint32), Ragged(np.uint8)

    def add(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray, raw: np.ndarray, lengths: np.ndarray) -> None:
        new = self.table.add(keys)
        self.ids.add(new, ids, sizes)
        self.raw.add(new, raw, lengths)

    def full(self) -> bool:
        return self.ids.used > STORE or self.raw.used > 4 * STORE or self.table.used > STORE // 6

    def agree(self, numbers: np.ndarray, data: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Whether the bytes kept under each number are those of the slice."""
        ok = self.raw.size[numbers] == lengths
        some = np.flatnonzero(ok)
        wrong = np.flatnonzero(self.raw.gather(numbers[some])[0] != sliced(data, start[some], lengths[some]))
        ok[some[np.searchsorted(np.cumsum(lengths[some]), wrong, "right")]] = False
        return ok


def firsts(keys: np.ndarray) -> np.ndarray:
    """Places of the first of each distinct key, in ascending order."""
    return np.sort(np.unique(keys, return_index=True)[1])


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        plain = {v: k for k, v in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        self.n_bytes = np.zeros(max(plain) + 2, np.int64)  # each character of a byte-level token is a byte
        self.n_bytes[list(plain)] = [len(t) for t in plain.values()]
        self.word_ids = self.tokenizer.model.tokenize
        pre = self.tokenizer.pre_tokenizer
        self.letters_alone = self.tokenizer.normalizer is None and pre is not None and [t for t, _ in pre.pre_tokenize_str("Ab cd")] == ["Ab", _BLANK + "cd"]
        self.pieces, self.chunks, self.joins = Store(), Store(), HashTable()
        self.made = self.seen = 0  # chunks that were encoded, and met

    def library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def odd_rows(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows in which a cut may not be safe: wide Unicode spaces, or text of an added token."""
        at: list[np.ndarray] = []
        if len(data) > 1 and (data >= 0xC2).any():
            a, b = data[:-1], data[1:]
            at.append(np.flatnonzero((a == 0xC2) & ((b == 0x85) | (b == 0xA0))))
            wide = np.flatnonzero(((a == 0xE2) & ((b == 0x80) | (b == 0x81))) | ((a == 0xE1) & (b == 0x9A)) | ((a == 0xE3) & (b == 0x80)))
            third = data[np.minimum(wide + 2, len(data) - 1)]
            at.append(wide[(third <= 0x8A) | np.isin(third, (0xA8, 0xA9, 0xAF, 0x9F))])
        raw = data.tobytes()
        for t in self.added:
            found, i = [], raw.find(t)
            while i >= 0:
                found.append(i)
                i = raw.find(t, i + 1)
            at.append(np.array(found, np.int64))
        return np.unique(np.searchsorted(offsets, np.concatenate(at), "right") - 1) if at else np.zeros(0, np.int64)

    @staticmethod
    def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pieces begin. A blank at the end of a row is judged by another row's byte; it then is a
        piece of its own or ends one, and the pre-tokenizer agrees with either."""
        n = len(data)
        cut = np.zeros(n + 1, bool)
        if n > 2:
            solid = data > 32
            lone = np.zeros(n, bool)
            lone[1:-1] = solid[:-2] & solid[2:]
            line = lone & (data == 10)
            lone &= (data == 32) | (data == 10)
            cut[:n] = lone
            cut[1:] |= line
            cut[1:n] |= _ALNUM[data[:-1]] & _MARKS[data[1:]]
        cut[offsets] = True
        cut[n] = False
        return np.flatnonzero(cut)

    def piece_numbers(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, whether the kept piece is this one)."""
        numbers = self.pieces.table.find(keys)
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            new = missing[firsts(keys[missing])]
            ids, sizes = self.encode_slices(data, start[new], end[new])
            lengths = end[new] - start[new]
            self.pieces.add(keys[new], ids, sizes, sliced(data, start[new], lengths), lengths)
            numbers[missing] = self.pieces.table.find(keys[missing])
        return numbers, self.pieces.agree(numbers, data, start, end - start)

    @staticmethod
    def lines(data: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> str:
        """The slices, a line each."""
        goal = np.cumsum(lengths + 1) - 1
        text = np.full(goal[-1] + 1, 10, np.uint8)
        text[np.repeat(goal - np.cumsum(lengths), lengths) + np.arange(lengths.sum())] = sliced(data, start, lengths)
        return text[:-1].tobytes().decode()

    def encode_slices(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids in a row and their counts. Plain slices go to the library as the lines of one text, which saves
        a call for each; a line end between them separates them and is one token itself. Slices of letters
        behind one blank at most are one pre-token and go to the library's model at once."""
        lengths = end - start
        counts = np.zeros(len(start), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []  # (numbers of slices, their ids in a row)
        first, second, last = data[start], data[np.minimum(start + 1, end - 1)], data[end - 1]
        letters = np.add.reduceat(_LETTER[sliced(data, start, lengths)], np.cumsum(lengths) - lengths, dtype=np.int64) if len(start) else lengths
        word = letters + (first == 32) == lengths if self.letters_alone else np.zeros(len(start), bool)
        word &= letters > 0
        if word.any():
            some = np.flatnonzero(word)
            each = [[t.id for t in self.word_ids(w)] for w in self.lines(data, start[some], lengths[some]).replace(" ", _BLANK).split("\n")]
            counts[some] = [len(x) for x in each]
            found.append((some, np.fromiter((i for x in each for i in x), np.uint32, counts[some].sum())))
        plain = np.flatnonzero(~word & (last > 32) & ((first > 32) | ((first == 32) & (lengths > 1) & (second > 32))))
        if len(plain):
            goal = np.cumsum(lengths[plain] + 1) - 1
            ids = np.array(self.library([self.lines(data, start[plain], lengths[plain])])[0], np.uint32)
            ends = np.cumsum(self.n_bytes[ids])
            at = np.searchsorted(ends, goal)
            between = at[:-1] + 1
            if at[-1] < len(ends) and (ends[at] == goal).all() and (ids[between] == ids[between[:1]]).all():
                counts[plain] = np.diff(at, prepend=-2) - 1
                counts[plain[0]] = at[0] + 1
                inside = np.ones(len(ids), bool)
                inside[between] = False
                found.append((plain, ids[inside]))
        rest = np.setdiff1d(np.arange(len(start)), np.concatenate([x for x, _ in found]) if found else [])
        if len(rest):
            each = self.library([data[s:e].tobytes().decode() for s, e in zip(start[rest].tolist(), end[rest].tolist(), strict=True)])
            counts[rest] = [len(x) for x in each]
            found.append((rest, np.array([i for x in each for i in x], np.uint32)))
        if len(found) == 1:
            return found[0][1], counts
        before = np.cumsum(counts) - counts
        out = np.zeros(counts.sum(), np.uint32)
        for numbers, ids in found:
            n = counts[numbers]
            out[np.repeat(before[numbers] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = ids
        return out, counts

    def encode_block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows in a row, ids of each row)."""
        n_rows = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n_rows, np.int64)
        if self.pieces.full():  # joins go by the numbers of pieces
            self.pieces, self.joins = Store(), HashTable()
        if self.chunks.full():
            self.chunks = Store()
        slices = Slices(data)
        start = self.piece_starts(data, offsets)
        end = np.append(start[1:], len(data))
        row = np.searchsorted(offsets, start, "right") - 1
        roll = slices.hashes(np.maximum(start - WINDOW, offsets[row]), start)
        cut = np.flatnonzero(((roll & np.uint64(MASK)) == 0) | (start == offsets[row]))
        c_start, c_end, c_row = start[cut], np.append(start[cut[1:]], len(data)), row[cut]
        plain = np.ones(n_rows, bool)
        plain[self.odd_rows(data, offsets)] = False
        numbers = self.chunk_numbers(data, slices, start, end, cut, c_start, c_end, plain[c_row])
        good = (numbers >= 0) & plain[c_row]
        good[good] = self.chunks.agree(numbers[good], data, c_start[good], (c_end - c_start)[good])
        plain[c_row[~good]] = False  # two slices of one hash: as rare as it may be, the row is encoded by itself
        joint = np.flatnonzero(plain[c_row] & (c_start != offsets[c_row]))
        plain[c_row[joint[~self.joins_agree(data, slices, start, end, cut[joint])]]] = False
        if plain.all():
            ids, sizes = self.chunks.ids.gather(numbers)
            return ids, np.bincount(c_row, sizes, n_rows).astype(np.int64)
        ids, sizes = self.chunks.ids.gather(numbers[plain[c_row]])
        counts = np.bincount(c_row[plain[c_row]], sizes, n_rows).astype(np.int64)
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for i in np.flatnonzero(~plain).tolist():
            parts[i] = np.array(self.repaired(data[offsets[i] : offsets[i + 1]].tobytes().decode()), np.uint32)
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def chunk_numbers(self, data: np.ndarray, slices: Slices, start: np.ndarray, end: np.ndarray, cut: np.ndarray, c_start: np.ndarray, c_end: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Numbers of the chunks, those not met before being encoded from their pieces; -1 for what is not
        wanted or has a piece that cannot be trusted."""
        keys = slices.hashes(c_start, c_end)
        numbers = self.chunks.table.find(keys)
        self.seen += len(keys)
        missing = np.flatnonzero((numbers < 0) & wanted)
        if len(missing):
            new = missing[firsts(keys[missing])]
            self.made += len(new)
            counts = np.append(cut[1:], len(start))[new] - cut[new]
            first = np.cumsum(counts) - counts
            mine = np.repeat(cut[new] - first, counts) + np.arange(counts.sum())
            piece, right = self.piece_numbers(data, start[mine], end[mine], slices.hashes(start[mine], end[mine]))
            if not right.all():
                sure = np.logical_and.reduceat(right, first)
                piece, new, counts = piece[np.repeat(sure, counts)], new[sure], counts[sure]
                first = np.cumsum(counts) - counts
            if len(new):
                ids, sizes = self.pieces.ids.gather(piece)
                lengths = c_end[new] - c_start[new]
                self.chunks.add(keys[new], ids, np.add.reduceat(sizes, first), sliced(data, c_start[new], lengths), lengths)
                numbers[missing] = self.chunks.table.find(keys[missing])
        return numbers

    def joins_agree(self, data: np.ndarray, slices: Slices, start: np.ndarray, end: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether the pieces on both sides of each join (before piece `at`), encoded again as one, keep the ids
        they have apart. A pair of pieces is encoded once, wherever it joins chunks."""
        if not len(at):
            return np.zeros(0, bool)
        both = np.concatenate([at - 1, at])
        piece, right = self.piece_numbers(data, start[both], end[both], slices.hashes(start[both], end[both]))
        left, after = piece[: len(at)], piece[len(at) :]
        code = mixed(left.astype(np.uint64) << np.uint64(32) | after.astype(np.uint64))
        known = self.joins.find(code) >= 0
        fresh = np.flatnonzero(~known)
        if len(fresh):
            new = fresh[firsts(code[fresh])]
            a, b = at[new] - 1, at[new]
            ids, sizes = self.encode_slices(data, start[a], end[b])
            pair = np.stack([left[new], after[new]], 1).reshape(-1)
            apart, n = self.pieces.ids.gather(pair)
            n = n.reshape(-1, 2).sum(1)
            same = sizes == n
            some = np.flatnonzero(same)
            ends, others = np.cumsum(sizes) - sizes, np.cumsum(n) - n
            wrong = np.flatnonzero(sliced(ids, ends[some], sizes[some]) != sliced(apart, others[some], n[some]))
            same[some[np.searchsorted(np.cumsum(n[some]), wrong, "right")]] = False
            self.joins.add(code[new[same]])
            known = self.joins.find(code) >= 0
        return known & right[: len(at)] & right[len(at) :]

    def repaired(self, text: str, window: int = 32, size: int = 1024) -> list[int]:
        """Ids by chunks of about `size` characters, cut anywhere, their joins re-encoded until they agree.
        A cut needs places nearby, on both sides, where the pre-tokenizer always separates."""
        safe = [m.start() for m in _SAFE.finditer(text)] if len(text) > 2 * size else []
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint8)
        sums = Slices(codes)
        at = np.arange(WINDOW, len(text))
        cuts = [0]
        for c in at[(sums.hashes(4 * (at - WINDOW), 4 * at) & np.uint64(size - 1)) == 0].tolist() if safe else []:
            if c - cuts[-1] >= size and len(text) - c >= size and _between(safe, c - size // 2, c - window) and _between(safe, c + window, c + size // 2):
                cuts.append(c)
        cuts.append(len(text))
        done = self.spans(text, 0, cuts[1])
        for a, b in zip(cuts[1:-1], cuts[2:], strict=True):
            self.join(text, done, self.spans(text, a, b), a, window, safe)
        return [i for i, _, _ in done]

    def spans(self, text: str, a: int, b: int) -> list[tuple[int, int, int]]:
        e = self.tokenizer.encode(text[a:b], add_special_tokens=False)
        return [(i, a + x, a + y) for i, (x, y) in zip(e.ids, e.offsets, strict=True)]

    def join(self, text: str, left: list, right: list, cut: int, window: int, safe: list[int]) -> None:
        """Appends `right` to `left`, the tokens around `cut` taken from a window encoded again. The window
        reaches from safe place to safe place; its tokens up to the next safe place inside it must be
        those that were there, on both sides, or it is doubled."""
        end = right[-1][2]
        while True:
            i, j = bisect.bisect_right(safe, cut - window) - 1, bisect.bisect_left(safe, cut + window)
            lo = safe[i] if i >= 0 else 0
            hi = safe[j] if j < len(safe) and safe[j] < end else end
            middle = self.spans(text, lo, hi)
            inner_lo = safe[i + 1] if i + 1 < len(safe) and safe[i + 1] <= cut else lo
            inner_hi = safe[j - 1] if hi < end and j and safe[j - 1] >= cut else hi
            k = len(left)
            while k and left[k - 1][1] >= lo:
                k -= 1
            rest = next((n for n, t in enumerate(right) if t[1] >= hi), len(right))
            head = [t for t in middle if t[2] <= inner_lo] == [t for t in left[k:] if t[2] <= inner_lo]
            tail = [t for t in middle if t[1] >= inner_hi] == [t for t in right[:rest] if t[1] >= inner_hi]
            if (head and tail) or (lo == 0 and hi == end):
                left[k:] = middle + right[rest:]
                return
            window *= 2

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        rows = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] if len(counts) else []
        return self.tokenizer.decode_batch(rows, skip_special_tokens=False)


def encode_rows(texts: pa.Array, path: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, ids, ids of each row) over the blocks of a text column."""
    enc = encoder(path)
    for first, last, data, offsets in blocks(texts):
        ids, counts = enc.encode_block(data, offsets)
        yield first, last, ids, counts


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit), decoded_sha256, and with
    `keep_ids` the ids."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, ids, counts in encode_rows(b.column(1), path):
                ends = np.cumsum(counts)
                raw = ids.astype("<u4")
                cols = {
                    "doc_id": b.column(0).slice(first, last - first),
                    "n_tokens": pa.array(counts),
                    "ids_sha256": pa.array([hashlib.sha256(raw[e - c : e].tobytes()).hexdigest() for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]),
                    "decoded_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in encoder(path).decode(ids, counts)]),
                }
                if keep_ids:
                    cols["ids"] = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
