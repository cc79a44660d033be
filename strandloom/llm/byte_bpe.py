"""Byte-level BPE: texts to token ids and back.

Texts are split into pre-tokens on arrays of code points.  A pre-token that is a token of the
vocabulary as a whole is resolved by a minimal perfect hash; any other is merged with a heap over
linked bytes, lowest rank first: short ones many at a time, each with its heap, long ones singly.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import CONTRACTIONS, LETTER, NUMBER, OTHER, SPACE
from .common import on_workers
from .perfect_hash import PerfectHash, hashes, padded, same_bytes
from .ragged import byte_slices, gathered

#: Pre-tokens of at most so many bytes are merged together, in classes of size and so many at a time.
TOGETHER, SIZES, PIECES = 64, ((0, 8), (8, 16), (16, 32), (32, 64)), 20_000
NO_RANK, FAR = np.iinfo(np.int32).max, np.iinfo(np.int64).max


@lru_cache(1)
def kinds() -> np.ndarray:
    """Class of every code point, as the pattern's ``\\p{L}``, ``\\p{N}`` and ``\\s`` have it.

    Versions of Unicode differ in what is a letter; the library's own is found by asking it which
    characters match.
    """
    import tiktoken

    out = np.full(0x110000, OTHER, np.uint8)
    every = np.r_[0:0xD800, 0xE000:0x110000].astype(np.uint32).tobytes().decode("utf-32-le")
    singles = {bytes([b]): b for b in range(256)}
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        asked = tiktoken.Encoding("matches", pat_str=pattern, mergeable_ranks=singles, special_tokens={})
        matched = bytes(asked.encode_ordinary(every)).decode("utf-8")
        out[np.frombuffer(matched.encode("utf-32-le"), np.uint32)] = kind
    return out


def pretoken_starts(chars: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Places where pre-tokens begin, in texts (none empty) that follow each other; each ends where the next begins.

    The pattern: contractions; runs of letters, of digits, or of other signs, each with a space before
    it; white space, of which the last character is left to what follows.
    """
    n, kind = len(chars), kinds()[chars]
    first = np.zeros(n + 1, bool)
    first[text_starts] = first[n] = True
    new = first.copy()
    new[1:n] |= kind[1:] != kind[:-1]
    starts = np.flatnonzero(new[:n])
    ends = np.r_[starts[1:], n]
    run = kind[starts]
    begins = new[:n].copy()
    blank = run == SPACE
    # a space goes with the run behind it
    follows = np.flatnonzero(~blank & ~first[starts] & (chars[np.maximum(starts - 1, 0)] == 32))
    begins[starts[follows]] = False
    begins[ends[blank & ~first[ends]] - 1] = True
    # contractions begin at an apostrophe that stands alone and has no space with it
    attached = np.zeros(len(starts), bool)
    attached[follows] = True
    lone = (chars[starts] == ord("'")) & (ends - starts == 1) & ~attached & ~first[ends]
    at = starts[np.flatnonzero(lone)]
    cut = np.zeros(len(at), np.int64)
    one, two = chars[np.minimum(at + 1, n - 1)], chars[np.minimum(at + 2, n - 1)]
    inside = ~first[np.minimum(at + 2, n)]
    for c in CONTRACTIONS:
        hit = (one == ord(c[1])) & ((len(c) == 2) | inside & (two == ord(c[-1])))
        cut[hit & (cut == 0)] = len(c) - 1
    at, cut = at[cut > 0], cut[cut > 0]
    begins[at + 1] = False
    rest = at + 1 + cut
    begins[rest[rest < n]] = True
    return np.flatnonzero(begins)


class PairRanks:
    """The rank of what two neighbouring tokens make together, for many pairs at a time."""

    def __init__(self, rank: dict[bytes, int]):
        found = {}
        for token, r in rank.items():
            for cut in range(1, len(token)):
                left, right = rank.get(token[:cut]), rank.get(token[cut:])
                if left is not None and right is not None:
                    found[left << 32 | right] = r
        keys, ranks = np.array(list(found), np.int64), np.array(list(found.values()), np.int32)
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.key, self.rank = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NO_RANK, np.int32)
        at = self._slot(keys)
        while len(keys):
            free = self.key[at] == -1
            slots, first = np.unique(np.where(free, at, -1), return_index=True)
            first = first[slots >= 0]
            self.key[at[first]], self.rank[at[first]] = keys[first], ranks[first]
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, ranks, at = keys[left], ranks[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        at = self._slot(keys)
        held = self.key[at]
        out = np.where(held == keys, self.rank[at], NO_RANK)
        more = np.flatnonzero((held != keys) & (held != -1))
        while len(more):
            at[more] = (at[more] + 1) & ((1 << self.bits) - 1)
            held = self.key[at[more]]
            hit = held == keys[more]
            out[more[hit]] = self.rank[at[more[hit]]]
            more = more[~hit & (held != -1)]
        return out


class ByteBpe:
    """A vocabulary of ranks: every single byte is a token, and ids are ranks."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.rank = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.hash = PerfectHash(list(self.rank))
        self.id_of_key = np.fromiter(self.rank.values(), np.int64, len(self.rank))
        self.pairs = PairRanks(self.rank)
        self.byte_id = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        first, second = np.divmod(np.arange(65536), 256)
        self.byte_pairs = self.pairs(self.byte_id[first], self.byte_id[second])
        by_id = {r: t for t, r in self.rank.items()}
        listed = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.size = np.fromiter(map(len, listed), np.int64, len(listed))
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(listed), np.uint8)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token.  A piece of n bytes takes O(n log n) time and about 60 n bytes of memory."""
        rank, n, longest = self.rank, len(piece), self.hash.longest
        bits = longest.bit_length()
        after = array("q", range(1, n + 1))  # where the token that begins here ends; -1 if none does
        before = array("q", range(-1, n - 1))
        heap = [(r << 40 | i) << bits | 2 for i in range(n - 1) if (r := rank.get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i = entry >> bits & 0xFFFFFFFFFF
            e = i + (entry & (1 << bits) - 1)
            j = after[i]
            if j < 0 or j >= n or after[j] != e:
                continue  # one of the two has been merged with another since
            after[i], after[j] = e, -1
            if e < n:
                before[e] = i
                end = after[e]
                if end - i <= longest and (r := rank.get(piece[i:end])) is not None:
                    heappush(heap, (r << 40 | i) << bits | end - i)
            p = before[i]
            if p >= 0 and e - p <= longest and (r := rank.get(piece[p:e])) is not None:
                heappush(heap, (r << 40 | p) << bits | e - p)
        out, i = [], 0
        while i < n:
            out.append(rank[piece[i : after[i]]])
            i = after[i]
        return out

    def merge_many(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pre-tokens of at most ``TOGETHER`` bytes: their counts, and all ids one after the other.

        Every piece has a heap of its own, and all take one step at a time.  A heap has a leaf for each
        byte, which holds (rank, place) of the pair that begins there; a node holds the smaller of its
        children, so the next pair is at the root, and none is ever out of date.
        """
        rows, width = len(start), 1 << int(size.max() - 1).bit_length() if len(size) else 1
        width = max(width, 2)
        place = np.arange(width)
        inside = place < size[:, None]
        raw = data[np.minimum(start[:, None] + place, len(data) - 1)]
        token = np.where(inside, self.byte_id[raw], -1)
        after = np.minimum(place + 1, size[:, None]).astype(np.int32)
        before = np.broadcast_to(np.arange(-1, width, dtype=np.int32), (rows, width + 1)).copy()
        heap = np.full((rows, 2 * width), NO_RANK, np.int64)
        ranks = self.byte_pairs[raw[:, :-1].astype(np.int64) << 8 | raw[:, 1:]].astype(np.int64)
        heap[:, width:-1] = np.where((ranks != NO_RANK) & inside[:, 1:], ranks * width + place[:-1], FAR)
        heap[:, -1] = FAR
        level = width
        while level > 1:
            heap[:, level // 2 : level] = np.minimum(heap[:, level : 2 * level : 2], heap[:, level + 1 : 2 * level : 2])
            level //= 2
        token_, after_, before_, heap_ = token.ravel(), after.ravel(), before.ravel(), heap.ravel()
        live = np.arange(rows)
        while len(live):
            root = heap_[live * (2 * width) + 1]
            some = root < FAR
            live, root = live[some], root[some]
            at = root % width
            own, end = live * width, size[live]
            right = after_[own + at].astype(np.int64)
            far = after_[own + right].astype(np.int64)
            merged = (root // width).astype(np.int32)
            token_[own + at], token_[own + right] = merged, -1
            after_[own + at] = far
            before_[live * (width + 1) + far] = at
            left = before_[live * (width + 1) + at].astype(np.int64)
            leaf = live * (2 * width) + width
            heap_[leaf + right] = FAR
            heap_[leaf + at] = FAR
            more = np.flatnonzero(far < end)
            heap_[(leaf + at)[more]] = self._entries(merged[more], token_[(own + far)[more]], at[more], width)
            more = np.flatnonzero(left >= 0)
            heap_[(leaf + left)[more]] = self._entries(token_[(own + left)[more]], merged[more], left[more], width)
            tree = live * (2 * width)
            nodes = [width + at, width + right, width + np.where(left >= 0, left, at)]
            for _ in range(width.bit_length() - 1):
                for k in range(3):
                    nodes[k] = nodes[k] >> 1
                    child = tree + 2 * nodes[k]
                    heap_[tree + nodes[k]] = np.minimum(heap_[child], heap_[child + 1])
        stay = token >= 0
        return stay.sum(1), token[stay].astype(np.int64)

    def _entries(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
        ranks = self.pairs(left, right).astype(np.int64)
        return np.where(ranks != NO_RANK, ranks * width + place, FAR)

    def _missed(self, data: np.ndarray, words: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that are no tokens as a whole; equal ones are merged once."""
        code = hashes(words, start, np.minimum(size, TOGETHER))
        code[size > TOGETHER] = np.arange((size > TOGETHER).sum())
        _, first, back = np.unique(code, return_index=True, return_inverse=True)
        # a piece stands for others only if it has their size and all of their bytes
        same = size[first[back]] == size
        some = np.flatnonzero(same & (first[back] != np.arange(len(start))))
        same[some] = same_bytes(words, start[some], start[first[back[some]]], np.minimum(size[some], TOGETHER))
        odd = np.flatnonzero(~same)
        back[odd] = len(first) + np.arange(len(odd))
        first = np.r_[first, odd]
        counts, lists = np.zeros(len(first), np.int64), np.zeros(0, np.int64)
        starts, begun = np.zeros(len(first), np.int64), 0
        flat = []
        own_size = size[first]
        for low, high in SIZES:
            part = np.flatnonzero((own_size > low) & (own_size <= high))
            for at in range(0, len(part), PIECES):
                few = part[at : at + PIECES]
                counts[few], ids = self.merge_many(data, start[first[few]], own_size[few])
                starts[few] = begun + np.cumsum(counts[few]) - counts[few]
                flat.append(ids)
                begun += len(ids)
        for i in np.flatnonzero(own_size > TOGETHER).tolist():
            a = start[first[i]]
            ids = np.array(self.merge(data[a : a + own_size[i]].tobytes()), np.int64)
            counts[i], starts[i] = len(ids), begun
            flat.append(ids)
            begun += len(ids)
        lists = np.concatenate(flat) if flat else lists
        return counts[back], gathered(lists, starts[back], counts[back])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each text data[offsets[i]:offsets[i + 1]] (UTF-8): their counts, and all ids one after the other."""
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(n, np.int64), np.zeros(0, np.int64)
        chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        byte_of = np.flatnonzero((data & 0xC0) != 0x80)  # where each character begins
        full = np.flatnonzero(np.diff(offsets))
        begins = pretoken_starts(chars, np.searchsorted(byte_of, offsets[full]))
        start = byte_of[begins]
        size = np.diff(np.r_[start, len(data)])
        words = padded(data, max(self.hash.longest, TOGETHER))
        key = self.hash.find(words, start, size)
        missed = np.flatnonzero(key < 0)
        count = np.ones(len(start), np.int64)
        count[missed], merged = self._missed(data, words, start[missed], size[missed])
        ids = np.empty(int(count.sum()), np.int64)
        place = np.cumsum(count) - count
        ids[place[key >= 0]] = self.id_of_key[key[key >= 0]]
        many = count[missed]
        spots = np.repeat(place[missed] - (np.cumsum(many) - many), many)
        ids[spots + np.arange(len(spots))] = merged
        owner = np.searchsorted(offsets, start, side="right") - 1
        return np.bincount(owner, weights=count, minlength=n).astype(np.int64), ids

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens, one after the other.  An id outside the vocabulary raises."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size) or not self.size[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        return gathered(self.flat, self.start[ids], self.size[ids])


_LOADED: dict[str, ByteBpe] = {}


def load(path: str) -> ByteBpe:
    """The vocabulary, once in a process.  A name without a folder is one of the installed public ones."""
    if path not in _LOADED:
        place = path
        if "/" not in path:
            import public_tokenizers

            place = public_tokenizers.path(path)
        _LOADED[path] = ByteBpe(place)
    return _LOADED[path]


def _list_array(sizes: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), values)


def encoded(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of every row, without special tokens; ``vocabulary`` is a file of ranks, or its public name.

    Null and empty texts have no ids.  Ids of rows may be null or repeat.  Other columns are ignored; an
    empty table gives no rows; nothing is shuffled.  Whole texts are worked off, some megabytes of them at a
    time.
    """
    source = on_workers(docs).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            for first, data, offsets in byte_slices(batch.column(1)):
                counts, ids = bpe.encode(data, offsets)
                lists = _list_array(counts, pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(counts)), lists], ["doc_id", "ids"])

    return source.mapInArrow(encode, f"doc_id {id_type}, ids array<int>")


def decoded(rows: DataFrame, vocabulary: str, *, ids_col: str = "ids", out_col: str = "bytes") -> DataFrame:
    """``rows`` with the bytes of their token ids as ``out_col`` (a column of that name is replaced); null ids give null.

    An id that the vocabulary lacks raises an error.  Tokens may cut characters, so bytes of a part of a
    text need not be UTF-8.
    """
    source = on_workers(rows.drop(out_col))
    names = source.columns
    at = names.index(ids_col)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            for row in range(0, batch.num_rows, 256):
                part = batch.slice(row, 256)
                lists = part.column(at)
                ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                sizes = np.r_[0, np.cumsum(bpe.size[ids])] if len(ids) else np.zeros(1, np.int64)
                ends = sizes[np.r_[0, np.cumsum(counts)]]
                out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(bpe.decode(ids))])
                out = pc.if_else(lists.is_valid(), out, pa.scalar(None, pa.large_binary())).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, out], [*names, out_col])

    kinds_ = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema)
    return source.mapInArrow(decode, f"{kinds_}`{out_col}` binary")
