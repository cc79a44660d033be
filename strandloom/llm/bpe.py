"""Token counts and ids by rank-synchronous array merging.

Texts become arrays of code points; classes of characters split them into pre-tokens, and a
pre-token is known by a 64-bit rolling hash.  New pre-tokens are held as one ragged numpy array
of symbols; in each round every pre-token applies its own lowest-rank pair, all at the same
time, until none has a pair left.  What survives are its tokens.

This reads vocabularies of the ``tokenizers`` library whose pre-tokens are contractions, runs of
letters, single digits and runs of other signs, with byte symbols and a word-end suffix.  Texts
with the vocabulary's special strings or with characters whose normal form or lower case is not
one-to-one are rare; the library itself takes those.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

SPACE, LETTER, NUMBER, OTHER, ODD = range(5)
#: Unicode's White_Space property (fixed values).
SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: The contractions that the pre-tokenizer knows (fixed values).
CONTRACTIONS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"]
#: Characters of one array slice, and known pre-tokens per process at most.
SLICE_CHARS, CACHE_WORDS = 200_000, 300_000
NO_RANK = np.iinfo(np.int32).max
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


@lru_cache(1)
def classes() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of every code point."""
    kind = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    low = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        cat = unicodedata.category(ch)
        if cat[0] == "L":
            kind[c] = LETTER
        elif cat[0] == "N":
            kind[c] = NUMBER
        elif cat == "Cn":
            kind[c] = ODD
        if c < 0x20000 and (small := ch.lower()) != ch:
            if len(small) == 1:
                low[c] = ord(small)
            else:
                kind[c] = ODD
    kind[SPACES] = SPACE
    kind[[0x3A3, 0xFFFD]] = ODD  # sigma has two lower cases
    return kind, low


@lru_cache(1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        base = np.full(n, _BASE, np.uint64)
        base[0] = 1
        inverse = np.full(n, pow(_BASE, -1, 2**64), np.uint64)
        inverse[0] = 1
        return np.cumprod(base), np.cumprod(inverse)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, extra = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in names:
            names[b] = chr(extra)
            extra += 1
    return [names[b] for b in range(256)]


class WordBpe:
    """A vocabulary as arrays, and the pre-tokens seen so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.path = path
        self.specials = [t["content"] for t in spec["added_tokens"]]
        names = byte_symbols()
        self.inner = np.array([vocab[n] for n in names], np.int64)
        self.final = np.array([vocab[n + suffix] for n in names], np.int64)
        pairs = [(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.result = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.bits = 20
        self.slot_key = np.full(1 << self.bits, -1, np.int64)
        self.slot_rank = np.full(1 << self.bits, NO_RANK, np.int32)
        for rank, (key, at) in enumerate(zip(keys.tolist(), self._slot(keys).tolist(), strict=True)):
            while self.slot_key[at] not in (-1, key):
                at = (at + 1) & ((1 << self.bits) - 1)
            if self.slot_key[at] == -1:
                self.slot_key[at], self.slot_rank[at] = key, rank
        self._library = None
        self._empty_cache()

    def _empty_cache(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(_BASE)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _ranks(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        found = self.slot_key[at]
        ranks = np.where(found == keys, self.slot_rank[at], NO_RANK)
        more = np.flatnonzero((found != keys) & (found != -1))
        while len(more):
            at[more] = (at[more] + 1) & ((1 << self.bits) - 1)
            found = self.slot_key[at[more]]
            hit = found == keys[more]
            ranks[more[hit]] = self.slot_rank[at[more[hit]]]
            more = more[~hit & (found != -1)]
        return ranks

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each word: their counts, and all ids one after the other."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym = self.inner[raw]
        sym[ends - 1] = self.final[raw[ends - 1]]
        owner = np.repeat(np.arange(len(words)), lengths)
        done_owner, done_sym = [], []
        while len(sym):
            same = owner[1:] == owner[:-1]
            rank = np.full(len(sym), NO_RANK, np.int32)
            rank[:-1][same] = self._ranks((sym[:-1] << 32 | sym[1:])[same])
            first = np.flatnonzero(np.r_[True, ~same])
            sizes = np.diff(np.r_[first, len(sym)])
            best = np.repeat(np.minimum.reduceat(rank, first), sizes)
            over = best == NO_RANK
            if over.any():
                done_owner.append(owner[over])
                done_sym.append(sym[over])
                live = ~over
                sym, owner, rank, best = sym[live], owner[live], rank[live], best[live]
                if not len(sym):
                    break
            take = rank == best
            # of pairs that overlap (one symbol again and again) every second is taken
            twice = take[1:] & take[:-1]
            if twice.any():
                spots = np.flatnonzero(take)
                fresh = np.r_[True, np.diff(spots) > 1]
                nth = np.arange(len(spots)) - np.maximum.accumulate(np.where(fresh, np.arange(len(spots)), 0))
                take[spots[nth % 2 == 1]] = False
            sym[take] = self.result[rank[take]]
            stay = np.r_[True, ~take[:-1]]
            sym, owner = sym[stay], owner[stay]
        owner, sym = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_owner, done_sym))
        order = np.argsort(owner, kind="stable")
        return np.bincount(owner, minlength=len(words)), sym[order].astype(np.int32)

    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._library.no_truncation()
            self._library.no_padding()
        return self._library

    def _spans(self, chars: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pre-tokens; the slice ends with a space."""
        new = np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)])
        end = np.r_[new[1:], len(kind)]
        solid = kind[new] != SPACE
        new, end = new[solid], end[solid]
        lone = np.flatnonzero((chars[new] == ord("'")) & (end - new == 1) & (kind[end % len(kind)] == LETTER))
        if not len(lone):
            return new, end
        cut = np.zeros(len(lone), np.int64)
        one, two = chars[end[lone]], chars[np.minimum(end[lone] + 1, len(chars) - 1)]
        for c in CONTRACTIONS:
            if len(c) == 2:
                cut[(cut == 0) & (one == ord(c[1]))] = 1
            else:
                cut[(cut == 0) & (one == ord(c[1])) & (two == ord(c[2]))] = 2
        lone, cut = lone[cut > 0], cut[cut > 0]
        end[lone] += cut
        new[lone + 1] += cut  # the run of letters that follows; it may be used up
        full = new < end
        return new[full], end[full]

    def _tokens_of(self, chars: np.ndarray, new: np.ndarray, end: np.ndarray, with_ids: bool):
        """For each pre-token the place in (start, count, flat)."""
        base, inverse = powers(1 << max(19, int(len(chars) + 2).bit_length()))
        with np.errstate(over="ignore"):
            mixed = (chars.astype(np.uint64) + np.uint64(0x51ED)) * np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(32)
            total = np.zeros(len(chars) + 1, np.uint64)
            np.cumsum(mixed * base[: len(chars)], out=total[1:])
            key = (total[end] - total[new]) * inverse[new]
        unique, at, back = np.unique(key, return_index=True, return_inverse=True)
        where = np.searchsorted(self.known, unique)
        hit = np.zeros(len(unique), bool)
        if len(self.known):
            hit = self.known[np.minimum(where, len(self.known) - 1)] == unique
        start, count = np.zeros(len(unique), np.int64), np.zeros(len(unique), np.int64)
        start[hit], count[hit] = self.start[where[hit]], self.count[where[hit]]
        flat = self.flat
        miss = np.flatnonzero(~hit)
        if len(miss):
            text = chars.tobytes().decode("utf-32-le")
            words = [text[a:b].encode() for a, b in zip(new[at[miss]].tolist(), end[at[miss]].tolist(), strict=True)]
            n, ids = self.merge(words)
            count[miss] = n
            start[miss] = len(flat) + np.cumsum(n) - n
            flat = np.r_[flat, ids]
            if len(self.known) < CACHE_WORDS:
                self.flat = flat
                known = np.r_[self.known, unique[miss]]
                order = np.argsort(known, kind="stable")
                self.known = known[order]
                self.start = np.r_[self.start, start[miss]][order]
                self.count = np.r_[self.count, count[miss]][order]
        return start[back], count[back], flat

    def encode(self, texts: list[str | None], with_ids: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
        """Yields (index of the first text, token counts, ids one after the other) for texts in order."""
        kind_of, low = classes()
        begin = 0
        while begin < len(texts):
            stop, chars_in = begin, 0
            while stop < len(texts) and (stop == begin or chars_in + len(texts[stop] or "") < SLICE_CHARS):
                chars_in += len(texts[stop] or "") + 1
                stop += 1
            part = [t or "" for t in texts[begin:stop]]
            odd = [any(s in t for s in self.specials) or not (t.isascii() or unicodedata.is_normalized("NFC", t)) for t in part]
            plain = ["" if o else t for t, o in zip(part, odd, strict=True)]
            if chars_in > 4 * SLICE_CHARS:
                yield begin, *self._long(part[0], odd[0])
                begin = stop
                continue
            chars = np.frombuffer((" ".join(plain) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
            lengths = np.fromiter(map(len, plain), np.int64, len(plain)) + 1
            text_end = np.cumsum(lengths)
            kind = kind_of[chars]
            if (strange := np.flatnonzero(kind == ODD)).size:
                for i in np.unique(np.searchsorted(text_end, strange, side="right")).tolist():
                    odd[i] = True
                kind = np.where(kind == ODD, np.uint8(OTHER), kind)
            chars = low[chars]
            new, end = self._spans(chars, kind)
            counts = np.zeros(len(part), np.int64)
            ids = np.zeros(0, np.int32)
            if len(new):
                start, count, flat = self._tokens_of(chars, new, end, with_ids)
                owner = np.searchsorted(text_end, new, side="right")
                counts = np.bincount(owner, weights=count, minlength=len(part)).astype(np.int64)
                if with_ids:
                    ids = flat[np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())]
            if any(odd):
                counts, ids = self._mend(part, odd, counts, ids, with_ids)
            yield begin, counts, ids if with_ids else None
            begin = stop

    def _mend(self, part, odd, counts, ids, with_ids):
        places = [i for i, o in enumerate(odd) if o]
        said = self.library().encode_batch([part[i] for i in places], add_special_tokens=False)
        pieces = np.split(ids, np.cumsum(counts)[:-1]) if with_ids else None
        for i, e in zip(places, said, strict=True):
            counts[i] = len(e.ids)
            if with_ids:
                pieces[i] = np.array(e.ids, np.int32)
        return counts, np.concatenate(pieces) if with_ids else ids

    def _long(self, text: str, odd: bool) -> tuple[np.ndarray, np.ndarray]:
        """One very long text, cut at white space into slices that are worked off in turn."""
        if odd:
            ids = np.array(self.library().encode(text, add_special_tokens=False).ids, np.int32)
            return np.array([len(ids)]), ids
        cuts, at = [], 0
        while at < len(text):
            to = min(len(text), at + SLICE_CHARS)
            while to < len(text) and ord(text[to]) not in SPACES:
                to += 1
            cuts.append(text[at:to])
            at = to
        ids = np.concatenate([i for _, _, i in self.encode(cuts)])
        return np.array([len(ids)]), ids


_LOADED: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """The vocabulary, once in a process.  A name without a folder is one of the installed public ones,
    which each worker finds for itself."""
    if path not in _LOADED:
        place = path
        if "/" not in path:
            import public_tokenizers

            place = public_tokenizers.path(path)
        _LOADED[path] = WordBpe(place)
    return _LOADED[path]
