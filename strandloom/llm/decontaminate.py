"""Benchmark decontamination by the q-gram lemma.

An item of m characters that occurs in a text with at most k edits shares at least
m - q + 1 - k q of its q-grams with the text, all of them on diagonals (place in the text less
place in the item) that lie within k of each other.  So the shared q-grams of every item are
counted in overlapping bands of diagonals; bands that reach the bound are aligned, within the
band only, and those within k edits are matches.

The benchmark is a stated query set: it is collected in blocks of bounded size, and each block is
held against all texts and freed before the next.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .bpe import SPACE
from .chars import Slice, mix, slices, tables
from .common import on_workers, smaller, written

FILTER_BITS = 22
#: Counts of shared q-grams that are worked off at a time.
CHUNK = 500_000


def normalise(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower case, with one space for each run of white space.

    Returns the characters, each one's place in the slice, and begin and end of every text.
    """
    kind, low, _ = tables()
    space = kind[part.chars] == SPACE
    space[part.end] = True
    keep = ~(space & np.r_[False, space[:-1]])
    keep[part.end] = True  # the end of each text stays
    place = np.flatnonzero(keep)
    chars = np.where(space[place], np.uint32(32), low[part.chars[place]])
    end = np.searchsorted(place, part.end)
    begin = np.r_[0, end[:-1] + 1][: len(end)]
    return chars, place, begin, end


def grams(chars: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q characters from each place on."""
    n = max(0, len(chars) - q + 1)
    value = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(q):
            value = value * np.uint64(0x100000001B3) + chars[i : i + n]
    return mix(value)


@dataclass
class Items:
    """A block of benchmark items: their q-grams, sorted, with item and places.

    Neighbouring places of one and the same q-gram are one entry, so a ruled line has few.
    """

    ids: list
    texts: list[np.ndarray]
    q: int
    budget: np.ndarray  # edits allowed
    bound: np.ndarray  # q-grams that must be shared
    hashes: np.ndarray
    begin: np.ndarray  # of each distinct hash in item, first and last
    item: np.ndarray
    first: np.ndarray
    last: np.ndarray
    seen: np.ndarray

    @classmethod
    def build(cls, ids: list, raw: list[str], q: int, rate: float) -> Items:
        texts, kept = [], []
        for id_, text in zip(ids, raw, strict=True):
            part = next(iter(slices([text])))
            chars, _, begin, end = normalise(part)
            chars = chars[begin[0] : end[0]]
            chars = chars[1:] if len(chars) and chars[0] == 32 else chars
            chars = chars[:-1] if len(chars) and chars[-1] == 32 else chars
            if len(chars) >= q:
                texts.append(chars)
                kept.append(id_)
        size = np.array([len(t) for t in texts], np.int64)
        budget = np.minimum((size * rate).astype(np.int64), np.maximum((size - q) // q, 0))
        all_grams = [grams(t, q) for t in texts]
        flat = np.concatenate(all_grams) if texts else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(texts)), [len(g) for g in all_grams] if texts else [])
        place = np.concatenate([np.arange(len(g)) for g in all_grams]) if texts else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        flat, item, place = flat[order], item[order], place[order]
        head = np.flatnonzero(np.r_[True, (flat[1:] != flat[:-1]) | (item[1:] != item[:-1]) | (place[1:] != place[:-1] + 1)][: len(flat)])
        last = place[np.r_[head[1:], len(flat)][: len(head)] - 1]
        flat, item, first = flat[head], item[head], place[head]
        hashes, begin = np.unique(flat, return_index=True)
        seen = np.zeros(1 << FILTER_BITS, bool)
        seen[hashes >> np.uint64(64 - FILTER_BITS)] = True
        return cls(kept, texts, q, budget, np.maximum(1, size - q + 1 - budget * q), hashes, np.r_[begin, len(flat)], item, first, last, seen)


def align(item: np.ndarray, text: np.ndarray, first: int, width: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, begin, end) of the item's best occurrence with at most ``budget`` edits in a band of ``text``.

    The band are the ``width`` diagonals (place in the text less place in the item) from ``first``
    on; no cell outside it is looked at.  A row of the band is worked off as a vector, by its
    diagonals; begins travel with the costs, both in one number.
    """
    plain = text[max(0, first) : max(0, first + width - 1 + len(item))].tobytes().find(item.tobytes())
    if plain >= 0 and plain % text.itemsize == 0:  # nothing is better than an exact occurrence
        begin = max(0, first) + plain // text.itemsize
        return 0, begin, begin + len(item)
    scale, far = np.int64(len(text) + 1), np.int64(budget + 1)
    step = np.arange(width)
    padded = np.full(len(item) + width, -1, np.int64)  # the text under the band, from its first diagonal on
    lo, hi = max(0, first), min(len(text), first + len(padded))
    if lo < hi:
        padded[lo - first : hi - first] = text[lo:hi]
    spot = first + step
    cell = np.where((spot >= 0) & (spot <= len(text)), spot, far * scale)
    for i, c in enumerate(item.tolist()):
        across = cell + scale * (padded[i : i + width] != c)
        down = np.r_[cell[1:], far * scale] + scale
        best = np.minimum(across, down)
        spot = first + i + 1 + step
        best[(spot < 0) | (spot > len(text))] = far * scale
        # gaps in the item: the least of (cost - place) so far, plus the place
        cell = np.minimum.accumulate(best - step * scale) + step * scale
        cell[(spot < 0) | (spot > len(text))] = far * scale
        if cell.min() >= far * scale:
            return None
    end = int(cell.argmin())
    return int(cell[end] // scale), int(cell[end] % scale), first + len(item) + end


def _shared(spot: np.ndarray, at: np.ndarray, text: np.ndarray, begin: np.ndarray, lowest: int, block: Items) -> tuple[np.ndarray, np.ndarray]:
    """(band, q-grams shared in it) for hits of a text's q-gram (``spot``) with an item's (``at``).

    A band is one number: text, item and cell.  Diagonals are cut into cells as wide as the item's
    budget and one, and a band is a cell with the next one.  Hits are worked off in pieces of
    bounded size, and a run of neighbouring places counts once for each cell.
    """
    bands, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    size = (block.begin[at + 1] - block.begin[at]).astype(np.int64)
    for hits in _pieces(size):
        n = size[hits]
        entry = np.repeat(block.begin[at[hits]], n) + _count_up(n)
        t, place = np.repeat(text[hits], n), np.repeat(spot[hits], n)
        item = block.item[entry]
        width = block.budget[item] + 1
        low, high = (place - begin[t] - x - lowest for x in (block.last[entry], block.first[entry]))
        group = (t * np.int64(len(block.texts)) + item) << np.int64(32)
        cells = high // width - low // width + 1
        for p in _pieces(cells):
            c = cells[p]
            w, lo, hi = (np.repeat(x[p], c) for x in (width, low, high))
            cell = lo // w + _count_up(c)
            own = np.minimum(hi, (cell + 1) * w - 1) - np.maximum(lo, cell * w) + 1
            key = np.repeat(group[p], c) + cell
            bands, counts = _summed([*bands, key + 1, key], [*counts, own, own])
    return bands[0], counts[0]


def _pieces(sizes: np.ndarray) -> Iterator[slice]:
    """Slices of ``sizes`` that add up to ``CHUNK`` at most (or hold one number)."""
    total = np.r_[0, np.cumsum(sizes)]
    done = 0
    while done < len(sizes):
        stop = max(done + 1, int(np.searchsorted(total, total[done] + CHUNK, side="right")) - 1)
        yield slice(done, stop)
        done = stop


def _count_up(n: np.ndarray) -> np.ndarray:
    """0 .. n[0] - 1, then 0 .. n[1] - 1, and so on."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _summed(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    unique, back = np.unique(np.concatenate(keys), return_inverse=True)
    return [unique], [np.bincount(back, np.concatenate(values), len(unique)).astype(np.int64)]


def prepared(part: Slice, q: int) -> tuple[tuple, np.ndarray]:
    """A slice as the search wants it: normalised, with its q-grams; the same for all blocks."""
    normal = normalise(part)
    return normal, grams(normal[0], q)


def matches(part: Slice, block: Items, ready: tuple[tuple, np.ndarray] | None = None) -> list[tuple[int, int, int, int, int, int]]:
    """(text, item, begin, end, edits, shared) of the matches in a slice (``ready``: ``prepared``); places in the slice."""
    (chars, place, text_begin, text_end), hashed = ready or prepared(part, block.q)
    spot = np.flatnonzero(block.seen[hashed >> np.uint64(64 - FILTER_BITS)])
    at = np.searchsorted(block.hashes, hashed[spot])
    ok = block.hashes[np.minimum(at, len(block.hashes) - 1)] == hashed[spot]
    spot, at = spot[ok], at[ok]
    text = np.searchsorted(text_end, spot, side="right")
    inside = spot + block.q <= text_end[np.minimum(text, len(text_end) - 1)]
    spot, at, text = spot[inside], at[inside], text[inside]
    if not len(spot):
        return []
    # no diagonal lies below; band 0 is the one before the first cell
    lowest = -(max(map(len, block.texts)) + 1)
    bands, shared = _shared(spot, at, text, text_begin, lowest, block)
    group, cell = bands >> 32, bands & 0xFFFFFFFF
    text, item = group // len(block.texts), group % len(block.texts)
    out = []
    done: dict[tuple[int, int], int] = {}
    for i in np.flatnonzero(shared >= block.bound[item]).tolist():
        t, j, k = int(text[i]), int(item[i]), int(block.budget[item[i]])
        low = max(int(text_begin[t]), done.get((t, j), 0))  # what an overlapping band has matched is not matched again
        first = int(text_begin[t]) + (int(cell[i]) - 1) * (k + 1) + lowest - low  # the band's first diagonal, from there
        found = align(block.texts[j], chars[low : min(int(text_end[t]), low + max(0, first) + len(block.texts[j]) + 2 * (k + 1))], first, 2 * (k + 1), k)
        if found:
            edits, begin, end = found
            done[t, j] = low + end
            out.append((t, j, int(place[low + begin]), int(place[low + end - 1]) + 1, edits, int(shared[i])))
    return out


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, q: int = 10, rate: float = 0.06, block_chars: int = 1_000_000, blocks_a_scan: int = 4,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """One row per match: doc_id, item_id, match_start, match_end (characters), edits, shared_grams.

    An item matches where it occurs in a text with at most ``rate`` edits a character, after lower
    case and with white space as one space.  The budget of a short item is cut to what the lemma
    can bound; items under ``q`` characters, and null ones, match nothing.  Null and empty texts
    match nothing.  Ids may be null or repeat, and so may rows: each stands for itself.  An empty table on
    either side gives no rows.  Other columns are ignored.  The texts are never shuffled.

    Items come in blocks of about ``block_chars`` characters, ``blocks_a_scan`` of which go to every task at a time (some 40 MB of
    memory each): a benchmark of n characters takes n / (block_chars * blocks_a_scan) scans of the texts, rounded up.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col(item_col).alias("id"), F.col(item_text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_chars))
    id_type = source.schema["doc_id"].dataType.simpleString()
    item_type = items.schema["id"].dataType.simpleString()
    schema = f"doc_id {id_type}, item_id {item_type}, match_start long, match_end long, edits int, shared_grams int"
    context, found = docs.sparkSession.sparkContext, None
    item_arrow = to_arrow_type(items.schema["id"].dataType)
    number = F.pmod(F.xxhash64("id", "text"), F.lit(blocks))
    for scan in range(0, blocks, blocks_a_scan):
        together = []
        for b in range(scan, min(scan + blocks_a_scan, blocks)):
            own = items.filter(number == b).orderBy("id", "text").collect()
            together.append(Items.build([r["id"] for r in own], [r["text"] for r in own], q, rate))
        block = context.broadcast(together)

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            known = [items for items in block.value if items.ids]
            for batch in smaller(batches):
                rows = []
                for part in slices(batch.column(1).to_pylist()) if known else ():
                    ready, begin = prepared(part, q), part.begin
                    for own in known:
                        rows += [(part.first + t, own.ids[j], a - int(begin[t]), e - int(begin[t]), d, s) for t, j, a, e, d, s in matches(part, own, ready)]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(columns[0], pa.int64())),
                        pa.array(columns[1], item_arrow),
                        pa.array(columns[2], pa.int64()),
                        pa.array(columns[3], pa.int64()),
                        pa.array(columns[4], pa.int32()),
                        pa.array(columns[5], pa.int32()),
                    ],
                    ["doc_id", "item_id", "match_start", "match_end", "edits", "shared_grams"],
                )

        one = on_workers(source).mapInArrow(run, schema)
        if blocks > blocks_a_scan:  # the blocks of one scan at a time are in memory
            one = written(one, "matches")
            block.destroy()
        found = one if found is None else found.union(one)
    return found
