"""Near-duplicate groups: one-permutation MinHash with optimal densification.

Every shingle is hashed once.  Its hash names a bin, and the bin keeps the smallest hash; an empty
bin takes the value of the first full bin in a random order of its own (optimal densification).
Bins form bands, and equal bands put texts into one bucket.  A bucket's texts are not paired with
each other but with one leader, in a star, so candidate edges are fewer than the bucket's rows.
Edges pass a bitmap filter, and those left are confirmed on the full shingle sets.

The bitmap of a text holds the parity of how many of its shingles fall on each of 2048 places, so
two sets differ in at least as many shingles as their bitmaps differ in bits: the filter loses no
link (Sandes, Teodoro and Melo, "Bitmap filter", 2017).

Buckets that still hold more than one component after the stars are joined exactly, inside the
join, across components only, on sizes and bitmaps: texts outside the bucket's largest component with all others.
Where that would be too many looks for one bucket, its texts are joined by their rarest shingles
instead (prefix filter), which is exact as well.  So no two texts of a bucket stay unmet.

With 30 bands of 5 rows, a pair at similarity 0.8 shares no bucket with probability 7e-6.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chars import Hasher, mix, runs, slices
from .common import discard, kept, on_workers, picked, scratch, smaller, written
from .components import components
from .exact_dedup import merge_runs

#: ASCII white space splits words: U+0020 and U+0009 to U+000D (fixed values).
BLANKS = np.zeros(0x110000, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
#: 64-bit words of a text's bitmap.
BITMAP = 32


def shingles(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of so many words.

    Only A-Z are lower-cased.  A text with fewer words is one shingle; one without words has none.
    """
    with np.errstate(over="ignore"):
        for part in slices(texts):
            small = np.where((part.chars >= 65) & (part.chars <= 90), part.chars + 32, part.chars)
            start, end = runs(~BLANKS[small])
            # words that touch the next text's are split by the space between the texts
            word, owner = Hasher(small)(start, end), part.owner(start)
            value = np.zeros(max(0, len(word) - words + 1), np.uint64)
            for i in range(words):
                value = value * np.uint64(0x9FB21C651E98DF25) + word[i : len(word) - words + 1 + i]
            value = mix(value)
            inside = owner[words - 1 :] == owner[: len(value)] if len(value) else np.zeros(0, bool)
            value, value_owner = value[inside], owner[: len(inside)][inside]
            n_words = np.bincount(owner, minlength=len(part.end))
            cut = np.searchsorted(value_owner, np.arange(len(part.end) + 1))
            first_word = np.searchsorted(owner, np.arange(len(part.end)))
            for i, n in enumerate(n_words.tolist()):
                if n >= words:
                    yield np.unique(value[cut[i] : cut[i + 1]])
                elif n:
                    one = np.uint64(n)
                    for w in word[first_word[i] : first_word[i] + n]:
                        one = one * np.uint64(0xA0761D6478BD642F) + w
                    yield mix(np.array([one]))
                else:
                    yield np.zeros(0, np.uint64)


@lru_cache(4)
def _orders(bins: int) -> np.ndarray:
    """orders[j, i]: the place of bin i in bin j's random order."""
    rng = np.random.default_rng(20)
    return np.stack([rng.permutation(bins) for _ in range(bins)]).astype(np.uint16)


def signature(hashes: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation signature of a sorted, non-empty array of hashes."""
    place = (((hashes >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    full = place[first]
    out = np.zeros(bins, np.uint64)
    out[full] = hashes[first]
    if len(full) < bins:
        empty = np.setdiff1d(np.arange(bins), full, assume_unique=True)
        out[empty] = out[full[_orders(bins)[np.ix_(empty, full)].argmin(axis=1)]]
    return out


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """The parity of the number of hashes on each place, as ``BITMAP`` words."""
    place = (hashes & np.uint64(64 * BITMAP - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=64 * BITMAP) & 1).astype(np.uint8)).view(np.int64)


def sketches(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n (shingles), h1 and h2 (hashes of the whole set), bands (one key each), bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd = mix(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)
        number = mix(np.arange(bands, dtype=np.uint64) + np.uint64(77))
        for batch in smaller(batches):
            n, h1, h2, keys, bits = [], [], [], [], []
            with np.errstate(over="ignore"):
                for s in shingles(batch.column(1).to_pylist(), words):
                    n.append(len(s))
                    h1.append(int(s.sum().view(np.int64)) if len(s) else 0)
                    h2.append(int(mix(s).sum().view(np.int64)) if len(s) else 0)
                    if len(s):
                        band = (signature(s, bands * rows) * odd).reshape(bands, rows).sum(axis=1)
                        keys.append(mix(band + number).view(np.int64))
                        bits.append(bitmap(s))
            some = np.r_[0, np.cumsum(np.array(n) > 0)].astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(some * w), pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))) for x, w in ((keys, bands), (bits, BITMAP))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), *lists],
                ["doc_id", "n", "h1", "h2", "bands", "bits"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return on_workers(docs).mapInArrow(run, f"doc_id {id_type}, n long, h1 long, h2 long, bands array<long>, bits array<long>")


def _sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """The full shingle sets of the texts with these ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in smaller(batches):
            sets = list(shingles(batch.column(1).to_pylist(), words))
            for at in range(0, len(sets), 512):
                some = sets[at : at + 512]
                offsets = np.r_[0, np.cumsum([len(s) for s in some])].astype(np.int32)
                flat = np.concatenate(some).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(some)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["id", "items"]
                )

    some = picked(docs.select(F.col("doc_id").alias("id"), "text"), ids)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return on_workers(some).mapInArrow(run, f"id {id_type}, items array<long>")


def _similar(sets: DataFrame, edges: DataFrame, percent: int) -> DataFrame:
    """The edges whose sets (id, items) are similar enough."""
    left, right = (sets.select(F.col("id").alias(c), F.col("items").alias(f"s_{c}")) for c in "ab")
    both = edges.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("s_a", "s_b"))
    union = F.size("s_a") + F.size("s_b") - common
    return both.filter(common * 100 >= union * percent).select("a", "b")


def _prefix_pairs(sets: DataFrame, percent: int, hot: int = 2000) -> DataFrame:
    """All (a, b) across components that can be similar enough, by an exact prefix filter.

    ``sets``: id, component, items.  Items are ordered from rare to frequent.  Similar sets have so
    many items in common that the first common one lies in a short prefix of both, with enough
    items behind it.  Items of more than ``hot`` texts are dealt out by a salt.
    """
    items = sets.select("id", "component", F.size("items").alias("n"), F.explode("items").alias("item"))
    range_of = (F.min("component").alias("lo"), F.max("component").alias("hi"))
    common = written(items.groupBy("item").agg(F.count("*").alias("texts"), *range_of).filter("texts > 1"), "frequencies")
    # an item of one text only comes first, whatever its hash
    ranked = items.join(common, "item", "left").withColumn("texts", F.coalesce("texts", F.lit(1)))
    at = F.row_number().over(Window.partitionBy("id").orderBy("texts", "item"))
    ranked = ranked.withColumn("at", at).filter(F.col("n") - F.col("at") + 1 >= F.ceil(F.col("n") * percent / 100))
    ranked = ranked.filter("lo <> hi").withColumn("salts", F.ceil(F.col("texts") / hot).cast("int"))
    ranked = written(ranked.select("item", "id", "component", "n", "at", "salts"), "prefixes")
    # the smaller set of a pair needs a still shorter prefix
    low = ranked.filter((F.col("n") - F.col("at") + 1) * (100 + percent) >= 2 * percent * F.col("n"))
    low = low.select("item", F.pmod(F.xxhash64("id"), "salts").cast("int").alias("salt"), F.struct("n", "id", "component", "at").alias("x"))
    high = ranked.select("item", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.struct("n", "id", "component", "at").alias("y"))
    behind = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) + 1
    fits = (
        (F.col("x.component") != F.col("y.component"))
        & ((F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.id") < F.col("y.id"))))
        & (F.col("x.n") * 100 >= F.col("y.n") * percent)
        & (behind * (100 + percent) >= (F.col("x.n") + F.col("y.n")) * percent)
    )
    pairs = low.alias("l").join(high.alias("h"), (F.col("l.item") == F.col("h.item")) & (F.col("l.salt") == F.col("h.salt")) & fits)
    return pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def _extended(found: DataFrame, new: DataFrame) -> DataFrame:
    """Components after new links: only the components that these touch are worked out again."""
    to_a, to_b = (found.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}")) for c in "ab")
    joined = new.join(to_a, "a", "left").join(to_b, "b", "left")
    lifted = joined.select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b")).filter("a <> b")
    above = components(lifted)
    fresh = above.join(found, "node", "left_anti")
    top = above.select(F.col("node").alias("component"), F.col("component").alias("top"))
    moved = found.join(top, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    return written(moved.union(fresh), "components")


def _near(x: dict[str, Column], y: dict[str, Column], percent: int) -> Column:
    """Whether two texts (n, bits) can be similar enough, by their sizes and then by their bitmaps."""
    differ = sum((F.bit_count(F.get(x["bits"], i).bitwiseXOR(F.get(y["bits"], i))) for i in range(BITMAP)), F.lit(0))
    sizes = F.least(x["n"], y["n"]) * 100 >= F.greatest(x["n"], y["n"]) * percent
    return sizes & (differ * (100 + percent) <= (x["n"] + y["n"]) * (100 - percent))


def _fields(struct: str) -> dict[str, Column]:
    return {c: F.col(f"{struct}.{c}") for c in ("n", "bits")}


def _filtered(edges: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """The edges (a, b) that the bitmaps let pass."""
    ends = [profiles.select(F.col("id").alias(c), F.struct("n", "bits").alias(f"p_{c}")) for c in "ab"]
    both = edges.join(ends[0], "a").join(ends[1], "b")
    return both.filter(_near(_fields("p_a"), _fields("p_b"), percent)).select("a", "b")


def _confirm(docs: DataFrame, edges: DataFrame, words: int, percent: int) -> DataFrame:
    """The edges whose full sets are similar enough, as a written table."""
    ids = written(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    sets = written(_sets(docs, ids, words), "sets")
    links = written(_similar(sets, edges, percent), "links")
    discard(sets)
    return links


def _star(rows: DataFrame, seed: int) -> DataFrame:
    """Edges (a, b) between texts and the bucket's leader, across components.  ``rows``: key, id, component.

    Leaders come first in one random order of all texts, so a text has few leaders in all its buckets.
    """
    first = F.min_by(F.struct("id", "component"), F.xxhash64("id", F.lit(seed))).alias("leader")
    # written first, so that both sides of the join are exchanged and a hot bucket can be split
    leaders = written(rows.groupBy("key").agg(first), "leaders")
    pairs = rows.join(leaders, "key").filter("component <> leader.component")
    return pairs.select(F.least("id", "leader.id").alias("a"), F.greatest("id", "leader.id").alias("b")).distinct()


def _mixed(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """The rows (key, id, component) of the buckets that hold more than one component, as a written table."""
    known = buckets.join(found.withColumnRenamed("node", "id"), "id", "left")
    known = written(known.select("key", "id", F.coalesce("component", "id").alias("component")), "known")
    mixed = known.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi")
    mixed = written(mixed.select("key"), "mixed_keys")
    out = written(known.join(mixed, "key", "left_semi"), "mixed")
    discard(known, mixed)
    return out


def _bucket_pairs(rows: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) across the components of a bucket that can be similar enough.

    ``rows``: key, id, component, main (the bucket's largest component).
    """
    rich = written(rows.join(profiles, "id"), "rich")
    text = F.struct("id", "component", "main", "n", "bits")
    x, y = (rich.select("key", text.alias(c)) for c in "xy")
    # of two texts outside the largest component one look is enough
    once = (F.col("y.component") == F.col("y.main")) | (F.col("x.id") < F.col("y.id"))
    meet = (F.col("x.component") != F.col("y.component")) & once & _near(_fields("x"), _fields("y"), percent)
    pairs = x.filter("x.component <> x.main").alias("l").join(y.alias("r"), (F.col("l.key") == F.col("r.key")) & meet)
    pairs = pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    out = written(pairs, "pairs")
    discard(rich)
    return out


def _rest(
    docs: DataFrame, mixed: DataFrame, found: DataFrame, profiles: DataFrame, words: int, percent: int, most_looks: int
) -> DataFrame:
    """Components after all links inside the buckets of ``mixed`` (key, id, component)."""
    parts = mixed.groupBy("key", "component").agg(F.count("*").alias("size"))
    whole = parts.groupBy("key").agg(
        F.max_by("component", F.struct("size", "component")).alias("main"), F.sum("size").alias("size"), F.max("size").alias("most")
    )
    whole = written(whole.select("key", "main", ((F.col("size") - F.col("most")) * F.col("size")).alias("looks")), "looks")
    rows = mixed.join(whole.filter(F.col("looks") <= most_looks).drop("looks"), "key")
    edges = _bucket_pairs(rows, profiles, percent)
    hot = mixed.join(whole.filter(F.col("looks") > most_looks).select("key"), "key", "left_semi")
    hot = written(hot.select("id", "component").distinct(), "hot")
    if not hot.isEmpty():
        sets = written(_sets(docs, hot.select("id").distinct(), words).join(hot, "id"), "sets")
        edges = written(edges.union(_filtered(_prefix_pairs(sets, percent), profiles, percent)).distinct(), "pairs")
    # a few edges between each two components first; then all that still lie between two
    to_a, to_b = (mixed.select(F.col("id").alias(c), F.col("component").alias(f"c_{c}")).distinct() for c in "ab")
    known = edges.join(to_a, "a").join(to_b, "b")
    one = lambda s: F.min_by(F.struct("a", "b"), F.xxhash64("a", "b", F.lit(s)))
    some = known.groupBy(F.least("c_a", "c_b"), F.greatest("c_a", "c_b")).agg(F.array(*map(one, range(4))).alias("e"))
    some = written(some.select(F.explode("e").alias("e")).select("e.a", "e.b").distinct(), "some")
    found = _extended(found, _confirm(docs, some, words, percent))
    to_a, to_b = (found.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}")) for c in "ab")
    left = edges.join(to_a, "a", "left").join(to_b, "b", "left").filter(F.coalesce("c_a", "a") != F.coalesce("c_b", "b"))
    left = written(left.select("a", "b"), "left")
    return found if left.isEmpty() else _extended(found, _confirm(docs, left, words, percent))


def near_duplicates(
    docs: DataFrame,
    *,
    words: int = 5,
    percent: int = 80,
    bands: int = 30,
    rows: int = 5,
    stars: int = 2,
    most_looks: int = 50_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Texts are linked when their sets of ``words``-word shingles have a Jaccard similarity of
    ``percent`` in a hundred or more; component_id is the smallest doc_id that can be reached over
    links, itself included.  Null and empty texts have no shingles and are linked with nothing.  A row
    without an id can't be named: its component_id is null, and it is kept.  Rows that repeat an id
    are one document, linked with all that any of its texts is linked with.  Other columns are
    ignored; an empty table gives no rows.  ``most_looks`` decides by which of two exact ways a
    bucket is joined, and changes no result.  The result is a written table; those it was made of are deleted.
    """
    with scratch():
        return kept(_near_duplicates(docs, words, percent, bands, rows, stars, most_looks, id_col, text_col), "near_duplicates")


def _near_duplicates(docs: DataFrame, words: int, percent: int, bands: int, rows: int, stars: int, most_looks: int, id_col: str, text_col: str) -> DataFrame:
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketch = written(sketches(docs, words, bands, rows), "sketches")
    usable = sketch.filter("n > 0 AND doc_id IS NOT NULL")
    # equal sets are one class, named by its smallest id
    classed = merge_runs(usable.select("doc_id", "h1", "h2", "n"), ["h1", "h2", "n"], F.col("h1"), keep="smallest")
    classed = written(classed.select("doc_id", "h1", "n", F.coalesce("keep_id", "doc_id").alias("rep")), "classes")
    copies = classed.filter("rep <> doc_id").select("doc_id", "h1")
    banded = picked(usable, copies, "left_anti").select(F.col("doc_id").alias("id"), F.explode("bands").alias("key"))
    # a bucket of two is an edge; the rows of larger ones are gathered
    ends = (F.min("id").alias("a"), F.max("id").alias("b"))
    shared = written(banded.groupBy("key").agg(F.count("*").alias("size"), *ends).filter("a <> b"), "shared")
    buckets = written(picked(banded, shared.filter("size > 2").select("key")), "buckets")
    alone = F.col("id").alias("component")
    edges = shared.filter("size = 2").select("a", "b").union(_star(buckets.select("*", alone), 0)).distinct()
    edges = written(edges, "edges")
    met = buckets.select("id").union(edges.select(F.explode(F.array("a", "b")).alias("id"))).distinct()
    profiles = picked(usable.select(F.col("doc_id").alias("id"), "n", "bits"), written(met, "met"))
    profiles = written(profiles, "profiles")
    near = written(_filtered(edges, profiles, percent), "near")
    discard(shared, edges)
    # the texts of a repeated id belong together
    twice = classed.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a <> b")
    twice = twice.select(F.explode(F.array("a", "b")).alias("b"), F.col("doc_id").alias("a")).filter("a <> b")
    found = components(_confirm(docs, near, words, percent).union(twice.select("a", "b")))
    mixed = _mixed(buckets, found)
    for seed in range(1, stars):
        near = written(_filtered(_star(mixed, seed), profiles, percent), "near")
        found = _extended(found, _confirm(docs, near, words, percent))
        rest = _mixed(mixed.drop("component"), found)
        discard(mixed, near)
        mixed = rest
    if not mixed.isEmpty():
        found = _rest(docs, mixed, found, profiles, words, percent, most_looks)
    discard(buckets, mixed, profiles)

    member = classed.select("doc_id", "n", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    member = member.select("doc_id", "n", F.coalesce("component", "rep").alias("component_id"))
    alone = sketch.filter("n = 0 OR doc_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    stays = F.col("component_id").isNull() | (F.col("component_id") == F.col("doc_id"))
    return member.union(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", stays.alias("kept"))
