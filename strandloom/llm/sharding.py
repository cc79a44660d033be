"""Sharding of documents by a k-d tree over their metadata.

The rows are split again and again at a weighted median along the dimension in which the node is
widest, until the leaves reach the target bytes.  A median is found exactly and distributed: rows
of a node are ordered by (coordinate, hash of the text, hash of the id), and each pass of a radix
selection sums weights by (node, digit) and brings no more than nodes x digits sums to the driver.
The coordinates depend on the text alone, so equal texts lie side by side.  A split moves to the
nearer edge of a light group of equal texts; a heavier one goes to one side as a whole, and the
split moves as far as makes up for it.  Only a group that is heavier than a leaf, or for which
neither side has room, is cut, by the ids' hash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written

DIGIT = 11
HASH_BITS = 31
COORD_BITS = 24


@dataclass
class Node:
    """A node of the tree: it has the shards first .. first + shards - 1."""

    first: int
    shards: int
    weight: float = 0.0
    dim: int = 0
    low: float = 0.0
    scale: float = 0.0
    key: int = 0
    tie: int = 0  # of rows whose key is the cut's, those with a smaller row hash go left


def _nodes(rows: DataFrame, nodes: list[Node], extra: dict[int, int] | None = None) -> DataFrame:
    """The rows of these nodes, with the node's cut; there are no more nodes than shards."""
    values = ", ".join(
        f"({n.first}, {n.shards // 2}, {n.dim}, {n.low!r}D, {n.scale!r}D, {n.key}L, {n.tie}L, {(extra or {}).get(n.first, 0)}L)"
        for n in nodes
    )
    cuts = rows.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(node, half, dim, low, scale, cut, tie, prefix)")
    return rows.join(F.broadcast(cuts), "node", "left")


def _placed(rows: DataFrame, groups: list[tuple[int, int, bool]]) -> DataFrame:
    """Adds to_left, for rows of groups (node, key, whether left) that go to one side as a whole.

    There are fewer of them than nodes over the share of a leaf at which a group is heavy.
    """
    if not groups:
        return rows.withColumn("to_left", F.lit(None).cast("boolean"))
    values = ", ".join(f"({n}, {k}L, {str(left).lower()})" for n, k, left in groups)
    table = rows.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(node, order, to_left)")
    return rows.join(F.broadcast(table), ["node", "order"], "left")


def _order(dims: int) -> Column:
    """Place of a row in its node: its coordinate, then the hash of its text."""
    wide = F.element_at(F.array(*(F.col(f"c{i}") for i in range(dims))), F.col("dim") + 1)
    return F.shiftleft(F.floor((wide - F.col("low")) * F.col("scale")).cast("long"), HASH_BITS) + F.col("text_hash")


def default_dimensions(text: Column) -> list[Column]:
    """Logarithms of bytes, characters beyond ASCII, lines and words."""
    return [
        F.log1p(F.octet_length(text)),
        F.log1p(F.octet_length(text) - F.length(text)),
        F.log1p(F.regexp_count(text, F.lit("\n"))),
        F.log1p(F.regexp_count(text, F.lit(" "))),
    ]


def _select(
    rows: DataFrame, nodes: list[Node], want: dict[int, float], order: Column, bits: int, slack: float, groups: list[tuple[int, int, bool]] = ()
):
    """For each node the key up to which the weight is nearest to the wanted one, without these groups.

    Returns {node: (key, weight before it, weight at it)}; the weight at it is 0 unless one
    single key of several rows is heavier than ``slack``.
    """
    live = {n.first: (0, want[n.first]) for n in nodes}  # prefix so far, weight still wanted
    found, shift = {}, bits
    while live:
        step = min(DIGIT, shift)
        shift -= step
        inside = _nodes(rows, [n for n in nodes if n.first in live], {k: v[0] for k, v in live.items()})
        sums = (
            _placed(inside.filter(F.col("prefix").isNotNull()).withColumn("order", order), groups)
            .filter("to_left IS NULL")
            .select("node", "weight", "prefix", F.col("order").alias("key"))
            .filter(F.shiftright("key", shift + step) == F.col("prefix"))
            .groupBy("node", F.shiftright("key", shift).alias("digit"))
            .agg(F.sum("weight").alias("w"), F.count("*").alias("n"))
            .collect()
        )
        by_node: dict[int, list] = {}
        for r in sums:
            by_node.setdefault(r["node"], []).append((r["digit"], r["w"], r["n"]))
        for first, (_, wanted) in list(live.items()):
            before = 0.0
            cells = sorted(by_node.get(first, []))
            for digit, w, n in cells:
                if before + w >= wanted or digit == cells[-1][0]:
                    break
                before += w
            if not cells:
                found[first] = (0, 0.0, 0.0)
                del live[first]
            elif w <= slack or shift == 0:
                heavy = w if w > slack and n > 1 else 0.0
                after = not heavy and (before + w - wanted) < (wanted - before)
                found[first] = ((digit + after) << shift, want[first] - wanted + before + after * w, heavy)
                del live[first]
            else:
                live[first] = (digit, wanted - before)
    return found


def _cuts(rows: DataFrame, level: list[Node], want: dict[int, float], order: Column, slack: float):
    """({node: (key, weight before it, weight at it if it must be cut, how much of that goes left)}, groups placed whole)."""
    found, groups, pending = {}, [], list(level)
    room = {n.first: [want[n.first], n.weight - want[n.first]] for n in level}  # left and right
    while pending:
        got = _select(rows, pending, {n.first: room[n.first][0] for n in pending}, order, COORD_BITS + HASH_BITS, slack, groups)
        again = []
        for n in pending:
            key, before, heavy = got[n.first]
            left = room[n.first][0]
            sides = [0, 1] if before + heavy / 2 <= left else [1, 0]
            free = [side for side in sides if room[n.first][side] >= heavy]
            if heavy and heavy <= n.weight / n.shards and free:
                groups.append((n.first, key, free[0] == 0))
                room[n.first][free[0]] -= heavy
                again.append(n)
            else:
                found[n.first] = (key, before, heavy, left - before)
        pending = again
    return found, groups


def kd_shards(
    docs: DataFrame,
    *,
    shards: int | None = None,
    target_bytes: float | None = None,
    overhead: int = 8,
    group_slack: float = 0.02,
    id_col: str = "doc_id",
    text_col: str = "text",
    dimensions=default_dimensions,
) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, shard, slot.

    ``size`` is the text's UTF-8 bytes (null: none) plus ``overhead``.  Leaves are as many as
    ``shards``, or as bring them down to ``target_bytes``; their bytes are near equal.  Equal
    texts share a shard unless they weigh more than a leaf, or several heavy groups leave none of
    the leaves with room for one; those are cut by their ids.  A cut is off by half of a row, or of a
    group of at most ``group_slack`` of a leaf.  Slots count from 0 in each shard without gaps.
    Null texts count as empty; null and repeated ids are rows of their own (rows equal in id and
    text have no order between them).  Other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    dims = dimensions(F.col("t"))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("t")).select(
        "doc_id",
        (F.octet_length("t") + overhead).cast("long").alias("size"),
        F.crc32(F.col("t").cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64("t"), 64 - HASH_BITS).alias("text_hash"),
        F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string"), F.lit(7)), 64 - HASH_BITS).alias("row_hash"),
        *(d.cast("double").alias(f"c{i}") for i, d in enumerate(dims)),
    )
    rows = rows.withColumns({"weight": F.col("size").cast("double"), "node": F.lit(0)})
    rows = written(rows, "metadata")
    edges = [f(f"c{i}").alias(f"{n}{i}") for i in range(len(dims)) for n, f in (("lo", F.min), ("hi", F.max))]
    whole = rows.agg(F.sum("weight").alias("w"), F.count("*").alias("n"), *edges).first()
    if shards is None:
        shards = max(1, math.ceil((whole["w"] or 0) / target_bytes))
    total = whole["w"] or 0.0
    root = Node(0, shards, total)
    spread = [(whole[f"hi{i}"] or 0) - (whole[f"lo{i}"] or 0) for i in range(len(dims))]
    slack = group_slack * total / shards
    order = _order(len(dims))
    level, stats = [root] if shards > 1 and total else [], {0: whole}
    while level:
        if level[0] is not root:
            stats = {r["node"]: r for r in rows.groupBy("node").agg(F.sum("weight").alias("w"), *edges).collect()}
        want = {}
        for n in level:
            if s := stats.get(n.first):
                wide = [(s[f"hi{i}"] - s[f"lo{i}"]) / spread[i] if spread[i] else 0.0 for i in range(len(dims))]
                n.weight, n.dim = s["w"], max(range(len(dims)), key=wide.__getitem__)
                n.low, width = s[f"lo{n.dim}"], s[f"hi{n.dim}"] - s[f"lo{n.dim}"]
                n.scale = ((1 << COORD_BITS) - 1) / width if width > 0 else 0.0
            want[n.first] = n.weight * (n.shards // 2) / n.shards
        found, groups = _cuts(rows, level, want, order, slack)
        for n in level:
            n.key = found[n.first][0]
        if heavy := [n for n in level if found[n.first][2]]:
            rest = {n.first: found[n.first][3] for n in heavy}
            ties = _select(rows, heavy, rest, F.when(order == F.col("cut"), F.col("row_hash")), HASH_BITS, slack / 100)
            for n in heavy:
                n.tie = ties[n.first][0]
        cut = _placed(_nodes(rows, level).withColumn("order", order), groups)
        left = (F.col("order") < F.col("cut")) | ((F.col("order") == F.col("cut")) & (F.col("row_hash") < F.col("tie")))
        left = F.coalesce("to_left", left)
        node = F.col("node") + F.when(left, 0).otherwise(F.coalesce("half", F.lit(0)))
        below = written(cut.select(*(c for c in rows.columns if c != "node"), node.cast("int").alias("node")), "level")
        discard(rows)
        rows = below
        halves = [(n, n.shards // 2) for n in level]
        below = [b for n, h in halves for b in (Node(n.first, h), Node(n.first + h, n.shards - h))]
        level = [n for n in below if n.shards > 1]
    buckets = 1 << max(4, math.ceil(math.log2(max(1, whole["n"] / shards / 200_000))))
    placed = rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.col("node").alias("shard"),
        F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)).alias("bucket"),
    )
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    # one row per shard and bucket, so these windows stay small however many rows there are
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32")
    numbered = placed.withColumn("rank", F.row_number().over(own) - 1)
    return numbered.join(offsets, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("rank")).cast("long").alias("slot")
    )
