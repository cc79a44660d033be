"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into bins.  Cyclic boosting goes round the features: a shallow tree over one
feature's bins is fitted to what is still unexplained, and added to that feature's lookup table.
At the end the same is done with trees over the cells of the most useful pairs of features.  A score is then a sum of
table entries, looked up for whole batches at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import LETTER, NUMBER, OTHER, SPACE
from .chars import Hasher, Slice, runs, slices, tables
from .common import bounded_rows, on_workers, smaller

FEATURES = [
    "log_chars", "letters", "upper", "digits", "signs", "spaces", "word_chars", "sign_repeats", "sign_runs",
    "distinct_words", "repeated_neighbours", "top_word", "log_lines", "repeated_lines", "line_chars",
    "distinct_pairs", "long_words", "capital_words", "lone_signs", "distinct_letters",
]


def _distinct(owner: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n texts: distinct values, and how often the most frequent one comes."""
    distinct, top = np.zeros(n), np.zeros(n)
    if len(value):
        with np.errstate(over="ignore"):
            key = value ^ (owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        unique, at, count = np.unique(key, return_index=True, return_counts=True)
        distinct = np.bincount(owner[at], minlength=n).astype(float)
        np.maximum.at(top, owner[at], count)
    return distinct, top


def features(part: Slice) -> np.ndarray:
    """One row of ``FEATURES`` per text; all are 0 for an empty text."""
    kind_of, low, upper_of = tables()
    chars, n = part.chars, len(part.end)
    kind = kind_of[chars]
    size = (part.end - part.begin).astype(float)
    share = lambda a, b: np.divide(a, b, out=np.zeros(n), where=b > 0)
    letter, sign = kind == LETTER, kind == OTHER
    letters, upper = part.sums(letter), part.sums(upper_of[chars])
    same = np.r_[False, chars[1:] == chars[:-1]]
    small = low[chars]
    hasher = Hasher(small)
    w0, w1 = runs(letter)
    owner = part.owner(w0)
    words = np.bincount(owner, minlength=n).astype(float)
    word = hasher(w0, w1)
    distinct, top = _distinct(owner, word, n)
    twin = np.r_[False, (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])]
    with np.errstate(over="ignore"):
        pair = word[1:] * np.uint64(3) + word[:-1]
    inside = owner[1:] == owner[:-1]
    pairs, _ = _distinct(owner[1:][inside], pair[inside], n)
    s0, s1 = runs(sign)
    sign_owner = part.owner(s0)
    # a text begins behind the space of the one before, and the first one in the same way
    lone = (np.r_[SPACE, kind[:-1]][s0] == SPACE) & (kind[np.minimum(s1, len(kind) - 1)] == SPACE)
    line = np.ones(len(chars), bool)
    line[chars == 10] = False
    line[part.end] = False
    l0, l1 = runs(line)
    line_owner = part.owner(l0)
    lines = np.bincount(line_owner, minlength=n).astype(float)
    distinct_lines, _ = _distinct(line_owner, hasher(l0, l1), n)
    spelled, _ = _distinct(part.owner(np.flatnonzero(letter)), small[letter].astype(np.uint64), n)
    columns = [
        np.log1p(size),
        share(letters, size),
        share(upper, letters),
        share(part.sums(kind == NUMBER), size),
        share(part.sums(sign), size),
        share(part.sums(kind == SPACE), size),
        share(letters, words),
        share(part.sums(same & sign), size),
        share(np.bincount(sign_owner, weights=s1 - s0 > 1, minlength=n), words + 1),
        share(distinct, words),
        share(np.bincount(owner, weights=twin, minlength=n), words),
        share(top, words),
        np.log1p(lines),
        1 - share(distinct_lines, lines) * (lines > 0) - (lines == 0),
        np.log1p(share(size, lines)),
        share(pairs, words),
        share(np.bincount(owner, weights=w1 - w0 > 12, minlength=n), words),
        share(np.bincount(owner, weights=upper_of[chars[w0]], minlength=n), words),
        share(np.bincount(sign_owner, weights=lone, minlength=n), words + 1),
        np.log1p(spelled),
    ]
    return np.stack(columns, axis=1)


@dataclass
class AdditiveModel:
    """score = sigmoid(base + sum of tables[f][bin of f] + sum of pair tables)."""

    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    base: float = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(self.cuts)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if self.cuts:
            b = self.bins(x)
            for i, t in enumerate(self.tables):
                total += t[b[:, i]]
            for i, j, coarse_i, coarse_j, t in self.pairs:
                total += t[coarse_i[b[:, i]], coarse_j[b[:, j]]]
        return 1 / (1 + np.exp(-total))


def _tree(gain: np.ndarray, weight: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Values of a tree with so many leaves over ordered bins: greedy best cuts, Newton leaves."""
    edges = [0, len(gain)]
    g, h = np.r_[0, np.cumsum(gain)], np.r_[0, np.cumsum(weight)]
    worth = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)
    while len(edges) < leaves + 1:
        best = (1e-9, None)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            cut = np.arange(a + 1, b)
            if len(cut):
                won = worth(a, cut) + worth(cut, b) - worth(a, b)
                k = int(won.argmax())
                best = max(best, (float(won[k]), int(cut[k])), key=lambda x: x[0])
        if best[1] is None:
            break
        edges = sorted([*edges, best[1]])
    out = np.zeros(len(gain))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return out


def _pair_tree(gain: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Values of a tree of depth two over a grid of cells: the best cut along both sides, Newton leaves."""
    g, h = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (gain, weight))
    rows, columns = np.arange(1, gain.shape[0])[:, None], np.arange(1, gain.shape[1])[None, :]

    def quarters(s: np.ndarray, i, j) -> list[np.ndarray]:
        return [s[i, j], s[i, -1] - s[i, j], s[-1, j] - s[i, j], s[-1, -1] - s[i, -1] - s[-1, j] + s[i, j]]

    worth = sum(a**2 / (b + ridge) for a, b in zip(quarters(g, rows, columns), quarters(h, rows, columns), strict=True))
    i, j = (int(x) + 1 for x in np.unravel_index(worth.argmax(), worth.shape))
    out = np.zeros(gain.shape)
    boxes = ((slice(i), slice(j)), (slice(i), slice(j, None)), (slice(i, None), slice(j)), (slice(i, None), slice(j, None)))
    for box, a, b in zip(boxes, quarters(g, i, j), quarters(h, i, j), strict=True):
        out[box] = a / (b + ridge)
    return out


def fit(
    x: np.ndarray, y: np.ndarray, *, bins: int = 48, rounds: int = 120, rate: float = 0.15, leaves: int = 4,
    pairs: int = 8, pair_bins: int = 8, pair_rounds: int = 40, ridge: float = 4.0,
) -> AdditiveModel:
    """Boost lookup tables on features ``x`` and labels ``y`` (0 or 1)."""
    model = AdditiveModel()
    share = (y.sum() + 1) / (len(y) + 2)
    model.base = float(np.log(share / (1 - share)))
    if len(y) < 2 or y.min() == y.max():
        return model
    model.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    b = model.bins(x)
    sizes = [len(c) + 1 for c in model.cuts]
    model.tables = [np.zeros(s) for s in sizes]
    total = np.full(len(y), model.base)
    for _ in range(rounds):
        for i, s in enumerate(sizes):
            p = 1 / (1 + np.exp(-total))
            step = rate * _tree(np.bincount(b[:, i], y - p, s), np.bincount(b[:, i], p * (1 - p), s), leaves, ridge)
            model.tables[i] += step
            total += step[b[:, i]]
    coarse = [np.minimum(np.arange(s) * pair_bins // s, pair_bins - 1) for s in sizes]
    p = 1 / (1 + np.exp(-total))
    cells = lambda i, j: coarse[i][b[:, i]] * pair_bins + coarse[j][b[:, j]]
    worth = []
    for i in range(len(sizes)):
        for j in range(i):
            g, h = np.bincount(cells(i, j), y - p, pair_bins**2), np.bincount(cells(i, j), p * (1 - p), pair_bins**2)
            worth.append(((g**2 / (h + ridge)).sum(), i, j))
    chosen = [(i, j, cells(i, j), np.zeros(pair_bins**2)) for _, i, j in sorted(worth, reverse=True)[:pairs]]
    for _ in range(pair_rounds):
        for _, _, c, t in chosen:
            p = 1 / (1 + np.exp(-total))
            g, h = (np.bincount(c, v, pair_bins**2).reshape(pair_bins, pair_bins) for v in (y - p, p * (1 - p)))
            step = rate * _pair_tree(g, h, ridge).ravel()
            t += step
            total += step[c]
    model.pairs = [(i, j, coarse[i], coarse[j], t.reshape(pair_bins, pair_bins)) for i, j, _, t in chosen]
    return model


def label_sample(labels: DataFrame, label: str, train: Column, max_rows: int) -> DataFrame:
    """About ``max_rows`` labelled ids, chosen by a hash of the id; a little fewer, as their rows are bounded afterwards."""
    usable = labels.select("doc_id", F.col(label).cast("int").alias("_sl_label")).filter(train & F.col("_sl_label").isin(0, 1))
    usable = usable.groupBy("doc_id").agg(F.max("_sl_label").alias("_sl_label"))
    share = min(1.0, 0.97 * max_rows / max(1, usable.count()))
    return usable.filter(F.abs(F.xxhash64(F.col("doc_id"), F.lit(13)) % 1_000_003) < int(share * 1_000_003))


def train_model(docs: DataFrame, labels: DataFrame, train: Column, *, label: str = "quality", max_rows: int = 20_000) -> AdditiveModel:
    """Learn from ``max_rows`` labelled rows at most for which ``train`` holds."""
    # the sample of labels has a proven bound, so it may go to every task
    picked = bounded_rows(docs.select("doc_id", "text").join(F.broadcast(label_sample(labels, label, train, max_rows)), "doc_id"), max_rows)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in smaller(batches):
            for part in slices(batch.column(1).to_pylist()):
                y = batch.column(0).slice(part.first, len(part.end))
                yield pa.RecordBatch.from_arrays([y, *map(pa.array, features(part).T)], ["y", *FEATURES])

    schema = "y int, " + ", ".join(f"{f} double" for f in FEATURES)
    rows = on_workers(picked).select("_sl_label", "text").mapInArrow(measure, schema).toPandas()
    rows = rows.sort_values(list(rows.columns))  # the same model whatever the order of rows
    return fit(rows[FEATURES].to_numpy(float), rows["y"].to_numpy(float))


def score_quality(
    docs: DataFrame, labels: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text",
    max_rows: int = 20_000, threshold: float = 0.3, model: AdditiveModel | None = None,
) -> DataFrame:
    """One row per input row: doc_id, score (0 to 1; higher: label 1 likelier), predicted.

    ``labels`` has doc_id and quality; ``train`` is a condition on doc_id that names the rows to
    learn from.  Null texts count as empty and get the score of an empty text.  Without labels of
    both kinds every text gets the smoothed share of label 1.  An id that is labelled twice has the
    larger label.  Ids may be null or repeat, and so may rows: each gets its text's score.  Other
    columns are ignored; an empty table gives no rows.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if model is None:
        model = train_model(source, labels, train, max_rows=max_rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in smaller(batches):
            parts = [model.score(features(part)) for part in slices(batch.column(1).to_pylist())]
            s = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"]
            )

    id_type = source.schema["doc_id"].dataType.simpleString()
    return on_workers(source).mapInArrow(score, f"doc_id {id_type}, score double, predicted int")
