"""Toxicity by weak supervision.

Voters are words of a small fixed lexicon, words and word beginnings mined from the labelled
sample, and patterns of the whole text.  A generative label model estimates each voter's accuracy
and the voters' correlations within a class (by expectation maximisation over labelled and
unlabelled texts; a known label is only a mild prior that the voters can outweigh), and gives every
sampled text a posterior label.  A linear classifier over the votes and
their densities is trained on those posteriors and scores all texts in vectorised batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import LETTER, OTHER
from .chars import Hasher, Slice, hash_of, runs, slices, tables
from .common import bounded_rows, on_workers, smaller
from .quality import label_sample

#: A general lexicon of abuse; mined voters add what a corpus has besides.
LEXICON = [
    "idiot", "idiots", "moron", "morons", "stupid", "imbecile", "fool", "loser", "losers", "scum", "trash", "garbage",
    "worthless", "pathetic", "disgusting", "clown", "dumb", "jerk", "hate", "vermin", "filth", "kill", "idiota", "imbécil",
    "estúpido", "basura", "asqueroso", "payaso", "dummkopf", "abschaum", "widerlich", "wertlos", "trottel", "crétin",
    "imbécile", "ordure", "dégoûtant", "nul", "minable",
]
#: Lengths of word beginnings that may become voters (0: the whole word).
STEMS = (0, 4, 5, 6, 7)
PATTERNS = ["shouting", "exclamations", "repeats"]


def terms(part: Slice, stems: tuple[int, ...] = STEMS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, hash, start) of every word and of its beginnings; a beginning is hashed apart from a word."""
    kind, low, _ = tables()
    small = low[part.chars]
    start, end = runs(kind[part.chars] == LETTER)
    hasher = Hasher(small)
    owners, hashes, starts = [], [], []
    owner = part.owner(start)
    for stem in stems:
        fits = np.ones(len(start), bool) if stem == 0 else end - start > stem
        stop = end if stem == 0 else start + stem
        owners.append(owner[fits])
        hashes.append(hasher(start[fits], stop[fits]) + np.uint64(stem))
        starts.append(start[fits])
    return np.concatenate(owners), np.concatenate(hashes), np.concatenate(starts)


def patterns(part: Slice) -> np.ndarray:
    """Share of capitals, of exclamation marks and of doubled words in each text."""
    kind, low, upper = tables()
    size = np.maximum(part.end - part.begin, 1)
    letter = kind[part.chars] == LETTER
    start, end = runs(letter)
    word, owner = Hasher(low[part.chars])(start, end), part.owner(start)
    twin = np.r_[False, (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])]
    return np.stack(
        [
            part.sums(upper[part.chars]) / np.maximum(part.sums(letter), 1),
            part.sums((part.chars == ord("!")) & (kind[part.chars] == OTHER)) / size,
            np.bincount(owner, twin, len(size)) / np.maximum(np.bincount(owner, minlength=len(size)), 1),
        ],
        axis=1,
    )


def mine(sample: DataFrame, *, voters: int = 600, support: int = 5) -> list[int]:
    """Hashes of the words and beginnings that most favour label 1 in the labelled sample.

    Document counts by class come from one aggregation; only terms with support and strong odds
    reach the driver, ``voters`` of them at most.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = np.array(batch.column(0).to_pylist(), np.int64)
            keys, positive = [], []
            for part in slices(batch.column(1).to_pylist()):
                owner, hashed, _ = terms(part)
                order = np.lexsort((hashed, owner))
                owner, hashed = owner[order], hashed[order]
                new = np.r_[True, (owner[1:] != owner[:-1]) | (hashed[1:] != hashed[:-1])][: len(owner)]
                keys.append(hashed[new])
                positive.append(y[part.first + owner[new]])
            key, back = np.unique(np.concatenate(keys), return_inverse=True) if keys else (np.zeros(0, np.uint64), np.zeros(0, int))
            pos = np.bincount(back, np.concatenate(positive) if keys else None, len(key)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(pos), pa.array(np.bincount(back, minlength=len(key)))], ["term", "pos", "n"])

    total = sample.agg(F.sum("_sl_label").alias("pos"), F.count("*").alias("n")).first()
    pos, n = total["pos"] or 0, total["n"]
    if not 0 < pos < n:
        return []
    counts = sample.select("_sl_label", "text").mapInArrow(count, "term long, pos long, n long")
    odds = F.log((F.col("pos") + 0.5) / (pos + 1)) - F.log((F.col("n") - F.col("pos") + 0.5) / (n - pos + 1))
    best = (
        counts.groupBy("term")
        .agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
        .filter(F.col("pos") >= support)
        .select("term", (odds - 1 / F.sqrt("pos")).alias("odds"))
        .filter("odds > 2.5")
        .orderBy(F.desc("odds"), "term")
        .limit(voters)
    )
    return [r["term"] & (2**64 - 1) for r in best.collect()]


@dataclass
class LabelModel:
    """Class-conditional rates of each vote, and weights that allow for correlated voters."""

    prior: float
    weights: np.ndarray
    bias: float

    @classmethod
    def fit(cls, votes: np.ndarray, known: np.ndarray, *, rounds: int = 8, trust: float = 2.0) -> tuple[LabelModel, np.ndarray]:
        """``votes``: texts x voters in {0, 1}; ``known``: 0 or 1 per text, else -1.

        Each round estimates how often each voter votes in either class (its accuracy) and the voters'
        correlations within a class from the present posterior, and then the posterior from both.  A vote
        counts by its log odds, and so does silence, which says little of a voter that is mostly silent; both
        are divided by how many voters the correlations make of one, so voters that repeat each other count as one.
        A known label adds ``trust`` to its side in log odds, less than the voters can (6).
        """
        share = known[known >= 0].mean() if (known >= 0).any() else 0.5
        post = np.where(known < 0, share, known.astype(float))
        post = 0.05 + 0.9 * post
        anchor = np.where(known < 0, 0.0, trust * (2 * known - 1))
        votes = votes.astype(np.float32)  # zeros and ones; half the memory
        together = (votes.T @ votes).astype(float)
        for _ in range(rounds):
            n1, n0 = post.sum() + 1, (1 - post).sum() + 1
            of1, of0 = (np.float32(p) @ votes for p in (post, 1 - post))
            m1, m0 = (of1 + 0.5) / (n1 + 1), (of0 + 0.5) / (n0 + 1)
            within = together.copy()
            for p, of, m in ((post, of1, m1), (1 - post, of0, m0)):
                cross = np.outer(of, m)
                within += p.sum() * np.outer(m, m) - cross - cross.T
            spread = np.sqrt(np.maximum(np.diag(within), 1e-9))
            alike = np.clip(within / np.outer(spread, spread), 0, 1)
            np.fill_diagonal(alike, 1)
            repeats = (alike**2).sum(1)
            said, silent = np.log(m1 / m0) / repeats, np.log((1 - m1) / (1 - m0)) / repeats
            weights = said - silent
            prior = np.log(n1 / n0)
            bias = prior + silent.sum()
            raw = np.clip(votes @ np.float32(weights) + bias, -6, 6)
            post = 1 / (1 + np.exp(-(raw + anchor)))
        return cls(prior, weights, bias), post


def logistic(x: np.ndarray, target: np.ndarray, *, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights (the last is the bias) of a linear classifier on soft labels, by Newton steps."""
    n = x.shape[1] + 1
    w, penalty = np.zeros(n), np.full(n, ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        h, gradient = np.diag(penalty), -penalty * w
        for at in range(0, len(x), 4096):  # so that no second copy of all rows is needed
            part = np.c_[x[at : at + 4096], np.ones(len(x[at : at + 4096]))]
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            h = h + (part * (p * (1 - p) + 1e-6)[:, None]).T @ part
            gradient = gradient + part.T @ (target[at : at + 4096] - p)
        step = np.linalg.solve(h, gradient)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class ToxicityModel:
    """Sorted term voters, and the classifier's weights."""

    terms: np.ndarray
    weights: np.ndarray

    def columns(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Votes (texts x voters), and what the classifier sees besides the votes."""
        n = len(part.end)
        votes = np.zeros((n, len(self.terms) + len(PATTERNS)))
        hits = np.zeros(n)
        if len(self.terms):
            owner, hashed, place = terms(part)
            at = np.minimum(np.searchsorted(self.terms, hashed), len(self.terms) - 1)
            found = self.terms[at] == hashed
            votes[owner[found], at[found]] = 1
            words = np.unique(place[found])  # a word counts once however many of its beginnings vote
            hits = np.bincount(part.owner(words), minlength=n).astype(float)
        seen = patterns(part)
        votes[:, len(self.terms) :] = seen > np.array([0.5, 0.01, 0.2])
        size = np.log1p(part.end - part.begin)
        extra = np.stack([np.minimum(hits, 6), hits > 0, hits > 1, np.log1p(hits), hits / np.maximum(size, 1), *seen.T], axis=1)
        return votes, extra

    def score(self, part: Slice) -> np.ndarray:
        votes, extra = self.columns(part)
        return 1 / (1 + np.exp(-np.clip(np.c_[votes, extra] @ self.weights[:-1] + self.weights[-1], -30, 30)))


def unlabelled_sample(docs: DataFrame, used: DataFrame, train: Column, max_rows: int) -> DataFrame:
    """About ``max_rows`` ids without a label in use, chosen by a hash of the id; a little fewer, as their rows are bounded afterwards."""
    usable = docs.select("doc_id").filter(train & F.col("doc_id").isNotNull()).join(F.broadcast(used.select("doc_id")), "doc_id", "left_anti")
    share = min(1.0, 0.97 * max_rows / max(1, usable.count()))
    return usable.filter(F.abs(F.xxhash64(F.col("doc_id"), F.lit(17)) % 1_000_003) < int(share * 1_000_003)).distinct()


def train_model(
    docs: DataFrame, labels: DataFrame, train: Column, *, label: str = "toxic", max_rows: int = 20_000, max_unlabelled: int = 10_000, voters: int = 600
) -> ToxicityModel:
    """Learn from ``max_rows`` labelled and ``max_unlabelled`` other rows at most for which ``train`` holds."""
    used = label_sample(labels, label, train, max_rows)
    docs = docs.select("doc_id", "text")
    sample = on_workers(bounded_rows(docs.join(F.broadcast(used), "doc_id"), max_rows).select("_sl_label", "text"))
    others = bounded_rows(docs.join(F.broadcast(unlabelled_sample(docs, used, train, max_unlabelled)), "doc_id"), max_unlabelled)
    others = others.select(F.lit(-1).alias("_sl_label"), "text")
    words = [hash_of(w) for w in LEXICON]
    model = ToxicityModel(np.unique(np.array(words + mine(sample, voters=voters), np.uint64)), np.zeros(0))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in smaller(batches):
            for part in slices(batch.column(1).to_pylist()):
                votes, extra = model.columns(part)
                at = [np.flatnonzero(v).tolist() for v in votes]
                y = batch.column(0).slice(part.first, len(part.end))
                yield pa.RecordBatch.from_arrays([y, pa.array(at, pa.list_(pa.int32())), pa.array(extra.tolist(), pa.list_(pa.float64()))], ["y", "votes", "extra"])

    rows = sample.union(others).mapInArrow(measure, "y int, votes array<int>, extra array<double>").toPandas()
    width = len(model.terms) + len(PATTERNS)
    given = rows["y"][rows["y"] >= 0]
    if given.nunique() < 2:
        share = (given.sum() + 1) / (len(given) + 2)
        model.weights = np.zeros(width + 9)
        model.weights[-1] = np.log(share / (1 - share))
        return model
    rows = rows.assign(key=[(*map(float, e), *map(float, v)) for e, v in zip(rows["extra"], rows["votes"], strict=True)])
    rows = rows.sort_values(["y", "key"])  # the same model whatever the order of rows
    votes = np.zeros((len(rows), width), np.float32)
    for i, v in enumerate(rows["votes"]):
        votes[i, v] = 1
    extra = np.array(rows["extra"].tolist(), np.float32)
    _, post = LabelModel.fit(votes, rows["y"].to_numpy())
    model.weights = logistic(np.c_[votes, extra], post)
    return model


def score_toxicity(
    docs: DataFrame, labels: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text",
    max_rows: int = 20_000, threshold: float = 0.3, model: ToxicityModel | None = None,
) -> DataFrame:
    """One row per input row: doc_id, score (0 to 1; higher: label 1 likelier), predicted.

    ``labels`` has doc_id and toxic; ``train`` is a condition on doc_id that names the rows to
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
            parts = [model.score(part) for part in slices(batch.column(1).to_pylist())]
            s = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"]
            )

    id_type = source.schema["doc_id"].dataType.simpleString()
    return on_workers(source).mapInArrow(score, f"doc_id {id_type}, score double, predicted int")
