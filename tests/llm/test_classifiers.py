"""op3, op4, op6: held-out accuracy on planted data, and nulls, empty tables and missing labels."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from strandloom.llm.common import bounded_rows, fold
from strandloom.llm.language_id import identify
from strandloom.llm.quality import _pair_tree, fit, score_quality
from strandloom.llm.toxicity import LabelModel, score_toxicity


def train():
    return fold(F.col("doc_id"), 5) != 0


def words(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


def auc(y, s):
    y, s = np.array(y), np.array(s)
    return np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])


def corpus(spark, seed=1, n=400):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good, toxic = rng.random() < 0.7, rng.random() < 0.3
        text = words(rng, ["ba", "to", "ne", "ri"], rng.randint(20, 80)).split()
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(["idiot", "zorgan", "zorgel", "zorgix"]))
        text = " ".join(text).capitalize() + "." if good else " ".join(w + "%%%" for w in text)
        docs.append((i, text, "en", 5))
        labels.append((i, int(good), int(toxic)))
    docs += [(n, None, None, None), (n + 1, "", None, None), (None, "some text", "en", 1), (n + 2, "x " * 30000, "en", 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string, y int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def check(docs, labels, scorer, at, spark):
    got = {r["doc_id"]: r for r in scorer(docs, labels[0], train()).collect()}
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    held = {r["doc_id"] for r in docs.filter(fold(F.col("doc_id"), 5) == 0).collect()}
    rows = [x for x in labels[1] if x[0] in held]
    assert auc([x[at] for x in rows], [got[x[0]]["score"] for x in rows]) > 0.95
    twice = scorer(docs.union(docs), labels[0].union(labels[0]), train()).collect()
    assert len(twice) == 2 * docs.count()
    none = scorer(docs, labels[0].limit(0), train()).collect()
    assert len({r["score"] for r in none}) == 1
    assert scorer(docs.limit(0), labels[0], train()).count() == 0


def test_quality(spark):
    docs, table, rows = corpus(spark)
    check(docs, (table, rows), score_quality, 1, spark)


def test_toxicity(spark):
    docs, table, rows = corpus(spark)
    check(docs, (table, rows), score_toxicity, 2, spark)


def test_pair_interactions():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = fit(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.95


def test_pair_tree_against_brute_force():
    rng = np.random.default_rng(4)
    gain, weight = rng.normal(size=(5, 6)), rng.random((5, 6)) + 0.1
    best = (-1.0, None)
    for i in range(1, 5):
        for j in range(1, 6):
            boxes = [np.s_[:i, :j], np.s_[:i, j:], np.s_[i:, :j], np.s_[i:, j:]]
            best = max(best, (sum(gain[b].sum() ** 2 / (weight[b].sum() + 4) for b in boxes), boxes), key=lambda x: x[0])
    want = np.zeros((5, 6))
    for b in best[1]:
        want[b] = gain[b].sum() / (weight[b].sum() + 4)
    assert np.allclose(_pair_tree(gain, weight, 4.0), want)


def test_noise_voters_give_the_prior():
    rng = np.random.default_rng(5)
    y = (rng.random(4000) < 0.3).astype(int)
    known = np.where(rng.random(4000) < 0.6, y, -1)
    _, post = LabelModel.fit((rng.random((4000, 20)) < 0.2).astype(float), known)
    assert abs(post[known < 0] - 0.3).mean() < 0.07 and post[known < 0].std() < 0.06


def test_label_model_discounts_correlated_voters():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 4000)
    vote = lambda hit, false: (rng.random(4000) < np.where(y == 1, hit, false)).astype(float)
    a, b = vote(0.6, 0.2), vote(0.6, 0.2)
    copy = np.where(rng.random(4000) < 0.98, a, 1 - a)
    model, post = LabelModel.fit(np.stack([a, copy, b], axis=1), np.where(rng.random(4000) < 0.3, y, -1))
    assert model.weights[2] > model.weights[0] and model.weights[2] > model.weights[1]
    assert np.corrcoef(post, y)[0, 1] > 0.4


def test_votes_move_posteriors_of_labelled_texts():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 3000)
    votes = (rng.random((3000, 8)) < np.where(y == 1, 0.8, 0.05)[:, None]).astype(float)
    known = np.where(rng.random(3000) < 0.5, y, -1)
    known[:2], votes[0], votes[1] = 0, 1, 0  # the same label, and all voters or none
    _, post = LabelModel.fit(votes, known)
    assert post[0] > 0.5 > post[1]
    votes[0] = 0
    assert LabelModel.fit(votes, known)[1][0] < 0.5


def test_label_model_sees_unlabelled_rows(spark, monkeypatch):
    docs, table, _ = corpus(spark, n=120)
    seen, fit_model = [], LabelModel.fit
    monkeypatch.setattr(LabelModel, "fit", lambda votes, known: seen.append(known) or fit_model(votes, known))
    score_toxicity(docs, table.filter("doc_id < 80"), train())
    assert {-1, 0, 1} == set(seen[0].tolist())


def test_languages_against_brute_force(spark):
    """The same log probabilities, n-gram by n-gram, without hashing into a matrix."""
    rng = random.Random(8)
    kinds = {"aa": ["ba", "to", "ne"], "bb": ["chi", "ur", "gra"], "cc": ["nu", "llo", "que"]}
    rows = [(i, words(rng, [*kinds[k], "mi"], rng.randint(1, 9)), k) for i in range(120) for k in [rng.choice(list(kinds))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = {r["doc_id"] for r in docs.filter(~train()).collect()}

    def grams(text):
        return [text[i : i + n] for n in (1, 2, 3) for i in range(len(text) - n + 1) if text[i : i + n].strip()]

    counts = {k: Counter(g for i, t, lang in rows if lang == k and i not in held for g in grams(t)) for k in kinds}
    size = 1 << 20
    total = {k: sum(c.values()) + 0.5 * size for k, c in counts.items()}
    got = {r["doc_id"]: r for r in identify(docs, train(), bits=20).collect()}
    for i, t, _ in rows:
        s = {k: sum(np.log((counts[k][g] + 0.5) / total[k]) for g in grams(t)) for k in kinds}
        best = max(s, key=s.get)
        assert got[i]["lang_pred"] == best
        assert abs(got[i]["score"] - 1 / sum(np.exp(v - s[best]) for v in s.values())) < 1e-3


def test_languages(spark):
    rng = random.Random(2)
    kinds = {"aa": ["ba", "to", "ne"], "bb": ["ch", "ü", "gr"], "cc": ["ñu", "llo", "que"]}
    rows = [(i, words(rng, kinds[k], rng.randint(1, 40)), k, "x") for i in range(300) for k in [rng.choice(list(kinds))]]
    rows += [(500, None, "aa", "x"), (501, "12 %% 3", "aa", "x"), (502, "", None, None), (503, "bato", None, "x"), (None, "chü", "bb", "x"), (504, "İ", "aa", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    got = {r["doc_id"]: r for r in identify(docs, train()).collect()}
    held = {r["doc_id"] for r in docs.filter(fold(F.col("doc_id"), 5) == 0).collect()}
    rows = [r for r in rows if r[0] in held and r[0] < 300]
    assert np.mean([got[i]["lang_pred"] == k for i, _, k, _ in rows]) > 0.97
    assert [got[i]["lang_pred"] for i in (500, 501, 502)] == ["und"] * 3 and got[500]["score"] == 0.0
    assert got[503]["lang_pred"] == "aa" and got[None]["lang_pred"] == "bb" and got[504]["lang_pred"] != "und"
    assert {r["lang_pred"] for r in identify(docs, F.lit(False)).collect()} == {"und"}
    assert identify(docs.limit(0), train()).count() == 0


def test_rows_that_are_learned_from_have_a_bound(spark):
    """One id that repeats brings no more rows than the bound; the rows that stay depend on no order."""
    rows = [(i % 3, f"text {i}", i) for i in range(500)] + [(1, "text 1", 9)] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, _sl_label int")
    some = [{(r["doc_id"], r["text"]) for r in bounded_rows(df.repartition(n), 40).collect()} for n in (1, 7)]
    assert len(some[0]) == 40 and some[0] == some[1]
    assert bounded_rows(df, 550).count() == 550 and bounded_rows(df.limit(0), 5).count() == 0
    labels = spark.createDataFrame([(0, 1, 1), (1, 0, 0), (2, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    docs = df.select("doc_id", "text")
    assert score_quality(docs, labels, F.lit(True), max_rows=100).count() == 550
    assert score_toxicity(docs, labels, F.lit(True), max_rows=100).count() == 550
