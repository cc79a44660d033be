"""op3, op4: features, additive model and label model against slow versions, row by row."""

import itertools
import math
import random
import unicodedata
from collections import Counter

import numpy as np
import pytest

from strandloom.llm.bpe import SPACES
from strandloom.llm.chars import slices
from strandloom.llm.quality import FEATURES, features, fit
from strandloom.llm.toxicity import LabelModel, logistic

RNG = random.Random(17)


def kind(c):
    if ord(c) in SPACES:
        return "space"
    return {"L": "letter", "N": "number"}.get(unicodedata.category(c)[0], "other")


def slow_features(text):
    n, kinds = len(text), [kind(c) for c in text]
    share = lambda a, b: a / b if b > 0 else 0.0
    spans = [(k, "".join(c for c, _ in g)) for k, g in itertools.groupby(zip(text, kinds, strict=True), key=lambda x: x[1])]
    words = [s for k, s in spans if k == "letter"]
    signs = [(i, s) for i, (k, s) in enumerate(spans) if k == "other"]
    small = lambda w: "".join(c.lower() if len(c.lower()) == 1 else c for c in w)
    low = [small(w) for w in words]
    count = lambda k: sum(x == k for x in kinds)
    letters, upper = count("letter"), sum(unicodedata.category(c) == "Lu" for c in text)
    lines = [x for x in text.split("\n") if x]
    near = lambda i: (i == 0 or spans[i - 1][0] == "space") and (i == len(spans) - 1 or spans[i + 1][0] == "space")
    own = {
        "log_chars": math.log1p(n), "letters": share(letters, n), "upper": share(upper, letters), "digits": share(count("number"), n), "signs": share(count("other"), n),
        "spaces": share(count("space"), n), "word_chars": share(letters, len(words)),
        "sign_repeats": share(sum(a == b and k == "other" for a, b, k in zip(text[1:], text, kinds[1:], strict=False)), n),
        "sign_runs": sum(len(s) > 1 for _, s in signs) / (len(words) + 1), "distinct_words": share(len(set(low)), len(words)),
        "repeated_neighbours": share(sum(a == b for a, b in itertools.pairwise(low)), len(words)), "top_word": share(max(Counter(low).values(), default=0), len(words)),
        "log_lines": math.log1p(len(lines)), "repeated_lines": 1 - len({small(x) for x in lines}) / len(lines) if lines else 0.0, "line_chars": math.log1p(share(n, len(lines))),
        "distinct_pairs": share(len(set(itertools.pairwise(low))), len(words)), "long_words": share(sum(len(w) > 12 for w in words), len(words)),
        "capital_words": share(sum(unicodedata.category(w[0]) == "Lu" for w in words), len(words)), "lone_signs": sum(near(i) for i, _ in signs) / (len(words) + 1),
        "distinct_letters": math.log1p(len({small(c) for c, k in zip(text, kinds, strict=True) if k == "letter"})),
    }
    return [own[f] for f in FEATURES]


def test_features_against_plain_counts():
    bits = ["word", "Word", "WORD", " ", "  ", "\n", "\n\n", "été", "!", "!!", "--", "7", "42", "a", "Straße", "extraordinarily", "日本", "\t", ". "]
    texts = ["", " ", "\n", "!", "a", "A\nA\na", *("".join(RNG.choice(bits) for _ in range(RNG.randint(1, 80))) for _ in range(150))]
    got = np.concatenate([features(p) for p in slices(texts, 300)])
    want = np.array([slow_features(t) for t in texts])
    for i, name in enumerate(FEATURES):
        assert got[:, i] == pytest.approx(want[:, i], abs=1e-9), name


def slow_tree(gain, weight, leaves, ridge):
    edges = [0, len(gain)]
    worth = lambda a, b: sum(gain[a:b]) ** 2 / (sum(weight[a:b]) + ridge)
    while len(edges) < leaves + 1:
        options = [(worth(a, c) + worth(c, b) - worth(a, b), c) for a, b in itertools.pairwise(edges) for c in range(a + 1, b)]
        options = [o for o in options if o[0] > 1e-9]
        if not options:
            break
        most = max(o[0] for o in options)
        edges = sorted([*edges, next(c for w, c in options if w == most)])
    return [sum(gain[a:b]) / (sum(weight[a:b]) + ridge) for a, b in itertools.pairwise(edges) for _ in range(a, b)]


def slow_pair_tree(gain, weight, ridge):
    n, best = len(gain), None
    for i, j in itertools.product(range(1, n), range(1, n)):
        boxes = [[(a, b) for a in r for b in c] for r in (range(i), range(i, n)) for c in (range(j), range(j, n))]
        values = [(sum(gain[a][b] for a, b in box), sum(weight[a][b] for a, b in box)) for box in boxes]
        worth = sum(g * g / (h + ridge) for g, h in values)
        if best is None or worth > best[0] + 1e-12:
            best = worth, {c: g / (h + ridge) for box, (g, h) in zip(boxes, values, strict=True) for c in box}
    return best[1]


def test_the_additive_model_against_a_slow_one():
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(200, 3)), 2)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + 0.3 * rng.normal(size=200) > 0).astype(float)
    options = {"bins": 6, "rounds": 6, "rate": 0.3, "leaves": 3, "pairs": 2, "pair_bins": 3, "pair_rounds": 4, "ridge": 2.0}
    model = fit(x, y, **options)
    rows, sigmoid = range(200), lambda t: 1 / (1 + math.exp(-t))
    base = math.log((y.sum() + 1) / (201 - y.sum()))
    cuts = [sorted(set(np.quantile(c, np.linspace(0, 1, 7)[1:-1]).tolist())) for c in x.T]
    bins = [[sum(v >= c for c in cuts[f]) for f, v in enumerate(row)] for row in x.tolist()]
    total, tables = [base] * 200, [[0.0] * (len(c) + 1) for c in cuts]
    for _ in range(6):
        for f, size in enumerate(map(len, tables)):
            gain, weight = [0.0] * size, [0.0] * size
            for r in rows:
                p = sigmoid(total[r])
                gain[bins[r][f]] += y[r] - p
                weight[bins[r][f]] += p * (1 - p)
            step = [0.3 * v for v in slow_tree(gain, weight, 3, 2.0)]
            tables[f] = [a + b for a, b in zip(tables[f], step, strict=True)]
            for r in rows:
                total[r] += step[bins[r][f]]
    coarse = [[min(b * 3 // len(t), 2) for b in range(len(t))] for t in tables]
    cell = lambda r, i, j: (coarse[i][bins[r][i]], coarse[j][bins[r][j]])

    def grids(i, j):
        gain, weight = [[0.0] * 3 for _ in range(3)], [[0.0] * 3 for _ in range(3)]
        for r in rows:
            p, (a, b) = sigmoid(total[r]), cell(r, i, j)
            gain[a][b] += y[r] - p
            weight[a][b] += p * (1 - p)
        return gain, weight

    worth = []
    for i in range(3):
        for j in range(i):
            g, h = grids(i, j)
            worth.append((sum(g[a][b] ** 2 / (h[a][b] + 2.0) for a in range(3) for b in range(3)), i, j))
    chosen = [(i, j) for _, i, j in sorted(worth, reverse=True)[:2]]
    for _ in range(4):
        for i, j in chosen:
            step = slow_pair_tree(*grids(i, j), 2.0)
            for r in rows:
                total[r] += 0.3 * step[cell(r, i, j)]
    assert [(i, j) for i, j, *_ in model.pairs] == chosen
    assert [t.tolist() for t in model.tables] == [pytest.approx(t) for t in tables]
    assert model.score(x).tolist() == pytest.approx([sigmoid(t) for t in total])


def test_the_label_model_against_a_slow_one():
    rng = np.random.default_rng(11)
    truth = rng.random(200) < 0.3
    votes = (rng.random((200, 7)) < np.where(truth, 0.5, 0.1)[:, None]).astype(float)
    votes[:, 6] = votes[:, 5]
    known = np.where(rng.random(200) < 0.5, truth, -1).astype(int)
    rounds, trust, texts, voters = 4, 2.0, range(200), range(7)
    share = sum(k for k in known if k >= 0) / sum(k >= 0 for k in known)
    post = [0.05 + 0.9 * (share if k < 0 else k) for k in known]
    for _ in range(rounds):
        n1, n0 = sum(post) + 1, sum(1 - p for p in post) + 1
        m1 = [(sum(post[t] * votes[t][v] for t in texts) + 0.5) / (n1 + 1) for v in voters]
        m0 = [(sum((1 - post[t]) * votes[t][v] for t in texts) + 0.5) / (n0 + 1) for v in voters]

        def together(a, b):
            return sum(p * (votes[t][a] - m[a]) * (votes[t][b] - m[b]) for t in texts for p, m in ((post[t], m1), (1 - post[t], m0)))

        spread = [math.sqrt(together(v, v)) for v in voters]
        alike = lambda a, b: 1.0 if a == b else min(1.0, max(0.0, together(a, b) / (spread[a] * spread[b])))
        repeats = [sum(alike(v, w) ** 2 for w in voters) for v in voters]
        said = [math.log(m1[v] / m0[v]) / repeats[v] for v in voters]
        silent = [math.log((1 - m1[v]) / (1 - m0[v])) / repeats[v] for v in voters]
        prior, after = math.log(n1 / n0), []
        for t in texts:
            raw = prior + sum(said[v] if votes[t][v] else silent[v] for v in voters)
            anchor = 0 if known[t] < 0 else trust * (2 * known[t] - 1)
            after.append(1 / (1 + math.exp(-(max(-6, min(6, raw)) + anchor))))
        post = after
    model, got = LabelModel.fit(votes, known, rounds=rounds, trust=trust)
    assert got.tolist() == pytest.approx(post, abs=2e-4)
    assert model.weights.tolist() == pytest.approx([a - b for a, b in zip(said, silent, strict=True)], abs=1e-3)
    assert abs(model.weights[5]) < 0.75 * abs(model.weights[:5]).max()  # two voters that always agree share their weight


def test_the_linear_classifier_is_at_its_optimum():
    rng = np.random.default_rng(2)
    x, target = rng.normal(size=(5000, 4)).astype(np.float32), rng.random(5000)  # more rows than a block
    w = logistic(x, target, ridge=1.0)
    whole = np.c_[x, np.ones(5000)]
    gradient = whole.T @ (target - 1 / (1 + np.exp(-whole @ w))) - np.r_[w[:-1], 1e-6 * w[-1]]
    assert np.abs(gradient).max() < 1e-6


def test_labels_that_clash_and_columns_with_odd_names(spark):
    from pyspark.sql import functions as F

    from strandloom.llm.quality import score_quality
    from strandloom.llm.toxicity import score_toxicity

    texts = [f"{'bad ugly' if i % 2 else 'good fine'} text number {i} " * 5 for i in range(60)]
    docs = spark.createDataFrame([(i, t, 9, "v", [1.0], "e", 3) for i, t in enumerate(texts)], "doc_id long, text string, y int, votes string, extra array<double>, key string, _sl_label int")
    labels = [(i, i % 2, i % 2) for i in range(60)] + [(3, 0, 0), (4, 1, 1)]  # 3 and 4 are labelled both ways: 1 counts
    flat = [(i, q, t) for i, q, t in labels if i not in (3, 4)] + [(3, 1, 1), (4, 1, 1)]
    for score, name in ((score_quality, "quality"), (score_toxicity, "toxic")):
        got = [
            sorted(tuple(r) for r in score(docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int").select("doc_id", name), F.lit(True)).collect()) for rows in (labels, flat)
        ]
        assert got[0] == got[1] and len(got[0]) == 60
