"""op1, op2, op9 against brute force, and the special cases that they define."""

import random
import re
import tracemalloc

import numpy as np
import pytest

from strandloom.llm.chars import mix, slices
from strandloom.llm.components import components
from strandloom.llm.decontaminate import Items, align, contamination, matches
from strandloom.llm.line_dedup import deduplicate_lines
from strandloom.llm.minhash import bitmap, near_duplicates, signature

WORDS = [a + b + c for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def brute_components(rows, k):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {i: len(s) for i, s in sets.items()}, label


def test_near_duplicates(spark):
    rng = random.Random(3)
    rows = []
    for base in range(12):
        words = sentence(rng, rng.choice([2, 5, 9, 40, 120])).split()
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            rows.append((len(rows), " ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy)))
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "x"), (904, "x"), (None, "x")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n int, rep int")
    sizes, label = brute_components([r for r in rows if r[0] is not None], 4)
    got = near_duplicates(docs, words=4).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (sizes[r["doc_id"]], label[r["doc_id"]], r["doc_id"] == label[r["doc_id"]]), r


def test_near_duplicates_of_templates(spark):
    rng = random.Random(17)
    frame, hub = sentence(rng, 160).split(), sentence(rng, 200).split()
    fresh = lambda n: [f"{w}{rng.randrange(10**6)}" for w in sentence(rng, n).split()]
    texts = [frame + fresh(20) for _ in range(1000)]  # at 0.797 with each other
    for i in range(60):
        texts.append(frame + texts[i][160:161] + fresh(19))  # at 0.806 with one
    for _ in range(150):  # at 0.85 with the hub, most of them below 0.8 with each other
        copy = list(hub)
        for at in rng.sample(range(2, 195, 4), 4):
            copy[at] = fresh(1)[0]
        texts.append(copy)
    texts.append(hub)
    rng.shuffle(texts)
    sets = [{tuple(t[j : j + 4]) for j in range(len(t) - 3)} for t in texts]
    label = list(range(len(texts)))
    for b in range(len(sets)):
        for a in range(b):
            both = len(sets[a] & sets[b]) if label[a] != label[b] else 0
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    assert len(set(label)) == 1001
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    for most_looks in (50_000_000, 0):  # inside the bucket, and by the rarest shingles
        got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs, words=4, most_looks=most_looks).collect()}
        assert got == dict(enumerate(label))


def test_near_duplicates_of_many_short_texts(spark):
    """2,400 texts of 4 to 40 words, many of them copies with a change or two, and repeated ids."""
    rng = random.Random(23)
    rows = []
    while len(rows) < 2400:
        base = sentence(rng, rng.choice([4, 6, 9, 14, 25, 40])).split()
        for _ in range(rng.choice([1, 1, 2, 5])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            rows.append((len(rows), " ".join(copy)))
    rows += [(7, rows[1200][1]), (9, rows[1500][1]), (9, rows[1500][1]), (2399, sentence(rng, 30))]  # one document each
    sets, holders = [], {}
    for i, t in rows:
        w = t.split()
        s = {tuple(w[j : j + 4]) for j in range(len(w) - 3)} or {tuple(w)}
        for x in s:
            holders.setdefault(x, []).append(len(sets))
        sets.append(s)
    label = {i: i for i, _ in rows}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for number, own in enumerate(sets):
        for other in {o for x in own for o in holders[x] if o < number}:
            both = len(own & sets[other])
            if 100 * both >= 80 * (len(own) + len(sets[other]) - both):
                a, b = sorted((top(rows[number][0]), top(rows[other][0])))
                label[b] = a
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = near_duplicates(docs, words=4).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: top(i) for i in label}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("size", [8, 18, 45, 400])
def test_recall_of_the_bands(size):
    """Of pairs at a similarity just over 0.8 all but a few in a hundred thousand share a bucket."""
    rng = np.random.default_rng(size)
    missed, pairs = 0, 1500
    odd = mix(np.arange(1, 151, dtype=np.uint64)) | np.uint64(1)
    with np.errstate(over="ignore"):
        for _ in range(pairs):
            common = int(np.ceil(size * 8 / 9))  # of two sets of this size
            some = rng.integers(0, 2**63, 2 * size - common).astype(np.uint64)
            a, b = np.unique(mix(some[:size])), np.unique(mix(np.r_[some[:common], some[size:]]))
            bands = [(signature(x, 150) * odd).reshape(30, 5).sum(axis=1) for x in (a, b)]
            missed += not (bands[0] == bands[1]).any()
    assert missed <= 1


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(2)
    for size in (3, 200, 5000):
        a, b = (rng.integers(0, 2**63, size).astype(np.uint64) for _ in range(2))
        b[: size // 2] = a[: size // 2]
        differ = len(np.setxor1d(a, b))
        bits = int(np.bitwise_count((bitmap(a) ^ bitmap(b)).view(np.uint64)).sum())
        assert bits <= differ and (size > 300 or bits > 0.7 * differ)


def test_near_duplicates_of_very_long_and_repeated_rows(spark):
    rng = random.Random(29)
    long = sentence(rng, 30000).split()
    other = long[:15000] + ["changed"] + long[15001:]
    rows = [(3, " ".join(long)), (1, " ".join(other)), (2, sentence(rng, 30)), (2, sentence(rng, 30)), (4, None), (4, "")] + [(5, "x y z")] * 4
    docs = spark.createDataFrame([(i, t, 1, "k", 2) for i, t in rows], "doc_id long, text string, id int, key string, component int")
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(docs).collect())
    assert got == [(1, 1, True), (2, 2, True), (2, 2, True), (3, 1, False), (4, 4, True), (4, 4, True), *[(5, 5, True)] * 4]


def test_components(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, 90), (90, 95), (200, 201)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 90: 90, 95: 90, 100: 90, 200: 200, 201: 200}


def test_line_dedup(spark):
    rng = random.Random(5)
    shared, short = [sentence(rng, n) for n in (60, 30, 28, 12)], sentence(rng, 20)
    fresh = lambda n: sentence(rng, n)
    rows = [
        (1, "\n".join([fresh(9), shared[0], short, fresh(30)])),
        (2, "\n".join([fresh(40), "", shared[0] + " ", fresh(8)])),  # one long line
        (3, "\n".join([shared[1], shared[2], shared[3], fresh(35)])),
        (4, "\n".join([fresh(26), shared[1], shared[2], shared[3], short])),  # a run of lines
        (5, "\n".join([fresh(26), shared[1], fresh(30)])),  # too short a run
        (6, None), (7, ""), (8, fresh(200)), (None, fresh(3)),
    ]
    rows += [(9, rows[0][1])]
    docs = spark.createDataFrame([(i, t, "a", 1, "b") for i, t in rows], "doc_id long, text string, row string, pos int, gram string")
    got = {r["doc_id"]: r for r in deduplicate_lines(docs).collect()}
    assert {i: list(r["_sl_removed"] or []) for i, r in got.items()} == {1: [], 2: [2], 3: [], 4: [1, 2, 3], 5: [], 6: [], 7: [], 8: [], None: [], 9: [0, 1, 2, 3]}
    assert got[2]["text"].split("\n") == [x for i, x in enumerate(rows[1][1].split("\n")) if i != 2]
    assert got[6]["text"] is None and got[9]["text"] == "" and got[8]["text"] == rows[7][1] and got[4]["row"] == "a"


def brute_lines(rows, words=50):
    """Per id the lines in a run of so many words that stands somewhere earlier as well."""
    texts = [(i, [(p, x.strip()) for p, x in enumerate(t.split("\n")) if x.strip()]) for i, t in sorted(rows)]
    gone = {i: set() for i, _ in rows}
    for at, (i, mine) in enumerate(texts):
        for j, other in texts[: at + 1]:
            for shift in range(-len(other), len(mine)):
                if i == j and shift <= 0:
                    continue
                run = []
                for k in range(max(0, shift), min(len(mine), len(other) + shift) + 1):
                    if k < min(len(mine), len(other) + shift) and mine[k][1] == other[k - shift][1]:
                        run.append(mine[k])
                        continue
                    if sum(x.count(" ") + 1 for _, x in run) >= words:
                        gone[i] |= {p for p, _ in run}
                    run = []
    return {i: sorted(g) for i, g in gone.items()}


def removed(spark, rows):
    got = deduplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return {r["doc_id"]: list(r["_sl_removed"] or []) for r in got}


def test_line_dedup_extends_past_long_lines(spark):
    rng = random.Random(11)
    long, tail = sentence(rng, 80), sentence(rng, 8)
    rows = [(i, "\n".join([sentence(rng, 30), long, tail, sentence(rng, 9)])) for i in (1, 2)]
    assert removed(spark, rows) == {1: [], 2: [1, 2]}
    pool = [sentence(rng, n) for n in (3, 8, 8, 20, 26, 40, 55, 80, 130)]
    rows = [(i, "\n".join(rng.choice(pool + [""]) if rng.random() < 0.8 else sentence(rng, 9) for _ in range(25))) for i in range(12)]
    assert removed(spark, rows) == brute_lines(rows)


def test_line_dedup_against_every_earlier_text(spark):
    rng = random.Random(13)
    a, b, c = (sentence(rng, n) for n in (30, 30, 20))
    parts = [[a, b, sentence(rng, 9)], [sentence(rng, 9), a, b, c, sentence(rng, 9)], [sentence(rng, 9), a, b, c, sentence(rng, 9)]]
    # the first text has all fingerprints of the run, the second more of its lines
    assert removed(spark, [(i, "\n".join(p)) for i, p in enumerate(parts)]) == {0: [], 1: [1, 2], 2: [1, 2, 3]}


def test_contamination(spark):
    rng = random.Random(7)
    items = [(i, sentence(rng, 40).capitalize()) for i in range(6)] + [(7, None), (8, ""), (9, "tiny")]
    edited = list(items[1][1])
    for at in (20, 90, 140):
        edited[at] = "#"
    del edited[61:63]
    rows = [
        (1, f"{sentence(rng, 50)}\n{items[0][1].upper()}  {sentence(rng, 9)}"), (2, sentence(rng, 30) + " " + "".join(edited)), (3, sentence(rng, 300)),
        (4, items[2][1].replace(" ", " \n ")), (5, None), (6, ""), (None, items[3][1]), (8, items[4][1][: len(items[4][1]) // 2]), (9, "tiny"),
        (10, sentence(rng, 20000) + " " + items[5][1]),
    ]
    docs = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in contamination(docs, bench, block_chars=400).collect()}  # several blocks
    assert set(got) == {(1, 0), (2, 1), (4, 2), (None, 3), (10, 5)}
    assert got[2, 1]["edits"] == 5 and got[1, 0]["edits"] == 0
    text = dict(rows)
    assert text[1][got[1, 0]["match_start"] : got[1, 0]["match_end"]] == items[0][1].upper()
    assert contamination(docs, bench.limit(0)).count() == 0 and contamination(docs.limit(0), bench).count() == 0


def test_contamination_against_brute_force(spark):
    """Every item that occurs within its budget is found, and nothing else is."""
    rng = random.Random(21)
    letters = lambda n: "".join(rng.choice("abcd ") for _ in range(n)).strip()
    items = [(i, " ".join(letters(rng.randrange(30, 90)).split())) for i in range(8)] + [(8, "-" * 60), (9, "=-" * 30)]
    rows = []
    for i in range(60):
        text = list(rng.choice(items)[1])
        for _ in range(rng.randrange(7)):
            at = rng.randrange(len(text))
            text[at : at + rng.randrange(2)] = rng.choice(["", "x", "yz"])
        rows.append((i, letters(40) + "".join(text) + letters(40)))
    rows += [(60, "-" * 200), (61, "=-" * 90), (62, "- " * 40)]
    want = set()
    for d, t in rows:
        t = " ".join(t.split()) if t.split() else ""
        for j, x in items:
            budget = min(int(len(x) * 0.06), max((len(x) - 10) // 10, 0))
            if best_edits(x, t) <= budget:
                want.add((d, j))
    assert 20 < len(want) < 120
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")
    got = contamination(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    twice = contamination(docs.union(docs), bench).count()
    assert twice == 2 * len(got)


def best_edits(item, text):
    """The fewest edits of any occurrence of ``item`` in ``text``."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_ruled_lines_stay_bounded():
    item = "-" * 2000
    block = Items.build([1], [item], 10, 0.06)
    part = next(slices(["-" * 20000]))
    tracemalloc.start()
    found = matches(part, block)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(a, b) for _, _, a, b, _, _ in found] == [(i * 2000, i * 2000 + 2000) for i in range(10)] and peak < 300e6


@pytest.mark.parametrize("seed", range(6))
def test_alignment(seed):
    rng = np.random.default_rng(seed)
    item, text = rng.integers(0, 3, 12), rng.integers(0, 3, 30)
    places = [(a, b) for a in range(31) for b in range(a, 31)]
    best = min(lev(item.tolist(), text[a:b].tolist()) for a, b in places)
    found = align(item, text, -12, 60, 12)
    assert found[0] == best and lev(item.tolist(), text[found[1] : found[2]].tolist()) == best
    assert align(item, text, -12, 60, best - 1) is None
    for first in range(-3, 20):  # a narrow band gives no less, and what the text has
        if narrow := align(item, text, first, 5, 12):
            assert narrow[0] >= lev(item.tolist(), text[narrow[1] : narrow[2]].tolist()) >= best and first <= narrow[1] < first + 5


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(none).count() == 0 and deduplicate_lines(none).count() == 0


def test_tables_on_the_way_are_deleted(spark):
    """What stays in the shared folder of near duplicates is the result."""
    from pathlib import Path

    from strandloom.llm.common import shared_dir

    top = Path(shared_dir(spark).removeprefix("file:"))
    files = lambda: {str(p) for p in top.rglob("*.parquet")}
    rng, before = random.Random(5), files()
    docs = spark.createDataFrame([(i, sentence(rng, 30) if i % 3 else "the same text again and again it is") for i in range(60)], "doc_id long, text string")
    out = near_duplicates(docs)
    assert out.count() == 60 and {str(p).split("/")[-2] for p in files() - before} == {"near_duplicates"}
