"""Adapters, inserts, window cuts, quality profiles and frequent sequences: against plain versions."""

import random
from collections import Counter, defaultdict
from statistics import mean

import pytest

from strandloom.operators import adapters as AD
from strandloom.operators import profile as PR
from strandloom.operators import reads as RD

RNG = random.Random(12)
TURN = str.maketrans("ACGT", "TGCA")
ADAPTER = "AGATCGGAAGAGCACACGTCTGAACTCCAGTCA"


def bases(n):
    return "".join(RNG.choice("ACGT") for _ in range(n))


def turned(s):
    return s[::-1].translate(TURN)


def wrong(a, b):
    return sum(x != y or x not in "ACGT" for x, y in zip(a, b, strict=False))


def changed(s, n):
    out = list(s)
    for i in RNG.sample(range(len(s)), min(n, len(s))):
        out[i] = RNG.choice([x for x in "ACGTN" if x != out[i]])
    return "".join(out)


def brute_insert(one, two, least, most, share):
    rc, best = turned(two.replace("N", "n")).replace("n", "N"), (0, 0, 0)
    for by in range(-len(rc) + 1, len(one)):
        a, b = (one[by:], rc) if by >= 0 else (one, rc[-by:])
        overlap, bad = min(len(a), len(b)), wrong(a, b)
        if overlap >= least and bad <= min(most, int(share * overlap)):
            best = max(best, (overlap, -bad, by + len(rc)))
    return best[2] or None


def test_inserts_against_brute_force(spark):
    pairs = []
    for i in range(150):
        insert = bases(RNG.choice([12, 25, 31, 40, 63, 64, 65, 70, 90, 120, 200]))
        size = RNG.choice([40, 64, 75, 100])
        one, two = (s + ADAPTER + bases(120) for s in (insert, turned(insert)))
        pairs.append((i, changed(one[:size], RNG.choice([0, 0, 1, 4])), changed(two[: size - RNG.choice([0, 7])], RNG.choice([0, 1, 6]))))
    pairs += [(1000, "", "ACGT"), (1001, None, None), (1002, "ACGT" * 20, "ACGT" * 20), (1003, "N" * 60, "N" * 60)]
    df = spark.createDataFrame(pairs, "i int, sequence_1 string, sequence_2 string").repartition(3)
    for least, most, share in ((20, 5, 0.2), (30, 2, 0.1)):
        got = {r["i"]: r["insert_size"] for r in AD.with_insert_sizes(df, least=least, most=most, share=share).collect()}
        assert got == {i: brute_insert(a or "", b or "", least, most, share) for i, a, b in pairs}


def test_mates_are_cut_to_their_insert(spark):
    insert = bases(50)
    one, two = insert + ADAPTER[:25], turned(insert) + ADAPTER[:25]
    df = spark.createDataFrame([(one, "I" * 75, two, "J" * 75), (bases(75), "I" * 75, bases(75), "J" * 75)], "sequence_1 string, quality_1 string, sequence_2 string, quality_2 string")
    got = sorted(map(tuple, AD.trimmed_to_insert(df).collect()), key=lambda r: r[4] is None)
    assert got[0] == (insert, "I" * 50, turned(insert), "J" * 50, 50) and [len(x) for x in got[1][:4]] == [75] * 4 and got[1][4] is None


def brute_place(read, adapter, least, share):
    for at in range(len(read)):
        part = read[at : at + len(adapter)]
        if len(part) >= least and sum(x != y for x, y in zip(part, adapter, strict=False)) <= int(share * len(part)):
            return at
    return len(read)


@pytest.mark.parametrize("size", [6, 13, 30])
def test_adapters_with_one_error_in_ten(spark, size):
    adapter, rows = ADAPTER[:size], []
    for i in range(200):
        at = RNG.randint(0, 80)
        read = (bases(at) + changed(adapter, size // 10 if RNG.random() < 0.5 else 0) + bases(90))[:90]
        rows.append((i, read, "".join(RNG.choice("!5I") for _ in read)))
    rows += [(900, "", ""), (901, adapter, "I" * size), (902, adapter[:5], "IIIII")]
    df = spark.createDataFrame(rows + [(903, None, None)], "i int, sequence string, quality string")
    got = {r["i"]: (r["sequence"], r["quality"]) for r in AD.without_adapter(df, adapter).collect()}
    for i, s, q in rows:
        at = brute_place(s, adapter, 6, 0.1)
        assert got[i] == (s[:at], q[:at])
    assert got[903] == (None, None)
    short = spark.createDataFrame([(bases(9) + adapter[:6], "I" * 15), ("", "")], "sequence string, quality string")
    assert [len(r["sequence"]) for r in AD.without_adapter(short, adapter + bases(70)).collect()][1] == 0


def test_an_adapter_is_inferred(spark):
    rows = [((bases(RNG.randint(30, 80)) + ADAPTER + "".join(bases(60)))[:100],) for _ in range(1500)]
    found = AD.infer_adapter(spark.createDataFrame(rows, "sequence string"), tail=70)
    assert found and found in ADAPTER + "ACGT" and len(found) >= 25
    assert AD.infer_adapter(spark.createDataFrame([(bases(100),) for _ in range(800)], "sequence string"), share=0.02) is None
    assert AD.infer_adapter(spark.createDataFrame([], "sequence string")) is None


def test_window_cuts_against_sums(spark):
    rows = [(i, bases(n), "".join(chr(33 + RNG.choice([2, 10, 15, 35])) for _ in range(n))) for i, n in enumerate([0, 1, 3, 4, 5, 40, 151] * 20)]
    df = spark.createDataFrame(rows, "i int, sequence string, quality string").repartition(3)
    got = {r["i"]: len(r["sequence"]) for r in RD.trim(df, window=4, mean=13).collect()}
    for i, s, q in rows:
        bad = [j for j in range(len(q) - 3) if sum(ord(c) - 33 for c in q[j : j + 4]) < 52]
        assert got[i] == (min(bad) if bad else len(s))


def test_profile(spark):
    rows = [(f"f{i % 2}", "".join(RNG.choice("ACGTN") for _ in range(n)), "".join(chr(33 + RNG.randint(0, 41)) for _ in range(n))) for i in range(300) for n in [RNG.choice([0, 1, 20, 33])]]
    df = spark.createDataFrame([*rows, ("f0", None, None)], "file string, sequence string, quality string").repartition(4)
    got = {(r["file"], r["cycle"]): r for r in PR.quality_profile(df, "file").collect()}
    seen = defaultdict(list)
    for f, s, q in rows:
        for i, (b, c) in enumerate(zip(s, q, strict=True), 1):
            seen[f, i].append((b, ord(c) - 33))
    assert set(got) == set(seen)
    for key, own in seen.items():
        r, scores = got[key], sorted(x for _, x in own)
        assert r["reads"] == len(own) and r["mean_quality"] == pytest.approx(mean(scores)) and r["median_quality"] == scores[(len(scores) - 1) // 2]
        assert r["share_n"] == pytest.approx(mean(b == "N" for b, _ in own)) and r["share_gc"] == pytest.approx(mean(b in "CG" for b, _ in own))
        assert r["share_q30"] == pytest.approx(mean(x >= 30 for _, x in own))
    assert PR.quality_profile(df.drop("file")).count() == 33


def test_frequent_sequences(spark):
    pool = [bases(60) for _ in range(3000)]
    rows = [(RNG.choice(pool),) for _ in range(4000)] + [(pool[i],) for i in range(20) for _ in range(10 * i)] + [(None,), ("",)]
    counts = Counter(s[:50] for (s,) in rows if s is not None)
    for n, share in ((1, 0.01), (6, 0.01), (6, 0.004)):
        got = {r["sequence"]: r["n"] for r in PR.overrepresented(spark.createDataFrame(rows, "sequence string").repartition(n), share).collect()}
        assert got == {s: c for s, c in counts.items() if c > share * (len(rows) - 1)}
