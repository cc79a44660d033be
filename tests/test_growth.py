"""Work that grows no faster than the input: what is worked out once, and results on long inputs."""

import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.operators import build as B
from strandloom.operators import info as I
from strandloom.operators import kmers as K
from strandloom.operators import ranges as R
from strandloom.operators import reads as RD
from strandloom.operators import superkmers as SK
from strandloom.operators import unions as UN
from strandloom.plans import carriers as T
from strandloom.plans import further_queries


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_runs_of_a_base_are_looked_up_once(spark):
    df = spark.createDataFrame([("ACCG" * 50_000,), ("AACCGGT",), ("",), (None,)], "s string").select(S.longest_homopolymer("s").alias("h"))
    assert _plan(df).count("regexp_extract_all") == 1
    assert [r["h"] and tuple(r["h"]) for r in df.collect()] == [(2, ["CC"]), (2, ["AA", "CC", "GG"]), (0, None), None]


def test_a_read_of_many_pieces_is_cut_in_one_pass(spark):
    long = "ACNTNNé" * 20_000
    rows = [(1, "h", long, "I" * (len(long) - 4)), (2, "", "", ""), (3, "x", None, ""), (4, "y", "TTNA", None), (5, "z", "nnGGn", "abcde")]
    got = RD.split_at_n(spark.createDataFrame(rows, "i int, header string, sequence string, quality string"))
    assert "lambdafunction" not in _plan(got)  # nothing is gone through for each piece
    found = {(r["i"], r["header"]): (r["sequence"], r["quality"]) for r in got.collect()}
    quality = "I" * (len(long) - 4)
    want = {(1, f"h:{m.start()}-{m.end()}"): (m[0], quality[m.start() : m.end()]) for m in re.finditer("[^N]+", long)}
    assert found == want | {(4, "y:0-2"): ("TT", None), (4, "y:3-4"): ("A", None), (5, "z:1-4"): ("GG", "cd")}


def test_more_windows_take_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(SK, "TASK_WINDOWS", 500)
    rng = random.Random(1)
    seqs = spark.createDataFrame([(i, "".join(rng.choices("ACGT", k=300))) for i in range(40)], "id int, sequence string")
    usual, _ = SK.dealt(SK.written_runs(seqs, 21, keys=["id"], seq_col="sequence"), 21, False)
    assert usual.rdd.getNumPartitions() == 40 * 280 // 500 + 1


def test_lists_of_groups_larger_than_blocks(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 3)
    monkeypatch.setattr(K, "TOGETHER", 2)
    rng, k = random.Random(2), 9
    shared = ["".join(rng.choices("ACGT", k=20)) for _ in range(6)]
    rows = [(i, "".join(rng.choices(shared, k=rng.randint(0, 3))) + "".join(rng.choices("ACGT", k=12))) for i in range(60)]
    rows += [(100 + i, shared[0]) for i in range(12)] + [(200, "ACG"), (201, "")]
    turn = str.maketrans("ACGT", "TGCA")
    own = {i: [min(s[j : j + k], s[j : j + k].translate(turn)[::-1]) for j in range(len(s) - k + 1)] for i, s in rows}
    want = {i: sorted(o for o in own if o != i and set(own[i]) & set(own[o])) for i in own}
    counts = {i: sum(any(x in own[o] for o in own if o != i) for x in own[i]) for i in own}
    found = K.kmer_overlaps(spark.createDataFrame(rows, "id int, sequence string"), k)
    assert {r["id"]: (r["kmers"], r["others"]) for r in found.collect()} == {i: (counts[i], want[i]) for i in own}


def test_sequences_do_not_travel_where_places_do(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{d}/lineitem.parquet").count()
    monkeypatch.setattr(T, "TASK_LINES", 100, raising=False)
    assert "RepartitionByExpression [_doc" in _plan(T.raw(spark, d)) and f"], {-(-lines // 100)}" in _plan(T.raw(spark, d))
    distinct = next(line for line in _plan(further_queries.long_duplications(spark, d)).split("\n") if "Aggregate" in line)
    assert "pos#" in distinct and "seq#" not in distinct


def test_targets_are_turned_round_once(spark):
    reads = spark.createDataFrame([(1, "ACGGA", "a"), (2, "TCCGT", "a"), (3, "GGGGG", "a"), (4, "ACG", "a"), (5, "ACGGA", "no"), (6, None, "a")], "i int, sequence string, header string")
    targets = spark.createDataFrame([("a", "TTACGGATT"), ("b", None)], "header string, sequence string")
    for strand, want in (("f", [1]), ("r", [2]), ("both", [1, 2])):
        found = K.reads_share_kmer(reads, targets, 4, strand)
        assert [r["i"] for r in found.orderBy("i").collect() if r["read_contains_reference_kmer"]] == want
        assert "Contains(reverse(" not in _plan(found)


def test_a_build_works_out_each_step_once_and_numbers_only_when_asked(spark, monkeypatch):
    monkeypatch.setattr(B, "numbered", lambda *_: pytest.fail("numbered without being asked"))
    built = B.build(T.variants(spark, "/root/testdata/sf0.001"), T.sequences(spark, "/root/testdata/sf0.001"), B.BuildOptions(w=20, k=25), seq_id_col="seq_id", var_col="variant")
    plan = _plan(built.variants)
    assert "size(array(struct" not in plan  # no filter that works out a step before it
    assert "upper(" not in plan  # the sequences are written


def test_common_prefixes_and_shared_kmers_of_any_length(spark):
    rng = random.Random(3)
    rows = [(None, "A"), ("A", None), (None, None), ("", "A"), ("", ""), ("ACA", "ACACACAA"), ("A" * 300, "A" * 299 + "C")]
    rows += [(p + "".join(rng.choices("AC", k=rng.randint(0, 9))), p + "".join(rng.choices("AC", k=rng.randint(0, 70)))) for p in ("", "A", "ACCA" * 4, "C" * 33) for _ in range(25)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", "b", S.common_prefix_length("a", "b").alias("p"), S.tandem_prefix("a", "b").alias("t"), *(S.shares_kmer("b", "a", k).alias(f"k{k}") for k in (3, 8))).collect()
    for r in got:
        a, b = r["a"], r["b"]
        if a is None or b is None:
            assert r["p"] == 0
            continue
        assert r["p"] == len(os.path.commonprefix([a, b]))
        assert r["t"] == (len(os.path.commonprefix([a * (len(b) + 1), b])) if a else 0)
        for k in (3, 8):
            assert r[f"k{k}"] == (b in a if len(b) <= k else any(b[i : i + k] in a for i in range(len(b) - k)))


def test_hits_of_a_frequent_kmer_are_made_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(K, "TASK_HITS", 50)
    monkeypatch.setattr(K, "BLOCK", 3)
    monkeypatch.setattr(SK, "HOT_SHARE", 1e-9)
    rng, k, turn = random.Random(4), 6, str.maketrans("ACGT", "TGCA")
    make = lambda i: "".join(rng.choices("ACGT", k=rng.randint(0, 40))) + "A" * (i % 3 * 9)
    own, ref = {f"q{i}": make(i) for i in range(20)} | {"": "ACG"}, {f"r{i}": make(i) for i in range(20)} | {"x": ""}
    tables = [spark.createDataFrame(list(x.items()), f"{n} string, sequence string") for x, n in ((own, "id"), (ref, "seq_id"))]
    for stranded in (True, False):
        want = []
        for i, s in own.items():
            words = {s[j : j + k] for j in range(len(s) - k + 1)}
            words |= set() if stranded else {w.translate(turn)[::-1] for w in words}
            want += [(f"{i}_{p}", i, r[max(p - 8, 0) : p + k + 8]) for r in ref.values() for p in range(len(r) - k + 1) if r[p : p + k] in words]
        got = K.distractors(*tables, k, stranded=stranded)
        assert got.rdd.getNumPartitions() >= len(want) // 50
        assert sorted(tuple(r) for r in got.select("header", "id", "sequence").collect()) == sorted(want)


@pytest.mark.parametrize("most", [500_000, 0])
def test_sequences_inside_others_of_any_length(spark, monkeypatch, most):
    monkeypatch.setattr(K, "MOST_BROADCAST", most)
    rng, turn = random.Random(5), str.maketrans("ACGT", "TGCA")
    long = ["".join(rng.choices("ACGT", k=rng.randint(150, 700))) for _ in range(6)]
    parts = []
    for size in (1, 2, 5, 6, 8, 11, 12, 13, 20, 21, 22, 60, 64, 65, 130):
        for _ in range(2):
            s = rng.choice(long)
            at = rng.randint(0, len(s) - size)
            cut = s[at : at + size] if size < 140 else s
            parts += [cut, cut.translate(turn)[::-1], cut[:-1] + "N"]
    rows = list(enumerate([*long, long[0], long[1].translate(turn)[::-1], long[2][-30:], *parts, "", None]))
    df = spark.createDataFrame(rows, "id int, sequence string")
    for stranded in (True, False):
        lies = lambda a, b: a in b or (not stranded and a in b.translate(turn)[::-1])
        want = {(i, j) for i, a in rows for j, b in rows if a and b and i != j and lies(a, b)}
        got = K.substring_relations(df, stranded)
        found = [tuple(r) for r in got.collect()]
        assert len(found) == len(want) and set(found) == want


def test_variants_of_a_build_are_dealt_once(spark, monkeypatch):
    plans, keep = [], B.in_columns
    monkeypatch.setattr(B, "in_columns", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    rows = spark.createDataFrame([(f"s{i % 3}", f"c.{i}A>C") for i in range(1, 40)], "seq_ID string, mutation string")
    seqs = spark.createDataFrame([("s0", "A" * 60), ("s1", "A" * 30), ("s3", "A" * 60)], "seq_id string, sequence string")
    found = B.build(rows, seqs, B.BuildOptions(w=4, k=5)).checked
    assert found.count() == 39 and found.filter("drop_reason = 'unknown_sequence'").count() == 13
    assert len(plans) == 1 and plans[0].count("REPARTITION_BY_COL") == 1
    assert plans[0].count("Exchange hashpartitioning") == 2  # the variants, and the tiles of sequences


@pytest.mark.parametrize("sizes", [(16, 8), (64, 40)])
def test_windows_are_the_same_whatever_tiles_hold(spark, monkeypatch, sizes):
    rng = random.Random(6)
    seqs = [(f"s{i}", "".join(rng.choices("ACGT", k=n))) for i, n in enumerate((700, 90, 17, 1, 0))]
    names = [None, "", "c.?del", "c.(3_4)del", "c.12+1A>C", "c.*4A>C", "c.5", "c.0del", "c.3_700del", "c.2_690inv", "c.16_17insACGT", "c.1_2dup", "c.1_99999999999del", "c.99999999999A>C"]
    names += [f"c.{p}_{p + n}{kind}" for p in (1, 15, 16, 17, 60, 89, 695) for n in (0, 1, 30) for kind in ("del", "dup", "inv", "delinsTTG")]
    names += [f"c.{p}{a}>{b}" for p in (1, 16, 17, 18, 90, 91, 92, 701, 702) for a, b in ("AC", "GT")]
    rows = [(s, n, x) for s in (*(i for i, _ in seqs), "no", None) for n in names for x in ((1, None) if n and "6" in n else (1,))]
    tables = spark.createDataFrame(rows, "seq_ID string, mutation string, more int"), spark.createDataFrame(seqs, "seq_id string, sequence string")

    def found():
        built = B.build(*tables, B.BuildOptions(w=10, k=12))
        kept = built.variants.select("header", "more", "variant_type", "named_start", "named_end", "sequence_length", "left_flank", "right_flank", "wt_sequence", "vcrs_sequence")
        return sorted(map(str, kept.collect())), sorted(map(str, built.checked.collect()))

    whole = found()
    assert len(whole[0]) > 100 and len(whole[1]) == len(rows)
    monkeypatch.setattr(B, "TILE", sizes[0])
    monkeypatch.setattr(B, "OVERLAP", sizes[1])
    assert found() == whole


def test_places_in_headers_need_no_merged_header(spark):
    assert "collect_list" not in _plan(further_queries.places_in_headers(spark, "/root/testdata/sf0.001"))
    rows = spark.createDataFrame([(i % 3, f"S{i * 7 % 50}:c.{i}A>C") for i in range(90)], "vcrs_id int, h string")
    merged = rows.groupBy("vcrs_id").agg(F.array_join(F.array_sort(F.collect_list("h")), ";").alias("vcrs_header"))
    want = I.explode_headers(merged).select("vcrs_id", "vcrs_header_individual", "order_in_vcrs")
    assert sorted(map(tuple, I.places_in_headers(rows, "h", "vcrs_id").select("vcrs_id", "h", "order_in_vcrs").collect())) == sorted(map(tuple, want.collect()))


def test_a_build_of_distinct_names_cleans_texts_once_and_sorts_no_names(spark, monkeypatch):
    d, written, keep = "/root/testdata/sf0.001", [], B.in_columns
    names, seqs = T.variants_and_sequences(spark, d)
    assert "regexp_replace" not in _plan(names) + _plan(seqs)
    assert sorted(names.collect()) == sorted(T.variants(spark, d).select("seq_id", "variant").collect())
    assert sorted(seqs.collect()) == sorted(T.sequences(spark, d).collect())
    monkeypatch.setattr(B, "in_columns", lambda df: written.append(df) or keep(df))
    built = [B.build(names, seqs, B.BuildOptions(w=20, k=25, distinct=x), seq_id_col="seq_id", var_col="variant") for x in (True, False)]
    plan = written[0]._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" in plan
    assert not {"header", "variant_type", "start", "end", "flank_low", "flank_high"} & set(written[0].columns)  # these follow from the others
    one, two = (sorted(map(str, b.checked.collect())) for b in built)
    assert one == two
    one, two = (sorted(map(str, b.variants.drop("original_order").collect())) for b in built)
    assert one == two and len(one) > 100


def test_windows_of_bytes_are_those_of_characters(spark):
    rows = [(s, i, j) for s in ("ACGTNACGT", "", None) for i in (-3, 0, 2, 8, 9, 12) for j in (-1, 0, 3, 9, 20)]
    got = spark.createDataFrame(rows, "s string, i int, j int").select(S.slice_of_bytes("s", "i", "j").alias("a"), S.slice_between("s", "i", "j").alias("b")).collect()
    assert len(got) == len(rows) and all(r["a"] == r["b"] for r in got)
    seqs = spark.createDataFrame([("é", "AéCGT" * 2000), ("a", "AACGT" * 2000)], "seq_id string, sequence string")
    places = spark.createDataFrame([(i, p, p + 7) for i in ("é", "a") for p in (0, 4090, 4096, 9000)], "seq_id string, low long, high long")
    found = B.windows(places, seqs, "low", "high", "bases").collect()
    assert all(r["bases"] == (("AéCGT" if r["seq_id"] == "é" else "AACGT") * 2000)[r["low"] : r["high"]] for r in found) and len(found) == 8


def test_of_a_sequence_and_its_key_one_is_merged(spark):
    rng, turn = random.Random(7), str.maketrans("ACGTNacgtn.", "TGCANtgcan.")
    some = ["".join(rng.choices("ACGTNacg", k=rng.randint(0, 9))) for _ in range(60)] + ["ACGT", "é", ""]
    rows = [(rng.choice([f"h{i}", f"h{i}", None]), rng.choice([s, s.translate(turn)[::-1]]), i) for i, s in enumerate(some * 4)]
    df = spark.createDataFrame(rows, "header string, vcrs_sequence string, original_order long")
    for reverse in (True, False):
        groups = {}
        for h, s, i in rows:
            groups.setdefault(min(s, s.translate(turn)[::-1]) if reverse else s, []).append((h, s, i))
        want = [(";".join(sorted(h for h, _, _ in g if h)), min(((h, s) for h, s, _ in g if h), default=(0, None))[1], min(i for _, _, i in g)) for g in groups.values()]
        merged = B.merge_identical(df, reverse)
        assert "min_by" not in _plan(merged)  # the sequence does not travel beside its key
        key = lambda r: r[2]
        assert sorted((tuple(r) for r in merged.select("vcrs_header", "vcrs_sequence", "original_order").collect()), key=key) == sorted(want, key=key)


def test_headers_within_reach_are_not_numbered(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    built = B.build(T.variants(spark, d), T.sequences(spark, d), B.BuildOptions(w=20, k=25), seq_id_col="seq_id", var_col="variant")
    lengths = T.sequences(spark, d).select(F.col("seq_id").alias("transcript_id"), F.lit(0).alias("utr5"), F.lit(400).alias("transcript_length"))
    want = further_queries.V.reachable(built.vcrs, lengths, "dropseq", 100)
    assert want.columns == built.vcrs.columns  # columns besides the header are still joined
    want = sorted(r["vcrs_header"] for r in want.collect())
    monkeypatch.setattr(B, "numbered", lambda *_: pytest.fail("numbered without need"))
    assert sorted(r["vcrs_header"] for r in further_queries.headers_within_reach(spark, d).collect()) == want != []


def test_no_pair_of_sequences_travels_to_be_made_distinct(spark, monkeypatch):
    rng = random.Random(8)
    long = ["".join(rng.choices("ACGT", k=400)) for _ in range(20)]
    rows = list(enumerate([*long, *(s[9 : 9 + n] for s in long for n in (1, 4, 5, 8, 15, 40))])) + [(900, "é" * 70 + long[0]), (901, "é" * 66 + long[0][:5]), (902, "é" * 3 + long[0][:4])]
    rows += [(903, long[1][:63]), (904, long[1][:64]), (905, long[1][5:70])]
    lies = lambda a, b: a in b or a in b.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    want = sorted((i, j) for i, a in rows for j, b in rows if i != j and lies(a, b))
    found = K.substring_relations(spark.createDataFrame(rows, "id int, sequence string"))
    assert sorted(tuple(r) for r in found.collect()) == want
    again = spark.createDataFrame(rows + rows[:30], "id int, sequence string")
    assert sorted(tuple(r) for r in K.substring_relations(again).collect()) == want  # ids that come twice give no pair twice
    mixed = [(i, s.lower() if i % 5 == 0 else s) for i, s in rows] + [(i + 2000, s[:5] + "N" + s[6:]) for i, s in rows if i % 7 == 0]
    lies_as = lambda a, b: a in b or a in b.translate(str.maketrans("ACGTacgt", "TGCAtgca"))[::-1]
    found = K.substring_relations(spark.createDataFrame(mixed, "id int, sequence string"))
    assert sorted(tuple(r) for r in found.collect()) == sorted((i, j) for i, a in mixed for j, b in mixed if i != j and lies_as(a, b))
    short = K._words_inside(K.SK.written(spark.createDataFrame(rows, "id int, sequence string")), spark.createDataFrame(rows, "inside int, sequence string").repartition(4, "inside"), {4: 4, 5: 5}, 512, True, False)
    assert short._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(inside") == 1


def test_a_word_of_all_sequences_deals_no_kmers_of_distractors_one_by_one(spark, monkeypatch):
    rng, dealt, frequent = random.Random(9), SK.dealt, []
    monkeypatch.setattr(SK, "HOT_SHARE", 0.01)
    monkeypatch.setattr(SK, "dealt", lambda *a, **b: frequent.append(out := dealt(*a, **b)) or out)
    bases = lambda n: "".join(rng.choices("ACGT", k=n))
    word = min((bases(SK.SIZE) for _ in range(5000)), key=lambda w: SK._mixed(SK._packed(SK._CODE[list(w.encode())], SK.SIZE)[:1] + 1)[0])  # mostly the minimizer
    rows = [(f"{i}", bases(20) + word + bases(20)) for i in range(3000)]
    own, ref = spark.createDataFrame(rows[:2000], "id string, sequence string"), spark.createDataFrame(rows[1900:], "seq_id string, sequence string")
    cut = lambda part: Counter(s[i : i + 21] for _, s in part for i in range(len(s) - 20))
    ids, places = cut(rows[:2000]), cut(rows[1900:])
    assert K.distractors(own, ref, 21, stranded=True).count() == sum(n * places[x] for x, n in ids.items())
    assert frequent[0][1].count() == 0


@pytest.mark.parametrize("most", [0, 3, 2000])
def test_nearby_variants_of_any_length_meet_in_one_order(spark, monkeypatch, most):
    monkeypatch.setattr(R, "BIN", 40)
    monkeypatch.setattr(R, "SHORT", 8)
    rng = random.Random(most)
    rows = [(rng.choice(["a", "b", None]), at := rng.choice([rng.randint(-50, 400), None]), at and at + rng.choice([0, 1, 3, rng.randint(-most, most)]), rng.choice([f"h{i}", "h", None])) for i in range(150)]
    rows += [("a", 5, None, "x"), ("a", 6, 7, "y"), *rows[:9]]
    near = lambda x, y: x is not None and y is not None and abs(x - y) <= 9
    mates = lambda r: {o[1:] for o in rows if r[0] is not None and o[0] == r[0] and o != r and (near(o[2], r[1]) or near(o[1], r[2]))}
    order = lambda x: (x is not None, x or "")
    want = sorted((order(r[3]), sorted((order(o[2]) for o in mates(r)))) for r in rows)
    df = spark.createDataFrame(rows, "seq_id string, start long, end long, header string")
    got = R.nearby_variants(df, 10).collect()
    assert sorted((order(r["header"]), sorted(map(order, r["nearby_variants"]))) for r in got) == want
    assert all(r["nearby_variants_count"] == len(r["nearby_variants"]) for r in got)
    assert all(x == sorted(x) for x in ([y for y in r["nearby_variants"] if y is not None] for r in got))


def test_nearby_variants_stay_where_their_sequence_is(spark):
    df = spark.createDataFrame([("a", i, i + 1, f"{i}") for i in range(40)], "seq_id string, start long, end long, header string").repartition(4, "seq_id")
    plan = R.nearby_variants(df, 10, longest=1)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("kind", ["int", "string"])
def test_a_list_comes_once_for_each_part(spark, monkeypatch, kind):
    monkeypatch.setattr(UN, "PARTS", 3)
    monkeypatch.setattr(K, "BLOCK", 5)
    rng, k, plans = random.Random(10), 9, []
    shared = ["".join(rng.choices("ACGT", k=20)) for _ in range(9)]
    rows = [(i, "".join(rng.choices(shared, k=rng.randint(0, 4))) + "".join(rng.choices("ACGT", k=12))) for i in range(120)]
    rows = [(i if kind == "int" else f"n{i}", s) for i, s in rows]
    own = {i: {s[j : j + k] for j in range(len(s) - k + 1)} for i, s in rows}
    want = {i: sorted(o for o in own if o != i and own[i] & own[o]) for i in own}
    keep = UN.unions
    monkeypatch.setattr(UN, "unions", lambda *a: plans.append(a) or keep(*a))
    found = K.kmer_overlaps(spark.createDataFrame(rows, f"id {kind}, sequence string"), k, True)
    assert {r["id"]: r["others"] for r in found.collect()} == want
    asked, lists, *_ = plans[0]
    assert asked.select("_part").distinct().count() <= 3
    # what travels: pieces of a list for each part at most, and no list of others
    assert lists.agg(F.max(F.size("_items"))).first()[0] <= 2 * 5 + 5
    assert "flatten" not in _plan(found) and "Join Inner, (id" not in _plan(found)
