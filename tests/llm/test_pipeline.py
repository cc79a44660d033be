"""The pipeline's stages on a small corpus with planted cases, and its whole run."""

import random

import corpus_pipeline as P
from test_near_and_lines import best_edits, brute_components, brute_lines, sentence


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    passage, item = sentence(rng, 60), sentence(rng, 40)
    clean = [(i, sentence(rng, 50) + ".\n" + sentence(rng, 30) + ".") for i in range(60)]
    near = sentence(rng, 300).split()
    other = list(near)
    other[150] = "changed"
    rows = clean + [
        (100, sentence(rng, 20) + "\n" + passage), (101, sentence(rng, 25) + "\n" + passage), (102, " ".join(near)), (103, " ".join(other)),
        (104, sentence(rng, 50) + " " + item), (105, " ".join(w + "%%%" for w in sentence(rng, 40).split())), (106, None), (107, ""),
    ]
    junk = [(200 + i, " ".join(w + "%%%" for w in sentence(rng, 40).split())) for i in range(30)]
    docs = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows + junk]
    folder = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i, _ in clean[:50]] + [(i, 0, 0) for i, _ in junk]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    df = spark.read.parquet(f"{folder}/documents.parquet")
    left = {}
    for n, (name, stage) in enumerate(P.STAGES):
        stage(spark, df, folder).write.parquet(f"{folder}/out{n}")
        df = spark.read.parquet(f"{folder}/out{n}")
        left[name] = {r["doc_id"]: r for r in df.collect()}
        if name != "packing":
            assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert not {105, *(i for i, _ in junk)} & set(left["quality"]) and {i for i, _ in clean} <= set(left["quality"])
    assert passage in left["line_dedup"][100]["text"] and passage not in left["line_dedup"][101]["text"]
    assert left["line_dedup"][101]["n_chars"] == len(left["line_dedup"][101]["text"])
    assert 102 in left["near_dedup"] and 103 not in left["near_dedup"]
    assert 104 not in left["decontamination"] and {i for i, _ in clean} <= set(left["packing"])


def test_rows_without_ids_and_empty_tables(spark, tmp_path):
    rng = random.Random(12)
    item, copy = sentence(rng, 40), sentence(rng, 120)
    junk = " ".join(w + "%%%" for w in sentence(rng, 40).split())
    clean = [(i, sentence(rng, 50) + ".") for i in range(46)]
    rows = clean + [(100 + i, junk.replace("a", "e", i)) for i in range(30)] + [(45, junk), (None, junk), (None, copy), (50, copy), (None, sentence(rng, 50) + " " + item), (None, None), (None, clean[0][1] + " x")]
    docs = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    folder = str(tmp_path)
    df = spark.createDataFrame(docs, schema)
    labels = [(i, 1, 0) for i, _ in clean[:40]] + [(100 + i, 0, 0) for i in range(30)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id int, text string").write.parquet(f"{folder}/benchmark.parquet")
    texts = lambda stage: sorted(((r["doc_id"], r["text"]) for r in stage(spark, df, folder).collect()), key=str)
    good = texts(P.quality)
    # the junk that repeats id 45 or has none goes, and the clean text of id 45 stays
    assert (45, junk) not in good and (None, junk) not in good and set(clean) <= set(good)
    near = texts(P.near)
    assert (50, copy) in near and (None, copy) not in near and (None, None) in near and (None, clean[0][1] + " x") not in near
    pure = texts(P.benchmark)
    assert len(pure) == len(rows) - 1 and not [t for _, t in pure if t and item in t]
    none = df.limit(0)
    assert all(stage(spark, none, folder).count() == 0 for _, stage in P.STAGES)


def test_stages_against_brute_force(spark, tmp_path):
    """What line dedup, near dedup, decontamination and packing keep, against plain versions of them."""
    rng = random.Random(31)
    pool = [sentence(rng, n) for n in (8, 14, 30, 40, 60)]
    items = [(i, sentence(rng, 30)) for i in range(3)]
    rows = []
    for i in range(70):
        lines = [rng.choice(pool) if rng.random() < 0.3 else sentence(rng, rng.randint(5, 20)) for _ in range(rng.randint(1, 7))]
        if rng.random() < 0.2:
            lines.insert(rng.randrange(len(lines) + 1), rng.choice(items)[1])
        rows.append((i, "\n".join(lines)))
    for i in range(70, 90):
        words = rows[rng.randrange(70)][1].split(" ")
        words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words)))
    folder = str(tmp_path)
    spark.createDataFrame(items, "item_id int, text string").write.parquet(f"{folder}/benchmark.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], schema)
    stages = dict(P.STAGES)
    gone = brute_lines(rows)
    rows = [(i, "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i])) for i, t in rows]
    rows = [(i, t) for i, t in rows if t.strip() or not gone[i]]
    df = stages["line_dedup"](spark, df, folder)
    assert sorted((r["doc_id"], r["text"]) for r in df.collect()) == rows
    _, label = brute_components(rows, 5)
    rows = [(i, t) for i, t in rows if label[i] == i]
    df = stages["near_dedup"](spark, df, folder)
    assert sorted((r["doc_id"], r["text"]) for r in df.collect()) == rows
    bound = lambda x: min(int(len(x) * 0.06), max((len(x) - 10) // 10, 0))
    rows = [(i, t) for i, t in rows if all(best_edits(x, " ".join(t.split())) > bound(x) for _, x in items)]
    df = stages["decontamination"](spark, df, folder)
    assert sorted((r["doc_id"], r["text"]) for r in df.collect()) == rows
    pieces = stages["packing"](spark, df, folder).collect()
    assert {r["doc_id"] for r in pieces} == {i for i, _ in rows} and len(rows) < 80


def test_copy_with_blank_lines_goes(spark):
    rng = random.Random(10)
    text = sentence(rng, 60) + "\n\n \n" + sentence(rng, 60)
    docs = spark.createDataFrame([(i, text, "en", "s", len(text)) for i in (1, 2)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in P.lines(spark, docs, "").collect()] == [1]


def test_more_columns_and_repeated_rows(spark, tmp_path):
    """Columns of a caller that are named like working ones come through, and rows that repeat are rows of their own."""
    rng = random.Random(14)
    names = ["row", "pos", "hash", "mark", "score", "predicted", "id", "items", "component", "kept", "label", "y", "piece", "sequence_id", "offset", "into", "a", "b", "run", "removed"]
    rows = [(i, sentence(rng, 40) + ".\n" + sentence(rng, 20), "en", "s", 1, *range(len(names))) for i in range(20)]
    rows += [rows[3]] * 2 + [(None, None, None, None, None, *[None] * len(names))] * 2
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names)
    df, folder = spark.createDataFrame(rows, schema), str(tmp_path)
    spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, sentence(rng, 30))], "item_id int, text string").write.parquet(f"{folder}/benchmark.parquet")
    for name, stage in P.STAGES[1:]:
        out = stage(spark, df, folder)
        got = out.collect()
        if name == "packing":
            assert len(got) == len(rows) and sum(r["doc_id"] == 3 for r in got) == 3 and sum(r["doc_id"] is None for r in got) == 2
        else:
            assert out.columns == df.columns and len(got) == len(rows)
            assert sorted(map(tuple, got), key=str) == sorted(rows, key=str)
    assert dict(P.STAGES)["quality"](spark, df, folder).columns == df.columns
