"""op11, op12, op13: brute-force versions, the library, round trips, and odd rows and tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from strandloom.llm import byte_bpe, resample
from strandloom.llm.byte_bpe import decoded, encoded
from strandloom.llm.crc import crcs, shifted
from strandloom.llm.fill_middle import fill_in_middle, restore
from strandloom.llm.perfect_hash import PerfectHash, padded
from strandloom.llm.ragged import byte_slices
from strandloom.llm.resample import importance_ranks

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, rank int, score string, ids string, n int, form string, output string, bucket int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RNG = random.Random(11)
TEXTS = [
    None, "", " ", "\n", "One two", "a's ''s 's it's we'll'll 'REALLY' 're", "x  y \n\n z \t", "Été À la PLAGE 日本語 ﷽ 😀😀", "\x00nul\x0bvt\x1c fs\x85nel ls",
    "has <P> in it", "has <S>", "<M>", "<P", "a<P b<S c<M d<P e<S f<M", "<<<PPP>>> <S <M", "word " * 4000, "long" * 3000, "ab" * 70, "12 345 6789 ½²",
    *("".join(RNG.choice(["alpha", "Beta", "gamma", " ", "  ", "\n", "é", "'s", "!", "7", "Ж", "x"]) for _ in range(RNG.randint(0, 200))) for _ in range(150)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rest = ("x", "y", 1, "f", "o", 2)
    rows = [(i, t, 1, *rest) for i, t in enumerate(TEXTS)] + [(4, "One two", 1, *rest), (5, "other text", 1, *rest), (None, "no id " * 30, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_crc_algebra():
    data = np.frombuffer(RNG.randbytes(70_000), np.uint8)
    start = np.array([RNG.randrange(60_000) for _ in range(500)])
    end = start + np.array([RNG.choice([0, 1, 5, 63, 64, 65, 130, 9000]) for _ in start])
    code = crcs(data, start, end)
    raw = [data[a:b].tobytes() for a, b in zip(start, end, strict=True)]
    assert code.tolist() == [zlib.crc32(r) for r in raw]
    joined = shifted(code, (end - start)[::-1]) ^ code[::-1]
    assert joined.tolist() == [zlib.crc32(a + b) for a, b in zip(raw, raw[::-1], strict=True)]


def brute_ranks(rows, target, buckets, share, least):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    grams = lambda w: [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    codes = lambda t: [zlib.crc32(g.encode()) % buckets for g in grams(words(t))]
    s, t = Counter(c for _, x in rows for c in codes(x)), Counter(c for x in target for c in codes(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for i, x in rows:
        own = codes(x)
        weight = sum(math.floor(1000 * math.log((t[c] + 1) * (all_s + buckets) / ((s[c] + 1) * (all_t + buckets)))) for c in own)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words(x)), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    drawn = {id(r): n for n, r in enumerate(able[: len(able) * share[0] // share[1]], 1)}
    return sorted((tuple([*r, drawn.get(id(r))]) for r in out), key=str)


@pytest.mark.parametrize(("buckets", "share"), [(10_000, (5, 100)), (97, (2, 3))])
def test_importance_ranks_against_brute_force(spark, docs, buckets, share):
    target = ["alpha beta gamma", None, "", "word word", "Beta ALPHA xx"]
    table = spark.createDataFrame([(t, 1) for t in target], "text string, weight int")
    got = importance_ranks(docs, table, buckets=buckets, share=share, min_words=5).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted((tuple(r) for r in got), key=str) == brute_ranks(rows, target, buckets, share, 5)


def test_very_long_texts_in_pieces(monkeypatch):
    texts = pa.array(["", "alpha beta  gamma " * 400, "x" * 3000 + " y z " + "é" * 500, "short one"])

    def sums():
        total = Counter()
        for first, _, of_word, owner, found in resample._features(texts, 3, 1000):
            total.update((first + o, b) for o, b in zip(owner.tolist(), found.tolist(), strict=True))
            total.update((first + o, "word") for o in of_word.tolist())
        return total

    whole = sums()
    monkeypatch.setattr(resample, "byte_slices", lambda t, size: byte_slices(t, 100))
    monkeypatch.setattr(resample.pieces, "__defaults__", (100,))
    assert sums() == whole


def test_resample_keeps_columns(docs):
    some = docs.filter("doc_id > 18")
    ranks = importance_ranks(some, docs.limit(3), share=(1, 10)).filter("rank IS NOT NULL").collect()
    drawn = resample.resample(some, docs.limit(3), share=(1, 10))
    assert ranks and drawn.columns == docs.columns and {r["doc_id"] for r in drawn.collect()} == {r["doc_id"] for r in ranks}


def test_perfect_hash():
    keys = list({RNG.randbytes(RNG.randint(1, 40)) for _ in range(5000)})
    table = PerfectHash(keys)
    assert sorted(table.key_of.tolist()) == list(range(len(keys)))
    asked = keys + [RNG.randbytes(RNG.randint(1, 60)) for _ in range(2000)]
    sizes = np.array(list(map(len, asked)))
    found = table.find(padded(b"".join(asked), table.longest), np.cumsum(sizes) - sizes, sizes)
    where = {k: i for i, k in enumerate(keys)}
    assert found.tolist() == [where.get(a, -1) for a in asked]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load(RANKS).rank, special_tokens={})


def test_byte_bpe_is_the_librarys(docs, library):
    both = decoded(encoded(docs, RANKS), RANKS)
    assert both.columns == ["doc_id", "ids", "bytes"]
    got = sorted(((r["doc_id"], list(r["ids"]), bytes(r["bytes"])) for r in both.collect()), key=str)
    want = sorted(((r["doc_id"], library.encode_ordinary(r["text"] or ""), (r["text"] or "").encode()) for r in docs.collect()), key=str)
    assert got == want


def test_every_character(library):
    own = byte_bpe.load(RANKS)
    points = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x20000, 3), 0x323AF, 0xE0100, 0x10FFFF]]
    texts = [f"a{c}a1{c}1 {c}!{c}'{c}" for c in points]
    raw = [t.encode() for t in texts]
    counts, ids = own.encode(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum(list(map(len, raw)))])
    want = library.encode_ordinary_batch(texts, num_threads=1)
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


def test_heaps_in_step_and_alone_agree():
    own = byte_bpe.load(RANKS)
    words = ["".join(RNG.choice("aeiourstn é日") for _ in range(RNG.randint(1, 21))).encode() for _ in range(3000)] + [b"a" * 64, b"ab" * 32]
    sizes = np.array(list(map(len, words)))
    counts, ids = own.merge_many(np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes, sizes)
    assert [list(x) for x in np.split(ids, np.cumsum(counts)[:-1])] == [own.merge(w) for w in words]


def test_decoding_of_other_columns(spark):
    rows = spark.createDataFrame([(1, [64, 65], "a"), (2, [], "b"), (3, None, "c")], "id int, ids array<int>, bytes string")
    got = {r["id"]: r["bytes"] for r in decoded(rows, RANKS).collect()}
    assert got == {1: byte_bpe.load(RANKS).decode(np.array([64, 65])).tobytes(), 2: b"", 3: None}


TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_middle(doc_id, text, plain, spm):
    text = text or ""
    units = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= plain:
        return doc_id, len(units), "plain", None, None, text, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


@pytest.mark.parametrize(("plain", "spm"), [(50, 80), (100, 50), (100, 0), (0, 0)])
def test_fill_in_middle_against_brute_force(docs, plain, spm):
    made = fill_in_middle(docs, returns=("output", "restored", "output_sha256", "restored_sha256"), plain_percent=plain, spm_percent=spm)
    got = sorted((tuple(r)[:7] for r in made.collect()), key=str)
    assert got == sorted((brute_middle(r["doc_id"], r["text"], plain, spm) for r in docs.collect()), key=str)
    for r in made.collect():
        assert r["output_sha256"] == hashlib.sha256(r["output"].encode()).hexdigest() and r["restored_sha256"] == hashlib.sha256(r["restored"].encode()).hexdigest()


def test_restore(docs):
    made = fill_in_middle(docs, plain_percent=100)
    got = sorted((tuple(r) for r in restore(made).collect()), key=str)
    assert got == sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=str)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert importance_ranks(none, none).count() == 0
    assert decoded(encoded(none, RANKS), RANKS).count() == 0
    assert fill_in_middle(none).count() == 0
    one = spark.createDataFrame([(1, "a b c " * 20)], "doc_id long, text string")
    assert importance_ranks(one, none, share=(1, 1)).first()["rank"] == 1
