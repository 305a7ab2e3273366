"""The pipeline's stages on a small corpus."""

import random

import numpy as np
import pytest

import corpus_pipeline
from nearfield.llm import common, similar, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(3)
    sounds = {"aa": "aeioumnl", "bb": "krtzsch"}
    word = lambda k: "".join(rng.choice(sounds[k]) for _ in range(7))
    text = lambda k, n: "\n".join(" ".join(word(k) for _ in range(20)) for _ in range(n))
    rows = [(n, text(k, 6), k) for n, k in enumerate(["aa", "bb"] * 40)]
    items = [(1, text("aa", 1))]
    rows[4] = (4, rows[4][1] + "\n" + items[0][1] + " " + word("aa"), "aa")
    rows += [(100, rows[0][1], "aa"), (101, rows[1][1].split("\n")[0] + "\n" + text("bb", 4), "bb"), (102, None, None), (103, "12 34 !!", "aa")]
    path = str(tmp_path_factory.mktemp("corpus"))
    data = [(*r, "s", len(r[1]) if r[1] else None) for r in rows]
    spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "SimHash near-dedup", "benchmark decontamination", "packing"]
    first = corpus_pipeline.language(spark, docs, folder)
    assert first.columns == COLUMNS
    ids = {r.doc_id for r in first.collect()}
    assert ids == set(range(80)) | {100, 101}
    second = corpus_pipeline.lines(spark, first, folder)
    kept = {r.doc_id: r for r in second.collect()}
    assert second.columns == COLUMNS and 100 not in kept and len(kept[101].text.split("\n")) == 4 and kept[101].n_chars == len(kept[101].text)
    copies = docs.where("doc_id in (0, 100, 2)")
    third = corpus_pipeline.near_copies(spark, copies, folder)
    assert third.columns == COLUMNS and sorted(r.doc_id for r in third.collect()) == [0, 2]
    fourth = corpus_pipeline.benchmark(spark, second, folder)
    assert fourth.columns == COLUMNS and {r.doc_id for r in fourth.collect()} == set(kept) - {4}


def test_run(spark, folder):
    pieces = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(range(80)) - {4} | {101}


def test_empty(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_edited_copies_go(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("aeioumnl") for _ in range(7))
    rows = []
    for k in range(60):
        ws = [word() for _ in range(200)]
        copy = ws[:]
        for at in (20, 70, 120, 170):  # 20 of 196 shingles: a similarity of 0.81
            copy[at] = word()
        rows += [(3 * k, " ".join(ws)), (3 * k + 1, " ".join(copy)), (1000 + k, " ".join(ws[:100] + [word() for _ in range(100)]))]
    rows += [(5000 + k, rows[0][1]) for k in range(5)] + [(None, rows[0][1])]
    docs = spark.createDataFrame([(k, t, "aa", "s", len(t)) for k, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()}
    assert kept == {3 * k for k in range(60)} | {1000 + k for k in range(60)}  # rows without an id are rows like others


def jaccard(a, b, n=5):
    x, y = ({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_near_copies_decide_rows(spark):
    rng = random.Random(17)
    make = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    a, b, c, d = make(80), make(80), make(80), make(30)
    edited = a.split()
    edited[40] = "changed"
    texts = [(1, a), (2, a), (2, b), (3, c), (3, c), (None, d), (None, d), (9, d), (None, make(40)), (4, " ".join(edited)), (5, None), (6, ""), (None, None), (7, "two words"), (8, "Two  words"), (10, make(4))]
    texts += [(20 + k, make(60)) for k in range(20)]
    docs = spark.createDataFrame([(k, t, "x", 1, n) for n, (k, t) in enumerate(texts)], "doc_id bigint, text string, id string, `row` int, again int")
    got = corpus_pipeline.near_copies(spark, docs, "")
    assert got.columns == docs.columns
    blank = lambda t: not (t or "").split()
    order = sorted(range(len(texts)), key=lambda n: (texts[n][0] is None, texts[n][0] or 0, n))
    kept = []
    for n in order:
        t = texts[n][1]
        if not any(blank(t) and blank(o) or not blank(t) and not blank(o) and jaccard(t, o) >= 0.8 for _, o in kept):
            kept.append(texts[n])
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(kept, key=str)


def test_clashing_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name in ("_verdict", "_lines", "_out", "_long", "helper_0", "HELPER_1", "id", "doc", "key", "label", "at"):
        docs = docs.withColumn(name, docs["n_chars"])
    plain = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        got, want = stage(spark, docs, folder), stage(spark, plain, folder)
        assert got.columns == docs.columns
        assert sorted(map(str, got.select(*plain.columns).collect())) == sorted(map(str, want.collect()))


def test_short_lines_leave_no_stubs(spark):
    long = "one two three four five six seven eight nine ten"
    other = "some quite other words that make a second long line"
    chinese = "这是一个没有空格的很长的句子它有二十多个字并且不重复出现"
    texts = {
        0: f"{long}\nshort one\nend",
        1: f"{long}\nshort one\nend",  # an exact copy: nothing is left
        2: f"{long}\nunlike",  # only a short line is left
        3: f"{long}\n{chinese}",
        4: "la la\noh yes\nla la\nfin",  # never had a longer line
        5: f"{other}\n\nend\n\nnew here",
        6: f"{chinese}\n{other}\nand one more long line of words",
        7: None,
        8: "",
    }
    docs = spark.createDataFrame([(k, t, "aa", "s", len(t or "")) for k, t in texts.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, "").collect()}
    assert got == {0: texts[0], 3: chinese, 4: "la la\noh yes\nfin", 5: f"{other}\n\n\nnew here", 6: "and one more long line of words", 7: None, 8: ""}


def test_parity_bitmaps_rule_out_no_similar_pair():
    rng = np.random.default_rng(4)
    for n in (1, 20, 300, 5000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for share in (0.01, 0.1, 0.5):
            b = np.unique(np.concatenate([a[rng.random(len(a)) > share], rng.integers(0, 2**63, int(share * n)).astype(np.uint64)]))
            differing = int(sum(int(x).bit_count() for x in (similar.parity_bitmap(a) ^ similar.parity_bitmap(b)).view(np.uint64)))
            assert differing <= len(np.setxor1d(a, b))


def test_near_copies_by_simhash_beyond_the_bands(spark):
    rng = random.Random(43)
    rows = []
    for k in range(12):
        tokens = [f"w{rng.randrange(100_000)}" for _ in range(800)]
        rows.append((2 * k, " ".join(tokens)))
        tokens[400] = "changed"
        rows.append((2 * k + 1, " ".join(tokens)))
    sets = [similar.shingle_set(t) for _, t in rows]
    near = [k for k in range(12) if (simhash.of_hashes([sets[2 * k]]) ^ simhash.of_hashes([sets[2 * k + 1]])).bit_count() <= 4]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {r.doc_id for r in similar.first_rows(docs, bands=1, per_band=600).collect()}  # one band of 600 rows finds hardly any
    assert len(near) >= 6 and not kept & {2 * k + 1 for k in near}


def test_stages_let_executors_collect_their_garbage(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(corpus_pipeline, "executors_tidied", lambda s: calls.append(s))
    docs = spark.createDataFrame([(1, "some words of a text")], "doc_id bigint, text string")
    for name, stage in corpus_pipeline.STAGES:
        if name == "packing":
            assert stage(spark, docs, "").agg({"length": "sum"}).first()[0] > 5
    assert calls == [spark]
    common.executors_tidied(spark)
