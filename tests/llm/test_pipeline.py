"""The corpus pipeline on a small corpus, stage by stage against brute force."""

import random

import corpus_pipeline
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from zonalis.llm import core

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
PARTS = {"aa": ["ka", "ro", "mi", "tu"], "bb": ["shu", "fte", "zza", "wo"]}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(6)
    word = lambda lang: "".join(rng.choices(PARTS[lang], k=4))
    rows, labels, toxic = [], [], set()
    for i in range(240):
        lang = rng.choice(sorted(PARTS))
        own = [word(lang) for _ in range(rng.randrange(12, 70))]
        if i % 5 == 0:
            own[3:3] = ["vilest", "foulest"]
            toxic.add(i)
        rows.append((i, " ".join(own), lang, f"s{i % 3}", 0))
        labels.append((i, 1, int(i in toxic)))
    items = [(1, " ".join(word("aa") for _ in range(14))), (2, None)]
    leaks = {300: rows[1][1] + " " + items[0][1], 301: items[0][1].upper()}
    copies = {310: rows[2][1], 311: rows[2][1].upper(), 312: rows[7][1] + " more"}
    rows += [(i, t, "aa", "s1", 0) for i, t in (leaks | copies).items()]
    rows += [(400, None, "aa", "s0", 0), (401, "", None, None, None), (402, "12 ! 34", "aa", "s0", 0), (None, " ".join(word("bb") for _ in range(30)), "bb", None, 0), (3, rows[3][1], rows[3][2], "s0", 0)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, DOCUMENTS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, toxic, leaks, copies


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_stages(spark, corpus):
    folder, rows, toxic, leaks, copies = corpus
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = core.stage(stage(spark, docs, folder), name)
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {k: [r.doc_id for r in v] for k, v in seen.items()}
    assert not toxic & set(ids["toxicity"]) and len(ids["toxicity"]) == len(rows) - len(toxic)
    assert sorted(map(str, ids["language"])) == sorted(str(i) for i in ids["toxicity"] if i not in (400, 401, 402))
    # of linked documents the smallest id stays, and those without an id
    before = {r.doc_id: shingles(r.text) for r in seen["language"] if r.doc_id is not None}
    label = {i: i for i in before}
    for i in sorted(before):
        for j in sorted(before):
            a, b = before[i], before[j]
            if i < j and 10 * len(a & b) >= 8 * len(a | b):
                x, y = sorted((label[i], label[j]))
                label = {k: x if v == y else v for k, v in label.items()}
    assert sorted(map(str, ids["near_duplicates"])) == sorted([*(str(i) for i in before if label[i] == i), "None"])
    assert not {310, 311, 312} & set(ids["near_duplicates"])
    assert sorted(map(str, ids["decontamination"])) == sorted(str(i) for i in ids["near_duplicates"] if i not in leaks)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r.doc_id: len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in seen["decontamination"]}
    got: dict = {}
    for p in seen["packing"]:
        got[p.doc_id] = got.get(p.doc_id, 0) + p.length
    assert got == want


def test_run_is_the_stages(spark, corpus):
    folder, *_ = corpus
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_empty_corpus(spark, tmp_path):
    for name, shape in (("documents", DOCUMENTS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], shape).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_names_repeats_and_long_texts(spark, tmp_path):
    rng = random.Random(2)
    word = lambda lang: "".join(rng.choices(PARTS[lang], k=4))
    text = lambda n, lang="aa": " ".join(word(lang) for _ in range(n))
    rows = [(i, text(rng.randrange(12, 60), "ab"[i % 2] * 2), "ab"[i % 2] * 2, "s", 1.0, "x", 2, "y") for i in range(60)]
    long = text(40_000)
    again = (rows[5][0], rows[5][1], "aa", "s", 0.5, "w", 2, "y")  # the text of a row again
    other = (rows[4][0], text(30), "aa", "s", 1.0, "x", 2, "y")  # another text under an id
    copy = (70, rows[4][1], "aa", "s", 1.0, "x", 2, "y")
    rows += [again, other, copy, copy, (71, long, "aa", "s", 1.0, "x", 2, "y"), (72, long + " more", "aa", "s", 1.0, "x", 2, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _score double, _lang_pred string, n_hit int, `a.b` string")
    marks = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    marks.where("doc_id < 0").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, text(12, "bb"))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = df
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = core.stage(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == df.columns
    got = sorted((r.doc_id, r.text, r._score) for r in docs.collect())
    want = {(r[0], r[1]) for r in rows if r[0] not in (70, 72)}
    assert sorted((i, x) for i, x, _ in got) == sorted(want)
    assert [s for i, _, s in got if i == 5] == [0.5]  # the first by its columns
