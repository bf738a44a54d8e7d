"""Operators on texts against brute force, with nulls, empty and long texts, ties, repeated
rows, empty tables and columns with clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from zonalis.llm import core, crf, decontaminate, hashing, minhash_join, queries, suffix_tree, toxicity

DOCS = "doc_id long, text string, score double, text_ string, words string"


def docs(spark, texts, first=0):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(first + i, t, 1.5, "x", "y") for i, t in enumerate(texts)], DOCS)


def words(text):
    return (text or "").encode().lower().split()


# Hashing -------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAbZ é\n\t\x0b\x1c.9", max_size=40), max_size=8))
def test_words_are_those_between_white_space(texts):
    raw = [t.encode() for t in texts]
    data, offsets = core.flat_bytes(pa.array(raw, pa.binary()))
    h, counts, begins, ends = hashing.words(data, offsets)
    want = [w for t in raw for w in t.lower().split()]
    assert [bytes(data[a:b]).lower() for a, b in zip(begins, ends)] == want
    assert counts.tolist() == [len(t.lower().split()) for t in raw]
    known = {}
    assert all(known.setdefault(w, x) == x for w, x in zip(want, h.tolist())) and len(set(known.values())) == len(known)
    value, n = hashing.shingles(h, counts, 3)
    sets = [[tuple(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else [] for ws in (t.lower().split() for t in raw)]
    flat, known = [x for s in sets for x in s], {}
    assert n.tolist() == [len(s) for s in sets] and all(known.setdefault(x, y) == y for x, y in zip(flat, value.tolist()))


def test_words_longer_than_a_piece():
    raw = [b"x" * 600_000 + b" y", b"z" * (1 << 18), b"", b"q"]
    h, counts, *_ = hashing.words(*core.flat_bytes(pa.array(raw, pa.binary())))
    assert counts.tolist() == [2, 1, 0, 1] and len(set(h.tolist())) == 4


# Decontamination -----------------------------------------------------------------------------

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def hits(text, items, size):
    ws = WORD.findall((text or "").encode().lower())
    hit, found = [False] * len(ws), set()
    for i, t in items:
        own = WORD.findall((t or "").encode().lower())
        for a in range(max(1, len(own) - size + 1)) if own else []:
            w = own[a : a + size]
            for b in range(len(ws) - len(w) + 1):
                if ws[b : b + len(w)] == w:
                    found.add(i)
                    hit[b : b + len(w)] = [True] * len(w)
    return len(ws), sum(hit), sorted(found, key=str)


@pytest.mark.parametrize("block", [1 << 17, 3])
def test_decontamination(spark, block):
    rng = random.Random(4)
    vocabulary = ["a", "b", "c", "The", "éa"]
    texts = [" ".join(rng.choices(vocabulary, k=n)) for n in (0, 1, 2, 5, 30, 30, 60, 400)] + [None, "", "a, B! c", "a, B! c", " a " * 30_000]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in ((1, 1), (2, 2), (10, 3), (11, 4), (3, 6), (4, 9))] + [(5, None), (6, ""), (12, "A b C"), (13, "zzz"), (14, "a")]
    item = spark.createDataFrame([(i, t, "n") for i, t in items], "item_id long, text string, n_hit string")
    got = decontaminate.decontaminate(docs(spark, texts), item, size=4, block_windows=block, keep=True).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.n_hit, r["items"]) == hits(texts[r.doc_id], items, 4) if len(texts[r.doc_id] or "") < 9999 else r.n_hit > 0
        assert sum(s.end - s.start for s in r.spans) == r.n_hit and r.row.text_ == "x"


def test_decontamination_of_nothing(spark):
    item = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.decontaminate(docs(spark, ["a b"]).limit(0), item).count() == 0
    assert decontaminate.decontaminate(docs(spark, ["a b"]), item.limit(0)).first().n_hit == 0


# Near-duplicates -----------------------------------------------------------------------------


def brute_components(texts, k, over, of):
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and of * len(a & sets[j]) >= over * len(a | sets[j]):
                x, y = label[i], label[j]
                label = [min(x, y) if z in (x, y) else z for z in label]
    return label, [len(s) for s in sets]


def near_copies(seed):
    """Groups whose members are linked, linked by a chain, or just not."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=3))
    texts = [None, "", " ", "one", "One", "one two"]
    for edits in (0, 1, 2, 3, 4, 6, 8):
        base = [word() for _ in range(60)]
        for _ in range(7):
            own = base[:]
            for at in rng.sample(range(60), edits):
                own[at] = word()
            texts.append(" ".join(own))
    shared = [word() for _ in range(40)]  # a passage that many share
    texts += [" ".join(shared + [word() for _ in range(rng.choice((8, 20, 40)))]) for _ in range(25)]
    return texts + texts[10:14] + ["w " * 50_000]


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, k, monkeypatch):
    monkeypatch.setattr(minhash_join, "PART_MEMBERS", 300)  # several parts of a group
    texts = near_copies(k)
    label, size = brute_components(texts, k, 80, 100)
    got = minhash_join.near_duplicates(docs(spark, texts), shingle=k).collect()
    assert {r.doc_id: (r.component_id, r.n_shingles, r.kept) for r in got} == {i: (label[i], size[i], label[i] == i) for i in range(len(texts))}


def test_near_duplicates_without_ids_and_repeated(spark):
    text = "a b c d e f g h"
    df = spark.createDataFrame([(7, text), (7, text), (None, text), (3, text), (9, "x y")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.component_id, r.kept) for r in minhash_join.near_duplicates(df).collect()), key=str)
    assert got == sorted([(7, 3, False), (7, 3, False), (0, None, True), (3, 3, True), (9, 9, True)], key=str)
    assert minhash_join.near_duplicates(df.limit(0)).count() == 0


def test_least_hits():
    t = minhash_join.least_hits(48, 0.8)
    tail = sum(math.comb(48, i) * 0.8**i * 0.2 ** (48 - i) for i in range(t))
    assert tail < minhash_join.MISS < tail + math.comb(48, t) * 0.8**t * 0.2 ** (48 - t)


# Suffix tree ---------------------------------------------------------------------------------


def brute_scores(texts, train):
    tokens = [[*words(t), None] for t in texts]
    c, b, t3 = Counter(), Counter(), Counter()
    for i in train:
        v = tokens[i]
        c.update(v)
        b.update(zip(v, v[1:]))
        t3.update(zip(v, v[1:], v[2:]))
    n, distinct, least, off = sum(c.values()), len(c), suffix_tree.LEAST, suffix_tree.DISCOUNT

    def root(w):
        return (c[w] + 0.1) / (n + 0.1 * (distinct + 1))

    def states(moves, count, parent):
        gain, kept = Counter(), Counter()
        for k, x in moves.items():
            if x >= least:
                gain[k[:-1]] += x * math.log(x / count(k[:-1]) / parent(k))
                kept[k[:-1]] += x - off
        return {s: 1 - kept[s] / count(s) for s in gain if gain[s] >= max(suffix_tree.GAIN, suffix_tree.GAIN_SHARE * count(s))}

    one = states(b, lambda s: c[s[0]], lambda k: root(k[1]))
    two = states(t3, lambda s: b[s], lambda k: b[k[1:]] / c[k[1]])
    out = []
    for v in tokens:
        base = score = 0.0
        for i, w in enumerate(v):
            p = root(w)
            base += math.log10(p)
            for k, tree, moves, count in ((1, one, b, lambda s: c[s[0]]), (2, two, t3, lambda s: b[s])):
                s = tuple(v[i - k : i])
                if i >= k and s in tree:
                    x = moves[(*s, w)]
                    p = tree[s] * p + (max(0, x - off) / count(s) if x >= least else 0)
            score += math.log10(p)
        out.append((len(v), sum(c[w] > 0 for w in v), base, score))
    return n, len(one), len(two), out


@pytest.mark.parametrize("block", [12_000_000, 40])
def test_suffix_tree(spark, block, monkeypatch):
    monkeypatch.setattr(suffix_tree, "BLOCK_ENTRIES", block)
    monkeypatch.setattr(suffix_tree, "FLUSH_RUNS", 500)
    rng = random.Random(8)
    phrase = ["x y z u v w x z", "p q r s t p p q"]
    texts = [" ".join(rng.choices(phrase, k=12)) + " " + " ".join(rng.choices("abcdefgh", k=40)) for _ in range(30)]
    texts += [None, "", "A", "a unseen b", texts[0], texts[0], "x y " * 20_000]
    df = docs(spark, texts)
    train = [i for i in range(len(texts)) if i % 5]
    tree = suffix_tree.grow(df.where("doc_id % 5 <> 0"))
    n, one, two, want = brute_scores(texts, train)
    kinds = {r["kind"]: r["n"] for r in tree.entries.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert tree.tokens == n and kinds[1] == one and kinds.get(3, 0) == two and one and two
    got = {r.doc_id: r for r in suffix_tree.score(df, tree).collect()}
    for i, (n_tokens, known, base, score) in enumerate(want):
        assert (got[i].n_tokens, got[i].n_known) == (n_tokens, known)
        assert got[i].base_score == pytest.approx(base, rel=1e-9) and got[i].score == pytest.approx(score, rel=1e-5)


@pytest.mark.parametrize("block", [12_000_000, 60])
def test_contexts_grow_with_the_texts(spark, block, tmp_path, monkeypatch):
    monkeypatch.setattr(suffix_tree, "BLOCK_ENTRIES", block)
    rng = random.Random(5)
    # what follows "b c d" depends on the fourth word before it
    texts = [" ".join(rng.choices(["a b c d x", "e b c d y", "b c z", "c d w"], k=30)) for _ in range(40)] + ["", "a b c d x"]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op2_suffix_tree(spark, str(tmp_path)).collect()}
    tokens = [[*words(t), None] for t in texts]
    train = [v for i, v in enumerate(tokens) if zlib.crc32(str(i).encode()) % 10]
    c = Counter(tuple(v[i : i + k]) for v in train for k in range(1, 9) for i in range(len(v) - k + 1))
    n, distinct = sum(map(len, train)), sum(len(r) == 1 for r in c)
    root = lambda w: (c[(w,)] + 0.1) / (n + 0.1 * (distinct + 1))
    tree, k = {}, 0
    while k == 0 or any(len(s) == k for s in tree) or k < 2:
        k += 1
        gain, kept = Counter(), Counter()
        for r, x in c.items():
            if len(r) == k + 1 and x >= suffix_tree.LEAST:
                gain[r[:-1]] += x * math.log(x / c[r[:-1]] / (c[r[1:]] / c[r[1:-1]] if k > 1 else root(r[1])))
                kept[r[:-1]] += x - suffix_tree.DISCOUNT
        tree |= {s: 1 - kept[s] / c[s] for s in gain if gain[s] >= max(suffix_tree.GAIN, suffix_tree.GAIN_SHARE * c[s])}
    assert 4 <= max(map(len, tree)) < 7
    for i, v in enumerate(tokens):
        score = 0.0
        for j, w in enumerate(v):
            p = root(w)
            for s in (tuple(v[j - k : j]) for k in range(1, min(j, 7) + 1)):
                if s in tree:
                    x = c[(*s, w)]
                    p = tree[s] * p + ((x - suffix_tree.DISCOUNT) / c[s] if x >= suffix_tree.LEAST else 0)
            score += math.log10(p)
        assert got[i].score == pytest.approx(score, rel=1e-5)


@pytest.mark.parametrize("same", [True, False])
def test_likely_pairs_of_many_documents_at_once(same):
    rng = np.random.default_rng(3)
    doc, n, c = rng.permutation(90), rng.integers(50, 80, 90), rng.integers(0, 9, 90)
    sketch = rng.choice(rng.integers(0, 2**63, 4, dtype=np.uint64), 90) ^ (np.uint64(1) << rng.integers(0, 64, 90).astype(np.uint64))
    rows, right = (np.arange(90),) * 2 if same else (np.arange(40), np.arange(40, 90))
    got = minhash_join._likely(rows, right, doc, n, c, sketch, same, 80, 100, 1 if same else 2)
    fits = lambda i, j: c[i] != c[j] and max(n[i], n[j]) * 80 <= min(n[i], n[j]) * 100 and int(sketch[i] ^ sketch[j]).bit_count() <= (1 if same else 2) and (not same or doc[j] > doc[i])
    want = [(i, j) for i in rows for j in right if fits(i, j)]
    assert [(int(i), int(j)) for i, j in zip(*got, strict=True)] == want and want


def test_blocks_write_sums_alone(spark, monkeypatch):
    """However many blocks score the texts, none writes texts or a row for each token; rows that repeat stay rows."""
    texts = ["a b c d e f g h"] * 9 + ["h g f e d c b a"] * 9 + ["a c", None, ""]
    df = docs(spark, texts).union(docs(spark, texts[:2])).union(docs(spark, ["unseen"]))
    tree = suffix_tree.grow(df)
    rows = lambda: sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 9), round(r.score, 9)) for r in suffix_tree.score(df, tree).collect())
    whole = rows()
    staged, stage = [], suffix_tree.core.stage
    monkeypatch.setattr(suffix_tree, "BLOCK_ENTRIES", tree.n_entries // 3)
    monkeypatch.setattr(suffix_tree.core, "stage", lambda t, *a, **b: staged.append(t.dtypes) or stage(t, *a, **b))
    assert rows() == whole and len(whole) == len(texts) + 3 and len(staged) > 2
    assert not [x for x in staged if any(kind in ("binary", "string") or kind.startswith("array") for _, kind in x)]


def test_suffix_tree_of_nothing(spark):
    df = docs(spark, ["a b", None])
    tree = suffix_tree.grow(df.limit(0))
    assert tree.tokens == 0 and [r.n_known for r in suffix_tree.score(df, tree).collect()] == [0, 0]
    assert suffix_tree.score(df.limit(0), tree).count() == 0


# Toxicity ------------------------------------------------------------------------------------


def labelled(seed=0, n=400):
    rng = random.Random(seed)
    plain, bad = [f"w{i}" for i in range(300)], ["vile", "foul", "nasty"]
    texts, labels = [], []
    for _ in range(n):
        toxic = rng.random() < 0.2
        own = rng.choices(plain, k=rng.randrange(5, 60))
        if toxic:
            own[rng.randrange(len(own))] = rng.choice(bad).upper() + "!"
            own.insert(0, rng.choice(bad))
        texts.append(" ".join(own))
        labels.append(int(toxic))
    return texts, labels


def test_toxicity_on_held_out_rows(spark):
    texts, labels = labelled()
    texts += [None, "", "vile " * 30_000, texts[0]]
    df = docs(spark, texts)
    marks = spark.createDataFrame([(i, y, "z") for i, y in enumerate(labels) if zlib.crc32(str(i).encode()) % 3 != 1] + [(None, 1, "z"), (5, None, "z"), (99999, 1, "z")], "doc_id long, toxic int, text string")
    w = toxicity.train(df, marks)
    assert 0 < len(w.index) < 2000
    got = {r.doc_id: r.p for r in toxicity.score(df, w, column="p").collect()}
    held = [i for i in range(len(labels)) if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum((got[i] >= 0.7) == bool(labels[i]) for i in held)
    assert right >= 0.97 * len(held)
    assert got[len(labels)] == got[len(labels) + 1] < 0.5 < got[len(labels) + 2] and got[len(labels) + 3] == got[0]
    again = toxicity.train(df.repartition(7), marks.repartition(3))
    assert again.bias == w.bias and (again.value == w.value).all()


def test_toxicity_without_labels(spark):
    df = docs(spark, ["a", None])
    marks = spark.createDataFrame([(0, 0)], "doc_id long, toxic int")
    assert {round(r.p, 6) for r in toxicity.score(df, toxicity.train(df, marks.limit(0)), column="p").collect()} == {0.5}
    assert max(r.p for r in toxicity.score(df, toxicity.train(df, marks), column="p").collect()) < 0.01
    other = spark.createDataFrame([(77, 0), (78, 1)], "doc_id long, toxic int")
    assert toxicity.score(df, toxicity.train(df, other), column="p").count() == 2


# Language ------------------------------------------------------------------------------------


def brute_marginals(e, move):
    size, a, x = e.shape[1], np.exp(move), np.exp(e)
    alpha, beta, v = np.zeros_like(e), np.ones_like(e), np.full(e.shape[1], 1 / size)
    for t in range(len(e)):
        v = (v @ a) * x[t]
        alpha[t] = v = v / v.sum()
    for t in range(len(e) - 2, -1, -1):
        beta[t] = a @ (x[t + 1] * beta[t + 1])
        beta[t] /= beta[t].sum()
    m = alpha * beta
    return m / m.sum(1, keepdims=True)


def test_forward_backward():
    rng = np.random.default_rng(1)
    counts = np.array([3, 0, 5, 150, 1, 64, 65, 128])
    e, move = rng.normal(size=(counts.sum(), 3)) * 3, rng.normal(size=(3, 3))
    got, moved = crf.marginals(e, counts, move, True)
    at = core.starts(counts)
    for i, n in enumerate(counts):
        if n:
            assert np.allclose(got[at[i] : at[i + 1]], brute_marginals(e[at[i] : at[i + 1]], move))
    assert moved.sum() == pytest.approx(counts.sum())


def test_languages(spark):
    rng = random.Random(3)
    parts = {"aa": ["ka", "ro", "mi"], "bb": ["shu", "fte", "zza"], "cc": ["élo", "ña", "xió"]}
    text = lambda lang, n: " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(n))
    rows = [(i, text(lang, rng.randrange(3, 60)), lang, "s") for i, lang in enumerate(rng.choices(sorted(parts), k=300))]
    rows += [(1000, None, "aa", "s"), (1001, "", None, "s"), (1002, "12 34 !", "bb", "s"), (1003, text("aa", 5) + " " + text("cc", 40), None, "s"), (1004, text("bb", 30_000), None, "s"), (None, text("aa", 9), "aa", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    model = crf.train(df.where("doc_id IS NULL OR doc_id % 4 <> 2"))
    got = {r.doc_id: (r._lang_pred, r._score) for r in crf.predict(df, model, prefix="_").collect()}
    held = [r for r in rows[:300] if r[0] % 4 == 2]
    assert sum(got[r[0]][0] == r[2] for r in held) >= 0.97 * len(held)
    assert got[1000] == got[1001] == got[1002] == ("und", 0.0)
    assert got[1003][0] == "cc" and 0.6 < got[1003][1] < 1 and got[1004][0] == "bb"
    assert crf.train(df.limit(0)) is None
    assert {r._lang_pred for r in crf.predict(df, None, prefix="_").collect()} == {"und"}
    assert crf.predict(df.limit(0), model, prefix="_").count() == 0


def test_digest_of_found_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


@pytest.mark.parametrize("n,rows", [(24, 0), (24, 500), (16, 20_000), (27, 3000)])
def test_filter_lets_all_that_it_holds_pass(spark, n, rows):
    ids = spark.range(0, rows, 1, 3).select((F.xxhash64("id")).alias("id"))
    held = np.array([r.id for r in ids.collect()], np.int64)
    found = core.bloom(ids, n=n)
    assert found.n == n and found.find(held).all()
    others = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 20_000)
    expected = (1 - math.exp(-2 * rows / 2**n)) ** 2
    assert abs(found.find(others).mean() - expected) < 0.02


def test_batch_size_is_put_back(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with pytest.raises(ValueError), core.small_batches(spark, 7):
        assert spark.conf.get(key) == "7"
        raise ValueError
    assert spark.conf.get(key) == before
