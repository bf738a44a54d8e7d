"""Operators on pages, vectors, files and tokens against brute force and round trips."""

import gzip
import zlib
from collections import Counter
from urllib.parse import urlsplit

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from zonalis.llm import core, licenses, link_trust, packing, queries, subspace_join, warc
from zonalis.llm.components import components

BREAK = "\r\n\r\nWARC/1.1\r\n"


# Components ----------------------------------------------------------------------------------


def test_components(spark):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 2000 + i) for i in range(60)]
    label = {x: x for p in pairs for x in p}
    for _ in range(400):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    want = {x: y for x, y in label.items() if any(x in p and p[0] != p[1] for p in pairs)}
    df = spark.createDataFrame([*pairs, *pairs[:9], (None, 3)], "u long, v long")
    assert {r.node: r.component for r in components(df).collect()} == want
    assert components(df.limit(0)).count() == 0


# WARC ----------------------------------------------------------------------------------------

PAGES = [(1, "http://a/", None), (2, None, ""), (3, "http://b/ x\r\ny", "h" * 200), (4, "u", "h" * 200), (5, "u", "x" * 100 + BREAK + "tail"), (6, "u", "WARC/1.1\r\nabc" + "z" * 100), (7, "u", "abc\r\n\r\nWARC/1.1"), (8, "u", "end\r\n"), (9, "u", "end\r\n\r\n"), (10, "u", "end\r\n\r\n\r\n"), (11, "u", "é" * 150 + "\x00\r\r\n"), (12, "u", "Content-Transfer-Encoding: base64\r\n\r\nhi"), (14, "u", "x" * 100 + BREAK + "tail"), (15, "u", "h" * 99), (16, "u", "h" * 99), (17, "u", "long" * 200_000), (None, "u", "h" * 200), (3, "u", "h" * 200)]


@pytest.mark.parametrize("parts", [1, 4])
def test_archives_hold_every_payload(spark, parts):
    df = spark.createDataFrame([(*p, "d", "t") for p in PAGES], "page_id long, url string, html string, digest string, type string")
    path = core.new_path(spark, "warc")
    warc.write(warc.resolve(df.repartition(parts)), path)
    got = warc.read(spark, path).collect()
    assert len(got) == len(PAGES)
    full = {i: h or "" for i, _, h in PAGES}
    for r in got:
        if r.type == "response":
            assert r.payload.decode() == full[r.id] and r.refers_to is None
        else:
            assert full[r.refers_to] == full[r.id] and r.refers_to < (r.id or 99) and r.payload is None
    assert {r.id for r in got if r.type == "revisit"} == {4, 14, None}
    assert {(r.id, r.payload_bytes) for r in warc.summary(warc.read(spark, path)).collect()} == {(i, len(h.encode())) for i, h in full.items()}
    raw = b"".join(gzip.decompress(x.content) for x in spark.read.format("binaryFile").load(path + "/*.gz").collect())
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: ") and raw.endswith(b"\r\n\r\n")
    assert warc.resolve(df.limit(0)).count() == 0


# URL filters ---------------------------------------------------------------------------------


def test_rules_and_hosts(spark):
    urls = [None, "no scheme", "http://", "HTTP://A.Example.ORG", "http://example.org/es/1", "http://x.example.org/en/12?q", "http://example.org/en/2", "http://com/fr/x", "http://a.com/de/x#y", "http://a.com?x=/de/", "http://acom/de/", "ftp://ÉX.org/É", "http://a.net/://b.org/", "http://org/"]
    rules = queries.URL_RULES
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: r for r in link_trust.judge(df, rules).collect()}
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
            path = rest[end:].split("?")[0].split("#")[0]
        fit = [(len(h + p), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, max(fit)[2] if fit else None), u
        if fit:
            assert got[i].verdict == max(fit)[1]
    assert urlsplit("http://a.net/").netloc == "a.net"
    assert link_trust.judge(df.limit(0), rules).count() == 0


def test_trust_and_distrust_follow_links(spark):
    rules = [("allow", "good.net", "/"), ("block", "bad.net", "/")]
    rows = [(1, "http://good.net/a", '<a href="http://friend.net/x">'), (2, "http://bad.net/a", "<a href=/own>"), (3, "http://friend.net/", None), (4, "http://shady.net/", "<A class=x HREF='//BAD.net/z'>"), (5, "http://alone.net/", "text http://bad.net/"), (5, "http://alone.net/", "")]
    got = link_trust.judge(spark.createDataFrame([(*r, 9.0, "v") for r in rows], "page_id long, url string, html string, trust double, verdict string"), rules).collect()
    assert sorted((r.page_id, r.verdict) for r in got) == [(1, "allow"), (2, "block"), (3, "allow"), (4, "block"), (5, "allow"), (5, "allow")]
    by = {r.host: r for r in got}
    # the same by hand
    hosts = sorted(by)
    edges = {("good.net", "friend.net"), ("shady.net", "bad.net"), *((h, h) for h in hosts)}
    for kind, seed in (("trust", "good.net"), ("distrust", "bad.net")):
        walk = edges if kind == "trust" else {(b, a) for a, b in edges}
        rank = {h: float(h == seed) for h in hosts}
        for _ in range(link_trust.ROUNDS):
            rank = {h: 0.85 * sum(rank[a] / sum(x == a for x, _ in walk) for a, b in walk if b == h) + 0.15 * (h == seed) for h in hosts}
        for h in hosts:
            assert (by[h][kind] or 0.0) == pytest.approx(rank[h], abs=1e-12)


def test_too_many_rules():
    with pytest.raises(ValueError):
        link_trust.match(F.lit("a"), F.lit("b"), [("allow", "h", str(i)) for i in range(1001)])


# Packing -------------------------------------------------------------------------------------


def test_words_encode_like_whole_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = ["hello <|endoftext|> world", "a<|startoftext|>b", "<|EndOfText|>", "x <|endoftext", "|>", "", "Hello  World's é ÉCOLE 12a", " \x0b\x0cA\x1cB c d", "<|endoftext|> it's", "́ x", "日本語 テキスト", "a" * 5000, "ß ΑΣ Σ İ", "it' s don't", "\x85x y"]
    for cache in (1 << 20, 5):
        e = packing.WordEncoder(path, 2, cache)
        for _ in range(2):
            ids, n = e.encode(*core.flat_bytes(pa.array([x.encode() for x in texts], pa.binary())))
            assert ids.tolist() == [i for x in texts for i in [*t.encode(x, add_special_tokens=False).ids, 2]]
            assert n.tolist() == [len(t.encode(x, add_special_tokens=False).ids) + 1 for x in texts]


@pytest.mark.parametrize("totals,weights", [([50, 30, 20], None), ([1, 1000, 3], None), ([40, 60, 200], [5.0, 1.0, 1.0]), ([7], None), ([3, 3, 3], None)])
def test_allotment_is_the_order_of_earning(totals, weights):
    totals = np.array(totals)
    w = np.array(weights) if weights else totals / totals.sum()
    order = sorted(((k + 0.5) / w[q], q) for q in range(len(totals)) for k in range(totals[q]))
    got = packing.allotment(np.arange(totals.sum() // 8 + 2), 8, totals, w)
    for r, row in enumerate(got):
        want = Counter(q for _, q in order[: 8 * r])
        assert row.tolist() == [want.get(q, 0) for q in range(len(totals))]


def test_packing(spark):
    texts = ["the quick brown fox " * n for n in (1, 40, 900, 5, 5, 3)] + [None, "", "x " * 20_000]
    df = spark.createDataFrame([(i, t, None if i % 4 == 3 else f"s{i % 3}", "p", 5) for i, t in enumerate(texts)] + [(2, texts[2], "s2", "p", 5)], "doc_id long, text string, source string, ids string, start int")
    pieces = packing.pack(df.repartition(3), public_tokenizers.path("word_bpe_49k.json"), size=256).collect()
    by_window, by_doc = {}, {}
    for p in pieces:
        assert len(p.ids) == 4 * p.length
        by_window.setdefault(p.sequence_id, []).append(p)
        by_doc.setdefault(p.doc_id, []).append(p)
    total = sum(p.length for p in pieces)
    assert sorted(by_window) == list(range(-(-total // 256)))
    for w, own in by_window.items():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == (256 if w < len(by_window) - 1 else total - 256 * w)
    assert [p.length for p in by_doc[7]] == [1] == [p.length for p in by_doc[6]]
    assert sum(p.length for p in by_doc[2]) == 2 * by_doc[2][0].doc_tokens
    shares = Counter()
    for p in pieces:
        shares[p.source] += p.length
    for own in (by_window[w] for w in range(len(by_window) - 1)):
        here = Counter()
        for p in own:
            here[p.source] += p.length
        assert all(abs(here[s] - 256 * n / total) <= len(shares) for s, n in shares.items())
    assert packing.pack(df.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_ids_of_pieces_are_those_of_whole_texts(spark):
    import zlib

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["hello <|endoftext|> world", None, "", "Ünïcode 日本語 " * 3000, "a<|startoftext|>b " * 700, "plain words " * 2500]
    df = spark.createDataFrame([(i, x, f"s{i % 2}", 1, "y") for i, x in enumerate(texts)], "doc_id long, text string, source string, start long, ids_crc32 string")
    got = queries.packed(df.repartition(2)).collect()
    by_doc = {}
    for p in got:
        by_doc.setdefault(p.doc_id, []).append(p)
    for i, x in enumerate(texts):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        own = sorted(by_doc[i], key=lambda p: p.start)
        assert own[0].start == 0 and sum(p.length for p in own) == len(ids) == own[0].doc_tokens
        for p in own:
            part = ids[p.start : p.start + p.length]
            assert len(part) == p.length and zlib.crc32(np.array(part, "<u4").tobytes()) == p.ids_crc32


def test_packing_with_many_sources(spark, monkeypatch):
    monkeypatch.setattr(packing, "MAX_QUEUES", 3)
    df = spark.range(20).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.col("id").cast("string").alias("source"))
    got = packing.pack(df, public_tokenizers.path("word_bpe_49k.json"), size=16).collect()
    assert sum(p.length for p in got) == 80 and {p.sequence_id for p in got} == set(range(5))


def test_mixture_of_more_sources_than_a_task_holds_at_once(spark, monkeypatch):
    monkeypatch.setattr(packing, "PAIRS", 5000)
    n, size = packing.MAX_QUEUES + 76, 2048
    name = lambda i: f"host{i:04d}"
    weights = {name(i): 1.0 + 3 * (i % 2) for i in range(n)}
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a "), (F.col("id") % 5 + 8).cast("int")).alias("text"), F.format_string("host%04d", "id").alias("source"))
    got = packing.pack(df, public_tokenizers.path("word_bpe_49k.json"), size=size, weights=weights).collect()
    tokens = {p.source: p.doc_tokens for p in got}
    share = np.array([weights[name(i)] for i in range(n)])
    share = share / share.sum()
    order = [name(i) for _, i in sorted(((k + 0.5) / share[i], i) for i in range(n) for k in range(tokens[name(i)]))]
    here = {}
    for p in got:
        here.setdefault(p.sequence_id, Counter())[p.source] += p.length
    assert here == {w: Counter(order[size * w : size * (w + 1)]) for w in range(-(-len(order) // size))}


@pytest.mark.parametrize("heavy", [1.0, 900.0])
def test_allotment_of_many_queues(heavy):
    totals, w = np.full(1500, 4), np.ones(1500)
    w[7], totals[7] = heavy, 3000
    w = w / w.sum()
    order = sorted(((k + 0.5) / w[q], q) for q in range(1500) for k in range(totals[q]))
    rounds = np.arange(totals.sum() // 700 + 2)
    for r, row in zip(rounds, packing.allotment(rounds, 700, totals, w), strict=True):
        assert row.tolist() == np.bincount([q for _, q in order[: 700 * r]], minlength=1500).tolist()


def test_crc_of_ids(spark):
    p = queries.packed(spark.createDataFrame([(1, "hello", "s")], "doc_id long, text string, source string")).first()
    assert p.doc_tokens == 2 and 0 < p.ids_crc32 < 2**32 and zlib.crc32(b"") == 0


# Embeddings ----------------------------------------------------------------------------------


def test_links_of_vectors(spark, monkeypatch):
    monkeypatch.setattr(subspace_join, "PART", 40)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 20))
    x = [*base, *(base[i % 9] + rng.normal(size=20) * rng.choice([0.05, 0.2, 0.3, 0.4]) for i in range(120)), *(base[3] * s for s in (2.0, -1.0, 1e-30, 1e30)), *[base[5]] * 6]
    rows = [(i, [float(y) for y in v], 0) for i, v in enumerate(x)]
    odd = [(900, None), (901, []), (902, [0.0] * 20), (903, [float("nan")] * 20), (904, [1.0, None] + [0.0] * 18), (905, [float("inf")] * 20), (906, [float(y) for y in base[0]][:7]), (None, [float(y) for y in base[0]])]
    rows += [(i, v, 1) for i, v in odd] + [rows[4]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int")
    got = subspace_join.links(df).collect()
    assert len(got) == len(rows)
    ids = [*range(len(x)), 4]
    u = np.array([*x, x[4]])
    u = u / np.abs(u).max(1, keepdims=True)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    label = list(ids)
    for _ in range(50):
        label = [min(label[j] for j in np.flatnonzero(row)) for row in near]
    want = Counter((ids[i], int(near[i].sum()) - 1, label[i], ids[i] == label[i]) for i in range(len(ids)))
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None and r.vec_id < 900) == want
    assert all(r.n_links == 0 and r.kept for r in got if r.vec_id is None or r.vec_id >= 900)
    assert subspace_join.links(df.limit(0)).count() == 0


def test_vectors_are_shuffled_once(spark, monkeypatch):
    """However many parts there are, a vector is not sent to each of them."""
    monkeypatch.setattr(subspace_join, "PART", 100)
    x = np.random.default_rng(4).normal(size=(400, 64))
    x[1::40] = x[::40] * 3 + 0.01
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    before = written()
    got = {r.vec_id: r.component_id for r in subspace_join.links(df).collect()}
    assert got == {i: i - (i % 40 == 1) for i in range(400)}
    assert written() - before < 4 * x.nbytes


# Licences ------------------------------------------------------------------------------------


def test_licences(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [(1, "a/b/x.c", f"// {mit}\nint x;"), (2, "a/LICENSE", gpl), (3, "a/b/c/y.c", "int y;"), (4, "z.c", None), (5, "d/COPYING.txt", "nothing here"), (6, "d/q.c", ""), (7, "a/b/NOTICE", mit), (8, "a/b/k.c", "word " * 40_000 + "\n" + gpl), (9, None, mit), (10, None, "x"), (11, "a/b/c/y.c", "int y;"), (12, "ab/y.c", "x")]
    df = spark.createDataFrame([(*r, "l", 0.0) for r in rows], "file_id long, path string, text string, license string, score double")
    got = {r.file_id: (r.license, r.how, r.origin) for r in licenses.scan(df).collect()}
    assert got[1] == ("MIT", "own", "a/b/x.c") and got[2] == ("GPL-3.0", "own", "a/LICENSE") and got[7][:2] == ("MIT", "own")
    assert got[3] == got[11] == ("MIT", "inherited", "a/b/NOTICE") and got[8][:2] == ("GPL-3.0", "own")
    assert got[4] == got[5] == got[6] == got[10] == got[12] == (None, None, None) and got[9] == ("MIT", "own", None)
    assert licenses.scan(df.limit(0)).count() == 0


def test_licence_files_and_headers(spark):
    text = dict(licenses.PASSAGES)
    mit = "MIT License\n\nCopyright (c) 2024 Some Body\n\n" + text["MIT"]
    marks = "\n".join("# " + x for x in text["Apache-2.0 header"].split("\n"))
    prose = "word and another plain thing " * 60
    rows = [
        (1, "a/LICENSE", mit, "MIT"),
        (2, "b/x.py", "# Copyright 2020 The Owners\n" + marks + "\nimport os\n" + prose, "Apache-2.0"),
        (3, "c/COPYING", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n                            Preamble\n\n The rest of a long licence follows. " + prose, "GPL-3.0"),
        (4, "d/y.c", prose + " /* " + text["GPL-2.0 header"].replace(" ", "  \r\n * ") + " */ " + prose, "GPL-2.0"),
        (5, "e/z", "Permission to speak freely was granted by the chair; no warranty was given. " + prose, None),
        (6, "f/w", text["BSD-2-Clause"], "BSD-2-Clause"),
        (6, "f/w", "plain text under the same key", None),
        (None, "g/v", text["Zlib"].upper(), "Zlib"),
    ]
    got = licenses.scan(spark.createDataFrame(rows, "file_id long, path string, text string, name string")).collect()
    assert sorted((str(r.file_id), str(r.license if r.how == "own" else None)) for r in got) == sorted((str(r[0]), str(r[3])) for r in rows)
    for name, passage in licenses.PASSAGES:
        assert any(x in passage.lower() for x in licenses.SIGNALS)


def test_anchors_lose_no_match():
    m = licenses.Model()
    for v in m.vectors.values():
        assert sum(w * w for t, w in v.items() if t not in m.anchors) ** 0.5 < licenses.LEAST
