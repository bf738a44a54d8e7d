"""Benchmark decontamination by a prefix-filtered set join.

Every window of an item is a set of positioned 2-word shingles (a one-word window: the
word itself). Containment of the whole window needs all of them, so the necessary
prefix is one token: its rarest shingle, rarity being the shingle's count over all
documents. Documents are joined with the windows on that token alone; a match must
leave room for the window's words before and after it (positional and length bounds)
and is then verified word by word.

The window side is joined in blocks of at most ``block_windows`` windows, each small
enough to broadcast whatever the benchmark's size; documents are never shuffled.

Defined results: a null or empty text has no words and no hits; null or empty items
have no windows; repeated rows are judged each; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import core, hashing

BLOCK_WINDOWS = 1 << 17


def windows(items: DataFrame, item_id: str = "item_id", text: str = "text", size: int = 10) -> DataFrame:
    """``(item, words)``: the distinct windows of each item, as 64-bit hashes of its words."""
    src = items.select(F.col(item_id).alias("item"), F.col(text).cast("binary").alias("text"))
    schema = T.StructType([T.StructField("item", src.schema["item"].dataType), T.StructField("words", T.BinaryType())])

    def cut(batches):
        for batch in core.slices(batches):
            h, counts, _, _ = hashing.words(*core.flat_bytes(batch.column(1)), hashing.ALNUM)
            at = core.starts(counts)
            rows, out = [], []
            for r in range(batch.num_rows):
                own = h[at[r] : at[r + 1]]
                found = {own[i : i + size].tobytes() for i in range(max(1, len(own) - size + 1))} if len(own) else ()
                rows += [r] * len(found)
                out += found
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(out, pa.binary())], ["item", "words"])

    return src.mapInArrow(cut, schema)


class _Block:
    """The windows of one block as flat arrays, found by one shingle of each."""

    def __init__(self, rows: list[tuple[bytes, list[int]]]) -> None:
        self.length = np.array([len(w) // 8 for w, _ in rows], np.int64)
        self.words = np.frombuffer(b"".join(w for w, _ in rows), np.uint64)
        self.at = core.starts(self.length)
        self.items = [i for _, i in rows]
        token, counts = hashing.shingles(self.words, self.length, 2)
        self.token, self.first = token, core.starts(counts)
        self.vocabulary = np.unique(token)

    def choose(self, seen: np.ndarray) -> None:
        """Keep each window's rarest token, by ``seen``, the counts of the vocabulary."""
        rarity = seen[np.searchsorted(self.vocabulary, self.token)]
        best = np.array([a + np.lexsort((self.token[a:b], rarity[a:b]))[0] for a, b in zip(self.first[:-1], self.first[1:], strict=True)], np.int64)
        self.offset = best - self.first[:-1]
        chosen = self.token[best]
        self.order = np.argsort(chosen, kind="stable")
        self.anchors, n = np.unique(chosen, return_counts=True)
        self.group = core.starts(n)
        self.singles = bool((self.length == 1).any())
        self.token = self.vocabulary = self.first = None


def _found(keys: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``tokens`` that are among the sorted ``keys``, and which key each is."""
    if not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    maybe = np.zeros(1 << 18, bool)
    maybe[(keys >> np.uint64(46)).astype(np.int64)] = True
    at = np.flatnonzero(maybe[(tokens >> np.uint64(46)).astype(np.int64)])
    k = np.minimum(np.searchsorted(keys, tokens[at]), len(keys) - 1)
    on = keys[k] == tokens[at]
    return at[on], k[on]


def _tokens(h: np.ndarray, counts: np.ndarray, singles: bool):
    """The 2-word shingles of all texts, each with the position of its first word; with
    ``singles`` the words alone too."""
    token, n = hashing.shingles(h, counts, 2)
    at, begin = core.starts(n), core.starts(counts)
    pos = np.arange(len(token)) + np.repeat(begin[:-1] - at[:-1], n)
    yield token, pos
    if singles and len(h):
        one, _ = hashing.shingles(h, np.ones(len(h), np.int64), 2)
        long = np.repeat(counts > 1, counts)
        yield one[long], np.flatnonzero(long)


def _match(block: _Block, h: np.ndarray, counts: np.ndarray, step: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Verified occurrences: the window, its first word's position, its text."""
    begin = core.starts(counts)
    out = []
    for token, pos in _tokens(h, counts, block.singles):
        at, key = _found(block.anchors, token)
        pos, n = pos[at], np.diff(block.group)[key]
        total = core.starts(n)
        i = 0
        while i < len(pos):
            j = max(i + 1, int(np.searchsorted(total, total[i] + step, "right")) - 1)
            row = np.repeat(np.arange(i, j), n[i:j])
            w = block.order[block.group[key[row]] + np.arange(len(row)) - np.repeat(total[i:j] - total[i], n[i:j])]
            start = pos[row] - block.offset[w]
            doc = np.searchsorted(begin, pos[row], "right") - 1
            ok = (start >= begin[doc]) & (start + block.length[w] <= begin[doc + 1])
            w, start, doc = w[ok], start[ok], doc[ok]
            for k in range(int(block.length[w].max()) if len(w) else 0):
                ok = (block.length[w] <= k) | (h[np.minimum(start + k, len(h) - 1)] == block.words[np.minimum(block.at[w] + k, len(block.words) - 1)])
                w, start, doc = w[ok], start[ok], doc[ok]
            out.append((w, start, doc))
            i = j
    if not out:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _count(docs: DataFrame, block: _Block) -> np.ndarray:
    """How often each token of the block's vocabulary occurs in all documents."""
    spark = docs.sparkSession
    keys, singles = spark.sparkContext.broadcast(block.vocabulary), bool((block.length == 1).any())

    def count(batches):
        total = np.zeros(len(keys.value), np.int64)
        for batch in core.slices(batches):
            h, counts, _, _ = hashing.words(*core.flat_bytes(batch.column(1)), hashing.ALNUM)
            for token, _ in _tokens(h, counts, singles):
                total += np.bincount(_found(keys.value, token)[1], minlength=len(total))
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(total[on])], ["token", "n"])

    got = docs.mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(len(block.vocabulary), np.int64)
    seen[got["token"].to_numpy()] = got["n"].to_numpy()
    keys.unpersist()
    return seen


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10, block_windows: int = BLOCK_WINDOWS, keep: bool = False) -> DataFrame:
    """Per document: ``doc_id, n_words, n_hit, items`` (the ids of the items with a window
    in it, distinct), ``spans`` (word ranges ``[start, end)`` that are hit) and with
    ``keep`` also ``row``, all its columns as a struct."""
    spark = docs.sparkSession
    # windows whose words are equal are one window; those of one block fit a broadcast
    cut = core.stage(windows(items, item_id, item_text, size), "windows")
    n_blocks = max(1, -(-cut.count() // block_windows))
    state = docs.select(F.col(doc_id).alias("doc"), F.col(text).cast("binary").alias("text"), *([F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text)).alias("row")] if keep else []))
    source = state.select("doc", "text")
    item_type = cut.schema["item"].dataType
    state = state.withColumns({"hit": F.lit(None).cast("binary"), "items": F.array().cast(T.ArrayType(item_type))})
    state = state.select("doc", "text", "hit", "items", *(["row"] if keep else []))
    for b in range(n_blocks):
        own = cut.where(F.pmod(F.xxhash64("words"), F.lit(n_blocks)) == b).toArrow()
        grouped = defaultdict(list)
        for i, w in zip(own["item"].to_pylist(), own["words"].to_pylist(), strict=True):
            grouped[w].append(i)
        block = _Block(sorted(grouped.items()))
        block.choose(_count(source, block))
        last = b + 1 == n_blocks
        state = _join(state, spark.sparkContext.broadcast(block), last)
        if not last:
            state = core.stage(state, "hits")
    if not keep:
        return state.select(F.col("doc").alias(doc_id), "n_words", "n_hit", "items", "spans")
    row = F.struct(*(F.col("text").cast(docs.schema[text].dataType).alias(text) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns))
    return state.select(F.col("doc").alias(doc_id), "n_words", "n_hit", "items", "spans", row.alias("row"))


_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _join(state: DataFrame, block, last: bool) -> DataFrame:
    """Adds a block's hits to ``hit``, a bit for each word, and ``items``; the last block gives
    ``n_words, n_hit, items, spans`` instead."""
    rest = [f for f in state.schema if f.name == "row"]
    kept = rest and [state.schema["text"]]
    schema = T.StructType([state.schema["doc"], T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), state.schema["items"], T.StructField("spans", _SPAN), *kept, *rest]) if last else state.schema

    def join(batches):
        for batch in core.slices(batches):
            h, counts, _, _ = hashing.words(*core.flat_bytes(batch.column(1)), hashing.ALNUM)
            begin = core.starts(counts)
            w, start, doc = _match(block.value, h, counts)
            edge = np.zeros(len(h) + 1, np.int32)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + block.value.length[w], -1)
            hit = np.cumsum(edge[:-1]) > 0
            found: dict[int, set] = defaultdict(set)
            for d, x in np.unique(np.stack([doc, w], 1), axis=0) if len(w) else ():
                found[int(d)].update(block.value.items[x])
            bits, n_hit, spans, items = [], [], [], batch.column(3).to_pylist()
            for r, before in enumerate(batch.column(2).to_pylist()):
                own = hit[begin[r] : begin[r + 1]]
                if before is not None:
                    own = own | np.unpackbits(np.frombuffer(before, np.uint8), count=len(own)).astype(bool)
                items[r] = sorted({*items[r], *found.get(r, ())}, key=str)
                if last:
                    turn = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)).tolist() if own.any() else []
                    n_hit.append(int(own.sum()))
                    spans.append([{"start": a, "end": b} for a, b in zip(turn[::2], turn[1::2], strict=True)])
                else:
                    bits.append(np.packbits(own).tobytes())
            item = pa.array(items, batch.column(3).type)
            if last:
                span = pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(n_hit, pa.int64()), item, span, *([batch.column(1)] if rest else []), *batch.columns[4:]], [f.name for f in schema])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.binary()), item, *batch.columns[4:]], batch.schema.names)

    return state.mapInArrow(join, schema)
