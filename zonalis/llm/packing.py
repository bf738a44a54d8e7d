"""Mixture-controlled packing of token queues into fixed windows.

Each source is a queue of its documents' tokens. A deficit round-robin fills window
after window: per window a queue earns ``window * weight`` tokens of credit, is served
what it has earned, and carries the rest (its deficit, under one token) to the next
window; an exhausted queue's share goes to the others in proportion. Serving tokens by
the time at which each is earned, (k + 1/2) / weight, makes the state before window w
a closed form of w: ``allotment``. So any task can start at any window with the exact
deficits that a sequential run would have carried there, across windows and partitions,
and no task ever holds a queue: documents are cut where their windows end.

Only the last window is padded. Default weights are the sources' shares of all tokens,
which empties every queue at the same time.

Defined results: a null text counts as empty and gives the end token alone; a null
source is a queue of its own; repeated rows are packed each; tokens earned at the same
time are served in the order of the queues' names; a text of any length is cut into
pieces like others, its ids being held by one task; other columns are ignored;
no documents give no pieces. Every source is a queue of its own, however many there are;
of more than ``MAX_QUEUES``, a task works out fewer windows at a time.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import core, hashing

#: Queues whose states before 4096 windows a task holds at once.
MAX_QUEUES = 1024
#: Pairs of a document and a window that a task looks at together.
PAIRS = 1 << 20
#: Words whose ids a worker remembers, before it begins anew.
CACHE_WORDS = 1 << 20


class WordEncoder:
    """Ids of whole texts, as the tokenizer gives them by itself, for one that never joins what
    white space separates and ignores that white space: each word is encoded once and
    remembered, with bounded memory. A text that holds one of the tokenizer's added tokens
    (in any case of its letters) is encoded whole."""

    def __init__(self, path: str, end_id: int, cache_words: int = CACHE_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = sorted({t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.end_id, self.cache_words = end_id, cache_words
        self._clear()

    def _clear(self) -> None:
        self.runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # sorted hashes, where ids begin, how many
        self.pool, self.used, self.n = np.empty(1 << 16, np.uint32), 0, 0

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        """Ids of new words; ``hashes`` are sorted."""
        counts = np.zeros(len(texts), np.int64)
        parts = []
        for a in range(0, len(texts), 2048):
            group = texts[a : a + 2048]
            done = self.tokenizer.encode(" ".join(group), add_special_tokens=False)
            ids = np.array(done.ids, np.uint32)
            begins = core.starts(np.array([len(x) + 1 for x in group]))[:-1]
            own = np.searchsorted(begins, np.array([x for x, _ in done.offsets], np.int64), "right") - 1
            counts[a : a + 2048] = np.bincount(own, minlength=len(group))
            parts.append(ids)
        flat = np.concatenate(parts)
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.empty(max(len(flat), self.used), np.uint32)])
        self.pool[self.used : self.used + len(flat)] = flat
        run = (hashes, core.starts(counts)[:-1] + self.used, counts)
        self.used += len(flat)
        self.n += len(hashes)
        while self.runs and len(self.runs[-1][0]) < 2 * len(run[0]):  # few runs, each twice the next
            joined = [np.concatenate(x) for x in zip(self.runs.pop(), run, strict=True)]
            order = np.argsort(joined[0], kind="stable")
            run = tuple(x[order] for x in joined)
        self.runs.append(run)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, n = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        left = np.arange(len(keys))
        for h, begins, counts in self.runs:
            k = np.minimum(np.searchsorted(h, keys[left]), len(h) - 1)
            on = h[k] == keys[left]
            at[left[on]], n[left[on]] = begins[k[on]], counts[k[on]]
            left = left[~on]
        return at, n

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by the end id, and how many each text has."""
        h, counts, begins, ends = hashing.words(data, offsets, fold=False)
        keys, first, which = np.unique(h, return_index=True, return_inverse=True)
        if self.n + len(keys) > self.cache_words:
            self._clear()
        at, n = self._find(keys)
        new = np.flatnonzero(at < 0)
        if len(new):
            raw = data.tobytes()
            self._learn(keys[new], [raw[begins[i] : ends[i]].decode("utf-8", "replace") for i in first[new]])
            at[new], n[new] = self._find(keys[new])
        at, n = np.append(at, self.used), np.append(n, 1)
        if self.used == len(self.pool):
            self.pool = np.append(self.pool, np.zeros(1 << 16, np.uint32))
        self.pool[self.used] = self.end_id
        which = np.insert(which, np.cumsum(counts), len(keys))
        size = n[which]
        total = core.starts(size)
        flat = self.pool[np.repeat(at[which] - total[:-1], size) + np.arange(total[-1])]
        return self._with_added(data, offsets, flat, np.diff(total[core.starts(counts + 1)]))

    def _with_added(self, data: np.ndarray, offsets: np.ndarray, flat: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids ``flat``, ``n`` of each text, but of texts with added tokens those of the whole text."""
        low = data.tobytes().lower()
        if not any(x in low for x in self.added):
            return flat, n
        parts = np.split(flat, np.cumsum(n)[:-1])
        for r in range(len(n)):
            a, b = offsets[r], offsets[r + 1]
            if any(low.find(x, a, b) >= 0 for x in self.added):
                parts[r] = np.array([*self.tokenizer.encode(data[a:b].tobytes().decode("utf-8", "replace"), add_special_tokens=False).ids, self.end_id], flat.dtype)
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)


@lru_cache(1)
def _encoder(path: str, end_id: int) -> WordEncoder:
    return WordEncoder(path, end_id)


def encode(docs: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc, queue, part, base, ids``: the ids of each document (little-endian unsigned
    16-bit, or 32-bit if the vocabulary needs them) and how many ids of its queue the same
    task has met before."""
    src = docs.select(F.col(doc_id).alias("doc"), F.col(source).cast("string").alias("queue"), F.col(text).cast("binary").alias("text"))
    schema = T.StructType([src.schema["doc"], src.schema["queue"], T.StructField("part", T.IntegerType()), T.StructField("base", T.LongType()), T.StructField("n", T.LongType()), T.StructField("wide", T.BooleanType()), T.StructField("ids", T.BinaryType())])

    def run(batches):
        part, met = TaskContext.get().partitionId(), {}
        for batch in core.slices(batches):
            ids, n = _encoder(tokenizer, end_id).encode(*core.flat_bytes(batch.column(2)))
            base = np.zeros(len(n), np.int64)
            for r, (q, k) in enumerate(zip(batch.column(1).to_pylist(), n.tolist(), strict=True)):
                base[r] = met.get(q, 0)
                met[q] = met.get(q, 0) + k
            wide = bool(len(ids) and ids.max() > 0xFFFF)
            flat = core.binary_column(ids.astype("<u4" if wide else "<u2"), n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(len(n), part, np.int32)), pa.array(base), pa.array(n), pa.array(np.full(len(n), wide)), flat], [f.name for f in schema])

    return src.mapInArrow(run, schema)


def marks(totals: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The times at which queues are exhausted, from 0, and how many tokens all have earned by then."""
    ends = totals / weights
    order = np.argsort(ends, kind="stable")
    at = np.concatenate([[0.0], ends[order]])
    done = core.starts(totals[order])
    left = np.append(np.cumsum(weights[order][::-1])[::-1], 0.0)
    return at, np.maximum.accumulate(done + at * left)


def allotment(rounds: np.ndarray, size: int, totals: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Tokens that each queue has given before each window: a row for each of ``rounds``.

    They are the ``size * round`` tokens that are earned first; token k of a queue is
    earned at (k + 1/2) / weight, ties in the order of the queues.
    """
    want = np.minimum(np.asarray(rounds, np.int64) * size, totals.sum())
    at, given = marks(totals, weights)
    time = np.interp(want.astype(float), given, at)

    def earned(time: np.ndarray) -> np.ndarray:
        return np.minimum(totals, np.floor(time[:, None] * weights + 0.5).astype(np.int64))

    c = earned(time)
    row = np.arange(len(want))

    def upcoming() -> np.ndarray:
        return np.where(c < totals, (c + 0.5) / weights, np.inf)

    def latest() -> np.ndarray:
        return np.where(c > 0, (c - 0.5) / weights, -np.inf)

    def last_of(x: np.ndarray) -> np.ndarray:
        return x.shape[1] - 1 - np.argmax(x[:, ::-1], 1)

    if (np.abs(want - c.sum(1)) > 16).any():  # many queues round alike: halve the time's bounds till few tokens are between them
        low, high = np.zeros(len(want)), np.full(len(want), at[-1])
        for _ in range(64):
            mid = (low + high) / 2
            under = earned(mid).sum(1) <= want
            low, high = np.where(under, mid, low), np.where(under, high, mid)
        c = earned(low)
        first = np.argsort(upcoming(), 1, kind="stable")
        lack = np.minimum(want - c.sum(1), (c < totals).sum(1))
        some = np.arange(len(totals)) < lack[:, None]
        c[np.nonzero(some)[0], first[some]] += 1
    while (lack := want - c.sum(1)).any():
        more, less = lack > 0, lack < 0
        c[row[more], np.argmin(upcoming()[more], 1)] += 1
        c[row[less], last_of(latest()[less])] -= 1
    while True:
        i, j = np.argmin(upcoming(), 1), last_of(latest())
        a, b = upcoming()[row, i], latest()[row, j]
        swap = (a < b) | ((a == b) & (i < j))
        if not swap.any():
            return c
        c[row[swap], i[swap]] += 1
        c[row[swap], j[swap]] -= 1


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = 4096, weights: dict[str | None, float] | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Pieces: ``doc_id, source, start, length, doc_tokens, sequence_id, offset, ids``
    (little-endian unsigned 32-bit).

    ``weights``: target proportions by source (those that it lacks get the smallest of
    them); None: the sources' shares of all tokens.
    """
    spark = docs.sparkSession
    ids = core.stage(encode(docs, tokenizer, end_id, doc_id, text, source), "ids")
    by_part = ids.groupBy("part", "queue").agg(F.sum("n").alias("n"))
    by_queue = by_part.groupBy("queue").agg(F.sum("n").alias("n"))
    tops = sorted(((r.queue, r.n) for r in by_queue.collect()), key=lambda r: (r[0] is not None, r[0] or ""))
    names, totals = [q for q, _ in tops], np.array([n for _, n in tops], np.int64)
    share = totals / max(1, totals.sum())
    if weights:
        share = np.array([weights.get(q) or min(x for x in weights.values() if x > 0) for q in names], float)
        share = share / share.sum()
    # where each task's tokens of a queue begin: one row a task and source
    w = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_part.select("part", "queue", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    if (n_rows := before.count()) <= 200_000:  # under 10 MB
        before = F.broadcast(before)
    order = {q: i for i, q in enumerate(names)}
    joined = ids.alias("i").join(before.alias("b"), (F.col("i.part") == F.col("b.part")) & F.col("i.queue").eqNullSafe(F.col("b.queue")))
    joined = joined.select("i.doc", "i.queue", (F.col("b.before") + F.col("i.base")).alias("at"), "i.n", "i.wide", "i.ids")
    state = spark.sparkContext.broadcast((order, totals, share))
    schema = T.StructType([T.StructField(doc_id, ids.schema["doc"].dataType), T.StructField("source", T.StringType()), *(T.StructField(x, T.LongType()) for x in ("start", "length", "doc_tokens", "sequence_id", "offset")), T.StructField("ids", T.BinaryType())])
    del n_rows

    def cut(batches):
        order, totals, share = state.value
        step = max(1, 4096 * MAX_QUEUES // max(1, len(totals)))

        def states(window: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, ...]:
            """What queue ``q`` has given before and after a window, and where its tokens begin there."""
            keys, which = np.unique(window, return_inverse=True)
            by = np.argsort(which, kind="stable")
            out = tuple(np.empty(len(q), np.int64) for _ in range(3))
            for i in range(0, len(keys), step):
                known, nexts = (allotment(keys[i : i + step] + k, size, totals, share) for k in (0, 1))
                some = by[slice(*np.searchsorted(which[by], (i, i + step)))]
                at = which[some] - i, q[some]
                for x, y in zip(out, (known, nexts, np.cumsum(nexts - known, 1) - (nexts - known)), strict=True):
                    x[some] = y[at]
            return out

        for batch in core.slices(batches, "ids", 2 << 20):
            q = np.array([order[x] for x in batch.column(1).to_pylist()], np.int64)
            at, n = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            data, offsets = core.flat_bytes(batch.column(5))
            wide = batch.column(4).to_numpy(zero_copy_only=False)
            # the windows that may hold each document: those about its share of time, widened till they do
            ends, given = marks(totals, share)
            guess = lambda k: np.interp(k / share[q], ends, given)
            lo = np.maximum(0, (guess(at) - len(totals)) // size - 1).astype(np.int64)
            hi = ((guess(at + n) + len(totals)) // size + 1).astype(np.int64)
            span = hi - lo + 2
            turn = core.starts(span)[:-1] // PAIRS
            for own in np.split(np.arange(len(n)), np.flatnonzero(np.diff(turn)) + 1):
                row = np.repeat(own, span[own])
                window = np.arange(len(row)) - np.repeat(core.starts(span[own])[:-1] - lo[own], span[own])
                a, b, o = states(window, q[row])
                begin, end = np.maximum(a, at[row]), np.minimum(b, at[row] + n[row])
                on = end > begin
                row, window, begin, end, a, o = row[on], window[on], begin[on], end[on], a[on], o[on]
                start, length = begin - at[row], end - begin
                narrow = 2 + 2 * wide[row].astype(np.int64)
                raw = [(data[x : x + m * k].view("<u2" if k == 2 else "<u4")).astype("<u4").tobytes() for x, m, k in zip((offsets[row] + start * narrow).tolist(), length.tolist(), narrow.tolist(), strict=True)]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(start), pa.array(length), pa.array(n[row]), pa.array(window), pa.array(o + begin - a), pa.array(raw, pa.binary())], [f.name for f in schema])

    return joined.mapInArrow(cut, schema)
