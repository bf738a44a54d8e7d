"""Toxicity by FTRL-proximal logistic regression over hashed word features.

Features of a text, each counted once: its words (letters and digits, A-Z lower-cased),
their leading 4 to 8 bytes, 2-grams, and skip-grams over one or two words, hashed to
``2**BITS`` coordinates. Training is online FTRL-proximal with per-coordinate rates, over
at most ``sample`` labelled rows that are chosen by a hash of their id, ``epochs`` times
in a hashed order; rows stream through one task, which holds the coordinates alone. The
L1 strength grows with the epochs, so that a feature of a single text stays at zero;
what remains is a table of a few thousand weights, small enough to broadcast: at most
``MAX_WEIGHTS``, checked. Every whole text is scored, of any length.

Defined results: a null or empty text scores by the bias alone; without labelled rows
of both kinds every score is the share of toxic ones (0.5 without any rows); labels
that differ for an id count as toxic; null ids, null labels and labels without a
document teach nothing; rows whose place in the hashed order is the same are taken in the
order of their features; repeated rows are scored each; a very long text is hashed as a
whole by one task (about 100 bytes a word); other columns, whatever their names, are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import core, hashing

BITS = 22
SAMPLE = 8000
#: Steps that a small sample is repeated to fill, within 2 to 20 epochs.
STEPS = 16000
MAX_WEIGHTS = 1 << 20
ALPHA, BETA, L1_PER_EPOCH, L2, BATCH = 1.0, 1.0, 3.0, 0.1, 16
PREFIXES = range(4, 9)
SKIPS = (1, 2, 3)


@dataclass(frozen=True)
class Weights:
    """``bias`` and the non-zero coordinates, sorted."""

    bias: float
    index: np.ndarray
    value: np.ndarray


def _features(data: np.ndarray, offsets: np.ndarray):
    """Arrays of (coordinate, text) for all features of all texts, repeats included."""
    h, counts, begins, ends = hashing.words(data, offsets, hashing.ALNUM)
    row = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    shift = np.uint64(64 - BITS)
    yield (h >> shift).astype(np.int32), row
    for n, prefix in hashing.prefixes(data, begins, ends, PREFIXES):
        on = ends - begins > n
        yield (prefix[on] >> shift).astype(np.int32), row[on]
    for gap in SKIPS:
        same = row[gap:] == row[:-gap]
        pair = hashing.mix(h[:-gap] * np.uint64(0x9E3779B97F4A7C15) + h[gap:] + np.uint64(min(gap, 2)))
        yield (pair[same] >> shift).astype(np.int32), row[gap:][same]


def _distinct(index: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique((row.astype(np.int64) << BITS) | index)
    return (key & ((1 << BITS) - 1)).astype(np.int32), (key >> BITS).astype(np.int64)


class Ftrl:
    """Per-coordinate FTRL-proximal state of a logistic regression on 0/1 features."""

    def __init__(self, l1: float) -> None:
        self.l1 = l1
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        self.zb = self.nb = 0.0

    def _weight(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def _bias(self) -> float:
        return -self.zb / ((BETA + self.nb**0.5) / ALPHA)

    def step(self, features: list[np.ndarray], labels: np.ndarray) -> None:
        row = np.repeat(np.arange(len(features)), [len(f) for f in features])
        keys, which = np.unique(np.concatenate(features), return_inverse=True)
        z, n, bias = self.z[keys], self.n[keys], self._bias()
        w = self._weight(z, n)
        s = np.bincount(row, w[which], minlength=len(features)) + bias
        g = 1 / (1 + np.exp(-np.clip(s, -35, 35))) - labels
        up, up2 = np.bincount(which, g[row], minlength=len(keys)), np.bincount(which, (g * g)[row], minlength=len(keys))
        self.z[keys] = z + up - (np.sqrt(n + up2) - np.sqrt(n)) / ALPHA * w
        self.n[keys] = n + up2
        sq = float((g * g).sum())
        self.zb, self.nb = self.zb + float(g.sum()) - ((self.nb + sq) ** 0.5 - self.nb**0.5) / ALPHA * bias, self.nb + sq

    def weights(self) -> Weights:
        w = self._weight(self.z, self.n)
        index = np.flatnonzero(w)
        return Weights(self._bias(), index, w[index])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Weights:
    """Weights from labelled rows: ``labels(doc_id, label)``; ids that repeat in ``docs`` teach each."""
    marked = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("doc")).agg(F.max((F.col(label) > 0).cast("int")).alias("y"))
    chosen = core.stage(marked.withColumn("at", F.xxhash64("doc")).orderBy("at", "doc").limit(sample), "sample")
    n, bad = chosen.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    empty = np.empty(0, np.int64)
    if not 0 < bad < n:
        share = min(max(bad / n, 1e-6), 1 - 1e-6) if n else 0.5
        return Weights(float(np.log(share / (1 - share))), empty, empty.astype(float))
    epochs = max(2, min(20, STEPS // n))
    src = docs.select(F.col(doc_id).alias("doc"), F.col(text).cast("binary").alias("text")).join(F.broadcast(chosen), "doc").select("at", "y", "text")

    def featurise(batches):
        for batch in core.slices(batches, limit=core.SLICE_BYTES // 4):
            parts = list(_features(*core.flat_bytes(batch.column(2))))
            index, row = _distinct(np.concatenate([i for i, _ in parts]), np.concatenate([r for _, r in parts]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), core.binary_column(index, np.bincount(row, minlength=batch.num_rows))], ["at", "y", "features"])

    rows = core.stage(src.mapInArrow(featurise, "at long, y int, features binary"), "features")
    turns = rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs)))).withColumn("turn", F.xxhash64("at", "epoch"))

    def learn(batches):
        model = Ftrl(L1_PER_EPOCH * epochs)
        held: tuple[list, list] = ([], [])
        for batch in batches:
            for y, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[0].append(np.frombuffer(f, np.int32))
                held[1].append(y)
                if len(held[0]) == BATCH:
                    model.step(held[0], np.array(held[1], float))
                    held = ([], [])
        if held[0]:
            model.step(held[0], np.array(held[1], float))
        core.release()
        if model.nb:
            w = model.weights()
            yield pa.RecordBatch.from_arrays([pa.array(np.append(w.index, -1)), pa.array(np.append(w.value, w.bias))], ["index", "value"])

    one = turns.repartition(1).sortWithinPartitions("epoch", "turn", "at", "features").select("y", "features")
    got = one.mapInArrow(learn, "index long, value double").toArrow()
    index, value = got["index"].to_numpy(), got["value"].to_numpy()
    if len(index) == 0:  # labels, but of none of the documents
        return Weights(0.0, empty, empty.astype(float))
    if len(index) > MAX_WEIGHTS:
        raise ValueError(f"{len(index)} weights are more than the {MAX_WEIGHTS} that are broadcast")
    on = index >= 0
    return Weights(float(value[~on][0]), index[on], value[on])


def score(docs: DataFrame, weights: Weights, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` and, as a further column, the chance that a whole text is toxic."""
    model = docs.sparkSession.sparkContext.broadcast(weights)
    names = docs.columns
    at_text = names.index(text)
    src = core.plain(docs)
    schema = src.select("*").schema.add("score", "double")

    def run(batches):
        w = model.value
        dense = np.zeros(1 << BITS, np.float32)
        dense[w.index] = w.value
        for batch in core.slices(batches, f"c{at_text}", core.SLICE_BYTES // 2):
            hit, at = [], []
            for index, row in _features(*core.flat_bytes(batch.column(at_text))):
                on = np.flatnonzero(dense[index])
                hit.append(index[on])
                at.append(row[on])
            index, row = _distinct(np.concatenate(hit), np.concatenate(at))
            s = np.bincount(row, dense[index], minlength=batch.num_rows) + w.bias
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(s, -35, 35))))], schema.names)

    return src.mapInArrow(run, schema).toDF(*names, column)
