"""Language identification by a linear-chain conditional random field over words.

Each word (letters, digits and all non-ASCII, A-Z lower-cased) of a text is labelled
with a language, so code-switched text is labelled part by part. Emissions are linear
in hashed features: the word itself (a learned lexicon), its prefixes and suffixes of 1
to 4 bytes, and the means over its byte 2- and 3-grams. Transitions between the labels
are learned with them. Training maximises the likelihood of the documents' languages by
Adagrad over at most ``sample`` labelled rows, chosen by a hash of their id, which
stream through one task; chains are cut there into pieces of ``PIECE`` words.

Prediction labels every word of every whole text by exact forward-backward. All pieces
of a batch are multiplied in step, then joined text by text, so a text of any length
takes few numpy steps. A text's language is the label with the largest expected number
of words; its score is that label's share.

Defined results: a text that is null, empty or without a letter is ``und`` with score 0,
as is any text if nothing can be learned; null languages, texts and ids teach nothing;
ties go to the first language by name; repeated rows are predicted each; other columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import core, hashing

BITS, SAMPLE, EPOCHS, PIECE, RATE = 18, 800, 2, 64, 0.4
#: Text bytes that are labelled at a time, or one text.
SLICE_BYTES = 1 << 20
#: Words of a training step.
STEP_WORDS = 8192
_NONE = 1 << BITS
MAX_LANGUAGES = 512


@dataclass
class Model:
    """``emit``: a row of label weights for each feature and, at the end, zeros."""

    labels: list[str]
    emit: np.ndarray
    move: np.ndarray


def _slot(x: np.ndarray, kind: int) -> np.ndarray:
    return (hashing.mix(x + np.uint64(kind)) >> np.uint64(64 - BITS)).astype(np.int64)


class _Words:
    """Features of distinct words, of which the n-grams count by their mean."""

    def __init__(self, data: np.ndarray, h: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> None:
        n = ends - begins
        whole = [_slot(h, 1)]
        whole += [np.where(n >= k, _slot(p, 10 + k), _NONE) for k, p in hashing.prefixes(data, begins, ends, range(1, 5))]
        acc = np.full(len(n), np.uint64(11))
        for k in range(1, 5):
            acc = acc * np.uint64(0xD6E8FEB86659FD93) + hashing.value_of(data[np.maximum(ends - k, 0)])
            whole.append(np.where(n >= k, _slot(acc, 20 + k), _NONE))
        self.whole = np.stack(whole, 1)
        self.at = core.starts(n)
        at = np.repeat(begins - self.at[:-1], n) + np.arange(self.at[-1])
        v = hashing.value_of(data[at])
        left = np.repeat(ends, n) - at
        two = v[:-1] * np.uint64(0xA24BAED4963EE407) + v[1:]
        three = two[:-1] * np.uint64(0xA24BAED4963EE407) + v[2:]
        self.grams = np.full((2, len(v)), _NONE, np.int64)
        if len(v) > 1:
            self.grams[0, :-1] = np.where(left[:-1] > 1, _slot(two, 2), _NONE)
        if len(v) > 2:
            self.grams[1, :-2] = np.where(left[:-2] > 2, _slot(three, 3), _NONE)
        self.share = 1.0 / n

    def take(self, keys: np.ndarray) -> _Words:
        """Some of the words."""
        own = object.__new__(_Words)
        n = np.diff(self.at)[keys]
        own.at = core.starts(n)
        own.whole, own.share = self.whole[keys], self.share[keys]
        own.grams = self.grams[:, np.repeat(self.at[keys] - own.at[:-1], n) + np.arange(own.at[-1])]
        return own

    def scores(self, emit: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.whole), emit.shape[1]))
        for column in self.whole.T:
            out += emit[column]
        for grams in self.grams:
            out += np.add.reduceat(emit[grams], self.at[:-1]) * self.share[:, None]
        return out

    def gradient(self, g: np.ndarray) -> np.ndarray:
        """Of the features, from that of the words' scores."""
        rows = [*self.whole.T, *self.grams]
        word = np.repeat(np.arange(len(g)), np.diff(self.at))
        out = np.zeros((_NONE + 1, g.shape[1]))
        for k in range(g.shape[1]):
            small = (g[:, k] * self.share)[word]
            for i, row in enumerate(rows):
                out[:, k] += np.bincount(row, g[:, k] if i < len(self.whole.T) else small, minlength=_NONE + 1)
        out[_NONE] = 0
        return out


def _split(data: np.ndarray, offsets: np.ndarray) -> tuple[_Words | None, np.ndarray, np.ndarray]:
    """The distinct words, each position's word, and the words of each text."""
    h, counts, begins, ends = hashing.words(data, offsets, hashing.ALNUM)
    if not len(h):
        return None, np.empty(0, np.int64), counts
    keys, first, which = np.unique(h, return_index=True, return_inverse=True)
    return _Words(data, keys, begins[first], ends[first]), which, counts


def marginals(emission: np.ndarray, counts: np.ndarray, move: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Each word's label probabilities, of chains with ``counts`` words each, and with
    ``pairs`` the expected number of transitions between labels, all by forward-backward.

    Before a chain's first word all labels are equally likely.
    """
    size, n_words = emission.shape[1], len(emission)
    a = np.exp(move - move.max())
    e = np.exp(emission - emission.max(1, keepdims=True))
    pieces = -(-counts // PIECE)
    first = core.starts(pieces)
    chain = np.repeat(np.arange(len(counts)), pieces)
    rank = np.arange(first[-1]) - first[chain]
    begin = core.starts(counts)[chain] + rank * PIECE
    length = np.minimum(PIECE, core.starts(counts)[chain + 1] - begin)
    steps = int(length.max()) if len(length) else 0
    e = np.concatenate([e, np.ones((1, size))])
    at = [np.where(length > t, begin + t, n_words) for t in range(steps)]
    # what a piece does to the message that enters it
    product = np.broadcast_to(np.eye(size), (len(begin), size, size)).copy()
    for t in range(steps):
        new = (product.reshape(-1, size) @ a).reshape(product.shape) * e[at[t]][:, None, :]
        on = length > t
        product[on] = new[on] / new[on].max((1, 2), keepdims=True)
    forward = np.full((len(begin), size), 1.0 / size)
    backward = np.ones((len(begin), size))
    order = np.argsort(-pieces, kind="stable")
    longest = int(pieces.max()) if len(pieces) else 0
    alive = np.searchsorted(-pieces[order], -np.arange(1, longest + 1), "right")
    for r in range(longest - 1):
        p = first[order[: alive[r + 1]]] + r
        m = np.einsum("ni,nij->nj", forward[p], product[p])
        forward[p + 1] = m / m.sum(1, keepdims=True)
    for r in range(longest - 1, 0, -1):
        p = first[order[: alive[r]]] + r
        m = np.einsum("nij,nj->ni", product[p], backward[p])
        backward[p - 1] = m / m.sum(1, keepdims=True)
    # within the pieces
    seen = np.empty((steps + 1, len(begin), size))
    seen[0] = forward
    for t in range(steps):
        m = (seen[t] @ a) * e[at[t]]
        seen[t + 1] = m / m.sum(1, keepdims=True)
    out = np.empty((n_words + 1, size))
    moved = np.zeros((size, size)) if pairs else None
    beta = backward
    for t in range(steps - 1, -1, -1):
        on = length > t
        m = seen[t + 1] * beta
        out[at[t]] = m / m.sum(1, keepdims=True)
        if pairs:
            x, y = seen[t][on], (e[at[t]] * beta)[on]
            z = ((x @ a) * y).sum(1)
            moved += (x / z[:, None]).T @ y * a
        new = (e[at[t]] * beta) @ a.T
        beta = np.where(on[:, None], new / new.sum(1, keepdims=True), beta)
    return out[:n_words], moved


class _Trainer:
    def __init__(self, labels: list[str]) -> None:
        n = len(labels)
        self.model = Model(labels, np.zeros((_NONE + 1, n), np.float32), np.zeros((n, n)))
        self.square, self.square_move = np.full((_NONE + 1, n), 1e-2, np.float32), np.full((n, n), 1.0)

    def step(self, words: _Words, which: np.ndarray, counts: np.ndarray, label: np.ndarray) -> None:
        m, n = self.model, len(self.model.labels)
        p, moved = marginals(words.scores(m.emit)[which], counts, m.move, True)
        y = np.repeat(label, counts)
        p[np.arange(len(p)), y] -= 1
        g = np.stack([np.bincount(which, p[:, k], minlength=len(words.whole)) for k in range(n)], 1) / len(p)
        grad = words.gradient(g)
        on = np.flatnonzero(grad.any(1))
        self.square[on] += grad[on] ** 2
        m.emit[on] -= RATE * grad[on] / np.sqrt(self.square[on])
        # every word but a chain's first follows one of its own label; the first follows any
        want = np.diag(np.bincount(label, np.maximum(counts - 1, 0), minlength=n)) + np.bincount(label, (counts > 0).astype(float), minlength=n) / n
        move = (moved - want) / len(p)
        self.square_move += move**2
        m.move -= RATE * move / np.sqrt(self.square_move)


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model | None:
    """A model of the languages of the rows with text and language; None without any."""
    src = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(doc_id).isNotNull())
    # ids and labels first, so that only the chosen rows' texts move
    chosen = core.stage(src.select(F.col(doc_id).alias("id"), F.xxhash64(doc_id).alias("at"), F.col(lang).alias("lang")).orderBy("at", "id", "lang").limit(sample), "sample")
    labels = [r.lang for r in chosen.select("lang").distinct().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()]
    if len(labels) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not labels:
        return None
    names = {x: i for i, x in enumerate(labels)}
    rows = src.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).cast("binary").alias("text")).join(F.broadcast(chosen.select("id", "at").distinct()), "id")
    rows = core.stage(rows.select("at", "lang", "text"), "sample")
    turns = rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(EPOCHS)))).withColumn("turn", F.xxhash64("at", "epoch"))

    def learn(batches):
        trainer = _Trainer(labels)
        held: list[tuple[bytes, int]] = []

        def step() -> None:
            words, which, counts = _split(*core.flat_bytes(pa.array([x for x, _ in held], pa.binary())))
            if words is None:
                return
            pieces = -(-counts // PIECE)
            label = np.repeat(np.array([y for _, y in held]), pieces)
            first = core.starts(pieces)
            cut = np.full(first[-1], PIECE)
            some = counts > 0
            cut[first[1:][some] - 1] = (counts - (pieces - 1) * PIECE)[some]
            ends = core.starts(cut)
            for a in range(0, len(cut), STEP_WORDS // PIECE):
                b = min(len(cut), a + STEP_WORDS // PIECE)
                part = which[ends[a] : ends[b]]
                keys, own = np.unique(part, return_inverse=True)
                trainer.step(words.take(keys), own, cut[a:b], label[a:b])

        size = 0
        for batch in core.slices(batches):
            for name, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((x, names[name]))
                size += len(x)
                if size > 8 * STEP_WORDS:
                    step()
                    held.clear()
                    size = 0
        step()
        m = trainer.model
        core.release()
        on = np.flatnonzero(m.emit.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(on, np.arange(-len(labels), 0))), pa.array([*(m.emit[on].astype(np.float64)), *m.move], pa.list_(pa.float64()))], ["feature", "weights"])

    got = turns.repartition(1).sortWithinPartitions("epoch", "turn", "at", "lang", "text").select("lang", "text").mapInArrow(learn, "feature long, weights array<double>").toArrow()
    feature = got["feature"].to_numpy()
    weights = np.array(got["weights"].to_pylist(), float).reshape(len(feature), len(labels))
    emit = np.zeros((_NONE + 1, len(labels)), np.float32)
    emit[feature[feature >= 0]] = weights[feature >= 0]
    return Model(labels, emit, weights[feature < 0])


def predict(docs: DataFrame, model: Model | None, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` and the columns ``lang_pred`` and ``score``, their names after ``prefix``."""
    names = docs.columns
    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    at_text = names.index(text)
    src = core.plain(docs.select("*", letter.alias(f"{prefix}letter")))
    schema = core.plain(docs).select("*").schema.add("lang_pred", "string").add("score", "double")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        core.release()
        for batch in core.slices(batches, f"c{at_text}", SLICE_BYTES):
            n = batch.num_rows
            label, score = ["und"] * n, np.zeros(n)
            words, which, counts = _split(*core.flat_bytes(batch.column(at_text))) if m else (None, None, None)
            if words is not None:
                p, _ = marginals(words.scores(m.emit)[which], counts, m.move)
                row = np.repeat(np.arange(n), counts)
                mass = np.stack([np.bincount(row, p[:, k], minlength=n) for k in range(p.shape[1])], 1)
                best = mass.argmax(1)
                for i in np.flatnonzero(batch.column(len(names)).to_numpy(zero_copy_only=False) & (counts > 0)):
                    label[i], score[i] = m.labels[best[i]], min(1.0, mass[i, best[i]] / counts[i])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(label, pa.string()), pa.array(score)], schema.names)

    return src.mapInArrow(run, schema).toDF(*names, f"{prefix}lang_pred", f"{prefix}score")
