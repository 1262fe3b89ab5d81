"""Operator 2. Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded; gated attention,

    a_i = softmax_i( w . (tanh(V h_i) * sigmoid(U h_i)) ),

weighs the encodings, and a logistic unit scores the weighted sum. Encoder, attention and output
are learned together from document labels alone, by Adam on the driver, over a bounded sample: ``SAMPLE`` documents of a
class, and of each at most ``BAG`` passages, evenly spread. All passages of every document are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloomlm import held_out
from .common import pieces, text_array
from .rules import SYMBOLS, duplicate_mask, labelled_sample, sigmoid
from .vectext import BLOCK, Words, mix, span_counts

#: Words of a passage, hashed n-gram buckets of its features, size of an encoding and of the attention.
PASSAGE, BUCKETS, HIDDEN, ATTENTION = 64, 96, 24, 12
#: Labelled documents of each class that are learned from, passages of each of them (so the driver gets 2 * SAMPLE * BAG vectors
#: at most, 11 MB), passes over them, and the least score of a good document.
SAMPLE, BAG, STEPS, THRESHOLD = 1500, 16, 250, 0.3

_BYTE = np.arange(256)
CLASSES = [
    (_BYTE >= 65) & (_BYTE <= 90), (_BYTE >= 97) & (_BYTE <= 122), (_BYTE >= 48) & (_BYTE <= 57), SYMBOLS, (_BYTE == 33) | (_BYTE == 63), (_BYTE == 46) | (_BYTE == 44),
    _BYTE == 10, _BYTE == 32, _BYTE >= 128, _BYTE == 124,
]
SHAPE = np.zeros(256, np.int64)
for _k, _c in enumerate(CLASSES):
    SHAPE[_c] = _k + 1
N_SHAPE = len(CLASSES) + 1
N_FEATURES = N_SHAPE + 8 + BUCKETS


def passages(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, len + 1 offsets of each text's passages). A text has a passage at least; without words it is empty."""
    m = len(w.text_off) - 1
    count = np.maximum(1, -(-w.counts // PASSAGE))
    off = np.concatenate([[0], np.cumsum(count)])
    total = int(off[-1])
    owner = w.owners()
    n = len(owner)
    inside = np.arange(n) - w.off[owner] if n else np.zeros(0, np.int64)
    place = off[owner] + inside // PASSAGE
    start = np.empty(total + 1, np.int64)
    start[off[:-1]] = w.text_off[:-1]
    later = np.flatnonzero((inside % PASSAGE == 0) & (inside > 0))
    start[place[later]] = w.starts[later]
    start[-1] = len(w.raw)
    shape, grams = np.zeros((total, N_SHAPE)), np.zeros((total, BUCKETS))
    for a in range(0, len(w.raw), BLOCK):
        b = min(a + BLOCK, len(w.raw))
        p, q = int(np.searchsorted(start, a, "right")) - 1, int(np.searchsorted(start, b))
        here = np.repeat(np.arange(q - p), np.diff(np.clip(start[p : q + 1], a, b)))
        shape[p:q] += np.bincount(here * N_SHAPE + SHAPE[w.raw[a:b]], minlength=(q - p) * N_SHAPE).reshape(-1, N_SHAPE)
        code = byte_pairs(w.raw[a : b + 1])
        grams[p:q] += np.bincount(here[: len(code)] * BUCKETS + code, minlength=(q - p) * BUCKETS).reshape(-1, BUCKETS)
    size = np.maximum(np.diff(start), 1)[:, None]
    words = np.bincount(place, minlength=total)
    per = np.maximum(words, 1)
    per_word = lambda v: np.bincount(place, weights=v, minlength=total) / per
    h = w.hashes(lower=False)
    same = np.zeros(n, bool)
    same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    again = duplicate_mask(place, h, False)
    covered = np.zeros(n, bool)
    if n >= 3:
        at = np.flatnonzero(owner[2:] == owner[:-2])
        tri = mix(mix(mix(h[:-2]) + h[1:-1]) + h[2:])[at]
        hit = at[duplicate_mask(owner[at], tri, True)]
        for k in range(3):
            covered[hit + k] = True
    length = (w.ends - w.starts).astype(float)
    mark = SYMBOLS[w.raw[w.ends - 1]] if n else np.zeros(0, bool)
    bang = (w.raw[w.ends - 1] == 33) if n else np.zeros(0, bool)
    caps = (span_counts(CLASSES[0][w.raw], w.starts, w.ends) > 1) & (span_counts(CLASSES[1][w.raw], w.starts, w.ends) == 0)
    each = (same, again, covered, mark, bang, caps)
    stats = [per_word(x.astype(float)) for x in each] + [per_word(length) / 10, words / PASSAGE]
    x = np.concatenate([np.sqrt(shape / size), np.stack(stats, axis=1), np.sqrt(grams / size)], axis=1)
    return x.astype(np.float32), off


def byte_pairs(raw: np.ndarray) -> np.ndarray:
    """Bucket of each byte but the last with the one behind it."""
    x = raw.astype(np.uint32)
    x = x[:-1] | x[1:] << np.uint32(8)
    return ((x * np.uint32(0x9E3779B1)) >> np.uint32(9)) % np.uint32(BUCKETS)


def softmax_weights(score: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Attention of each passage within its text."""
    top = np.repeat(np.maximum.reduceat(score, off[:-1]), np.diff(off))
    e = np.exp(score - top)
    return e / np.repeat(np.add.reduceat(e, off[:-1]), np.diff(off))


class Net:
    """Parameters and passes of the gated attention model."""

    NAMES = ("W", "b", "V", "U", "w", "c", "d")

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        s = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"W": s(N_FEATURES, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": s(HIDDEN, ATTENTION), "U": s(HIDDEN, ATTENTION), "w": s(ATTENTION), "c": s(HIDDEN), "d": np.zeros(1, np.float32)}
        self.mean, self.scale = np.zeros(N_FEATURES, np.float32), np.ones(N_FEATURES, np.float32)

    def forward(self, x: np.ndarray, off: np.ndarray) -> tuple:
        p = self.p
        x = np.clip((x - self.mean) * self.scale, -6, 6)
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), sigmoid(h @ p["U"]).astype(np.float32)
        a = softmax_weights((t * g) @ p["w"], off)
        z = np.add.reduceat(h * a[:, None], off[:-1])
        return x, h, t, g, a, z, z @ p["c"] + p["d"][0]

    def scores(self, x: np.ndarray, off: np.ndarray) -> np.ndarray:
        return sigmoid(self.forward(x, off)[-1].astype(np.float64))

    def gradients(self, x: np.ndarray, off: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, size = self.p, np.diff(off)
        x, h, t, g, a, z, logit = self.forward(x, off)
        err = ((sigmoid(logit) - y) * weight).astype(np.float32)
        dz = np.repeat(err[:, None] * p["c"], size, axis=0)
        da = (dz * h).sum(axis=1)
        ds = a * (da - np.repeat(np.add.reduceat(a * da, off[:-1]), size))
        dtg = ds[:, None] * p["w"]
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh = (dz * a[:, None] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ ds, "c": z.T @ err, "d": err.sum(keepdims=True)}

    def fit(self, x: np.ndarray, off: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = STEPS, rate: float = 0.02, penalty: float = 1e-4) -> Net:
        self.mean, self.scale = x.mean(0), 1 / np.maximum(x.std(0), 1e-3)
        one, two = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        weight = weight / weight.sum()
        for step in range(1, steps + 1):
            for k, g in self.gradients(x, off, y, weight).items():
                g = g + penalty * self.p[k]
                one[k] = 0.9 * one[k] + 0.1 * g
                two[k] = 0.99 * two[k] + 0.01 * g * g
                self.p[k] = self.p[k] - (rate * min(1.0, 2 * (1 - step / (steps + 1))) * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


def learn(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE, folds: int = 5, fold: int = 0, steps: int = STEPS, bag: int = BAG) -> Net | float:
    """The model, learned from at most ``per_class`` labelled documents of each class outside the fold, and at most ``bag``
    passages of each; with one class or none, its smoothed share as constant score.

    Only texts and labels.quality are read. The bound of what meets on the driver is ``2 * per_class * bag`` vectors,
    however long the texts are (a doc_id that repeats gives all its rows).
    """
    inside = held_out(labels.select("doc_id", "quality"), folds, fold).where(~F.col("held_out"))
    sample, known = labelled_sample(docs, inside, per_class)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            x, off = passages(Words(text_array(piece.column(1))))
            x = x.astype(np.float16)
            kept = [x[spread(a, b, bag)].tobytes() for a, b in zip(off, off[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), pa.array(kept, pa.binary())], ["doc_id", "label", "x"])

    vectors = sample.select("doc_id", "text", "label").mapInArrow(bags, "doc_id long, label int, x binary")
    rows = vectors.toArrow().sort_by([("doc_id", "ascending"), ("x", "ascending")])
    y = rows.column("label").to_numpy().astype(np.float64)
    n1, n0 = known.get(1, 0), known.get(0, 0)
    if len(set(y)) < 2:
        return float((n1 + 1) / (n1 + n0 + 2))
    each = [np.frombuffer(b.as_py(), np.float16).reshape(-1, N_FEATURES) for b in rows.column("x")]
    off = np.concatenate([[0], np.cumsum([len(e) for e in each])])
    weight = np.where(y == 1, n1 / (y == 1).sum(), n0 / (y == 0).sum())
    return Net().fit(np.concatenate(each).astype(np.float32), off, y, weight, steps)


def spread(a: int, b: int, most: int) -> np.ndarray:
    """At most ``most`` of the places a..b-1, evenly spread."""
    return np.arange(a, b) if b - a <= most else a + np.arange(most) * (b - a) // most


def scorer(model: Net | float):
    """Arrow column of texts without nulls -> scores."""
    if isinstance(model, float):
        return lambda col: np.full(len(col), model)
    return lambda col: model.scores(*passages(Words(col)))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, threshold: float = THRESHOLD, **options) -> DataFrame:
    """doc_id, held_out boolean, score double, predicted int of every document.

    Null and empty texts are one empty passage; null doc_ids and repeated rows pass through row by row; labels that are null,
    contradictory or of unknown documents teach nothing; other columns are ignored; an empty table gives no rows. Map-only but
    for the bounded sample; the model of some 20 kB is broadcast. Memory of a worker: some 150 bytes a word of the longest text.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, folds=folds, fold=fold, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(model.value)
        for piece in pieces(batches):
            s = score(text_array(piece.column(1))).astype(np.float64)
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int")
    return held_out(scored, folds, fold).select("doc_id", "held_out", "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`classify` predicts as good; scored in place, with no join."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(model.value)
        for piece in pieces(batches):
            good = score(text_array(piece.column(piece.schema.get_field_index("text")))) >= threshold
            yield piece.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
