"""Operator 6. Quality rules: a calibrated hashed n-gram logistic regression beside fixed rules.

Word n-grams (1 to 3 words) and character n-grams (2 and 3 code points) are hashed to buckets; a text's features are the square
roots of its shares of each bucket. A logistic regression is fitted to a bounded sample of labelled rows, Platt-calibrated on
folds it did not see, broadcast (a few hundred kB) and applied in Arrow batches against a fixed threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, text_array
from .vectext import U, Words, code_points, mix, owners, runs, span_hashes, sums

#: Buckets for word and for character n-grams; labelled rows of each class that are learned from; least probability kept.
WORD_BUCKETS, CHAR_BUCKETS, SAMPLE, KEEP = 1024, 1024, 1500, 0.5
#: Lengths of the n-grams, in words and in code points.
WORD_ORDERS, CHAR_ORDERS = (1, 2, 3), (2, 3)
#: Words whose buckets are counted at once.
STEP = 1 << 18
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def duplicate_mask(owner: np.ndarray, hashes: np.ndarray, first_too: bool) -> np.ndarray:
    """Which entries equal another entry (``first_too``) or an earlier one of the same owner."""
    key = mix(owner.astype(U)) ^ hashes
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), bool)
    out[order[1:]] = same
    if first_too:
        out[order[:-1]] |= same
    return out


def base_counts(col: pa.Array, words: Words | None = None) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text of a column without nulls."""
    w = words or Words(col)
    raw, off = w.raw, w.text_off
    chars = ~w.sep & ((raw & 0xC0) != 0x80)
    hashed, owner = w.hashes(lower=False), w.owners()
    n = len(hashed)
    covered = np.zeros(n, bool)
    if n >= 3:
        inside = owner[2:] == owner[:-2]
        tri = mix(mix(mix(hashed[:-2]) + hashed[1:-1]) + hashed[2:])
        at = np.flatnonzero(inside)
        again = at[duplicate_mask(owner[at], tri[at], True)]
        for k in range(3):
            covered[again + k] = True
    a, b, line_off = runs(raw != 10, off)
    line_owner = owners(line_off)
    held = np.searchsorted(w.starts, b) > np.searchsorted(w.starts, a)  # a word starts in the line
    a, b, line_owner = a[held], b[held], line_owner[held]
    dup = duplicate_mask(line_owner, span_hashes(raw, a, b), False)
    m = len(col)
    return {
        "n_words": w.counts, "word_chars": sums(chars.astype(np.int64), off), "n_symbols": sums(SYMBOLS[raw].astype(np.int64), off),
        "n_dup_lines": np.bincount(line_owner[dup], minlength=m), "n_repeat_words": sums(covered.astype(np.int64), w.off),
    }


def word_buckets(hashes: np.ndarray) -> np.ndarray:
    """Bucket of the n-gram of words with these hashes (n-grams x n)."""
    h = hashes[:, 0]
    for k in range(1, hashes.shape[1]):
        h = mix(h * U(0x9FB21C651E98DF25) + hashes[:, k])
    return ((h >> U(40)) % U(WORD_BUCKETS)).astype(np.int64)


def char_buckets(points: np.ndarray) -> np.ndarray:
    """Bucket of the n-gram of these code points (n-grams x n, unsigned 32-bit)."""
    h = np.full(len(points), points.shape[1], np.uint32)
    for k in range(points.shape[1]):
        h = (h ^ points[:, k]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return ((h >> np.uint32(7)) % np.uint32(CHAR_BUCKETS)).astype(np.int64)


def _windows(x: np.ndarray, n: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, n) if len(x) >= n else np.zeros((0, n), x.dtype)


def features(w: Words) -> np.ndarray:
    """Square roots of bucket shares, texts x buckets: word n-grams of all orders share one half, character n-grams the
    other. No n-gram crosses texts; a text without n-grams of a kind is all zeros there."""
    m = len(w.text_off) - 1
    words, chars = (np.zeros(m * size, np.float32) for size in (WORD_BUCKETS, CHAR_BUCKETS))
    h, owner = w.hashes(lower=False), w.owners()
    more = max(WORD_ORDERS) - 1
    for a in range(0, len(h), STEP):
        own, some = owner[a : a + STEP + more], h[a : a + STEP + more]
        for n in WORD_ORDERS:
            last = min(STEP, len(some) - n + 1)
            ok = np.flatnonzero(own[:last] == own[n - 1 : n - 1 + last]) if last > 0 else np.zeros(0, np.int64)
            words += np.bincount(own[ok] * WORD_BUCKETS + word_buckets(_windows(some, n)[ok]), minlength=len(words))
    for points, own, mine in code_points(w.raw, w.text_off, max(CHAR_ORDERS) - 1):
        for n in CHAR_ORDERS:
            last = min(mine, len(points) - n + 1)
            ok = np.flatnonzero(own[:last] == own[n - 1 : n - 1 + last]) if last > 0 else np.zeros(0, np.int64)
            chars += np.bincount(own[ok] * CHAR_BUCKETS + char_buckets(_windows(points, n)[ok]), minlength=len(chars))
    halves = [x.reshape(m, -1) for x in (words, chars)]
    return np.sqrt(np.concatenate([x / np.maximum(x.sum(axis=1, keepdims=True), 1) for x in halves], axis=1))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-4, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated full-batch gradient descent on the penalised log loss."""
    coef, bias = np.zeros(x.shape[1], np.float32), 0.0
    look, look_bias, rate, t = coef.copy(), bias, 4.0, 1.0
    total = weight.sum()
    for _ in range(steps):
        err = (sigmoid(x @ look + look_bias) - y) * weight / total
        new, new_bias = look - rate * (x.T @ err.astype(np.float32) + penalty * look), look_bias - rate * float(err.sum())
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, look_bias = new + (t - 1) / t2 * (new - coef), new_bias + (t - 1) / t2 * (new_bias - bias)
        coef, bias, t = new, new_bias, t2
    return coef, bias


def platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """a, b of sigmoid(a * margin + b), by Newton steps with a small ridge and smoothed targets."""
    pos, neg = (weight * y).sum(), (weight * (1 - y)).sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * margin + b)
        g = np.array([((p - target) * weight * margin).sum() + 1e-3 * (a - 1), ((p - target) * weight).sum()])
        r = np.maximum(p * (1 - p), 1e-6) * weight
        h = np.array([[(r * margin**2).sum() + 1e-3, (r * margin).sum()], [(r * margin).sum(), r.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a - step[0], b - step[1]
    return max(float(a), 1e-3), float(b)


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, label) of at most ``per_class`` labelled documents a class, those with the smallest hash of
    doc_id, and each class's full count.

    Labels that are null, neither 0 nor 1, of unknown documents or that contradict each other are left out; repeated equal
    labels count once; without labels the sample is empty. A chosen doc_id that repeats gives all its rows. Null texts stay
    null. Only doc_id, text and quality are read, whatever other columns are called.
    """
    quality = F.col("quality")
    by_id = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(quality).alias("label"), F.max(quality).alias("other"))
    sure = F.col("doc_id").isNotNull() & (F.col("label") == F.col("other")) & F.col("label").isin(0, 1)
    by_id = by_id.where(sure).select("doc_id", F.col("label").cast("int").alias("label"))
    here = by_id.join(docs.select(F.col("doc_id").cast("long")).distinct(), "doc_id", "left_semi")
    known = dict(map(tuple, here.groupBy("label").count().collect()))
    order = F.xxhash64("doc_id")
    picked = [r for c in (0, 1) for r in here.where(F.col("label") == c).orderBy(order, "doc_id").limit(per_class).collect()]
    # bounded by 2 * per_class ids
    chosen = docs.sparkSession.createDataFrame(picked, "doc_id long, label int")
    return docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id"), known


def learn(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> tuple[np.ndarray, float]:
    """What the driver gets is a vector of fixed length for each row of the sample (12 MB in all). Calibrated weights and bias: sigmoid(x @ weights + bias) is the probability of label 1.

    With one class or none, there is nothing to tell apart: weights 0, and the class's smoothed share as bias.
    """
    sample, known = labelled_sample(docs, labels, per_class)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            x = features(Words(text_array(piece.column(1)))).astype(np.float16)
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "label", "x"])

    rows = sample.select("doc_id", "text", "label").mapInArrow(vectors, "doc_id long, label int, x binary").toArrow().sort_by("doc_id")
    y = rows.column("label").to_numpy().astype(np.float64)
    size = WORD_BUCKETS + CHAR_BUCKETS
    if len(set(y)) < 2:
        n1, n0 = known.get(1, 0), known.get(0, 0)
        return np.zeros(size, np.float32), float(np.log((n1 + 1) / (n0 + 1)))
    x = np.stack([np.frombuffer(b.as_py(), np.float16) for b in rows.column("x")]).astype(np.float32)
    # the sample is balanced by class; weights give the classes their true shares when calibrating
    even = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    true = np.where(y == 1, known[1] / (y == 1).sum(), known[0] / (y == 0).sum())
    fold = np.arange(len(y)) % 4
    margin = np.zeros(len(y))
    for k in range(4):
        own = fold != k
        if len(set(y[own])) < 2:
            continue
        coef, bias = fit_logistic(x[own], y[own], even[own])
        margin[~own] = x[~own] @ coef + bias
    a, b = platt(margin, y, true)
    coef, bias = fit_logistic(x, y, even)
    return (a * coef).astype(np.float32), float(a * bias + b)


def probabilities(w: Words, coef: np.ndarray, bias: float) -> np.ndarray:
    return sigmoid(features(w) @ coef + bias)


def judge(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words long, base_failed, kept boolean, probability double.

    base_failed: under 50 words, or over half of the words in repeated 3-word windows. kept: not base_failed, and the
    probability of good quality is at least ``keep``. Null texts are empty; null doc_ids and repeated rows pass through row by row;
    other columns are ignored; an empty table gives no rows. Lines and words are told apart by the 64-bit hashes of
    :mod:`vectext`. Map-only but for the sample of at most 2 * ``per_class`` labelled rows. Memory of a worker: some
    60 bytes a word and 10 a byte of the longest text.
    """
    sc = docs.sparkSession.sparkContext
    model = sc.broadcast(learn(docs, labels, per_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coef, bias = model.value
        for piece in pieces(batches):
            w = Words(text_array(piece.column(1)))
            got = base_counts(piece.column(1), w)
            failed = (got["n_words"] < 50) | (100 * got["n_repeat_words"] > 50 * got["n_words"])
            p = probabilities(w, coef, bias)
            cols = [piece.column(0), *(pa.array(got[k].astype(np.int64)) for k in got), pa.array(failed), pa.array(~failed & (p >= keep)), pa.array(p.astype(np.float64))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", *got, "base_failed", "kept", "probability"])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
