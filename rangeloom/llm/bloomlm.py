"""Operator 4. Language-model scoring from a log-frequency Bloom filter.

A filter holds quantised n-gram counts: an n-gram of count c is entered together with
every level 1 .. 1 + floor(log_b(c / MIN_COUNT)); its count is read back by probing level after level
until one is absent. With h the ``ORDER`` - 1 words before w (a text begins behind marks of its start), the model is

    P(w | h) = (c(h w) + mu * P1(w)) / (c(h) + mu),   P1(w) = (c(w) + 1) / (N + V + 1),

that is the n-gram where it is known and the word's own frequency where it is not. Everything is counted, over all training texts;
as is usual for long n-grams, one that occurs once in the whole corpus says no more than its words do and is not entered, which
leaves a tenth of them. So a passage that the corpus repeats stands out from one that it holds once.

The log of the score is a sum of terms that each depend on entries keyed by one word: c(h w) and c(w)
by w, c(h) by its last word. So the vocabulary is dealt to regions by a word's hash; a region holds its words,
the n-grams that end in them, their filter and their exact counts (which also give the unigram base
score). Within a region, entries are dealt over cells, n-grams by a hash of all their words, so that the many n-grams that end in one frequent
word make no cell larger than others. Groups of regions of bounded size are broadcast, one a pass. Filters grow with the corpus and
need more passes, never a larger broadcast: then the texts are read and hashed once, their probes are dealt to the passes, each pass reads
its own, and a row's score is the sum of its parts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, new_folder, pieces, table, text_array
from .vectext import U, Words, buffers, mix, sums

#: Words of an n-gram; step of the quantised counts; filter bits for each entry and level; bits set for each; smoothing mass; occurrences from
#: which an n-gram is entered.
ORDER, LOG_BASE, BITS, PROBES, MU, MIN_COUNT = 4, 1.5, 16, 6, 2.0, 2
#: Bytes broadcast at once; binary digits of the number of regions at most, and of cells in a region.
PASS_BYTES, REGION_BITS, CELL_BITS = 192 << 20, 13, 4
END = mix(np.array([0xE0D], U))[0]
BOS = mix(np.array([0xB05], U))[0]
WORDS, HISTORIES, GRAMS = KINDS = (0, 1, 2)
#: Bits of an n-gram's hash; its region is that of its last word.
GRAM_BITS = 48
#: Distinct n-grams that a task holds before it passes counts on.
HELD = 2_500_000


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, history, n-gram, offsets) of each text's words and its end token, as hashes: ``history`` is of the ORDER - 1 words that
    end here, ``n-gram`` of the ORDER words that end here, both below 2**GRAM_BITS."""
    words = Words(col)
    off = words.off + np.arange(len(col) + 1)
    seq = np.empty(off[-1], U)
    ends = off[1:] - 1
    seq[ends] = END
    inner = np.ones(off[-1], bool)
    inner[ends] = False
    seq[inner] = words.hashes(lower=True)
    got, acc = {}, seq
    shifted = seq
    for n in range(2, ORDER + 1):
        shifted = np.concatenate([shifted[:1], shifted[:-1]])
        shifted[off[:-1]] = BOS
        acc = mix(acc * U(0x9FB21C651E98DF25) + shifted)
        got[n] = acc >> U(64 - GRAM_BITS)
    return seq, got[ORDER - 1], got[ORDER], off


def keys_of(word: np.ndarray, gram: np.ndarray, bits: int) -> np.ndarray:
    """Filter keys of histories or n-grams: the region of the last word, then the hash."""
    return (word >> U(64 - bits)) << U(GRAM_BITS) | gram


def cells(keys: np.ndarray, kind: int, bits: int) -> np.ndarray:
    """The cell of each word or n-gram key: its region, then for words the next bits (so cells ascend with words), for n-grams the
    lowest, which depend on all their words."""
    if kind == WORDS:
        return (keys >> U(64 - bits - CELL_BITS)).astype(np.int64)
    return (keys >> U(GRAM_BITS)).astype(np.int64) << CELL_BITS | (keys & U((1 << CELL_BITS) - 1)).astype(np.int64)


def pack(keys: np.ndarray, counts: np.ndarray, zip_: zstandard.ZstdCompressor) -> tuple[bytes, bytes]:
    """Ascending keys as byte planes of their differences, and counts, both compressed."""
    steps = np.diff(keys, prepend=U(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zip_.compress(np.ascontiguousarray(steps).tobytes()), zip_.compress(counts.astype("<u4").tobytes())


def unpack(keys: bytes, counts: bytes, unzip: zstandard.ZstdDecompressor) -> tuple[np.ndarray, np.ndarray]:
    steps = np.ascontiguousarray(np.frombuffer(unzip.decompress(keys), np.uint8).reshape(8, -1).T).view("<u8").ravel()
    return np.cumsum(steps, dtype=U), np.frombuffer(unzip.decompress(counts), "<u4").astype(np.int64)


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and how often each occurs."""
    if counts is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
        return keys[first], np.diff(np.append(first, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, total = keys[order], np.concatenate([[0], np.cumsum(counts[order], dtype=np.int64)])
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.diff(total[np.append(first, len(keys))])


def levels(counts: np.ndarray, least: int = MIN_COUNT) -> np.ndarray:
    """The level of counts from ``least`` on."""
    return 1 + np.floor(np.log(counts / least) / np.log(LOG_BASE) + 1e-9).astype(np.int64)


def level_counts(level: np.ndarray, least: int = MIN_COUNT) -> np.ndarray:
    """The count that a level stands for: 0 for none, else the middle of the whole numbers that it holds."""
    low = least * np.power(LOG_BASE, np.maximum(level, 1) - 1.0)
    first, last = np.ceil(low - 1e-9), np.ceil(low * LOG_BASE - 1e-9) - 1
    return np.where(level == 0, 0.0, (first + np.maximum(first, last)) / 2)


def slots(keys: np.ndarray, level: np.ndarray | int, blocks: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit block, mask of bits) of each key and level."""
    x = mix(keys + np.asarray(level).astype(U) * U(0xA24BAED4963EE407))
    block = ((x >> U(32)) * np.asarray(blocks).astype(U)) >> U(32)
    mask = np.zeros(len(keys), U)
    for k in range(PROBES):
        mask |= U(1) << ((x >> U(6 * k)) & U(63))
    return block.astype(np.int64), mask


def make_filter(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The 64-bit blocks of a filter that holds every key with its quantised count."""
    level = levels(counts)
    each = np.repeat(keys, level)
    depth = np.arange(len(each)) - np.repeat(np.cumsum(level) - level, level) + 1
    n = max(1, -(-len(each) * BITS // 64))
    block, mask = slots(each, depth, n)
    order = np.argsort(block, kind="stable")
    block, mask = block[order], mask[order]
    out = np.zeros(n, U)
    if len(block):
        first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        out[block[first]] = np.bitwise_or.reduceat(mask, first)
    return out


class Model:
    """The regions [low, high) of one pass, as workers use them: words in ascending order with their counts, and the cells' filters
    one behind the other. The arrays are those of the broadcast, not copies."""

    def __init__(self, bits: int, low: int, keys: np.ndarray, counts: np.ndarray, blocks: np.ndarray, filters: np.ndarray):
        self.bits, self.low, self.high = bits, low, low + (len(blocks) >> CELL_BITS)
        self.keys, self.counts, self.filter = keys, counts, filters
        self.blocks = blocks.astype(U)
        self.first = np.concatenate([[0], np.cumsum(blocks)]).astype(np.int64)
        self.shift = U(64 - max(1, len(keys).bit_length() - 2))
        self.start: np.ndarray | None = None

    def mine(self, word: np.ndarray) -> np.ndarray:
        region = (word >> U(64 - self.bits)).astype(np.int64)
        return (region >= self.low) & (region < self.high)

    def exact(self, word: np.ndarray) -> np.ndarray:
        """Exact counts of words of these regions."""
        if not len(self.keys):
            return np.zeros(len(word), np.int64)
        if self.start is None:
            steps = np.arange((1 << 64 - int(self.shift)) + 1, dtype=np.int64)
            self.start = np.searchsorted(self.keys >> self.shift, steps.astype(U)).astype(np.int32)
        slot = (word >> self.shift).astype(np.int64)
        at, end = self.start[slot].astype(np.int64), self.start[slot + 1]
        out = np.zeros(len(word), np.int64)
        active = np.flatnonzero(at < end)
        while len(active):
            place = at[active]
            hit = self.keys[place] == word[active]
            out[active[hit]] = self.counts[place[hit]]
            at[active] += 1
            active = active[~hit & (at[active] < end[active])]
        return out

    def probe(self, keys: np.ndarray) -> np.ndarray:
        """Quantised counts of histories or n-grams of these regions."""
        cell = cells(keys, GRAMS, self.bits) - (self.low << CELL_BITS)
        blocks, first = self.blocks[cell], self.first[cell]
        level = np.zeros(len(keys), np.int64)
        active = np.arange(len(keys))
        while len(active):
            block, mask = slots(keys[active], level[active] + 1, blocks[active])
            hit = (self.filter[first[active] + block] & mask) == mask
            active = active[hit]
            level[active] += 1
            if len(active) and level[active[0]] > 120:  # counts end far below; only a full filter answers yes for ever
                break
        return level_counts(level)


def train(docs: DataFrame) -> tuple[DataFrame, str, int]:
    """The cells of a table with a column ``text``: (table, its path, bits of a region's number).

    Null texts are empty; repeated rows count as often as they occur; other columns are ignored; an empty table gives no cells.
    Words and n-grams are counted in each task first, so a frequent one costs a row a task; what is
    shuffled are packets of sorted keys, one a cell and task.
    """
    parts = docs.rdd.getNumPartitions()
    bits = min(REGION_BITS, max(3, (parts * 4 - 1).bit_length() - CELL_BITS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in KINDS]
        size = 0
        zip_ = zstandard.ZstdCompressor(level=1)

        def flush() -> pa.RecordBatch:
            rows = []
            for kind in KINDS:
                keys, counts = counted(*(np.concatenate(x) for x in zip(*held[kind], strict=True)))
                held[kind].clear()
                cell = cells(keys, kind, bits)
                by = np.argsort(cell, kind="stable")
                keys, counts = keys[by], counts[by]
                cut = np.searchsorted(cell[by], np.arange((1 << bits + CELL_BITS) + 1))
                for r in np.flatnonzero(np.diff(cut)):
                    rows.append((int(r), kind, *pack(keys[cut[r] : cut[r + 1]], counts[cut[r] : cut[r + 1]], zip_)))
            types = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["cell", "kind", "keys", "counts"])

        for piece in pieces(batches):
            word, history, gram, _ = tokens(text_array(piece.column(0)))
            for kind, keys in ((WORDS, word), (HISTORIES, keys_of(word, history, bits)), (GRAMS, keys_of(word, gram, bits))):
                distinct, counts = counted(keys)
                held[kind].append((distinct, counts.astype(np.uint32)))
                size += len(distinct)
            if size > HELD:
                yield flush()
                size = 0
        if held[0]:
            yield flush()

    def build(key: tuple, packets: pd.DataFrame) -> pd.DataFrame:
        unzip = zstandard.ZstdDecompressor()
        got = []
        for kind in KINDS:
            some = packets[packets["kind"] == kind]
            parts = [unpack(k, c, unzip) for k, c in zip(some["keys"], some["counts"], strict=True)] or [(np.zeros(0, U), np.zeros(0, np.int64))]
            got.append(counted(*(np.concatenate(x) for x in zip(*parts, strict=True))))
        words, counts = got[WORDS]
        # a history and an n-gram of one cell have hashes of their own
        entered = [(k[c >= MIN_COUNT], c[c >= MIN_COUNT]) for k, c in got[HISTORIES:]]
        made = make_filter(*(np.concatenate(x) for x in zip(*entered, strict=True)))
        shown = np.minimum(counts, 0xFFFFFFFF).astype("<u4")
        row = (int(key[0]), len(words), int(counts.sum()), words.tobytes(), shown.tobytes(), made.tobytes())
        return pd.DataFrame([row], columns=["cell", "n_words", "n_tokens", "words", "counts", "filter"])

    packets = docs.select("text").mapInArrow(count, "cell int, kind int, keys binary, counts binary")
    made = packets.groupBy("cell").applyInPandas(build, "cell int, n_words long, n_tokens long, words binary, counts binary, filter binary")
    done, path = table(made, "lm-cells", codec="none")
    return done, path, bits


class Sizes:
    """What the driver knows of a model: words, blocks and bytes of each cell (2**(REGION_BITS + CELL_BITS) at most), and totals."""

    def __init__(self, cells: DataFrame, bits: int):
        size = (F.length("words") * 1.5 + F.length("filter")).cast("long")
        rows = cells.select("cell", "n_words", "n_tokens", (F.length("filter") / 8).cast("long"), size).collect()
        self.words, self.blocks = {r[0]: r[1] for r in rows}, {r[0]: r[3] for r in rows}
        self.bytes = np.zeros(1 << bits, np.int64)
        for r in rows:
            self.bytes[r[0] >> CELL_BITS] += r[4]
        self.n, self.v = sum(r[2] for r in rows), sum(r[1] for r in rows)

    def passes(self, most: int) -> list[tuple[int, int]]:
        """Regions [low, high) of each pass: as many as ``most`` bytes hold, one at least."""
        out, low, total = [], 0, 0
        for r, size in enumerate(self.bytes.tolist()):
            if total and total + size > most:
                out.append((low, r))
                low, total = r, 0
            total += size
        return [*out, (low, len(self.bytes))]


def parts(m: Model, word: np.ndarray, history: np.ndarray, gram: np.ndarray, n: int, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(known, base, score) of tokens whose words are of the model's regions: each token's own terms."""
    c = m.exact(word)
    # an n-gram is no more frequent than its last word: this undoes false positives
    here, next_ = (np.minimum(m.probe(keys_of(word, x, m.bits)), c) for x in (gram, history))
    cost = np.log10(here + MU * (c + 1) / (n + v + 1))
    # as history of the next token; the end token is none
    cost -= np.where(word == END, 0.0, np.log10(next_ + MU))
    return (c > 0).astype(np.int64), np.log10(c + 1.0) - np.log10(n + v + 1), cost


def score(docs: DataFrame, model: tuple[DataFrame, str, int], train_docs: int, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens long, base_score, score double of every text, in base 10 logs.

    Rows are scored one by one: null texts are empty, null and repeated doc_ids stay rows of their own, also where the
    model needs several passes. Other columns are ignored; an empty table gives no rows.
    """
    cells_, _, bits = model
    sizes = Sizes(cells_, bits)
    n, v = sizes.n, sizes.v
    groups = sizes.passes(pass_bytes)
    start = np.log10(train_docs + MU)  # of every text as history, counted exactly
    names = ["doc_id", "n_tokens", "n_known", "base_score", "score"]
    schema = "doc_id long, n_tokens long, n_known long, base_score double, score double"
    if len(groups) == 1:
        shipped = _ship(cells_, groups[0], sizes)

        def run(batches: Iterator[pa.RecordBatch], token=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            m = _model(token, shipped, bits, 0)
            for piece in pieces(batches):
                word, history, gram, off = tokens(text_array(piece.column(1)))
                known, base, cost = (sums(x, off) for x in parts(m, word, history, gram, n, v))
                yield pa.RecordBatch.from_arrays([piece.column(0), *map(pa.array, (np.diff(off), known, base, cost - start))], names)

        out = docs.select("doc_id", "text").mapInArrow(run, schema)
    else:
        out = _score_in_passes(docs, cells_, bits, sizes, groups, start)
    return out.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def _score_in_passes(docs: DataFrame, cells_: DataFrame, bits: int, sizes: Sizes, groups: list[tuple[int, int]], start: float) -> DataFrame:
    """The texts are hashed once; each row's probes go to the pass that has their regions (a shuffle of 20 bytes a token, dealt by
    pass and split where a pass has much). One pass after another reads its own probes, and its broadcast goes when it is done.
    Every row has an end token, so every row comes back."""
    n, v = sizes.n, sizes.v
    pass_of = np.repeat(np.arange(len(groups)), [high - low for low, high in groups])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            word, *grams, off = tokens(text_array(piece.column(1)))
            owner, to = np.repeat(np.arange(len(off) - 1), np.diff(off)), pass_of[(word >> U(64 - bits)).astype(np.int64)]
            by = np.lexsort((to, owner))
            cut = np.flatnonzero(np.concatenate([[True], (np.diff(owner[by]) != 0) | (np.diff(to[by]) != 0), [True]]))
            first = by[cut[:-1]]
            ids = [np.ascontiguousarray(x[by]).view(np.uint8).reshape(-1, 8) for x in (word, *grams)]
            packed = np.concatenate([ids[0], ids[1][:, :6], ids[2][:, :6]], axis=1)
            probes = [packed[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)]
            rows = pa.array(owner[first])
            cols = [piece.column(0).take(rows), piece.column(2).take(rows), pa.array(np.diff(off)[owner[first]]), pa.array(to[first].astype(np.int32)), pa.array(probes, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "lm_row", "n_tokens", "lm_pass", "probes"])

    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("lm_row"))
    probes = rows.mapInArrow(deal, "doc_id long, lm_row long, n_tokens long, lm_pass int, probes binary")
    probes, probes_at = table(probes.hint("rebalance", "lm_pass"), "lm-probes", codec="none", partition_by="lm_pass")
    names = ["doc_id", "lm_row", "n_tokens", "n_known", "base_score", "score"]
    schema = "doc_id long, lm_row long, n_tokens long, n_known long, base_score double, score double"
    done = new_folder(docs.sparkSession, "lm-parts")
    for k, (low, high) in enumerate(groups):
        shipped = _ship(cells_, (low, high), sizes)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped, low=low, token=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            m = _model(token, shipped, bits, low)
            for piece in pieces(batches, "probes"):
                raw, off = buffers(piece.column(3))
                packed, off = raw.reshape(-1, 20), off // 20
                word = np.ascontiguousarray(packed[:, :8]).view(U).ravel()
                grams = np.zeros((2, len(packed), 8), np.uint8)
                grams[0, :, :6], grams[1, :, :6] = packed[:, 8:14], packed[:, 14:]
                known, base, cost = parts(m, word, *grams.view(U)[:, :, 0], n, v)
                ends = sums((word == END).astype(np.int64), off)
                cols = [*piece.columns[:3], *map(pa.array, (sums(known, off), sums(base, off), sums(cost, off) - start * ends))]
                yield pa.RecordBatch.from_arrays(cols, names)

        mine = probes.where(F.col("lm_pass") == k).select("doc_id", "lm_row", "n_tokens", "probes")
        mine.mapInArrow(run, schema).write.mode("append").parquet(done)
        shipped.destroy()
    drop(docs.sparkSession, probes_at)
    got = docs.sparkSession.read.schema(schema).parquet(done).groupBy("lm_row", "doc_id", "n_tokens")
    return got.agg(*(F.sum(c).alias(c) for c in ("n_known", "base_score", "score"))).drop("lm_row")


def _ship(cells_: DataFrame, regions: tuple[int, int], sizes: Sizes):
    low, high = regions[0] << CELL_BITS, regions[1] << CELL_BITS
    return cells_.sparkSession.sparkContext.broadcast(_arrays(cells_, low, high, sizes.words, sizes.blocks))


def _arrays(cells_: DataFrame, low: int, high: int, words: dict[int, int], blocks: dict[int, int]) -> tuple[np.ndarray, ...]:
    """Keys, counts, blocks of each cell (one empty block where there is none) and filters of the cells [low, high), filled cell by cell."""
    size = np.array([blocks.get(r, 1) for r in range(low, high)], np.int64)
    at, slot = np.cumsum([0] + [words.get(r, 0) for r in range(low, high)]), np.concatenate([[0], np.cumsum(size)])
    keys, counts, filters = np.empty(at[-1], U), np.empty(at[-1], "<u4"), np.zeros(slot[-1], U)
    for r in cells_.where(F.col("cell").between(low, high - 1)).select("cell", "words", "counts", "filter").toLocalIterator():
        k = r["cell"] - low
        keys[at[k] : at[k + 1]] = np.frombuffer(r["words"], U)
        counts[at[k] : at[k + 1]] = np.frombuffer(r["counts"], "<u4")
        filters[slot[k] : slot[k + 1]] = np.frombuffer(r["filter"], U)
    return keys, counts, size, filters


_models: dict[str, Model] = {}


def _model(token: str, shipped, bits: int, low: int) -> Model:
    """The pass's model in this worker, made once; another pass's goes."""
    if token not in _models:
        _models.clear()
        _models[token] = Model(bits, low, *shipped.value)
    return _models[token]


def held_out(docs: DataFrame, folds: int, fold: int) -> DataFrame:
    """With a column held_out: crc32(doc_id as text) mod ``folds`` is ``fold``. A null doc_id counts as the text 'null'."""
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"))
    return docs.withColumn("held_out", crc % folds == fold)


def score_documents(docs: DataFrame, folds: int = 7, fold: int = 2, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Train on the documents outside the fold, score all: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null texts are empty: only an end token. Letters A-Z are lower-cased. Other columns are ignored. Repeated rows count
    as often as they occur in training and are scored row by row, however many passes the model needs. An empty table gives no
    rows. Words are told apart by the 64-bit hashes of :mod:`vectext`. Shuffles: packets of counts; with several passes, also the probes (20 bytes
    a token) and a row of sums a text and pass. Broadcast: at most ``pass_bytes`` or one region. Memory of a worker: the broadcast, and some
    80 bytes a word of the longest text.
    """
    rows = held_out(docs.select(F.col("doc_id").cast("long"), "text"), folds, fold)
    learn = rows.where(~F.col("held_out")).select("text")
    model = train(learn)
    scored = score(rows, model, learn.count(), pass_bytes)
    return held_out(scored, folds, fold).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
