"""Operator 5. N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Shingles (n-grams of words, as 64-bit hashes) have one global order: by estimated document frequency, rare first, then by hash.
The estimate comes from a sketch of 2**21 counters, a size that never grows; any order is right for a prefix filter, and a
better estimate only makes the prefixes rarer. Two sets of Jaccard similarity t share a shingle among the first
n - ceil(t n) + 1 of each. The plan:

1. One pass gives each document its set's size and a hash of the set (equal sets are one node) and fills the sketch.
2. One pass deals the prefix shingles to buckets, packed by task. A bucket keeps the shingles of two documents or more; of equal
   documents only the first stays.
3. Star round: each node meets the least node of its lists, and the pair with most lists in common is verified. Verified links give
   first components, so that a group of near copies needs no more pairs than members.
4. Cross round: lists with nodes of several components are joined, long lists in salted parts; pairs across components that pass
   the length and positional filters and were not verified yet are verified, once each, behind the suffix filter.
5. Components of all links; every document gets the least doc_id of its own.

Nothing is capped: what the star round leaves out, the cross round covers. Links inside a component are redundant for components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, pieces, table, text_array, unused
from .components import components
from .vectext import U, Words, mix

#: Words of a shingle; a link is 100 * |A and B| >= PERCENT * |A or B|.
SHINGLE, PERCENT = 5, 75
#: Counters of the frequency sketch, and counters of a slice that a task passes on.
SKETCH_BITS, SLICE_BITS = 21, 15
#: Prefix entries that a task holds before it passes packets on.
HELD = 1_000_000
#: Estimated document frequency from which a shingle's list is dealt over salted buckets.
HOT = 4096
#: Bits of the filter that spares texts no pair needs; it is exact only with the join behind it.
NEED_BITS = 22
#: Pairs of one node that are verified in one part, and entries of a list that one part of the cross join holds.
PART, LIST_PART = 100, 1000


def shingle_sets(col: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """Ascending distinct shingle hashes of each text. Under k words, the whole sequence is one shingle; without words, none."""
    w = Words(col)
    h = w.hashes(lower=True)
    n = len(h)
    roll = mix(h + U(k))
    grams = roll[: max(0, n - k + 1)]
    for j in range(1, k):
        grams = mix(grams * U(0x9FB21C651E98DF25) + h[j : n - k + 1 + j])
    out = []
    for a, b in zip(w.off, w.off[1:], strict=False):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            x = np.array([0x5405 + b - a], U)
            for one in h[a:b]:
                x = mix(x * U(0x9FB21C651E98DF25) + one)
            out.append(x)
        else:
            out.append(np.zeros(0, U))
    return out


def node_of(s: np.ndarray) -> int:
    """A 64-bit hash of a set; two of N different sets share one with probability N**2 / 2**65."""
    return int(mix(np.array([mix(s).sum(dtype=U) + U(len(s))], U)).view(np.int64)[0])


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def survey(docs: DataFrame, k: int) -> DataFrame:
    """Rows of two kinds: (doc_id, n, node) of each document, and (slice, packed) of each task's counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        waiting: list[np.ndarray] = []

        def add() -> None:
            nonlocal sketch
            if waiting:
                sketch += np.bincount(np.concatenate(waiting), minlength=1 << SKETCH_BITS).astype(np.uint32)
                waiting.clear()

        for piece in pieces(batches):
            sets = shingle_sets(text_array(piece.column(1)), k)
            waiting.append((np.concatenate(sets) >> U(64 - SKETCH_BITS)).astype(np.int32) if sets else np.zeros(0, np.int32))
            if sum(map(len, waiting)) > HELD:
                add()
            m = len(sets)
            cols = [piece.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "node", "slice", "packed"])
        add()
        size, zip_ = 1 << SLICE_BITS, zstandard.ZstdCompressor(level=1)
        used = [j for j in range(len(sketch) // size) if sketch[j * size : (j + 1) * size].any()]
        packed = [zip_.compress(sketch[j * size : (j + 1) * size].astype("<u4").tobytes()) for j in used]
        m = len(used)
        yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(used, pa.int32()), pa.array(packed, pa.binary())], ["doc_id", "n", "node", "slice", "packed"])

    return docs.mapInArrow(run, "doc_id long, n long, node long, slice int, packed binary")


def sketch_of(rows: DataFrame) -> np.ndarray:
    """The summed counters: 2**SKETCH_BITS numbers, whatever the input."""

    def add(key: tuple, packets: pd.DataFrame) -> pd.DataFrame:
        unzip = zstandard.ZstdDecompressor()
        total = np.zeros(1 << SLICE_BITS, np.int64)
        for x in packets["packed"]:
            total += np.frombuffer(unzip.decompress(x), "<u4")
        return pd.DataFrame({"slice": [int(key[0])], "packed": [np.minimum(total, 0xFFFFFFFF).astype("<u4").tobytes()]})

    out = np.zeros(1 << SKETCH_BITS, np.uint32)
    tree = rows.where(F.col("slice").isNotNull()).select("slice", "packed").groupBy("slice").applyInPandas(add, "slice int, packed binary")
    for r in tree.collect():
        out[r["slice"] << SLICE_BITS : r["slice"] + 1 << SLICE_BITS] = np.frombuffer(r["packed"], "<u4")
    return out


def shared_lists(docs: DataFrame, sketch: np.ndarray, k: int, percent: int) -> DataFrame:
    """(sh, doc_id, pos): the prefix entries whose shingle two documents or more have, and could link by. pos counts from 0 in the global order.

    A packet holds a bucket's entries of a task: 48 bits of each shingle, as buckets need no more to keep lists apart (should two shingles
    fall together, their lists only grow), and its documents and places as compressed differences. Shingles so frequent that one list
    would fill a bucket are dealt over salted buckets, which keep them unseen: they are shared for sure.
    """
    spark = docs.sparkSession
    parts = docs.rdd.getNumPartitions()
    n_buckets = 4 * max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rank = spark.sparkContext.broadcast(sketch)
    hot = HOT + 4 * int(sketch.mean())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        order, held, size = rank.value, [], 0
        salt = n_buckets + int(mix(np.array([TaskContext.get().partitionId()], U))[0] % U(n_buckets))
        zip_ = zstandard.ZstdCompressor(level=3)

        def flush() -> pa.RecordBatch:
            sh, doc, pos, n, bucket = (np.concatenate(x) for x in zip(*held, strict=True))
            by = np.argsort(bucket, kind="stable")
            cut = np.flatnonzero(np.concatenate([[True], np.diff(bucket[by]) != 0, [True]]))
            rows = []
            for a, b in zip(cut, cut[1:], strict=False):
                at = by[a:b]
                six = np.ascontiguousarray(sh[at]).view(np.uint8).reshape(-1, 8)[:, :6]
                rows.append((int(bucket[at[0]]), six.tobytes(), zip_.compress(np.diff(doc[at], prepend=0).tobytes()), zip_.compress(pos[at].tobytes()), zip_.compress(n[at].tobytes())))
            kinds = (pa.int32(), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "sh", "doc", "pos", "n"])

        for piece in pieces(batches):
            for doc, s in zip(piece.column(0).to_pylist(), shingle_sets(text_array(piece.column(1)), k), strict=True):
                if not len(s):
                    continue
                p = prefix_length(len(s), percent)
                est = order[(s >> U(64 - SKETCH_BITS)).astype(np.int64)]
                first = np.lexsort((s, est))[:p]
                sh, est = s[first], est[first]
                bucket = np.where(est > hot, salt, (sh % U(n_buckets)).astype(np.int64)).astype(np.int32)
                held.append((sh, np.full(p, doc, np.int64), np.arange(p, dtype=np.int32), np.full(p, len(s), np.int32), bucket))
                size += p
            if size > HELD:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def keep(key: tuple, packets: pd.DataFrame) -> pd.DataFrame:
        unzip = zstandard.ZstdDecompressor()
        six = np.concatenate([np.frombuffer(x, np.uint8).reshape(-1, 6) for x in packets["sh"]])
        sh = np.zeros((len(six), 8), np.uint8)
        sh[:, :6] = six
        sh = sh.view(np.int64).ravel()
        doc = np.concatenate([np.cumsum(np.frombuffer(unzip.decompress(x), np.int64)) for x in packets["doc"]])
        pos, n = (np.concatenate([np.frombuffer(unzip.decompress(x), np.int32) for x in packets[c]]) for c in ("pos", "n"))
        by = np.lexsort((doc, sh))
        sh, doc, pos, n = sh[by], doc[by], pos[by], n[by].astype(np.int64)
        if key[0] < n_buckets:
            first = np.flatnonzero(np.concatenate([[True], sh[1:] != sh[:-1]]))
            size = np.diff(np.append(first, len(sh)))
            # a list of two serves only if its two documents pass the length and positional filters with this shingle
            two = first[size == 2]
            need = -(-percent * (n[two] + n[two + 1]) // (100 + percent))
            fits = (100 * np.minimum(n[two], n[two + 1]) >= percent * np.maximum(n[two], n[two + 1])) & (pos[two] <= n[two] - need) & (pos[two + 1] <= n[two + 1] - need)
            serves = size > 2
            serves[size == 2] = fits
            many = np.repeat(serves, size)
            sh, doc, pos = sh[many], doc[many], pos[many]
        return pd.DataFrame({"sh": sh, "doc_id": doc, "pos": pos})

    packets = docs.mapInArrow(deal, "bucket int, sh binary, doc binary, pos binary, n binary")
    return packets.groupBy("bucket").applyInPandas(keep, "sh long, doc_id long, pos int")


def sizes_fit(a: Column, b: Column, percent: int) -> Column:
    """Length filter."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def overlap_needed(a: Column, b: Column, percent: int) -> Column:
    return F.ceil(percent * (a + b) / (100.0 + percent) - 1e-9)


def first_fits(need: Column, a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Positional filter for the first shingle that two sets (n, pos) share: what follows it must still be enough."""
    return (a[1] <= a[0] - need) & (b[1] <= b[0] - need)


def star_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b): each node with the hub that most of its lists have. A list's hub is the node that has its shingle first in its order:
    the one with the fewest rarer shingles, so the least edited of a group of near copies."""
    hub = lists.groupBy("sh").agg(F.min(F.struct("pos", "node", "n")).alias("m")).select(F.col("sh").alias("k"), F.col("m.node").alias("a"), F.col("m.n").alias("na"), F.col("m.pos").alias("pa"))
    need = overlap_needed(F.col("n"), F.col("na"), percent)
    met = lists.join(hub, lists["sh"] == hub["k"]).where((F.col("node") != F.col("a")) & sizes_fit(F.col("n"), F.col("na"), percent) & first_fits(need, (F.col("n"), F.col("pos")), (F.col("na"), F.col("pa"))))
    shared = met.groupBy(F.col("node").alias("b"), "a").agg(F.count(F.lit(1)).alias("c"))
    return shared.groupBy("b").agg(F.max(F.struct("c", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")


def cross_pairs(lists: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b: pairs of nodes of different components that the length and positional filters leave.

    The first shared shingle of two sets that link stands at n - need at the latest in both, so later entries make no rows. A list of
    more than ``LIST_PART`` entries is dealt: each part of one side meets a copy of the other, so no list is bound to one task.
    """
    named = lists.join(comps, lists["node"] == comps["cnode"], "left").withColumn("comp", F.coalesce("comp", "node")).select("sh", "node", "n", "pos", "comp")
    several = named.groupBy("sh").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m"))
    several = several.where(F.col("lo") != F.col("hi")).select(F.col("sh").alias("k"), F.ceil(F.col("m") / LIST_PART).alias("deals"))
    some, some_at = table(named.join(several, named["sh"] == several["k"]).drop("k"), "join-mixed")
    x, y = some.withColumnsRenamed({c: c + "_a" for c in some.columns}), some.withColumnsRenamed({c: c + "_b" for c in some.columns})
    x = x.withColumn("salt_a", F.pmod(F.xxhash64("node_a"), F.col("deals_a")))
    y = y.withColumn("salt_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals_b") - 1)))
    need = overlap_needed(F.col("n_a"), F.col("n_b"), percent)
    near = first_fits(need, (F.col("n_a"), F.col("pos_a")), (F.col("n_b"), F.col("pos_b")))
    across = (F.col("node_a") < F.col("node_b")) & (F.col("comp_a") != F.col("comp_b")) & sizes_fit(F.col("n_a"), F.col("n_b"), percent)
    met = x.join(y, (F.col("sh_a") == F.col("sh_b")) & (F.col("salt_a") == F.col("salt_b"))).where(across & near)
    pairs, _ = table(met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct(), "join-cross")
    drop(lists.sparkSession, some_at)
    return pairs


def hamming_bound(x: np.ndarray, y: np.ndarray, depth: int = 2) -> int:
    """Suffix filter: a lower bound of the symmetric difference of two ascending sets, by splitting at a probe."""
    if depth == 0 or not len(x) or not len(y):
        return abs(len(x) - len(y))
    probe = y[len(y) // 2]
    i, j = int(np.searchsorted(x, probe)), len(y) // 2
    hit = i < len(x) and x[i] == probe
    return hamming_bound(x[:i], y[:j], depth - 1) + (not hit) + hamming_bound(x[i + hit :], y[j + 1 :], depth - 1)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Exact test of two ascending sets, behind the suffix filter."""
    need = -(-percent * (len(x) + len(y)) // (100 + percent))
    if hamming_bound(x, y) > len(x) + len(y) - 2 * need:
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum()) >= need


def verify(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets, each tested once. nodes: (node, rep, n).

    Texts travel, as they compress better than sets: a node's text goes to the node ``a`` of its pairs, in parts of bounded size
    if that node has many; there a's text comes first and the others stream past it. A bit filter of fixed size spares the texts that no
    pair needs; the join behind it drops what it lets through.
    """
    spark = docs.sparkSession
    parts = pairs.groupBy(F.col("a").alias("g")).agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"))
    grouped = pairs.join(parts, pairs["a"] == parts["g"])
    others = grouped.select("g", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), F.lit(1).alias("role"), F.col("b").alias("w"))
    firsts = parts.select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), F.col("g").alias("w"))
    seats = others.unionByName(firsts)
    seats, seats_at = table(seats.join(nodes, seats["w"] == nodes["node"]).select("g", "part", "role", "node", F.col("rep").alias("d")), "join-seats")
    # bounded: 2**NEED_BITS / 32 rows at most
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << NEED_BITS))
    words = seats.select(spot("d").alias("s")).groupBy((F.col("s") / 32).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 32 as int))")).alias("bits")).toPandas()
    bitmap = np.zeros(1 << NEED_BITS - 5, np.uint32)
    bitmap[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype(np.uint32)
    need = spark.sparkContext.broadcast(bitmap)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = batch.column(2).to_numpy()
            hit = (need.value[s >> 5] >> (s & 31).astype(np.uint32)) & 1
            yield batch.select([0, 1]).filter(pa.array(hit.astype(bool)))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for piece in pieces(batches):
            a, b = [], []
            place = list(zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True))
            for here, role, node, s in zip(place, piece.column(2).to_pylist(), piece.column(3).to_pylist(), shingle_sets(text_array(piece.column(4)), k), strict=True):
                if node_of(s) != node:  # another text under the same doc_id
                    continue
                if role == 0:
                    at, held = here, s
                elif here == at and similar(held, s, percent):
                    a.append(here[0])
                    b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    sifted = docs.select("doc_id", "text", spot("doc_id").alias("s")).mapInArrow(sift, "doc_id long, text string")
    seated = sifted.join(seats, sifted["doc_id"] == seats["d"]).select("g", "part", "role", "node", "text")
    links, _ = table(seated.repartition("g", "part").sortWithinPartitions("g", "part", "role").mapInArrow(test, "a long, b long").distinct(), "join-links")
    drop(spark, seats_at)
    return links


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles long, component_id long: the least doc_id that links reach, its own included.

    Null and empty texts have no shingles and link with nothing. A row without doc_id takes no part in links and has no component.
    Rows that repeat a doc_id are one document where links are followed: all of them get the component that any of them reaches. Repeated
    texts are one node, and their copies are never paired. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    rows, rows_at = table(survey(docs, k), "join-survey")
    sketch = sketch_of(rows)
    found = rows.where(F.col("slice").isNull()).select("doc_id", "n", "node")
    some = docs.where(F.col("doc_id").isNotNull())
    nodes = found.where(F.col("node").isNotNull() & F.col("doc_id").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("n").cast("int").alias("n"))
    nodes, nodes_at = table(nodes, "join-nodes")
    entries, entries_at = table(shared_lists(some, sketch, k, percent), "join-entries")
    lists, lists_at = table(entries.join(nodes, entries["doc_id"] == nodes["rep"]).select("sh", "node", "n", "pos"), "join-lists")
    drop(spark, entries_at)
    stars, _ = table(star_pairs(lists, percent), "join-pairs")
    links = verify(some, nodes, stars, k, percent)
    comps = components(links)
    named = comps.select(F.col("node").alias("cnode"), "comp")
    left = cross_pairs(lists, named, percent)
    done = stars.select(F.least("a", "b").alias("da"), F.greatest("a", "b").alias("db"))
    left, _ = table(left.join(done, (left["a"] == done["da"]) & (left["b"] == done["db"]), "left_anti"), "join-pairs")
    more = verify(some, nodes, left, k, percent)
    drop(spark, lists_at)
    # a doc_id that repeats with different texts ties their nodes
    ids = found.where(F.col("node").isNotNull() & F.col("doc_id").isNotNull())
    ties = ids.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count_distinct("node").alias("m")).where(F.col("m") > 1).select("doc_id")
    tied = ids.join(ties, "doc_id", "left_semi")
    tied = tied.join(tied.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").select("a", F.col("node").alias("b")).where("a <> b")
    every = components(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(more).unionByName(tied))
    placed = nodes.join(every.withColumnRenamed("node", "e"), F.col("node") == F.col("e"), "left").select("node", F.coalesce("comp", "node").alias("comp"), "rep")
    placed, placed_at = table(placed, "join-placed")
    # a table of its own, so that a component of any size is a plain shuffled side of the join, which skew handling can split
    least, _ = table(placed.groupBy("comp").agg(F.min("rep").alias("component_id")).withColumnRenamed("comp", "c"), "join-least")
    names, _ = table(placed.join(least, placed["comp"] == least["c"]).select(F.col("node").alias("k"), "component_id"), "join-names")
    drop(spark, placed_at, nodes_at)
    out = found.join(names, found["node"] == names["k"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, but for one document of each component: its least doc_id.

    Of rows that repeat a doc_id, the first by text stays, of those whose texts have words if there are any. Rows without doc_id have no component: of
    those with the same words and spaces one stays, whichever; without words (null, empty, blank) all stay. Columns may have any names.
    An empty table gives no rows. One shuffle of the texts, by doc_id.
    """
    from pyspark.sql import Window

    row, stay = unused(docs, "join_row", "stay")
    own = F.col("doc_id").cast("long")
    got = near_duplicates(docs.select("doc_id", "text"), **options)
    left = got.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(stay)).distinct()
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = docs.join(left, own == F.col(stay), "left_semi")
    kept = kept.withColumn(row, F.row_number().over(Window.partitionBy(own).orderBy(worded.desc(), "text"))).where(F.col(row) == 1).drop(row)
    nameless = docs.where(F.col("doc_id").isNull())
    return kept.unionByName(nameless.where(~worded)).unionByName(nameless.where(worded).dropDuplicates(["text"]))
