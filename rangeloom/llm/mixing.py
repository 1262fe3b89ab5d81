"""Operator 8. Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

A document of source s is to be taken target(s) / size(s) times. The whole part is taken
as it is; the fractional parts are rounded dependently. Two documents a, b meet, and
random mass (counted in words) moves between them until one fraction is 0 or 1, with the
odds that leave both expectations as they were. A chunk of documents is folded this way,
which leaves at most one undecided document; the leftovers of the chunks are the documents
of the next level of a reduction tree, until one is left of each source. The words taken
of a source so differ from the target by less than one document.

Rows that are alike (same id, source, size and text) are one element with a number ``m``: m alike fractions always end as
floor(m p) ones and one rest, so no more than one of them is ever undecided, however many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, unused

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: No document is taken more often than this, and no target exceeds this many source sizes.
MOST = 3
#: Expected elements of a chunk. Chunks of the first level are formed by a hash of id, size and text.
CHUNK = 64
EPS = 1e-9
#: An element: id, size, hash of the text, two hashes of the row, fraction, how many rows, how many of them are up for sure.
ELEMENT = "struct<id:bigint,w:bigint,t:bigint,a:bigint,b:bigint,p:double,m:bigint,ups:bigint>"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, n, source_size, target) of a table source, size; n counts its rows.

    Sources in code-point order, null last, weigh ``weights``, repeated. Targets share the sum of all sizes by weight;
    one above ``most`` source sizes stops there, and its excess is shared again by weight. Sorted by how
    soon they stop, the stopped sources are a prefix, found with running sums, so no iteration is needed. One row
    a source meets in one task; documents don't. Other columns are ignored; an empty table gives no rows.
    """
    total = 1
    for w in weights:
        total *= w
    by = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    place = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(place) - 1) % len(weights) + 1).cast("int")).cast("long")
    s = by.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    soon = Window.orderBy(F.col("cap") * total / F.col("weight"), F.col("source").asc_nulls_last())
    upto, every = soon.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumn("room", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(upto), F.lit(0)))
    s = s.withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0)))
    s = s.withColumn("stops", F.col("cap") * F.col("left_weight") <= F.col("weight") * F.col("room"))
    s = s.withColumn("room", F.min(F.when(~F.col("stops"), F.struct(-F.col("left_weight"), "room"))).over(every)["room"]).withColumn("left_weight", F.max(F.when(~F.col("stops"), F.col("left_weight"))).over(every))
    share = F.col("weight") * F.col("room").cast("double") / F.col("left_weight")
    return s.select("source", "n", "source_size", F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def _uniform(*by: Column) -> Column:
    """A number in [0, 1) fixed by its arguments."""
    return F.shiftrightunsigned(F.xxhash64(*by), 11) * F.lit(2.0**-53)


def _fold(elements: Column, level: int, seed: int) -> Column:
    """Pairwise rounding of an array of elements: struct(rest: element or null, out: array of decided elements, p 0 or 1)."""
    start = F.expr(f"struct(cast(null as {ELEMENT}) as rest, cast(array() as array<{ELEMENT}>) as out)")

    def meet(acc: Column, b: Column) -> Column:
        a = acc["rest"]
        wa, wb = a["w"].cast("double"), b["w"].cast("double")
        rise = F.least((1 - a["p"]) * wa, b["p"] * wb)
        fall = F.least(a["p"] * wa, (1 - b["p"]) * wb)
        draw = _uniform(*(F.coalesce(e["id"], F.lit(-1)) for e in (a, b)), a["w"], b["w"], a["t"], b["t"], F.lit(level), F.lit(seed))
        moved = F.when(draw * (rise + fall) < fall, rise).otherwise(-fall)
        pa, pb = a["p"] + moved / wa, b["p"] - moved / wb
        open_ = lambda p: (p > EPS) & (p < 1 - EPS)
        mark = lambda e, p: _with_p(e, F.when(p > 0.5, F.lit(1.0)).otherwise(F.lit(0.0)))
        rest = F.when(open_(pa), _with_p(a, pa)).when(open_(pb), _with_p(b, pb))
        done = F.when(open_(pa), F.array(mark(b, pb))).when(open_(pb), F.array(mark(a, pa))).otherwise(F.array(mark(a, pa), mark(b, pb)))
        next_ = F.struct(rest.alias("rest"), F.concat(acc["out"], done).alias("out"))
        return F.when(a.isNull(), F.struct(_with_p(b, b["p"]).alias("rest"), acc["out"].alias("out"))).otherwise(next_)

    return F.aggregate(elements, start, meet)


def _with_p(e: Column, p: Column) -> Column:
    return F.struct(*(e[c].alias(c) for c in ("id", "w", "t", "a", "b")), p.alias("p"), e["m"].alias("m"), e["ups"].alias("ups"))


def _decide(rows: DataFrame, weights: tuple[int, ...], most: int, chunk: int, seed: int) -> DataFrame:
    """(source, source_size, target, base, id, w, t, a, b, m, ups) of a table id, source, w, t, a, b: of m alike rows, ``ups`` are
    taken base + 1 times and the others base times."""
    keys = ["source", "source_size", "target", "base"]
    alike, _ = table(rows.groupBy("id", "source", "w", "t", "a", "b").agg(F.count(F.lit(1)).alias("m")), "mix-sizes")
    per, _ = table(targets(alike.select("source", (F.col("w") * F.col("m")).alias("size")), weights, most), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    per = per.withColumn("rate", rate).withColumn("base", F.floor("rate").cast("int")).withColumn("frac", F.col("rate") - F.col("base")).withColumnRenamed("source", "s")
    every = alike.join(per, alike["source"].eqNullSafe(per["s"])).drop("s")
    # what alike rows settle among themselves
    mass = F.col("m") * F.col("frac")
    every = every.withColumn("ups", F.floor(mass + EPS)).withColumn("p", F.greatest(mass - F.col("ups"), F.lit(0.0)))
    open_ = (F.col("w") > 0) & (F.col("p") > EPS)
    sure = F.when(F.col("w") > 0, F.col("ups")).otherwise(F.when(F.col("frac") > 0.5, F.col("m")).otherwise(F.lit(0)))
    shown = ["id", "w", "t", "a", "b", "m"]
    decided = [every.where(~open_).select(*keys, *shown, sure.cast("long").alias("ups"))]
    largest = per.agg(F.max("n")).first()[0] or 0
    level, groups = 0, -(-largest // chunk)
    place = F.pmod(F.xxhash64("id", "w", "t", F.lit(seed)), F.ceil(F.col("n") / chunk)).cast("long")
    element = F.struct(*shown[:-1], "p", "m", F.col("ups").cast("long").alias("ups")).alias("e")
    elements = every.where(open_).select(*keys, place.alias("place"), element)
    while True:
        folded = elements.groupBy(*keys, "place").agg(F.array_sort(F.collect_list("e")).alias("es"))
        folded = folded.select(*keys, "place", _fold(F.col("es"), level, seed).alias("f"))
        kept, _ = table(folded.select(*keys, "place", F.col("f.rest").alias("rest"), F.col("f.out").alias("out")), f"mix-level{level}")
        settled = kept.select(*keys, F.explode("out").alias("o")).select(*keys, *(F.col(f"o.{c}") for c in shown), (F.col("o.ups") + F.col("o.p").cast("long")).alias("ups"))
        decided.append(settled)
        rest = kept.where(F.col("rest").isNotNull())
        if groups <= 1:
            last = _uniform(F.coalesce(F.col("rest.id"), F.lit(-1)), F.col("rest.t"), F.lit(seed), F.lit(level + 1)) < F.col("rest.p")
            decided.append(rest.select(*keys, *(F.col(f"rest.{c}") for c in shown), (F.col("rest.ups") + last.cast("long")).alias("ups")))
            break
        level, groups = level + 1, -(-groups // chunk)
        elements = rest.select(*keys, F.floor(F.col("place") / chunk).alias("place"), F.col("rest").alias("e"))
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    return out


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, chunk: int = CHUNK, seed: int = 17) -> DataFrame:
    """Per document: doc_id, source, size, source_size long, target double, copies int, taken long (size * copies).

    ``size`` counts words; null texts have none. A document without words is taken as often as the whole part of its
    source's rate says, which moves no words. A null source is a source of its own; null doc_ids and repeated rows
    are documents of their own; other columns are ignored; an empty table gives no rows. All random numbers are hashes
    of ids, sizes and texts, so reruns agree. A hot source is folded in as many chunks as it needs, and rows that are
    alike, however many, are one element. The texts are read once and never shuffled.
    """
    none = F.lit(0).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "source", word_count(F.col("text")).alias("w"), F.xxhash64("text").alias("t"), none.alias("a"), none.alias("b"))
    got = _decide(rows, weights, most, chunk, seed)
    got = got.withColumn("k", F.explode(F.sequence(none + 1, F.col("m"))))
    copies = F.col("base") + (F.col("k") <= F.col("ups")).cast("int")
    return got.select(F.col("id").alias("doc_id"), "source", F.col("w").alias("size"), "source_size", "target", copies.alias("copies"), (F.col("w") * copies).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, chunk: int = CHUNK, seed: int = 17) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as :func:`mix` takes it, with all its columns, whatever they are called.

    Rows find their decisions by 128 bits of hashes of all their columns; rows that are equal in all of them are one row of the shuffle, and
    come back as often as all of them are taken. Null ids, empty texts and empty tables as for :func:`mix`. The texts are
    shuffled once.
    """
    a, b, row = unused(docs, "mix_a", "mix_b", "mix_row")
    every = [F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema]
    one, two = F.xxhash64(F.lit(seed), *every), F.xxhash64(F.lit(-1 - seed), *every)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "source", word_count(F.col("text")).alias("w"), F.xxhash64("text").alias("t"), one.alias("a"), two.alias("b"))
    got = _decide(rows, weights, most, chunk, seed)
    chosen = got.select(F.col("a").alias("c_a"), F.col("b").alias("c_b"), (F.col("m") * F.col("base") + F.col("ups")).alias("copies")).where("copies > 0")
    packed = docs.select(one.alias(a), two.alias(b), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(row))
    packed = packed.groupBy(F.col(a).alias("r_a"), F.col(b).alias("r_b")).agg(F.first(row).alias("r"))
    both = packed.join(chosen, (F.col("r_a") == F.col("c_a")) & (F.col("r_b") == F.col("c_b")))
    return both.select("r", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("r.*")
