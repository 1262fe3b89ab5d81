"""Traffic summaries: /16 matrix, blocks, capture ratios, intensity, top talkers, inter-arrival times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import ips_in

#: Cells of the 256 x 256 matrix along the side of a block.
SCALE = 8


def octets(ip: str = "ip") -> tuple[Column, Column]:
    return F.shiftright(ip, 24).cast("int").alias("a"), F.shiftright(ip, 16).bitwiseAND(F.lit(255)).cast("int").alias("b")


def matrix(requests: DataFrame, weight: Column | None = None) -> DataFrame:
    """(a, b, cnt): requests by the first two octets, over all rows with a valid address; a row stands for ``weight`` requests."""
    each = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return requests.where(F.col("ip") != 0).groupBy(*octets()).agg(each.alias("cnt"))


def clustered_matrix(requests: DataFrame, ranges: DataFrame) -> DataFrame:
    """:func:`matrix` of the addresses inside the ranges (start, len), over all requests."""
    return matrix(ips_in(requests.where(F.col("ip") != 0).select("ip"), ranges))


def blocks(cells: DataFrame, scale: int = SCALE) -> DataFrame:
    """(ba, bb, cnt): the matrix summed over scale x scale blocks."""
    return cells.groupBy(F.floor(F.col("a") / scale).cast("int").alias("ba"), F.floor(F.col("b") / scale).cast("int").alias("bb")).agg(F.sum("cnt").alias("cnt"))


def capture(cells: DataFrame, clustered: DataFrame, keys: tuple[str, ...] = ("a", "b")) -> DataFrame:
    """With ``clustered``, ``ratio`` (clustered / all) and ``marker``: dot sizes from 0.8, from 0.2 and above 0."""
    inner = clustered.select(*(F.col(k).alias("_" + k) for k in keys), F.col("cnt").alias("clustered"))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col("_" + k))
    out = cells.join(inner, same, "left").drop(*("_" + k for k in keys)).withColumn("clustered", F.coalesce("clustered", F.lit(0)))
    ratio = F.coalesce(F.try_divide(F.col("clustered"), F.col("cnt")), F.lit(0.0))
    return out.withColumn("ratio", ratio).withColumn("marker", F.when(ratio >= 0.8, "●").when(ratio >= 0.2, "•").when(ratio > 0, "·").otherwise(""))


def intensity(cells: DataFrame, how: str = "linear", buckets: int = 10) -> DataFrame:
    """With ``intensity`` in [0, 1] (linear, sqrt or log) and ``bucket``: the count against the largest. One row, the largest, meets all."""
    top = cells.agg(F.max("cnt").alias("_top"))
    share = {"linear": F.col("cnt") / F.col("_top"), "sqrt": F.sqrt(F.col("cnt") / F.col("_top")), "log": F.log1p("cnt") / F.log1p("_top")}[how]
    return cells.crossJoin(F.broadcast(top)).withColumn("intensity", share).withColumn("bucket", F.least(F.floor(F.col("intensity") * buckets), F.lit(buckets - 1)).cast("int")).drop("_top")


def top_talkers(counts: DataFrame, n: int) -> DataFrame:
    """The n addresses with most requests, ties to the lower one; none for n <= 0. A top-n, never a full sort."""
    return counts.orderBy(F.col("c").desc(), "ip").limit(max(0, n))


def top_talkers_by(counts: DataFrame, n: int, by: list[str]) -> DataFrame:
    """The same for each group, with ``rank``; Spark prunes to n a group before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.col("c").desc(), "ip")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


#: Arrivals whose numbers agree but for so many low bits make a slice of an address's arrivals.
SLICE_BITS = 16


def arrival_gaps(rows: DataFrame, order: str = "seq") -> DataFrame:
    """(ip, seq, ts, gap): a row an arrival, with the seconds since the address's one before it (null for its first).

    An address's arrivals are cut into slices by their number, so one hot address is many groups; only the last time of each slice, a
    row, meets those of the other slices.
    """
    part = F.call_function("shiftright", F.col(order), F.lit(SLICE_BITS))
    sliced = rows.select("ip", F.col(order).alias("seq"), "ts", part.alias("_s"))
    w = Window.partitionBy("ip", "_s").orderBy("seq")
    inside = sliced.withColumn("_before", F.lag("ts").over(w)).withColumn("_first", F.row_number().over(w) == 1)
    ends = sliced.groupBy("ip", "_s").agg(F.max_by("ts", "seq").alias("_last"))
    carry = ends.select(F.col("ip").alias("_ip"), F.col("_s").alias("_t"), F.lag("_last").over(Window.partitionBy("ip").orderBy("_s")).alias("_carry"))
    both = inside.join(carry, (F.col("ip") == F.col("_ip")) & (F.col("_s") == F.col("_t")))
    before = F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_before"))
    return both.select("ip", "seq", "ts", (F.col("ts").cast("double") - before.cast("double")).alias("gap"))


def inter_arrival(rows: DataFrame, order: str = "seq") -> DataFrame:
    """(ip, last, deltas, count): each address's last time, the seconds between its arrivals in order, and their number.

    An address's arrivals are one array, as a window's snapshot shows them; windows bound them by their size. For
    unbounded tables take :func:`arrival_gaps`, a row an arrival.
    """
    got = arrival_gaps(rows, order)
    pairs = F.array_sort(F.collect_list(F.when(F.col("gap").isNotNull(), F.struct(F.col("seq").alias("o"), F.col("gap").alias("g")))))
    return got.groupBy("ip").agg(F.max_by("ts", "seq").alias("last"), F.transform(pairs, lambda p: p["g"]).alias("deltas"), F.count(F.lit(1)).alias("count"))


def unique_ips(requests: DataFrame) -> DataFrame:
    """Exact number of valid distinct addresses."""
    return requests.where(F.col("ip") != 0).agg(F.count_distinct("ip").alias("unique_ips"))
