"""Where traffic concentrates: counts over the prefix hierarchy, and the ranges that a rule singles out.

A prefix of depth d with n requests, l and r of them in its halves, is a candidate of a parameter set (m, lo, hi, diff) if n >= m and either d = hi,
or lo <= d < hi, both halves are there, and l = r or 2000 * |l - r| < trunc(1000 * diff) * n. The result are the outermost
candidates. Prefixes nest or are disjoint, so a candidate is outermost iff no range that starts before it (or with it and is shorter) ends at or behind its end: a running maximum.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ip import cidr_text, last_ip

PARAMS = "trie string, set_idx int, min_size bigint, min_depth int, max_depth int, mean_diff double, use_for_jail boolean, t bigint"


class ParameterError(ValueError):
    pass


@dataclass(frozen=True)
class ClusterParams:
    """A parameter set: least requests, depths, and how uneven the halves may be."""

    min_size: int
    min_depth: int
    max_depth: int
    mean_diff: float
    use_for_jail: bool = False

    def __post_init__(self):
        if self.min_depth > self.max_depth:
            raise ParameterError(f"minDepth ({self.min_depth}) must be <= maxDepth ({self.max_depth})")
        if self.min_size < 0 or self.min_depth < 0:
            raise ParameterError("sizes and depths are not negative")

    @property
    def threshold(self) -> int:
        return int(max(self.mean_diff, 0.0) * 1000)


def ip_counts(requests: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Requests of each valid address: (*by, ip, c). Grouping by address first bounds what follows by the number of addresses,
    so no hot address skews it."""
    return requests.where(F.col("ip") != 0).groupBy(*(by or []), "ip").agg(F.count(F.lit(1)).alias("c"))


def prefix_nodes(counts: DataFrame, low: int, high: int, by: list[str] | None = None) -> DataFrame:
    """(*by, d, p, n, l, r) of every prefix of depths low..high: requests, and those of its halves. The root's own count is 0."""
    by = by or []
    depths = F.explode(F.sequence(F.lit(low), F.lit(min(high, 32))))
    rows = counts.select(*by, "ip", "c", depths.alias("d"))
    bit = F.call_function("shiftright", F.col("ip"), F.greatest(F.lit(31) - F.col("d"), F.lit(0))).bitwiseAND(F.lit(1))
    inner = F.col("d") < 32
    p = F.call_function("shiftright", F.col("ip"), F.lit(32) - F.col("d"))
    got = rows.groupBy(*by, "d", p.alias("p")).agg(
        F.sum("c").alias("n"), F.sum(F.when(inner & (bit == 0), F.col("c")).otherwise(F.lit(0))).alias("l"), F.sum(F.when(inner & (bit == 1), F.col("c")).otherwise(F.lit(0))).alias("r")
    )
    return got.withColumn("n", F.when(F.col("d") == 0, F.lit(0)).otherwise(F.col("n"))) if low == 0 else got


def params_table(spark, sets: dict[str, list[ClusterParams]]) -> DataFrame:
    rows = [(trie, k, s.min_size, s.min_depth, s.max_depth, float(s.mean_diff), s.use_for_jail, s.threshold) for trie, ps in sets.items() for k, s in enumerate(ps)]
    return spark.createDataFrame(rows, PARAMS)


def params_array(sets: dict[str, list[ClusterParams]]) -> Column:
    """The parameter sets as a literal array of structs: they are configuration, so a counted prefix looks through them where it is."""
    one = lambda trie, k, s: F.struct(
        F.lit(trie).alias("trie"), F.lit(k).alias("set_idx"), F.lit(s.min_size).cast("bigint").alias("min_size"), F.lit(s.min_depth).alias("min_depth"), F.lit(s.max_depth).alias("max_depth"), F.lit(s.threshold).cast("bigint").alias("t"),
    )
    return F.array(*(one(trie, k, s) for trie, ps in sets.items() for k, s in enumerate(ps)))


def balanced(n: Column, left: Column, right: Column, t: Column, wrap: bool = False) -> Column:
    """The halves' test; ``wrap`` computes modulo 2**32, for results equal to 32-bit arithmetic on huge counts."""
    a, b = 2000 * F.abs(left - right), t * n
    if wrap:
        a, b = F.pmod(a, F.lit(1 << 32)), F.pmod(b, F.lit(1 << 32))
    return (left > 0) & (right > 0) & ((left == right) | (a < b))


def detect_clusters(counts: DataFrame, sets: dict[str, list[ClusterParams]], wrap: bool = False) -> DataFrame:
    """(trie, set_idx, start, end, len, cidr, requests) of all parameter sets of all tries; counts: (trie, ip, c).

    The hierarchy is counted once a trie, whatever the number of sets; parameters are literals of the plan. Two shuffles: by
    address before, by prefix here; the window sees only candidates, and is partitioned by their prefix at the set's least depth.
    """
    spark = counts.sparkSession
    every = [s for ps in sets.values() for s in ps]
    if not every:
        return spark.createDataFrame([], "trie string, set_idx int, start bigint, end bigint, len int, cidr string, requests bigint")
    low = min(s.min_depth for s in every)
    high = max(min(s.max_depth, 32) for s in every)
    if low == 0 and all(s.min_size > 0 for s in every):
        low = min(1, high)  # the root counts 0 and is no candidate then
    # a node that no set's least size admits is dropped before the join
    nodes = prefix_nodes(counts, min(low, high), high, ["trie"]).where(F.col("n") >= min(s.min_size for s in every))
    d, n = F.col("d"), F.col("n")

    def admits(s: Column) -> Column:
        inside = (d < s["max_depth"]) & (d >= s["min_depth"]) & (d < 32) & balanced(n, F.col("l"), F.col("r"), s["t"], wrap)
        return (F.col("trie") == s["trie"]) & (n >= s["min_size"]) & ((d == s["max_depth"]) | inside)

    found = nodes.withColumn("s", F.explode(F.filter(params_array(sets), admits))).select("trie", "d", "p", "n", "s.set_idx", "s.min_depth")
    start = F.call_function("shiftleft", F.col("p"), F.lit(32) - d)
    found = found.select("trie", "set_idx", start.alias("start"), d.alias("len"), n.alias("requests"), "min_depth").withColumn("end", last_ip(F.col("start"), F.col("len")))
    if any(s.min_size == 0 and s.min_depth == 0 for s in every):
        found = found.unionByName(_empty_roots(counts, params_table(spark, sets).withColumnRenamed("trie", "pt")))
    home = F.call_function("shiftright", F.col("start"), F.lit(32) - F.col("min_depth"))
    before = Window.partitionBy("trie", "set_idx", home).orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)
    outer = found.withColumn("covered", F.coalesce(F.max("end").over(before), F.lit(-1))).where(F.col("covered") < F.col("end"))
    return outer.select("trie", "set_idx", "start", "end", "len", cidr_text(F.col("start"), F.col("len")).alias("cidr"), "requests")


def _empty_roots(counts: DataFrame, params: DataFrame) -> DataFrame:
    """0.0.0.0/0 for the sets with least size 0 and least depth 0 of tries without any request."""
    seen = counts.select(F.col("trie").alias("st")).distinct()
    free = params.where((F.col("min_size") == 0) & (F.col("min_depth") == 0)).join(seen, F.col("pt") == F.col("st"), "left_anti")
    zero = F.lit(0).cast("bigint")
    return free.select(F.col("pt").alias("trie"), "set_idx", zero.alias("start"), F.lit(0).alias("len"), zero.alias("requests"), "min_depth", F.lit((1 << 32) - 1).cast("bigint").alias("end"))


def with_percentage(ranges: DataFrame, counts: DataFrame) -> DataFrame:
    """With ``percentage``: of the trie's requests (0 for none). The totals, one number a trie, are a map that every row looks into."""
    total = counts.groupBy("trie").agg(F.sum("c").alias("total")).agg(F.map_from_entries(F.collect_list(F.struct("trie", "total")))).scalar()
    return ranges.withColumn("percentage", F.coalesce(100.0 * F.col("requests") / F.try_element_at(total, F.col("trie")), F.lit(0.0)))
