"""Algebra of CIDR ranges: containment, cover, subtraction, merging, coalescing, membership.

Ranges are (start, len). CIDR ranges nest or are disjoint, so "overlaps" means that one is a prefix of the other: every
join here is an equi-join on (len, prefix), with one side's prefixes of all lengths (33 at most) exploded; no
comparison of all ranges with all ranges.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import islice, takewhile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ip import block_size, cidr_len, cidr_start, cidr_text, is_cidr, last_ip, mask, prefix_of


def parse(ranges: DataFrame, column: str = "cidr") -> DataFrame:
    """With start and len of a text column; rows that are no ranges go."""
    return ranges.where(is_cidr(F.col(column))).withColumn("start", cidr_start(F.col(column))).withColumn("len", cidr_len(F.col(column)))


def _ancestors(ranges: DataFrame, names: tuple[str, str]) -> DataFrame:
    """A row for every prefix of each range, itself included."""
    grown = ranges.withColumn(names[0], F.explode(F.sequence(F.lit(0), F.col("len"))))
    return grown.withColumn(names[1], prefix_of(F.col("start"), F.col(names[0])))


def contained(ranges: DataFrame, outer: DataFrame, how: str = "left_semi") -> DataFrame:
    """Ranges that lie wholly in one range of ``outer`` (``left_semi``), or in none (``left_anti``).

    A range's prefixes are gathered to its row by id where rows must stay whole, so duplicates keep their number.
    """
    keyed = outer.select(F.col("len").alias("_ol"), prefix_of(F.col("start"), F.col("len")).alias("_op")).distinct()
    rows = ranges.withColumn("_key", F.struct("start", "len"))
    inside = _ancestors(ranges.select("start", "len").distinct(), ("_l", "_p")).join(keyed, (F.col("_l") == F.col("_ol")) & (F.col("_p") == F.col("_op")), "left_semi")
    hit = inside.select(F.struct("start", "len").alias("_hit")).distinct()
    return rows.join(hit, F.col("_key") == F.col("_hit"), how).drop("_key")


def cover(spans: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """The fewest CIDR ranges that make up [start, end]: the columns of ``spans`` but its ends, and start, len, cidr.

    At each level there are at most two aligned blocks that lie in the span while their parent doesn't. An empty span gives no rows.
    """
    rest = [c for c in spans.columns if c not in (start, end)]
    rows = spans.where(F.col(start) <= F.col(end)).select(*rest, F.col(start).alias("_s"), F.col(end).alias("_e"), F.explode(F.sequence(F.lit(0), F.lit(32))).alias("_k"))
    size = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_k"))
    down = lambda x: F.call_function("shiftleft", F.call_function("shiftright", x, F.col("_k")), F.col("_k"))
    rows = rows.withColumn("_b", F.explode(F.array_distinct(F.array(down(F.col("_s") + size - 1), down(F.col("_e") + 1) - size))))
    parent = F.call_function("shiftleft", F.call_function("shiftright", F.col("_b"), F.col("_k") + 1), F.col("_k") + 1)
    inside = (F.col("_b") >= F.col("_s")) & (F.col("_b") + size - 1 <= F.col("_e"))
    parent_in = (F.col("_k") < 32) & (parent >= F.col("_s")) & (parent + 2 * size - 1 <= F.col("_e"))
    return rows.where(inside & ~parent_in).select(*rest, F.col("_b").alias("start"), (32 - F.col("_k")).alias("len"), cidr_text(F.col("_b"), 32 - F.col("_k")).alias("cidr"))


def subtract(black: DataFrame, white: DataFrame, key: str = "ord") -> DataFrame:
    """What remains of each black range without all white ones: (key, start, len, cidr).

    Ranges inside a white one vanish; ranges that hold white ones give the cover of the gaps; the others stay. Rows of ``black`` are told apart by ``key``, so duplicates stay.

    One join and one window: a black range looks for white ones at each of its prefixes (those hold it) and, under its own prefix, for
    white ones that it holds; an end row behind its last address closes the last gap. A range without holes is one gap, whose cover is itself.
    """
    end = last_ip(F.col("start"), F.col("len"))
    base = black.select(key, "start", "len", end.alias("end"))
    probe = lambda kind, length: F.struct(F.lit(kind).alias("kind"), length.alias("l"), prefix_of(F.col("start"), length).alias("p"))
    up = F.transform(F.sequence(F.lit(0), F.col("len")), lambda n: probe(OUTER, n))
    probes = base.withColumn("_q", F.explode(F.concat(up, F.array(probe(INNER, F.col("len")), probe(LAST, F.col("len"))))))
    # a white range is found by its own prefix from inside, by its shorter ones from outside
    shorter = F.when(F.col("len") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("len") - 1, F.lit(0))), lambda n: probe(INNER, n))).otherwise(F.expr("array()"))
    keys = white.select("start", "len").distinct().withColumn("_k", F.explode(F.concat(F.array(probe(OUTER, F.col("len"))), shorter)))
    keys = keys.select("_k.kind", "_k.l", "_k.p", F.col("start").alias("w"), end.alias("wend"))
    same = (F.col("_q.kind") == F.col("kind")) & (F.col("_q.l") == F.col("l")) & (F.col("_q.p") == F.col("p"))
    hits = probes.join(keys, same, "left").where(F.col("w").isNotNull() | (F.col("_q.kind") == LAST))
    last, inner = F.col("_q.kind") == LAST, F.col("_q.kind") == INNER
    hits = hits.select(
        key, "start", (F.col("_q.kind") == OUTER).alias("gone"), F.when(last, F.col("end") + 1).when(inner, F.col("w")).alias("w"), F.when(inner, F.col("wend")).alias("wend"),
    )
    each = Window.partitionBy(key)
    before = each.orderBy("w", "wend").rowsBetween(Window.unboundedPreceding, -1)
    gaps = hits.withColumn("s", F.coalesce(F.max("wend").over(before) + 1, F.col("start"))).withColumn("gone", F.max("gone").over(each))
    rest = cover(gaps.where(~F.col("gone") & (F.col("s") < F.col("w"))).select(key, "s", (F.col("w") - 1).alias("e")), "s", "e")
    return rest.select(key, "start", "len", "cidr")


#: What a probe of :func:`subtract` looks for: white ranges that hold the black one, those that it holds, or nothing.
OUTER, INNER, LAST = 0, 1, 2
#: Ranges are dealt by this many leading bits. Distinct ranges below such a block are bounded; shorter ranges are put into each block that they touch.
BLOCK_BITS = 10


def _blocks(ranges: DataFrame, by: list[str]) -> DataFrame:
    """(*by, start, len, end, _b): distinct ranges, in every block that they touch."""
    rows = ranges.select(*by, "start", "len").distinct().withColumn("end", last_ip(F.col("start"), F.col("len")))
    return rows.withColumn("_b", F.explode(F.sequence(prefix_of(F.col("start"), BLOCK_BITS), prefix_of(F.col("end"), BLOCK_BITS))))


def remove_contained(ranges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Ranges that no other range of their group holds; equal ranges become one. A range is judged in its first block, where all that
    hold it are too."""
    return _outermost(ranges, by or []).drop("_b")


def _outermost(ranges: DataFrame, by: list[str]) -> DataFrame:
    before = Window.partitionBy(*by, "_b").orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)
    marked = _blocks(ranges, by).withColumn("_c", F.coalesce(F.max("end").over(before), F.lit(-1)))
    return marked.where((F.col("_c") < F.col("end")) & (F.col("_b") == prefix_of(F.col("start"), BLOCK_BITS))).drop("_c")


_ITEM = "struct<start:bigint,len:int,raw:boolean>"


def _sibling_fold(ranges: str) -> str:
    """SQL of one greedy pass from left to right over an array: a range that is the current one's sibling merges into their parent. A range that
    is itself merged (not ``raw``) can be the current one, but is not merged into the one before it: that is for the next pass."""
    sibling = "x.raw AND acc.cur.len = x.len AND x.len > 0 AND acc.cur.start + shiftleft(1L, 32 - x.len) = x.start AND pmod(acc.cur.start, shiftleft(2L, 32 - x.len)) = 0"
    parent = "named_struct('start', acc.cur.start, 'len', acc.cur.len - 1, 'raw', false)"
    return f"""aggregate({ranges}, named_struct('out', cast(array() AS array<{_ITEM}>), 'cur', cast(null AS {_ITEM})),
        (acc, x) -> CASE WHEN acc.cur IS NULL THEN named_struct('out', acc.out, 'cur', x) WHEN {sibling} THEN named_struct('out', acc.out, 'cur', {parent})
            ELSE named_struct('out', concat(acc.out, array(acc.cur)), 'cur', x) END,
        acc -> concat(acc.out, array(acc.cur)))"""


def _fold_groups(items: DataFrame, keys: list[str], group: Column) -> DataFrame:
    """The items (*keys, start, len, raw), folded within each group."""
    rows = items.groupBy(*keys, group.alias("_g")).agg(F.array_sort(F.collect_list(F.struct("start", "len", "raw"))).alias("_r"))
    return rows.select(*keys, F.explode(F.expr(_sibling_fold("_r"))).alias("_r")).select(*keys, "_r.start", "_r.len", "_r.raw")


#: A fold's array holds the ranges of a block of so many leading bits, longer than that and not longer than the number before: 4,096 at most.
FOLD_BITS = (21, BLOCK_BITS)


def _two_passes(rows: DataFrame, by: list[str]) -> DataFrame:
    """(*by, start, len) after two greedy passes over disjoint ranges (*by, _b, start, len) in order, the smallest blocks first.

    Only ranges of at most n bits have siblings outside their block of n leading bits; in a round they are groups of one. So both passes run
    inside blocks ``_b``, with no further shuffle, until ranges are as large as a block. Those that a block had after the first pass
    (``early``) then go through its end and the second pass, those that the second pass made through its end, in one row a group.
    """
    items = rows.select(*by, "_b", "start", "len", F.lit(True).alias("raw"))
    alone, large = -1 - F.col("start"), F.col("len") <= BLOCK_BITS  # starts are distinct
    for bits in FOLD_BITS:
        items = _fold_groups(items, [*by, "_b"], F.when(F.col("len") > bits, prefix_of(F.col("start"), bits)).otherwise(alone))
    items = items.withColumn("early", large).withColumn("raw", ~large | F.col("raw"))
    for bits in FOLD_BITS:
        items = _fold_groups(items, [*by, "_b", "early"], F.when(F.col("len") > bits, prefix_of(F.col("start"), bits)).otherwise(alone))
    group = F.when(large, F.lit(0).cast("bigint")).otherwise(alone).alias("_g")
    last = items.groupBy(*by, group).agg(F.array_sort(F.collect_list(F.struct("start", "len", "raw", "early"))).alias("_r"))
    item = "x -> named_struct('start', x.start, 'len', x.len, 'raw', {})"
    first = _sibling_fold(f"transform(filter(_r, x -> x.early), {item.format('x.raw')})")
    every = f"concat(transform(array_compact({first}), {item.format('true')}), transform(filter(_r, x -> NOT x.early), {item.format('x.raw')}))"
    return last.select(*by, F.explode(F.expr(_sibling_fold(f"array_sort({every})"))).alias("_r")).select(*by, "_r.start", "_r.len")


def merge(ranges: DataFrame, by: list[str] | None = None, canonical: bool = False) -> DataFrame:
    """(*by, start, len, cidr): without contained ranges, and with adjacent siblings merged in exactly two greedy passes,
    which is not a fixpoint. ``canonical`` gives the true least set instead.

    Siblings share all bits but their last, so a pass folds blocks of the address space by themselves; only ranges of at most
    ``BLOCK_BITS`` bits, some 2,000, meet in one row.
    """
    by = by or []
    if canonical:
        return cover(coalesce_spans(ranges, by), "start", "end").select(*by, "start", "len", "cidr")
    out = _two_passes(_outermost(ranges, by), by)
    return out.select(*by, "start", "len", cidr_text(F.col("start"), F.col("len")).alias("cidr"))


def coalesce_spans(ranges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(*by, start, end): disjoint, non-touching spans of all addresses of the ranges.

    Spans are formed block by block; those that touch an edge of their block, two a block at most, are then joined in one row a group.
    """
    by = by or []
    low = F.call_function("shiftleft", F.col("_b"), F.lit(32 - BLOCK_BITS))
    high = low + (1 << 32 - BLOCK_BITS) - 1
    spans = _blocks(ranges, by).select(*by, "_b", F.greatest("start", low).alias("start"), F.least("end", high).alias("end"))
    order = Window.partitionBy(*by, "_b").orderBy("start", "end")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    marked = spans.withColumn("_new", (F.coalesce(F.max("end").over(before), F.lit(-2)) + 1 < F.col("start")).cast("int"))
    marked = marked.withColumn("_i", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    own = marked.groupBy(*by, "_b", "_i").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    edge = (F.col("start") == low) | (F.col("end") == high)
    group = F.when(edge, F.lit(-1).cast("bigint")).otherwise(F.col("start")).alias("_g")
    joined = own.groupBy(*by, group).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_r"))
    return joined.withColumn("_r", F.explode(_join_touching(F.col("_r")))).select(*by, "_r.start", "_r.end")


def _join_touching(spans: Column) -> Column:
    """Ascending disjoint spans, those that touch made one."""
    kind = "struct<start:bigint,end:bigint>"
    start = F.expr(f"cast(struct(cast(array() as array<{kind}>), cast(null as {kind})) as struct<out:array<{kind}>,cur:{kind}>)")

    def step(acc: Column, x: Column) -> Column:
        c = acc["cur"]
        longer = F.struct(acc["out"].alias("out"), F.struct(c["start"].alias("start"), x["end"].alias("end")).alias("cur"))
        new = F.struct(F.concat(acc["out"], F.array(c)).alias("out"), x.alias("cur"))
        return F.when(c.isNull(), F.struct(acc["out"].alias("out"), x.alias("cur"))).when(c["end"] + 1 == x["start"], longer).otherwise(new)

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.array(acc["cur"])))


def _lengths(ranges: DataFrame) -> Column:
    """The distinct prefix lengths of a list, 33 at most, as an array that the plan itself finds out when it runs."""
    return F.coalesce(ranges.agg(F.collect_set("len")).scalar(), F.expr("cast(array() as array<int>)"))


def ips_in(ips: DataFrame, ranges: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of ``ips`` (column ip) that lie in a range, or with ``left_anti`` in none, by equi-joins on the list's own prefix lengths."""
    keyed = ranges.select(F.col("len").alias("_rl"), prefix_of(F.col("start"), F.col("len")).alias("_rp")).distinct()
    addresses = ips.select("ip").distinct().withColumn("_ls", _lengths(ranges)).select("ip", F.explode("_ls").alias("_l")).withColumn("_p", prefix_of(F.col("ip"), F.col("_l")))
    hit = addresses.join(keyed, (F.col("_l") == F.col("_rl")) & (F.col("_p") == F.col("_rp")), "left_semi").select(F.col("ip").alias("_hit")).distinct()
    return ips.join(hit, F.col("ip") == F.col("_hit"), how)


def range_counts(counts: DataFrame, ranges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """With ``requests``: those in each range, 0 for none. counts: (*by, ip, c); ranges: (*by, start, len, ...)."""
    by = by or []
    rows = counts.select(*by, "c", "ip", _lengths(ranges).alias("_ls")).select(*by, "c", "ip", F.explode("_ls").alias("_l"))
    nodes = rows.groupBy(*(F.col(b).alias(f"_{b}") for b in by), "_l", prefix_of(F.col("ip"), F.col("_l")).alias("_p")).agg(F.sum("c").alias("_n"))
    same = (F.col("len") == F.col("_l")) & (prefix_of(F.col("start"), F.col("len")) == F.col("_p"))
    for b in by:
        same = same & (F.col(b) == F.col(f"_{b}"))
    return ranges.join(nodes, same, "left").withColumn("requests", F.coalesce("_n", F.lit(0))).drop("_l", "_p", "_n", *(f"_{b}" for b in by))


def compose_ban_lists(active: DataFrame, manual: DataFrame, white: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Active bans and manual entries, both without whitelisted addresses: the whitelist always wins."""
    return subtract(active, white), subtract(manual, white)


def without(texts: DataFrame, white: DataFrame) -> DataFrame:
    """(cidr, ord, start): :func:`subtract_lists` of tables: what is left of each text, duplicates kept; ``ord`` and ``start`` have its order.

    texts: (cidr, ord). A range as long as the longest white one holds none: it stays or goes by a look at its first address.
    """
    text = F.col("cidr")
    # one split a row; ip_to_long and its kin look at the text's pattern again for each octet
    part = lambda k: F.get(F.split(F.translate(text, "/", "."), r"\."), F.lit(k)).try_cast("bigint")
    rows = texts.where(is_cidr(text)).select("cidr", "ord", mask(((part(0) * 256 + part(1)) * 256 + part(2)) * 256 + part(3), part(4).cast("int")).alias("ip"), part(4).cast("int").alias("len"))
    longest = F.coalesce(white.agg(F.max("len")).scalar(), F.lit(0))
    alone = F.col("len") >= longest
    other = texts.where(~is_cidr(text)).select("cidr", "ord", F.lit(0).cast("bigint").alias("start"))
    kept = ips_in(rows.where(alone), white, "left_anti")
    keyed = rows.where(~alone).select(F.struct("ord", "cidr", "ip", "len", F.monotonically_increasing_id().alias("row")).alias("_was"), F.col("ip").alias("start"), "len")
    left = subtract(keyed, white, "_was")
    whole = (F.col("start") == F.col("_was.ip")) & (F.col("len") == F.col("_was.len"))
    left = left.select(F.when(whole, F.col("_was.cidr")).otherwise(F.col("cidr")).alias("cidr"), F.col("_was.ord").alias("ord"), "start")
    return kept.select("cidr", "ord", F.col("ip").alias("start")).unionByName(left).unionByName(other)


# ---- the same on lists of the driver, for what is configuration or the small result of a job


def subtract_lists(black: list[str], white: list[str]) -> list[str]:
    """:func:`subtract` of texts, in order, duplicates kept; a text that is no range stays as it is, a white one that is none is skipped.

    White ranges are joined to disjoint spans first, and each black one looks up those that it meets by bisection.
    """
    from ipaddress import IPv4Address, summarize_address_range

    from ..functions.ip import parse_cidr

    def span(text: str) -> tuple[int, int] | None:
        try:
            s, n = parse_cidr(text)
        except ValueError:
            return None
        return s, s + (1 << 32 - n) - 1

    spans: list[tuple[int, int]] = []
    for s, e in sorted(x for w in white if (x := span(w))):
        if spans and s <= spans[-1][1] + 1:
            spans[-1] = spans[-1][0], max(e, spans[-1][1])
        else:
            spans.append((s, e))
    out = []
    for b in black:
        if not (own := span(b)):
            out.append(b)
            continue
        at, end = own
        k = bisect_left(spans, at, key=lambda x: x[1])
        if k == len(spans) or spans[k][0] > end:
            out.append(b)
            continue
        for s, e in [*takewhile(lambda x: x[0] <= end, islice(spans, k, None)), (end + 1, end + 1)]:
            if at < s:
                out += [str(r) for r in summarize_address_range(IPv4Address(at), IPv4Address(s - 1))]
            at = max(at, e + 1)
    return out


def merge_lists(ranges: list[tuple[int, int]], passes: int = 2) -> list[tuple[int, int]]:
    """:func:`merge` of (start, len) pairs."""
    kept, top = [], -1
    for s, n in sorted(ranges):
        if (end := s + (1 << 32 - n) - 1) > top:
            kept.append((s, n))
            top = end
    for _ in range(passes):
        out: list[tuple[int, int]] = []
        for s, n in kept:
            if out and out[-1][1] == n > 0 and out[-1][0] + (1 << 32 - n) == s and out[-1][0] % (2 << 32 - n) == 0:
                out[-1] = (out[-1][0], n - 1)
            else:
                out.append((s, n))
        kept = out
    return kept
