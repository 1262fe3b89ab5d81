"""Registered queries over the driver's tables, and for each its DuckDB counterpart, written independently.

The tables hold no addresses, so requests, log lines and ranges are derived (:mod:`rangeloom.sources.derived`). Times are compared as
epoch seconds.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ip as ipf
from ..operators import clusters, filters, jail, ranges, traffic
from ..sources import access_log, derived, logformat
from ..sources.derived import RANGES_SQL, REQUESTS_SQL
from ..streaming import window
from .config import Spec, TrieSpec
from . import static

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

SETS = [clusters.ClusterParams(20, 16, 24, 0.2, True), clusters.ClusterParams(5, 24, 32, 0.1), clusters.ClusterParams(100, 8, 24, 0.5, True)]
WATCHED = ["10.20.0.0/16", "192.168.0.0/18", "172.16.0.0/20", "40.0.0.0/8", "0.0.0.0/0", "10.20.1.77/32", "8.8.8.0/24", "203.0.113.0/25"]
START, END = datetime(2024, 1, 5, tzinfo=timezone.utc), datetime(2024, 1, 20, tzinfo=timezone.utc)
WHITE_UA, BLACK_UA = ["GOOGLEBOT/2.1 (+http://example.com/bot)", "# comment", ""], ['badbot/1.0 \\"scan\\"', "curl/8.5.0"]


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def _counts(spark: SparkSession, sf: str, where=None) -> DataFrame:
    r = derived.requests(spark, sf)
    rows = r if where is None else r.where(where)
    return clusters.ip_counts(rows.withColumn("trie", F.lit("all")), ["trie"])


def _ip_sql(x: str) -> str:
    return f"(({x}) >> 24) || '.' || ((({x}) >> 16) & 255) || '.' || ((({x}) >> 8) & 255) || '.' || (({x}) & 255)"


def _walk_sql(sets: list[clusters.ClusterParams], where: str = "TRUE") -> str:
    """CTEs counts, node and found(set_idx, d, p, n): the rule as a walk from the root, one level after another."""
    rows = ", ".join(f"({k}, {s.min_size}, {s.min_depth}, {s.max_depth}, {s.threshold})" for k, s in enumerate(sets))
    return f"""
    counts AS (SELECT ip, count(*) AS c FROM base WHERE ip <> 0 AND {where} GROUP BY ip),
    node AS (SELECT d, ip >> (32 - d) AS p, sum(c) AS n FROM counts, (SELECT unnest(range(0, 33)) AS d) GROUP BY ALL),
    kids AS (
        SELECT a.d, a.p, a.n, coalesce(l.n, 0) AS l, coalesce(r.n, 0) AS r FROM node a
        LEFT JOIN node l ON l.d = a.d + 1 AND l.p = 2 * a.p LEFT JOIN node r ON r.d = a.d + 1 AND r.p = 2 * a.p + 1),
    params(set_idx, m, lo, hi, t) AS (VALUES {rows}),
    walk AS (
        SELECT set_idx, m, lo, hi, t, CAST(0 AS BIGINT) AS d, CAST(0 AS BIGINT) AS p, CAST(0 AS HUGEINT) AS n, l, r, FALSE AS hit FROM params, kids WHERE d = 0
        UNION ALL
        SELECT w.set_idx, w.m, w.lo, w.hi, w.t, k.d, k.p, k.n, k.l, k.r,
            k.n >= w.m AND (k.d = w.hi OR (k.d >= w.lo AND k.l > 0 AND k.r > 0 AND (k.l = k.r OR 2000 * abs(k.l - k.r) < w.t * k.n)))
        FROM walk w JOIN kids k ON k.d = w.d + 1 AND k.p >> 1 = w.p WHERE NOT w.hit AND w.d < w.hi AND k.n >= w.m),
    found AS (SELECT set_idx, CAST(d AS INTEGER) AS len, p << (32 - d) AS start, CAST(n AS BIGINT) AS requests FROM walk WHERE hit)"""


def _found(df: DataFrame, counts: DataFrame) -> DataFrame:
    return clusters.with_percentage(df, counts).select("set_idx", "cidr", "requests", F.round("percentage", 6).alias("percentage"))


_FOUND = f"""SELECT CAST(set_idx AS INTEGER) AS set_idx, {_ip_sql('start')} || '/' || len AS cidr, requests, round(100.0 * requests / (SELECT sum(c) FROM counts), 6) AS percentage FROM found"""


@query(f"WITH RECURSIVE {REQUESTS_SQL}, {_walk_sql(SETS[:1])} {_FOUND}")
def cluster_detect(spark: SparkSession, sf: str) -> DataFrame:
    counts = _counts(spark, sf)
    return _found(clusters.detect_clusters(counts, {"all": SETS[:1]}), counts)


@query(f"WITH RECURSIVE {REQUESTS_SQL}, {_walk_sql(SETS)} {_FOUND}")
def cluster_multi_set(spark: SparkSession, sf: str) -> DataFrame:
    counts = _counts(spark, sf)
    return _found(clusters.detect_clusters(counts, {"all": SETS}), counts)


_FILTERED = "user_agent LIKE 'Mozilla%' AND regexp_matches(uri, '^/(error|click)/')"


@query(f"WITH RECURSIVE {REQUESTS_SQL}, {_walk_sql(SETS[:2], _FILTERED)} {_FOUND}")
def cluster_filtered(spark: SparkSession, sf: str) -> DataFrame:
    counts = _counts(spark, sf, filters.matches("^Mozilla", "^/(error|click)/"))
    return _found(clusters.detect_clusters(counts, {"all": SETS[:2]}), counts)


def _fold_sql(source: str, name: str) -> str:
    """One greedy pass over ordered ranges (set_idx, i, start, len) of ``source``, as a recursion over places."""
    return f"""
    {name}_f AS (
        SELECT set_idx, i, start AS cs, len AS cl, CAST(NULL AS BIGINT) AS os, CAST(NULL AS INTEGER) AS ol FROM {source} WHERE i = 1
        UNION ALL
        SELECT x.set_idx, x.i,
            CASE WHEN f.cl = x.len AND f.cl > 0 AND f.cs + (CAST(1 AS BIGINT) << (32 - f.cl)) = x.start AND f.cs % (CAST(2 AS BIGINT) << (32 - f.cl)) = 0 THEN f.cs ELSE x.start END,
            CASE WHEN f.cl = x.len AND f.cl > 0 AND f.cs + (CAST(1 AS BIGINT) << (32 - f.cl)) = x.start AND f.cs % (CAST(2 AS BIGINT) << (32 - f.cl)) = 0 THEN f.cl - 1 ELSE x.len END,
            CASE WHEN f.cl = x.len AND f.cl > 0 AND f.cs + (CAST(1 AS BIGINT) << (32 - f.cl)) = x.start AND f.cs % (CAST(2 AS BIGINT) << (32 - f.cl)) = 0 THEN NULL ELSE f.cs END,
            CASE WHEN f.cl = x.len AND f.cl > 0 AND f.cs + (CAST(1 AS BIGINT) << (32 - f.cl)) = x.start AND f.cs % (CAST(2 AS BIGINT) << (32 - f.cl)) = 0 THEN NULL ELSE f.cl END
        FROM {name}_f f JOIN {source} x ON x.set_idx = f.set_idx AND x.i = f.i + 1),
    {name}_out AS (
        SELECT set_idx, os AS start, ol AS len FROM {name}_f WHERE os IS NOT NULL
        UNION ALL SELECT set_idx, arg_max(cs, i), arg_max(cl, i) FROM {name}_f GROUP BY set_idx),
    {name} AS (SELECT set_idx, start, len, row_number() OVER (PARTITION BY set_idx ORDER BY start) AS i FROM {name}_out)"""


@query(f"""WITH RECURSIVE {REQUESTS_SQL}, {_walk_sql(SETS)},
    zero AS (SELECT set_idx, start, len, row_number() OVER (PARTITION BY set_idx ORDER BY start) AS i FROM found), {_fold_sql('zero', 'one')}, {_fold_sql('one', 'two')}
    SELECT CAST(set_idx AS INTEGER) AS set_idx, {_ip_sql('start')} || '/' || len AS cidr,
        CAST((SELECT sum(c) FROM counts WHERE ip BETWEEN start AND start + (CAST(1 AS BIGINT) << (32 - len)) - 1) AS BIGINT) AS requests FROM two""")
def cluster_merge(spark: SparkSession, sf: str) -> DataFrame:
    counts = _counts(spark, sf)
    merged = ranges.merge(clusters.detect_clusters(counts, {"all": SETS}), ["trie", "set_idx"])
    return ranges.range_counts(counts, merged, ["trie"]).select("set_idx", "cidr", "requests")


@query(f"""WITH {REQUESTS_SQL},
    w(cidr, start, len) AS (VALUES {", ".join(f"('{c}', {ipf.parse_cidr(c)[0]}, {ipf.parse_cidr(c)[1]})" for c in WATCHED)})
    SELECT cidr, count(ip) AS requests, round(100.0 * count(ip) / (SELECT count(*) FROM base WHERE ip <> 0), 6) AS percentage
    FROM w LEFT JOIN (SELECT ip FROM base WHERE ip <> 0) ON ip BETWEEN start AND start + (CAST(1 AS BIGINT) << (32 - len)) - 1 GROUP BY cidr""")
def cidr_range_report(spark: SparkSession, sf: str) -> DataFrame:
    counts = _counts(spark, sf)
    listed = ranges.parse(spark.createDataFrame([(c,) for c in WATCHED + ["not a range", "1.2.3.4"]], "cidr string")).withColumn("trie", F.lit("all"))
    got = clusters.with_percentage(ranges.range_counts(counts, listed, ["trie"]), counts)
    return got.select("cidr", "requests", F.round("percentage", 6).alias("percentage"))


@query(f"WITH {REQUESTS_SQL} SELECT count(DISTINCT ip) AS unique_ips FROM base WHERE ip <> 0")
def unique_ips(spark: SparkSession, sf: str) -> DataFrame:
    return traffic.unique_ips(derived.requests(spark, sf))


_CELLS = "cells AS (SELECT CAST(ip >> 24 AS INTEGER) AS a, CAST((ip >> 16) & 255 AS INTEGER) AS b, count(*) AS cnt FROM base WHERE ip <> 0 GROUP BY ALL)"


@query(f"WITH {REQUESTS_SQL}, {_CELLS} SELECT * FROM cells")
def heatmap16(spark: SparkSession, sf: str) -> DataFrame:
    return traffic.matrix(derived.requests(spark, sf))


@query(f"WITH {REQUESTS_SQL}, {_CELLS} SELECT a // 8 AS ba, b // 8 AS bb, CAST(sum(cnt) AS BIGINT) AS cnt FROM cells GROUP BY ALL")
def heatmap_block8(spark: SparkSession, sf: str) -> DataFrame:
    return traffic.blocks(traffic.matrix(derived.requests(spark, sf)))


_INSIDE = "inside AS (SELECT CAST(ip >> 24 AS INTEGER) AS a, CAST((ip >> 16) & 255 AS INTEGER) AS b, count(*) AS cnt FROM base WHERE ip <> 0 AND EXISTS (SELECT 1 FROM found WHERE ip BETWEEN start AND start + (CAST(1 AS BIGINT) << (32 - len)) - 1) GROUP BY ALL)"


def _detected(spark: SparkSession, sf: str, sets=SETS[1:2]) -> DataFrame:
    return clusters.detect_clusters(_counts(spark, sf), {"all": list(sets)})


@query(f"WITH RECURSIVE {REQUESTS_SQL}, {_walk_sql(SETS[1:2])}, {_INSIDE} SELECT * FROM inside")
def clustered_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    return traffic.clustered_matrix(derived.requests(spark, sf), ranges.merge(_detected(spark, sf)))


@query(f"""WITH RECURSIVE {REQUESTS_SQL}, {_walk_sql(SETS[1:2])}, {_INSIDE}, {_CELLS}, j AS (
    SELECT c.a, c.b, c.cnt, coalesce(i.cnt, 0) AS clustered, coalesce(i.cnt, 0) / c.cnt AS q FROM cells c LEFT JOIN inside i USING (a, b))
    SELECT a, b, cnt, clustered, round(q, 6) AS ratio, CASE WHEN q >= 0.8 THEN '●' WHEN q >= 0.2 THEN '•' WHEN q > 0 THEN '·' ELSE '' END AS marker FROM j""")
def capture_ratio(spark: SparkSession, sf: str) -> DataFrame:
    r = derived.requests(spark, sf)
    got = traffic.capture(traffic.matrix(r), traffic.clustered_matrix(r, _detected(spark, sf)))
    return got.withColumn("ratio", F.round("ratio", 6))


def _scaled(cells: DataFrame) -> DataFrame:
    out = None
    for how in ("linear", "sqrt", "log"):
        one = traffic.intensity(cells, how).select(F.lit(how).alias("how"), "a", "b", F.round("intensity", 6).alias("intensity"), "bucket")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {REQUESTS_SQL}, {_CELLS}, t AS (SELECT max(cnt) AS top FROM cells),
    s AS (SELECT 'linear' AS how, a, b, cnt / top AS x FROM cells, t UNION ALL SELECT 'sqrt', a, b, sqrt(cnt / top) FROM cells, t UNION ALL SELECT 'log', a, b, ln(1 + cnt) / ln(1 + top) FROM cells, t)
    SELECT how, a, b, round(x, 6) AS intensity, CAST(least(floor(x * 10), 9) AS INTEGER) AS bucket FROM s""")
def traffic_intensity(spark: SparkSession, sf: str) -> DataFrame:
    return _scaled(traffic.matrix(derived.requests(spark, sf)))


@query(f"WITH {REQUESTS_SQL} SELECT {_ip_sql('ip')} AS ip, count(*) AS requests FROM base WHERE base.ip <> 0 GROUP BY base.ip ORDER BY requests DESC, base.ip LIMIT 10")
def top_talkers(spark: SparkSession, sf: str) -> DataFrame:
    counts = clusters.ip_counts(derived.requests(spark, sf))
    return traffic.top_talkers(counts, 10).select(ipf.long_to_ip(F.col("ip")).alias("ip"), F.col("c").alias("requests"))


@query(f"""WITH {REQUESTS_SQL}, c AS (SELECT kind, ip, count(*) AS requests FROM base WHERE ip <> 0 GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY requests DESC, ip) AS rank FROM c)
    SELECT kind, ip, requests, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""")
def top_talkers_by_window(spark: SparkSession, sf: str) -> DataFrame:
    r = derived.requests(spark, sf).withColumn("kind", F.split("uri", "/")[1])
    return traffic.top_talkers_by(clusters.ip_counts(r, ["kind"]), 3, ["kind"]).select("kind", "ip", F.col("c").alias("requests"), "rank")


_ROW = "ip, t AS epoch, method, uri, status, bytes, user_agent, bad_status, bad_bytes"


@query(f"WITH {REQUESTS_SQL} SELECT {_ROW} FROM base")
def parse_combined_log(spark: SparkSession, sf: str) -> DataFrame:
    rows = logformat.parse_lines(derived.lines(spark, sf), derived.COMBINED)
    return rows.select("ip", F.unix_timestamp("ts").alias("epoch"), "method", "uri", "status", "bytes", "user_agent", "bad_status", "bad_bytes")


@query(f"WITH {REQUESTS_SQL} SELECT ip, count(*) AS n FROM base GROUP BY ip")
def parse_ip_only(spark: SparkSession, sf: str) -> DataFrame:
    return logformat.parse_lines(derived.lines(spark, sf), derived.COMBINED, ["ip"]).groupBy("ip").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {REQUESTS_SQL} SELECT count(*) FILTER (bad_status) AS malformed_status, count(*) FILTER (bad_bytes) AS malformed_bytes, count(*) FILTER (ip = 0) AS invalid_ips, count(*) AS total FROM base")
def parse_malformed_counts(spark: SparkSession, sf: str) -> DataFrame:
    return access_log.malformed_counts(logformat.parse_lines(derived.lines(spark, sf), derived.COMBINED)).select(*(F.col(c).cast("bigint") for c in ("malformed_status", "malformed_bytes", "invalid_ips", "total")))


@query(f"""WITH {REQUESTS_SQL} SELECT event_id, ip, t - 7200 AS epoch, method, uri, status, bytes, user_agent,
    CAST(bad_status AS INTEGER) + CAST(bad_bytes AS INTEGER) AS malformed FROM base WHERE ip <> 0""")
def parse_live_events(spark: SparkSession, sf: str) -> DataFrame:
    message = F.replace(F.replace(F.col("value"), F.lit('\\"'), F.lit("'")), F.lit("+0000]"), F.lit("+0200]"))
    rows = access_log.parse_live(derived.lines(spark, sf).select("event_id", message.alias("message"))).where(~F.col("parse_error"))
    agent = F.replace(F.col("user_agent"), F.lit("'"), F.lit('\\"'))
    return rows.select("event_id", "ip", F.unix_timestamp("ts").alias("epoch"), "method", "uri", "status", "bytes", agent.alias("user_agent"), "malformed")


@query(f"WITH {REQUESTS_SQL} SELECT event_id, ip FROM base WHERE t BETWEEN {int(START.timestamp())} AND {int(END.timestamp())}")
def time_filter(spark: SparkSession, sf: str) -> DataFrame:
    return filters.select_requests(derived.requests(spark, sf), START, END).select("event_id", "ip")


@query(f"WITH {REQUESTS_SQL} SELECT event_id FROM base WHERE regexp_matches(user_agent, '(?i)bot/[0-9]+\\.[0-9]')")
def ua_regex_filter(spark: SparkSession, sf: str) -> DataFrame:
    return filters.select_requests(derived.requests(spark, sf), user_agent_regex=r"(?i)bot/[0-9]+\.[0-9]").select("event_id")


@query(f"WITH {REQUESTS_SQL} SELECT event_id FROM base WHERE regexp_matches(uri, '^/(view|purchase)/item[1-3]$')")
def endpoint_regex_filter(spark: SparkSession, sf: str) -> DataFrame:
    return filters.select_requests(derived.requests(spark, sf), endpoint_regex="^/(view|purchase)/item[1-3]$").select("event_id")


@query(f"WITH {REQUESTS_SQL} SELECT event_id FROM base WHERE contains(uri, 'signup') OR contains(uri, 'error')")
def literal_regex_filter(spark: SparkSession, sf: str) -> DataFrame:
    return filters.select_requests(derived.requests(spark, sf), endpoint_regex="signup|error").select("event_id")


@query(r"SELECT page_id FROM pages WHERE regexp_matches(url, '/(en|de)/[0-9]+(\?page=[0-9]+.*)?$') AND contains(url, 'example.com')")
def page_url_regex(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.regex import gate

    p = spark.read.parquet(f"{sf}/pages.parquet")
    return p.where(gate(F.col("url"), r"/(en|de)/[0-9]+(\?page=[0-9]+.*)?$") & gate(F.col("url"), r"example\.com")).select("page_id")


_CLASS = "CASE WHEN lower(user_agent) = 'googlebot/2.1 (+http://example.com/bot)' THEN 1 WHEN lower(user_agent) IN ('badbot/1.0 \\\"scan\\\"', 'curl/8.5.0') THEN -1 ELSE 0 END"


def _classified(spark: SparkSession, sf: str) -> DataFrame:
    return filters.classify_agents(derived.requests(spark, sf), WHITE_UA, BLACK_UA)


@query(f"WITH {REQUESTS_SQL} SELECT event_id, {_CLASS} AS ua_class FROM base")
def ua_list_classify(spark: SparkSession, sf: str) -> DataFrame:
    return _classified(spark, sf).select("event_id", "ua_class")


@query(f"WITH {REQUESTS_SQL} SELECT DISTINCT ip FROM base WHERE ip <> 0 AND {_CLASS} = -1")
def ua_blacklist_ips(spark: SparkSession, sf: str) -> DataFrame:
    return filters.agent_ips(_classified(spark, sf), -1)


@query(f"WITH {REQUESTS_SQL} SELECT DISTINCT ip FROM base WHERE ip <> 0 AND {_CLASS} = 1")
def ua_whitelist_ips(spark: SparkSession, sf: str) -> DataFrame:
    return filters.agent_ips(_classified(spark, sf), 1)


def _specs() -> Spec:
    return Spec(tries={
        "agents": TrieSpec(user_agent_regex="curl|Mozilla", sets=SETS[:2]), "all": TrieSpec(sets=SETS), "posts": TrieSpec(endpoint_regex="^/(signup|purchase)/", sets=SETS[1:2]),
        "week": TrieSpec(start=START, end=END, sets=SETS[:1]),
    })


def _trie_where(name: str) -> str:
    return {"agents": "regexp_matches(user_agent, 'curl|Mozilla')", "all": "TRUE", "posts": "regexp_matches(uri, '^/(signup|purchase)/')", "week": f"t BETWEEN {int(START.timestamp())} AND {int(END.timestamp())}"}[name]


def _multi_sql() -> str:
    parts = []
    for name, t in _specs().tries.items():
        parts.append(f"SELECT * FROM (WITH RECURSIVE {REQUESTS_SQL}, {_walk_sql(t.sets, _trie_where(name))} SELECT '{name}' AS trie, CAST(set_idx AS INTEGER) AS set_idx, {_ip_sql('start')} || '/' || len AS cidr, requests FROM found)")
    return " UNION ALL ".join(parts)


@query(_multi_sql())
def multi_trie_detect(spark: SparkSession, sf: str) -> DataFrame:
    return static.plan(derived.requests(spark, sf), _specs()).detected.select("trie", "set_idx", "cidr", "requests")


@query(" UNION ALL ".join(f"SELECT * FROM (WITH {REQUESTS_SQL} SELECT '{n}' AS trie, count(*) FILTER (ip <> 0) AS requests, count(DISTINCT CASE WHEN ip <> 0 THEN ip END) AS unique_ips, count(*) FILTER (ip = 0) AS invalid FROM base WHERE {_trie_where(n)})" for n in ("agents", "all", "posts", "week")))
def multi_trie_stats(spark: SparkSession, sf: str) -> DataFrame:
    return static.stats(static.tally(derived.requests(spark, sf), _specs())).select("trie", "requests", "unique_ips", "invalid")


@query(f"WITH {REQUESTS_SQL}, o AS (SELECT ip, {_ip_sql('ip')} AS text FROM (SELECT DISTINCT ip FROM base)) SELECT ip, text, ip AS back FROM o")
def ip_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    rows = derived.requests(spark, sf).select("ip").distinct().withColumn("text", ipf.long_to_ip(F.col("ip")))
    return rows.withColumn("back", ipf.ip_to_long(F.col("text")))


_SPANS = "sp AS (SELECT o_orderkey AS ord, 3000000000 + (o_orderkey * 7919) % 100000000 AS s, 3000000000 + (o_orderkey * 7919) % 100000000 + (o_custkey * 31) % 70000 - 50 AS e FROM orders)"


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    start = 3000000000 + (k * 7919) % 100000000
    return spark.read.parquet(f"{sf}/orders.parquet").select(k.alias("ord"), start.alias("start"), (start + (c * 31) % 70000 - 50).alias("end"))


def _cover_sql(source: str) -> str:
    """Greedy cover of spans (ord, s, e): the largest aligned block that fits, again and again."""
    size = "CAST(1 AS BIGINT) << CAST(least(CASE WHEN s = 0 THEN 32 ELSE bit_count((s & -s) - 1) END, floor(log2(e - s + 1))) AS INTEGER)"
    return f"""cov AS (
        SELECT ord, s AS low, {size} AS size, e FROM {source} WHERE s <= e
        UNION ALL SELECT ord, s, {size}, e FROM (SELECT ord, low + size AS s, e FROM cov WHERE low + size <= e))"""


@query(f"WITH RECURSIVE {_SPANS}, {_cover_sql('sp')} SELECT ord, {_ip_sql('low')} || '/' || CAST(32 - log2(size) AS INTEGER) AS cidr FROM cov")
def cidr_cover(spark: SparkSession, sf: str) -> DataFrame:
    return ranges.cover(_spans(spark, sf)).select("ord", "cidr")


@query(f"WITH {_SPANS} SELECT ord, CAST(32 - least(bit_count((s & -s) - 1), floor(log2(e - s + 1))) AS INTEGER) AS len FROM sp WHERE s <= e")
def largest_block(spark: SparkSession, sf: str) -> DataFrame:
    rows = _spans(spark, sf).where("start <= end")
    return rows.select("ord", ipf.largest_block(F.col("start"), F.col("end") - F.col("start") + 1).cast("int").alias("len"))


def _black_white(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Ranges of all customers, and of all suppliers."""
    return derived.ranges(spark, sf), derived.supplier_ranges(spark, sf, 22, 7)


_BW = f"{RANGES_SQL}, bl AS (SELECT * FROM rg), {derived.supplier_ranges_sql('wh', 22, 7)}"
_GAPS = """
    hits AS (SELECT b.ord, b.start, b."end", greatest(w.start, b.start) AS ws, least(w."end", b."end") AS we FROM bl b JOIN wh w ON w."end" >= b.start AND w.start <= b."end"),
    ends AS (SELECT ord, start, "end", ws, we FROM hits UNION ALL SELECT DISTINCT ord, start, "end", "end" + 1, "end" + 1 FROM hits),
    gaps AS (SELECT ord, coalesce(max(we) OVER (PARTITION BY ord ORDER BY ws, we ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, start) AS s, ws - 1 AS e FROM ends)"""
_REMOVED = f"""SELECT ord, {_ip_sql('low')} || '/' || CAST(32 - log2(size) AS INTEGER) AS cidr FROM cov
    UNION ALL SELECT ord, {_ip_sql('start')} || '/' || len FROM bl WHERE ord NOT IN (SELECT ord FROM hits)"""


@query(f"WITH RECURSIVE {_BW}, {_GAPS}, {_cover_sql('gaps')} {_REMOVED}")
def cidr_subtract(spark: SparkSession, sf: str) -> DataFrame:
    black, white = _black_white(spark, sf)
    return ranges.subtract(black, white).select("ord", "cidr")


@query(f"WITH RECURSIVE {_BW}, {_GAPS}, {_cover_sql('gaps')}, rest AS ({_REMOVED}) SELECT cidr, count(*) AS n FROM rest GROUP BY cidr")
def remove_whitelisted(spark: SparkSession, sf: str) -> DataFrame:
    black, white = _black_white(spark, sf)
    active, _ = ranges.compose_ban_lists(black, black.limit(0), white)
    return active.groupBy("cidr").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {RANGES_SQL}, {derived.supplier_ranges_sql('outside', 17, 7)}
    SELECT ord, {_ip_sql('start')} || '/' || len AS cidr FROM rg b WHERE EXISTS (SELECT 1 FROM outside w WHERE w.start <= b.start AND w."end" >= b."end")""")
def range_containment(spark: SparkSession, sf: str) -> DataFrame:
    outer = derived.supplier_ranges(spark, sf, 17, 7)
    return ranges.contained(derived.ranges(spark, sf), outer).select("ord", ipf.cidr_text(F.col("start"), F.col("len")).alias("cidr"))


@query(f"""WITH {RANGES_SQL}, u AS (SELECT DISTINCT start, len, "end" FROM rg)
    SELECT {_ip_sql('start')} || '/' || len AS cidr FROM u a WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b.len < a.len AND b.start <= a.start AND b."end" >= a."end")""")
def remove_contained(spark: SparkSession, sf: str) -> DataFrame:
    return ranges.remove_contained(derived.ranges(spark, sf)).select(ipf.cidr_text(F.col("start"), F.col("len")).alias("cidr"))


@query(f"""WITH RECURSIVE {RANGES_SQL}, u AS (SELECT DISTINCT start, len, "end" FROM rg),
    top AS (SELECT start, len FROM u a WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b.len < a.len AND b.start <= a.start AND b."end" >= a."end")),
    zero AS (SELECT 0 AS set_idx, start, len, row_number() OVER (ORDER BY start) AS i FROM top), {_fold_sql('zero', 'one')}, {_fold_sql('one', 'two')}
    SELECT {_ip_sql('start')} || '/' || len AS cidr FROM two""")
def merge_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return ranges.merge(derived.ranges(spark, sf)).select("cidr")


_ISLANDS = """
    m AS (SELECT start, "end", CASE WHEN coalesce(max("end") OVER (ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -2) + 1 < start THEN 1 ELSE 0 END AS fresh FROM rg),
    isl AS (SELECT min(start) AS start, max("end") AS "end" FROM (SELECT *, sum(fresh) OVER (ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS i FROM m) GROUP BY i)"""


@query(f'WITH {RANGES_SQL}, {_ISLANDS} SELECT start, "end" FROM isl')
def interval_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    return ranges.coalesce_spans(derived.ranges(spark, sf))


@query(f"""WITH RECURSIVE {RANGES_SQL}, {_ISLANDS}, sp AS (SELECT start AS ord, start AS s, "end" AS e FROM isl), {_cover_sql('sp')}
    SELECT {_ip_sql('low')} || '/' || CAST(32 - log2(size) AS INTEGER) AS cidr FROM cov""")
def merge_canonical(spark: SparkSession, sf: str) -> DataFrame:
    return ranges.merge(derived.ranges(spark, sf), canonical=True).select("cidr")


@query(f"WITH {RANGES_SQL}, ips AS (SELECT DISTINCT 167772160 + (o_custkey * 2741) % 5000000 AS ip FROM orders) SELECT ip FROM ips WHERE EXISTS (SELECT 1 FROM rg WHERE ip BETWEEN start AND \"end\")")
def ip_in_ranges(spark: SparkSession, sf: str) -> DataFrame:
    ips = spark.read.parquet(f"{sf}/orders.parquet").select((167772160 + (F.col("o_custkey") * 2741) % 5000000).alias("ip")).distinct()
    return ranges.ips_in(ips, derived.ranges(spark, sf))


_NOW = datetime(2024, 1, 25, tzinfo=timezone.utc)
_BOUND = timedelta(days=12)


def _queue(spark: SparkSession, sf: str) -> DataFrame:
    return derived.requests(spark, sf).where("ip <> 0").select("seq", "ip", "ts")


_HEAD = f"q AS (SELECT seq, ip, t FROM base WHERE ip <> 0), live AS (SELECT * FROM q WHERE seq >= (SELECT min(seq) FROM q WHERE t >= {int((_NOW - _BOUND).timestamp())}))"


@query(f"WITH {REQUESTS_SQL}, {_HEAD} SELECT seq, ip FROM live")
def window_evict_time(spark: SparkSession, sf: str) -> DataFrame:
    return window.evict_old(_queue(spark, sf), _NOW, _BOUND).select("seq", "ip")


@query(f"WITH {REQUESTS_SQL}, {_HEAD} SELECT seq, ip FROM live ORDER BY seq DESC LIMIT 300")
def window_evict_size(spark: SparkSession, sf: str) -> DataFrame:
    return window.evict(_queue(spark, sf), _NOW, _BOUND, 300).select("seq", "ip")


@query(f"""WITH {REQUESTS_SQL}, g AS (SELECT ip, seq, t, t - lag(t) OVER (PARTITION BY ip ORDER BY seq) AS gap FROM base WHERE ip <> 0)
    SELECT ip, arg_max(t, seq) AS last, CAST(coalesce(string_agg(CAST(gap AS BIGINT), ',' ORDER BY seq), '') AS VARCHAR) AS deltas, count(*) AS n FROM g GROUP BY ip""")
def inter_arrival(spark: SparkSession, sf: str) -> DataFrame:
    got = traffic.inter_arrival(_queue(spark, sf))
    return got.select("ip", F.unix_timestamp("last").alias("last"), F.concat_ws(",", F.transform("deltas", lambda x: x.cast("bigint").cast("string"))).alias("deltas"), F.col("count").alias("n"))


def _prisoners(spark: SparkSession, sf: str) -> DataFrame:
    """A register's table, from orders: five cells, some bans off."""
    k = F.col("o_orderkey")
    start = F.timestamp_seconds(F.lit(1704067200) + (k * 977) % 2000000)
    return spark.read.parquet(f"{sf}/orders.parquet").select((1 + k % 5).cast("int").alias("cell_id"), F.concat(ipf.long_to_ip(F.lit(1 << 30).cast("bigint") + k), F.lit("/32")).alias("cidr"), start.alias("ban_start"), (k % 4 != 0).alias("ban_active"))


_JAILED = f"""pr AS (SELECT CAST(1 + o_orderkey % 5 AS INTEGER) AS cell_id, {_ip_sql('(1073741824 + o_orderkey)')} || '/32' AS cidr, 1704067200 + (o_orderkey * 977) % 2000000 AS s, o_orderkey % 4 <> 0 AS on_ FROM orders),
    du(cell_id, secs) AS (VALUES {", ".join(f"({k}, {int(d.total_seconds())})" for k, (_, d) in enumerate(jail.STAGES, 1))})"""


@query(f"WITH {_JAILED} SELECT cell_id, count(*) FILTER (on_) AS active FROM pr GROUP BY cell_id")
def jail_stage_counts(spark: SparkSession, sf: str) -> DataFrame:
    return jail.stage_counts(_prisoners(spark, sf))


@query(f"WITH {_JAILED} SELECT cidr, cell_id AS stage, s AS ban_start, s + secs AS expires_at FROM pr JOIN du USING (cell_id) WHERE on_ AND 1704700800 <= s + secs")
def active_bans_meta(spark: SparkSession, sf: str) -> DataFrame:
    cells = spark.createDataFrame([(k, int(d.total_seconds())) for k, (_, d) in enumerate(jail.STAGES, 1)], "cell_id int, seconds long")
    got = jail.active_bans(_prisoners(spark, sf), datetime.fromtimestamp(1704700800, timezone.utc), cells)
    return got.select("cidr", "stage", F.unix_timestamp("ban_start").alias("ban_start"), F.unix_timestamp("expires_at").alias("expires_at"))


@query(f"""WITH RECURSIVE {REQUESTS_SQL}, {_walk_sql(SETS)} SELECT {_ip_sql('start')} || '/' || len AS cidr, count(*) AS sets, CAST(sum(requests) AS BIGINT) AS requests FROM found GROUP BY start, len""")
def detections_union(spark: SparkSession, sf: str) -> DataFrame:
    return _detected(spark, sf, SETS).groupBy("cidr").agg(F.count(F.lit(1)).alias("sets"), F.sum("requests").alias("requests"))


@query(f"WITH {REQUESTS_SQL} SELECT method, status, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM base GROUP BY ALL")
def requests_by_method_status(spark: SparkSession, sf: str) -> DataFrame:
    return derived.requests(spark, sf).groupBy("method", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))


@query(f"WITH {REQUESTS_SQL} SELECT CAST(ip >> 24 AS INTEGER) AS a, format('{{:,}}', count(*)) AS shown FROM base WHERE ip <> 0 GROUP BY ALL")
def formatted_numbers(spark: SparkSession, sf: str) -> DataFrame:
    got = derived.requests(spark, sf).where("ip <> 0").groupBy(F.shiftright("ip", 24).cast("int").alias("a")).agg(F.count(F.lit(1)).alias("n"))
    return got.select("a", F.format_number("n", 0).alias("shown"))


@query("SELECT 167772160 + (l_orderkey * 48271 + l_linenumber * 97) % 16777216 AS ip, count(*) AS c FROM lineitem GROUP BY ALL")
def ip_counts_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.ip_counts(_line_requests(spark, sf))


def _line_requests(spark: SparkSession, sf: str) -> DataFrame:
    """The largest table as requests: one network of 16 million addresses."""
    ip = 167772160 + (F.col("l_orderkey") * 48271 + F.col("l_linenumber") * 97) % 16777216
    return spark.read.parquet(f"{sf}/lineitem.parquet").select(ip.cast("bigint").alias("ip"))


_LINES_SETS = [clusters.ClusterParams(20, 8, 24, 0.05), clusters.ClusterParams(3, 12, 30, 0.2)]


@query("WITH RECURSIVE base AS (SELECT 167772160 + (l_orderkey * 48271 + l_linenumber * 97) % 16777216 AS ip FROM lineitem), " + _walk_sql(_LINES_SETS) + " " + _FOUND)
def cluster_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    counts = clusters.ip_counts(_line_requests(spark, sf).withColumn("trie", F.lit("all")), ["trie"])
    return _found(clusters.detect_clusters(counts, {"all": _LINES_SETS}), counts)
