"""Requests, log lines and ranges derived from the driver's tables by integer arithmetic, the same in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ip import long_to_ip

AGENTS = ["Mozilla/5.0 (X11; Linux x86_64)"] * 8 + ["Googlebot/2.1 (+http://example.com/bot)"] * 5 + ["curl/8.5.0"] * 4 + ["BadBot/1.0 \\\"scan\\\""] * 3
COMBINED = '%h %^ %^ [%t] "%r" %s %b "%^" "%u"'


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, seq, ip, ts, method, uri, status, bytes, user_agent, bad_status, bad_bytes: traffic in a few dense networks and noise.

    Every 97th address, 50th status and 70th size is malformed, as logs have them.
    """
    e, u, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    noise = (40 + e % 52) * 16777216 + F.floor((e % 1000) / 4) * 65536 + (e % 4) * 256 + 1 + (e * 7) % 254
    ip = F.when(kind == "error", 169082880 + e % 5000).when(kind == "click", 3232235520 + e % 2000).when(kind == "view", 2886729728 + e % 1000).when(kind == "signup", 3405803776 + u % 256).otherwise(noise)
    agents = F.array(*map(F.lit, AGENTS))
    return events(spark, sf_dir).select(
        "event_id", e.alias("seq"), F.when(e % 97 == 0, F.lit(0)).otherwise(ip).cast("bigint").alias("ip"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"),
        F.when(kind.isin("purchase", "signup"), "POST").otherwise("GET").alias("method"), F.concat(F.lit("/"), kind, F.lit("/item"), (e % 7).cast("string")).alias("uri"),
        F.when(e % 50 == 0, F.lit(0)).otherwise(200 + (e % 4) * 101).cast("int").alias("status"), F.when(e % 70 == 0, F.lit(0)).otherwise(e * 37 % 100000).cast("bigint").alias("bytes"),
        F.element_at(agents, (e % 20 + 1).cast("int")).alias("user_agent"), (e % 50 == 0).alias("bad_status"), (e % 70 == 0).alias("bad_bytes"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, value): the same requests as text in the combined layout."""
    r = requests(spark, sf_dir)
    shown = lambda ok, good, bad: F.when(ok, bad).otherwise(good)
    return r.select("event_id", F.concat(
        shown(F.col("ip") == 0, long_to_ip(F.col("ip")), F.lit("unknown")), F.lit(" - - ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "'), "method", F.lit(" "), "uri", F.lit(' HTTP/1.1" '),
        shown(F.col("bad_status"), F.col("status").cast("string"), F.lit("2x0")), F.lit(" "), shown(F.col("bad_bytes"), F.col("bytes").cast("string"), F.lit("12k")), F.lit(' "-" "'), "user_agent", F.lit('"'),
    ).alias("value"))


#: The same requests for DuckDB, as the head of a WITH.
REQUESTS_SQL = """
    base AS (
        SELECT event_id, event_id AS seq, event_type AS kind,
            CAST(CASE WHEN event_id % 97 = 0 THEN 0 WHEN event_type = 'error' THEN 169082880 + event_id % 5000 WHEN event_type = 'click' THEN 3232235520 + event_id % 2000
                WHEN event_type = 'view' THEN 2886729728 + event_id % 1000 WHEN event_type = 'signup' THEN 3405803776 + user_id % 256
                ELSE (40 + event_id % 52) * 16777216 + ((event_id % 1000) // 4) * 65536 + (event_id % 4) * 256 + 1 + (event_id * 7) % 254 END AS BIGINT) AS ip,
            CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS t,
            CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END AS method, '/' || event_type || '/item' || (event_id % 7) AS uri,
            CAST(CASE WHEN event_id % 50 = 0 THEN 0 ELSE 200 + (event_id % 4) * 101 END AS INTEGER) AS status,
            CAST(CASE WHEN event_id % 70 = 0 THEN 0 ELSE event_id * 37 % 100000 END AS BIGINT) AS bytes,
            CASE WHEN event_id % 20 < 8 THEN 'Mozilla/5.0 (X11; Linux x86_64)' WHEN event_id % 20 < 13 THEN 'Googlebot/2.1 (+http://example.com/bot)'
                WHEN event_id % 20 < 17 THEN 'curl/8.5.0' ELSE 'BadBot/1.0 \\"scan\\"' END AS user_agent,
            event_id % 50 = 0 AS bad_status, event_id % 70 = 0 AS bad_bytes
        FROM events)"""


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, start, len): ranges of many lengths that nest, touch and repeat, from customer keys; every second one is a /26 next to others."""
    k = F.col("c_custkey")
    dense = (k % 2 == 0) & (k % 22 != 0)
    length = F.when(dense, 26).otherwise(18 + k % 13).cast("int")
    raw = F.when(dense, 184549376 + F.floor(k / 2) * 64).otherwise(167772160 + (k * 7919) % 4194304)
    size = F.call_function("shiftleft", F.lit(1).cast("bigint"), 32 - length)
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("ord"), (raw - raw % size).alias("start"), length.alias("len"))


RANGES_SQL = """
    rg AS (
        SELECT ord, raw - raw % (CAST(1 AS BIGINT) << (32 - len)) AS start, len, raw - raw % (CAST(1 AS BIGINT) << (32 - len)) + (CAST(1 AS BIGINT) << (32 - len)) - 1 AS "end"
        FROM (
            SELECT c_custkey AS ord, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 22 <> 0 THEN 184549376 + (c_custkey // 2) * 64 ELSE 167772160 + (c_custkey * 7919) % 4194304 END AS raw,
                CAST(CASE WHEN c_custkey % 2 = 0 AND c_custkey % 22 <> 0 THEN 26 ELSE 18 + c_custkey % 13 END AS INTEGER) AS len FROM customer))"""


def supplier_ranges(spark: SparkSession, sf_dir: str, low: int, lengths: int) -> DataFrame:
    """(ord, start, len): ranges of the lengths low .. low + lengths - 1 from supplier keys, in the same network as those of :func:`ranges`."""
    k = F.col("s_suppkey")
    length = (low + k % lengths).cast("int")
    raw, size = F.lit(167772160) + (k * 104729) % 4194304, F.call_function("shiftleft", F.lit(1).cast("bigint"), 32 - length)
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k.alias("ord"), (raw - raw % size).cast("bigint").alias("start"), length.alias("len"))


def supplier_ranges_sql(name: str, low: int, lengths: int) -> str:
    """The same for DuckDB, as a common table expression."""
    size = f"CAST(1 AS BIGINT) << (32 - CAST({low} + s_suppkey % {lengths} AS INTEGER))"
    return f"""{name} AS (SELECT ord, raw - raw % size AS start, len, raw - raw % size + size - 1 AS "end" FROM (
        SELECT s_suppkey AS ord, 167772160 + (s_suppkey * 104729) % 4194304 AS raw, CAST({low} + s_suppkey % {lengths} AS INTEGER) AS len, {size} AS size FROM supplier))"""
