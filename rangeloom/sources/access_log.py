"""Log files and live events as rows of the ``requests`` schema, and the counters of what was malformed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .logformat import DEFAULT, parse_lines

METHODS = ("GET", "POST", "PUT", "DELETE", "HEAD", "OPTIONS", "PATCH")


def read_log(spark: SparkSession, path: str, fmt: str = DEFAULT, columns: list[str] | None = None) -> DataFrame:
    """Rows of a log file, folder or glob, in any store Spark reads. Blank lines are rows with ip 0."""
    return parse_lines(spark.read.text(path), fmt, columns)


def read_ips(spark: SparkSession, path: str, fmt: str = DEFAULT) -> DataFrame:
    """Only the addresses: the line pattern ends behind %h."""
    return read_log(spark, path, fmt, ["ip"])


def malformed_counts(requests: DataFrame) -> DataFrame:
    """One row: malformed_status, malformed_bytes, invalid_ips, total."""
    return requests.agg(
        F.count_if("bad_status").alias("malformed_status"), F.count_if("bad_bytes").alias("malformed_bytes"), F.count_if(F.col("ip") == 0).alias("invalid_ips"), F.count(F.lit(1)).alias("total")
    )


def _field(text: Column, k: int) -> Column:
    return F.get(F.filter(F.split(text, r"[\s]+"), lambda x: x != ""), F.lit(k))


def parse_live(events: DataFrame, message: str = "message") -> DataFrame:
    """Events whose ``message`` is a combined-layout line: the columns of the events and ip, ts, method, uri, status, bytes,
    user_agent, malformed (fields), parse_error (the event is to be dropped).

    Unlike log files, the time's offset counts, methods are whole names, and a - for bytes is malformed.
    """
    msg = F.col(message)
    head = F.regexp_extract(msg, r"\A([^ ]*) ", 1)
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    v4 = head.rlike(rf"\A{octet}(?:\.{octet}){{3}}\z")
    v6 = head.rlike(r"\A[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*\z")
    quad = F.split(head, r"\.")
    ip = F.when(v4, sum((quad[k].try_cast("bigint") * 256 ** (3 - k) for k in range(1, 4)), quad[0].try_cast("bigint") * 16777216)).otherwise(F.lit(0))
    stamp = F.regexp_extract(msg, r"\A[^\[\]]*\[([^\]]*)\]", 1)
    ts = F.when(stamp.rlike(r"\A\d{1,2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4}\z"), F.try_to_timestamp(stamp, F.lit("d/MMM/yyyy:HH:mm:ss xx")))
    after = F.regexp_extract(msg, r"(?s)\A[^\[\]]*\[[^\]]*\](.*)\z", 1)
    quoted = after.rlike(r'(?s)\A[^"]*"[^"]*"')
    request = F.regexp_extract(after, r'(?s)\A[^"]*"([^"]*)"', 1)
    rest = F.regexp_extract(after, r'(?s)\A[^"]*"[^"]*".(.*)\z', 1)
    both = _field(request, 1).isNotNull()
    method = F.when(both, F.when(_field(request, 0).isin(*METHODS), _field(request, 0)).otherwise("UNKNOWN")).otherwise("GET")
    two = _field(rest, 1).isNotNull()
    number = lambda k: F.when(two & _field(rest, k).rlike(r"\A[+-]?[0-9]{1,18}\z"), _field(rest, k).try_cast("bigint"))
    bad = lambda k: (two & number(k).isNull()).cast("int")
    agent = F.regexp_extract(msg, r'(?s)\A(?:[^"]*"){5}([^"]*)"', 1)
    return events.select(
        "*", ip.alias("ip"), ts.alias("ts"), method.alias("method"), F.coalesce(F.when(both, _field(request, 1)), F.lit("")).alias("uri"),
        F.coalesce(F.pmod(number(0), F.lit(65536)), F.lit(0)).cast("int").alias("status"), F.coalesce(F.pmod(number(1), F.lit(4294967296)), F.lit(0)).alias("bytes"), agent.alias("user_agent"),
        (bad(0) + bad(1)).alias("malformed"), F.coalesce(~((v4 | v6) & ts.isNotNull() & quoted), F.lit(True)).alias("parse_error"),
    )
