"""Row predicates: time range, pattern gates, user-agent lists, invalid addresses."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.regex import gate

#: A list up to this long becomes an IN set; a longer one a table to join, which Spark broadcasts if it is small.
INLINE = 1000


def in_time(start: datetime | None, end: datetime | None, ts: str = "ts") -> Column:
    """start <= ts <= end, each side optional. Unreadable times are year 1: a start rejects them, an end alone doesn't."""
    out = F.lit(True)
    if start is not None:
        out = out & (F.col(ts) >= F.lit(start))
    if end is not None:
        out = out & (F.col(ts) <= F.lit(end))
    return out


def matches(user_agent_regex: str | None, endpoint_regex: str | None) -> Column:
    """Both pattern gates."""
    return gate(F.col("user_agent"), user_agent_regex) & gate(F.col("uri"), endpoint_regex)


def patterns(entries: list[str]) -> list[str]:
    """Lower-cased entries of a user-agent list, without blanks and comments."""
    return sorted({t.lower() for e in entries if (t := e.strip()) and not t.startswith("#")})


def classify_agents(requests: DataFrame, white: list[str], black: list[str]) -> DataFrame:
    """With a column ua_class: 1 whitelisted, -1 blacklisted, 0 neither. Whole agents are compared, without case;
    the whitelist wins."""
    white, black = patterns(white), patterns(black)
    black = sorted(set(black) - set(white))
    agent = F.lower("user_agent")
    if not white and not black:
        return requests.withColumn("ua_class", F.lit(0))
    if len(white) + len(black) <= INLINE:
        cls = F.lit(0)
        if black:
            cls = F.when(agent.isin(black), -1).otherwise(cls)
        if white:
            cls = F.when(agent.isin(white), 1).otherwise(cls)
        return requests.withColumn("ua_class", cls)
    spark: SparkSession = requests.sparkSession
    known = spark.createDataFrame([(w, 1) for w in white] + [(b, -1) for b in black], "_ua string, _class int")
    joined = requests.join(known, agent == F.col("_ua"), "left")
    return joined.withColumn("ua_class", F.coalesce("_class", F.lit(0))).drop("_ua", "_class")


def agent_ips(classified: DataFrame, cls: int) -> DataFrame:
    """Distinct valid addresses of a class."""
    return classified.where((F.col("ua_class") == cls) & (F.col("ip") != 0)).select("ip").distinct()


def passes(start=None, end=None, user_agent_regex: str | None = None, endpoint_regex: str | None = None) -> Column:
    """Whether a row passes the time range and both gates, cheapest test first; columns that no test needs may be missing."""
    out = F.lit(True)
    if start is not None or end is not None:
        out = out & in_time(start, end)
    if user_agent_regex or endpoint_regex:
        out = out & matches(user_agent_regex, endpoint_regex)
    return out


def select_requests(requests: DataFrame, start=None, end=None, user_agent_regex: str | None = None, endpoint_regex: str | None = None) -> DataFrame:
    """Rows that pass the time range and both gates."""
    return requests.where(passes(start, end, user_agent_regex, endpoint_regex))
