"""Sliding windows bounded by time and size, as relational steps over the window's rows.

A window is a queue in arrival order. Rows leave from the head while the head is older than the bound; an old row behind a fresh
one stays until it is the head. Then the oldest arrivals leave until the size fits. ``now`` is a parameter, so a replay is exact.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: seq = batch number * 2**SEQ_BITS + place in the batch: ascending in arrival order.
SEQ_BITS = 43
STATE = "seq bigint, ip bigint, ts timestamp"


def append(state: DataFrame | None, batch: DataFrame, number: int) -> DataFrame:
    """The queue with the batch's (ip, ts) rows behind it. Places in a batch follow its partitions, so no sort is needed."""
    place = F.monotonically_increasing_id() + F.lit(number << SEQ_BITS)
    new = batch.select(place.alias("seq"), "ip", "ts")
    return new if state is None else state.unionByName(new)


def evict_old(queue: DataFrame, now: datetime, max_time: timedelta) -> DataFrame:
    """Without the expired rows at the head: what lies before the first row that is young enough."""
    cutoff = now - max_time
    # one row, the head's place, meets all
    head = queue.where(F.col("ts") >= F.lit(cutoff)).agg(F.min("seq").alias("_head"))
    return queue.join(F.broadcast(head), F.col("seq") >= F.col("_head")).drop("_head")


def evict_excess(queue: DataFrame, max_size: int) -> DataFrame:
    """The latest ``max_size`` arrivals."""
    return queue.orderBy(F.col("seq").desc()).limit(max(0, max_size))


def evict(queue: DataFrame, now: datetime, max_time: timedelta, max_size: int) -> DataFrame:
    return evict_excess(evict_old(queue, now, max_time), max_size)


def purge_expired(seen: DataFrame, cutoff: datetime) -> DataFrame:
    """Rows (ip, last_seen) that were seen at or after the cutoff."""
    return seen.where(F.col("last_seen") >= F.lit(cutoff))
