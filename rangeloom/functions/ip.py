"""IPv4 addresses and CIDR ranges as column expressions over BIGINT, and their driver-side twins.

A range is (start, len): ``start`` is its first address with host bits cleared, ``len`` its prefix length.
Address 0 stands for an invalid or missing address.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

TOP = 1 << 32


def ip_to_long(text: Column) -> Column:
    """Dotted quad -> BIGINT; anything else -> 0.

    Accepted are 7 to 15 characters of digits and exactly three dots, octets up to 255; leading zeros
    and empty octets (0) are allowed, as the log grammar has them.
    """
    octets = F.split(text, r"\.")
    value = [F.coalesce(octets[k].try_cast("bigint"), F.lit(0)) for k in range(4)]
    whole = value[0] * 16777216 + value[1] * 65536 + value[2] * 256 + value[3]
    fine = text.rlike(r"\A[0-9]*(\.[0-9]*){3}\z") & F.length(text).between(7, 15)
    for v in value:
        fine = fine & (v <= 255)
    return F.when(fine, whole).otherwise(F.lit(0)).cast("bigint")


def long_to_ip(ip: Column) -> Column:
    """BIGINT -> dotted quad."""
    return F.concat_ws(".", *(F.shiftright(ip, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)))


def cidr_text(start: Column, length: Column) -> Column:
    return F.concat(long_to_ip(start), F.lit("/"), length.cast("string"))


def block_size(length: Column) -> Column:
    """Addresses of a range with this prefix length."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.lit(32) - length).cast("int"))


def last_ip(start: Column, length: Column) -> Column:
    return start + block_size(length) - 1


def prefix_of(ip: Column, length: Column | int) -> Column:
    """The address's first ``length`` bits as a number."""
    n = F.lit(length) if isinstance(length, int) else length
    return F.call_function("shiftright", ip, (F.lit(32) - n).cast("int"))


def mask(ip: Column, length: Column) -> Column:
    """The address with its host bits cleared."""
    return F.call_function("shiftleft", prefix_of(ip, length), (F.lit(32) - length).cast("int"))


def cidr_start(text: Column) -> Column:
    """First address of ``a.b.c.d/len``; null where the text is no strict IPv4 range."""
    return F.when(is_cidr(text), mask(ip_to_long(F.split(text, "/")[0]), cidr_len(text)))


def cidr_len(text: Column) -> Column:
    return F.split(text, "/")[1].try_cast("int")


def is_cidr(text: Column) -> Column:
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return F.coalesce(text.rlike(rf"\A{octet}(\.{octet}){{3}}/(3[0-2]|[12]?[0-9])\z"), F.lit(False))


def covers(a_start: Column, a_len: Column, b_start: Column, b_len: Column) -> Column:
    """Whether range a holds all of range b."""
    return (a_len <= b_len) & (mask(b_start, a_len) == a_start)


def within_unmasked(a_host: Column, a_len: Column, b_host: Column, b_len: Column) -> Column:
    """Whether range a lies in range b, both from the address as written (host bits stay) to the end of its block."""
    end = lambda host, n: last_ip(mask(host, n), n)
    return (a_host >= b_host) & (end(a_host, a_len) <= end(b_host, b_len))


def largest_block(start: Column, size: Column) -> Column:
    """Prefix length of the largest aligned block that begins at ``start`` and has at most ``size`` addresses."""
    aligned = F.when(start == 0, F.lit(32)).otherwise(F.bit_count(start.bitwiseAND(-start) - 1))
    fits = F.length(F.bin(size)) - 1
    return F.lit(32) - F.least(aligned, fits, F.lit(32))


# ---- the same on the driver, for lists that are configuration


def parse_cidr(text: str) -> tuple[int, int]:
    """(start, len) of a strict IPv4 range; ValueError otherwise. Host bits are cleared; no bare address."""
    if "/" not in text:
        raise ValueError(f"invalid CIDR address: {text}")
    net = ipaddress.IPv4Network(text, strict=False)
    if not text.split("/")[1].isdigit():
        raise ValueError(f"invalid CIDR address: {text}")
    return int(net.network_address), net.prefixlen


def is_cidr_or_ip(text: str) -> bool:
    try:
        ipaddress.ip_network(text, strict=False)
        return True
    except ValueError:
        return False


def format_ip(ip: int) -> str:
    return str(ipaddress.IPv4Address(ip))


def format_cidr(start: int, length: int) -> str:
    return f"{format_ip(start)}/{length}"


def format_number(n: int) -> str:
    return f"{n:,}"


def random_ips(spark: SparkSession, cidr: str, n: int, seed: int = 0):
    """n addresses of a range, network and last address excluded: a test-data generator."""
    start, length = parse_cidr(cidr)
    room = max(1, (1 << 32 - length) - 2)
    return spark.range(n).select((F.lit(start) + 1 + F.floor(F.rand(seed) * room)).cast("bigint").alias("ip"))


def register(spark: SparkSession) -> None:
    """SQL functions: ip_to_long, long_to_ip, cidr_start, cidr_end, and cidr_cover(first, last), the array of the fewest ranges that make
    up a span. They are expressions, not Python code."""
    quad = "transform(split(x, '[.]'), o -> coalesce(try_cast(o AS BIGINT), 0L))"
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION ip_to_long(x STRING) RETURNS BIGINT RETURN
        CASE WHEN x RLIKE '^[0-9]*([.][0-9]*){{3}}$' AND length(x) BETWEEN 7 AND 15 AND forall({quad}, o -> o <= 255)
        THEN aggregate({quad}, 0L, (a, o) -> a * 256 + o) ELSE 0L END""")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION long_to_ip(x BIGINT) RETURNS STRING RETURN concat_ws('.', shiftright(x, 24) & 255, shiftright(x, 16) & 255, shiftright(x, 8) & 255, x & 255)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION cidr_start(x STRING) RETURNS BIGINT RETURN shiftleft(shiftright(ip_to_long(split(x, '/')[0]), 32 - int(split(x, '/')[1])), 32 - int(split(x, '/')[1]))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION cidr_end(x STRING) RETURNS BIGINT RETURN cidr_start(x) + shiftleft(1L, 32 - int(split(x, '/')[1])) - 1")
    # at each level, blocks of 2**k addresses at either end of the span, kept if they lie in it and their parent doesn't
    block = "shiftleft(shiftright({0}, k), k)"
    ends = f"array_distinct(array({block.format('a + shiftleft(1L, k) - 1')}, {block.format('z + 1')} - shiftleft(1L, k)))"
    parent = "shiftleft(shiftright(b, k + 1), k + 1)"
    fits = f"b >= a AND b + shiftleft(1L, k) - 1 <= z AND NOT (k < 32 AND {parent} >= a AND {parent} + shiftleft(2L, k) - 1 <= z)"
    level = f"transform(filter({ends}, b -> {fits}), b -> struct(b AS s, 32 - k AS n))"
    text = "concat(concat_ws('.', shiftright(x.s, 24) & 255, shiftright(x.s, 16) & 255, shiftright(x.s, 8) & 255, x.s & 255), '/', x.n)"
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION cidr_cover(a BIGINT, z BIGINT) RETURNS ARRAY<STRING> RETURN
        CASE WHEN a <= z THEN transform(array_sort(flatten(transform(sequence(0, 32), k -> {level}))), x -> {text}) ELSE array() END""")
