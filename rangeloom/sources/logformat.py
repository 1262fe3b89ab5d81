"""Access-log lines to rows: a format string becomes one Java pattern, and fields become column expressions.

Format codes: %h address, %t time, %r request line, %m method, %U URI, %s status, %b bytes, %u user agent, %^ skip.
The character behind a code ends its field (a space at the end of the format); a field with a double quote behind it may be quoted,
with backslash escapes; %u may always be quoted, %t always bracketed. A line never fails: short
or odd lines leave zero values.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ip import ip_to_long

DEFAULT = '%^ %^ %^ [%t] "%r" %s %b %^ "%u" "%h"'
CODES = "htrmsbUu^"
#: Separates the fields of a line while it is taken apart; lines that hold it are taken apart with the second.
MARKS = ("\x01", "\x02")
ZERO_TIME = "TIMESTAMP '0001-01-01 00:00:00'"
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


class FormatError(ValueError):
    pass


@dataclass(frozen=True)
class Field:
    code: str
    delimiter: str
    quoted: bool
    bracketed: bool


def compile_format(fmt: str) -> list[Field]:
    """The fields of a format; FormatError for unknown or repeated codes, or without %h."""
    if not fmt:
        raise FormatError("format string is empty")
    fields, seen = [], set()
    for m in re.finditer(r"%(.)", fmt, re.S):
        code, behind = m[1], fmt[m.end() : m.end() + 1]
        if code not in CODES:
            raise FormatError(f"unknown format code %{code}")
        if code != "^" and code in seen:
            raise FormatError(f"format code %{code} is repeated")
        seen.add(code)
        fields.append(Field(code, behind or " ", code == "u" or behind == '"', code == "t"))
    if "h" not in seen:
        raise FormatError("format code %h is required")
    return fields


def line_pattern(fields: list[Field]) -> str:
    """One pattern with two groups a field; nesting stops at the end of a short line."""

    def one(f: Field) -> str:
        d = re.escape(f.delimiter)
        plain = "([^ ]*+)(?: )?+" if f.delimiter == " " else f"([^ {d}]*+)(?:{d})?+"
        if f.quoted:
            return r' *+(?:"((?:[^"\\]|\\.)*+\\?+)"?+|(?!")' + plain + ")"
        if f.bracketed:
            return r" *+(?:\[([^\]]*+)\]?+|(?!\[)" + plain + ")"
        return " *+()" + plain

    body = ""
    for f in reversed(fields):
        body = f"(?:(?=.){one(f)}{body})?+"
    return f"(?s)^{body}.*$"


def split_line(line: Column, fields: list[Field], wanted: list[int]) -> Column:
    """Array of the wanted fields' texts, by a single pass of the pattern."""
    pattern = line_pattern(fields[: max(wanted) + 1])

    def taken(mark: str) -> Column:
        shape = mark.join(f"${2 * k + 1}${2 * k + 2}" for k in wanted)
        return F.split(F.regexp_replace(line, pattern, shape), mark, -1)

    return F.when(F.contains(line, F.lit(MARKS[0])), taken(MARKS[1])).otherwise(taken(MARKS[0]))


def parse_time(text: Column) -> Column:
    """``dd/MMM/yyyy:HH:mm:ss`` at fixed places, offset ignored, as UTC; out-of-range parts carry over; a bad month
    or a short text gives year 1."""
    digit = lambda k: F.ascii(F.substring(text, k, 1)).bitwiseAND(F.lit(15))
    two = lambda k: digit(k) * 10 + digit(k + 1)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(text, 4, 3)).cast("int")
    year = two(8) * 100 + two(10)
    first = F.make_date(F.greatest(year, F.lit(1)), F.greatest(month, F.lit(1)), F.lit(1)).cast("timestamp")
    whole = first + F.make_dt_interval(two(1) - 1, two(13), two(16), two(19).cast("decimal(18,6)"))
    return F.when((F.length(text) >= 20) & (month > 0), whole).otherwise(F.expr(ZERO_TIME))


def parse_method(text: Column) -> Column:
    """By the first letters, as log lines abbreviate nothing else: G, PO, PA, other P, D, H, O; else UNKNOWN."""
    one, two = F.substring(text, 1, 1), F.substring(text, 1, 2)
    return (
        F.when(one == "G", "GET").when(two == "PO", "POST").when(two == "PA", "PATCH").when(one == "P", "PUT").when(one == "D", "DELETE")
        .when(one == "H", "HEAD").when(one == "O", "OPTIONS").otherwise("UNKNOWN")
    )


def parse_status(text: Column) -> tuple[Column, Column]:
    """(status, malformed): three digits; an empty field or one that begins with - is a silent 0."""
    good = text.rlike(r"\A[0-9]{3}\z")
    return F.when(good, text.try_cast("int")).otherwise(F.lit(0)), ~good & (text != "") & (text != "-")


def parse_bytes(text: Column) -> tuple[Column, Column]:
    """(bytes, malformed): digits, modulo 2**32; an empty field or one that begins with - is a silent 0."""
    good = text.rlike(r"\A[0-9]+\z")
    # long values are cut to their last digits: 2**32 divides 10**32
    value = F.pmod(F.right(text, F.lit(32)).try_cast("decimal(38,0)"), F.lit(4294967296).cast("decimal(38,0)")).cast("bigint")
    return F.when(good, value).otherwise(F.lit(0).cast("bigint")), ~good & (text != "") & ~F.startswith(text, F.lit("-"))


def parse_lines(lines: DataFrame, fmt: str = DEFAULT, columns: list[str] | None = None, line: str = "value") -> DataFrame:
    """Rows ip, ts, method, uri, status, bytes, user_agent, bad_status, bad_bytes of a table of lines.

    ``columns`` names those that are needed: for ``["ip"]`` alone the pattern stops behind %h and nothing else is parsed.
    """
    fields = compile_format(fmt)
    every = ["ip", "ts", "method", "uri", "status", "bytes", "user_agent", "bad_status", "bad_bytes"]
    needs = {"ip": "h", "ts": "t", "method": "mr", "uri": "Ur", "status": "s", "bytes": "b", "user_agent": "u", "bad_status": "s", "bad_bytes": "b"}
    columns = columns or every
    codes = [f.code for f in fields]
    wanted = [k for k, c in enumerate(codes) if c != "^" and any(c in needs[x] for x in columns)]
    if columns == ["ip"]:
        wanted = [codes.index("h")]
    text = F.regexp_replace(F.col(line), r"\r\z", "")
    parts = lines.withColumn("_parts", split_line(text, fields, wanted))
    got = {codes[k]: F.coalesce(F.get(F.col("_parts"), F.lit(n)), F.lit("")) for n, k in enumerate(wanted)}
    nothing = F.lit("")
    out = {"ip": ip_to_long(got["h"]) if "h" in got else F.lit(0).cast("bigint"), "ts": parse_time(got["t"]) if "t" in got else F.expr(ZERO_TIME)}
    request_quoted = next((f.quoted for f in fields if f.code == "r"), False)
    method, uri = F.lit("GET"), nothing
    for code in (c for c in codes if c in got and c in "rmU"):  # a later field wins, but a request line never replaces a method other than GET
        if code == "m":
            method = F.when(got["m"] != "", parse_method(got["m"])).otherwise(method)
        elif code == "U":
            uri = F.when(got["U"] != "", got["U"]).otherwise(uri)
        elif request_quoted:
            method = F.when((method == "GET") & ~got["r"].rlike(r"\A( |\z)"), parse_method(got["r"])).otherwise(method)
            second = F.coalesce(F.get(F.split(got["r"], " +", 3), F.lit(1)), nothing)
            uri = F.when(second != "", second).otherwise(uri)
        else:
            uri = F.when(got["r"] != "", got["r"]).otherwise(uri)
    status, bad_status = parse_status(got["s"]) if "s" in got else (F.lit(0), F.lit(False))
    size, bad_bytes = parse_bytes(got["b"]) if "b" in got else (F.lit(0).cast("bigint"), F.lit(False))
    out |= {"method": method, "uri": uri, "status": status, "bytes": size, "user_agent": got.get("u", nothing), "bad_status": bad_status, "bad_bytes": bad_bytes}
    return parts.select(*(out[c].alias(c) for c in columns))
