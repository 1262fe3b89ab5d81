"""Line parsing against a state machine written out by hand, over formats, quoting and truncation."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rangeloom.sources import logformat
from rangeloom.sources.access_log import malformed_counts, parse_live, read_ips, read_log

FORMATS = [
    logformat.DEFAULT, '%h %^ %^ [%t] "%r" %s %b "%^" "%u"', "%h %t %m %U %s %b", '%h "%m %U %^" %s', "%h, %t, %s", "%s|%b|%h", '%m "%r" %h', "%U %r %h", "%u %h", "%h %u,%s",
]


def slow_fields(line, fields):
    """code -> text of each field that is not empty."""
    at, out = 0, []
    for f in fields:
        if at >= len(line):
            break
        while at < len(line) and line[at] == " ":
            at += 1
        start = at
        if f.quoted and line[at : at + 1] == '"':
            start = at = at + 1
            while at < len(line) and line[at] != '"':
                at += 2 if line[at] == "\\" and at + 1 < len(line) else 1
        elif f.bracketed and line[at : at + 1] == "[":
            start = at = at + 1
            while at < len(line) and line[at] != "]":
                at += 1
        else:
            while at < len(line) and line[at] not in (f.delimiter, " "):
                at += 1
        if f.code != "^" and at > start:
            out.append((f.code, line[start:at]))
        closer = line[at : at + 1]
        if closer and (f.quoted and closer == '"' or f.bracketed and closer == "]" or closer == f.delimiter):
            at += 1
    return out


def slow_ip(t):
    parts = t.split(".")
    if not 7 <= len(t) <= 15 or len(parts) != 4 or any(not (p == "" or p.isascii() and p.isdigit()) for p in parts):
        return 0
    nums = [int(p or 0) for p in parts]
    return 0 if max(nums) > 255 else sum(n << s for n, s in zip(nums, (24, 16, 8, 0)))


def slow_time(t):
    if len(t) < 20 or t[3:6] not in logformat.MONTHS:
        return datetime(1, 1, 1)
    d = lambda k: ord(t[k]) & 15
    two = lambda k: d(k) * 10 + d(k + 1)
    month = logformat.MONTHS.index(t[3:6]) + 1
    return datetime(max(1, two(7) * 100 + two(9)), month, 1) + timedelta(days=two(0) - 1, hours=two(12), minutes=two(15), seconds=two(18))


def slow_method(t):
    return {"G": "GET", "D": "DELETE", "H": "HEAD", "O": "OPTIONS"}.get(t[:1]) or {"PO": "POST", "PA": "PATCH"}.get(t[:2]) or ("PUT" if t[:1] == "P" else "UNKNOWN")


def slow_row(line, fields):
    row = {"ip": 0, "ts": datetime(1, 1, 1), "method": "GET", "uri": "", "status": 0, "bytes": 0, "user_agent": "", "bad_status": False, "bad_bytes": False}
    quoted = next((f.quoted for f in fields if f.code == "r"), False)
    for code, t in slow_fields(line, fields):
        if code == "h":
            row["ip"] = slow_ip(t)
        elif code == "t":
            row["ts"] = slow_time(t)
        elif code == "m":
            row["method"] = slow_method(t)
        elif code == "U":
            row["uri"] = t
        elif code == "u":
            row["user_agent"] = t
        elif code == "r" and not quoted:
            row["uri"] = t
        elif code == "r":
            head, _, rest = t.partition(" ")
            if head and row["method"] == "GET":
                row["method"] = slow_method(head)
            row["uri"] = rest.lstrip(" ").split(" ")[0] or row["uri"]
        elif code == "s":
            good = len(t) == 3 and t.isascii() and t.isdigit()
            row["status"] = int(t) if good else 0
            row["bad_status"] = not good and t != "-"
        elif code == "b" and t[0] != "-":
            good = t.isascii() and t.isdigit()
            row["bytes"] = int(t) % (1 << 32) if good else 0
            row["bad_bytes"] = not good
    return row


def random_lines(seed, n):
    r = random.Random(seed)
    parts = ["1.2.3.4", "255.255.255.255", "01.002.3.4", "1..2.3", "256.1.1.1", "::1", "-", "[06/Jul/2025:19:57:26 +0200]", "[31/Feb/2025:25:61:61 +0000]", "[xx/Foo/2025:00:00:00 +0000]", "[short]", "[unclosed",
             '"GET /a/b?c=d HTTP/1.1"', '"POST  /two HTTP/1.1"', '"PATCH /p"', '"PUT"', '" lead /x"', '"esc \\" quote /y"', '"odd \\\\" tail"', '"open', "GET", "/plain", "200", "404", "20", "2x0", "1234", "99999999999", "12k", '"Mozilla/5.0 (X11)"', '"-"', "", "a,b", "x|y", "é", "\\"]
    good = '9.8.7.6 - - [06/Jul/2025:19:57:26 +0000] "GET /ok HTTP/1.1" 200 512 "-" "agent"'
    out = ["", " ", good, good[:40], good + " 10.0.0.1", good.replace("GET", "\x01GET")]
    return out + [r.choice([" ", "  ", ",", "|"]).join(r.choice(parts) for _ in range(r.randint(1, 9))) for _ in range(n)]


@pytest.mark.parametrize("fmt", FORMATS)
def test_lines(spark, fmt):
    fields = logformat.compile_format(fmt)
    lines = random_lines(len(fmt), 300)
    got = logformat.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"), fmt).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).collect()
    for line, row in zip(lines, got, strict=True):
        want = slow_row(line, fields)
        want["ts"] = want["ts"].strftime("%Y-%m-%d %H:%M:%S").zfill(19)
        assert row.asDict() == want, line
    only = logformat.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"), fmt, ["ip"])
    assert only.columns == ["ip"] and Counter(r["ip"] for r in only.collect()) == Counter(r["ip"] for r in got)


@pytest.mark.parametrize("fmt", ["", "%t %s", "%h %h", "%h %x", "%h %s %s", "%%h"])
def test_bad_formats(fmt):
    with pytest.raises(logformat.FormatError):
        logformat.compile_format(fmt)


def test_files(spark, tmp_path):
    log = tmp_path / "a.log"
    log.write_bytes(b'1.2.3.4 - - [06/Jul/2025:19:57:26 +0000] "GET / HTTP/1.1" 200 5 "-" "x"\r\n\nnonsense\n1.2.3.5 - - [06/Jul/2025:19:57:26 +0000] "GET / HTTP/1.1" 2 z "-" "x"\n')
    fmt = FORMATS[1]
    rows = read_log(spark, str(log), fmt)
    counts = malformed_counts(rows).first()
    assert (counts["total"], counts["invalid_ips"], counts["malformed_status"], counts["malformed_bytes"]) == (4, 2, 1, 1)
    assert sorted(r["ip"] for r in read_ips(spark, str(log), fmt).collect()) == [0, 0, 16909060, 16909061]


def test_live_events(spark):
    good = '1.2.3.4 - - [06/Jul/2025:19:57:26 +0200] "DELETE /x HTTP/1.1" 404 77 "-" "agent \'q\'"'
    cases = [good, None, "nospace", good.replace("1.2.3.4", "1.2.3"), good.replace("Jul", "Foo"), good.replace('"', ""), good.replace("1.2.3.4", "::1"), good.replace("404 77", "4x4 -"), good.replace("DELETE", "delete"), good[: good.index(" 404")]]
    rows = parse_live(spark.createDataFrame([(c,) for c in cases], "message string")).withColumn("ts", F.unix_timestamp("ts")).collect()
    first = rows[0]
    assert (first["ip"], first["ts"], first["method"], first["uri"], first["status"], first["bytes"], first["user_agent"], first["malformed"], first["parse_error"]) == (16909060, 1751824646, "DELETE", "/x", 404, 77, "agent 'q'", 0, False)
    assert [r["parse_error"] for r in rows] == [False, True, True, True, True, True, False, False, False, False]
    assert rows[6]["ip"] == 0 and rows[7]["malformed"] == 2 and rows[8]["method"] == "UNKNOWN" and rows[9]["status"] == 0
