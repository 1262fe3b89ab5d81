"""Detection, range algebra, register, filters and windows against small independent versions."""

import ipaddress
import random
from collections import Counter
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from rangeloom.functions import ip as ipf
from rangeloom.functions import regex
from rangeloom.operators import clusters, filters, jail, ranges, traffic
from rangeloom.streaming import window

NOW = datetime(2025, 3, 1, tzinfo=timezone.utc)


def slow_clusters(counts, m, low, high, diff):
    """The rule as a recursive walk."""
    t = int(max(diff, 0) * 1000)
    child = Counter()
    for ip, c in counts.items():
        for d in range(1, 33):
            child[d, ip >> 32 - d] += c
    out = []

    def walk(d, p, n):
        if d == high:
            if n >= m:
                out.append((p << 32 - d, d))
            return
        left, right = (child.get((d + 1, 2 * p + k), 0) for k in (0, 1)) if d < 32 else (0, 0)
        if not left and not right:
            return
        if left and right and (left == right or 2000 * abs(left - right) < t * n) and n >= m and d >= low:
            out.append((p << 32 - d, d))
            return
        for k, c in enumerate((left, right)):
            if c and c >= m:
                walk(d + 1, 2 * p + k, c)

    if not counts:
        return [(0, 0)] if m == 0 and low == 0 else []
    walk(0, 0, 0)
    return out


def test_clusters_against_the_walk(spark):
    r = random.Random(12)
    sets, cases, rows = {}, {}, []
    for k in range(40):
        base = [r.randrange(1 << 32) for _ in range(3)]
        ips = Counter()
        for _ in range(r.randint(0, 60)):
            x = r.choice(base) ^ r.randrange(1 << r.choice([1, 4, 8, 12, 20]))
            ips[r.choice([x, x, 1, (1 << 32) - 1]) or 1] += r.randint(1, 4)
        name = f"t{k}"
        low = r.choice([0, 1, 8, 16, 24, 32])
        sets[name] = [clusters.ClusterParams(r.choice([0, 1, 2, 5, 20]), low, r.randint(low, r.choice([32, 34]) if low < 33 else 33), r.choice([-1, 0, 0.1, 0.2, 0.5, 1, 3])) for _ in range(3)]
        cases[name] = ips
        rows += [(name, ip, c) for ip, c in ips.items()]
    counts = spark.createDataFrame(rows, "trie string, ip long, c long")
    got = clusters.detect_clusters(counts, sets).collect()
    for name, ps in sets.items():
        for k, p in enumerate(ps):
            mine = sorted((x["start"], x["len"]) for x in got if (x["trie"], x["set_idx"]) == (name, k))
            assert mine == sorted(slow_clusters(cases[name], p.min_size, p.min_depth, p.max_depth, p.mean_diff)), (name, p)
    for x in got:
        if x["len"]:
            assert x["requests"] == sum(c for ip, c in cases[x["trie"]].items() if x["start"] <= ip <= x["end"])
    with pytest.raises(clusters.ParameterError):
        clusters.ClusterParams(1, 25, 24, 0.1)


def net(start, length):
    return ipaddress.IPv4Network((start, length))


def random_ranges(r, n, low=16):
    out = []
    for _ in range(n):
        length = r.randint(low, 32)
        x = (10 << 24) + r.randrange(1 << 17)
        out.append((x >> 32 - length << 32 - length, length))
    return out


def test_cover_and_subtract(spark):
    r = random.Random(3)
    spans = [(k, a, a + r.choice([0, 1, 5, 255, 256, 70_000]) - r.choice([0, 0, 2])) for k, a in enumerate(r.randrange(1 << 31) for _ in range(200))] + [(900, 0, (1 << 32) - 1), (901, 5, 4), (902, (1 << 32) - 1, (1 << 32) - 1), (903, 0, 0)]
    got = Counter((x["ord"], x["cidr"]) for x in ranges.cover(spark.createDataFrame(spans, "ord long, start long, end long")).collect())
    want = Counter((k, str(n)) for k, a, b in spans if a <= b for n in ipaddress.summarize_address_range(ipaddress.IPv4Address(a), ipaddress.IPv4Address(b)))
    assert got == want
    black, white = random_ranges(r, 60), random_ranges(r, 80, 20) + [black_ for black_ in random_ranges(r, 3, 16)]
    black += black[:3]
    frame = lambda rows: spark.createDataFrame([(k, *x) for k, x in enumerate(rows)], "ord long, start long, len int")
    got = Counter((x["ord"], x["cidr"]) for x in ranges.subtract(frame(black), frame(white)).collect())
    want = Counter()
    for k, (s, n) in enumerate(black):
        left = [net(s, n)]
        for w in white:
            w = net(*w)
            left = [y for x in left for y in ([] if x.subnet_of(w) else x.address_exclude(w) if w.subnet_of(x) else [x])]
        want.update((k, str(x)) for x in ipaddress.collapse_addresses(left))
    assert got == want
    texts = [str(net(*b)) for b in black]
    assert Counter(ranges.subtract_lists(texts, [str(net(*w)) for w in white])) == Counter(c for (_, c), n in want.items() for _ in range(n))
    assert ranges.subtract_lists(["bad", "10.0.0.0/24"], ["nonsense", "10.0.0.0/25"]) == ["bad", "10.0.0.128/25"]


def test_merge(spark):
    r = random.Random(5)
    rows = []
    for g in range(12):
        rows += [(g, s, n) for s, n in random_ranges(r, r.randint(1, 40), 22)]
        rows += [(g, (11 << 24) + k * 32, 27) for k in range(r.randint(1, 20))]
    rows += [(50, (1 << 32) - 2, 31), (50, (1 << 32) - 1, 32), (51, 0, 0), (51, 5, 32)]
    df = spark.createDataFrame(rows, "g long, start long, len int")
    got = Counter((x["g"], x["start"], x["len"]) for x in ranges.merge(df, ["g"]).collect())
    want = Counter((g, *x) for g in {row[0] for row in rows} for x in ranges.merge_lists([row[1:] for row in rows if row[0] == g]))
    assert got == want
    large = []  # around the sizes of the blocks that are folded by themselves
    for g in range(60):
        top = r.randint(6, 22)
        base = r.randrange(1 << top) << 32 - top
        for _ in range(r.randint(1, 30)):
            length = min(32, top + r.randint(0, 6))
            x = base + (r.randrange(1 << min(6, 32 - top)) << max(0, 26 - top))
            large.append((g, x >> 32 - length << 32 - length, length))
        large += [(g, k << 32 - n, n) for n in (9, 10, 11, 12) for k in range(r.randint(0, 5))]
    got = Counter((x["g"], x["start"], x["len"]) for x in ranges.merge(spark.createDataFrame(large, "g long, start long, len int"), ["g"]).collect())
    assert got == Counter((g, *x) for g in range(60) for x in ranges.merge_lists([row[1:] for row in large if row[0] == g]))
    eight = spark.createDataFrame([((11 << 24) + k * 32, 27) for k in range(8)], "start long, len int")
    assert sorted(x["cidr"] for x in ranges.merge(eight).collect()) == ["11.0.0.0/25", "11.0.0.128/25"]
    assert [x["cidr"] for x in ranges.merge(eight, canonical=True).collect()] == ["11.0.0.0/24"]
    for g in range(12):
        nets = [net(*row[1:]) for row in rows if row[0] == g]
        one = spark.createDataFrame([row[1:] for row in rows if row[0] == g], "start long, len int")
        assert sorted(x["cidr"] for x in ranges.merge(one, canonical=True).collect()) == sorted(map(str, ipaddress.collapse_addresses(nets)))
        if g > 1:
            break


def test_membership(spark):
    r = random.Random(9)
    rs = random_ranges(r, 50, 20) + [(1 << 31, 1)]
    ips = [(10 << 24) + r.randrange(1 << 17) for _ in range(400)] + [0, (1 << 32) - 1]
    df, ir = spark.createDataFrame(rs, "start long, len int"), spark.createDataFrame([(x,) for x in ips], "ip long")
    inside = lambda x: any(s <= x < s + (1 << 32 - n) for s, n in rs)
    assert sorted(x["ip"] for x in ranges.ips_in(ir, df).collect()) == sorted(filter(inside, ips))
    assert sorted(x["ip"] for x in ranges.ips_in(ir, df, "left_anti").collect()) == sorted(x for x in ips if not inside(x))
    assert ranges.ips_in(ir, df.limit(0)).count() == 0
    counts = clusters.ip_counts(ir)
    got = {(x["start"], x["len"]): x["requests"] for x in ranges.range_counts(counts, df).collect()}
    assert all(got[s, n] == sum(s <= x < s + (1 << 32 - n) for x in ips if x) for s, n in rs)


def test_addresses(spark):
    texts = ["1.2.3.4", "0.0.0.0", "255.255.255.255", "256.1.1.1", "01.02.03.04", "1..2.3.4", "...", "1.2.3.", "1.2.3", "a.b.c.d", "", "999999999.1.1", "1.2.3.4.5", "1.2.3.45678901", None]
    got = [x["v"] for x in spark.createDataFrame([(t,) for t in texts], "t string").select(ipf.ip_to_long(F.col("t")).alias("v")).collect()]
    assert got == [16909060, 0, (1 << 32) - 1, 0, 16909060, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0]
    ipf.register(spark)
    row = spark.sql("select ip_to_long('1.2.3.4') a, long_to_ip(16909060) b, cidr_start('10.1.2.3/16') c, cidr_end('10.1.0.0/16') d, ip_to_long('x') e").first()
    assert tuple(row) == (16909060, "1.2.3.4", int(ipaddress.IPv4Address("10.1.0.0")), int(ipaddress.IPv4Address("10.1.255.255")), 0)
    assert ipf.is_cidr_or_ip("1.2.3.4") and ipf.is_cidr_or_ip("1.2.3.0/24") and not ipf.is_cidr_or_ip("1.2.3")
    assert ipf.format_number(1234567) == "1,234,567"
    got = ipf.random_ips(spark, "10.0.0.0/24", 50, 1).collect()
    assert all((10 << 24) < x["ip"] < (10 << 24) + 255 for x in got)
    for bad in ("1.2.3.4", "1.2.3.4/33", "::/0", "x/8"):
        with pytest.raises(ValueError):
            ipf.parse_cidr(bad)
    assert ipf.parse_cidr("10.1.2.3/8") == (10 << 24, 8)


@pytest.mark.parametrize("pattern,good,bad", [
    ("bot", ["robot"], ["cat", ""]), ("^/a(b|c)$", ["/ab", "/ac"], ["/ab\n", "/abc"]), ("(?i)BOT", ["robot"], ["cat"]), ("(?P<x>a+)b", ["aab"], ["b"]), ("[[:digit:]]{2}", ["x12"], ["x1"]), ("[[:^alpha:]]", ["1"], ["a"]), ("a.c", ["abc", "a\rc"], ["a\nc"]),
    ("", ["x", ""], []), ("abc|def", ["xdefx"], ["de"]), (r"\$5", ["$5"], ["5"]), ("[]a]x", ["]x", "ax"], ["bx"]), ("[a&&b]", ["&"], ["c"]), (".*", ["x"], [""]),
])
def test_patterns(spark, pattern, good, bad):
    rows = spark.createDataFrame([(x,) for x in good + bad], "v string")
    assert sorted(x["v"] for x in rows.where(regex.gate(F.col("v"), pattern)).collect()) == sorted(good)


def test_bad_patterns_and_literals():
    for p in ("(", "a(?=b)", r"(a)\1", "[z-a]", "*", "[[:nope:]]"):
        with pytest.raises(regex.PatternError):
            regex.check(p)
    assert regex.required_literals("abc") == (["abc"], True)
    assert regex.required_literals("abc|de") == (["abc", "de"], True)
    assert regex.required_literals("^abc") == (["abc"], False)
    assert regex.required_literals("x.*hello[0-9]+") == (["hello"], False)
    assert regex.required_literals("a[bc]d") == (["abd", "acd"], True)
    assert regex.required_literals("(?i)abc") is None and regex.required_literals(".*") is None and regex.required_literals("a|bc") is None


def test_agent_lists(spark):
    rows = spark.createDataFrame([(1, "Good"), (2, "BAD"), (3, "other"), (4, ""), (5, "both"), (0, "bad")], "ip long, user_agent string")
    white, black = ["good", "# no", " ", "Both"], ["bad", "both"]
    for inline in (1000, 1):
        filters.INLINE, keep = inline, filters.INLINE
        got = {(x["ip"], x["user_agent"]): x["ua_class"] for x in filters.classify_agents(rows, white, black).collect()}
        filters.INLINE = keep
        assert got == {(1, "Good"): 1, (2, "BAD"): -1, (3, "other"): 0, (4, ""): 0, (5, "both"): 1, (0, "bad"): -1}
    assert [x["ip"] for x in filters.agent_ips(filters.classify_agents(rows, white, black), -1).collect()] == [2]


def test_jail():
    j = jail.Jail.new()
    t = [NOW]

    def update(*cidrs, later=timedelta(0)):
        t[0] += later
        return j.update(list(cidrs), t[0])

    update("10.0.0.0/24")
    assert j.stage_counts() == [(1, 1), (2, 0), (3, 0), (4, 0), (5, 0)] and j.active_bans() == ["10.0.0.0/24"]
    update("10.0.0.0/24", later=timedelta(minutes=10))  # exactly over is not over
    assert j.cells[0].prisoners and j.active_bans()
    update("10.0.0.0/24", later=timedelta(seconds=1))
    assert not j.cells[0].prisoners and j.cells[1].prisoners[0].active
    update("10.0.0.0/16", "10.1.0.0/16")  # takes the place of what it holds
    assert [p.cidr for p in j.cells[1].prisoners] == ["10.0.0.0/16"] and [p.cidr for p in j.cells[0].prisoners] == ["10.1.0.0/16"]
    assert j.all_cidrs == ["10.0.0.0/16", "10.1.0.0/16"]
    update("10.0.5.0/24")  # inside an active ban: nothing
    assert j.stage_counts()[:2] == [(1, 1), (2, 1)]
    update("10.0.5.0/24", later=timedelta(hours=5))  # inside one that ran out: the parent moves on
    assert [p.cidr for p in j.cells[2].prisoners] == ["10.0.0.0/16"]
    assert len(update("", "nonsense", "1.2.3.4", "9.9.9.0/24")) == 3 and "9.9.9.0/24" in j.active_bans()
    for _ in range(4):
        update("9.9.9.0/24", later=timedelta(days=400))
    assert [p.cidr for p in j.cells[4].prisoners] == ["9.9.9.0/24"]
    update("9.9.9.0/24", later=timedelta(days=400))  # the last stage renews
    assert len(j.cells[4].prisoners) == 1 and j.cells[4].prisoners[0].ban_start == t[0]
    meta = j.active_bans_with_meta()
    assert meta[0]["expires_at"] == meta[0]["ban_start"] + timedelta(days=180)
    again = jail.Jail.from_json(j.to_json())
    assert again == j and '"BanDuration": 600000000000' in j.to_json()
    assert jail.is_sub_range("10.0.0.7/24", "10.0.0.5/24") and not jail.is_sub_range("10.0.0.3/24", "10.0.0.5/24") and not jail.is_sub_range("::/64", "::/0")


def test_jail_files(tmp_path):
    path = str(tmp_path / "jail.json")
    assert jail.Jail.load(path) == jail.Jail.new()
    (tmp_path / "jail.json").write_text("{}")
    none = jail.Jail.load(path)
    none.update(["1.2.3.0/24"], NOW)
    assert none.cells == [] and none.active_bans() == []
    for bad in ("{", "[]", '{"Cells": [{"Id": "x"}]}'):
        (tmp_path / "jail.json").write_text(bad)
        with pytest.raises(jail.JailError):
            jail.Jail.load(path)
    old = '{"Cells":[{"Id":1,"Description":"d","BanDuration":600000000000,"Prisoners":[{"Cidr":"1.2.3.0/24","BanStart":"2025-01-01T00:00:00.123456789Z","BanActive":true}]}],"AllCidrs":["1.2.3.0/24"]}'
    assert jail.Jail.from_json(old).cells[0].prisoners[0].ban_start == datetime(2025, 1, 1, 0, 0, 0, 123456, tzinfo=timezone.utc)
    text = jail.ban_file(["1.0.0.0/8"], ["2.0.0.0/8"], NOW)
    assert text.splitlines()[1:] == ["# Ranges whose bans are in force", "1.0.0.0/8", "# Ranges from the manual list", "2.0.0.0/8", "# No more manual ranges"]
    assert len(jail.ban_file([], [], NOW).splitlines()) == 1
    jail.write_atomic(path, "x")
    assert (tmp_path / "jail.json").read_text() == "x" and len(list(tmp_path.iterdir())) == 1


def test_window(spark):
    r = random.Random(2)
    for _ in range(4):
        rows = [(k, r.randrange(5) + 1, NOW - timedelta(minutes=r.randint(0, 100))) for k in range(r.randint(0, 40))]
        bound, size = timedelta(minutes=r.randint(10, 90)), r.randint(0, 30)
        queue = list(rows)
        while queue and queue[0][2] < NOW - bound:
            queue.pop(0)
        queue = queue[len(queue) - size :] if len(queue) > size else queue
        df = spark.createDataFrame(rows, window.STATE)
        assert sorted(x["seq"] for x in window.evict(df, NOW, bound, size).collect()) == [x[0] for x in queue]


def test_traffic(spark):
    counts = spark.createDataFrame([(5, 3), (1, 9), (2, 3), (9, 1)], "ip long, c long")
    assert [x["ip"] for x in traffic.top_talkers(counts, 3).collect()] == [1, 2, 5]
    assert traffic.top_talkers(counts, 0).count() == 0 and traffic.top_talkers(counts, -1).count() == 0
    rows = spark.createDataFrame([(1, 7, NOW), (2, 8, NOW), (3, 7, NOW + timedelta(seconds=5)), (4, 7, NOW + timedelta(seconds=3))], "seq long, ip long, ts timestamp")
    got = {x["ip"]: x for x in traffic.inter_arrival(rows).collect()}
    assert (got[7]["deltas"], got[7]["count"], got[8]["deltas"]) == ([5.0, -2.0], 3, [])
