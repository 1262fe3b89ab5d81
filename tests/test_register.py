"""The register as a table, its file and the ban file, against the register of the driver."""

import random
import time
from datetime import datetime, timedelta, timezone

import pytest

from rangeloom.operators import jail, ranges, register
from rangeloom.plans import catalog_io, catalog_state
from rangeloom.sources.scratch import new_folder
from rangeloom.streaming import snapshot

NOW = datetime(2025, 3, 1, tzinfo=timezone.utc)
SF = "/root/testdata/sf0.001"


@pytest.fixture
def no_lists(monkeypatch):
    """What holds a whole register or list on the driver fails."""

    def refuse(*_, **__):
        raise AssertionError("on the driver")

    for owner, name in ((jail.Jail, "to_json"), (jail.Jail, "from_json"), (jail, "Prisoner"), (ranges, "subtract_lists"), (catalog_io, "_texts"), (catalog_io, "_range_texts")):
        monkeypatch.setattr(owner, name, refuse)


def cut(spark):
    """Small splits and parts, so that order is not that of one task."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


small_parts = pytest.fixture(cut)


def test_without_matches_lists(spark):
    black = ["10.0.0.0/24", "10.0.0.0/24", "10.0.0.7/24", "10.0.1.5/32", "10.0.2.0/30", "::/64", "nonsense", "10.0.0.9/32", "9.0.0.3/8", "1.2.3.4"]
    white = ["10.0.0.8/30", "10.0.1.0/24", "10.0.2.2/31", "10.0.0.64/26"]
    texts = spark.createDataFrame([(c, k) for k, c in enumerate(black)], "cidr string, ord int")
    for w in (white, ["10.0.1.0/24"], []):
        got = ranges.without(texts, ranges.parse(spark.createDataFrame([(c,) for c in w], "cidr string"))).orderBy("ord", "start")
        assert [r["cidr"] for r in got.collect()] == ranges.subtract_lists(black, w)


def test_ban_file_matches_lists(spark, small_parts):
    active, manual = [f"10.0.{k % 7}.{k}/32" for k in range(200)], ["1.0.0.0/8", "0.0.0.0/9"]
    table = lambda texts: spark.createDataFrame([(c, k) for k, c in enumerate(texts)], "cidr string, ord int")
    for a, m in ((active, manual), ([], manual), (active, []), ([], [])):
        register.write_ban_file(path := new_folder(spark, "bans"), table(a), table(m), NOW)
        assert "".join(r[0] for r in spark.read.text(path, wholetext=True).collect()) == jail.ban_file(a, m, NOW)
        got = register.read_ban_file(spark, path).collect()
        assert sorted(map(tuple, got)) == sorted([("active", c) for c in a] + [("manual", c) for c in m])


def test_ban_file_holds_no_list(spark, no_lists):
    assert catalog_io.ban_file(spark, SF).count()


def test_register_file_matches_jail(spark, small_parts):
    """The same text as that of the driver's register, but for spaces; both read either."""
    j, t = jail.Jail.new(), [NOW + timedelta(microseconds=k % 3, hours=k) for k in range(60)]
    for k, now in enumerate(t):
        j.cells[(0, 1, 3)[k % 3]].prisoners.append(jail.Prisoner(f"10.{k}.0.0/16" if k else 'odd "é\\', now, k % 4 > 0))
        j.all_cidrs.append(j.cells[(0, 1, 3)[k % 3]].prisoners[-1].cidr)
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        register.Register.of(spark, j).save(path := new_folder(spark, "jail"))
        assert jail.Jail.from_json(spark.read.text(path, wholetext=True).first()[0]) == j
        got = register.Register.load(spark, path)
        assert got.stage_counts() == j.stage_counts() and got.first_active(7) == j.first_active(7)
        assert [r[0] for r in got.listed.orderBy("at").collect()] == j.all_cidrs
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_round_trip_holds_no_register(spark, no_lists, monkeypatch):
    monkeypatch.undo()
    monkeypatch.setattr(jail.Jail, "save", lambda *_: 1 / 0)
    assert catalog_io.jail_file_round_trip(spark, SF).count()


@pytest.mark.parametrize("page", ["stats_page_bans", "stats_page_lists", "metrics_page"])
def test_pages_hold_what_they_show(spark, monkeypatch, page):
    """Neither the register nor a list is collected: 500 bans and 1,000 entries at most."""
    monkeypatch.setattr(jail, "Prisoner", lambda *_: 1 / 0)
    monkeypatch.setattr(catalog_io, "_range_texts", lambda *_: 1 / 0)
    assert getattr(catalog_io, page)(spark, SF).count()


@pytest.mark.parametrize("page", ["stats_page_lists", "metrics_page"])
def test_pages_collect_what_they_show(spark, monkeypatch, page):
    """No more rows reach the driver than the page shows, however many there are of bans (1,500 here) and entries (150)."""
    monkeypatch.setattr(snapshot, "MOST_BANS", 9)
    monkeypatch.setattr(snapshot, "MOST_CIDRS", 7)
    kind, sizes = type(spark.range(1)), []
    for name in ("collect", "toPandas", "toLocalIterator"):
        real = getattr(kind, name)
        monkeypatch.setattr(kind, name, lambda self, *a, _real=real, **k: (lambda got: (sizes.append(len(got)), got)[1])(_real(self, *a, **k)))
    got = getattr(catalog_io, page)(spark, SF)
    assert max(sizes) <= 9
    monkeypatch.undo()
    assert got.count() == (7 if page == "stats_page_lists" else 9 + 11)


def test_replay_matches_one_register(spark):
    rng = random.Random(4)
    texts = [f"10.{rng.randrange(3)}.{rng.randrange(2)}.{rng.randrange(256)}/{rng.choice((14, 15, 16, 20, 24, 28, 32, 32, 32))}" for _ in range(60)]
    texts += ["::/64", "nonsense", "172.16.0.0/255.255.0.0", "172.16.9.9/32", "", "200.0.0.1/32"]
    rounds = [[rng.choice(texts) for _ in range(25)] for _ in range(8)]
    times = [NOW + timedelta(hours=h) for h in (0, 1, 6, 7, 200, 201, 2000, 9000)]
    j, failed = jail.Jail.new(), []
    for cidrs, t in zip(rounds, times, strict=True):
        failed += j.update(cidrs, t)
        assert sorted(j.all_cidrs) == sorted(p.cidr for c in j.cells for p in c.prisoners)
    rows = spark.createDataFrame([(r, k, c) for r, cidrs in enumerate(rounds) for k, c in enumerate(cidrs)], "round int, ord int, cidr string")
    got = jail.replay(rows, times).collect()
    assert sorted(r["failed"] for r in got if r["failed"]) == sorted(failed) and failed
    held = [(r["cell_id"], r["cidr"], r["ban_start"].timestamp(), r["ban_active"]) for r in got if not r["failed"]]
    assert sorted(held) == sorted((c.id, p.cidr, p.ban_start.timestamp(), p.active) for c in j.cells for p in c.prisoners)


def test_register_takes_many_at_once():
    """Time in proportion to the list: 32,768 addresses go into 128 ranges; the lists were searched for each before."""
    j, began = jail.Jail.new(), time.process_time()
    singles = [f"10.0.{k >> 8}.{k & 255}/32" for k in range(1 << 15)]
    assert not j.update(singles, NOW) and not j.update([f"10.0.{k}.0/24" for k in range(127, -1, -1)], NOW)
    assert j.all_cidrs == [p.cidr for p in j.cells[0].prisoners] == [f"10.0.{k}.0/24" for k in range(127, -1, -1)]
    assert time.process_time() - began < 8


def test_replays_hold_no_keys(spark, monkeypatch):
    monkeypatch.setattr(jail.Jail, "update", lambda *_: 1 / 0)
    for name in ("jail_replay", "jail_absorb"):
        assert getattr(catalog_state, name)(spark, SF).columns


def test_groups_hold_what_meets(spark, monkeypatch):
    """One busy /16 network is many groups, and each range is in one group with all that it meets."""
    monkeypatch.setattr(jail, "GROUP", 100)
    texts = [f"10.0.{k >> 8}.{k & 255}/32" for k in range(5000)] + [f"10.0.{k}.{17 * k}/28" for k in range(15)] + ["10.0.3.9/24", "10.0.3.0/255.255.255.0", "10.0.4.0/026"]
    texts += ["11.7.0.0/12", "11.9.0.0/255.255.0.0", "11.15.1.1/32", "11.16.0.0/32", "::/64", "nonsense", "", None]
    rows = spark.createDataFrame([(r, k, c) for k, c in enumerate(texts) for r in (0, 1)], "round int, ord int, cidr string")
    got = jail.parted(rows).collect()
    assert sorted((r["round"], r["ord"], r["cidr"] or "") for r in got) == sorted((r, k, c or "") for k, c in enumerate(texts) for r in (0, 1))
    groups, of = {}, {}
    for r in got:
        groups.setdefault((r["part"], r["group"]), []).append(r["cidr"])
        of.setdefault(r["cidr"], set()).add((r["part"], r["group"]))
    assert all(len(g) == 1 for g in of.values())
    assert len(groups) > 50 and max(map(len, groups.values())) <= 100 + 2 * 260
    spans = [(c, s) for c in texts if c and (s := jail._span(c))]
    for wide, (_, last, n) in spans:
        if n < 32:
            first = last >> 32 - n << 32 - n
            assert {g for c, s in spans if first <= s[0] <= last for g in of[c]} == of[wide]


@pytest.mark.parametrize("odd", [False, True])
def test_replay_by_single_ranges_matches_one_register(spark, monkeypatch, odd):
    """Groups of one outermost range each; with texts that only Python reads and without."""
    monkeypatch.setattr(jail, "GROUP", 1)
    rng = random.Random(6)
    texts = [f"10.0.{rng.randrange(2)}.{rng.randrange(64)}/{rng.choice((24, 26, 27, 28, 30, 31, 32, 32, 32))}" for _ in range(60)]
    texts += ["172.16.0.0/255.255.0.0", "172.16.9.9/32", "10.0.0.0/255.255.255.192", "12.0.0.0/07", "13.1.1.1/32"] if odd else ["::/64", "nonsense", "1.2.3.4", "1.2.3.4/33", "1.2.3.256/8", "12.0.0.0/7", "13.1.1.1/32", "13.1.1.1/32\n"]
    rounds = [[rng.choice(texts) for _ in range(25)] for _ in range(8)]
    times = [NOW + timedelta(hours=h) for h in (0, 1, 6, 7, 200, 201, 2000, 9000)]
    j, failed = jail.Jail.new(), []
    for cidrs, t in zip(rounds, times, strict=True):
        failed += j.update(cidrs, t)
    rows = spark.createDataFrame([(r, k, c) for r, cidrs in enumerate(rounds) for k, c in enumerate(cidrs)], "round int, ord int, cidr string")
    got = jail.replay(rows, times).collect()
    assert sorted(r["failed"] for r in got if r["failed"]) == sorted(failed) and bool(failed) != odd
    held = [(r["cell_id"], r["cidr"], r["ban_start"].timestamp(), r["ban_active"]) for r in got if not r["failed"]]
    assert sorted(held) == sorted((c.id, p.cidr, p.ban_start.timestamp(), p.active) for c in j.cells for p in c.prisoners)


def test_blocks_match_python(spark):
    """Whatever the spelling: the plan's blocks are those that the register sees."""
    rng = random.Random(7)
    texts = ["0.0.0.0/0", "255.255.255.255/32", "1.2.3.4/00", "1.2.3.4/255.0.0.0", "1.2.3.4/0.0.0.255", "01.2.3.4/8", "1.2.3.4/8\n", " 1.2.3.4/8", "1.2.3.4/8/9", "1.2.3/8", "::1.2.3.4/96", "1.2.3.4/+8", "1.2.3.4/٨"]
    for _ in range(3000):
        text = list(f"{rng.randrange(260)}.{rng.randrange(260)}.{rng.randrange(260)}.{rng.randrange(260)}/{rng.choice((rng.randrange(36), '255.255.0.0', '08'))}")
        if rng.random() < 0.5:
            text[rng.randrange(len(text))] = rng.choice("0123456789./ :a")
        texts.append("".join(text))
    got = jail._with_block(spark.createDataFrame([(t,) for t in texts], "cidr string"), True).collect()
    assert [(r["start"], r["len"]) for r in got] == [((s[1] >> 32 - s[2] << 32 - s[2], s[2]) if (s := jail._span(t)) else (-1, -1)) for t in texts]
