"""The live loop, fed batch by batch and by a file stream; snapshot, metrics, HTTP; the receiver's protocol."""

import json
import socket
import struct
import time
import urllib.error
import urllib.request
import zlib
from datetime import datetime, timedelta, timezone

import pytest

from rangeloom.operators.clusters import ClusterParams
from rangeloom.plans.config import Spec, WindowSpec
from rangeloom.sources import lumberjack
from rangeloom.streaming.live import LiveLoop
from rangeloom.streaming.snapshot import StatsServer, duration_text, escape_label, render_metrics

T0 = datetime(2025, 7, 6, 12, tzinfo=timezone.utc)


def line(ip, at, agent="x", uri="/"):
    return f'{ip} - - [{at:%d/%b/%Y:%H:%M:%S} +0000] "GET {uri} HTTP/1.1" 200 5 "-" "{agent}"'


def batch(spark, lines):
    return spark.createDataFrame([(x,) for x in lines], "message string")


@pytest.fixture
def loop(spark, tmp_path):
    (tmp_path / "w.txt").write_text("10.9.0.0/16\n")
    (tmp_path / "b.txt").write_text("198.51.100.0/24\n")
    (tmp_path / "uaw.txt").write_text("friend\n")
    (tmp_path / "uab.txt").write_text("enemy\n")
    sets = [ClusterParams(8, 24, 30, 0.5, True)]
    spec = Spec(
        jail_file=str(tmp_path / "jail.json"), ban_file=str(tmp_path / "ban.txt"), whitelist=str(tmp_path / "w.txt"), blacklist=str(tmp_path / "b.txt"), ua_whitelist=str(tmp_path / "uaw.txt"), ua_blacklist=str(tmp_path / "uab.txt"), has_global=True,
        live={"port": "1", "statsListen": "", "topTalkers": 2}, windows={"main": WindowSpec(sets=sets, max_time=timedelta(minutes=10), max_size=50), "api": WindowSpec(endpoint_regex="^/api", sets=sets, max_time=timedelta(minutes=1), max_size=10)},
    )
    clock = [T0]
    out = LiveLoop(spark, spec, str(tmp_path / "state"), clock=lambda: clock[0])
    out.test_clock = clock
    return out


def test_loop(spark, loop, tmp_path):
    hot = [line(f"10.5.5.{k % 8}", T0) for k in range(32)]
    mine = [line(f"10.9.9.{k % 8}", T0) for k in range(16)]
    s = loop.step(batch(spark, hot + mine + [line("1.1.1.1", T0, "friend"), line("2.2.2.2", T0, "enemy"), "broken", line("::1", T0)]))
    main, api = s["windows"]
    assert (main["requests"], main["size_ips"], main["accepted_total"]) == (49, 17, 49) and api["rejected_by_filter_total"] == 49
    found = {r["cidr"]: r["count"] for r in main["cluster_sets"][0]["detected_now"]}
    assert found == {"10.5.5.0/29": 32, "10.9.9.0/29": 16} or set(found) == {"10.5.5.0/30", "10.5.5.4/30", "10.9.9.0/30", "10.9.9.4/30"}
    bans = (tmp_path / "ban.txt").read_text()
    assert "10.5.5." in bans and "10.9.9." not in bans and "2.2.2.2/32" in bans and "198.51.100.0/24" in bans and "1.1.1.1" not in bans
    assert s["ingest"]["parse_errors_total"] == 1 and s["lists"]["user_agent_lists"] == {"whitelist_hits_total": 1, "blacklist_hits_total": 1, "active_whitelist_ips": 1, "active_blacklist_ips": 1}
    assert s["windows"][0]["top_talkers"][0]["count"] >= 4 and s["jail"]["total_active"] >= 2
    assert loop.step(batch(spark, [])) is None and loop.step(batch(spark, ["broken"])) is None
    loop.test_clock[0] = T0 + timedelta(minutes=11)
    s = loop.step(batch(spark, [line("9.9.9.9", T0 + timedelta(minutes=11), uri="/api/x")]))
    assert s["windows"][0]["requests"] == 1 and s["windows"][1]["requests"] == 1 and s["loop"]["iterations"] == 2
    assert not [b for b in s["jail"]["active_bans"] if b["cidr"].startswith("10.5.5")]  # ten minutes are over
    assert s["lists"]["user_agent_lists"]["active_blacklist_ips"] == 0
    loop.step(batch(spark, [line("9.9.9.9", T0 + timedelta(minutes=11))] * 80))
    assert loop.snapshot["windows"][0]["requests"] == 50
    text = render_metrics(loop.snapshot)
    assert 'rangeloom_window_requests{window="main"} 50' in text and text.count("# TYPE") == 21


def test_stream(spark, loop, tmp_path):
    spool = tmp_path / "spool"
    spool.mkdir()
    (spool / "a.json").write_text("\n".join(json.dumps({"message": line(f"10.5.5.{k % 8}", T0)}) for k in range(40)) + "\n{}\n")
    loop.spooled = lambda: len(list(spool.glob("*.json"))) + 3
    q = loop.start(lumberjack.stream(spark, str(spool)), str(tmp_path / "cp"))
    q.processAllAvailable()
    assert loop.snapshot["ingest"]["queue_depth"] == 3
    (spool / "b.json").write_text(json.dumps({"message": line("10.5.5.1", T0)}) + "\n")
    q.processAllAvailable()
    q.stop()
    assert loop.snapshot["windows"][0]["requests"] == 41 and loop.snapshot["ingest"]["parse_errors_total"] == 1


def windows_of(loop):
    """What the windows hold, as (name, ip, time)."""
    return sorted((n, r["ip"], r["ts"]) for n, q in loop.queues.items() if q is not None for r in q.collect())


def test_replayed_batches_give_the_same_windows(spark, loop):
    batches = [[line(f"10.5.{b}.{k % 8}", T0, uri="/api/x") for k in range(6 + b)] for b in range(4)]
    for n, lines in enumerate(batches[:3]):
        loop.step(batch(spark, lines), n)
    once, counted = windows_of(loop), dict(loop.counters.accepted)
    loop.step(batch(spark, batches[2]), 2)  # the last one again
    assert windows_of(loop) == once and loop.counters.accepted == counted and loop.counters.batches == 3
    loop.step(batch(spark, batches[3]), 3)
    assert loop.counters.accepted["main"] == sum(map(len, batches)) and len(windows_of(loop)) == 30 + 10


def test_a_new_loop_goes_on(spark, loop, tmp_path):
    for n in range(3):
        loop.step(batch(spark, [line(f"10.7.0.{k}", T0) for k in range(8)] + [line("2.2.2.2", T0, "enemy")]), n)
    again = LiveLoop(spark, loop.spec, str(tmp_path / "state"), clock=lambda: T0)
    assert again.number == 3 and windows_of(again) == windows_of(loop) and again.counters.accepted == loop.counters.accepted
    s = again.step(batch(spark, [line("10.7.0.1", T0)]), 3)
    assert s["windows"][0]["requests"] == 28 and s["windows"][0]["accepted_total"] == 28 and s["lists"]["user_agent_lists"]["active_blacklist_ips"] == 1
    replayed = LiveLoop(spark, loop.spec, str(tmp_path / "state"), clock=lambda: T0)
    s = replayed.step(batch(spark, [line("10.7.0.1", T0)]), 3)  # published, but the stream had not committed it
    assert s["windows"][0]["requests"] == 28 and s["windows"][0]["accepted_total"] == 28
    state = tmp_path / "state"
    assert sorted(p.name for p in state.glob("manifest-*.json")) == ["manifest-3.json", "manifest-4.json"]
    assert all(len(list((state / t).iterdir())) == 2 for t in ("window-main", "window-api", "agents"))


def test_server(spark, loop):
    server = StatsServer("127.0.0.1:0")
    url = f"http://127.0.0.1:{server.address[1]}"
    try:
        with pytest.raises(urllib.error.HTTPError) as e:
            urllib.request.urlopen(url + "/stats")
        assert e.value.code == 503 and e.value.headers["Retry-After"] == "5"
        loop.server = server
        loop.step(batch(spark, [line("9.9.9.9", T0)]))
        assert json.load(urllib.request.urlopen(url + "/stats"))["schema_version"] == 1
        assert urllib.request.urlopen(url + "/bans").read().startswith(b"# Written by")
        assert b"rangeloom_uptime_seconds" in urllib.request.urlopen(url + "/metrics").read()
        with pytest.raises(urllib.error.HTTPError):
            urllib.request.urlopen(url + "/none")
    finally:
        server.shutdown()


def test_labels_and_durations():
    assert escape_label('a"b\\c\nd') == 'a\\"b\\\\c\\nd'
    assert [duration_text(timedelta(seconds=s)) for s in (600, 14400, 604800, 1.5, 0)] == ["10m0s", "4h0m0s", "168h0m0s", "1.5s", "0s"]


def frame(seq, event):
    raw = json.dumps(event).encode()
    return b"2J" + struct.pack(">II", seq, len(raw)) + raw


def test_receiver(spark, tmp_path):
    r = lumberjack.Receiver("127.0.0.1:0", str(tmp_path / "spool"))
    try:
        with socket.create_connection(r.address, timeout=10) as s:
            s.sendall(b"2W" + struct.pack(">I", 2) + frame(1, {"message": "one", "more": 1}) + frame(2, {"other": 2}))
            assert s.recv(6) == b"2A" + struct.pack(">I", 2)
            inner = zlib.compress(frame(1, {"message": "zwei ü"}) + frame(2, {"message": "three"}))
            s.sendall(b"2W" + struct.pack(">I", 2) + b"2C" + struct.pack(">I", len(inner)) + inner)
            assert s.recv(6) == b"2A" + struct.pack(">I", 2)
        with socket.create_connection(r.address, timeout=10) as s:
            s.sendall(b"garbage")
            s.shutdown(socket.SHUT_WR)
            assert s.recv(6) == b""
        time.sleep(0.1)
        got = spark.read.schema(lumberjack.EVENT).json(str(tmp_path / "spool"))
        assert sorted(x["message"] or "" for x in got.collect()) == ["", "one", "three", "zwei ü"]
        assert (r.batches, r.events) == (2, 4)
    finally:
        r.close()
