"""Specifications, static runs end to end, reports, command line."""

import json
from datetime import datetime, timedelta, timezone

import pytest

from rangeloom import cli
from rangeloom.functions.regex import PatternError
from rangeloom.plans import report, static
from rangeloom.plans.config import ConfigError, Spec, TrieSpec, check_logging, flag_sets, load_spec, parse_duration, parse_flexible_time, parse_rfc3339, parse_spec
from rangeloom.sources.lists import ListError, read_cidrs, read_patterns

NOW = datetime(2025, 3, 1, tzinfo=timezone.utc)
FMT = '%h %^ %^ [%t] "%r" %s %b "%^" "%u"'


def write_log(path):
    """1,600 requests in one /24, 300 in a /26, noise; agents and days vary; one malformed line."""
    out = []
    for k in range(1600):
        out.append(f'10.5.5.{k % 256} - - [{1 + k % 7:02d}/Feb/2025:10:00:00 +0000] "GET /api/{k % 3} HTTP/1.1" 200 12 "-" "{("scanner", "Mozilla", "goodbot")[k % 3]}"')
    for k in range(300):
        out.append(f'172.16.3.{64 + k % 64} - - [05/Feb/2025:10:00:00 +0000] "POST /login HTTP/1.1" 401 - "-" "evilbot"')
    out += [f'{50 + k}.1.2.{k} - - [05/Feb/2025:10:00:00 +0000] "GET / HTTP/1.1" 200 1 "-" "curl"' for k in range(20)]
    out += ["", 'x - - [05/Feb/2025:10:00:00 +0000] "GET / HTTP/1.1" 9 z "-" "curl"']
    path.write_text("\n".join(out) + "\n")


@pytest.fixture
def files(tmp_path):
    write_log(tmp_path / "a.log")
    (tmp_path / "white.txt").write_text("# ours\n10.5.5.0/25\n\n")
    (tmp_path / "black.txt").write_text("198.51.100.0/24\n10.5.5.64/26\n")
    (tmp_path / "uaw.txt").write_text("GOODBOT\n")
    (tmp_path / "uab.txt").write_text("curl\n# x\n")
    return tmp_path


def toml(d):
    return f"""
[global]
jailFile = "{d}/jail.json"
banFile = "{d}/ban.txt"
whitelist = "{d}/white.txt"
blacklist = "{d}/black.txt"
userAgentWhitelist = "{d}/uaw.txt"
userAgentBlacklist = "{d}/uab.txt"
[static]
logFile = "{d}/a.log"
logFormat = '{FMT}'
plotPath = "{d}/map.html"
[static.all]
clusterArgSets = [[100, 20, 28, 0.3], [1, 2, 3]]
useForJail = [true]
cidrRanges = ["10.5.0.0/16", "1.2.3.4", "172.16.3.64/26"]
[static.login]
endpointRegex = "^/login"
startTime = "2025-02-05T00:00:00Z"
endTime = "2025-02-06T00:00:00Z"
clusterArgSets = [[50, 24, 32, 0.2]]
useForJail = [true]
[static.never]
useragentRegex = "scanner"
startTime = "2030-01-01T00:00:00Z"
endTime = "bad"
clusterArgSets = [[5, 24, 32, 0.2]]
"""


def test_static_run(spark, files):
    (files / "spec.toml").write_text(toml(files))
    spec = load_spec(str(files / "spec.toml"))
    doc = static.analyse(spark, spec, now=NOW)
    kinds = [w["type"] for w in doc["warnings"]]
    for kind in ("malformed_field", "invalid_ips_skipped", "invalid_time_format", "time_filter_no_results", "invalid_cidr", "whitelist_applied", "blacklist_applied"):
        assert kind in kinds, kind
    assert not doc["errors"] and doc["general"]["total_requests"] == 1922
    every, login, never = doc["tries"]
    n = 1600 - len(range(2, 1600, 3)) + 300 + 20  # without the whitelisted agent
    assert every["stats"]["total_requests_after_filtering"] == n and every["stats"]["skipped_invalid_ips"] == 2
    assert [(r["cidr"], r["requests"]) for r in every["stats"]["cidr_analysis"]] == [("10.5.0.0/16", n - 320), ("172.16.3.64/26", 300)]
    assert [r["cidr"] for r in login["data"][0]["merged_ranges"]] == ["172.16.3.64/26"] and login["data"][0]["merged_ranges"][0]["percentage"] == 100.0
    assert never["stats"]["total_requests_after_filtering"] == 0 and never["data"][0]["detected_ranges"] == []
    assert len(doc["useragent_blacklist_ips"]) == 20 and doc["useragent_whitelist_ips"]
    bans = (files / "ban.txt").read_text()
    assert "172.16.3.64/26" in bans and "198.51.100.0/24" in bans and "50.1.2.0/32" in bans
    assert "10.5.5.64/26" not in bans and "10.5.5.0/25" not in bans  # the whitelist always wins
    assert json.loads((files / "jail.json").read_text())["Cells"][0]["Prisoners"]
    assert "<canvas" in (files / "map.html").read_text()
    text = report.to_plain(doc)
    assert "[analysis login]" in text and "    sum " in text and "Endpoint: ^/login, Time: 2025-02-05 00:00 → 2025-02-06 00:00" in text
    assert doc["general"]["parsing"]["duration_ms"] > 0 and all(c["execution_time_us"] > 0 for t in doc["tries"] for c in t["data"]) and every["stats"]["insert_time_ms"] > 0
    assert json.loads(report.to_json(doc)) == json.loads(report.to_json(doc, compact=True)) == doc


def test_flags_and_toml_agree(spark, files, capsys):
    (files / "spec.toml").write_text(f"[static]\nlogFile = \"{files}/a.log\"\nlogFormat = '{FMT}'\n[static.cli_trie]\nuseragentRegex = \"scanner|evil\"\nclusterArgSets = [[50, 20, 30, 0.3], [10, 24, 32, 0.1]]\nuseForJail = [true, true]\n")
    assert cli.main(["static", "--config", f"{files}/spec.toml", "--compact"]) == 0
    one = json.loads(capsys.readouterr().out)
    assert cli.main(["static", "--logfile", f"{files}/a.log", "--logFormat", FMT, "--useragentRegex", "scanner|evil", "--clusterArgSets", "50,20,30,0.3,10,24,32,0.1"]) == 0
    two = json.loads(capsys.readouterr().out)
    for doc in (one, two):  # times are measured
        assert doc["tries"][0]["stats"].pop("insert_time_ms") > 0
        assert all(c.pop("execution_time_us") > 0 for c in doc["tries"][0]["data"])
    assert one["tries"] == two["tries"] and one["tries"][0]["data"][0]["merged_ranges"]
    assert cli.main(["static", "--logfile", f"{files}/a.log", "--logFormat", FMT, "--plain"]) == 0
    assert "No issues" not in capsys.readouterr().out
    for bad in (["static"], ["static", "--config", "x", "--logfile", "y"], ["static", "--logfile", "x", "--rangesCidr", "nope"], ["static", "--logfile", "x", "--clusterArgSets", "1,2,3"], ["static", "--logfile", "x", "--logFormat", "%s"], ["live"], ["static", "--config", f"{files}/none.toml"]):
        assert cli.main(bad) == 1
        assert "error:" in capsys.readouterr().err


def test_empty_log(spark, tmp_path):
    (tmp_path / "e.log").write_text("")
    doc = static.analyse(spark, Spec(str(tmp_path / "e.log"), FMT, tries={"t": TrieSpec(sets=flag_sets([1, 8, 16, 0.1]))}), now=NOW)
    assert doc["general"]["total_requests"] == 0 and "empty_logfile" in [w["type"] for w in doc["warnings"]]


def test_needed_columns():
    assert static.needed_columns(Spec(tries={"a": TrieSpec()})) == ["ip"]
    assert "uri" in static.needed_columns(Spec(tries={"a": TrieSpec(endpoint_regex="x")})) and "ts" not in static.needed_columns(Spec(tries={"a": TrieSpec(endpoint_regex="x")}))


def test_specifications():
    assert parse_duration("1h30m") == timedelta(minutes=90) and parse_duration("1.5s") == timedelta(seconds=1.5) and parse_duration("-2m") == timedelta(minutes=-2) and parse_duration("0") == timedelta(0)
    for bad in ("", "5", "h", "5x", "1h 2m"):
        with pytest.raises(ConfigError):
            parse_duration(bad)
    assert parse_flexible_time("2025-02-01 05") == datetime(2025, 2, 1, 5, tzinfo=timezone.utc)
    with pytest.raises(ConfigError):
        parse_flexible_time("01/02/2025")
    assert parse_rfc3339("2025-02-01T00:00:00+02:00").utcoffset() == timedelta(hours=2) and parse_rfc3339("2025-02-01") is None and parse_rfc3339("2025-13-01T00:00:00Z") is None
    assert [s.min_size for s in flag_sets([1, 2, 3, 0.1, 4, 5, 6, 0.2])] == [1, 4]
    for bad in ([], [1, 2, 3], [1, 9, 8, 0.1]):
        with pytest.raises(ConfigError):
            flag_sets(bad)
    with pytest.raises(PatternError):
        parse_spec('[static.x]\nuseragentRegex = "("')
    for bad in ("[log]\nlvl = 1", '[log]\nlevel = "loud"', "x = [", "[static.a]\nclusterArgSets = [[1, 9, 8, 0.1]]", '[live]\nreadTimeout = "x"'):
        with pytest.raises(ConfigError):
            parse_spec(bad)
    check_logging("warn", "json")
    live = parse_spec('[global]\njailFile="j"\nbanFile="b"\n[live]\nport="9"\n[live.w]\nslidingWindowMaxTime="5m"\nslidingWindowMaxSize=7\nsleepBetweenIterations=3\nclusterArgSets=[[1,2,3,0.1]]')
    live.validate_live()
    assert live.windows["w"].max_time == timedelta(minutes=5) and live.windows["w"].max_size == 7 and not live.windows["w"].sets[0].use_for_jail
    for bad in ("", "[live]\n", '[live]\nport="9"', '[live]\nport="9"\nstatsListen="x"\n[global]\njailFile="j"\nbanFile="b"\n[live.w]\n', '[live]\nport="9"\n[global]\njailFile="j"\nbanFile="b"', '[live]\nport="9"\ntopTalkers=-1\n[global]\njailFile="j"\nbanFile="b"\n[live.w]\n'):
        with pytest.raises(ConfigError):
            parse_spec(bad).validate_live()


def test_lists(tmp_path):
    p = tmp_path / "l.txt"
    p.write_text("  1.2.3.0/24  \n\n# c\n")
    assert read_cidrs(str(p)) == ["1.2.3.0/24"] and read_patterns(str(p)) == ["1.2.3.0/24"]
    for bad in ("1.2.3.4\n", "1.2.3.0/24 # c\n", "x\n"):
        p.write_text("# first\n" + bad)
        with pytest.raises(ListError, match="line 2"):
            read_cidrs(str(p))
