"""Command line: ``python -m rangeloom static ...`` and ``python -m rangeloom live ...``."""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace

from .functions.ip import is_cidr_or_ip
from .functions.regex import PatternError
from .plans import report, static
from .plans.config import LIVE_SET, PAUSE, WINDOW_SIZE, WINDOW_TIME, ConfigError, Spec, TrieSpec, WindowSpec, flag_sets, load_spec, parse_duration, parse_flexible_time
from .sources.lists import ListError
from .sources.logformat import DEFAULT, FormatError

#: Flags that go together with --config.
WITH_CONFIG = {"config", "command", "tui", "compact", "plain", "log_level", "master", "state_dir"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rangeloom", description="Ranges where requests concentrate")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("static", "live"):
        c = sub.add_parser(name)
        for flag in ("config", "useragentRegex", "endpointRegex", "jailFile", "banFile", "whitelist", "blacklist", "userAgentWhitelist", "userAgentBlacklist", "master"):
            c.add_argument(f"--{flag}", default=None)
        if name == "static":
            for flag in ("logfile", "logFormat", "startTime", "endTime", "plotPath"):
                c.add_argument(f"--{flag}", default=None)
            c.add_argument("--clusterArgSets", default=None, help="numbers in fours, separated by commas")
            c.add_argument("--rangesCidr", action="append", default=None)
            for flag in ("compact", "plain"):
                c.add_argument(f"--{flag}", action="store_true")
        else:
            for flag in ("port", "logLevel", "slidingWindowMaxTime", "clusterArgSet", "stateDir"):
                c.add_argument(f"--{flag}", default=None)
            for flag in ("slidingWindowMaxSize", "sleepBetweenIterations"):
                c.add_argument(f"--{flag}", type=int, default=None)
    return p


def _numbers(text: str | None) -> list[float]:
    return [float(x) for x in text.split(",")] if text else []


def spec_of(a: argparse.Namespace) -> Spec:
    """The specification of parsed flags; ConfigError where flags exclude each other or are malformed."""
    if a.config:
        extra = [k for k, v in vars(a).items() if v not in (None, False) and k not in ("config", "command", "compact", "plain", "master", "stateDir", "logLevel")]
        if extra:
            raise ConfigError(f"--config can't be used together with --{extra[0]}")
        return load_spec(a.config)
    files = {
        "jail_file": a.jailFile or "", "ban_file": a.banFile or "", "whitelist": a.whitelist or "", "blacklist": a.blacklist or "",
        "ua_whitelist": a.userAgentWhitelist or "", "ua_blacklist": a.userAgentBlacklist or "", "has_global": True,
    }
    try:
        if a.command == "static":
            if not a.logfile:
                raise ConfigError("--logfile or --config is required")
            for r in a.rangesCidr or []:
                if not is_cidr_or_ip(r):
                    raise ConfigError(f"invalid CIDR or address: {r}")
            sets = flag_sets(_numbers(a.clusterArgSets)) if a.clusterArgSets else []
            trie = TrieSpec(a.useragentRegex, a.endpointRegex, parse_flexible_time(a.startTime) if a.startTime else None, parse_flexible_time(a.endTime) if a.endTime else None, a.rangesCidr or [], sets)
            return Spec(a.logfile, a.logFormat or DEFAULT, a.plotPath or "", tries={"cli_trie": trie}, **files)
        if not a.port:
            raise ConfigError("--port or --config is required")
        sets = flag_sets(_numbers(a.clusterArgSet) or list(LIVE_SET))
        longest = parse_duration(a.slidingWindowMaxTime) if a.slidingWindowMaxTime else WINDOW_TIME
        pause = PAUSE if a.sleepBetweenIterations is None else a.sleepBetweenIterations
        window = WindowSpec(a.useragentRegex, a.endpointRegex, sets=sets, max_time=longest, max_size=a.slidingWindowMaxSize or WINDOW_SIZE, pause=pause)
        spec = Spec(windows={"cli_window": window}, live={"port": a.port, "statsListen": "", "topTalkers": 0}, **files)
        return replace(spec, jail_file=spec.jail_path, ban_file=spec.ban_path, log_level=a.logLevel or "info")
    except (PatternError, ValueError) as e:
        raise ConfigError(str(e)) from e


def session(master: str | None):
    from pyspark.sql import SparkSession

    b = SparkSession.builder.appName("rangeloom").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    return (b.master(master) if master else b).getOrCreate()


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        spec = spec_of(a)
        if a.command == "live":
            return run_live(spec, a)
        doc = static.analyse(session(a.master), spec)
    except (ConfigError, FormatError, ListError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    print(report.to_plain(doc) if a.plain else report.to_json(doc, a.compact), end="\n")
    return 0


def run_live(spec: Spec, a: argparse.Namespace) -> int:
    """Receive on the port, stream the spool, publish statistics."""
    from .sources import lumberjack
    from .streaming.live import LiveLoop
    from .streaming.snapshot import StatsServer

    spec.validate_live()
    spark, state = session(a.master), a.stateDir or "rangeloom-state"
    server = StatsServer(spec.live["statsListen"]) if spec.live.get("statsListen") else None
    port = spec.live["port"]
    receiver = lumberjack.Receiver(port if ":" in port else f":{port}", f"{state}/spool")
    loop = LiveLoop(spark, spec, f"{state}/tables", server, spooled=receiver.spooled)
    try:
        loop.start(lumberjack.stream(spark, f"{state}/spool"), f"{state}/checkpoint").awaitTermination()
    finally:
        receiver.close()
        if server:
            server.shutdown()
    return 0
