"""The analysis specification: TOML documents or keyword arguments, checked on the driver."""

from __future__ import annotations

import logging
import os
import re
import tomllib
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from ..functions.regex import check
from ..operators.clusters import ClusterParams, ParameterError
from ..sources.lists import read_cidrs, read_patterns
from ..sources.logformat import DEFAULT


class ConfigError(ValueError):
    pass


#: Where the register and the ban file go if nothing is said.
JAIL_FILE, BAN_FILE = os.path.expanduser("~/jail.json"), os.path.expanduser("~/banFile.txt")
READ_TIMEOUT = timedelta(seconds=5)
#: A live window's defaults when flags give no others: time, size, pause in seconds, parameter set.
WINDOW_TIME, WINDOW_SIZE, PAUSE, LIVE_SET = timedelta(hours=2), 100_000, 10, (1000, 30, 32, 0.2)
_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "μs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


def parse_duration(text: str) -> timedelta:
    """``2h``, ``30m``, ``1h30m``, ``1.5s``, ``0``; ConfigError otherwise."""
    body = text.lstrip("+-") if text[:1] in "+-" else text
    if body == "0":
        return timedelta(0)
    parts = re.findall(r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|μs|ms|s|m|h)", body)
    if not parts or "".join(a + b for a, b in parts) != body:
        raise ConfigError(f"invalid duration {text!r}")
    return timedelta(seconds=sum(float(a) * _UNITS[b] for a, b in parts)) * (-1 if text[0] == "-" else 1)


def parse_rfc3339(text: str) -> datetime | None:
    """An RFC 3339 time, or None."""
    if not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d([.,]\d+)?(Z|[+-]\d\d:\d\d)", text):
        return None
    try:
        return datetime.fromisoformat(text.replace("Z", "+00:00").replace(",", "."))
    except ValueError:
        return None


def parse_flexible_time(text: str) -> datetime:
    """``YYYY-MM-DD``, with `` HH`` or `` HH:MM`` behind it, in UTC."""
    for shape in ("%Y-%m-%d %H:%M", "%Y-%m-%d %H", "%Y-%m-%d"):
        try:
            return datetime.strptime(text, shape).replace(tzinfo=timezone.utc)
        except ValueError:
            continue
    raise ConfigError(f"invalid time {text!r}: want YYYY-MM-DD, YYYY-MM-DD HH or YYYY-MM-DD HH:MM")


def flag_sets(numbers: list[float], use_for_jail: bool = True) -> list[ClusterParams]:
    """Parameter sets of a flat list: four numbers each."""
    if not numbers or len(numbers) % 4:
        raise ConfigError(f"cluster parameters come in fours, got {len(numbers)}")
    out = []
    for k in range(0, len(numbers), 4):
        size, low, high, diff = numbers[k : k + 4]
        try:
            out.append(ClusterParams(int(size), int(low), int(high), float(diff), use_for_jail))
        except ParameterError as e:
            raise ConfigError(str(e)) from e
    return out


def _toml_sets(doc: dict) -> list[ClusterParams]:
    """``clusterArgSets`` with ``useForJail`` by place; sets with fewer than four numbers are no sets, inverted depths an error."""
    flags = [b for b in doc.get("useForJail") or [] if isinstance(b, bool)]
    out: list[ClusterParams] = []
    for item in doc.get("clusterArgSets") or []:
        numbers = [x for x in item if isinstance(x, (int, float)) and not isinstance(x, bool)] if isinstance(item, list) else []
        if len(numbers) < 4:
            continue
        try:
            out.append(ClusterParams(int(numbers[0]), int(numbers[1]), int(numbers[2]), float(numbers[3]), len(out) < len(flags) and flags[len(out)]))
        except ParameterError as e:
            raise ConfigError(str(e)) from e
    return out


@dataclass
class TrieSpec:
    """One static analysis: filters, reported ranges, parameter sets."""

    user_agent_regex: str | None = None
    endpoint_regex: str | None = None
    start: datetime | None = None
    end: datetime | None = None
    cidr_ranges: list[str] = field(default_factory=list)
    sets: list[ClusterParams] = field(default_factory=list)
    bad_times: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        for p in (self.user_agent_regex, self.endpoint_regex):
            if p:
                check(p)


@dataclass
class WindowSpec(TrieSpec):
    """One live window: as above, with its bounds and the pause between iterations."""

    max_time: timedelta = timedelta(0)
    max_size: int = 0
    pause: int = 0


@dataclass
class Spec:
    """Everything a run needs."""

    log_file: str = ""
    log_format: str = DEFAULT
    plot_path: str = ""
    jail_file: str = ""
    ban_file: str = ""
    whitelist: str = ""
    blacklist: str = ""
    ua_whitelist: str = ""
    ua_blacklist: str = ""
    tries: dict[str, TrieSpec] = field(default_factory=dict)
    windows: dict[str, WindowSpec] = field(default_factory=dict)
    live: dict | None = None
    log_level: str = "info"
    log_style: str = "text"
    has_global: bool = False

    @property
    def jail_path(self) -> str:
        return self.jail_file or JAIL_FILE

    @property
    def ban_path(self) -> str:
        return self.ban_file or BAN_FILE

    def cidrs(self, which: str) -> list[str]:
        path = getattr(self, which)
        return read_cidrs(path) if path else []

    def agents(self, which: str) -> list[str]:
        path = getattr(self, which)
        return read_patterns(path) if path else []

    @property
    def jails(self) -> bool:
        """Static runs keep a register only where both files are named."""
        return bool(self.jail_file and self.ban_file)

    def validate_live(self) -> None:
        if self.live is None:
            raise ConfigError("live configuration section is required")
        if not self.live.get("port"):
            raise ConfigError("port is required in live configuration")
        listen = self.live.get("statsListen")
        if listen and not re.fullmatch(r"(\[[^\]]*\]|[^:\[\]]*):[^:]*", listen):
            raise ConfigError(f"invalid statsListen {listen!r} (want host:port)")
        if self.live["topTalkers"] < 0:
            raise ConfigError(f"topTalkers must be >= 0, got {self.live['topTalkers']}")
        if not self.has_global:
            raise ConfigError("global configuration section is required for live mode")
        if not self.jail_file or not self.ban_file:
            raise ConfigError("jailFile and banFile are required in global configuration for live mode")
        if not self.windows:
            raise ConfigError("at least one sliding window is required in live mode")


def _text(doc: dict, key: str) -> str:
    v = doc.get(key)
    return v if isinstance(v, str) else ""


def _trie(doc: dict) -> dict:
    out = {"user_agent_regex": _text(doc, "useragentRegex") or None, "endpoint_regex": _text(doc, "endpointRegex") or None, "sets": _toml_sets(doc), "bad_times": {}}
    for key, name in (("startTime", "start"), ("endTime", "end")):
        if raw := _text(doc, key):
            got = parse_rfc3339(raw)
            out[name] = got
            if got is None:
                out["bad_times"][key] = raw
    out["cidr_ranges"] = [c for c in doc.get("cidrRanges") or [] if isinstance(c, str)]
    return out


def parse_spec(text: str) -> Spec:
    """A specification of a TOML text. Every sub-table of [static] is an analysis, of [live] a window; [log] takes only its own keys."""
    try:
        doc = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"invalid TOML: {e}") from e
    spec = Spec()
    if isinstance(g := doc.get("global"), dict):
        spec.has_global = True
        for key, name in (("jailFile", "jail_file"), ("banFile", "ban_file"), ("whitelist", "whitelist"), ("blacklist", "blacklist"), ("userAgentWhitelist", "ua_whitelist"), ("userAgentBlacklist", "ua_blacklist")):
            setattr(spec, name, _text(g, key))
    if isinstance(s := doc.get("static"), dict):
        spec.log_file, spec.plot_path = _text(s, "logFile"), _text(s, "plotPath")
        spec.log_format = _text(s, "logFormat") or DEFAULT
        spec.tries = {name: TrieSpec(**_trie(t)) for name, t in s.items() if isinstance(t, dict)}
    if isinstance(v := doc.get("live"), dict):
        top = v.get("topTalkers")
        timeout = parse_duration(v["readTimeout"]) if isinstance(v.get("readTimeout"), str) else READ_TIMEOUT
        spec.live = {"port": _text(v, "port"), "statsListen": _text(v, "statsListen"), "topTalkers": top if isinstance(top, int) else 0, "readTimeout": timeout}
        for name, t in v.items():
            if isinstance(t, dict):
                size, pause = t.get("slidingWindowMaxSize"), t.get("sleepBetweenIterations")
                spec.windows[name] = WindowSpec(
                    **_trie(t), max_time=parse_duration(t["slidingWindowMaxTime"]) if isinstance(t.get("slidingWindowMaxTime"), str) else timedelta(0),
                    max_size=size if isinstance(size, int) else 0, pause=pause if isinstance(pause, int) else 0,
                )
    if isinstance(log := doc.get("log"), dict):
        if unknown := set(log) - {"level", "format"}:
            raise ConfigError(f"unknown key {sorted(unknown)[0]!r} in [log] section (want level, format)")
        spec.log_level, spec.log_style = log.get("level", "info"), log.get("format", "text")
        check_logging(spec.log_level, spec.log_style)
    return spec


def load_spec(path: str) -> Spec:
    with open(path, encoding="utf-8") as f:
        return parse_spec(f.read())


def check_logging(level: str, style: str) -> None:
    if str(level).lower() not in ("", "debug", "info", "warn", "warning", "error"):
        raise ConfigError(f"invalid log level {level!r} (want debug, info, warn or error)")
    if str(style).lower() not in ("", "text", "json"):
        raise ConfigError(f"invalid log format {style!r} (want text or json)")


def logger(level: str = "info", style: str = "text") -> logging.Logger:
    """Leveled logging to standard error, as text or one JSON object a line."""
    import json

    check_logging(level, style)

    class Json(logging.Formatter):
        def format(self, r: logging.LogRecord) -> str:
            return json.dumps({"time": self.formatTime(r), "level": r.levelname, "msg": r.getMessage()} | getattr(r, "fields", {}))

    out = logging.getLogger("rangeloom")
    out.setLevel({"warn": "WARNING", "": "INFO"}.get(level.lower(), level.upper()))
    handler = logging.StreamHandler()
    handler.setFormatter(Json() if style == "json" else logging.Formatter("time=%(asctime)s level=%(levelname)s msg=%(message)s"))
    out.handlers[:] = [handler]
    return out
