"""What the live loop shows: a snapshot document, metrics text, and an HTTP server for both and the ban list."""

from __future__ import annotations

import json
import threading
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from ..operators.jail import Jail
from ..operators.register import Register
from ..plans.config import Spec
from ..plans.report import rfc3339

#: Entries of lists and bans that a snapshot shows; totals stay exact. Top talkers are renewed every so many iterations.
MOST_BANS, MOST_CIDRS, TALKERS_EVERY, SCHEMA = 500, 1000, 5, 1


@dataclass
class Counters:
    """Totals since the start, kept by the loop alone."""

    started: datetime
    accepted: dict[str, int]
    rejected: dict[str, int]
    iterations: int = 0
    batches: int = 0
    requests: int = 0
    parse_errors: int = 0
    malformed: int = 0
    files: int = 0
    last_batch: datetime | None = None
    ua_white_hits: int = 0
    ua_black_hits: int = 0
    ua_white_ips: int = 0
    ua_black_ips: int = 0
    ban_content: str = ""
    ban_entries: int = 0
    ban_written: datetime | None = None
    connected: bool = True
    queue_depth: int = 0
    talkers: dict[str, list[dict]] = field(default_factory=dict)


@dataclass
class Listed:
    """A list as a snapshot shows it: its number of entries and the first of them."""

    entries: int
    first: list[str]

    @classmethod
    def of(cls, cidrs: list[str]) -> Listed:
        return cls(len(cidrs), cidrs[:MOST_CIDRS])


def _when(t: datetime | None) -> str:
    return rfc3339(t) if t else "0001-01-01T00:00:00Z"


def duration_text(d: timedelta) -> str:
    """``4h0m0s``, ``10m0s``, ``1.5s``."""
    s = d.total_seconds()
    h, rest = divmod(s, 3600)
    m, rest = divmod(rest, 60)
    last = f"{rest:g}s"
    return f"{h:.0f}h{m:.0f}m{last}" if h else f"{m:.0f}m{last}" if m else last


def build_snapshot(spec: Spec, c: Counters, windows: dict, found: list[dict], jail: Jail | Register, white: Listed, black: Listed, now: datetime, took: float, pause: int) -> dict:
    """The document of one iteration. jail: bans before the whitelist; the ban file's entries are those after it."""
    shown = []
    for name, w in spec.windows.items():
        sets = []
        for k, s in enumerate(w.sets):
            now_found = [{"cidr": r["cidr"], "count": r["requests"]} for r in sorted(found, key=lambda r: (r["start"], r["len"])) if (r["trie"], r["set_idx"]) == (name, k)]
            params = {"min_size": s.min_size, "depth": f"{s.min_depth}-{s.max_depth}", "threshold": s.mean_diff}
            sets.append({"params": params, "use_for_jail": s.use_for_jail, "last_duration_us": round(took * 1e6), "detected_now": now_found})
        row = {"name": name} | windows[name] | {"accepted_total": c.accepted[name], "rejected_by_filter_total": c.rejected[name], "cluster_sets": sets}
        if c.talkers.get(name):
            row["top_talkers"] = c.talkers[name]
        shown.append(row)
    counts, bans = jail.stage_counts(), jail.first_active(MOST_BANS)
    total = sum(n for _, n in counts)
    listed = [{"cidr": b["cidr"], "stage": b["stage"], "ban_start": _when(b["ban_start"]), "expires_at": _when(b["expires_at"])} for b in bans]
    stages = [{"stage": cell.id, "ban_duration": duration_text(cell.duration), "active": n} for cell, (_, n) in zip(jail.cells, counts, strict=True)]
    listing = lambda path, x: {"path": path, "entries": x.entries, "cidrs": x.first[:MOST_CIDRS]}
    return {
        "schema_version": SCHEMA, "generated_at": _when(now), "uptime_s": int((now - c.started).total_seconds()),
        "ingest": {
            "connected": c.connected, "queue_depth": c.queue_depth, "last_batch_at": _when(c.last_batch), "batches_total": c.batches, "requests_total": c.requests,
            "parse_errors_total": c.parse_errors, "malformed_fields_total": c.malformed,
        },
        "windows": shown, "jail": {"total_active": total, "stages": stages, "active_bans": listed, "active_bans_truncated": total > MOST_BANS},
        "lists": {
            "whitelist": listing(spec.whitelist, white), "blacklist": listing(spec.blacklist, black),
            "user_agent_lists": {"whitelist_hits_total": c.ua_white_hits, "blacklist_hits_total": c.ua_black_hits, "active_whitelist_ips": c.ua_white_ips, "active_blacklist_ips": c.ua_black_ips},
            "ban_file": {"path": spec.ban_path, "entries": c.ban_entries, "last_written": _when(c.ban_written)}, "jail_file": {"path": spec.jail_path},
        },
        "loop": {"iterations": c.iterations, "last_duration_ms": round(took * 1000), "sleep_s": pause},
    }


def escape_label(v: str) -> str:
    return v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")


def render_metrics(s: dict, prefix: str = "rangeloom") -> str:
    """The snapshot in the Prometheus text format; ``prefix`` begins each family's name."""
    out: list[str] = []

    def family(name: str, kind: str, text: str, *samples: tuple[dict, float]) -> None:
        out.extend((f"# HELP {prefix}_{name} {text}", f"# TYPE {prefix}_{name} {kind}"))
        for labels, value in samples:
            shown = ",".join(f'{k}="{escape_label(str(v))}"' for k, v in labels.items())
            out.append(f"{prefix}_{name}{'{' + shown + '}' if shown else ''} {value:g}")

    def single(name: str, kind: str, text: str, value: float) -> None:
        family(name, kind, text, ({}, value))

    i, w, j, lists, loop = s["ingest"], s["windows"], s["jail"], s["lists"], s["loop"]
    agents = lists["user_agent_lists"]
    single("uptime_seconds", "gauge", "Seconds since the live loop started.", s["uptime_s"])
    single("ingest_connected", "gauge", "Whether the source is connected (1) or closed (0).", int(i["connected"]))
    single("ingest_queue_depth", "gauge", "Batches that wait to be read.", i["queue_depth"])
    single("ingest_batches_total", "counter", "Batches received.", i["batches_total"])
    single("ingest_requests_total", "counter", "Requests parsed.", i["requests_total"])
    single("ingest_parse_errors_total", "counter", "Events that could not be parsed.", i["parse_errors_total"])
    single("ingest_malformed_fields_total", "counter", "Malformed fields of parsed events.", i["malformed_fields_total"])
    per = lambda key: [({"window": x["name"]}, x[key]) for x in w]
    family("window_unique_ips", "gauge", "Unique addresses in the window.", *per("size_ips"))
    family("window_requests", "gauge", "Requests in the window.", *per("requests"))
    family("window_accepted_total", "counter", "Requests that entered the window.", *per("accepted_total"))
    family("window_rejected_by_filter_total", "counter", "Requests that the window's filters rejected.", *per("rejected_by_filter_total"))
    sets = [({"window": x["name"], "set": f"{c['params']['min_size']}:{c['params']['depth']}:{c['params']['threshold']:.2f}"}, c) for x in w for c in x["cluster_sets"]]
    family("cluster_detected", "gauge", "Ranges that the set detected in the last iteration.", *((k, len(c["detected_now"])) for k, c in sets))
    family("cluster_duration_seconds", "gauge", "Time of detection in the last iteration.", *((k, c["last_duration_us"] / 1e6) for k, c in sets))
    single("jail_active", "gauge", "Active bans in the register, before the whitelist.", j["total_active"])
    family("ban_active", "gauge", "1 for each active ban that the snapshot lists.", *(({"cidr": b["cidr"], "stage": b["stage"]}, 1) for b in j["active_bans"]))
    family("jail_stage_active", "gauge", "Active bans of each stage.", *(({"stage": x["stage"]}, x["active"]) for x in j["stages"]))
    single("ban_file_entries", "gauge", "Ranges in the last ban file.", lists["ban_file"]["entries"])
    both = lambda key: [({"list": n}, agents[key.format(n)]) for n in ("whitelist", "blacklist")]
    family("ua_list_hits_total", "counter", "Requests whose user agent is on a list.", *both("{}_hits_total"))
    family("ua_list_active_ips", "gauge", "Addresses kept for each user-agent list.", *both("active_{}_ips"))
    single("loop_iterations_total", "counter", "Iterations of the live loop.", loop["iterations"])
    single("loop_duration_seconds", "gauge", "Time of the last iteration.", loop["last_duration_ms"] / 1e3)
    return "\n".join(out) + "\n"


class StatsServer:
    """GET /stats (JSON), /bans (the ban file's text), /metrics; 503 with Retry-After before the first snapshot."""

    def __init__(self, listen: str):
        host, _, port = listen.rpartition(":")
        self._latest: tuple[dict, str] | None = None
        outer = self

        class Handler(BaseHTTPRequestHandler):
            timeout = 10

            def do_GET(self) -> None:
                pages = {
                    "/stats": ("application/json", lambda s, b: json.dumps(s, indent=2)), "/bans": ("text/plain; charset=utf-8", lambda s, b: b),
                    "/metrics": ("text/plain; version=0.0.4; charset=utf-8", lambda s, b: render_metrics(s)),
                }
                page = pages.get(self.path.split("?")[0])
                latest = outer._latest
                if page is None:
                    return self._send(404, "text/plain", "not found")
                if latest is None:
                    return self._send(503, "text/plain", "no snapshot yet", {"Retry-After": "5"})
                self._send(200, page[0], page[1](*latest))

            def _send(self, status: int, kind: str, body: str, more: dict | None = None) -> None:
                raw = body.encode()
                self.send_response(status)
                for k, v in {"Content-Type": kind, "Content-Length": str(len(raw)), **(more or {})}.items():
                    self.send_header(k, v)
                self.end_headers()
                self.wfile.write(raw)

            def log_message(self, *_: object) -> None:
                pass

        self._http = ThreadingHTTPServer((host.strip("[]") or "0.0.0.0", int(port)), Handler)
        self.address = self._http.server_address
        threading.Thread(target=self._http.serve_forever, daemon=True).start()

    def publish(self, snapshot: dict, bans: str) -> None:
        self._latest = (snapshot, bans)

    def shutdown(self) -> None:
        self._http.shutdown()
        self._http.server_close()
