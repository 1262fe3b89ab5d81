"""Report documents: JSON, plain text, heatmap page."""

from __future__ import annotations

import json
from datetime import datetime

from ..functions.ip import format_number
from ..operators.clusters import ClusterParams
from .config import TrieSpec

VERSION = "1.0.0"


def rfc3339(t: datetime) -> str:
    return t.isoformat(timespec="seconds").replace("+00:00", "Z")


def new_document(kind: str, now: datetime) -> dict:
    return {"metadata": {"generated_at": rfc3339(now), "analysis_type": kind, "version": VERSION, "duration_ms": 0}, "general": {}, "tries": [], "warnings": [], "errors": []}


def set_parameters(s: ClusterParams) -> dict:
    return {"min_cluster_size": s.min_size, "min_depth": s.min_depth, "max_depth": s.max_depth, "mean_subnet_difference": s.mean_diff}


def trie_parameters(t: TrieSpec) -> dict:
    out: dict = {}
    if t.user_agent_regex:
        out["useragent_regex"] = t.user_agent_regex
    if t.endpoint_regex:
        out["endpoint_regex"] = t.endpoint_regex
    if t.start or t.end:
        zero = "0001-01-01T00:00:00Z"
        out["time_range"] = {"start": rfc3339(t.start) if t.start else zero, "end": rfc3339(t.end) if t.end else zero}
    if t.cidr_ranges:
        out["cidr_ranges"] = list(t.cidr_ranges)
    if t.sets and any(s.use_for_jail for s in t.sets):
        out["use_for_jail"] = [s.use_for_jail for s in t.sets]
    return out


def to_json(doc: dict, compact: bool = False) -> str:
    return json.dumps(doc, ensure_ascii=False, **({"separators": (",", ":")} if compact else {"indent": 2}))


def active_filters(parameters: dict) -> list[str]:
    """Filters of an analysis in words; an open end of the time range is ∞."""
    out = []
    if p := parameters.get("useragent_regex"):
        out.append(f"User-Agent: {p}")
    if p := parameters.get("endpoint_regex"):
        out.append(f"Endpoint: {p}")
    if span := parameters.get("time_range"):
        shown = ["∞" if span[k].startswith("0001-") else span[k][:16].replace("T", " ") for k in ("start", "end")]
        out.append(f"Time: {shown[0]} → {shown[1]}")
    return out


def _lines(title: str, pairs: list[tuple[str, object]]) -> list[str]:
    """A section: its title, and names and values in two columns."""
    wide = max((len(k) for k, _ in pairs), default=0)
    return [f"[{title}]", *(f"  {k.ljust(wide)} : {format_number(v) if isinstance(v, int) else v}" for k, v in pairs), ""]


def _table(title: str, rows: list[dict], sum_of: int | None = None) -> list[str]:
    """Ranges with requests and shares; with ``sum_of``, their sum and its share of that."""
    shown = [(r["cidr"], r["requests"], r["percentage"]) for r in rows]
    if sum_of is not None:
        n = sum(r["requests"] for r in rows)
        shown.append(("sum", n, 100 * n / sum_of if sum_of else 0.0))
    return [f"  {title}", *(f"    {c:<18} {format_number(n):>14} {p:>8.2f} %" for c, n, p in shown)]


def _trie_text(t: dict) -> list[str]:
    s = t["stats"]
    n = s["total_requests_after_filtering"]
    filters = ", ".join(active_filters(t["parameters"])) or "none"
    out = _lines(f"analysis {t['name']}", [("filters", filters), ("requests that pass", n), ("addresses", s["unique_ips"]), ("counted in ms", s["insert_time_ms"])])
    if s.get("cidr_analysis"):
        out += [*_table("watched ranges", s["cidr_analysis"]), ""]
    for k, c in enumerate(t["data"], 1):
        p = c["parameters"]
        head = f"set {k} (size >= {p['min_cluster_size']}, depth {p['min_depth']} to {p['max_depth']}, difference {p['mean_subnet_difference']:g}), detected in {c['execution_time_us']} us"
        out += [*(_table(head, c["merged_ranges"], n) if c["merged_ranges"] else [f"  {head}", "    nothing found"]), ""]
    return out


def to_plain(doc: dict) -> str:
    """The report as text: a section on the run, one for each analysis, and what was odd."""
    g, meta = doc["general"], doc["metadata"]
    run = [("kind", meta["analysis_type"]), ("log", g.get("log_file", "")), ("format", g["parsing"]["format"]), ("at", meta["generated_at"]), ("took ms", meta["duration_ms"])]
    run += [("requests", g["total_requests"]), ("read and counted in ms", g["parsing"]["duration_ms"]), ("requests a second", g["parsing"]["rate_per_second"])]
    out = _lines("run", run)
    for t in doc["tries"]:
        out += _trie_text(t)
    odd = [("warning", w["message"]) for w in doc["warnings"] if w["type"] != "info"] + [("error", e["message"]) for e in doc["errors"]]
    return "\n".join(out + (_lines("notes", odd) if odd else [])).rstrip("\n") + "\n"


def heatmap_html(cells: list[tuple[int, int, int]]) -> str:
    """A page that draws (a, b, count) cells on a 256 x 256 canvas, shaded by the logarithm of the count."""
    data = json.dumps(sorted(cells), separators=(",", ":"))
    return f"""<!DOCTYPE html>
<html><head><meta charset="utf-8"><title>Requests by /16</title></head><body>
<h3>Requests by first (down) and second (across) octet</h3><canvas id="c" width="1024" height="1024"></canvas><pre id="t"></pre>
<script>
const cells = {data}, by = new Map(cells.map(x => [x[0] * 256 + x[1], x[2]])), top_ = Math.max(1, ...cells.map(x => x[2]));
const g = document.getElementById("c").getContext("2d");
g.fillStyle = "#111"; g.fillRect(0, 0, 1024, 1024);
for (const [a, b, n] of cells) {{ g.fillStyle = `hsl(${{60 - 60 * Math.log1p(n) / Math.log1p(top_)}}, 90%, 55%)`; g.fillRect(b * 4, a * 4, 4, 4); }}
document.getElementById("c").onmousemove = e => {{ const a = e.offsetY >> 2, b = e.offsetX >> 2; document.getElementById("t").textContent = `${{a}}.${{b}}.0.0/16: ${{by.get(a * 256 + b) || 0}}`; }};
</script></body></html>
"""
