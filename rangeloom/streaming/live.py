"""Live analysis: one step a micro-batch over all windows, with register, ban file and snapshot.

State that grows (window queues, user-agent addresses) lives in Parquet tables of the state folder, published step by step
(:mod:`.state`) with the counters. Step n starts from what the step before n published, so a lost executor loses nothing, a batch that Spark
replays gives the same windows again, and a new process goes on where the last one ended. On the driver are only lists, detected
ranges, the register, and addresses of listed agents, which go to the ban file line by line.
"""

from __future__ import annotations

import dataclasses
import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.ip import format_cidr, format_ip
from ..operators import filters
from ..operators.clusters import detect_clusters
from ..operators.jail import Jail, ban_file, write_atomic
from ..operators.ranges import merge_lists, subtract_lists
from ..operators.traffic import top_talkers_by
from ..plans.config import Spec, logger
from ..sources.access_log import parse_live
from . import window
from .snapshot import TALKERS_EVERY, Counters, Listed, StatsServer, build_snapshot
from .state import StateStore

#: Counters that a manifest keeps.
KEPT = ("accepted", "rejected", "iterations", "batches", "requests", "parse_errors", "malformed", "files", "ua_white_hits", "ua_black_hits", "talkers")


SEEN = "ip bigint, ua_class int, last_seen timestamp"


class LiveLoop:
    """The loop's state between batches. ``clock`` gives the processing time, ``spooled`` how many files were ever spooled."""

    def __init__(
        self, spark: SparkSession, spec: Spec, state_dir: str, server: StatsServer | None = None, clock: Callable[[], datetime] | None = None,
        spooled: Callable[[], int] | None = None,
    ):
        spec.validate_live()
        self.spark, self.spec, self.server, self.spooled = spark, spec, server, spooled
        self.store = StateStore(spark, state_dir)
        self.clock = clock or (lambda: datetime.now(timezone.utc))
        self.white, self.black = spec.cidrs("whitelist"), spec.cidrs("blacklist")
        self.agents = spec.agents("ua_whitelist"), spec.agents("ua_blacklist")
        self.jail = Jail.load(spec.jail_path)
        self.longest = max(w.max_time for w in spec.windows.values())
        self.pause = max(w.pause for w in spec.windows.values())
        self.queues: dict[str, DataFrame | None] = dict.fromkeys(spec.windows)
        self.seen: DataFrame | None = None
        self.counters = Counters(started=self.clock(), accepted=dict.fromkeys(spec.windows, 0), rejected=dict.fromkeys(spec.windows, 0))
        self.log = logger(spec.log_level, spec.log_style)
        self.snapshot: dict | None = None
        self.tables: dict[str, str] = {}
        self.number = 0
        if known := self.store.numbers():
            self._load(self.store.read(known[-1]))

    def _load(self, doc: dict | None) -> None:
        """Take over what a step published; nothing before the first."""
        doc = doc or {"number": 0, "tables": {}, "counters": {}}
        self.number = doc["number"]
        fresh = Counters(started=self.counters.started, accepted=dict.fromkeys(self.spec.windows, 0), rejected=dict.fromkeys(self.spec.windows, 0))
        old = {k: v for k, v in doc["counters"].items() if k in KEPT}
        for k in ("accepted", "rejected"):
            old[k] = getattr(fresh, k) | {w: n for w, n in old.get(k, {}).items() if w in self.spec.windows}
        self.counters = dataclasses.replace(fresh, **old)
        self.queues = {w: self._reread(doc["tables"].get(f"window-{w}"), window.STATE) for w in self.spec.windows}
        self.seen = self._reread(doc["tables"].get("agents"), SEEN)
        self.tables = {}

    def _reread(self, at: str | None, schema: str) -> DataFrame | None:
        return self.spark.read.schema(schema).parquet(at) if at else None

    def _table(self, df: DataFrame, name: str, schema: str) -> DataFrame:
        """Write this step's version of a state table, and read it back."""
        self.tables[name] = self.store.write(df, name)
        return self._reread(self.tables[name], schema)

    def _classify(self, rows: DataFrame, now: datetime) -> DataFrame:
        """Mark agents, remember their addresses as long as the longest window, drop whitelisted rows."""
        if not any(self.agents):
            return rows
        rows = filters.classify_agents(rows, *self.agents)
        hits = {r["ua_class"]: r["n"] for r in rows.groupBy("ua_class").agg(F.count(F.lit(1)).alias("n")).collect()}
        self.counters.ua_white_hits += hits.get(1, 0)
        self.counters.ua_black_hits += hits.get(-1, 0)
        new = rows.where((F.col("ua_class") != 0) & (F.col("ip") != 0)).select("ip", "ua_class", F.lit(now).alias("last_seen"))
        both = new if self.seen is None else self.seen.unionByName(new)
        latest = both.groupBy("ip", "ua_class").agg(F.max("last_seen").alias("last_seen"))
        self.seen = self._table(window.purge_expired(latest, now - self.longest), "agents", SEEN)
        return rows.where("ua_class <> 1").drop("ua_class")

    def _agent_ips(self, cls: int) -> list[str]:
        """Addresses of a class, ascending; they go to the ban file, line by line."""
        if self.seen is None:
            return []
        return [format_ip(r["ip"]) for r in self.seen.where(F.col("ua_class") == cls).select("ip").distinct().orderBy("ip").collect()]

    def step(self, events: DataFrame, batch_id: int | None = None) -> dict | None:
        """One micro-batch of (message) events. An empty batch changes nothing, so without traffic no ban is renewed."""
        began, now = time.time(), self.clock()
        number = self.number + 1 if batch_id is None else batch_id + 1
        if number <= self.number:  # Spark gives a batch again
            self._load(self.store.before(number))
        self.number, self.tables = number, {}
        parsed = parse_live(events).persist()
        try:
            c = self.counters
            files = F.count_distinct("file") if "file" in events.columns else F.lit(0)
            malformed = F.coalesce(F.sum(F.when(~F.col("parse_error"), F.col("malformed"))), F.lit(0))
            total = parsed.agg(F.count(F.lit(1)).alias("n"), F.count_if("parse_error").alias("bad"), malformed.alias("mal"), files.alias("files")).first()
            c.files += total["files"]
            c.queue_depth = max(0, self.spooled() - c.files) if self.spooled else 0
            if total["n"] == total["bad"]:
                c.parse_errors += total["bad"]
                return None
            c.batches, c.requests, c.parse_errors, c.malformed, c.last_batch = c.batches + 1, c.requests + total["n"] - total["bad"], c.parse_errors + total["bad"], c.malformed + total["mal"], now
            kept = self._classify(parsed.where(~F.col("parse_error")).drop("message"), now)
            usable = kept.where(F.col("ip") != 0)
            passes = {n: filters.matches(w.user_agent_regex, w.endpoint_regex) for n, w in self.spec.windows.items()}
            tally = usable.agg(*(F.count_if(p).alias(f"yes_{n}") for n, p in passes.items()), F.count(F.lit(1)).alias("n")).first()
            counts = None
            for name, w in self.spec.windows.items():
                c.accepted[name] += tally[f"yes_{name}"]
                c.rejected[name] += tally["n"] - tally[f"yes_{name}"]
                queue = window.append(self.queues[name], usable.where(passes[name]), self.number)
                self.queues[name] = self._table(window.evict(queue, now, w.max_time, w.max_size), f"window-{name}", window.STATE)
                one = self.queues[name].groupBy("ip").agg(F.count(F.lit(1)).alias("c")).select(F.lit(name).alias("trie"), "ip", "c")
                counts = one if counts is None else counts.unionByName(one)
            windows = {name: {"size_ips": 0, "requests": 0} for name in passes}
            for r in counts.groupBy("trie").agg(F.count(F.lit(1)).alias("ips"), F.sum("c").alias("n")).collect():
                windows[r["trie"]] = {"size_ips": r["ips"], "requests": r["n"]}
            top = self.spec.live["topTalkers"]
            if top > 0 and c.iterations % TALKERS_EVERY == 0:
                c.talkers = {name: [] for name in passes}
                for r in top_talkers_by(counts, top, ["trie"]).orderBy("trie", "rank").collect():
                    c.talkers[r["trie"]].append({"ip": format_ip(r["ip"]), "count": r["c"]})
            found = [r.asDict() for r in detect_clusters(counts, {n: w.sets for n, w in self.spec.windows.items()}).collect()]
        finally:
            parsed.unpersist()
        return self._publish(found, windows, now, began)

    def _publish(self, found: list[dict], windows: dict, now: datetime, began: float) -> dict:
        """Raw detections of all jailing sets of all windows merge together; then whitelist, register, ban file, snapshot."""
        spec, c = self.spec, self.counters
        jailing = {(n, k) for n, w in spec.windows.items() for k, s in enumerate(w.sets) if s.use_for_jail}
        merged = [format_cidr(*r) for r in merge_lists([(r["start"], r["len"]) for r in found if (r["trie"], r["set_idx"]) in jailing])]
        white_ips, black_ips = self._agent_ips(1), self._agent_ips(-1)
        every = self.white + [f"{ip}/32" for ip in white_ips]
        jailed = subtract_lists(merged, every) + [f"{ip}/32" for ip in black_ips]
        if failed := self.jail.update(jailed, now):
            self.log.warning("the register refused: %s", "; ".join(failed))
        self.jail.save(spec.jail_path)
        bans, manual = subtract_lists(self.jail.active_bans(), every), subtract_lists(self.black, every)
        content = ban_file(bans, manual, now)
        write_atomic(spec.ban_path, content)
        c.ban_content, c.ban_entries, c.ban_written = content, len(bans) + len(manual), now
        c.ua_white_ips, c.ua_black_ips = len(white_ips), len(black_ips)
        took = time.time() - began
        c.iterations += 1
        self.snapshot = build_snapshot(spec, c, windows, found, self.jail, Listed.of(self.white), Listed.of(self.black), now, took, self.pause)
        if self.server:
            self.server.publish(self.snapshot, content)
        self.store.publish(self.number, {"number": self.number, "tables": self.tables, "counters": {k: getattr(c, k) for k in KEPT}})
        self.log.info("iteration windows=%d detected=%d merged=%d jailed=%d active_bans=%d loop_ms=%d", len(windows), len(found), len(merged), len(jailed), len(bans), round(took * 1000))
        return self.snapshot

    def start(self, events: DataFrame, checkpoint: str) -> StreamingQuery:
        """Run the loop on a streaming table with a column ``message``."""
        return events.writeStream.foreachBatch(lambda df, n: self.step(df, n)).option("checkpointLocation", checkpoint).trigger(processingTime=f"{max(self.pause, 0)} seconds").start()
