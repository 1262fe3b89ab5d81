"""Registered queries of what the engine keeps between batches: windows, agents' addresses, the ban register, the receiver.

Batches, times and offences are derived from the tables; the SQL replays them round by round.
"""

from __future__ import annotations

import functools
import os
import tempfile
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ip as ipf
from ..operators import clusters, jail, ranges
from ..sources import access_log, derived, lumberjack
from ..sources.derived import REQUESTS_SQL
from ..sources.scratch import new_folder
from ..streaming import window
from ..streaming.live import LiveLoop
from . import static
from .catalog import _BOUND, _GAPS, _HEAD, _NOW, RANGES_SQL, _cover_sql, _fold_sql, _ip_sql, _queue, _spans, _SPANS, _walk_sql, query
from .config import Spec, TrieSpec, WindowSpec

DAY = timedelta(days=1)


@query(f"WITH {REQUESTS_SQL}, {_HEAD} SELECT ip, count(*) AS c FROM live GROUP BY ip")
def window_counts_after_eviction(spark: SparkSession, sf: str) -> DataFrame:
    """Retraction: the counts of what the window still holds."""
    return clusters.ip_counts(window.evict_old(_queue(spark, sf), _NOW, _BOUND))


@query(f"WITH {REQUESTS_SQL} SELECT seq, ip, coalesce(t - lag(t) OVER (PARTITION BY ip ORDER BY seq), -1) AS gap FROM base WHERE ip <> 0")
def arrival_gaps(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.traffic import arrival_gaps as gaps

    return gaps(_queue(spark, sf)).select("seq", "ip", F.coalesce(F.col("gap").cast("long"), F.lit(-1)).alias("gap"))


# ---- live loop: all requests in four batches by arrival, some older than their place says


BATCHES = 4
_ENDS = [datetime(2024, 1, d, tzinfo=timezone.utc) for d in (9, 16, 23, 31)]
_WINDOWS = {"main": ("", 9 * DAY, 100_000), "short": ("", 2 * DAY, 100_000), "small": ("", 20 * DAY, 40), "clicks": ("^/click/", 20 * DAY, 100_000)}
_LIVE_SETS = [clusters.ClusterParams(20, 16, 24, 0.2, True), clusters.ClusterParams(5, 24, 32, 0.1)]


def _live_spec(folder: str, sets=()) -> Spec:
    def file(name: str, text: str) -> str:
        with open(path := os.path.join(folder, name), "w", encoding="utf-8") as f:
            f.write(text)
        return path

    windows = {n: WindowSpec(endpoint_regex=uri or None, sets=list(sets), max_time=bound, max_size=size) for n, (uri, bound, size) in _WINDOWS.items()}
    agents = {"ua_whitelist": file("w", "Googlebot/2.1 (+http://example.com/bot)\n"), "ua_blacklist": file("b", "# tools\nCURL/8.5.0\n")}
    return Spec(jail_file=os.path.join(folder, "jail.json"), ban_file=os.path.join(folder, "bans"), has_global=True, live={"port": "1", "statsListen": "", "topTalkers": 2}, windows=windows, **agents)


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    """(event_id, ts, message): live lines; every fifth is three days old."""
    r = derived.requests(spark, sf)
    ts = F.col("ts") - F.when(F.col("event_id") % 5 == 0, F.expr("INTERVAL 3 DAYS")).otherwise(F.expr("INTERVAL 0 DAYS"))
    line = F.concat(
        F.when(F.col("ip") == 0, F.lit("unknown")).otherwise(ipf.long_to_ip(F.col("ip"))), F.lit(" - - ["), F.date_format(ts, "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "'), "method", F.lit(" "), "uri",
        F.lit(' HTTP/1.1" '), F.col("status").cast("string"), F.lit(" "), F.col("bytes").cast("string"), F.lit(' "-" "'), F.translate("user_agent", '\\"', "''"), F.lit('"'),
    )
    return r.select("event_id", "ts", line.alias("message"))


_replays: dict[tuple[str, str], LiveLoop] = {}


def _replayed(spark: SparkSession, sf: str) -> LiveLoop:
    """The loop after all batches, once an application and folder of tables."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _replays:
        with tempfile.TemporaryDirectory() as d:
            _replays[key] = _replay(spark, sf, d)
    return _replays[key]


def _replay(spark: SparkSession, sf: str, folder: str) -> LiveLoop:
    """All batches, one of them empty, one given twice, and the last by a new process."""
    at = [_ENDS[0]]
    state = new_folder(spark, "live")
    loop = LiveLoop(spark, _live_spec(folder), state, clock=lambda: at[0])
    every = _messages(spark, sf).withColumn("batch", sum((F.col("ts") >= F.lit(e)).cast("int") for e in _ENDS[:-1]))
    batch = lambda k: every.where(F.col("batch") == k).select("message")
    for k in range(BATCHES):
        at[0] = _ENDS[k]
        if k == 1:
            assert loop.step(batch(k).limit(0), 1) is None
        if k == BATCHES - 1:
            loop = LiveLoop(spark, _live_spec(folder), state, clock=lambda: at[0])
        loop.step(batch(k), k + (k > 0))
        if k == 2:
            loop.step(batch(k), k + 1)
    return loop


def _live_sql(name: str) -> str:
    """CTE ``w_<name>`` (seq, ip, t): a queue that loses its head batch by batch."""
    uri, bound, size = _WINDOWS[name]
    gate = f" AND regexp_matches(uri, '{uri}')" if uri else ""
    out = [f"q_{name} AS (SELECT event_id AS seq, ip, lt, batch, row_number() OVER (ORDER BY event_id) AS i FROM arrived WHERE ip <> 0 AND cls <> 1{gate})"]
    before = "0"
    for k, end in enumerate(_ENDS):
        cutoff = int((end - bound).timestamp())
        held = f"(SELECT coalesce(max(i), 0) FROM q_{name} WHERE batch <= {k})"
        # what has left: all before the first fresh row behind what had left, or all, and what is beyond the size
        out.append(f"""gone_{name}_{k} AS (SELECT greatest({before}, coalesce((SELECT min(i) - 1 FROM q_{name} WHERE i > {before} AND lt >= {cutoff} AND batch <= {k}), {held}), {held} - {size}) AS n)""")
        before = f"(SELECT n FROM gone_{name}_{k})"
    out.append(f"w_{name} AS (SELECT seq, ip, lt FROM q_{name} WHERE i > {before})")
    return ", ".join(out)


_CUTS = " + ".join(f"CAST(t >= {int(e.timestamp())} AS INTEGER)" for e in _ENDS[:-1])
_ARRIVED = f"""{REQUESTS_SQL}, arrived AS (
    SELECT *, t - CASE WHEN event_id % 5 = 0 THEN 259200 ELSE 0 END AS lt, {_CUTS} AS batch,
        CASE WHEN user_agent LIKE 'Googlebot%' THEN 1 WHEN user_agent = 'curl/8.5.0' THEN -1 ELSE 0 END AS cls FROM base)"""


@query(f"WITH {_ARRIVED}, {', '.join(map(_live_sql, _WINDOWS))} " + " UNION ALL ".join(f"SELECT '{n}' AS name, ip, lt AS epoch, count(*) AS n FROM w_{n} GROUP BY ALL" for n in _WINDOWS))
def live_windows(spark: SparkSession, sf: str) -> DataFrame:
    """What each window holds at the end."""
    out = None
    for name, q in _replayed(spark, sf).queues.items():
        one = q.select(F.lit(name).alias("name"), "ip", F.unix_timestamp("ts").alias("epoch"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("name", "ip", "epoch").agg(F.count(F.lit(1)).alias("n"))


_BATCH_END = "CASE batch " + " ".join(f"WHEN {k} THEN {int(e.timestamp())}" for k, e in enumerate(_ENDS)) + " END"


@query(f"""WITH {_ARRIVED}, seen AS (SELECT ip, cls AS ua_class, max({_BATCH_END}) AS last_seen FROM arrived WHERE ip <> 0 AND cls <> 0 GROUP BY ALL)
    SELECT ip, ua_class, last_seen FROM seen WHERE last_seen >= {int((_ENDS[-1] - 20 * DAY).timestamp())}""")
def live_agent_addresses(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses of listed agents, kept as long as the longest window."""
    return _replayed(spark, sf).seen.select("ip", "ua_class", F.unix_timestamp("last_seen").alias("last_seen"))


@query(f"""WITH {_ARRIVED}, ok AS (SELECT * FROM arrived WHERE ip <> 0), kept AS (SELECT * FROM ok WHERE cls <> 1)
    SELECT * FROM (
        SELECT 'requests' AS name, count(*) AS n FROM ok UNION ALL SELECT 'parse errors', count(*) FROM arrived WHERE ip = 0 UNION ALL SELECT 'batches', {BATCHES} UNION ALL SELECT 'iterations', {BATCHES}
        UNION ALL SELECT 'agents listed 1', count(*) FROM ok WHERE cls = 1 UNION ALL SELECT 'agents listed -1', count(*) FROM ok WHERE cls = -1
        UNION ALL SELECT 'accepted ' || w, count(*) FROM kept, (VALUES {', '.join(f"('{n}', '{u}')" for n, (u, _, _) in _WINDOWS.items())}) v(w, uri_) WHERE regexp_matches(uri, uri_) GROUP BY w
        UNION ALL SELECT 'rejected clicks', count(*) FROM kept WHERE NOT regexp_matches(uri, '^/click/') UNION ALL SELECT 'rejected ' || w, 0 FROM (VALUES ('main'), ('short'), ('small')) v(w))""")
def live_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Totals over all batches: an empty batch is no iteration, a batch given twice counts once, a new process goes on."""
    c = _replayed(spark, sf).counters
    rows = [("requests", c.requests), ("parse errors", c.parse_errors), ("batches", c.batches), ("iterations", c.iterations), ("agents listed 1", c.ua_white_hits), ("agents listed -1", c.ua_black_hits)]
    rows += [(f"accepted {n}", v) for n, v in c.accepted.items()] + [(f"rejected {n}", v) for n, v in c.rejected.items()]
    return spark.createDataFrame(rows, "name string, n long")


def _window_found(name: str) -> str:
    gate = f"regexp_matches(uri, '{_WINDOWS[name][0]}')"
    walk = _walk_sql(_LIVE_SETS[:1], gate).replace("FROM base WHERE", "FROM arrived WHERE")
    return f"SELECT * FROM (WITH RECURSIVE {walk} SELECT start, len FROM found)"


@query(f"""WITH RECURSIVE {_ARRIVED}, u AS ({_window_found('main')} UNION {_window_found('clicks')}),
    top AS (SELECT start, len FROM u a WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b.len < a.len AND b.start <= a.start AND b.start + (CAST(1 AS BIGINT) << (32 - b.len)) > a.start)),
    zero AS (SELECT 0 AS set_idx, start, len, row_number() OVER (ORDER BY start) AS i FROM top), {_fold_sql('zero', 'one')}, {_fold_sql('one', 'two')}
    SELECT {_ip_sql('start')} || '/' || len AS cidr, 1 AS stage FROM two""")
def live_bans(spark: SparkSession, sf: str) -> DataFrame:
    """One batch of everything: raw detections of the jailing sets of two windows merge together into new bans."""
    with tempfile.TemporaryDirectory() as d:
        spec = _live_spec(d, _LIVE_SETS)
        spec.ua_whitelist = spec.ua_blacklist = ""
        wide = {n: WindowSpec(endpoint_regex=w.endpoint_regex, sets=w.sets, max_time=400 * DAY, max_size=1 << 30) for n, w in spec.windows.items() if n in ("main", "clicks")}
        spec.windows = wide
        loop = LiveLoop(spark, spec, new_folder(spark, "live"), clock=lambda: _ENDS[-1])
        loop.step(_messages(spark, sf).select("message"), 0)
        bans = [r for r in loop.jail.active_bans_with_meta()]
    return spark.createDataFrame([(b["cidr"], b["stage"]) for b in bans], "cidr string, stage int")


# ---- receiver: shippers on the executors, spool, stream


def _received(spark: SparkSession, sf: str) -> tuple[DataFrame, dict]:
    """Everything shipped by tasks to a receiver, streamed from its spool in micro-batches, parsed; and the counters."""
    out, checkpoint = new_folder(spark, "events"), new_folder(spark, "checkpoint")
    with tempfile.TemporaryDirectory() as spool:
        receiver = lumberjack.Receiver("127.0.0.1:0", spool)
        try:
            address = receiver.address
            messages = _messages(spark, sf).select("message")
            messages.foreachPartition(lambda rows: lumberjack.ship(address, ({"message": r["message"]} for r in rows)))
            sent, files = receiver.events, receiver.spooled()
            read = []

            def take(df: DataFrame, _: int) -> None:
                read.append(df.select("file").distinct().count())
                access_log.parse_live(df.select("message")).write.mode("append").parquet(out)

            stream = lumberjack.stream(spark, spool).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
            stream.trigger(availableNow=True).start().awaitTermination()
        finally:
            receiver.close()
    got = spark.read.parquet(out)
    return got, {"events": sent, "waiting": files - sum(read), "closed": int(receiver.closed)}


@query(f"WITH {_ARRIVED} SELECT ip, lt AS epoch, method, uri, status, bytes, count(*) AS n FROM arrived WHERE ip <> 0 GROUP BY ALL")
def lumberjack_events(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = _received(spark, sf)
    rows = rows.where(~F.col("parse_error")).select("ip", F.unix_timestamp("ts").alias("epoch"), "method", "uri", "status", "bytes")
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {REQUESTS_SQL} SELECT 'events' AS name, count(*) AS n FROM base UNION ALL SELECT 'parse errors', count(*) FROM base WHERE ip = 0
    UNION ALL SELECT 'requests', count(*) FROM base WHERE ip <> 0 UNION ALL VALUES ('waiting', 0), ('closed', 1)""")
def ingest_counters(spark: SparkSession, sf: str) -> DataFrame:
    rows, counters = _received(spark, sf)
    told = spark.createDataFrame(list(counters.items()), "name string, n long")
    kind = F.when(F.col("parse_error"), "parse errors").otherwise("requests").alias("name")
    return told.unionByName(rows.groupBy(kind).agg(F.count(F.lit(1)).alias("n")))


# ---- register: offences round by round


_HOURS = [0, 1, 8, 200, 1500, 7000, 7001]
_ROUND = datetime(2024, 1, 1, tzinfo=timezone.utc)
_STAGE_SECONDS = "CASE stage " + " ".join(f"WHEN {k} THEN {int(d.total_seconds())}" for k, (_, d) in enumerate(jail.STAGES, 1)) + " END"


def _offends(k: str, r: str) -> str:
    return f"({k} + {r}) % (1 + {k} % 3) = 0"


@query("SELECT * FROM (VALUES " + ", ".join(f"({k}, {int(d.total_seconds())}, 0)" for k, (_, d) in enumerate(jail.STAGES, 1)) + ") AS t(cell, seconds, prisoners)")
def jail_defaults(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(c.id, int(c.duration.total_seconds()), len(c.prisoners)) for c in jail.Jail.new().cells], "cell int, seconds int, prisoners int")


@query(f"""WITH RECURSIVE rounds(r, now) AS (VALUES {", ".join(f"({r}, {int((_ROUND + timedelta(hours=h)).timestamp())})" for r, h in enumerate(_HOURS))}),
    st AS (
        SELECT c_custkey AS k, -1 AS r, 0 AS stage, CAST(0 AS BIGINT) AS start, FALSE AS active FROM customer
        UNION ALL
        SELECT k, rounds.r, CASE WHEN off AND stage = 0 THEN 1 WHEN off AND NOT on_ THEN least(stage + 1, 5) ELSE stage END,
            CASE WHEN off AND NOT on_ THEN now ELSE start END, off OR on_
        FROM (SELECT st.k, st.r, stage, start, active AND a.now - start <= {_STAGE_SECONDS} AS on_, {_offends('st.k', 'a.r')} AS off FROM st JOIN rounds a ON a.r = st.r + 1) x JOIN rounds ON rounds.r = x.r + 1)
    SELECT {_ip_sql('(1073741824 + 2 * k)')} || '/32' AS cidr, stage AS cell, start AS ban_start, active FROM st WHERE r = {len(_HOURS) - 1} AND stage > 0""")
def jail_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Rounds of offences by single addresses: new, banned still, back after the ban ran out, renewed in the last cell."""
    k, r = F.col("c_custkey"), F.col("round")
    again = spark.read.parquet(f"{sf}/customer.parquet").select(k, F.explode(F.array(*map(F.lit, range(len(_HOURS))))).alias("round")).where((k + r) % (1 + k % 3) == 0)
    offences = again.select("round", k.alias("ord"), F.concat(ipf.long_to_ip((F.lit(1 << 30) + 2 * k).cast("bigint")), F.lit("/32")).alias("cidr"))
    nonsense = spark.range(len(_HOURS)).select(F.col("id").cast("int").alias("round"), F.lit(1 << 62).alias("ord"), F.lit("nonsense").alias("cidr"))
    got = jail.replay(offences.unionByName(nonsense), [_ROUND + timedelta(hours=h) for h in _HOURS]).where("failed IS NULL")  # an entry that fails stops nothing
    return got.select("cidr", F.col("cell_id").alias("cell"), F.unix_timestamp("ban_start").alias("ban_start"), F.col("ban_active").alias("active"))


@query(f"""WITH k AS (SELECT c_custkey AS k, c_custkey // 16 AS g FROM customer),
    -- after the second round, an even key is in cell 2; the range over a group of an even number takes the highest cell of what it holds
    one AS (SELECT k, g, CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END AS cell FROM k),
    held AS (SELECT g, max(cell) AS cell FROM one WHERE g % 2 = 0 GROUP BY g)
    SELECT {_ip_sql('(1073741824 + k)')} || '/32' AS cidr, cell, CASE cell WHEN 2 THEN 1 ELSE 0 END AS last_round FROM one WHERE g % 2 = 1
    UNION ALL SELECT {_ip_sql('(1073741824 + 16 * g)')} || '/28', CASE WHEN g % 4 = 0 THEN cell + 1 ELSE cell END, CASE WHEN g % 4 = 0 THEN 3 ELSE 2 END FROM held""")
def jail_absorb(spark: SparkSession, sf: str) -> DataFrame:
    """A range takes the place of the jailed ones it holds, in their highest cell; one inside a jailed range is that range coming back."""
    keys = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("k"))
    groups = keys.select(F.floor(F.col("k") / 16).cast("long").alias("k")).distinct()
    at = lambda step, n: F.concat(ipf.long_to_ip((F.lit(1 << 30) + step * F.col("k")).cast("bigint")), F.lit(f"/{n}"))
    rounds = [keys.select("k", at(1, 32).alias("cidr")), keys.where("k % 2 = 0").select("k", at(1, 32).alias("cidr")), groups.where("k % 2 = 0").select("k", at(16, 28).alias("cidr")), groups.where("k % 4 = 0").select("k", at(16, 32).alias("cidr"))]
    offences = functools.reduce(DataFrame.unionByName, (x.select(F.lit(r).alias("round"), F.col("k").alias("ord"), "cidr") for r, x in enumerate(rounds)))
    times = [_ROUND + timedelta(hours=h) for h in (0, 1, 2, 300)]
    place = F.create_map(*(x for r, t in enumerate(times) for x in (F.lit(int(t.timestamp())), F.lit(r))))
    refused = F.raise_error(F.col("failed")).cast("string")
    return jail.replay(offences, times).select(F.when(F.col("failed").isNull(), F.col("cidr")).otherwise(refused).alias("cidr"), F.col("cell_id").alias("cell"), place[F.unix_timestamp("ban_start")].alias("last_round"))


_PAIR = "1073741824 + c_custkey * 31 AS ah, 24 + c_custkey % 9 AS al, 1073741824 + c_custkey * 31 + c_custkey % 7 - 3 AS bh, 22 + c_custkey % 4 AS bl"


@query(f"""WITH p AS (SELECT c_custkey AS k, {_PAIR} FROM customer), e AS (SELECT *, (ah >> (32 - al) << (32 - al)) + (1 << (32 - al)) - 1 AS ae, (bh >> (32 - bl) << (32 - bl)) + (1 << (32 - bl)) - 1 AS be FROM p)
    SELECT k, ah >= bh AND ae <= be AS inside, ah >= bh AND ae <= be AS by_text FROM e""")
def sub_range_unmasked(spark: SparkSession, sf: str) -> DataFrame:
    """Containment from the addresses as written, as expression and on texts."""
    k = F.col("c_custkey")
    host = (F.lit(1 << 30) + k * 31).cast("bigint")
    rows = spark.read.parquet(f"{sf}/customer.parquet").select(k.alias("k"), host.alias("ah"), (24 + k % 9).cast("int").alias("al"), (host + k % 7 - 3).alias("bh"), (22 + k % 4).cast("int").alias("bl"))
    rows = rows.withColumn("inside", ipf.within_unmasked(F.col("ah"), F.col("al"), F.col("bh"), F.col("bl")))
    text = lambda h, n: f"{ipf.format_ip(h)}/{n}"
    got = [(r["k"], r["inside"], jail.is_sub_range(text(r["ah"], r["al"]), text(r["bh"], r["bl"]))) for r in rows.collect()]
    return spark.createDataFrame(got, "k long, inside boolean, by_text boolean")


_STATIC_SET = [clusters.ClusterParams(20, 16, 24, 0.2, True)]
_GUARD = """wh AS (SELECT DISTINCT ip - ip % 64 AS start, 26 AS len, ip - ip % 64 + 63 AS "end" FROM (
    SELECT 169082880 + s_suppkey * 61 % 5000 AS ip FROM supplier UNION ALL SELECT 3232235520 + s_suppkey * 37 % 2000 FROM supplier))"""


def _guarded(spark: SparkSession, sf: str) -> list[str]:
    """Whitelisted ranges in two busy networks, two from each supplier."""
    k = F.col("s_suppkey")
    ips = F.explode(F.array(169082880 + k * 61 % 5000, 3232235520 + k * 37 % 2000))
    rows = spark.read.parquet(f"{sf}/supplier.parquet").select(ips.alias("ip")).select((F.col("ip") - F.col("ip") % 64).alias("start")).distinct()
    return [ipf.format_cidr(r["start"], 26) for r in rows.collect()]


@query(f"""WITH RECURSIVE {REQUESTS_SQL}, {_walk_sql(_STATIC_SET)},
    zero AS (SELECT set_idx, start, len, row_number() OVER (ORDER BY start) AS i FROM found), {_fold_sql('zero', 'one')}, {_fold_sql('one', 'two')},
    {_GUARD}, bl AS (SELECT start AS ord, start, len, start + (CAST(1 AS BIGINT) << (32 - len)) - 1 AS "end" FROM two), {_GAPS}, {_cover_sql('gaps')},
    free AS (SELECT low AS start, CAST(32 - log2(size) AS INTEGER) AS len, low + size - 1 AS "end" FROM cov UNION ALL SELECT start, len, "end" FROM bl WHERE ord NOT IN (SELECT ord FROM hits)),
    agent AS (SELECT DISTINCT ip FROM base WHERE ip <> 0 AND user_agent LIKE 'BadBot%'),
    jailed AS (SELECT start, len FROM free UNION ALL SELECT ip, 32 FROM agent WHERE NOT EXISTS (SELECT 1 FROM free WHERE ip BETWEEN start AND "end")),
    shown AS (SELECT start, len FROM free UNION ALL SELECT ip, 32 FROM agent WHERE NOT EXISTS (SELECT 1 FROM free WHERE ip BETWEEN start AND "end") AND NOT EXISTS (SELECT 1 FROM wh WHERE ip BETWEEN start AND "end"))
    SELECT 'register' AS place, {_ip_sql('start')} || '/' || len AS cidr FROM jailed UNION ALL SELECT 'ban file', {_ip_sql('start')} || '/' || len FROM shown""")
def static_jail(spark: SparkSession, sf: str) -> DataFrame:
    """A static run with lists: the register holds merged ranges without whitelisted addresses and listed agents' addresses; the ban
    file never holds a whitelisted one."""
    r = derived.requests(spark, sf)
    white = _guarded(spark, sf)
    with tempfile.TemporaryDirectory() as d:
        at = {n: os.path.join(d, n) for n in ("white", "agents", "jail", "bans")}
        for name, lines in (("white", white), ("agents", ['badbot/1.0 \\"scan\\"'])):
            with open(at[name], "w", encoding="utf-8") as f:
                f.write("\n".join(lines) + "\n")
        spec = Spec(jail_file=at["jail"], ban_file=at["bans"], whitelist=at["white"], ua_blacklist=at["agents"], tries={"all": TrieSpec(sets=_STATIC_SET)})
        static.analyse(spark, spec, r, _NOW)
        register = [p.cidr for c in jail.Jail.load(at["jail"]).cells for p in c.prisoners]
        with open(at["bans"], encoding="utf-8") as f:
            bans = [x for x in f.read().splitlines() if not x.startswith("#")]
    return spark.createDataFrame([("register", c) for c in register] + [("ban file", c) for c in bans], "place string, cidr string")


# ---- what is left of the range algebra


def _published(source: str) -> str:
    return f"""SELECT * FROM (WITH RECURSIVE bl AS (SELECT * FROM {source}), wh AS (SELECT * FROM gd), {_GAPS}, {_cover_sql('gaps')}
        SELECT {_ip_sql('low')} || '/' || CAST(32 - log2(size) AS INTEGER) AS cidr FROM cov UNION ALL SELECT {_ip_sql('start')} || '/' || len FROM bl WHERE ord NOT IN (SELECT ord FROM hits))"""


@query(f"""WITH {RANGES_SQL}, {derived.supplier_ranges_sql("sr", 16, 13)}, quarter AS (SELECT *, ("end" - start + 1) // 4 AS size FROM sr),
    gd AS (SELECT ord, start + 2 * size AS start, 32 - CAST(log2(size) AS INTEGER) AS len, start + 3 * size - 1 AS "end" FROM quarter)
    SELECT 'active' AS section, cidr, count(*) AS n FROM ({_published('rg')}) GROUP BY cidr UNION ALL SELECT 'manual', cidr, count(*) FROM ({_published('sr')}) GROUP BY cidr""")
def publish_composition(spark: SparkSession, sf: str) -> DataFrame:
    """Active bans and manual entries, both without the whitelist: the third quarter of every manual range."""
    active, manual = derived.ranges(spark, sf), derived.supplier_ranges(spark, sf, 16, 13)
    quarter = ipf.block_size(F.col("len") + 2)
    white = manual.select((F.col("start") + 2 * quarter).alias("start"), (F.col("len") + 2).alias("len"))
    both = [df.select(F.lit(name).alias("section"), "cidr") for name, df in zip(("active", "manual"), ranges.compose_ban_lists(active, manual, white), strict=True)]
    return both[0].unionByName(both[1]).groupBy("section", "cidr").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey AS k, 200 AS n, TRUE AS inside FROM nation")
def random_addresses(spark: SparkSession, sf: str) -> DataFrame:
    """200 addresses of a range for each nation: all within it, the first and the last one excluded."""
    rows = []
    for (k,) in spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey").orderBy("n_nationkey").collect():
        length = 8 + k % 22
        start, size = (10 << 24) + ((k << 18) >> 32 - length << 32 - length), 1 << 32 - length
        low, high, n = ipf.random_ips(spark, ipf.format_cidr(start, length), 200, seed=k).agg(F.min("ip"), F.max("ip"), F.count("ip")).first()
        rows.append((k, n, start < low <= high < start + size - 1))
    return spark.createDataFrame(rows, "k int, n int, inside boolean")


@query(f"""WITH {REQUESTS_SQL}, u AS (SELECT DISTINCT ip >> 24 AS a, ip FROM base WHERE ip <> 0)
    SELECT CAST(a AS INTEGER) AS a, string_agg(CAST(ip AS VARCHAR), ',' ORDER BY ip) AS ips FROM u GROUP BY a""")
def sorted_addresses(spark: SparkSession, sf: str) -> DataFrame:
    """The distinct addresses of each /8 network, in order."""
    ips = derived.requests(spark, sf).where("ip <> 0").select("ip").distinct().groupBy(F.shiftright("ip", 24).cast("int").alias("a"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("ip")), lambda x: x.cast("string")), ",")
    return ips.agg(text.alias("ips"))


@query(f"WITH RECURSIVE {_SPANS}, {_cover_sql('sp')} SELECT ord, {_ip_sql('low')} || '/' || CAST(32 - log2(size) AS INTEGER) AS cidr, low AS first, low + size - 1 AS last, {_ip_sql('low')} AS text FROM cov")
def sql_functions(spark: SparkSession, sf: str) -> DataFrame:
    """cidr_cover, cidr_start, cidr_end, ip_to_long and long_to_ip in a SQL text."""
    ipf.register(spark)
    covered = _spans(spark, sf).selectExpr("ord", "cidr_cover(start, end) AS cidrs").select("ord", F.explode("cidrs").alias("cidr"))
    return covered.selectExpr("ord", "cidr", "ip_to_long(split(cidr, '/')[0]) AS first", "cidr_end(cidr) AS last", "long_to_ip(cidr_start(cidr)) AS text")
