"""The escalating ban register: a small state machine, folded over ranges on the driver with an injected clock.

Cells are stages of longer bans. A range that is new starts in the first cell; one that comes back after its ban ran out moves on; one that holds jailed ranges
takes their place in the highest of their cells; one inside a jailed range counts as that range coming back.
"""

from __future__ import annotations

import functools
import ipaddress
import json
import os
import re
import tempfile
from bisect import bisect_left, insort
from collections import Counter
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ip as ipf

# The stages of a new register.
STAGES = [("10min", timedelta(minutes=10)), ("4h", timedelta(hours=4)), ("7d", timedelta(days=7)), ("30d", timedelta(days=30)), ("180d", timedelta(days=180))]

#: Lines of the register's file: the first, and the one between the cells and the list of all ranges.
FILE_MARKS = '{"Cells": [', '], "AllCidrs": ['
#: Lines of the ban file.
BAN_MARKS = "# Written by rangeloom at {now:%Y-%m-%d %H:%M:%S}; changes by hand are lost.", "# Ranges whose bans are in force", "# Ranges from the manual list", "# No more manual ranges"


class JailError(ValueError):
    pass


@dataclass
class Prisoner:
    cidr: str
    ban_start: datetime
    active: bool = True


@dataclass
class Cell:
    id: int
    description: str
    duration: timedelta
    prisoners: list[Prisoner] = field(default_factory=list)


#: Ranges as most are written; others go the long way.
_PLAIN = re.compile(r"(0|[1-9][0-9]{0,2})\.(0|[1-9][0-9]{0,2})\.(0|[1-9][0-9]{0,2})\.(0|[1-9][0-9]{0,2})/(0|[1-9][0-9]?)")


@functools.lru_cache(1 << 16)
def _span(cidr: str) -> tuple[int, int, int] | None:
    """First and last address and prefix length as the text writes them: host bits of the first stay."""
    if "/" not in cidr:
        return None
    if m := _PLAIN.fullmatch(cidr):
        *octets, n = map(int, m.groups())
        if max(octets) < 256 and n < 33:
            host = int.from_bytes(bytes(octets), "big")
            return host, host | (1 << 32 - n) - 1, n
    try:
        net, host = ipaddress.ip_network(cidr, strict=False), ipaddress.ip_address(cidr.split("/")[0])
    except ValueError:
        return None
    if net.version != 4:
        return None
    return int(host), int(host) | int(net.hostmask), net.prefixlen


def is_sub_range(inner: str, outer: str) -> bool:
    a, b = _span(inner), _span(outer)
    return bool(a and b and a[0] >= b[0] and a[1] <= b[1])


class Places:
    """Where each prisoner is: looked up by text, by the blocks that hold a range, and by first address, so that a fill does not look at
    everyone. Order is that of cells, and of arrival within a cell."""

    def __init__(self, cells: list[Cell]):
        self.by_text: dict[str, list[tuple[int, int, Prisoner]]] = {}
        self.by_block: dict[tuple[int, int], list[tuple[int, int, Prisoner]]] = {}
        self.starts: list[tuple[int, int]] = []
        self.lengths: Counter[int] = Counter()
        self.at: dict[int, tuple[int, int, Prisoner]] = {}
        self.next = 0
        for k, cell in enumerate(cells):
            for p in cell.prisoners:
                self.add(k, p)

    def add(self, cell: int, p: Prisoner) -> None:
        entry = (cell, self.next, p)
        self.at[id(p)] = entry
        self.by_text.setdefault(p.cidr, []).append(entry)
        if span := _span(p.cidr):
            self.lengths[span[2]] += 1
            self.by_block.setdefault((span[2], span[1] >> 32 - span[2]), []).append(entry)
            insort(self.starts, (span[0], self.next, span[1], entry))
        self.next += 1

    def drop(self, p: Prisoner) -> None:
        entry = self.at.pop(id(p))
        self.by_text[p.cidr].remove(entry)
        if span := _span(p.cidr):
            self.by_block[span[2], span[1] >> 32 - span[2]].remove(entry)
            self.lengths[span[2]] -= 1
            del self.starts[bisect_left(self.starts, (span[0], entry[1]))]

    def same(self, cidr: str) -> tuple[int, int, Prisoner] | None:
        return min(self.by_text.get(cidr, []), key=lambda e: e[:2], default=None)

    def inside(self, cidr: str) -> list[tuple[int, int, Prisoner]]:
        """Those that lie in a range."""
        first, last, _ = _span(cidr)
        found = [e for _, _, end, e in self.starts[bisect_left(self.starts, (first, -1)) : bisect_left(self.starts, (last + 1, -1))] if end <= last]
        return sorted(found, key=lambda e: e[:2])

    def around(self, cidr: str) -> tuple[int, int, Prisoner] | None:
        """The first that holds a range."""
        first, last, _ = _span(cidr)
        found = [e for n, held in self.lengths.items() if held for e in self.by_block.get((n, first >> 32 - n), []) if (s := _span(e[2].cidr)) and s[0] <= first and last <= s[1]]
        return min(found, key=lambda e: e[:2], default=None)


@dataclass
class Jail:
    cells: list[Cell]
    all_cidrs: list[str] = field(default_factory=list)

    def __post_init__(self):
        self._places: Places | None = None
        # what a fill took out goes from the lists at the end of the update, in one pass
        self._left: list[set[int]] = [set() for _ in self.cells]
        self._forgotten: Counter[str] = Counter()
        self._known: Counter[str] = Counter()

    @classmethod
    def new(cls) -> Jail:
        return cls([Cell(k, f"Stage {k} Ban -> {name}", duration) for k, (name, duration) in enumerate(STAGES, 1)])

    def _everyone(self) -> list[tuple[int, Prisoner]]:
        return [(k, p) for k, cell in enumerate(self.cells) for p in cell.prisoners]

    def _remove(self, cell: int, prisoner: Prisoner) -> None:
        self._left[cell].add(id(prisoner))
        self._places.drop(prisoner)

    def _forget(self, cidr: str) -> None:
        if self._known[cidr]:
            self._known[cidr] -= 1
            self._forgotten[cidr] += 1

    def _know(self, cidr: str) -> None:
        self._known[cidr] += 1
        self.all_cidrs.append(cidr)

    def _settle(self) -> None:
        """Lists without what has left them: prisoners by identity, ranges by their first places."""
        for cell, left in zip(self.cells, self._left, strict=True):
            if left:
                cell.prisoners[:] = [p for p in cell.prisoners if id(p) not in left]
                left.clear()
        if gone := self._forgotten:
            kept = []
            for c in self.all_cidrs:
                if gone[c]:
                    gone[c] -= 1
                else:
                    kept.append(c)
            self.all_cidrs[:], self._forgotten = kept, Counter()

    def _put(self, cell: int, prisoner: Prisoner) -> None:
        self.cells[cell].prisoners.append(prisoner)
        self._places.add(cell, prisoner)

    def _again(self, cell: int, prisoner: Prisoner, now: datetime) -> None:
        """A range comes back: nothing while it is banned, else a new ban, one stage on."""
        if prisoner.active:
            return
        prisoner.ban_start, prisoner.active = now, True
        if cell < len(self.cells) - 1:
            self._remove(cell, prisoner)
            self._put(cell + 1, prisoner)

    def fill(self, cidr: str, now: datetime) -> None:
        try:
            self._fill(cidr, now)
        finally:
            self._settle()

    def _fill(self, cidr: str, now: datetime) -> None:
        if not cidr:
            raise JailError("empty CIDR")
        span = _span(cidr)
        try:
            if "/" not in cidr:
                raise ValueError("no prefix length")
            if not span:
                ipaddress.ip_network(cidr, strict=False)
        except ValueError as e:
            raise JailError(f"error parsing CIDR {cidr}: {e}") from e
        if self._places is None:
            self._places, self._known = Places(self.cells), Counter(self.all_cidrs)
        same = self._places.same(cidr)
        inner = self._places.inside(cidr) if span and not same else []
        parent = self._places.around(cidr) if span and not same and not inner else None
        if same:
            self._again(same[0], same[2], now)
        elif inner:
            for k, _, p in inner:
                self._remove(k, p)
                self._forget(p.cidr)
            self._put(max(k for k, _, _ in inner), Prisoner(cidr, now))
            self._know(cidr)
        elif parent:
            self._again(parent[0], parent[2], now)
        else:
            if self.cells:
                self._put(0, Prisoner(cidr, now))
            self._know(cidr)

    def expire(self, now: datetime) -> None:
        for cell in self.cells:
            for p in cell.prisoners:
                if now - p.ban_start > cell.duration:
                    p.active = False

    def update(self, cidrs: list[str], now: datetime) -> list[str]:
        """A list of ranges comes in: expire once, then fill in order; messages of those that failed, which stop nothing."""
        self.expire(now)
        failed = []
        for c in cidrs:
            try:
                self._fill(c, now)
            except JailError as e:
                failed.append(str(e))
        self._settle()
        return failed

    def active_bans(self) -> list[str]:
        return [p.cidr for _, p in self._everyone() if p.active]

    def active_bans_with_meta(self) -> list[dict]:
        return [{"cidr": p.cidr, "stage": self.cells[k].id, "ban_start": p.ban_start, "expires_at": p.ban_start + self.cells[k].duration} for k, p in self._everyone() if p.active]

    def first_active(self, n: int) -> list[dict]:
        return self.active_bans_with_meta()[:n]

    def stage_counts(self) -> list[tuple[int, int]]:
        return [(c.id, sum(p.active for p in c.prisoners)) for c in self.cells]

    # ---- persistence

    def to_json(self) -> str:
        one = lambda p: {"Cidr": p.cidr, "BanStart": p.ban_start.isoformat().replace("+00:00", "Z"), "BanActive": p.active}
        rows = lambda texts: "".join("," * (k > 0) + t + "\n" for k, t in enumerate(texts))
        cells = rows(cell_head(c) + "\n" + rows(json.dumps(one(p)) for p in c.prisoners) + "]}" for c in self.cells)
        return f"{FILE_MARKS[0]}\n{cells}{FILE_MARKS[1]}\n{rows(map(json.dumps, self.all_cidrs))}]}}\n"

    @classmethod
    def from_json(cls, text: str) -> Jail:
        """An empty object is a register without cells; anything unreadable is a JailError."""
        try:
            doc = json.loads(text)
            cells = []
            for c in doc.get("Cells") or []:
                inmates = [Prisoner(p["Cidr"], _time(p["BanStart"]), bool(p["BanActive"])) for p in c.get("Prisoners") or []]
                cells.append(Cell(int(c["Id"]), c.get("Description", ""), timedelta(microseconds=int(c["BanDuration"]) / 1000), inmates))
            return cls(cells, list(doc.get("AllCidrs") or []))
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            raise JailError(f"unreadable register: {e}") from e

    @classmethod
    def load(cls, path: str) -> Jail:
        if not os.path.exists(path):
            return cls.new()
        with open(path, encoding="utf-8") as f:
            return cls.from_json(f.read())

    def save(self, path: str) -> None:
        write_atomic(path, self.to_json())

    def table(self, spark: SparkSession) -> DataFrame:
        """(cell_id, pos, cidr, ban_start, ban_active, expires_at): the register for queries."""
        rows = [(c.id, k, p.cidr, p.ban_start, p.active, p.ban_start + c.duration) for c in self.cells for k, p in enumerate(c.prisoners)]
        return spark.createDataFrame(rows, "cell_id int, pos int, cidr string, ban_start timestamp, ban_active boolean, expires_at timestamp")


def cell_head(cell: Cell) -> str:
    """The line above a cell's prisoners, one a line, in the register's file."""
    return json.dumps({"Id": cell.id, "Description": cell.description, "BanDuration": cell.duration // timedelta(microseconds=1) * 1000, "Prisoners": []})[:-2]


def _time(text: str) -> datetime:
    t = datetime.fromisoformat(re.sub(r"(\.\d{6})\d+", r"\1", text).replace("Z", "+00:00"))
    return t if t.tzinfo else t.replace(tzinfo=timezone.utc)


def write_atomic(path: str, text: str, mode: int = 0o644) -> None:
    """Replace a file in one step: readers see the old text or the new one."""
    folder = os.path.dirname(os.path.abspath(path))
    fd, tmp = tempfile.mkstemp(dir=folder, prefix=".tmp-")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.chmod(tmp, mode)
        os.replace(tmp, path)
    except BaseException:
        if os.path.exists(tmp):
            os.unlink(tmp)
        raise


def ban_file(active: list[str], manual: list[str], now: datetime) -> str:
    """Text of the ban file; empty sections are left out."""
    out = [BAN_MARKS[0].format(now=now)]
    if active:
        out += [BAN_MARKS[1], *active]
    if manual:
        out += [BAN_MARKS[2], *manual, BAN_MARKS[3]]
    return "\n".join(out) + "\n"


def stage_counts(prisoners: DataFrame) -> DataFrame:
    """(cell_id, active) of a register's table."""
    return prisoners.groupBy("cell_id").agg(F.count_if("ban_active").alias("active"))


def active_bans(prisoners: DataFrame, now, durations: DataFrame) -> DataFrame:
    """(cidr, stage, ban_start, expires_at) of bans that are active at ``now``; durations: (cell_id, seconds)."""
    both = prisoners.join(F.broadcast(durations.select(F.col("cell_id").alias("_c"), "seconds")), F.col("cell_id") == F.col("_c"))
    ends = F.timestamp_seconds(F.col("ban_start").cast("double") + F.col("seconds"))
    return both.where(F.col("ban_active") & (F.lit(now) <= ends)).select("cidr", F.col("cell_id").alias("stage"), "ban_start", ends.alias("expires_at"))


#: Rounds are replayed by this many leading bits of an address, and a part that has more offences than this in groups of about so many; a shorter
#: range joins all parts that it touches.
PART_BITS, GROUP = 16, 8192


def _odd_block(cidr: str | None) -> int | None:
    """64 * start + len of a range that is not written in the usual way."""
    span = _span(cidr) if cidr else None
    return (span[1] >> 32 - span[2] << 32 - span[2]) * 64 + span[2] if span else None


def _with_block(df: DataFrame, odd: bool) -> DataFrame:
    """With the block that a text's range fills, (start, len); (-1, -1) for what is no IPv4 range. odd: whether there are texts that only Python reads."""
    p = F.split(F.translate("cidr", "/", "."), r"\.")
    usual = df.withColumn("_p", F.when(ipf.is_cidr(F.col("cidr")), p))
    rest = F.udf(_odd_block, "long", useArrow=True)(F.when(_is_odd(), F.col("cidr"))) if odd else F.lit(None).cast("long")
    octets = [F.col("_p")[k].cast("bigint") for k in range(4)]
    host = functools.reduce(lambda x, octet: x * 256 + octet, octets)
    placed = usual.select(*df.columns, host.alias("_host"), F.col("_p")[4].cast("int").alias("_len"), rest.alias("_rest"))
    start = F.coalesce(ipf.mask(F.col("_host"), F.col("_len")), F.shiftright("_rest", 6), F.lit(-1))
    length = F.coalesce("_len", F.col("_rest").bitwiseAND(F.lit(63)).cast("int"), F.lit(-1))
    return placed.select(*df.columns, start.alias("start"), length.alias("len"))


def _is_odd() -> Column:
    """Whether a text may be a range that is not written in the usual way, as with the mask in place of a length."""
    return F.col("cidr").rlike(r"\A[0-9.]+/[0-9.]+\z") & ~ipf.is_cidr(F.col("cidr"))


def parted(offences: DataFrame) -> DataFrame:
    """(round, ord, cidr, part, group): what meets, whatever its round, has the same part and group.

    A group holds the outermost ranges that begin within ``GROUP`` offences of a part, in order, with all that lies in them; so only one large outermost
    range makes a group much larger.
    """
    plain = offences.select(F.col("round").cast("int").alias("round"), F.col("ord").cast("long").alias("ord"), "cidr")
    # at most as many as there are prefixes shorter than a part, and one row for all odd texts
    is_short = (F.col("len") >= 0) & (F.col("len") < PART_BITS)
    maybe = plain.where(~F.col("cidr").rlike("/(1[6-9]|2[0-9]|3[0-2])$") | _is_odd())
    seen = _with_block(maybe, False).where(is_short | _is_odd()).select("len", "start").distinct().collect()
    odd = any(r["len"] < 0 for r in seen)
    if odd:
        seen += _with_block(plain.where(_is_odd()), True).where(is_short).select("len", "start").distinct().collect()
    short = sorted({(r["len"], r["start"]) for r in seen if r["len"] >= 0})
    head = {}
    for n, start in short:
        for part in range(start >> 32 - PART_BITS, (start >> 32 - PART_BITS) + (1 << PART_BITS - n)):
            head.setdefault(part, start >> 32 - PART_BITS)
    part = F.shiftright("start", 32 - PART_BITS)
    rows = _with_block(plain, odd).withColumn("part", F.when(F.col("start") < 0, -1 - F.abs(F.hash("cidr").cast("long"))).otherwise(part))
    if head:
        heads = offences.sparkSession.createDataFrame([(a, b) for a, b in head.items() if a != b] or [(-1 << 40, 0)], "part long, head long")
        rows = rows.join(F.broadcast(heads), "part", "left").withColumn("part", F.coalesce("head", "part")).drop("head")
    order = Window.partitionBy("part").orderBy("start", "len")
    last = F.when(F.col("len") < 0, F.col("start")).otherwise(ipf.last_ip(F.col("start"), F.col("len")))
    rows = rows.withColumns({"_reached": F.max(last).over(order.rowsBetween(Window.unboundedPreceding, -1)), "_place": F.row_number().over(order)})
    outermost = F.col("_reached").isNull() | (F.col("start") > F.col("_reached"))
    place = F.max(F.when(outermost, F.col("_place"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.select("round", "ord", "cidr", "part", F.floor((place - 1) / GROUP).alias("group"))


def replay(offences: DataFrame, times: list[datetime]) -> DataFrame:
    """The register, from a new one, after a list of ranges at each of ``times``: (cell_id, cidr, ban_start, ban_active, failed).

    offences: (round, ord, cidr); a round's list is in the order of ``ord``. ``failed`` is the message of one that was refused; such a row has no
    cell. Ranges that do not meet never change each other, so each group of outermost ranges is replayed by itself, by a :class:`Jail` of its own, and
    texts that are no IPv4 range with those that have the same text.
    """

    def run(df):
        import pandas as pd

        j, failed = Jail.new(), []
        lists = {r: g.sort_values("ord")["cidr"].tolist() for r, g in df.groupby("round")}
        for r, now in enumerate(times):
            failed += j.update(lists.get(r, []), now)
        held = [(c.id, p.cidr, p.ban_start, p.active, None) for c in j.cells for p in c.prisoners]
        if sorted(j.all_cidrs) != sorted(h[1] for h in held):
            raise JailError("a register's cells and its list of all ranges differ")
        out = pd.DataFrame(held + [(None, None, None, None, f) for f in failed], columns=["cell_id", "cidr", "ban_start", "ban_active", "failed"], dtype=object)
        return out.assign(cell_id=out["cell_id"].astype("Int32"), ban_start=pd.to_datetime(out["ban_start"], utc=True), ban_active=out["ban_active"].astype("boolean"))

    rows = parted(offences).repartition(4 * offences.sparkSession.sparkContext.defaultParallelism, "part", "group")
    return rows.groupBy("part", "group").applyInPandas(run, "cell_id int, cidr string, ban_start timestamp, ban_active boolean, failed string")
