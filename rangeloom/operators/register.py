"""A ban register too large for the driver: its prisoners are a table, its file is written and read by tasks.

The file is the one that :class:`~rangeloom.operators.jail.Jail` reads and writes, one JSON document, with one prisoner a line.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import pieces
from .jail import BAN_MARKS, FILE_MARKS, Cell, Jail, cell_head, stage_counts

_MICROS = 86_400_000_000


def _is_mark(value: Column) -> Column:
    return value.isin(FILE_MARKS[0], FILE_MARKS[1]) | value.rlike(r'^,?\{"Id": .*"Prisoners": \[$')


def _told(ts: Column) -> Column:
    """A time as the register's file writes it, in whatever time zone the session is."""
    us = F.unix_micros(ts)
    rest = F.pmod(us, F.lit(_MICROS))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    part = lambda size, n: two(F.floor(rest / size) % n)
    micros = rest % 1_000_000
    more = F.when(micros == 0, "").otherwise(F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0")))
    day = F.date_from_unix_date(((us - rest) / _MICROS).cast("int")).cast("string")
    return F.concat(day, F.lit("T"), part(3_600_000_000, 24), F.lit(":"), part(60_000_000, 60), F.lit(":"), part(1_000_000, 60), more, F.lit("Z"))


def _quoted(text: Column) -> Column:
    whole = F.to_json(F.struct(text.alias("c")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


@dataclass
class Register:
    """``prisoners``: (cell_id, cidr, ban_start, ban_active, *order), whose order within a cell is that of the columns ``order``;
    ``listed``: (cidr, *order), every range that the register knows."""

    cells: list[Cell]
    prisoners: DataFrame
    listed: DataFrame
    order: list[str]

    def _duration(self) -> Column:
        """Of a row's cell, in microseconds."""
        pairs = [x for c in self.cells for x in (F.lit(c.id), F.lit(c.duration // timedelta(microseconds=1)).cast("long"))]
        return F.create_map(*pairs)[F.col("cell_id")]

    def table(self) -> DataFrame:
        """(cell_id, cidr, ban_start, ban_active, expires_at)."""
        if not self.cells:
            return self.prisoners.select("cell_id", "cidr", "ban_start", "ban_active", F.col("ban_start").alias("expires_at")).limit(0)
        ends = F.timestamp_micros(F.unix_micros("ban_start") + self._duration())
        return self.prisoners.select("cell_id", "cidr", "ban_start", "ban_active", ends.alias("expires_at"))

    def active(self) -> DataFrame:
        """(cidr, ord): bans in force; ``ord`` has their order."""
        return self.prisoners.where("ban_active").select("cidr", F.struct("cell_id", *self.order).alias("ord"))

    def stage_counts(self) -> list[tuple[int, int]]:
        found = {r["cell_id"]: r["active"] for r in stage_counts(self.prisoners).collect()}
        return [(c.id, found.get(c.id, 0)) for c in self.cells]

    def first_active(self, n: int) -> list[dict]:
        """The first bans in force, as :meth:`Jail.first_active`."""
        durations = {c.id: c.duration for c in self.cells}
        rows = self.prisoners.where("ban_active").orderBy("cell_id", *self.order).limit(n).select("cidr", "cell_id", F.unix_micros("ban_start").alias("us"))
        out = []
        for r in rows.collect():
            start = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=r["us"])
            out.append({"cidr": r["cidr"], "stage": r["cell_id"], "ban_start": start, "expires_at": start + durations[r["cell_id"]]})
        return out

    def save(self, path: str) -> None:
        """Write the file; the path must be one that the driver and all executors see."""
        spark = self.prisoners.sparkSession
        one = F.to_json(F.struct(F.col("cidr").alias("Cidr"), _told(F.col("ban_start")).alias("BanStart"), F.col("ban_active").alias("BanActive")))
        held = pieces.write_sorted(self.prisoners, F.concat(F.lit(","), one), self.order, ["cell_id"])
        known = pieces.write_sorted(self.listed, F.concat(F.lit(","), _quoted(F.col("cidr"))), self.order)
        text: list[str | tuple[str, int]] = [FILE_MARKS[0] + "\n"]
        for k, c in enumerate(self.cells):
            text += ["," * (k > 0) + cell_head(c) + "\n", (f"{held}/cell_id={c.id}", 1), "]}\n"]
        pieces.put_together(spark, path, [*text, FILE_MARKS[1] + "\n", (known, 1), "]}\n"])
        pieces.drop(spark, held, known)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Register:
        """Read the file: by tasks if it has a prisoner a line, as :meth:`save` writes it, else on the driver."""
        rows = pieces.lines(spark, path)
        if rows.limit(1).collect()[0]["value"] != FILE_MARKS[0]:
            whole = spark.read.text(path, wholetext=True).first()[0]
            return cls.of(spark, Jail.from_json(whole))
        heads = [r["value"] for r in rows.where(_is_mark(F.col("value"))).orderBy("at").collect()]
        cells = Jail.from_json(f"{heads[0]}{''.join(f'{h}]}}' for h in heads[1:-1])}{heads[-1]}]}}").cells
        under = pieces.under_marks(spark, path, _is_mark).where(~F.col("value").isin("]}", "")).withColumn("value", F.ltrim("value", F.lit(",")))
        # conditions of who reads the table may be looked at before a line's place is known, so each expression asks for it
        inside = F.col("mark") != FILE_MARKS[1]
        p = F.from_json(F.when(inside, F.col("value")), "Cidr string, BanStart string, BanActive boolean", {"mode": "FAILFAST"})
        have = lambda x, where: F.when(where, F.coalesce(x, F.raise_error(F.lit("unreadable register")).cast("string")))
        start = have(p["BanStart"], inside)
        start = F.when(start.rlike(r"(Z|[+-]\d\d:?\d\d)$"), start).otherwise(F.concat(start, F.lit("Z"))).cast("timestamp")
        cell = F.regexp_extract("mark", r'"Id": (\d+)', 1).try_cast("int")
        prisoners = under.where(inside).select(cell.alias("cell_id"), have(p["Cidr"], inside).alias("cidr"), start.alias("ban_start"), have(p["BanActive"].cast("string"), inside).cast("boolean").alias("ban_active"), "at")
        text = F.from_json(F.when(~inside, F.concat(F.lit('{"c":'), "value", F.lit("}"))), "c string", {"mode": "FAILFAST"})
        listed = under.where(~inside).select(have(text["c"], ~inside).alias("cidr"), "at")
        return cls(cells, prisoners, listed, ["at"])

    @classmethod
    def of(cls, spark: SparkSession, j: Jail) -> Register:
        """A register of the driver as a table."""
        prisoners = [(c.id, p.cidr, p.ban_start, p.active, k) for c in j.cells for k, p in enumerate(c.prisoners)]
        listed = [(c, k) for k, c in enumerate(j.all_cidrs)]
        cells = [Cell(c.id, c.description, c.duration) for c in j.cells]
        return cls(cells, spark.createDataFrame(prisoners, "cell_id int, cidr string, ban_start timestamp, ban_active boolean, at long"), spark.createDataFrame(listed, "cidr string, at long"), ["at"])


def write_ban_file(path: str, active: DataFrame, manual: DataFrame, now: datetime) -> None:
    """The ban file of tables (cidr, ord, ...), in their order, as :func:`~rangeloom.operators.jail.ban_file` has it of lists."""
    spark, text, made = active.sparkSession, [BAN_MARKS[0].format(now=now) + "\n"], []
    for rows, head, foot in ((active, BAN_MARKS[1], ""), (manual, BAN_MARKS[2], BAN_MARKS[3] + "\n")):
        made.append(pieces.write_sorted(rows, F.col("cidr"), [c for c in rows.columns if c != "cidr"]))
        if pieces.has_lines(spark, made[-1]):
            text += [head + "\n", (made[-1], 0), foot]
    pieces.put_together(spark, path, text)
    pieces.drop(spark, *made)


def read_ban_file(spark: SparkSession, path: str) -> DataFrame:
    """(section, cidr) of a ban file."""
    rows = pieces.under_marks(spark, path, lambda x: x.startswith("#"))
    return rows.select(F.when(F.col("mark") == BAN_MARKS[2], "manual").otherwise("active").alias("section"), F.col("value").alias("cidr"))
