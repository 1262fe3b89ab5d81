r"""Operator 7. Chat formatting by prefix-target expansion.

Each assistant turn becomes an example of its own: every preceding turn of the
conversation is context, and only that reply is trainable. All examples of a
conversation are prefixes of one formatted text, so the output is one table,

``segments`` (conv_id, pos, role, start, formatted, example, target_start, target_end): the formatted text of each turn, written
once; an assistant turn also carries its example's number and loss mask [target_start, target_end), in code points of the
conversation's text. Example number ``example`` is that text up to ``target_end``; :func:`examples_of` lists them.

A conversation of n turns so takes n segments and at most n examples, not n² turns;
:func:`render` writes the full strings out for those who want them.

Template of a turn: ``<|im_start|>role\ntext<|im_end|>\n``. In texts and roles, each ``<`` that
is followed by any number of backslashes and a ``|`` gets one more backslash, so no
control string can appear inside; removing one backslash there is the inverse. Roles
also have backslash and line feed written as ``\\`` and ``\n``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

START, END = "<|im_start|>", "<|im_end|>\n"
PARSE = re.compile(r"<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def _escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_chat(conv: DataFrame) -> DataFrame:
    """Segments of a table conv_id, turn, role, text; other columns are ignored.

    Null texts and null roles are empty; turns with equal or null numbers follow by role, then text, nulls
    first; a null conv_id is a conversation of its own; repeated rows are repeated turns; an empty table gives none. One shuffle, by
    conversation; a conversation streams through its task sorted and is never held whole, so a very long one costs time, not memory.
    """
    rows = conv.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    shown = F.replace(F.replace(F.col("role"), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    head = F.concat(F.lit(START), _escaped(shown), F.lit("\n"))
    rows = rows.withColumn("head_chars", F.length(head)).withColumn("formatted", F.concat(head, _escaped(F.col("text")), F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    reply = F.col("role") == "assistant"
    zero = F.lit(0).cast("long")
    rows = rows.withColumns({
        "pos": F.row_number().over(order).cast("long") - 1, "start": F.coalesce(F.sum(F.length("formatted")).over(before), zero),
        "replies": F.coalesce(F.sum(reply.cast("long")).over(before), zero),
    })
    only = lambda c: F.when(reply, c)
    return rows.select(
        "conv_id", "pos", "role", "start", "formatted", only(F.col("replies")).alias("example"), only(F.col("start") + F.col("head_chars")).alias("target_start"),
        only(F.col("start") + F.length("formatted") - len(END)).alias("target_end"),
    )


def examples_of(segments: DataFrame) -> DataFrame:
    """conv_id, example, reply_pos, context_chars, target_start, target_end: one row an assistant turn. A projection of the segments."""
    of = segments.where(F.col("example").isNotNull())
    return of.select("conv_id", "example", F.col("pos").alias("reply_pos"), F.col("start").alias("context_chars"), "target_start", "target_end")


def render(segments: DataFrame) -> DataFrame:
    """Full strings: conv_id, example, context, target, of conversations without id too.

    This writes every context out, so its size is that of all prefixes together, and a context is one row that must fit a task. No
    segments, no rows; other columns of the segments are ignored.
    """
    of = examples_of(segments).withColumnRenamed("conv_id", "c")
    got = of.join(segments.select("conv_id", "pos", "formatted"), F.col("c").eqNullSafe(F.col("conv_id")) & (F.col("pos") <= F.col("reply_pos")))
    text = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("pos", "formatted"))), lambda s: s["formatted"]))
    whole = got.groupBy("conv_id", "example", "target_start", "target_end").agg(text.alias("text"))
    context, target = "substring(text, 1, int(target_start))", "substring(text, int(target_start) + 1, int(target_end - target_start))"
    return whole.select("conv_id", "example", F.expr(context).alias("context"), F.expr(target).alias("target"))


class _Reader:
    """What is read of one conversation so far."""

    def __init__(self, conv: int | None):
        self.conv, self.turns, self.loss_chars, self.chars, self.examples = conv, 0, 0, 0, 0
        self.said, self.loss, self.text, self.chain = (hashlib.sha256() for _ in range(4))

    def turn(self, start: int, formatted: str, t0: int | None, t1: int | None) -> None:
        role, text = PARSE.fullmatch(formatted).groups()
        self.turns += 1
        self.said.update(f"{unescape_role(role)}\n{unescape(text)}\n".encode())
        self.chars += len(formatted)
        if t0 is not None:
            loss = unescape(formatted[t0 - start : t1 - start])
            self.loss_chars += len(loss)
            self.loss.update(loss.encode())
            self.examples += 1
            whole = self.text.copy()  # the example's text: all before, and this turn up to its mask's end
            whole.update(formatted[: t1 - start].encode())
            self.chain.update(f"{t0}:{whole.hexdigest()};".encode())
        self.text.update(formatted.encode())

    def row(self) -> tuple:
        return (self.conv, self.turns, self.said.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.examples, self.chain.hexdigest())


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long, examples_sha256 string"


def read_back(segments: DataFrame) -> DataFrame:
    """Digest of what the written output says, a row a conversation (columns ``READ``): the turns parsed from the formatted text, the
    text under the loss masks, and the examples: ``examples_sha256`` is over ``<mask start>:<hex sha256 of the example's text>;`` of each.

    A hash is sequential, so a conversation's rows stream through one task, one at a time, in constant memory; an example's
    text is never rebuilt, as the running hash of the text before it is copied. One shuffle; no segments, no rows.
    """
    names = [x.split()[0] for x in READ.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Reader | None = None
        done: list[tuple] = []

        def out() -> pa.RecordBatch:
            kinds = [pa.string() if n.endswith("sha256") else pa.int64() for n in names]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for conv, start, formatted, t0, t1 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now.conv != conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Reader(conv)
                now.turn(start, formatted, t0, t1)
            if len(done) >= 1000:
                yield out()
                done = []
        if now is not None:
            done.append(now.row())
        if done:
            yield out()

    rows = segments.select("conv_id", "start", "formatted", "target_start", "target_end")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "start").mapInArrow(run, READ)


def chat_files(conv: DataFrame) -> DataFrame:
    """Format, write the segments to the shared folder, read them and return :func:`read_back`'s rows."""
    written, _ = table(format_chat(conv), "chat-segments")
    return read_back(written)
