"""Helpers shared by the training-data operators: shared storage and Arrow text pieces."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import drop, new_folder  # noqa: F401

#: Text bytes handled by one vectorised step; longer texts make a step of their own.
PIECE_BYTES = 1 << 20
PIECE_ROWS = 1024


#: With this, the files of a plan's shuffles go when the plan has ended, not when the driver collects its garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Plans that run inside leave no shuffle files."""
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(TIDY)
        else:
            spark.conf.set(TIDY, before)


def table(df: DataFrame, name: str, codec: str = "zstd", partition_by: str | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet to the shared folder; return the reread table and its path.

    This cuts the lineage, and the files outlive any executor.
    """
    spark = df.sparkSession
    at = new_folder(spark, name)
    out = df.write.option("compression", codec)
    with tidy(spark):
        (out.partitionBy(partition_by) if partition_by else out).parquet(at)
    return spark.read.schema(df.schema).parquet(at), at


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until no column of ``df`` has it, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def text_array(col: pa.Array) -> pa.Array:
    """Nulls as empty texts; large offsets never needed, as one batch stays under 2 GB."""
    return pc.fill_null(col, "") if col.null_count else col


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of at most ``limit`` text bytes and ``PIECE_ROWS`` rows, or one row; column order is kept."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < n:
            end, total = at + 1, int(sizes[at])
            while end < min(n, at + PIECE_ROWS) and total + int(sizes[end]) <= limit:
                total += int(sizes[end])
                end += 1
            yield batch.slice(at, end - at)
            at = end
