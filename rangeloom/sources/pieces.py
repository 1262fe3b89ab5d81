"""One text file too large for the driver: put together from what tasks wrote, and read again by tasks, with lines in their order."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import drop, new_folder  # noqa: F401 - who writes pieces drops them


def _parts(spark: SparkSession, folder: str) -> list:
    """Paths of a folder's part files that are not empty, in the order of their tasks; none if there is no such folder."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(conf)
    found = fs.listStatus(path) if fs.exists(path) else []
    named = [(m, f.getPath()) for f in found if (m := re.match(r"part-(\d+)", f.getPath().getName())) and f.getLen()]
    return [p for _, p in sorted(named, key=lambda x: (int(x[0][1]), x[1].getName()))]


def write_sorted(rows: DataFrame, line: Column, order: list[str], by: list[str] | None = None) -> str:
    """A folder with a line for each row, in the order of ``order`` over its part files; ``by``: columns of which each value gets a folder of its own."""
    keys, folder = [*(by or []), *order], new_folder(rows.sparkSession, "pieces")
    out = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*(by or []), line.alias("value")).write.option("compression", "none")
    (out.partitionBy(*by) if by else out).text(folder)
    return folder


def put_together(spark: SparkSession, path: str, pieces: list[str | tuple[str, int]]) -> None:
    """Replace a file by texts and folders, one after the other; of a folder, so many first bytes are left out. Readers see the old file or the new one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    tmp = jvm.org.apache.hadoop.fs.Path(at.getParent(), f".tmp-{at.getName()}")
    out = fs.create(tmp, True)
    try:
        for piece in pieces:
            if isinstance(piece, str):
                out.write(piece.encode())
                continue
            for k, part in enumerate(_parts(spark, piece[0])):
                source = part.getFileSystem(conf).open(part)
                try:
                    source.seek(0 if k else piece[1])
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
                finally:
                    source.close()
    finally:
        out.close()
    how = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    how[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(tmp), fs.makeQualified(at), how)


def has_lines(spark: SparkSession, folder: str) -> bool:
    return bool(_parts(spark, folder))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, at): the lines of one file; ``at`` has their order."""
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return spark.read.text(path).select("value", at.alias("at"))


def under_marks(spark: SparkSession, path: str, is_mark: Callable[[Column], Column]) -> DataFrame:
    """(value, at, mark): the lines that are no marks, each with the last mark above it. There are few marks: they are broadcast."""
    rows = lines(spark, path)
    marks = rows.where(is_mark(F.col("value"))).agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("_marks"))
    both = rows.where(~is_mark(F.col("value"))).crossJoin(F.broadcast(marks))
    above = F.try_element_at(F.filter("_marks", lambda m: m["at"] < F.col("at")), F.lit(-1))
    return both.select("value", "at", above["value"].alias("mark"))
