"""State tables of the live loop: versions, published by manifests.

A step writes each table to a new place and publishes all of them at once by a small manifest, a JSON file that appears in one rename. A step
that is replayed starts from the manifest before its number, writes new places again and replaces its own manifest; what it
read is still there, as tables go only when no kept manifest names them. A new process finds the last manifest.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


class StateStore:
    """A folder, in any store Spark reads, with manifests ``manifest-<number>.json`` and the tables they name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.folder))

    def numbers(self) -> list[int]:
        """Numbers of the published steps, ascending."""
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.folder))]
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"manifest-(\d+)\.json", n)))

    def read(self, number: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.folder}/manifest-{number}.json", wholetext=True).first()[0])

    def before(self, number: int) -> dict | None:
        """The last manifest with a smaller number."""
        known = [n for n in self.numbers() if n < number]
        return self.read(known[-1]) if known else None

    def write(self, df: DataFrame, name: str) -> str:
        """Write a table to a new place."""
        at = f"{self.folder}/{name}/{uuid.uuid4().hex}"
        df.write.parquet(at)
        return at

    def publish(self, number: int, doc: dict) -> None:
        """Make a manifest stand, and clear what only older ones than the one before it, or a replaced one, name."""
        final, fresh = (self._path(f"{self.folder}/{n}") for n in (f"manifest-{number}.json", f".manifest-{uuid.uuid4().hex}"))
        out = self._fs.create(fresh, True)
        out.write(bytearray(json.dumps(doc).encode()))
        out.close()
        known = self.numbers()
        every = {n: self.read(n) for n in known}
        if number in every:
            self._fs.delete(final, False)
        self._fs.rename(fresh, final)
        kept = [n for n in known if n < number][-1:]
        named = {t for n in kept for t in every[n]["tables"].values()} | set(doc["tables"].values())
        for n, old in every.items():
            for t in set(old["tables"].values()) - named:
                self._fs.delete(self._path(t), True)
            if n not in kept and n != number:
                self._fs.delete(self._path(f"{self.folder}/manifest-{n}.json"), False)
