"""Operator 3. Exact top-k search: tiled matrix products, partial selection, tree merging.

Queries are taken in tiles of bounded size, each broadcast once. A task multiplies the
tile with one block of its shard after another and keeps only each query's best k so far;
the shards' lists are merged in a tree of two levels, each of which keeps k a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import new_folder, table

#: Numbers in a tile of queries (64 MB of doubles), and candidates multiplied at once.
TILE_NUMBERS, BLOCK = 1 << 23, 2048
LONG = (-(1 << 63), (1 << 63) - 1)


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not empty, and all components finite."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, as doubles, which hold it exactly."""
    return F.transform(vector.cast("array<double>"), lambda x: _floor(x * scale))


def _floor(x: Column) -> Column:
    # floor() of a double is a long and saturates; beyond 2**53 a double is whole anyway
    return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers: exact in doubles while sums stay below 2**53, else in Python integers,
    held to the range of a long."""
    most = (np.abs(a).max(initial=0) * np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2.0**53:
        return a @ b.T
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object)
    return np.clip(whole(a) @ whole(b).T, *LONG)


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score) of each row's k highest scores, ties to the smaller id. ids ascend; own[row] never counts."""
    n = scores.shape[1]
    valid = own[:, None] != ids[None, :]
    if scores.dtype == object:
        pick = valid
    else:
        masked = np.where(valid, scores, -np.inf)
        pick = valid if n <= k else valid & (masked >= np.partition(masked, n - k, axis=1)[:, n - k, None])
    row, col = np.nonzero(pick)
    score = scores[row, col]
    order = np.lexsort((col, -score, row)) if scores.dtype != object else np.array(sorted(range(len(row)), key=lambda x: (row[x], -score[x], col[x])), int)
    row, col, score = row[order], col[order], score[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], ids[col[rank < k]], score[rank < k]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, tile_numbers: int = TILE_NUMBERS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products over all other rows.

    ``vectors`` has vec_id long and embedding array<float or double>; other columns are ignored. Vectors that are null, empty or
    hold null or non-finite components, and rows without an id, take no part. Only vectors of equal length are compared. Rows that
    repeat a query's id are its own; of repeated candidate ids each row counts; a query id that repeats is asked
    once, with its smallest vector. A query with no candidate has no row; an empty table gives none. Vectors are quantised
    and written once; a tile of queries costs a pass over these.
    """
    spark = vectors.sparkSession
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows, _ = table(good.select("vec_id", quantised(F.col("embedding"), scale).alias("v")), "topk-vectors")
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    n, width = rows.where(is_query).agg(F.count_distinct("vec_id"), F.max(F.size("v"))).first()
    tiles = max(1, -(-n * (width or 1) * 5 // (4 * tile_numbers)))
    asked, _ = table(asked.withColumn("tile", F.pmod(F.xxhash64("vec_id"), F.lit(tiles)).cast("int")), "topk-queries", partition_by="tile")
    at = new_folder(spark, "topk")
    schema = "query_id long, vec_id long, score long, shard int"
    for t in range(tiles):
        mine = asked.where(F.col("tile") == t).select("vec_id", "v").toArrow().combine_chunks()
        ids, lists = mine.column("vec_id").to_numpy(), mine.column("v").combine_chunks() if len(mine) else None
        groups = {}
        if len(mine):
            first = lists.offsets.to_numpy()
            flat, size = lists.values.to_numpy(zero_copy_only=False), np.diff(first)
            for d in np.unique(size).tolist():
                of_d = np.flatnonzero(size == d)
                groups[d] = (ids[of_d], flat[first[of_d][:, None] + np.arange(d)])
        tile = spark.sparkContext.broadcast(groups)

        def search(batches: Iterator[pa.RecordBatch], tile=tile) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            kept: dict[int, tuple] = {}
            for batch in batches:
                ids, col = batch.column(0).to_numpy(), batch.column(1)
                lengths = np.diff(col.offsets.to_numpy())
                flat, first = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()[:-1]
                for d, (own, q) in tile.value.items():
                    of_d = np.flatnonzero(lengths == d)
                    of_d = of_d[np.argsort(ids[of_d], kind="stable")]
                    for a in range(0, len(of_d), BLOCK):
                        some = of_d[a : a + BLOCK]
                        block = flat[first[some][:, None] + np.arange(d)]
                        for b in range(0, len(own), BLOCK):
                            got = best(products(q[b : b + BLOCK], block), ids[some], own[b : b + BLOCK], k)
                            kept[d, b] = merge(kept.get((d, b)), got, k)
            shard = TaskContext.get().partitionId()
            for (d, b), (row, vec, score) in kept.items():
                out = [tile.value[d][0][b + row], vec, np.array([int(x) for x in score], np.int64), np.full(len(row), shard, np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["query_id", "vec_id", "score", "shard"])

        rows.mapInArrow(search, schema).write.mode("append").parquet(at)
        tile.destroy()
    lists = spark.read.schema(schema).parquet(at)
    order = [F.col("score").desc(), F.col("vec_id")]
    near = lists.withColumn("branch", F.col("shard") % 16)
    first = near.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "branch").orderBy(*order))).where(F.col("r") <= k)
    ranked = first.select("query_id", "vec_id", "score").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def merge(a: tuple | None, b: tuple, k: int) -> tuple:
    """The best k a row of two lists of (row, id, score)."""
    if a is None:
        return b
    row, vec, score = (np.concatenate(x) for x in zip(a, b, strict=True))
    order = np.lexsort((vec, -score, row)) if score.dtype != object else np.array(sorted(range(len(row)), key=lambda x: (row[x], -score[x], vec[x])), int)
    row, vec, score = row[order], vec[order], score[order]
    few = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[few], vec[few], score[few]
