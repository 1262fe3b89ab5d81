"""Operator 1. Token-id files: byte-plane shuffled, zstandard-compressed, chunk-indexed.

File format: a Parquet table ("container") of chunks. A chunk holds the ids of whole
documents, in order; its id stream is cut into blocks of ``block_ids`` ids (the last one
shorter). A block of n 32-bit ids is transposed into four byte planes of n bytes, least
significant first, and every plane is a zstandard frame of its own, so the two upper
planes of a small vocabulary nearly vanish. Columns:

    shard int, chunk int    place: shards ascend with doc_id, chunks ascend in a shard
    n_ids long              ids in the chunk
    doc_ids array<long>     its documents, in order
    lengths array<int>      ids of each
    blocks array<array<binary>>  the planes

The chunk index is (shard, chunk, n_ids): it gives every chunk's first id with no plane read.
The container is written by Spark's committer, so a lost executor leaves no partial shard.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import new_folder, text_array

BLOCK_IDS = 1 << 14
CHUNK_IDS = 1 << 17
END_ID = 2
#: Distinct chunks of text whose ids one worker remembers.
CACHE = 500_000

CONTAINER = T.StructType([
    T.StructField("shard", T.IntegerType()), T.StructField("chunk", T.IntegerType()), T.StructField("n_ids", T.LongType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("lengths", T.ArrayType(T.IntegerType())),
    T.StructField("blocks", T.ArrayType(T.ArrayType(T.BinaryType()))),
])
ARROW = pa.schema([
    ("shard", pa.int32()), ("chunk", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
    ("lengths", pa.list_(pa.int32())), ("blocks", pa.list_(pa.list_(pa.binary()))),
])


def to_planes(ids: np.ndarray, level: int = 3) -> list[bytes]:
    """The compressed byte planes of one block of unsigned 32-bit ids."""
    planes = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return [zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(p).tobytes()) for p in planes]


def from_planes(planes: list[bytes]) -> np.ndarray:
    """Inverse of :func:`to_planes`."""
    cols = [np.frombuffer(zstandard.ZstdDecompressor().decompress(p), np.uint8) for p in planes]
    return np.ascontiguousarray(np.stack(cols, axis=1)).view("<u4").ravel()


def cut_blocks(ids: np.ndarray, block_ids: int) -> list[list[bytes]]:
    return [to_planes(ids[k : k + block_ids]) for k in range(0, len(ids), block_ids)]


#: What a vocabulary's own file must say for words to be taken apart here: lower case, and pieces of letters, single digits
#: or other characters. Fixed value: the pattern as the file has it.
PIECES = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
TAIL = ".,;:!?#*$%&|<>\"()-"


def _plain(tok) -> bool:
    """Whether the tokenizer normalises to lower case and splits by PIECES, then maps bytes."""
    rules = json.loads(tok.to_str())
    normal = [n["type"] for n in (rules["normalizer"] or {}).get("normalizers", [])]
    split = (rules["pre_tokenizer"] or {}).get("pretokenizers", [])
    return normal == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in split] == ["Split", "ByteLevel"] and split[0]["pattern"] == {"Regex": PIECES} and not split[1]["use_regex"]


@functools.cache
def word_encoder(path: str, cache: int = CACHE) -> Callable[[str], bytes]:
    """Text -> ids as little-endian 32-bit integers, by the tokenizers library. Special-token strings in a text are ordinary text.

    A tokenizer of the plain kind (:func:`_plain`) drops white space, so no token spans a space and each stretch between spaces is
    encoded once per worker and remembered, up to ``cache`` of them: a stretch of Latin-1 characters is taken apart by the tokenizer's own pattern,
    and the library's model sees each distinct piece once (letters below U+0100 are stable under composition,
    and lower-casing them is the same everywhere); other stretches go through the whole tokenizer. Any other
    tokenizer gets every text whole.
    """
    import regex
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    model, mapped = tok.model, ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
    if not _plain(tok):
        return lambda text: np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    find = regex.compile(PIECES).findall
    known: dict[str, bytes] = {"": b""}
    pieces: dict[str, bytes] = {}

    def piece(p: str) -> bytes:
        got = pieces.get(p)
        if got is None:
            if len(pieces) > 2 * cache:
                pieces.clear()
            shown = p if p.isascii() and p.isprintable() else mapped(p)[0][0]
            got = pieces[p] = np.array([t.id for t in model.tokenize(shown)], "<u4").tobytes()
        return got

    def stretch(w: str) -> bytes | None:
        """Ids of a stretch by its pieces, or None if the whole tokenizer must see it."""
        if max(w) >= "\u0100":
            return None
        core = w.rstrip(TAIL)
        if core.isalpha():
            return piece(core.lower()) + (piece(w[len(core) :]) if len(core) < len(w) else b"")
        return b"".join(map(piece, find(w.lower())))

    def encode(text: str) -> bytes:
        words = text.replace("\n", " ").split(" ")
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            pass
        if len(known) > cache:
            known.clear()
            known[""] = b""
        rest = []
        for w in set(words):
            if w not in known:
                got = stretch(w)
                if got is None:
                    rest.append(w)
                else:
                    known[w] = got
        if rest:
            for w, e in zip(rest, tok.encode_batch_fast(rest, add_special_tokens=False), strict=True):
                known[w] = np.array(e.ids, "<u4").tobytes()
        return b"".join(map(known.__getitem__, words))

    return encode


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS, chunk_ids: int = CHUNK_IDS,
    shards: int | None = None,
) -> None:
    """Write the token files of ``docs`` (doc_id long, text string; more columns are ignored, whatever they are called) to ``path``.

    Null texts are empty: their document is the end id alone. Repeated doc_ids stay
    separate documents, next to each other, ordered by text; a null doc_id comes first. An empty table gives an
    empty container. One shuffle: texts are range-partitioned by doc_id into ``shards`` (by default as many as the input has
    partitions, or ``spark.sql.shuffle.partitions`` if that is more); a hot doc_id only
    fills one shard. Memory: a chunk, or one document if that is longer (some 30 bytes a byte of it).
    """
    spark = docs.sparkSession
    n = shards or max(docs.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = word_encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        shard, chunk = TaskContext.get().partitionId(), 0
        ids, parts, lengths, total = [], [], [], 0

        def flush() -> pa.RecordBatch:
            stream = np.frombuffer(b"".join(parts), "<u4")
            row = {"shard": shard, "chunk": chunk, "n_ids": len(stream), "doc_ids": list(ids), "lengths": list(lengths), "blocks": cut_blocks(stream, block_ids)}
            return pa.RecordBatch.from_pylist([row], schema=ARROW)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), text_array(batch.column(1)), strict=True):
                got = encode(text.as_py()) + end
                ids.append(doc)
                parts.append(got)
                lengths.append(len(got) // 4)
                total += len(got) // 4
                if total >= chunk_ids:
                    yield flush()
                    ids, parts, lengths, total, chunk = [], [], [], 0, chunk + 1
        if ids:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(chunks, CONTAINER).write.option("compression", "none").parquet(path)


def chunk_index(spark: SparkSession, path: str) -> DataFrame:
    """(shard, chunk, n_ids, start): every chunk's place and first id, from the files' small columns.

    Shard totals, one row a shard, meet on the driver to give each shard's first id.
    """
    from pyspark.sql import Window

    index = spark.read.schema(CONTAINER).parquet(path).select("shard", "chunk", "n_ids")
    at, firsts = 0, []
    for s, total in sorted(map(tuple, index.groupBy("shard").agg(F.sum("n_ids")).collect())):
        firsts.append((s, at))
        at += total
    first = spark.createDataFrame(firsts, "shard int, shard_start long")
    inside = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    # one row a shard: its size is bounded by the number of write tasks
    return index.withColumn("before", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(F.broadcast(first), "shard").select("shard", "chunk", "n_ids", (F.col("shard_start") + F.col("before")).alias("start"))


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document of the files, in file order: doc_id, start, n_tokens, ids_crc32 and, if asked, ids (array<long>)."""
    schema = "doc_id long, shard int, chunk int, inside long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                ids = np.concatenate([from_planes(b) for b in row["blocks"]])
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                spans = [ids[a:b] for a, b in zip(starts, ends, strict=True)]
                m = len(spans)
                cols = [
                    pa.array(row["doc_ids"], pa.int64()), pa.array([row["shard"]] * m, pa.int32()), pa.array([row["chunk"]] * m, pa.int32()),
                    pa.array(starts, pa.int64()), pa.array(row["lengths"], pa.int64()), pa.array([zlib.crc32(s.tobytes()) for s in spans], pa.int64()),
                ]
                names = ["doc_id", "shard", "chunk", "inside", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([s.tolist() for s in spans], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    box = spark.read.schema(CONTAINER).parquet(path).select("shard", "chunk", "doc_ids", "lengths", "blocks")
    read = box.mapInArrow(docs, schema)
    index = chunk_index(spark, path).select("shard", "chunk", "start")
    out = read.join(index, ["shard", "chunk"]).withColumn("start", F.col("start") + F.col("inside"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def token_files(docs: DataFrame, tokenizer: str, path: str | None = None, **options) -> DataFrame:
    """Write the files to ``path`` (by default a new shared folder) and read them back."""
    spark = docs.sparkSession
    path = path or new_folder(spark, "tokens")
    write_token_files(docs, path, tokenizer, **options)
    return read_token_files(spark, path)
