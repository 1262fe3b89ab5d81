"""Operator 9. Byte-level BPE through a sentencepiece model written directly from the vocabulary.

Every byte is mapped to one character; a vocabulary entry becomes a piece of such
characters, scored by its negative rank, so sentencepiece's best-score merge is the
lowest-rank merge. The model is serialised here field by field, with identity
normalisation; nothing is trained. Pre-tokens are encoded one by one, and decoding maps
ids back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, text_array

#: Distinct pre-tokens whose ids one worker remembers.
CACHE = 400_000
#: White space as Unicode defines it: what ``\\s`` means to the rank files' own library.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: lines of base64 token, space, rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def byte_chars() -> list[str]:
    """One private-use character for each byte."""
    return [chr(0xE000 + b) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value: bytes | str | int | float | bool) -> bytes:
    """One protocol-buffer field: varint, 32-bit float or length-delimited."""
    if isinstance(value, (bool, int)):
        return _varint(number << 3) + _varint(int(value))
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    raw = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(raw)) + raw


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """The serialised model. Piece ids are the ranks' places; the unknown piece is last."""
    chars = byte_chars()
    out = bytearray()
    for rank, token in sorted((r, t) for t, r in ranks.items()):
        piece = "".join(chars[b] for b in token)
        out += _field(1, _field(1, piece) + _field(2, -float(rank)) + _field(3, 1))
    out += _field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(ranks) + 1) + _field(24, False) + _field(40, len(ranks)) + _field(41, -1 & (1 << 64) - 1) + _field(42, -1 & (1 << 64) - 1) + _field(43, -1 & (1 << 64) - 1)
    normal = _field(1, "identity") + _field(3, False) + _field(4, False) + _field(5, False)
    return bytes(out) + _field(2, trainer) + _field(3, normal)


class Codec:
    """Encoder and decoder over one rank file, for one worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = CACHE):
        import regex
        import sentencepiece

        self.ranks, self.cache = ranks, cache
        self.find = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"(?!\S)", f"(?![^{WHITE}])").replace(r"\s", f"[{WHITE}]")).findall
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(ranks))
        order = sorted((r, t) for t, r in ranks.items())
        self.rank_of = np.array([r for r, _ in order], "<u4")
        self.token_of = {r: t for r, t in order}
        self.table = [self.token_of.get(r, b"") for r in range(order[-1][0] + 1)] if order else []
        self.map = {k: c for k, c in enumerate(byte_chars())}
        self.known: dict[str, bytes] = {}

    def pretoken(self, raw: bytes) -> bytes:
        """Ids of one pre-token. A pre-token that is an entry itself is that id, whether or not merges reach it."""
        whole = self.ranks.get(raw)
        if whole is not None:
            return struct.pack("<I", whole)
        return self.rank_of[self.sp.encode(raw.decode("latin-1").translate(self.map), out_type=int)].tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text, as little-endian 32-bit integers."""
        words = self.find(text)
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            pass
        if len(self.known) > self.cache:
            self.known.clear()
        for w in dict.fromkeys(words):
            if w not in self.known:
                self.known[w] = self.pretoken(w.encode())
        return b"".join(map(self.known.__getitem__, words))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def codec_source(spark: SparkSession, path: str) -> Callable[[], dict[bytes, int]]:
    """Ranks for workers: the file's entries are broadcast, a size fixed by the vocabulary."""
    ranks = spark.sparkContext.broadcast(read_ranks(path))
    return lambda: ranks.value


_codecs: dict[tuple[int, str], Codec] = {}


def encode_decode(docs: DataFrame, path: str, pattern: str, keep: bool = False) -> DataFrame:
    """Encode and decode every whole text. Returns doc_id, n_tokens long, ids_sha256 and
    decoded_sha256 strings, and with ``keep`` also ids (binary, little-endian 32-bit) and decoded (binary).

    Null texts are empty texts (no ids); null doc_ids and repeated rows pass through row by
    row; other columns are ignored; an empty table gives no rows. Map-only, one pass; a
    worker's memory holds the vocabulary, ``CACHE`` pre-tokens and one megabyte of text or one text.
    """
    source = codec_source(docs.sparkSession, path)
    key = (hash(path), pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _codecs:
            _codecs[key] = Codec(source(), pattern)
        codec = _codecs[key]
        for piece in pieces(batches):
            ids = [codec.encode(t) for t in text_array(piece.column(1)).to_pylist()]
            back = [codec.decode(x) for x in ids]
            cols = [piece.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), *(pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string()) for xs in (ids, back))]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep:
                cols += [pa.array(ids, pa.binary()), pa.array(back, pa.binary())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded binary" if keep else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
