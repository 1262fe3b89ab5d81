"""Lumberjack v2 receiver: events of log shippers become JSON files that a file stream reads.

The receiver acknowledges a window only when its events are on disk, in a file that appears in one step; so a crash loses nothing
that was acknowledged, and Spark's file source replays what it had not committed. The spool folder must be one that the
receiver's machine, the driver and all executors see under the same path (a shared mount); :func:`stream` checks that on a cluster.
"""

from __future__ import annotations

import json
import os
import socket
import socketserver
import struct
import threading
import uuid
import zlib
from collections.abc import Iterable
from datetime import datetime, timezone
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "message string"


class ProtocolError(ValueError):
    pass


def read_frames(read) -> list[tuple[int, dict]]:
    """(sequence, event) of one window; ``read(n)`` gives exactly n bytes or raises EOFError."""
    if (head := read(2)) != b"2W":
        raise ProtocolError(f"expected a window frame, got {head!r}")
    size = struct.unpack(">I", read(4))[0]
    out: list[tuple[int, dict]] = []
    while len(out) < size:
        out += _frame(read)
    return out


def _frame(read) -> list[tuple[int, dict]]:
    head = read(2)
    if head == b"2J":
        seq, size = struct.unpack(">II", read(8))
        return [(seq, json.loads(read(size)))]
    if head == b"2C":
        raw = zlib.decompress(read(struct.unpack(">I", read(4))[0]))
        at, out = 0, []

        def inner(n: int) -> bytes:
            nonlocal at
            at += n
            if at > len(raw):
                raise EOFError
            return raw[at - n : at]

        while at < len(raw):
            out += _frame(inner)
        return out
    raise ProtocolError(f"unknown frame {head!r}")


class Receiver:
    """A TCP server that spools what it gets to ``folder``. Counters: batches, events, last_batch."""

    def __init__(self, listen: str, folder: str, timeout: float = 5.0):
        host, _, port = listen.rpartition(":")
        os.makedirs(folder, exist_ok=True)
        self.folder = folder
        self.batches = self.events = 0
        self.last_batch: datetime | None = None
        self.closed = False
        outer, lock = self, threading.Lock()

        class Handler(socketserver.StreamRequestHandler):
            def read(self, n: int) -> bytes:
                got = self.rfile.read(n)
                if len(got) < n:
                    raise EOFError
                return got

            def handle(self) -> None:
                try:
                    while True:
                        frames = read_frames(self.read)
                        with lock:
                            outer._spool(folder, [e for _, e in frames])
                        if frames:
                            self.wfile.write(b"2A" + struct.pack(">I", frames[-1][0]))
                except (EOFError, ProtocolError, OSError, ValueError):
                    return

        class Server(socketserver.ThreadingTCPServer):
            allow_reuse_address, daemon_threads = True, True

        self._tcp = Server((host or "0.0.0.0", int(port)), Handler)
        self.address = self._tcp.server_address
        self.timeout = timeout
        threading.Thread(target=self._tcp.serve_forever, daemon=True).start()

    def _spool(self, folder: str, events: list[dict]) -> None:
        name = f"{self.batches:012d}-{uuid.uuid4().hex}.json"
        with open(os.path.join(folder, "." + name), "w", encoding="utf-8") as f:
            for e in events:
                f.write(json.dumps({"message": e["message"]} if isinstance(e.get("message"), str) else {}) + "\n")
            f.flush()
            os.fsync(f.fileno())
        os.replace(os.path.join(folder, "." + name), os.path.join(folder, name))
        self.batches += 1
        self.events += len(events)
        self.last_batch = datetime.now(timezone.utc)

    def spooled(self) -> int:
        """How many files were ever spooled to the folder: a loop that knows how many it has read knows the depth of the queue."""
        with os.scandir(self.folder) as found:
            return sum(f.name.endswith(".json") and not f.name.startswith(".") for f in found)

    def close(self) -> None:
        self.closed = True
        self._tcp.shutdown()
        self._tcp.server_close()


def ship(address: tuple[str, int], events: Iterable[dict], window: int = 1000) -> None:
    """Send events to a receiver, window by window, each acknowledged before the next: a shipper."""
    with socket.create_connection(address, timeout=60) as s, s.makefile("rb") as replies:
        rest = iter(events)
        while some := list(islice(rest, window)):
            raw = [json.dumps(e).encode() for e in some]
            frames = b"".join(b"2J" + struct.pack(">II", k, len(x)) + x for k, x in enumerate(raw, 1))
            s.sendall(b"2W" + struct.pack(">I", len(raw)) + frames)
            if replies.read(6) != b"2A" + struct.pack(">I", len(raw)):
                raise ProtocolError("the window was not acknowledged")


def stream(spark: SparkSession, folder: str) -> DataFrame:
    """The spooled events as a streaming table (message, file); events without a text message have a null there."""
    if not spark.sparkContext.master.startswith("local["):
        check_shared(spark, folder)
    return spark.readStream.schema(EVENT).json(folder).select("message", F.col("_metadata.file_path").alias("file"))


def check_shared(spark: SparkSession, folder: str) -> None:
    """An executor must read what the driver writes to the folder; OSError if not."""
    probe = os.path.join(folder, f".probe-{uuid.uuid4().hex}")
    with open(probe, "w", encoding="utf-8") as f:
        f.write("seen")

    def see(_: int) -> bool:
        return os.path.exists(probe)

    try:
        if not all(spark.sparkContext.parallelize(range(64), 64).map(see).collect()):
            raise OSError(f"executors don't see {folder}: the spool must be on a shared mount")
    finally:
        os.unlink(probe)
