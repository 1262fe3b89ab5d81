"""Operator 10. Secret scan: fixed patterns, and password guess cost for values in credential context.

The guess cost of a value is the least sum, over all segmentations, of the log10 guesses
of its segments plus a charge for each segment. A segment is a dictionary word, a date,
a repeat, a keyboard or alphabet walk, or brute force; the minimum is found by dynamic
programming over start positions, last to first. A value after a credential key whose cost reaches
``GUESS_MIN`` is a secret, if it has ``GUESS_CHARS`` characters; no other condition holds. Single words of prose
stay cheap, as the dictionary holds a tokenizer's whole words; several words in one value can reach the limit.
"""

from __future__ import annotations

import functools
import hashlib
import json
import math
import re
from array import array
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, text_array

#: Kinds in the order that breaks ties of start.
KINDS = ("assign", "access", "hex", "guess")
#: Least log10 guesses of a secret, and least characters.
GUESS_MIN, GUESS_CHARS = 10.0, 8

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
CONTEXT = re.compile(r"""(?:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|credentials?)["']?\x20*(?:=>|:=|:|=|\x20is\x20)\x20*""", re.I | re.A)
#: What follows a context: a quoted value, spaces included, or one that ends at a space or mark.
VALUE = re.compile(r""""([^"\r\n]+)"|'([^'\r\n]+)'|["']?([^\s"',;]+)""")
#: A text with none of these holds no assignment and no credential context.
HINTS = ("passw", "passphrase", "pwd", "secret", "token", "api", "key", "auth", "credential")

# Everyday words, most frequent first, then the whole words of a tokenizer in its order; a word's guesses are its place.
WORDS = """password admin the and for that with this you not are from have was user login secret token test key
hello welcome master dragon monkey letmein qwerty abc sunshine princess football shadow change changeme default
example sample guest root temp demo none null true false value your here pass my name home work love life time
year day man world good new first last long great little own other old right big high different small large next
early young important few public bad same able api auth access private server client data file system service
account email phone number address code string text word line page site web net com org www http https""".split()


@functools.cache
def word_ranks(vocabulary: str | None = None) -> tuple[dict[str, int], int]:
    """(rank of each dictionary word, length of the longest). ``vocabulary`` is the path of a word-end BPE tokenizer file, by default that of
    the public ``word_bpe_49k.json``; its words of four ASCII letters or more follow ``WORDS`` in the file's order, some 30,000."""
    with open(vocabulary or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        ids = json.load(f)["model"]["vocab"]
    found = (p.removesuffix("</w>") for p in sorted(ids, key=ids.__getitem__) if p.endswith("</w>"))
    more = [w for w in found if len(w) >= 4 and w.isascii() and w.isalpha()]
    rank = {w: k + 1 for k, w in enumerate(dict.fromkeys(WORDS + more))}
    return rank, max(map(len, rank))


def lowered(text: str) -> str:
    """Lower case, but for letters whose lower case has another length, so that places stay."""
    out = text.lower()
    return out if len(out) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


LEET = str.maketrans("430157$@!", "aeoistsai")
# Rows of a keyboard, and the orders that walks follow.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
_NEXT = {(a, b) for row in ROWS for a, b in zip(row, row[1:], strict=False)} | {(a, b) for up, down in zip(ROWS[:3], ROWS[1:4], strict=False) for a, b in zip(up[1:] if up[0] == "`" else up, down, strict=False)}
WALKS = _NEXT | {(b, a) for a, b in _NEXT}
DATE = re.compile(r"(?:(?:19|20)\d\d)(?:([-/._]?)(?:0[1-9]|1[0-2])(?:\1(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d")
#: Repeated units and least characters of a run; unit 0 is a walk.
RUNS = ((0, 3), (1, 3), (2, 4), (3, 6), (4, 8))
#: log10 of what a guesser pays for each further segment.
PER_SEGMENT = math.log10(4)


def _brute(c: str) -> float:
    """log10 of the class that a brute-force guesser must try for this character."""
    return 1.0 if c.isdigit() else math.log10(26) if c.isascii() and c.isalpha() else math.log10(33)


def guess_costs(value: str, vocabulary: str | None = None) -> array:
    """For each position of ``value``, its end included, log10 of the guesses for the rest by the cheapest segmentation.

    Every part of a run (a walk, or a unit repeated) is a segment. Of two ends of parts in one run, a whole number of units apart, the nearer one loses
    its lead the longer the parts grow, so an end that is no better when it first can be used is dropped: few are left, and a value of
    n characters takes about O(n) steps and 8 bytes each.
    """
    ranks, longest = word_ranks(vocabulary)
    n = len(value)
    low = lowered(value)
    plain = low.translate(LEET)
    best = array("d", bytes(8 * (n + 1)))
    limit = dict.fromkeys((unit for unit, _ in RUNS), n)
    ends: dict[int, list[list[int]]] = {unit: [[] for _ in range(unit or 1)] for unit, _ in RUNS}
    free = math.inf  # of a brute-force span that begins here and the rest behind it
    for i in range(n - 1, -1, -1):
        cost = free = _brute(value[i]) + min(free, best[i + 1])
        for size in range(2, min(longest, n - i) + 1):
            word = low[i : i + size]
            rank = ranks.get(word)
            extra = 0.0
            if rank is None and (rank := ranks.get(plain[i : i + size])) is not None:
                extra = 0.5
            if rank is not None:
                case = 0.0 if value[i : i + size] == word else 0.5
                cost = min(cost, best[i + size] + math.log10(rank) + extra + case)
        if value[i].isdigit():
            for j in range(i + 4, min(n, i + 10) + 1):
                if DATE.fullmatch(value, i, j):
                    cost = min(cost, best[j] + math.log10(36500))
        for unit, least in RUNS:
            step = unit or 1
            if i + step < n and not (value[i] == value[i + unit] if unit else (low[i], low[i + 1]) in WALKS):
                limit[unit] = i + step
                ends[unit] = [[] for _ in range(step)]
            if i + least > limit[unit]:
                continue
            first = sum(map(_brute, value[i : i + unit])) if unit else math.log10(94)
            least_run = math.inf
            for group, some in enumerate(ends[unit]):
                runs = min((best[j] + math.log10((j - i) // step) for j in some), default=math.inf)
                if group == (i + least) % step and (new := best[i + least] + math.log10(least // step)) < runs:
                    some.append(i + least)
                    runs = new
                least_run = min(least_run, runs)
            cost = min(cost, first + least_run)
        best[i] = cost + PER_SEGMENT
    return best


def guess_cost(value: str, vocabulary: str | None = None) -> float:
    """log10 of the guesses for ``value`` by the cheapest segmentation; 0 for an empty value."""
    return guess_costs(value, vocabulary)[0]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the fixed patterns: whole matches, leftmost and non-overlapping for each kind; failing matches go."""
    found = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    return found


def guess_spans(text: str, vocabulary: str | None = None) -> list[tuple[int, int, str]]:
    """Values in credential context whose guess cost makes them secrets. A value may hold a further context, whose own value
    is looked at too, unless a secret found before covers where it begins and it ends there. Values with one end share their costs."""
    found = []
    covered = at = end = 0
    costs = array("d")
    for c in CONTEXT.finditer(text):
        start = c.end()
        if start < covered and text[start] not in "\"'":
            continue
        if not at <= start < end:
            if not (m := VALUE.match(text, start)):
                continue
            g = m.lastindex
            value = m[g].rstrip(".,;:!?)") if g == 3 else m[g]
            start = m.start(g)
            costs = guess_costs(value, vocabulary)
            first, stop = start, start + len(value)
            if g == 3:
                at, end = first, stop
        else:
            first, stop = at, end
        if stop > covered and stop - start >= GUESS_CHARS and costs[start - first] >= GUESS_MIN:
            found.append((start, stop, "guess"))
            covered = stop
    return found


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def all_spans(text: str, vocabulary: str | None = None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base, added) spans of a text."""
    low = text.lower()
    if any(h in low for h in HINTS):
        return base_spans(text), guess_spans(text, vocabulary)
    found = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    return found, []


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """The text with every covered stretch replaced by ``mark``; overlapping spans are one stretch."""
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join(out) + text[at:]


def scan(docs: DataFrame, masked: bool = False, vocabulary: str | None = None) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, n_guess long, base_sha256 and spans strings, and
    with ``masked`` the text with its secrets replaced.

    Null texts are empty and have no spans; null doc_ids and repeated rows pass through row by row; other
    columns are ignored; an empty table gives no rows. Map-only. Positions are code points, ends exclusive. ``vocabulary`` is a
    path that every worker can open (:func:`word_ranks`). A value in credential context costs time in proportion to its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            texts = text_array(piece.column(1)).to_pylist()
            found = [all_spans(t, vocabulary) for t in texts]
            base = [b for b, _ in found]
            counts = [pa.array([sum(s[2] == kind for s in b) for b in base], pa.int64()) for kind in KINDS[:3]]
            digests = [hashlib.sha256(joined(b).encode()).hexdigest() for b in base]
            cols = [piece.column(0), *counts, pa.array([len(g) for _, g in found], pa.int64()), pa.array(digests, pa.string()), pa.array([joined(b + g) for b, g in found], pa.string())]
            names = ["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"]
            if masked:
                cols.append(pa.array([redact(t, b + g) if b or g else t for t, (b, g) in zip(texts, found, strict=True)], pa.string()))
                names.append("masked")
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string" + (", masked string" if masked else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def mask_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The table with the secrets of its ``text`` replaced; null texts stay null. A column ``n_chars`` follows the text where it changes; all other columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            new = {"text": piece.column(piece.schema.get_field_index("text")).to_pylist()}
            hits = [(row, base + added) for row, t in enumerate(new["text"]) if t for base, added in [all_spans(t, vocabulary)] if base or added]
            if "n_chars" in piece.schema.names:
                new["n_chars"] = piece.column(piece.schema.get_field_index("n_chars")).to_pylist()
            for row, spans in hits:
                new["text"][row] = redact(new["text"][row], spans)
                if "n_chars" in new:
                    new["n_chars"][row] = len(new["text"][row])
            yield pa.RecordBatch.from_arrays([pa.array(new[f.name], f.type) if hits and f.name in new else c for f, c in zip(piece.schema, piece.columns, strict=True)], names=piece.schema.names)

    return docs.mapInArrow(run, docs.schema)
