"""CIDR and pattern list files: one entry a line, whole-line # comments."""

from __future__ import annotations

from ..functions.ip import parse_cidr


class ListError(ValueError):
    pass


def read_patterns(path: str) -> list[str]:
    """Entries of a list file, trimmed, without blank and comment lines. Lists are configuration: they are read on the driver."""
    with open(path, encoding="utf-8") as f:
        return [t for line in f if (t := line.strip()) and not t.startswith("#")]


def read_cidrs(path: str) -> list[str]:
    """As :func:`read_patterns`; every entry must be a CIDR range, or ListError names the line. Bare addresses and
    comments behind an entry are errors."""
    out = []
    with open(path, encoding="utf-8") as f:
        for number, line in enumerate(f, 1):
            text = line.strip()
            if not text or text.startswith("#"):
                continue
            try:
                parse_cidr(text)
            except ValueError as e:
                raise ListError(f"{path}, line {number}: invalid CIDR {text!r}: {e}") from e
            out.append(text)
    return out
