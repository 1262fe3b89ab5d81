"""Filter patterns: RE2 dialect to Java, compile errors on the driver, and required-literal prefilters.

Patterns are searched unanchored. Look-around and back-references do not exist in the dialect and are refused.

The JVM's engine backtracks, where the dialect's own takes time in proportion to the value: a pattern with repeats inside repeats, such as
``(a+)+$``, can take very long on a long value that almost matches. Required literals in front keep most rows from the pattern.
"""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

try:  # Python's own parse tree, which is no public interface: without it there are no literals, and patterns alone decide
    import re._constants as C
    import re._parser as parser
except ImportError:
    C = parser = None

# POSIX classes and what Java calls them.
POSIX = {"alpha": "Alpha", "digit": "Digit", "alnum": "Alnum", "upper": "Upper", "lower": "Lower", "space": "Space", "punct": "Punct", "print": "Print", "graph": "Graph", "cntrl": "Cntrl", "xdigit": "XDigit", "blank": "Blank", "ascii": "ASCII", "word": "Alnum}_\\p{M"}
#: Alternatives that a literal set may have, and the fewest characters of a literal.
MOST_LITERALS, LEAST_CHARS = 64, 2


class PatternError(ValueError):
    pass


def to_java(pattern: str) -> str:
    """The pattern for RLIKE. ``$`` without the m flag means the very end, ``.`` excludes only a line feed."""
    if re.search(r"\(\?(?:=|!|<=|<!|>)", pattern) or re.search(r"(?<!\\)(?:\\\\)*\\[1-9]", pattern):
        raise PatternError(f"look-around and back-references are not supported: {pattern!r}")
    multi = bool(re.match(r"\(\?[a-zA-Z]*m", pattern))
    out, k, in_class = [], 0, False
    while k < len(pattern):
        c = pattern[k]
        if c == "\\" and k + 1 < len(pattern):
            nxt = pattern[k + 1]
            out.append(r"\z" if nxt == "z" else pattern[k : k + 2])
            k += 2
            continue
        if in_class:
            if m := re.match(r"\[:(\^?)(\w+):\]", pattern[k:]):
                if m[2] not in POSIX:
                    raise PatternError(f"invalid character class: {m[0]}")
                out.append(rf"\{'P' if m[1] else 'p'}{{{POSIX[m[2]]}}}")
                k += len(m[0])
                continue
            if c == "]":
                in_class = False
            out.append("\\[" if c == "[" else "\\&" if c == "&" else c)
        elif c == "[":
            in_class = True
            out.append(c)
            if m := re.match(r"\[(\^?)(\]?)", pattern[k:]):
                out.append(m[1] + ("\\]" if m[2] else ""))
                k += len(m[0])
                continue
        elif pattern.startswith("(?P<", k):
            out.append("(?<")
            k += 4
            continue
        elif c == "$" and not multi:
            out.append(r"\z")
        else:
            out.append(c)
        k += 1
    java = re.sub(r"\(\?([a-z]*)i([a-z]*)([:)])", lambda m: f"(?{m[1]}i{m[2]}{'' if 'u' in m[1] + m[2] else 'u'}{m[3]}", "".join(out))
    java = re.sub(r"\(\?([a-zA-Z]*)U([a-zA-Z]*)\)", lambda m: f"(?{m[1]}{m[2]})", java)
    return "(?d)" + java


def check(pattern: str) -> str:
    """The Java pattern, or PatternError if the pattern does not compile."""
    java = to_java(pattern)
    try:
        re.compile(_python(pattern))
    except (re.error, OverflowError) as e:
        raise PatternError(f"error parsing regexp {pattern!r}: {e}") from e
    return java


def _python(pattern: str) -> str:
    """A form that Python's parser reads, for checks and literals only."""
    p = re.sub(r"\[:\^?\w+:\]", "a-z", pattern).replace(r"\z", r"\Z")
    p = re.sub(r"\\[pP](?:\{\^?\w+\}|\w)", r"\\w", p)
    head = re.match(r"((?:\(\?[a-zA-Z]+\))*)(.*)", p, re.S)
    return re.sub(r"U", "", head[1]) + re.sub(r"\(\?([a-z]+)\)", "", head[2])


def required_literals(pattern: str) -> tuple[list[str], bool] | None:
    """(literals, exact): every match holds one of the literals; exact if holding one is also enough.

    None where nothing useful is required; then the pattern alone decides. Case-insensitive patterns give none.
    """
    if parser is None:
        return None
    try:
        tree = parser.parse(_python(pattern))
    except (re.error, OverflowError):
        return None
    if tree.state.flags & re.I or re.search(r"\(\?[a-z]*i", pattern):
        return None
    got = _literals(list(tree))
    if not got:
        return None
    words, exact = got
    words = list(dict.fromkeys(words))
    if not words or min(map(len, words)) < LEAST_CHARS or len(words) > MOST_LITERALS:
        return None
    return words, exact


def _literals(nodes: list) -> tuple[list[str], bool] | None:
    """Literal set of a concatenation: the run of exact parts with the longest least literal."""
    best: tuple[list[str], bool] | None = None
    run: list[str] | None = None
    whole = True

    def close(best: tuple | None, run: list[str] | None, exact: bool) -> tuple | None:
        if run and min(map(len, run)) > 0 and (best is None or min(map(len, run)) > min(map(len, best[0]))):
            return run, exact
        return best

    for node in nodes:
        part = _part(node)
        if part and part[1]:
            joined = [a + b for a, b in product(run or [""], part[0])]
            if len(joined) <= MOST_LITERALS:
                run = joined
                continue
            best, run, whole = close(best, run, False), part[0], False
            continue
        best, run, whole = close(best, run, False), None, False
        if part:
            best = close(best, part[0], False)
    best = close(best, run, whole)
    return (best[0], whole and best[1]) if best else None


def _part(node: tuple) -> tuple[list[str], bool] | None:
    op, arg = node
    if op is C.LITERAL:
        return [chr(arg)], True
    if op is C.SUBPATTERN:
        return _literals(list(arg[3])) if not arg[1] and not arg[2] else None
    if op is C.BRANCH:
        parts = [_literals(list(b)) for b in arg[1]]
        if any(p is None for p in parts):
            return None
        return [w for p in parts for w in p[0]], all(p[1] for p in parts)
    if op is C.IN and len(arg) <= 4 and all(k is C.LITERAL for k, _ in arg):
        return [chr(v) for _, v in arg], True
    if op is C.MAX_REPEAT and arg[0] >= 1:
        got = _literals(list(arg[2]))
        return (got[0], got[1] and arg[0] == arg[1] == 1) if got else None
    return None


def gate(value: Column, pattern: str | None) -> Column:
    """Whether the value passes: no pattern lets all pass; an empty value matches no pattern.

    A pattern that is a set of plain strings becomes ``contains``; otherwise required literals stand before
    the pattern, as they are cheaper and never change the result.
    """
    if not pattern:
        return F.lit(True)
    java = check(pattern)
    got = required_literals(pattern)
    held = F.lit(True)
    if got:
        held = F.lit(False)
        for w in got[0]:
            held = held | F.contains(value, F.lit(w))
        if got[1]:
            return (value != "") & held
    return (value != "") & held & value.rlike(java)
