"""Globs of file names as one regular expression that Spark and Python read alike.

`*` is any run of characters and `?` any one, neither of them `/`; `[a-c]`, `[^a-c]` one of a class or none of it; a backslash
takes the next character as it is. The whole name must match. A range whose ends are the wrong way round holds nothing. An open
or empty class, a bare `-` or `]` where a class has to have a character, and a backslash at the end are errors.
"""

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

ANY, NOTHING = r"[\s\S]", r"[^\s\S]"


def _literal(c: str) -> str:
    """c in or outside of a class."""
    if c.isalnum() or not c.isascii():
        return c
    return f"\\x{ord(c):02x}" if c < " " or c == "\x7f" else "\\" + c


def _class(glob: str, i: int) -> tuple[str, int]:
    """The class that opens before i, and where it ends."""

    def one(i: int) -> tuple[str, int]:
        if i < len(glob) and glob[i] not in "-]":
            i += glob[i] == "\\"
            if i < len(glob):
                return glob[i], i + 1
        raise ValueError(f"{glob!r} has a bad class")

    negated = glob[i : i + 1] == "^"
    i += negated
    ranges, n = "", 0
    while n == 0 or glob[i : i + 1] != "]":
        low, i = one(i)
        high = low
        if glob[i : i + 1] == "-":
            high, i = one(i + 1)
        ranges += f"{_literal(low)}-{_literal(high)}" if low <= high else ""
        n += 1
    if ranges:
        return f"[{'^' * negated}{ranges}]", i + 1
    return (ANY if negated else NOTHING), i + 1


def glob_regex(globs: str | Iterable[str]) -> str:
    """An expression that matches a name if one of the globs does."""
    out = []
    for glob in [globs] if isinstance(globs, str) else globs:
        parts, i = "", 0
        while i < len(glob):
            c, i = glob[i], i + 1
            if c == "*":
                parts += "" if parts.endswith("[^/]*") else "[^/]*"
            elif c == "?":
                parts += "[^/]"
            elif c == "[":
                found, i = _class(glob, i)
                parts += found
            else:
                if c == "\\":
                    if i == len(glob):
                        raise ValueError(f"{glob!r} ends in a backslash")
                    c, i = glob[i], i + 1
                parts += _literal(c)
        out.append(parts)
    return f"^(?:{'|'.join(out)})(?!{ANY})" if out else NOTHING


def matches_glob(name: Column, globs: str | Iterable[str]) -> Column:
    return F.rlike(name, F.lit(glob_regex(globs)))


def glob_matcher(globs: str | Iterable[str]) -> Callable[[str], bool]:
    """The same test in Python, for use while walking."""
    found = re.compile(glob_regex(globs))
    return lambda name: found.search(name) is not None
