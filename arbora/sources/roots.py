"""Where caches usually live: scan roots with a depth limit (0: none)."""

import os
import sys
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values: (variable or folder, path below it, depth limit).
ROOTS = {
    "windows": (
        ("LOCALAPPDATA", "", 1),
        ("WINDIR", "Temp", 0),
        ("LOCALAPPDATA", "pip/Cache", 0),
        ("LOCALAPPDATA", "npm-cache", 0),
        ("LOCALAPPDATA", "JetBrains", 0),
        ("LOCALAPPDATA", "Microsoft/Teams/Cache", 0),
        ("LOCALAPPDATA", "Google/Chrome/User Data", 0),
        ("LOCALAPPDATA", "Microsoft/Edge/User Data", 0),
        ("APPDATA", "Code/Cache", 0),
        ("APPDATA", "Adobe", 0),
    ),
    "darwin": (("/Library/Caches/Adobe", "", 0), ("HOME", "Library/Caches", 0)),
    "linux": (("/tmp", "", 0), ("/var/tmp", "", 0), ("HOME", ".cache", 0)),
}


def cache_roots(system: str | None = None, env: Mapping[str, str] | None = None) -> list[tuple[str, int]]:
    """(root, depth limit) of a system. Roots whose variable is unset are left out: never a relative path."""
    system = system or {"win32": "windows"}.get(sys.platform, sys.platform)
    env = os.environ if env is None else env
    found = []
    for base, below, depth in ROOTS.get(system, ()):
        top = base if base.startswith("/") else env.get(base, "")
        if top:
            found.append(("/".join(x for x in (top.replace("\\", "/").rstrip("/"), below) if x), depth))
    return found


def usable_roots(roots: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Those that are directories now (links are followed here)."""
    return [(r, d) for r, d in roots if r and os.path.isdir(r)]


def roots_of_homes(homes: DataFrame, system: str) -> DataFrame:
    """(root, max_depth) of every home directory (home) of a system whose roots need no other variable; each root once."""
    fixed = cache_roots(system, {})
    own = [(r, d) for r, d in cache_roots(system, {"HOME": "~"}) if r.startswith("~/")]
    root = F.array(
        *(F.struct(F.lit(r).alias("root"), F.lit(d).alias("max_depth")) for r, d in fixed if r.startswith("/")),
        *(F.struct(F.concat(F.col("home"), F.lit(r[1:])).alias("root"), F.lit(d).alias("max_depth")) for r, d in own),
    )
    return homes.select(F.inline(root)).distinct()
