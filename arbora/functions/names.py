"""Which names are junk, and which directories hold caches."""

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from arbora.functions.bytepaths import escape
from arbora.functions.globs import glob_matcher, matches_glob

# These lists decide the results.
JUNK_PARTS = ("~$", ".tmp", ".~lock.", ".bak", "~WRL", "Thumbs.db", ".DS_Store")
CACHE_GLOBS = (
    "cache", "*cache*", "glcache", "inetcache", "webcache", "cacheddata", "npm-cache", "pip", "consentoptions", "webkit",
    "code cache", "gpucache", "bluestacks", "pypa", "squirreltemp", "go", "go-build", "vcpkg", "tempzxpsign*",
    "photoshop temp*", "adobetemp*", "bridgecache*",
)
NEVER_CACHE = ("package cache", "slstore")

_cache_glob = glob_matcher(CACHE_GLOBS)


def is_junk(name: Column) -> Column:
    """A junk part anywhere in the base name; case matters."""
    return reduce(or_, (F.contains(name, F.lit(p)) for p in JUNK_PARTS))


def is_cache_name(name: Column) -> Column:
    """The whole name, case-folded, names a cache directory and isn't protected."""
    low = F.lower(name)
    return ~low.isin(*NEVER_CACHE) & matches_glob(low, CACHE_GLOBS)


def names_cache(name: bytes) -> bool:
    """The same for a name met while walking."""
    low = escape(name).lower()
    return low not in NEVER_CACHE and _cache_glob(low)


def accepts(answer: str | None) -> bool:
    """Whether an answer to a prompt means yes; the end of input does not."""
    return answer is not None and answer.strip().lower() in ("y", "yes")
