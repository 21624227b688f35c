"""Two trees against each other: by path, by path then content, or by content alone."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.functions.hashing import hash_matching
from arbora.staging import stage

MODES = ("off", "smart", "strict")
REPORTS = ("all", "missing_a", "missing_b")


def _hashed(files: DataFrame, hasher: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """files with `hash`: already there (hashed in the scan of a table), or by reading the files."""
    if hasher is not None:
        return hasher(files)
    if "hash" not in files.columns:
        raise ValueError("a hash column or a hasher is needed")
    return files


def same_size(files: DataFrame, others: DataFrame) -> DataFrame:
    """Files of some size that others have too: the only ones whose content can be equal."""
    return files.join(others.select("size").distinct(), "size", "left_semi")


def only_in(a: DataFrame, b: DataFrame, mode: str = "off", hasher=None) -> DataFrame:
    """Rows of a without a partner in b.

    off: no equal `rel` in b (sizes aren't compared). smart: of those, the ones whose content no file of b has;
    all of b's files of a fitting size count. strict: no file of b has the content, whatever the paths. A null hash
    matches nothing, so such rows are reported. Multiplicity is ignored: one copy in b answers for all in a.
    """
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is not one of {MODES}")
    left = a if mode == "strict" else a.join(b.select("rel"), "rel", "left_anti")
    if mode == "off":
        return left
    alone = left.join(b.select("size").distinct(), "size", "left_anti")
    hashes = _hashed(same_size(b, left), hasher).select("hash").distinct()
    rest = _hashed(same_size(left, b), hasher).join(hashes, "hash", "left_anti")
    return alone.select(a.columns).unionByName(rest.select(a.columns))


def hashed_once(a: DataFrame, b: DataFrame, mode: str, hasher) -> tuple[DataFrame, DataFrame]:
    """Both sides listed once and staged, with `hash` where only content can decide: each such file is read once, whichever
    directions are asked for, and whole only if its ends are those of a file of the other side. Elsewhere the hash is null,
    which matches nothing."""
    sides = [stage(d, "files") for d in (a, b)]
    wanted = []
    for mine, other in (sides, sides[::-1]):
        needed = same_size(mine, other)
        if mode == "smart":  # either has no partner by path, or may be the content of one that hasn't
            alone = mine.join(other.select("rel"), "rel", "left_anti")
            others_alone = other.join(mine.select("rel"), "rel", "left_anti")
            needed = same_size(alone, other).unionByName(same_size(mine, others_alone)).dropDuplicates(["abs"])
        wanted.append(needed)
    out = []
    for mine, hashed in zip(sides, hash_matching(*wanted, hasher)):
        own = [c for c in mine.columns if c != "hash"]
        out.append(mine.select(own).join(hashed.select("abs", "hash"), "abs", "left").select(*own, "hash"))
    return out[0], out[1]


def compare_trees(a: DataFrame, b: DataFrame, mode: str = "off", report: str = "all", hasher=None) -> DataFrame:
    """(side, rel): 'a' for what only a has, 'b' for what only b has.

    The report missing_a lists what a lacks (only b has it), missing_b what b lacks. Order by side, rel for print.
    """
    if report not in REPORTS:
        raise ValueError(f"report {report!r} is not one of {REPORTS}")
    if mode != "off" and hasher is not None:
        (a, b), hasher = hashed_once(a, b, mode, hasher), None
    sides = {"a": (a, b), "b": (b, a)}
    wanted = {"all": "ab", "missing_a": "b", "missing_b": "a"}[report]
    parts = [only_in(*sides[s], mode, hasher).select(F.lit(s).alias("side"), "rel") for s in wanted]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def size_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Equal paths whose sizes differ."""
    right = b.select("rel", F.col("size").alias("size_b"))
    both = a.select("rel", F.col("size").alias("size_a")).join(right, "rel")
    return both.filter("size_a <> size_b")


def compare_summary(a: DataFrame, b: DataFrame, mode: str, hasher=None) -> DataFrame:
    """One row: files in each tree, and files that only one of them has."""
    one = lambda d, n: d.agg(F.count("*").alias(n))
    diff = compare_trees(a, b, mode, "all", hasher).agg(
        F.count_if(F.col("side") == "a").alias("only_a"), F.count_if(F.col("side") == "b").alias("only_b")
    )
    rows = [one(a, "n_a"), one(b, "n_b"), diff]
    keyed = [r.withColumn("_k", F.lit(1)) for r in rows]
    return keyed[0].join(keyed[1], "_k").join(keyed[2], "_k").select(F.lit(mode).alias("mode"), "n_a", "n_b", "only_a", "only_b")


def shared_sizes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sizes that occur in both trees."""
    return a.select("size").intersect(b.select("size"))


def size_groups(files: DataFrame) -> DataFrame:
    """Files by tree and size: count, first and last path. One size may hold most files, so no lists."""
    return files.groupBy("tree", "size").agg(
        F.count("*").alias("n_files"), F.min("rel").alias("first_rel"), F.max("rel").alias("last_rel")
    )


def hash_set(files: DataFrame) -> DataFrame:
    """Distinct known hashes."""
    return files.select("hash").filter("hash is not null").distinct()


def tree_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("tree").agg(F.count("*").alias("n_files"))
