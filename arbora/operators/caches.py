"""Outermost cache directories and the space they hold."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.functions.names import is_cache_name
from arbora.functions.paths import base_name, join_path, outermost_match
from arbora.functions.sizes import human_size
from arbora.operators.rollup import enclosing
from arbora.schema import UNLISTED


def _segments() -> Column:
    """Directory names on the way to the entry, without a file's own name."""
    parts = F.filter(F.split("rel", "/"), lambda s: s != "")
    return F.when(F.col("is_dir"), parts).otherwise(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))))


def cache_match(entries: DataFrame, max_depth: Column | int = 0) -> DataFrame:
    """Adds `match`: rel of the outermost cache directory at or above the entry, '' if the root itself is one,
    null if there is none."""
    inner = outermost_match(_segments(), is_cache_name, max_depth)
    return entries.withColumn("match", F.when(is_cache_name(base_name(F.col("root"))), F.lit("")).otherwise(inner))


def cache_sizes(entries: DataFrame, max_depth: Column | int = 0) -> DataFrame:
    """(root, match, path, size, n_files): each outermost cache directory with the bytes below it, in one pass.

    A directory without files has 0 bytes. If a size below it is unknown (a file without one, or a directory that can't be
    listed) its total is null.
    Overlapping roots are not merged.
    """
    found = cache_match(entries, max_depth).filter("match is not null")
    sizes = found.groupBy("root", "match").agg(
        F.coalesce(F.sum(F.when(~F.col("is_dir"), F.col("size"))), F.lit(0)).cast("bigint").alias("_sum"),
        F.count_if(~F.col("is_dir")).alias("n_files"),
        F.count_if(F.when(F.col("is_dir"), F.col("size").eqNullSafe(UNLISTED)).otherwise(F.col("size").isNull())).alias("_lost"),
    )
    size = F.when(F.col("_lost") == 0, F.col("_sum"))
    return sizes.select("root", "match", join_path(F.col("root"), F.col("match")).alias("path"), size.alias("size"), "n_files")


def find_cache_dirs(entries: DataFrame, max_depth: Column | int = 0, distinct_targets: bool = False) -> DataFrame:
    """Paths of the outermost cache directories; distinct_targets drops those listed by two roots or lying below
    another target."""
    targets = cache_sizes(entries, max_depth).select("path")
    if not distinct_targets:
        return targets
    once = targets.distinct()
    return enclosing(once, once).filter("path = outer").select("path")


def cache_total(sizes: DataFrame) -> DataFrame:
    """Targets, bytes of those with known sizes, and the bytes for people."""
    total = sizes.agg(F.count("*").alias("n_targets"), F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("bytes"))
    return total.withColumn("text", human_size(F.col("bytes")))
