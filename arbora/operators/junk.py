"""Temporary and junk files by name."""

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.functions.globs import matches_glob
from arbora.functions.names import JUNK_PARTS, is_junk


def find_junk(entries: DataFrame) -> DataFrame:
    """Files (never directories) whose base name holds a junk part. A plain filter, also over streams."""
    return entries.filter(~F.col("is_dir") & is_junk(F.col("name")))


def find_named(entries: DataFrame, globs: str | Iterable[str], fold: bool = False) -> DataFrame:
    """Files whose whole base name one of the globs matches (see functions/globs.py); fold: names in lower case. Also over streams."""
    name = F.lower("name") if fold else F.col("name")
    return entries.filter(~F.col("is_dir") & matches_glob(name, globs))


def junk_by_part(entries: DataFrame) -> DataFrame:
    """Files and bytes for each junk part; a name with two parts counts under both, a part without files as 0."""
    files = entries.filter(~F.col("is_dir"))
    hits = lambda p: F.contains("name", F.lit(p))
    sums = [F.count_if(hits(p)).alias(f"n{i}") for i, p in enumerate(JUNK_PARTS)]
    sums += [F.coalesce(F.sum(F.when(hits(p), F.col("size"))), F.lit(0)).alias(f"b{i}") for i, p in enumerate(JUNK_PARTS)]
    rows = F.array(
        *(
            F.struct(F.lit(p).alias("part"), F.col(f"n{i}").alias("n_files"), F.col(f"b{i}").cast("bigint").alias("bytes"))
            for i, p in enumerate(JUNK_PARTS)
        )
    )
    return files.agg(*sums).select(F.inline(rows))
