"""Directories that hold nothing, or nothing any more."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.operators.rollup import directory_totals


def directories(entries: DataFrame) -> DataFrame:
    """(tree, root, dir) of listed directories and of every directory above a file, the root ('') included."""
    return directory_totals(entries).select("tree", "root", "dir")


def empty_dirs(entries: DataFrame, removed: DataFrame | None = None, keep_root: bool = False) -> DataFrame:
    """(tree, root, dir, depth): directories below which no entry but directories survives.

    removed: rows (tree, root, rel) of files that go; without a root column a path goes from every root. One pass over the sorted
    entries counts what survives below each directory; links and special files are files here. The root itself is among them
    unless keep_root. Remove in descending depth.
    """
    survives = None
    if removed is not None:
        key = [c for c in ("tree", "root", "rel") if c in removed.columns]
        entries = entries.join(removed.select(key).distinct().withColumn("_gone", F.lit(True)), key, "left")
        survives = F.col("_gone").isNull()
    out = directory_totals(entries, survives).filter("n_files = 0").select("tree", "root", "dir", "depth")
    return out.filter("dir <> ''") if keep_root else out
