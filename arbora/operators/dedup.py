"""Files of cleanup trees that a reference tree already holds."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.functions.bytepaths import byte_order
from arbora.functions.hashing import hash_matching
from arbora.functions.ordinals import global_ordinal
from arbora.operators.compare import same_size
from arbora.staging import stage

# The columns that must agree in each mode.
MODE_KEYS = {"path": ["rel"], "path+name": ["rel", "size"], "path+hash": ["rel", "hash"], "hash": ["hash"]}


def find_duplicates(reference: DataFrame, cleanup: DataFrame, mode: str = "hash", hasher=None) -> DataFrame:
    """reference_abs, abs, rel, root, size: one row for each cleanup file with a partner.

    The partner is the reference file of the smallest `abs` among those with the key, found by a map-side combined
    minimum, so the build side has one row a key however often it occurs. With a hasher (see functions/hashing.py), files are read whole
    only if one of equal size and ends is on the other side. Null keys match nothing. Copies inside
    the cleanup trees alone are kept. Cleanup files that are reference files (overlapping roots) are left out, and
    a file listed by two roots counts once.
    """
    if mode not in MODE_KEYS:
        raise ValueError(f"mode {mode!r} is not one of {tuple(MODE_KEYS)}")
    keys = MODE_KEYS[mode]
    ref, other = reference, cleanup
    if "hash" in keys and hasher is not None:
        files = [stage(d, "files") for d in (reference, cleanup)]
        ref, other = hash_matching(same_size(*files), same_size(*files[::-1]), hasher)
    best = ref.groupBy(*keys).agg(F.min("abs").alias("reference_abs"))
    files = other.join(reference.select("abs"), "abs", "left_anti").dropDuplicates(["abs"])
    return files.join(best, keys).select("reference_abs", "abs", "rel", "root", "size")


def group_duplicates(duplicates: DataFrame) -> DataFrame:
    """Adds group_id (1.. in the order of reference_abs); order by group_id, abs for print."""
    names = duplicates.select("reference_abs").distinct().withColumn("_bytes", byte_order(F.col("reference_abs")))
    return duplicates.join(global_ordinal(names, ["_bytes"], "group_id").drop("_bytes"), "reference_abs")


def nested_groups(duplicates: DataFrame) -> DataFrame:
    """One row for each reference file with its sorted cleanup paths. A group must fit one row; the flat form is
    the one that scales."""
    return duplicates.groupBy("reference_abs").agg(F.array_sort(F.collect_list("abs")).alias("cleanup"))


def duplicate_summary(duplicates: DataFrame) -> DataFrame:
    """Groups, files and bytes that can go."""
    return duplicates.agg(
        F.countDistinct("reference_abs").alias("n_groups"),
        F.count("*").alias("n_duplicates"),
        F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("bytes"),
    )
