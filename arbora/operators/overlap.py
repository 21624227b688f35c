"""Scan roots that lie in each other, are the same, or are links to the same place."""

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbora.operators.rollup import enclosing


def real_roots(roots: Iterable[str]) -> list[str]:
    """Each place once, by the path that links lead to, in the given order."""
    return list(dict.fromkeys(os.path.realpath(r) for r in roots if r))


def root_owners(roots: DataFrame) -> DataFrame:
    """(root, owner) of roots (root): the outermost root at or above each."""
    paths = roots.select(F.col("root").alias("path")).distinct()
    return enclosing(paths, paths).select(F.col("path").alias("root"), F.col("outer").alias("owner"))


def owned_once(entries: DataFrame) -> DataFrame:
    """Entries of several roots, each path kept once: under the outermost root that lists it (an inner one may reach deeper).

    Only entries of roots that overlap are shuffled.
    """
    owners = root_owners(entries.select("root").distinct())
    nested = owners.filter("root <> owner")
    shared = nested.select("root").unionByName(nested.select(F.col("owner").alias("root"))).distinct()
    alone = entries.join(shared, "root", "left_anti").dropDuplicates(["root", "rel"])
    first = F.row_number().over(Window.partitionBy("abs").orderBy(F.length("root"), "root", "rel"))
    once = entries.join(shared, "root", "left_semi").withColumn("_nth", first).filter("_nth = 1").drop("_nth")
    return alone.select(entries.columns).unionByName(once.select(entries.columns))
