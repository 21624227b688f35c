"""Plans: tables that say what would be done. Nothing here touches a file."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.functions.paths import base_name

# action: delete, move, empty (a directory's contents) or rmdir (if empty).
PLAN = "group_id bigint, action string, path string, dest string, collides boolean"


def plan_duplicates(grouped: DataFrame, move_to: str = "") -> DataFrame:
    """Delete each duplicate, or move it to the flat folder move_to.

    Moves keep the base name only, so two files may meet at one destination: `collides` marks them, and the sink
    refuses them. Destinations are counted with a map-side combine, not in a window.
    """
    if not move_to:
        none = F.lit(None).cast("string")
        return grouped.select(
            "group_id", F.lit("delete").alias("action"), F.col("abs").alias("path"), none.alias("dest"), F.lit(False).alias("collides")
        )
    dest = F.concat_ws("/", F.lit(move_to.rstrip("/")), base_name(F.col("abs")))
    moves = grouped.select("group_id", F.lit("move").alias("action"), F.col("abs").alias("path"), dest.alias("dest"))
    met = moves.groupBy("dest").agg((F.count("*") > 1).alias("collides"))
    return moves.join(met, "dest").select("group_id", "action", "path", "dest", "collides")


def plan_paths(paths: DataFrame, action: str) -> DataFrame:
    """One action for each path: junk files (delete), caches (delete or empty), empty directories (rmdir)."""
    none = F.lit(None)
    return paths.select(
        none.cast("bigint").alias("group_id"),
        F.lit(action).alias("action"),
        "path",
        none.cast("string").alias("dest"),
        F.lit(False).alias("collides"),
    )
