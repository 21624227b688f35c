"""Path columns. Paths use `/`; `rel` never starts or ends with it."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def join_path(root: Column, rel: Column) -> Column:
    """root/rel; the root itself where rel is empty."""
    return F.when(rel == "", root).otherwise(F.concat_ws("/", F.rtrim(root, F.lit("/")), rel))


def relative_path(path: Column, root: Column) -> Column:
    """The part of path below root ('' for the root)."""
    base = F.length(F.rtrim(root, F.lit("/")))
    return F.substring(path, base + 2, F.length(path))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_path(path: Column) -> Column:
    """'' for a path of one segment."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/")


def path_depth(rel: Column) -> Column:
    """Segments below the root; 0 for the root itself."""
    return F.when(rel == "", 0).otherwise(F.size(F.split(rel, "/")))


def ancestor_dirs(rel: Column) -> Column:
    """Every directory above rel, the root ('') first."""
    parts = F.split(rel, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def outermost_match(segments: Column, matches, max_depth: Column | int = 0) -> Column:
    """Joined path of the shortest leading run of segments whose last one matches; null if none does.

    Only each segment's own name decides, so the outermost match needs neither recursion nor a self-join. A
    segment that fails to match never stops the search below it. max_depth 0 means any depth.
    """
    limit = F.lit(max_depth) if isinstance(max_depth, int) else max_depth
    at = F.array_min(
        F.filter(
            F.sequence(F.lit(1), F.size(segments)),
            lambda i: matches(F.get(segments, i - 1)) & ((limit == 0) | (i <= limit)),
        )
    )
    return F.when(F.size(segments) > 0, F.array_join(F.slice(segments, F.lit(1), at), "/"))
