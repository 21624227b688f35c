"""Arbora: file-catalogue analytics as lazy Spark queries."""

from arbora.operators.caches import find_cache_dirs, cache_sizes, cache_total
from arbora.operators.compare import compare_trees, only_in
from arbora.operators.dedup import find_duplicates, group_duplicates
from arbora.operators.emptydirs import empty_dirs
from arbora.operators.junk import find_junk
from arbora.sources.filetree import scan_tree, scan_trees

__all__ = [
    "cache_sizes",
    "cache_total",
    "compare_trees",
    "empty_dirs",
    "find_cache_dirs",
    "find_duplicates",
    "find_junk",
    "group_duplicates",
    "only_in",
    "scan_tree",
    "scan_trees",
]
