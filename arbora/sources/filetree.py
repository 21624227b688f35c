"""Directory trees as a Spark data source.

Spark's own binaryFile source hides dotted names and empty files, follows links and never lists directories, so
trees are walked here. Links are listed as files and not followed. A directory that can't be listed has the size
UNLISTED, a file that can't be examined a null size; what is gone meanwhile is left out, and a missing root gives no rows.
Names need not be UTF-8: see functions/bytepaths.py for the text they have in columns. `raw_path` is the path itself.

`scan_tree` walks in rounds that spread over the cluster. The format FORMAT (call `register` first) reads the same rows lazily, a task for each
directory of the root; with the option pushdown, filters on depth, name and is_dir reach the walk.
"""

import json
import os
from collections.abc import Iterable, Iterator
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, LessThan, LessThanOrEqual, Not, StringContains

from arbora.functions.bytepaths import escape, unescape
from arbora.schema import FILE_ENTRY
from arbora.sources.walk import CACHES, Rules, entries_of, listed, walk

FORMAT, MOST_TASKS = "arbora-filetree", 4096


class Subtree(InputPartition):
    """One unit of walking: directories, with or without what lies below their own entries."""

    def __init__(self, dirs: list[tuple[bytes, bool]], deep: bool):
        super().__init__(None)
        self.dirs, self.deep = dirs, deep


def rules_of(options: dict) -> Rules:
    if not options.get("path"):
        raise ValueError("a root directory is needed")
    caches = options.get("caches", "")
    if caches not in CACHES:
        raise ValueError(f"caches {caches!r} is not one of {CACHES}")
    root = os.path.abspath(unescape(options["path"]))
    depth = int(options.get("maxdepth", options.get("maxDepth", 0)))
    return Rules(root, options.get("tree", ""), depth, tuple(json.loads(options.get("contains", "[]"))), dirs=not json.loads(options.get("contains", "[]")), caches=caches)


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.rules = rules_of(options)

    def partitions(self) -> list[Subtree]:
        """The root's own entries, and its directories dealt out to at most MOST_TASKS."""
        root = self.rules.start()
        if not root or not self.rules.opens(0, root[0][1]):
            return [Subtree(root, True)]
        below = [(e.path, self.rules.inside(e.name, root[0][1])) for e in entries_of(self.rules.root) or () if e.is_dir(follow_symlinks=False)]
        return [Subtree(root, False), *(Subtree(below[i::MOST_TASKS], True) for i in range(min(MOST_TASKS, len(below))))]

    def read(self, partition: Subtree) -> Iterator[tuple]:
        yield from listed(partition.dirs, self.rules, deep=partition.deep)


class PushedReader(TreeReader):
    """The same, steered by filters. Spark refuses it while spark.sql.python.filterPushdown.enabled is unset."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what spares opening directories or making rows. All are left to Spark too, which also knows how nulls compare."""
        for f in filters:
            yield f
            match f:
                case LessThanOrEqual(("depth",), n) if n > 0:
                    self._limit(n)
                case LessThan(("depth",), n) if n > 1:
                    self._limit(n - 1)
                case EqualTo(("depth",), n) if n > 0:
                    self._limit(n)
                case EqualTo(("is_dir",), only):
                    self.rules = replace(self.rules, files=self.rules.files and not only, dirs=self.rules.dirs and only)
                case Not(EqualTo(("is_dir",), never)):
                    self.rules = replace(self.rules, files=self.rules.files and never, dirs=self.rules.dirs and not never)
                case StringContains(("name",), part) if not self.rules.dirs and not self.rules.contains:
                    self.rules = replace(self.rules, contains=(part,))

    def _limit(self, depth: int) -> None:
        self.rules = replace(self.rules, max_depth=min(depth, self.rules.max_depth or depth))


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self):
        return FILE_ENTRY

    def reader(self, schema) -> TreeReader:
        options = dict(self.options)
        return (PushedReader if options.get("pushdown") == "true" else TreeReader)(options)


def register(spark: SparkSession) -> None:
    """Makes FORMAT known to the session."""
    spark.dataSource.register(FileTree)


def scan_tree(spark: SparkSession, root: str | bytes, tree: str = "", max_depth: int = 0, contains: tuple[str, ...] = (), caches: str = "") -> DataFrame:
    """Every file and directory of one tree, the root included, as FILE_ENTRY rows; walked now, in rounds.

    contains: only files whose base name holds one of these parts, and no directories. caches: only outermost cache directories
    down to max_depth and all below them (`sizes`), or these directories alone, which then stay closed (`paths`).
    """
    return walk(spark, rules_of({"path": root and escape(os.fsencode(root)), "tree": tree, "maxDepth": max_depth, "contains": json.dumps(contains), "caches": caches}))


def scan_trees(spark: SparkSession, roots: list[str], tree: str = "") -> DataFrame:
    """Several trees one after another; a file that lies in two of them is listed twice (see operators/overlap.py)."""
    return reduce(DataFrame.unionByName, (scan_tree(spark, r, tree) for r in roots))


def files_of(entries: DataFrame) -> DataFrame:
    """Files of known size."""
    return entries.filter("not is_dir and size is not null")
