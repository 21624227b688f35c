"""Walking trees breadth first, in rounds.

A directory is opened by whichever task has it. A task lists directories until it has met its budget of entries and hands
back those it has not opened; they are dealt out anew to as many tasks as they can keep busy. So the driver knows the root
only, a narrow way down costs nothing, and what lies below it spreads. Rounds are staged; a lost task lists its directories
again.

`Rules` say what is wanted, and what is never opened for it: directories at the depth limit, and, where only the paths of
outermost cache directories are asked for, those directories themselves.
"""

import os
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.functions.bytepaths import escape
from arbora.functions.names import names_cache
from arbora.schema import FILE_ENTRY, UNLISTED
from arbora.staging import stage

FIRST_BUDGET, BUDGET, EACH = 1_000, 50_000, 16
CACHES = ("", "paths", "sizes")
_LEFT = T.StructType([*(T.StructField(f.name, f.dataType) for f in FILE_ENTRY), T.StructField("left", T.BooleanType()), T.StructField("inside", T.BooleanType())])
_ARROW = pa.schema(
    [(n, pa.string()) for n in ("tree", "root", "rel", "abs", "name")]
    + [("is_dir", pa.bool_()), ("depth", pa.int32()), ("size", pa.int64()), ("raw_path", pa.binary()), ("left", pa.bool_()), ("inside", pa.bool_())]
)


@dataclass(frozen=True)
class Rules:
    """max_depth: the deepest entries listed (0: all). contains: only files whose name holds one of these. files, dirs: which rows are
    wanted. caches: only outermost cache directories and what lies below (`sizes`), or just they (`paths`)."""

    root: bytes
    tree: str = ""
    max_depth: int = 0
    contains: tuple[str, ...] = ()
    files: bool = True
    dirs: bool = True
    caches: str = ""

    def depth(self, path: bytes) -> int:
        return 0 if path == self.root else os.path.relpath(path, self.root).count(b"/") + 1

    def inside(self, name: bytes, above: bool) -> bool:
        return bool(self.caches) and (above or names_cache(name))

    def opens(self, depth: int, inside: bool) -> bool:
        if inside:
            return self.caches == "sizes"
        return not self.max_depth or depth < self.max_depth

    def row(self, path: bytes, is_dir: bool, size: int | None) -> tuple:
        rel = b"" if path == self.root else os.path.relpath(path, self.root)
        return (self.tree, escape(self.root), escape(rel), escape(path), escape(os.path.basename(path)), is_dir, rel.count(b"/") + 1 if rel else 0, size, path)

    def start(self) -> list[tuple[bytes, bool]]:
        return [(self.root, self.inside(os.path.basename(self.root), False))] if os.path.isdir(self.root) else []


def entries_of(path: bytes) -> list[os.DirEntry] | None:
    """Sorted entries; none of a directory that is gone, None if it can't be listed."""
    try:
        with os.scandir(path) as found:
            return sorted(found, key=lambda e: e.name)
    except FileNotFoundError:
        return []
    except OSError:
        return None


def listed(todo: Iterable[tuple[bytes, bool]], rules: Rules, budget: int = 0, deep: bool = True) -> Iterator[tuple]:
    """Rows of rules.row for (directory, lies in a cache) and what is below, then (directory, lies in a cache) pairs that are left once
    `budget` entries were met. Without `deep` directories below stay closed and have no rows."""
    queue, met = deque(todo), 0
    while queue:
        if budget and met >= budget:
            yield from queue
            return
        path, inside = queue.popleft()
        depth = rules.depth(path)
        opened = rules.opens(depth, inside)
        entries = entries_of(path) if opened else []
        linked_root = path == rules.root and os.path.islink(path)
        if rules.dirs and (inside or not rules.caches) and not linked_root:
            yield rules.row(path, True, UNLISTED if entries is None else None)
        for e in entries or ():
            met += 1
            if e.is_dir(follow_symlinks=False):
                within = rules.inside(e.name, inside)
                if not deep:
                    continue
                if rules.opens(depth + 1, within):
                    queue.append((e.path, within))
                elif rules.dirs and (within or not rules.caches):
                    yield rules.row(e.path, True, None)
            elif rules.files and (inside or not rules.caches) and (not rules.contains or any(c in escape(e.name) for c in rules.contains)):
                try:
                    size = e.stat(follow_symlinks=False).st_size
                except FileNotFoundError:
                    continue
                except OSError:
                    size = None
                yield rules.row(e.path, False, size)


def walk(spark: SparkSession, rules: Rules, budget: int = BUDGET) -> DataFrame:
    """FILE_ENTRY rows of a tree. Runs one job a round, and returns what they have staged."""

    def run_of(most: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            todo = [x for b in batches for x in zip(b.column("raw_path").to_pylist(), b.column("inside").to_pylist())]
            rows: list[tuple] = []
            for x in listed(todo, rules, most):
                rows.append((*x, False, None) if len(x) > 2 else (*rules.row(x[0], True, None), True, x[1]))
                if len(rows) == 10_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

        return run

    start, rounds = rules.start(), []
    todo = spark.createDataFrame(start, "raw_path binary, inside boolean").coalesce(1)
    n, most = len(start), min(FIRST_BUDGET, budget)
    while n:
        rounds.append(stage(todo.mapInArrow(run_of(most), _LEFT), "walk"))
        todo = rounds[-1].filter("left").select("raw_path", "inside")
        n, most = todo.count(), budget
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
        todo = todo.repartition(max(min(-(-n // EACH), tasks), 1), F.xxhash64("raw_path"))
    if not rounds:
        return spark.createDataFrame([], FILE_ENTRY)
    found = spark.read.schema(_LEFT).parquet(*(r._arbora_path for r in rounds)).filter("not left")
    return found.select([F.col(f.name) for f in FILE_ENTRY])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
