"""Totals of every directory, and which directories lie in which, from paths sorted once.

In tree order (`/` before every other character) a directory is followed by all that lies below it, so a task that reads a range
of sorted paths closes each directory once, with its totals complete but for those that neighbouring ranges share: the
directories above a range's ends. Only these meet again in a sum. What is shuffled is a row for each path and about one for
each directory, however deep the tree is.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.functions.paths import ancestor_dirs, path_depth
from arbora.schema import UNLISTED
from arbora.staging import stage

TOTALS = "tree string, root string, dir string, n_files long, bytes long, n_lost long"
BATCH = 10_000


def tree_order(path: Column) -> Column:
    return F.replace(path, F.lit("/"), F.lit("\0"))


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _closed(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(tree, root, dir, files, bytes, lost) of (tree, root, rel, is_dir, size, counts) rows in tree order."""
    place, names, sums = None, [], []

    def close(depth: int) -> Iterator[tuple]:
        while len(sums) > depth:
            own = sums.pop()
            yield (*place, "/".join(names), *own)
            if names:
                names.pop()
                sums[-1] = [a + b for a, b in zip(sums[-1], own)]

    for tree, root, rel, is_dir, size, counts in rows:
        if (tree, root) != place:
            yield from close(0)
            place, names, sums = (tree, root), [], [[0, 0, 0]]
        dirs = rel.split("/") if rel else []
        if not is_dir:
            dirs.pop()
        same = 0
        while same < len(dirs) and same < len(names) and dirs[same] == names[same]:
            same += 1
        yield from close(same + 1)
        names += dirs[same:]
        sums += [[0, 0, 0] for _ in dirs[same:]]
        if is_dir:
            sums[-1][2] += size == UNLISTED
        elif counts:
            sums[-1][0] += 1
            sums[-1][1] += size or 0
            sums[-1][2] += size is None
    yield from close(0)


def directory_totals(entries: DataFrame, counts: Column | None = None) -> DataFrame:
    """TOTALS and depth of every directory listed or passed on the way to a file, the root ('') included: files below it, their bytes,
    and how many things below have no known size. counts: which files count; directories of others are still there."""
    schema = pa.schema([("tree", pa.string()), ("root", pa.string()), ("dir", pa.string()), ("n_files", pa.int64()), ("bytes", pa.int64()), ("n_lost", pa.int64())])
    rows = entries.select("tree", "root", "rel", "is_dir", F.col("size").cast("long").alias("size"), (F.lit(True) if counts is None else counts).alias("counts"))
    order = ["tree", "root", tree_order(F.col("rel"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(_closed(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), schema)

    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, TOTALS)
    sums = parts.groupBy("tree", "root", "dir").agg(*(F.sum(c).alias(c) for c in ("n_files", "bytes", "n_lost")))
    return sums.withColumn("depth", path_depth(F.col("dir")))


def _below(path: str, top: str) -> bool:
    return not top or path == top or path.startswith(top + "/")


def enclosing(items: DataFrame, containers: DataFrame) -> DataFrame:
    """items (path and more) with `outer` and `inner`: the outermost and the innermost of `containers` (path) at or above each path, or null.

    Both are sorted together, once. Containers that stand before a range and enclose its first path are found by that path's
    ancestors: a row for each range and level.
    """
    fields = [f for f in items.schema if f.name not in ("outer", "inner")]
    names = [f.name for f in fields]
    tops = containers.select("path").distinct()
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in fields if f.name != "path"]
    rows = items.select(*names, F.lit(False).alias("_top")).unionByName(tops.select("path", *none, F.lit(True).alias("_top")))
    order = [tree_order(F.rtrim(F.col("path"), F.lit("/"))), F.desc("_top")]
    extra = [("outer", pa.string()), ("inner", pa.string()), ("_first", pa.string()), ("_part", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[tuple[str, str]] = []
        first, part = None, TaskContext.get().partitionId()
        for b in batches:
            outer, inner, own = [], [], []
            for i, (path, top) in enumerate(zip(b.column("path").to_pylist(), b.column("_top").to_pylist())):
                first = path if first is None else first
                bare = path.rstrip("/")
                while open_ and not _below(bare, open_[-1][0]):
                    open_.pop()
                if top:
                    open_.append((bare, path))
                else:
                    own.append(i)
                    outer.append(open_[0][1] if open_ else None)
                    inner.append(open_[-1][1] if open_ else None)
            kept = b.take(pa.array(own, pa.int64()))
            more = [outer, inner, [first] * len(own), [part] * len(own)]
            yield pa.RecordBatch.from_arrays([*(kept.column(n) for n in names), *(pa.array(v, t) for v, (_, t) in zip(more, extra))], [*names, *(n for n, _ in extra)])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "outer string, inner string, _first string, _part int"])
    found = stage(rows.repartitionByRange(order[0]).sortWithinPartitions(*order).mapInArrow(run, schema), "enclosed")
    firsts = found.groupBy("_part").agg(F.min("_first").alias("_first"))
    bare = F.rtrim(F.col("_first"), F.lit("/"))
    above = firsts.select("_part", F.explode(F.concat(ancestor_dirs(bare), F.array(bare))).alias("_bare"))
    kept = above.join(tops.select(F.rtrim("path", F.lit("/")).alias("_bare"), F.col("path").alias("_top")), "_bare")
    before = kept.groupBy("_part").agg(F.array_sort(F.collect_list(F.struct(F.length("_bare").alias("n"), F.col("_bare").alias("bare"), F.col("_top").alias("top")))).alias("_before"))
    path = F.rtrim(F.col("path"), F.lit("/"))
    holds = lambda c: (c["bare"] == "") | (path == c["bare"]) | F.startswith(path, F.concat(c["bare"], F.lit("/")))
    found = found.join(F.broadcast(before), "_part", "left")  # a row for each range
    earlier = F.filter("_before", holds)
    outer = F.coalesce(F.get(earlier, F.lit(0))["top"], F.col("outer"))
    inner = F.coalesce("inner", F.try_element_at(earlier, F.lit(-1))["top"])
    return found.select(*names, outer.alias("outer"), inner.alias("inner"))
