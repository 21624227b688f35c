"""Content hashes: SHA-256 as 64 lower-case hex digits, null for what can't be read.

Files are dealt to tasks by bytes. Before a file is read whole its ends are: files whose ends differ differ, so only those
whose length and ends another file shares are read in full.
"""

import hashlib
import heapq
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.staging import stage

CHUNK, END = 1 << 20, 1 << 16
OPEN_COST, LARGE = 1 << 14, 8


def content_hash(content: Column) -> Column:
    """Hash of a table's content. It runs in the scan, so that content itself is never shuffled."""
    return F.sha2(content.cast("binary"), 256)


def hash_file(path: bytes | str) -> str | None:
    """Hash of a file's bytes, read in chunks; null if it can't be read."""
    digest = hashlib.sha256()
    try:
        with open(path, "rb") as f:
            while block := f.read(CHUNK):
                digest.update(block)
    except OSError:
        return None
    return digest.hexdigest()


def probe_file(path: bytes | str) -> tuple[str | None, str | None]:
    """(hash of the length and both ends, hash of the whole if the ends are all of it)."""
    try:
        with open(path, "rb") as f:
            size = os.fstat(f.fileno()).st_size
            head = f.read(2 * END)
            if size > 2 * END:
                f.seek(size - END)
                return hashlib.sha256(b"%d " % size + head[:END] + f.read(END)).hexdigest(), None
            if f.read(1):  # it grows, or is no plain file
                return None, None
    except OSError:
        return None, None
    return hashlib.sha256(b"%d " % len(head) + head).hexdigest(), hashlib.sha256(head).hexdigest()


def n_tasks(files: DataFrame) -> int:
    spark = files.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def dealt_by_bytes(files: DataFrame, cost: Column, path: str = "raw_path", tasks: int | None = None) -> DataFrame:
    """files in `tasks` partitions of about equal sums of `cost`.

    Files that cost more than 1 / LARGE of a task's share, LARGE for each task at most, are given to the emptiest task in
    turn, the dearest first. The others fill up what room is left, along a running sum over buckets of hashed paths. One file is never split.
    """
    tasks = tasks or n_tasks(files)
    files = stage(files.withColumn("_cost", cost.cast("long")), "sizes")
    share = -(-files.agg(F.coalesce(F.sum("_cost"), F.lit(0))).first()[0] // tasks)
    large = files.filter(F.col("_cost") * LARGE > share).select(path, "_cost").distinct().collect()
    load = [(0, t) for t in range(tasks)]
    bins, loads = [], np.zeros(tasks, np.int64)
    for r in sorted(large, key=lambda r: (-r["_cost"], r[path])):
        held, t = heapq.heappop(load)
        heapq.heappush(load, (held + r["_cost"], t))
        loads[t] = held + r["_cost"]
        bins.append((r[path], t))
    room = np.cumsum(np.maximum(share - loads, 0))

    bucket = F.pmod(F.xxhash64(path), F.lit(tasks))
    small = files.filter(F.col("_cost") * LARGE <= share).withColumn("_bucket", bucket)
    sums = small.groupBy("_bucket").agg(F.sum("_cost").alias("_sum"))  # a row for each task
    before = sums.select("_bucket", (F.sum("_sum").over(Window.orderBy("_bucket")) - F.col("_sum")).alias("_before"))
    upto = F.sum("_cost").over(Window.partitionBy("_bucket").orderBy(path, "_cost").rowsBetween(Window.unboundedPreceding, -1))

    @F.pandas_udf("int")
    def task(at: pd.Series) -> pd.Series:
        return pd.Series(np.minimum(np.searchsorted(room, at.to_numpy(), "right"), tasks - 1).astype("int32"))

    at = small.withColumn("_upto", F.coalesce(upto, F.lit(0))).join(F.broadcast(before), "_bucket")
    dealt = at.withColumn("_task", task(F.col("_before") + F.col("_upto")))
    kept = [c for c in files.columns if c != "_cost"]
    out = dealt.select(*kept, "_task")
    if bins:
        own = F.broadcast(files.sparkSession.createDataFrame(bins, f"{path} {files.schema[path].dataType.simpleString()}, _task int"))
        out = out.unionByName(files.filter(F.col("_cost") * LARGE > share).join(own, path).select(*kept, "_task"))
    return out.repartitionById(tasks, "_task").drop("_task")


def _read(files: DataFrame, path: str, more: dict[str, T.DataType], reader: Callable, cost: Column) -> DataFrame:
    """files with the columns that reader gives for each path. mapInArrow is a barrier for the optimizer: no inferred filter moves the
    reading below a semi-join."""
    schema = T.StructType([*(f for f in files.schema if f.name not in more), *(T.StructField(n, t) for n, t in more.items())])
    keep = [f.name for f in schema if f.name not in more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [reader(p) if p else (None,) * len(more) for p in b.column(path).to_pylist()]
            columns = [pa.array([r[i] for r in found], pa.string()) for i in range(len(more))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *columns], schema.names)

    return dealt_by_bytes(files, cost, path).mapInArrow(run, schema)


def _size(files: DataFrame) -> Column:
    return F.coalesce(F.col("size"), F.lit(0)) if "size" in files.columns else F.lit(0)


def with_file_hash(files: DataFrame, path: str = "raw_path") -> DataFrame:
    """Add `hash` by reading each file where the task runs; prune rows before calling this."""
    return _read(files, path, {"hash": T.StringType()}, lambda p: (hash_file(p),), _size(files) + OPEN_COST)


def with_probe(files: DataFrame, path: str = "raw_path") -> DataFrame:
    """Add `probe`, equal for files of equal content and hardly ever else, and `hash` where reading the ends was reading all."""
    kinds = {"probe": T.StringType(), "hash": T.StringType()}
    return _read(files, path, kinds, probe_file, F.least(_size(files), F.lit(2 * END)) + OPEN_COST)


def hash_matching(mine: DataFrame, others: DataFrame, hasher: Callable[[DataFrame], DataFrame] = with_file_hash) -> tuple[DataFrame, DataFrame]:
    """Both with `hash`, which stays null where no file of the other side has the same ends: nothing there can be equal.

    Entries without raw_path aren't files; they are left to hasher as they are.
    """
    if "raw_path" not in mine.columns or "raw_path" not in others.columns:
        return hasher(mine), hasher(others)
    probed = [stage(with_probe(d), "probes") for d in (mine, others)]
    out = []
    for own, other in (probed, probed[::-1]):
        met = other.filter("probe is not null").select("probe").distinct()
        known = own.filter("hash is not null or probe is null")
        rest = own.filter("hash is null and probe is not null")
        unmet = rest.join(met, "probe", "left_anti")
        columns = [c for c in own.columns if c != "probe"]
        read = hasher(rest.join(met, "probe", "left_semi").drop("hash"))
        out.append(stage(known.unionByName(unmet).select(columns).unionByName(read.select(columns)), "hashes"))
    return out[0], out[1]
