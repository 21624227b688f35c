"""Plain-text reports: ordered lines, printed or written."""

import os
import sys
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.functions.bytepaths import byte_order
from arbora.staging import discard, stage

# Fixed values: (side, heading) of each section of a comparison.
SECTIONS = {"all": ("a", "b"), "missing_a": ("b",), "missing_b": ("a",)}


def compare_report(diff: DataFrame, report: str = "all") -> DataFrame:
    """(section, line) rows, a heading with the count before the paths of each section. Empty sections are left
    out of `all` and keep their heading otherwise. Order by section, rank, line."""
    sides = F.array(*map(F.lit, SECTIONS[report]))
    counts = diff.groupBy("side").agg(F.count("*").alias("n"))
    wanted = diff.sparkSession.range(1).select(F.explode(sides).alias("side")).join(counts, "side", "left")
    wanted = wanted.withColumn("n", F.coalesce("n", F.lit(0)))
    if report == "all":
        wanted = wanted.filter("n > 0")
    head = wanted.select(
        F.col("side").alias("section"), F.lit(0).alias("rank"), F.format_string("Only in %s: %s", F.upper("side"), "n").alias("line")
    )
    return head.unionByName(diff.select(F.col("side").alias("section"), F.lit(1).alias("rank"), F.col("rel").alias("line")))


def check_target(path: str | None) -> None:
    """Fail before any work if a report can't be written there. The file itself is made afterwards, so a scan never lists it."""
    folder = os.path.dirname(os.path.abspath(path)) if path else None
    if folder and (os.path.isdir(path) or not os.access(folder, os.W_OK | os.X_OK)):
        raise SystemExit(f"can't write {path}")


def print_lines(lines: DataFrame, line: Column, by: list[Column | str]) -> None:
    """Print in order, a partition at a time; names come out as the bytes they are."""
    sys.stdout.flush()
    for row in lines.orderBy(*by).select(byte_order(line).alias("value")).toLocalIterator():
        sys.stdout.buffer.write(bytes(row[0]) + b"\n")
    sys.stdout.buffer.flush()


def write_file(lines: DataFrame, line: Column, by: list[Column | str], path: str) -> None:
    """One text file, replaced when whole, that tasks write side by side; no line passes the driver.

    Rows are sorted into ranges and staged with their lengths. A line starts where the lengths before it end: those within
    its range, and those of the ranges before. A task that runs again writes the same bytes to the same places. The file must lie
    where all executors can open it; those that can't find it fail.
    """
    path = os.path.abspath(path)
    rows = lines.select(byte_order(line).alias("value"), *(F.col(b).alias(f"_by{i}") if isinstance(b, str) else b.alias(f"_by{i}") for i, b in enumerate(by)))
    keys = [f"_by{i}" for i in range(len(by))]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns({"_part": F.spark_partition_id(), "_nth": F.monotonically_increasing_id()})
    parts = stage(ranged.select("value", "_part", "_nth"), "lines")
    length = (F.octet_length("value") + 1).cast("long")
    sums = parts.groupBy("_part").agg(F.sum(length).alias("_n"))  # a row for each range
    before = sums.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    total = sums.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    upto = F.sum(length).over(Window.partitionBy("_part").orderBy("_nth").rowsBetween(Window.unboundedPreceding, -1))
    placed = parts.withColumn("_upto", F.coalesce(upto, F.lit(0))).join(F.broadcast(before), "_part")
    placed = placed.select("value", (F.col("_before") + F.col("_upto")).alias("at"))
    near = f"{path}.arbora-{uuid.uuid4().hex}"
    with open(near, "wb") as f:
        f.truncate(total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = os.open(near, os.O_WRONLY)
        for b in batches:
            at, values = b.column("at").to_pylist(), b.column("value").to_pylist()
            start, run_ = 0, bytearray()
            for place, value in zip(at, values):
                if place != start + len(run_):
                    _put(out, run_, start)
                    start, run_ = place, bytearray()
                run_ += value + b"\n"
            _put(out, run_, start)
            yield pa.RecordBatch.from_arrays([pa.array([len(at)])], ["n"])
        os.fsync(out)
        os.close(out)

    try:
        placed.mapInArrow(run, "n long").agg(F.sum("n")).collect()
        os.replace(near, path)
    finally:
        if os.path.exists(near):
            os.unlink(near)
        discard(parts)


def _put(out: int, data: bytearray, at: int) -> None:
    done = 0
    while done < len(data):
        done += os.pwrite(out, memoryview(data)[done:], at + done)


def write_lines(lines: DataFrame, line: Column, by: list[Column | str], path: str | None = None) -> None:
    """Print, or write one file, in the order of `by`."""
    if path:
        write_file(lines, line, by, path)
    else:
        print_lines(lines, line, by)
