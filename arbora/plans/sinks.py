"""Carrying out a plan, once, and telling how each row went.

Tasks may be tried again, or twice at a time. What a row stands for is noted in a ledger before it is done: a path that is gone
counts as done only if the ledger says that an attempt at this row of this plan met it before. Each attempt appends to a
file of its own in a folder that all executors see, and reads the others only when it misses a path. Outcomes are staged,
so of several attempts the one that Spark commits gives the row of the outcome.

Nothing is overwritten: a file is moved by linking it at its destination, which fails if that is taken.
"""

import errno
import os
import shutil
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions.bytepaths import unescape
from arbora.functions.paths import parent_path
from arbora.operators.rollup import directory_totals, enclosing
from arbora.staging import shared_dir, stage

RESULT = "action string, path string, ok boolean, error string"
SUBTREE = 10_000


class Ledger:
    """What one attempt at a partition of a plan is about to do, and what others at the same partition were."""

    def __init__(self, folder: str, partition: int):
        os.makedirs(folder, exist_ok=True)
        self.folder, self.start, self.own = folder, f"{partition:06d}-", f"{partition:06d}-{uuid.uuid4().hex}"
        self.out = os.open(os.path.join(folder, self.own), os.O_WRONLY | os.O_CREAT | os.O_APPEND)
        self.read: dict[str, int] = {}
        self.others: set[int] = set()

    def note(self, row: int) -> None:
        os.write(self.out, b"%d\n" % row)

    def noted_by_another(self, row: int) -> bool:
        for name in os.listdir(self.folder):
            if name.startswith(self.start) and name != self.own:
                with open(os.path.join(self.folder, name), "rb") as f:
                    f.seek(self.read.get(name, 0))
                    whole = f.read().rpartition(b"\n")[0] + b"\n"
                    self.read[name] = f.tell() if whole == b"\n" else self.read.get(name, 0) + len(whole)
                    self.others.update(map(int, whole.split()))
        return row in self.others

    def close(self) -> None:
        os.fsync(self.out)
        os.close(self.out)


def _gone(_, path, error) -> None:
    if not isinstance(error, FileNotFoundError):
        raise error


def _remove(path: bytes) -> None:
    """A file, or a directory with all it holds; what another attempt takes away meanwhile does no harm."""
    if os.path.isdir(path) and not os.path.islink(path):
        shutil.rmtree(path, onexc=_gone)
    else:
        os.unlink(path)


def _move(path: bytes, dest: bytes) -> None:
    """To dest, which must be free or already be the same file (moved there, but not yet gone here)."""
    os.makedirs(os.path.dirname(dest), exist_ok=True)
    try:
        os.link(path, dest, follow_symlinks=False)
    except FileExistsError:
        if not (os.path.lexists(path) and os.path.samestat(os.lstat(path), os.lstat(dest))):
            os.lstat(path)
            raise OSError(errno.EEXIST, "the destination is taken", dest) from None
    except OSError as e:
        if e.errno != errno.EXDEV:
            raise
        near = dest + b".arbora-" + uuid.uuid4().hex.encode()  # another file system: copy beside it, then link
        shutil.copy2(path, near, follow_symlinks=False)
        try:
            _move(near, dest)
        finally:
            if os.path.lexists(near):
                os.unlink(near)
    os.unlink(path)


def _act(action: str, path: bytes, dest: bytes | None) -> None:
    if action == "move":
        _move(path, dest)
    elif action == "rmdir":
        os.rmdir(path)
    elif action == "empty":
        for e in list(os.scandir(path)):
            try:
                _remove(e.path)
            except FileNotFoundError:
                pass
    elif action == "delete":
        _remove(path)
    else:
        raise OSError(f"unknown action {action}")


def carry_out(ledger: Ledger, row: int, action: str, path: bytes, dest: bytes | None, collides: bool) -> str | None:
    """Do one row; what went wrong, or nothing."""
    try:
        if collides:
            raise OSError(errno.EEXIST, "several files would get this name", dest)
        os.lstat(path)
        ledger.note(row)
        _act(action, path, dest)
    except FileNotFoundError as e:
        done = ledger.noted_by_another(row) and not os.path.lexists(path) and (action != "move" or os.path.lexists(dest))
        return None if done else str(e)
    except OSError as e:
        return str(e)
    return None


def ledger_folder(spark: SparkSession, ledger: str | None = None) -> str:
    """A new folder below `ledger`, or below the shared folder where that is a mounted one."""
    if ledger is None:
        where = urlparse(shared_dir(spark))
        if where.scheme not in ("", "file"):
            raise RuntimeError(f"name a ledger folder that all executors can open: {where.geturl()} isn't mounted")
        ledger = unquote(where.path)
    return os.path.join(ledger, "arbora-ledger", uuid.uuid4().hex)


def _run(ordered: DataFrame, folder: str) -> DataFrame:
    """The outcome of rows (_row, action, path, dest, collides), each partition in its order; staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ledger = Ledger(folder, TaskContext.get().partitionId())
        for b in batches:
            rows = b.to_pylist()
            errors = [carry_out(ledger, r["_row"], r["action"], unescape(r["path"]), r["dest"] and unescape(r["dest"]), r["collides"]) for r in rows]
            ok = pa.array([e is None for e in errors])
            yield pa.RecordBatch.from_arrays([b.column("action"), b.column("path"), ok, pa.array(errors, pa.string())], ["action", "path", "ok", "error"])
        ledger.close()

    out = stage(ordered.mapInArrow(run, RESULT), "outcome")
    shutil.rmtree(folder, ignore_errors=True)
    return out


def apply_plan(plan: DataFrame, confirm: bool = False, workers: int = 8, ledger: str | None = None) -> DataFrame:
    """Do what the plan says; (action, path, ok, error) for each row.

    Without confirm nothing happens and an error is raised. The plan is staged first, so that it can't change while files go, and
    the outcome is staged, so that reading it twice doesn't act twice. A path that wasn't there is an error.
    """
    if not confirm:
        raise PermissionError("the plan has not been confirmed")
    folder = ledger_folder(plan.sparkSession, ledger)
    frozen = stage(plan.withColumn("_row", F.monotonically_increasing_id()), "plan")
    return _run(frozen.select("_row", "action", "path", "dest", "collides").repartition(workers, "_row"), folder)


def remove_dirs(dirs: DataFrame, confirm: bool = False, ledger: str | None = None, subtree: int = SUBTREE) -> DataFrame:
    """rmdir rows (path, depth), children first; a parent whose child stays also stays.

    Subtrees of at most `subtree` of these directories are each one task's, deepest first; then come the directories above them,
    of which there are few unless the tree is a chain. Two jobs, however deep it is.
    """
    if not confirm:
        raise PermissionError("the plan has not been confirmed")
    spark = dirs.sparkSession
    doomed = stage(dirs.select("path", "depth").distinct().withColumn("_row", F.monotonically_increasing_id()), "dirs")
    entries = doomed.select(F.lit("").alias("tree"), F.lit("").alias("root"), F.col("path").alias("rel"), F.lit(False).alias("is_dir"), F.lit(1).cast("long").alias("size"))
    below = directory_totals(entries).select(F.col("dir").alias("path"), "n_files")  # each counts as a file of its parent
    sized = doomed.join(below, "path", "left").withColumn("n", F.coalesce("n_files", F.lit(0)) + 1).drop("n_files")
    above = sized.select(F.col("path").alias("_parent"), F.col("n").alias("_n"))
    sized = stage(sized.join(above, parent_path(F.col("path")) == F.col("_parent"), "left"), "sized")
    heads = sized.filter((F.col("n") <= subtree) & (F.col("_n").isNull() | (F.col("_n") > subtree))).select("path")
    grouped = stage(sized.join(enclosing(sized.filter(F.col("n") <= subtree).select("path"), heads).select("path", F.col("inner").alias("head")), "path", "left"), "grouped")
    row = lambda df: df.select("_row", F.lit("rmdir").alias("action"), "path", F.lit(None).cast("string").alias("dest"), F.lit(False).alias("collides"), "depth", "head")
    done = []
    for some, parts in ((row(grouped.filter("head is not null")), None), (row(grouped.filter("head is null")), 1)):
        dealt = some.repartition("head") if parts is None else some.coalesce(1)
        done.append(_run(dealt.sortWithinPartitions(F.desc("depth")).drop("depth", "head"), ledger_folder(spark, ledger)))
    return done[0].unionByName(done[1])


def failures(outcome: DataFrame) -> DataFrame:
    """Operations and failures by action."""
    return outcome.groupBy("action").agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("n_failed"))
