"""Command line: compare, dedup, junk, caches."""

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from arbora.functions.bytepaths import byte_order
from arbora.functions.hashing import with_file_hash
from arbora.functions.names import JUNK_PARTS, accepts
from arbora.functions.sizes import human_size
from arbora.operators import caches, compare, dedup, emptydirs, junk
from arbora.operators.overlap import owned_once, real_roots
from arbora.operators.rollup import enclosing
from arbora.plans.actions import plan_duplicates, plan_paths
from arbora.plans.sinks import apply_plan, failures, remove_dirs
from arbora.report import check_target, compare_report, write_lines
from arbora.sources.filetree import files_of, scan_tree, scan_trees
from arbora.sources.roots import cache_roots, usable_roots
from arbora.staging import stage

VERSION = "0.1.0"


def _asked(question: str) -> bool:
    print(question, end=" ", flush=True)
    return accepts(sys.stdin.readline() or None)


def _compare(spark, args) -> None:
    check_target(args.out)
    mode = args.hash_mode or ("smart" if args.hash else "off")
    a, b = files_of(scan_tree(spark, args.a, "a")), files_of(scan_tree(spark, args.b, "b"))
    diff = stage(compare.compare_trees(a, b, mode, args.mode, with_file_hash), "diff")
    write_lines(compare_report(diff, args.mode), F.col("line"), ["section", "rank", byte_order(F.col("line"))], args.out)


def _dedup(spark, args) -> None:
    check_target(args.out)
    # by the paths that links lead to, so that a file of the reference is known however a cleanup root reaches it
    reference = files_of(scan_tree(spark, next(iter(real_roots([args.reference])), ""), "reference"))
    entries = owned_once(scan_trees(spark, real_roots(args.cleanup) or [""], "cleanup"))
    if args.mode == "path":
        print("Warning: equal paths are taken for equal files; contents aren't compared.")
    found = dedup.group_duplicates(dedup.find_duplicates(reference, files_of(entries), args.mode, with_file_hash))
    plan = stage(plan_duplicates(found, args.move_to or ""), "plan")
    write_lines(plan, F.concat_ws(" ", "action", "path", "dest"), ["group_id", byte_order(F.col("path"))], args.out)
    n = plan.count()
    if not n or not _asked(f"{'Move' if args.move_to else 'Delete'} {n} files? [y/N]"):
        return
    entries = stage(entries, "entries")
    outcome = apply_plan(plan, confirm=True)
    if failed := outcome.filter("not ok").count():
        raise SystemExit(f"{failed} operations failed")
    if not args.keep_empty_dirs:
        gone = outcome.select(F.col("path").alias("abs")).join(entries, "abs").select("tree", "root", "rel")
        empty = emptydirs.empty_dirs(entries, gone)
        path = F.when(F.col("dir") == "", F.col("root")).otherwise(F.concat_ws("/", "root", "dir"))
        print(f"{remove_dirs(empty.select(path.alias('path'), 'depth'), confirm=True).filter('ok').count()} directories removed")


def _junk(spark, args) -> None:
    check_target(args.out)
    found = stage(junk.find_junk(scan_tree(spark, args.dir, contains=JUNK_PARTS)).select(F.col("abs").alias("path")), "junk")
    write_lines(found, F.col("path"), [byte_order(F.col("path"))], args.out)
    n = found.count()
    if n and _asked(f"Delete {n} files? [y/N]"):
        failures(apply_plan(plan_paths(found, "delete"), confirm=True, workers=args.workers or 8)).show()


def _caches(spark, args) -> None:
    parts = [caches.cache_sizes(scan_tree(spark, r, max_depth=d, caches="sizes"), d) for r, d in usable_roots(cache_roots())]
    if not parts:
        return print("No scan roots.")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = stage(found, "caches")
    text = F.coalesce(human_size(F.col("size")), F.lit("size unknown"))
    write_lines(found, F.concat_ws("  ", "path", text), [byte_order(F.col("path"))])
    print("Total:", caches.cache_total(found).first()["text"])
    action = "empty" if args.empty else "delete"
    if args.force and _asked(f"{action} these directories? [y/N]"):
        # of targets in one another the outermost alone: to empty or delete it does the same to the others
        targets = enclosing(found.select("path").distinct(), found.select("path")).filter("path = outer").select("path")
        failures(apply_plan(plan_paths(targets, action), confirm=True)).show()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="arbora")
    top.add_argument("--version", action="version", version=VERSION)
    sub = top.add_subparsers(required=True)
    c = sub.add_parser("compare")
    c.add_argument("-a", required=True)
    c.add_argument("-b", required=True)
    c.add_argument("-m", "--mode", default="all", choices=compare.REPORTS)
    c.add_argument("-H", "--hash", action="store_true", help="same as --hash-mode smart")
    c.add_argument("--hash-mode", choices=compare.MODES)
    c.add_argument("-o", "--out")
    c.set_defaults(run=_compare)
    d = sub.add_parser("dedup")
    d.add_argument("--reference", required=True)
    d.add_argument("--cleanup", action="append", required=True)
    d.add_argument("--mode", default="hash", choices=tuple(dedup.MODE_KEYS))
    d.add_argument("--move-to")
    d.add_argument("--out")
    d.add_argument("--keep-empty-dirs", action="store_true")
    d.set_defaults(run=_dedup)
    j = sub.add_parser("junk")
    j.add_argument("-d", "--dir", required=True)
    j.add_argument("-o", "--out")
    j.add_argument("-w", "--workers", type=int, default=0)
    j.set_defaults(run=_junk)
    k = sub.add_parser("caches")
    k.add_argument("-f", "--force", action="store_true")
    k.add_argument("-e", "--empty", action="store_true")
    k.set_defaults(run=_caches)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(SparkSession.builder.appName("arbora").getOrCreate(), args)


if __name__ == "__main__":
    main()
