"""Real directory trees: scanning, hashing, plans and sinks."""

import io
import os

import pytest
from pyspark.sql import functions as F

from arbora import cli
from arbora.functions.hashing import hash_file, with_file_hash
from arbora.functions.names import JUNK_PARTS, accepts
from arbora.operators import caches, compare, dedup, emptydirs, junk
from arbora.plans.actions import plan_duplicates, plan_paths
from arbora.plans.sinks import apply_plan, remove_dirs
from arbora.report import compare_report
from arbora.schema import FILE_ENTRY, UNLISTED
from arbora.sources.filetree import TreeReader, files_of, scan_tree, scan_trees
from arbora.sources.roots import cache_roots


def put(root, files):
    for rel, text in files.items():
        path = root / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


@pytest.fixture
def trees(tmp_path):
    put(tmp_path / "a", {"keep.txt": "k", "size.txt": "abc", "old/name.txt": "moved", "same-size.bin": "12345", "zero": "", "twin1": "tw", "twin2": "tw", ".hid/.x": "h"})
    put(tmp_path / "b", {"keep.txt": "k", "size.txt": "abcd", "new/name.txt": "moved", "other.bin": "54321", "sub/zero2": "", "twin": "tw", ".hid/.x": "h"})
    os.symlink("keep.txt", tmp_path / "a/link")
    os.symlink("old", tmp_path / "a/dlink")
    return tmp_path


def rels(df):
    return sorted(r.rel for r in df.collect())


def test_scan_lists_hidden_empty_and_links_without_following(spark, trees):
    rows = {r.rel: r for r in scan_tree(spark, str(trees / "a"), "a").collect()}
    assert rows[""].is_dir and rows["old"].is_dir and rows["old"].depth == 1
    assert rows["zero"].size == 0 and rows[".hid/.x"].size == 1
    assert not rows["dlink"].is_dir and "dlink/name.txt" not in rows
    assert rels(scan_tree(spark, str(trees / "a"), max_depth=1)) == sorted(["", ".hid", "dlink", "keep.txt", "link", "old", "same-size.bin", "size.txt", "twin1", "twin2", "zero"])
    assert scan_tree(spark, str(trees / "none")).count() == 0
    with pytest.raises(ValueError):
        scan_tree(spark, "")


def test_compare_modes(spark, trees):
    a, b = files_of(scan_tree(spark, str(trees / "a"))), files_of(scan_tree(spark, str(trees / "b")))
    assert rels(compare.only_in(a, b, "off")) == ["dlink", "link", "old/name.txt", "same-size.bin", "twin1", "twin2", "zero"]
    assert rels(compare.only_in(a, b, "smart", with_file_hash)) == ["dlink", "link", "same-size.bin"]
    assert rels(compare.only_in(a, b, "strict", with_file_hash)) == ["dlink", "link", "same-size.bin", "size.txt"]
    assert compare.only_in(a.filter("rel not in ('dlink', 'link')"), a, "strict", with_file_hash).count() == 0
    lines = compare_report(compare.compare_trees(a, b, "off", "missing_a"), "missing_a").orderBy("section", "rank", "line").collect()
    assert [r.line for r in lines] == ["Only in B: 4", "new/name.txt", "other.bin", "sub/zero2", "twin"]


def test_duplicates_are_moved_once_and_empty_directories_follow(spark, trees, tmp_path):
    reference = files_of(scan_tree(spark, str(trees / "a")))
    entries = scan_trees(spark, [str(trees / "b"), str(trees / "b")], "b")
    found = dedup.group_duplicates(dedup.find_duplicates(reference, files_of(entries), "hash", with_file_hash))
    assert rels(found) == [".hid/.x", "keep.txt", "new/name.txt", "sub/zero2", "twin"]
    plan = plan_duplicates(found, str(tmp_path / "moved"))
    with pytest.raises(PermissionError):
        apply_plan(plan)
    frozen = files_of(entries).select("abs", "rel", "tree").distinct().collect()
    gone = spark.createDataFrame([(r.tree, r.rel) for r in frozen if r.rel in rels(found)], "tree string, rel string")
    empty = spark.createDataFrame([(r.root + "/" + r.dir, r.depth) for r in emptydirs.empty_dirs(entries, gone).collect()], "path string, depth int")
    assert apply_plan(plan, confirm=True).filter("not ok").count() == 0
    assert sorted(os.listdir(tmp_path / "moved")) == [".x", "keep.txt", "name.txt", "twin", "zero2"]
    assert remove_dirs(empty.distinct(), confirm=True).filter("not ok").count() == 0
    assert sorted(os.listdir(trees / "b")) == ["other.bin", "size.txt"]


def test_colliding_moves_are_refused(spark, tmp_path):
    put(tmp_path, {"r/f": "x", "c/1/f": "x", "c/2/f": "x"})
    found = dedup.group_duplicates(dedup.find_duplicates(files_of(scan_tree(spark, str(tmp_path / "r"))), files_of(scan_tree(spark, str(tmp_path / "c"))), "hash", with_file_hash))
    assert apply_plan(plan_duplicates(found, str(tmp_path / "m")), confirm=True).filter("not ok").count() == 2
    assert (tmp_path / "c/1/f").exists() and (tmp_path / "c/2/f").exists()


def test_junk_and_caches(spark, tmp_path):
    put(tmp_path, {f"j/{n}": "x" for n in ("~$x.docx", "a.tmpl", ".~lock.f#", "x.bak2", "~WRL01", "Thumbs.db", ".DS_Store", "thumbs.db", "A.TMP", ".tmp/plain.txt")})
    found = junk.find_junk(scan_tree(spark, str(tmp_path / "j")))
    assert rels(found) == sorted(["~$x.docx", "a.tmpl", ".~lock.f#", "x.bak2", "~WRL01", "Thumbs.db", ".DS_Store"])
    put(tmp_path, {"c/app/GPUCache/sub/cache/f": "12", "c/Package Cache/pip/f": "1", "c/SLStore/f": "", "c/golang/f": "", "c/go/f": "123"})
    (tmp_path / "c/Cache-empty").mkdir()
    sizes = {r.match: r.size for r in caches.cache_sizes(scan_tree(spark, str(tmp_path / "c"))).collect()}
    assert sizes == {"app/GPUCache": 2, "Package Cache/pip": 1, "go": 3, "Cache-empty": 0}
    assert apply_plan(plan_paths(caches.find_cache_dirs(scan_tree(spark, str(tmp_path / "c"))), "empty"), confirm=True).filter("not ok").count() == 0
    assert os.listdir(tmp_path / "c/go") == []


def test_small_things(tmp_path):
    assert [accepts(x) for x in ("y\n", " YES ", "n", "", None)] == [True, True, False, False, False]
    assert cache_roots("windows", {}) == [] and cache_roots("darwin", {"HOME": "/u"})[1] == ("/u/Library/Caches", 0)
    assert hash_file(str(tmp_path / "none")) is None
    assert cli.parser().parse_args(["compare", "-a", "x", "-b", "y", "-H"]).hash


def test_hashing_stays_out_of_filters(spark):
    from arbora.queries import QUERIES

    plan = QUERIES["strict_only_a"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line.split("(")[0] and "sha2(" in line]
    assert "text" not in "".join(x for x in plan.splitlines() if "Join" in x)


def test_two_cleanup_roots_keep_their_files_apart(spark, tmp_path):
    put(tmp_path, {"r/f": "same", "c1/x/f": "same", "c2/x/f": "other"})
    entries = scan_trees(spark, [str(tmp_path / "c1"), str(tmp_path / "c2")], "c")
    found = dedup.find_duplicates(files_of(scan_tree(spark, str(tmp_path / "r"))), files_of(entries), "hash", with_file_hash)
    gone = found.select(F.lit("c").alias("tree"), "root", "rel")
    assert sorted((os.path.basename(r.root), r.dir) for r in emptydirs.empty_dirs(entries, gone).collect()) == [("c1", ""), ("c1", "x")]


def test_files_are_hashed_in_many_tasks_and_once(spark, tmp_path):
    put(tmp_path, {f"a/{i}": f"{i % 7}" for i in range(400)} | {f"b/{i + 200}": f"{i % 9}" for i in range(400)})
    a, b = (files_of(scan_tree(spark, str(tmp_path / x))) for x in "ab")
    parts = with_file_hash(a).select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts >= 2 * spark.sparkContext.defaultParallelism
    read = spark.sparkContext.accumulator(0)

    def counting(files):
        read.add(files.count())
        return with_file_hash(files)

    for mode, wanted in (("strict", 800), ("smart", 800)):
        before = read.value
        diff = compare.compare_trees(a, b, mode, "all", counting)
        got = {(r.side, r.rel) for r in diff.collect()}
        text = {s: {i: str((i - o) % k) for i in range(o, o + 400)} for s, o, k in (("a", 0, 7), ("b", 200, 9))}
        left = {("a", str(i)) for i, t in text["a"].items() if t not in text["b"].values() and (mode == "strict" or i not in text["b"])}
        left |= {("b", str(i)) for i, t in text["b"].items() if t not in text["a"].values() and (mode == "strict" or i not in text["a"])}
        assert got == left
        assert read.value - before <= wanted


def test_directories_that_cannot_be_listed_have_no_known_size(spark, tmp_path, monkeypatch):
    put(tmp_path, {"pip/a": "123", "pip/locked/b": "45", "go/c": "6"})
    real = os.scandir

    def scandir(path):
        if os.path.basename(path) == b"locked":
            raise PermissionError(path)
        return real(path)

    monkeypatch.setattr(os, "scandir", scandir)
    reader = TreeReader({"path": str(tmp_path)})
    rows = [row for part in reader.partitions() for row in reader.read(part)]
    assert {r[2]: r[7] for r in rows if r[5]} == {"": None, "pip": None, "pip/locked": UNLISTED, "go": None}
    sizes = caches.cache_sizes(spark.createDataFrame(rows, FILE_ENTRY))
    assert {r.match: r.size for r in sizes.collect()} == {"pip": None, "go": 1}
    total = caches.cache_total(sizes).first()
    assert (total.n_targets, total.bytes) == (2, 1)


def test_a_wide_tree_is_dealt_out_as_subtrees(tmp_path):
    for i in range(100):
        (tmp_path / f"d{i}/e").mkdir(parents=True)
        (tmp_path / f"d{i}/e/f").write_text("x")
    reader = TreeReader({"path": str(tmp_path)})
    parts = reader.partitions()
    assert len(parts) == 101 and sum(p.deep for p in parts) == 100
    assert sorted(r[2] for p in parts for r in reader.read(p)) == sorted(["", *(f"d{i}{x}" for i in range(100) for x in ("", "/e", "/e/f"))])


def test_names_are_filtered_while_walking(spark, tmp_path):
    put(tmp_path, {"a.tmp": "", "sub/b.bak": "", "sub/c.txt": "", "x.tmp/d.txt": ""})
    assert rels(scan_tree(spark, str(tmp_path), contains=JUNK_PARTS)) == ["a.tmp", "sub/b.bak"]


def answer(monkeypatch, text):
    monkeypatch.setattr("sys.stdin", io.StringIO(text))


def test_command_compare_writes_one_file(spark, trees, tmp_path, capsys):
    cli.main(["compare", "-a", str(trees / "a"), "-b", str(trees / "b"), "--hash-mode", "strict"])
    printed = capsys.readouterr().out
    cli.main(["compare", "-a", str(trees / "a"), "-b", str(trees / "b"), "--hash-mode", "strict", "-o", str(tmp_path / "out.txt")])
    assert (tmp_path / "out.txt").read_text() == printed
    assert printed.splitlines() == ["Only in A: 4", "dlink", "link", "same-size.bin", "size.txt", "Only in B: 2", "other.bin", "size.txt"]
    with pytest.raises(SystemExit):
        cli.main(["compare", "-a", "x", "-b", "y", "-o", str(tmp_path / "none/out.txt")])


def test_command_dedup_asks_first(spark, tmp_path, monkeypatch, capsys):
    put(tmp_path, {"r/f": "same", "c1/x/f": "same", "c2/x/f": "other", "c2/y/g": "same"})
    call = ["dedup", "--reference", str(tmp_path / "r"), "--cleanup", str(tmp_path / "c1"), "--cleanup", str(tmp_path / "c2")]
    for text in ("", "n\n"):
        answer(monkeypatch, text)
        cli.main(call)
        assert (tmp_path / "c1/x/f").exists()
    answer(monkeypatch, " Yes\n")
    cli.main(call)
    assert not (tmp_path / "c1").exists() and (tmp_path / "c2/x/f").exists() and not (tmp_path / "c2/y").exists()
    assert "3 directories removed" in capsys.readouterr().out


def test_command_junk_deletes_what_it_lists(spark, tmp_path, monkeypatch, capsys):
    put(tmp_path, {"j/a.tmp": "", "j/b.txt": "", "j/s/Thumbs.db": ""})
    answer(monkeypatch, "y\n")
    cli.main(["junk", "-d", str(tmp_path / "j"), "-o", str(tmp_path / "list.txt")])
    assert (tmp_path / "list.txt").read_text().splitlines() == [str(tmp_path / "j/a.tmp"), str(tmp_path / "j/s/Thumbs.db")]
    assert sorted(p.name for p in (tmp_path / "j").rglob("*") if p.is_file()) == ["b.txt"]


def test_command_caches_empties_or_deletes(spark, tmp_path, monkeypatch, capsys):
    put(tmp_path, {"h/pip/a": "123", "h/app/GPUCache/b": "45", "h/app/keep": "6"})
    monkeypatch.setattr(cli, "cache_roots", lambda: [(str(tmp_path / "h"), 0), (str(tmp_path / "none"), 0)])
    cli.main(["caches"])
    out = capsys.readouterr().out.splitlines()
    assert out == [f"{tmp_path}/h/app/GPUCache  2 B", f"{tmp_path}/h/pip  3 B", "Total: 5 B"]
    answer(monkeypatch, "y\n")
    cli.main(["caches", "--force", "--empty"])
    assert (tmp_path / "h/pip").is_dir() and not os.listdir(tmp_path / "h/pip")
    answer(monkeypatch, "y\n")
    cli.main(["caches", "--force"])
    assert sorted(os.listdir(tmp_path / "h")) == ["app"] and os.listdir(tmp_path / "h/app") == ["keep"]


def test_staged_tables_need_a_shared_folder_and_can_be_cleaned_up(spark):
    from types import SimpleNamespace

    from arbora import staging

    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        staging.shared_dir(unset)
    kept = staging.stage(spark.range(3))
    assert kept.count() == 3
    folder = kept._arbora_path.removeprefix("file://")
    staging.discard(kept)
    assert not os.path.exists(folder)
