"""Actions tried twice, removal of deep trees, totals of directories, roots in one another, files written side by side, streams."""

import io
import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from arbora import cli, report
from arbora.operators import emptydirs, overlap, rollup
from arbora.operators.junk import find_junk, find_named
from arbora.plans import sinks
from arbora.plans.actions import plan_paths
from arbora.sources.filetree import scan_tree, scan_trees
from arbora.sources.roots import roots_of_homes
from arbora.streaming import stream_duplicates, what_has_arrived


@pytest.fixture
def many_parts(spark):
    """Small tables stay in many partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def jobs(spark, run):
    """What run gives, and the number of jobs it took."""
    first = spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    out = run()
    return out, spark.sparkContext._jsc.sc().dagScheduler().nextJobId() - first


def test_an_attempt_after_a_dead_one_knows_what_it_did(tmp_path):
    for n in ("a", "b", "c"):
        (tmp_path / n).write_text(n)
    path = lambda n: os.fsencode(tmp_path / n)
    folder = str(tmp_path / "ledger")
    first = sinks.Ledger(folder, 3)
    assert sinks.carry_out(first, 0, "delete", path("a"), None, False) is None
    assert sinks.carry_out(first, 1, "move", path("b"), path("to/b"), False) is None
    os.write(first.out, b"7")  # it dies in the middle of a line
    again = sinks.Ledger(folder, 3)
    assert sinks.carry_out(again, 0, "delete", path("a"), None, False) is None
    assert sinks.carry_out(again, 1, "move", path("b"), path("to/b"), False) is None
    assert "No such file" in sinks.carry_out(again, 2, "delete", path("never"), None, False)
    assert sinks.carry_out(again, 3, "delete", path("c"), None, False) is None
    # rows of another partition, and what this attempt itself noted, prove nothing
    other = sinks.Ledger(folder, 4)
    assert sinks.carry_out(other, 0, "delete", path("a"), None, False) is not None
    assert sinks.carry_out(again, 3, "delete", path("c"), None, False) is not None
    assert (tmp_path / "to/b").read_text() == "b"


def test_twins_at_one_row(tmp_path, monkeypatch):
    """The second comes when the first has linked but not unlinked, then when the first is through."""
    folder, path, dest = str(tmp_path / "ledger"), os.fsencode(tmp_path / "f"), os.fsencode(tmp_path / "to/f")
    (tmp_path / "f").write_text("x")
    a, b = sinks.Ledger(folder, 0), sinks.Ledger(folder, 0)
    real = os.unlink

    def late(p, **kw):
        monkeypatch.setattr(os, "unlink", real)
        assert sinks.carry_out(b, 5, "move", path, dest, False) is None
        real(p, **kw)

    monkeypatch.setattr(os, "unlink", late)
    assert sinks.carry_out(a, 5, "move", path, dest, False) is None
    assert not os.path.lexists(path) and (tmp_path / "to/f").read_text() == "x"
    (tmp_path / "d/sub").mkdir(parents=True)
    gone, rmtree = os.fsencode(tmp_path / "d"), sinks.shutil.rmtree

    def after(p, **kw):
        monkeypatch.setattr(sinks.shutil, "rmtree", rmtree)
        assert sinks.carry_out(b, 6, "delete", p, None, False) is None
        return rmtree(p, **kw)

    monkeypatch.setattr(sinks.shutil, "rmtree", after)
    assert sinks.carry_out(a, 6, "delete", gone, None, False) is None


def test_nothing_is_overwritten(tmp_path):
    (tmp_path / "f").write_text("new")
    (tmp_path / "to").mkdir()
    (tmp_path / "to/f").write_text("old")
    ledger = sinks.Ledger(str(tmp_path / "ledger"), 0)
    assert "taken" in sinks.carry_out(ledger, 0, "move", os.fsencode(tmp_path / "f"), os.fsencode(tmp_path / "to/f"), False)
    assert (tmp_path / "f").read_text() == "new" and (tmp_path / "to/f").read_text() == "old"
    os.symlink("nowhere", tmp_path / "l")
    assert sinks.carry_out(ledger, 1, "move", os.fsencode(tmp_path / "l"), os.fsencode(tmp_path / "to/l"), False) is None
    assert os.readlink(tmp_path / "to/l") == "nowhere"


def test_a_plan_run_again_gives_one_outcome_a_row(spark, tmp_path):
    for i in range(60):
        (tmp_path / f"{i}").write_text("x")
    paths = [(str(tmp_path / f"{i}"),) for i in range(60)] + [(str(tmp_path / "never"),)]
    plan = plan_paths(spark.createDataFrame(paths, "path string"), "delete").withColumn("_row", F.monotonically_increasing_id())
    frozen = spark.createDataFrame(plan.collect(), plan.schema).select("_row", "action", "path", "dest", "collides").repartition(4, "_row")
    # an earlier attempt at each partition got through half of it
    folder = sinks.ledger_folder(spark, str(tmp_path / "shared"))
    for r in frozen.withColumn("_part", F.spark_partition_id()).collect():
        if r._row % 2 and "never" not in r.path:
            assert sinks.carry_out(sinks.Ledger(folder, r._part), r._row, r.action, r.path.encode(), None, False) is None
    outcome = {os.path.basename(r.path): r.ok for r in sinks._run(frozen, folder).collect()}
    assert outcome == {f"{i}": True for i in range(60)} | {"never": False}
    assert not os.path.exists(folder)


def test_deep_trees_go_in_a_fixed_number_of_jobs(spark, tmp_path):
    counts = []
    for depth in (20, 200):
        top = tmp_path / f"t{depth}"
        os.makedirs(top.joinpath(*["d"] * depth))
        for i in range(30):
            os.makedirs(top / f"wide/{i}/x")
        os.makedirs(top / "kept/in/here")
        (top / "kept/in/file").write_text("")
        dirs = scan_tree(spark, str(top)).filter("is_dir and depth > 0").select(F.col("abs").alias("path"), "depth")
        for subtree in (7, 10_000):
            if subtree == 7:
                done, n = jobs(spark, lambda: sinks.remove_dirs(dirs, confirm=True, subtree=7).collect())
                counts.append(n)
                assert {os.path.relpath(r.path, top) for r in done if not r.ok} == {"kept", "kept/in"}
                assert len(done) == depth + 61 + 3 and os.listdir(top) == ["kept"]
    assert counts[1] <= counts[0] + 4  # whether a join is broadcast may differ


def totals_by_hand(rows):
    out = defaultdict(lambda: [0, 0, 0])
    for tree, root, rel, is_dir, size, counts in rows:
        parts = rel.split("/") if rel else []
        dirs = ["/".join(parts[:i]) for i in range(len(parts) + 1)]
        for d in dirs if is_dir else dirs[:-1]:
            own = out[tree, root, d]
            if not is_dir and counts:
                own[0] += 1
                own[1] += size or 0
                own[2] += size is None
            elif is_dir:
                own[2] += size == -1
    return {(*k, *v) for k, v in out.items()}


def test_totals_over_many_ranges(spark, many_parts):
    rng = random.Random(8)
    names = ["a", "b", "a-", "a.b", "é", "A"]
    seen = {}
    for _ in range(3000):
        rel = "/".join(rng.choices(names, k=rng.randint(1, 7)))
        seen[rng.choice("tu"), rng.choice(["/r", "/s"]), rel] = (rng.random() < 0.2, rng.choice([None, -1, 0, 7, 10**6]), rng.random() < 0.5)
    rows = [(t, r, rel, d, s if d or s != -1 else 3, c) for (t, r, rel), (d, s, c) in seen.items()]
    df = spark.createDataFrame(rows, "tree string, root string, rel string, is_dir boolean, size long, c boolean")
    found = rollup.directory_totals(df, F.col("c"))
    assert {tuple(r)[:6] for r in found.collect()} == totals_by_hand(rows)
    assert found.filter("depth <> case when dir = '' then 0 else size(split(dir, '/')) end").count() == 0
    assert rollup.directory_totals(df.limit(0)).count() == 0
    empty = {(r.tree, r.root, r.dir) for r in emptydirs.empty_dirs(df).collect()}
    assert empty == {x[:3] for x in totals_by_hand([(*r[:5], True) for r in rows]) if x[3] == 0}


def test_what_is_shuffled_does_not_grow_with_depth(spark, many_parts):
    made = []
    for depth in (3, 40):
        rows = [("t", "/r", "/".join([str(i)] * depth) + "/f", False, 1) for i in range(200)]
        df = spark.createDataFrame(rows, "tree string, root string, rel string, is_dir boolean, size long")
        totals = rollup.directory_totals(df)
        assert totals.count() == 200 * depth + 1
        made.append(totals._jdf.queryExecution().toString().count("Generate"))
    assert made == [0, 0]


def test_enclosing_over_many_ranges(spark, many_parts):
    rng = random.Random(9)
    path = lambda: "/" + "/".join(rng.choices(["a", "b", "a b", "a.b", "a-"], k=rng.randint(0, 6)))
    items, tops = [path() for _ in range(2000)], [path() for _ in range(60)]
    for some in (tops, tops + ["/"], []):
        found = rollup.enclosing(spark.createDataFrame([(p, i) for i, p in enumerate(items)], "path string, n long"), spark.createDataFrame([(t,) for t in some], "path string"))
        assert found.columns == ["path", "n", "outer", "inner"]
        for r in found.collect():
            above = sorted((t for t in set(some) if t == "/" or r.path == t or r.path.startswith(t + "/")), key=len)
            assert (r.outer, r.inner) == ((above[0], above[-1]) if above else (None, None)), r
        assert found.count() == 2000


def test_nested_equal_and_linked_roots(spark, tmp_path):
    for f in ("a/b/f", "a/b/c/g", "a/h", "z/i"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_text("x")
    os.symlink(tmp_path / "a/b", tmp_path / "link")
    roots = overlap.real_roots([f"{tmp_path}/{r}" for r in ("a/b", "a", "a", "link", "z")])
    assert roots == [f"{tmp_path}/{r}" for r in ("a/b", "a", "z")]
    entries = scan_trees(spark, [f"{tmp_path}/{r}" for r in ("a/b", "a", "a", "z")])
    once = overlap.owned_once(entries).filter("not is_dir")
    assert sorted((os.path.relpath(r.abs, tmp_path), os.path.basename(r.root)) for r in once.collect()) == [("a/b/c/g", "a"), ("a/b/f", "a"), ("a/h", "a"), ("z/i", "z")]
    # an outer root with a limit lists less than the inner one
    some = scan_tree(spark, f"{tmp_path}/a", max_depth=1).unionByName(scan_tree(spark, f"{tmp_path}/a/b"))
    once = overlap.owned_once(some).filter("not is_dir")
    assert sorted((os.path.relpath(r.abs, tmp_path), os.path.basename(r.root)) for r in once.collect()) == [("a/b/c/g", "b"), ("a/b/f", "b"), ("a/h", "a")]


def test_a_link_to_the_reference_loses_nothing(spark, tmp_path, monkeypatch, capsys):
    """The cleanup tree is the reference under another name, and holds it again; only the copy beside it may go."""
    (tmp_path / "r").mkdir()
    (tmp_path / "r/f").write_text("same")
    (tmp_path / "copy").write_text("same")
    os.symlink(tmp_path / "r", tmp_path / "link")
    monkeypatch.setattr("sys.stdin", io.StringIO("y\n"))
    cli.main(["dedup", "--reference", str(tmp_path / "link"), "--cleanup", str(tmp_path / "r"), "--cleanup", str(tmp_path), "--cleanup", str(tmp_path / "link")])
    assert (tmp_path / "r/f").exists() and not (tmp_path / "copy").exists()
    with pytest.raises(ValueError):
        cli.main(["dedup", "--reference", "", "--cleanup", str(tmp_path)])


def test_files_are_written_side_by_side(spark, many_parts, tmp_path, monkeypatch):
    rng = random.Random(10)
    words = ["".join(rng.choices("abé😀" + chr(0xEFFF), k=rng.randint(0, 40))) for _ in range(5000)] * 2
    lines = spark.createDataFrame([(w, i % 3) for i, w in enumerate(words)], "line string, rank int").repartition(7)
    monkeypatch.setattr(report, "print_lines", None)  # nothing comes through the driver
    report.write_lines(lines, F.col("line"), ["rank", report.byte_order(F.col("line"))], str(tmp_path / "out"))
    raw = [(i % 3, w.encode().replace(chr(0xEFFF).encode(), b"\xff")) for i, w in enumerate(words)]
    assert (tmp_path / "out").read_bytes() == b"".join(w + b"\n" for _, w in sorted(raw))
    report.write_lines(lines.limit(0), F.col("line"), ["rank"], str(tmp_path / "out"))
    assert (tmp_path / "out").read_bytes() == b"" and os.listdir(tmp_path) == ["out"]


def test_streams_give_what_tables_give(spark, tmp_path):
    schema = "abs string, rel string, name string, is_dir boolean, size long, hash string"
    rows = [(f"/b/{i}", f"{i}", n, d, 1, h) for i, (n, d, h) in enumerate([("a.tmp", False, "h1"), ("a.tmp", True, "h1"), ("b", False, None), ("c.bak", False, "h2"), ("d", False, "h3")])]
    for i in range(5):
        spark.createDataFrame(rows[i : i + 1], schema).write.mode("append").parquet(str(tmp_path / "in"))
    reference = spark.createDataFrame([("/r/2", "h1"), ("/r/1", "h1"), ("/r/0", None), ("/r/3", "h2")], "abs string, hash string")
    arriving = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    junk = what_has_arrived(find_junk(arriving()), "junk")
    assert sorted(r.abs for r in junk.collect()) == ["/b/0", "/b/3"]
    assert sorted(r.abs for r in what_has_arrived(find_named(arriving(), ["?", "*.b*"]), "named").collect()) == ["/b/2", "/b/3", "/b/4"]
    files = what_has_arrived(stream_duplicates(arriving().filter("not is_dir"), reference), "dups")
    assert sorted((r.abs, r.reference_abs) for r in files.collect()) == [("/b/0", "/r/1"), ("/b/3", "/r/3")]


def test_roots_of_every_home(spark):
    homes = spark.createDataFrame([("/home/a",), ("/home/b",), ("/home/a",)], "home string")
    assert sorted(map(tuple, roots_of_homes(homes, "linux").collect())) == [("/home/a/.cache", 0), ("/home/b/.cache", 0), ("/tmp", 0), ("/var/tmp", 0)]
    assert sorted(r.root for r in roots_of_homes(homes, "darwin").collect()) == ["/Library/Caches/Adobe", "/home/a/Library/Caches", "/home/b/Library/Caches"]
