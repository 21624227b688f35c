"""Names as bytes, walking in rounds, what a walk leaves shut, files dealt by bytes."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, LessThanOrEqual, Not, StringContains

from arbora import cli
from arbora.functions import hashing
from arbora.functions.bytepaths import byte_order, escape, unescape
from arbora.functions.globs import glob_matcher, glob_regex, matches_glob
from arbora.functions.names import is_cache_name, names_cache
from arbora.operators import caches, compare, dedup
from arbora.plans.actions import plan_duplicates, plan_paths
from arbora.plans.sinks import apply_plan
from arbora.sources.filetree import FORMAT, PushedReader, TreeReader, files_of, register, scan_tree
from arbora.sources.walk import listed, walk


def put(root, files):
    for name, content in files.items():
        path = os.path.join(os.fsencode(root), os.fsencode(name))
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(content)


@given(st.binary(max_size=12), st.binary(max_size=12))
def test_every_name_has_a_text_of_its_own(a, b):
    assert unescape(escape(a)) == a and (escape(a) == escape(b)) == (a == b)
    escape(a).encode()
    # the character that a byte becomes is a name of its own, too
    shown = escape(a).encode()
    assert unescape(escape(shown)) == shown and (escape(shown) == escape(a)) == (shown == a)


def test_order_is_that_of_the_bytes(spark):
    rng = random.Random(2)
    names = list({bytes(rng.choice([0x41, 0x7A, 0xC3, 0xA9, 0xFF, 0xEE, 0xBE, 0x80, 0xF0, 0x9F, 0x98, 0x2F]) for _ in range(rng.randint(0, 6))) for _ in range(3000)})
    rows = spark.createDataFrame([(escape(n), n) for n in names], "text string, raw binary")
    assert rows.filter(byte_order(F.col("text")) != F.col("raw")).count() == 0
    assert [bytes(r.raw) for r in rows.orderBy(byte_order(F.col("text"))).collect()] == sorted(names)


def test_names_that_are_no_text_are_kept_apart(spark, tmp_path):
    odd = {b"x\xff": b"1", b"x\xfe": b"1", b"d\xff/n": b"2", escape(b"x\xff").encode(): b"3", b"good": b"4"}
    put(tmp_path / "a", {k: v for k, v in odd.items() if k != b"x\xfe"})
    put(tmp_path / "b", {k: v for k, v in odd.items() if k != b"x\xff"})
    a, b = (files_of(scan_tree(spark, str(tmp_path / t), t)) for t in "ab")
    assert sorted(unescape(r.rel) for r in compare.only_in(a, b).collect()) == [b"x\xff"]
    assert sorted(unescape(r.rel) for r in compare.only_in(b, a).collect()) == [b"x\xfe"]
    same = {unescape(r.rel) for r in dedup.find_duplicates(a, b, "path").collect()}
    assert same == set(odd) - {b"x\xff", b"x\xfe"}
    found = dedup.find_duplicates(a, b, "hash", hashing.with_file_hash)
    assert {unescape(r.rel) for r in found.collect()} == set(odd) - {b"x\xff"}
    outcome = apply_plan(plan_duplicates(dedup.group_duplicates(found.filter(F.col("rel") == escape(b"x\xfe"))), str(tmp_path / "moved")), confirm=True)
    assert [(r.ok, r.error) for r in outcome.collect()] == [(True, None)]
    assert os.listdir(os.fsencode(tmp_path / "moved")) == [b"x\xfe"]
    assert sorted(os.listdir(os.fsencode(tmp_path / "b"))) == sorted([b"d\xff", escape(b"x\xff").encode(), b"good"])
    gone = apply_plan(plan_paths(spark.createDataFrame([(str(tmp_path / "b/never"),)], "path string"), "delete"), confirm=True).first()
    assert not gone.ok and "never" in gone.error


def test_reports_hold_the_bytes(spark, tmp_path, capfdbinary):
    put(tmp_path, {b"a/x\xff": b"", b"a/\xc3\xa9": b"", b"a/\xc3z": b"", b"b/q": b""})
    cli.main(["compare", "-a", str(tmp_path / "a"), "-b", str(tmp_path / "b"), "-o", str(tmp_path / "out")])
    want = b"Only in A: 3\nx\xff\n\xc3z\n\xc3\xa9\nOnly in B: 1\nq\n"
    assert (tmp_path / "out").read_bytes() == want
    cli.main(["compare", "-a", str(tmp_path / "a"), "-b", str(tmp_path / "b")])
    assert capfdbinary.readouterr().out == want


def test_roots_that_are_no_text(spark, tmp_path):
    put(tmp_path, {b"r\xff/f": b"1", b"r\xfe/f": b"2", b"r\xfe/g": b"2"})
    assert sorted(r.rel for r in scan_tree(spark, os.fsencode(tmp_path) + b"/r\xff").collect()) == ["", "f"]
    assert sorted(r.rel for r in scan_tree(spark, os.fsdecode(os.fsencode(tmp_path) + b"/r\xfe")).collect()) == ["", "f", "g"]


def test_a_narrow_way_down_spreads_below(spark, tmp_path, monkeypatch):
    """50 directories in a chain, 10,000 at its end; the driver opens none of them."""
    end = os.path.join(tmp_path, *["c"] * 50)
    for i in range(10_000):
        os.makedirs(f"{end}/{i}")
    put(end, {f"{i}/f": b"x" for i in range(0, 10_000, 10)})
    opened = []
    real = os.scandir
    monkeypatch.setattr(os, "scandir", lambda p=".": opened.append(p) or real(p))
    found = scan_tree(spark, str(tmp_path))
    assert not [p for p in opened if str(tmp_path) in os.fsdecode(p)]
    assert found.groupBy("is_dir").count().orderBy("is_dir").collect() == [(False, 1000), (True, 10_051)]
    assert found.select("abs").distinct().count() == 11_051
    tasks = found.filter("depth = 52").select(F.input_file_name().alias("f")).groupBy("f").count().collect()
    assert len(tasks) >= 16 and max(r["count"] for r in tasks) < 300


def test_rounds_give_what_one_walk_gives(spark, tmp_path):
    put(tmp_path, {f"{i % 7}/{i % 5}/{i}": b"x" * i for i in range(200)})
    put(tmp_path, {"3/pip/in/deep/f": b"12", "GPUCache/f": b"1", "3/pip/in/cache/g": b"345"})
    for more in ({}, {"max_depth": 2}, {"contains": ("1",)}, {"caches": "sizes"}, {"caches": "paths"}, {"caches": "sizes", "max_depth": 1}):
        rules = TreeReader({"path": str(tmp_path)}).rules.__class__(os.fsencode(tmp_path), dirs="contains" not in more, **more)
        whole = sorted(r[3] for r in listed(rules.start(), rules))
        for budget in (1, 30, 10**6):
            assert sorted(r.abs for r in walk(spark, rules, budget).collect()) == whole


@pytest.fixture
def opened(monkeypatch):
    seen, real = [], os.scandir
    monkeypatch.setattr(os, "scandir", lambda p=".": seen.append(os.fsdecode(p)) or real(p))
    return seen


def read(reader):
    return [row for part in reader.partitions() for row in reader.read(part)]


def test_pushed_filters_leave_directories_shut(tmp_path, opened):
    put(tmp_path, {"a/b/c/d": b"", "a/x.tmp": b"", "e": b""})
    reader = PushedReader({"path": str(tmp_path)})
    filters = [LessThanOrEqual(("depth",), 2), EqualTo(("is_dir",), False), StringContains(("name",), ".tmp"), Not(EqualTo(("tree",), "x"))]
    assert list(reader.pushFilters(filters)) == filters
    assert [r[2] for r in read(reader)] == ["a/x.tmp"]
    assert {os.path.relpath(p, tmp_path) for p in opened} == {".", "a"}
    reader = PushedReader({"path": str(tmp_path)})
    list(reader.pushFilters([Not(EqualTo(("is_dir",), False)), EqualTo(("depth",), 1)]))
    assert sorted(r[2] for r in read(reader)) == ["", "a"]


def test_spark_hands_filters_to_the_walk(spark, tmp_path):
    put(tmp_path, {"a/b/c/d": b"", "a/x.tmp": b"", "e.tmp": b""})
    register(spark)
    tree = lambda push: spark.read.format(FORMAT).option("pushdown", push).load(str(tmp_path)).filter("depth <= 2 and not is_dir and name like '%.tmp%'")
    plain = sorted(r.rel for r in tree("false").collect())
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert sorted(r.rel for r in tree("true").collect()) == plain == ["a/x.tmp", "e.tmp"]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_walks_for_caches_open_what_they_need(spark, tmp_path, opened):
    tmp_path = tmp_path / "top"  # the test's own folder is a cache by name
    put(tmp_path, {"app/GPUCache/sub/f": b"12", "app/deep/pip/f": b"1", "pip/cache/f": b"123", "other/f": b""})
    sizes = lambda depth: {r.match: r.size for r in caches.cache_sizes(scan_tree(spark, str(tmp_path), max_depth=depth, caches="sizes"), depth).collect()}
    assert sizes(0) == {"app/GPUCache": 2, "app/deep/pip": 1, "pip": 3}
    assert sizes(1) == {"pip": 3} and sizes(2) == {"app/GPUCache": 2, "pip": 3}
    assert sorted(r.rel for r in scan_tree(spark, str(tmp_path), caches="paths").collect()) == ["app/GPUCache", "app/deep/pip", "pip"]
    for caches_, depth, want in (("paths", 0, {".", "app", "app/deep", "other"}), ("paths", 1, {"."}), ("sizes", 1, {".", "pip", "pip/cache"}), ("sizes", 2, {".", "app", "app/GPUCache", "app/GPUCache/sub", "other", "pip", "pip/cache"})):
        del opened[:]
        read(TreeReader({"path": str(tmp_path), "caches": caches_, "maxDepth": str(depth)}))
        assert {os.path.relpath(p, tmp_path) for p in opened} == want


def test_a_root_that_is_a_cache(spark, tmp_path):
    put(tmp_path, {"pip/a/f": b"12", "pip/g": b"3"})
    assert sorted(r.rel for r in scan_tree(spark, str(tmp_path / "pip"), caches="sizes").collect()) == ["", "a", "a/f", "g"]
    assert [r.rel for r in scan_tree(spark, str(tmp_path / "pip"), caches="paths").collect()] == [""]


def test_files_are_dealt_by_bytes(spark):
    rng = random.Random(4)
    for sizes in ([int(rng.paretovariate(0.9) * 1000) for _ in range(4000)], [10**6] * 40 + [10] * 4000, [5] * 1000, [0] * 50, [7]):
        share = sum(sizes) / 16
        sizes = [min(s, int(share)) for s in sizes]  # one file alone can't be split
        rows = spark.createDataFrame([(f"/p/{i}".encode(), s) for i, s in enumerate(sizes)], "raw_path binary, size long")
        dealt = hashing.dealt_by_bytes(rows, F.col("size"), tasks=16).withColumn("t", F.spark_partition_id())
        assert sorted((bytes(r.raw_path), r["size"]) for r in dealt.collect()) == sorted((f"/p/{i}".encode(), s) for i, s in enumerate(sizes))
        loads = [r.n for r in dealt.groupBy("t").agg(F.sum("size").alias("n")).collect()]
        if len(sizes) >= 1000:
            assert max(loads) < 1.3 * sum(sizes) / 16
    assert hashing.dealt_by_bytes(rows.limit(0), F.col("size"), tasks=4).count() == 0


def test_ends_are_read_before_files_are(spark, tmp_path):
    big = 3 * hashing.END
    body = lambda head, middle, tail: head + b"." * (big // 2) + middle + b"." * (big // 2) + tail
    a = {"same": body(b"1", b"m", b"1"), "head": body(b"2", b"m", b"1"), "tail": body(b"1", b"m", b"2"), "middle": body(b"3", b"m", b"3"), "small": b"s", "alone": b"12"}
    b = {"twin": body(b"1", b"m", b"1"), "middle": body(b"3", b"n", b"3"), "tiny": b"s", "mine": body(b"9", b"9", b"9")}
    put(tmp_path / "a", a)
    put(tmp_path / "b", b)
    left, right = (files_of(scan_tree(spark, str(tmp_path / t))) for t in "ab")
    whole = []

    def counting(files):
        whole.extend(os.path.basename(r.abs) for r in files.collect())
        return hashing.with_file_hash(files)

    diff = compare.compare_trees(left, right, "strict", "all", counting)
    assert {(r.side, r.rel) for r in diff.collect()} == {("a", x) for x in ("head", "tail", "middle", "alone")} | {("b", x) for x in ("middle", "mine")}
    assert sorted(whole) == ["middle", "middle", "same", "twin"]
    del whole[:]
    found = dedup.find_duplicates(left, right, "hash", counting)
    assert {(os.path.basename(r.reference_abs), r.rel) for r in found.collect()} == {("same", "twin"), ("small", "tiny")}
    assert sorted(whole) == ["middle", "middle", "same", "twin"]
    assert hashing.probe_file(str(tmp_path / "none")) == (None, None)


def test_entries_of_a_table_take_any_hasher(spark):
    files = lambda *rows: spark.createDataFrame([(f"/{r}", r, 1, t) for r, t in rows], "abs string, rel string, size long, text string")
    a, b = files(("x", "1"), ("y", "2")), files(("z", "1"), ("y", "3"))
    by_text = lambda df: df.withColumn("hash", hashing.content_hash(F.col("text")))
    diff = compare.compare_trees(a, b, "strict", "all", by_text)
    assert sorted((r.side, r.rel) for r in diff.collect()) == [("a", "y"), ("b", "y")]


def plain_glob(glob, name):
    """Whether the whole name matches, straight from the rules; an error if the glob is a bad one."""

    def one(i):
        if i >= len(glob) or glob[i] in "-]":
            raise ValueError
        if glob[i] == "\\":
            i += 1
            if i >= len(glob):
                raise ValueError
        return glob[i], i + 1

    tokens, i = [], 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "[":
            negated = i < len(glob) and glob[i] == "^"
            i += negated
            ranges = []
            while not ranges or i >= len(glob) or glob[i] != "]":
                low, i = one(i)
                high = low
                if i < len(glob) and glob[i] == "-":
                    high, i = one(i + 1)
                ranges.append((low, high))
            i += 1
            tokens.append(lambda x, r=ranges, n=negated: any(a <= x <= b for a, b in r) != n)
        elif c == "*":
            tokens.append(None)
        elif c == "?":
            tokens.append(lambda x: x != "/")
        else:
            if c == "\\":
                if i == len(glob):
                    raise ValueError
                c = glob[i]
                i += 1
            tokens.append(lambda x, c=c: x == c)

    def fits(t, n):
        if t == len(tokens):
            return n == len(name)
        if tokens[t] is None:
            return fits(t + 1, n) or (n < len(name) and name[n] != "/" and fits(t, n + 1))
        return n < len(name) and tokens[t](name[n]) and fits(t + 1, n + 1)

    return fits(0, 0)


ALPHABET = "abé-^]\\*?[.$|&\n/😀"


@settings(max_examples=600)
@given(st.text(ALPHABET, max_size=7), st.text(ALPHABET, max_size=5))
def test_globs_in_python(glob, name):
    try:
        want = plain_glob(glob, name)
    except ValueError:
        with pytest.raises(ValueError):
            glob_regex(glob)
        return
    assert glob_matcher(glob)(name) == want


def test_globs_in_spark(spark):
    rng = random.Random(6)
    names = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 4))) for _ in range(400)]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    globs = []
    while len(globs) < 60:
        glob = "".join(rng.choices(ALPHABET, k=rng.randint(1, 5)))
        try:
            plain_glob(glob, "")
            globs.append(glob)
        except ValueError:
            pass
    found = rows.select("name", *(matches_glob(F.col("name"), g).alias(f"g{i}") for i, g in enumerate(globs)), matches_glob(F.col("name"), globs).alias("some"), matches_glob(F.col("name"), []).alias("none"))
    for r in found.collect():
        want = [plain_glob(g, r.name) for g in globs]
        assert list(r[1:-2]) == want and r["some"] == any(want) and not r["none"]


def test_cache_names_are_judged_alike_while_walking(spark):
    names = ["Cache", "xCACHEx", "pip", "PIP", "pipx", "Photoshop Temp12", "adobetemp", "Package Cache", "SLStore", "go", "golang", "go-build", "İcache", "K", "bridgecachex", "tempzxpsig"]
    rows = spark.createDataFrame([(n,) for n in names], "name string").select("name", is_cache_name(F.col("name")).alias("is"))
    assert {r.name: r["is"] for r in rows.collect()} == {n: names_cache(n.encode()) for n in names}
