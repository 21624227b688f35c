"""Named queries over the virtual catalogue, each with the SQL that gives the same rows."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions.bytepaths import FIRST, byte_order
from arbora.functions.names import JUNK_PARTS, is_cache_name
from arbora.functions.ordinals import global_ordinal
from arbora.functions.paths import parent_path, relative_path
from arbora.functions.sizes import human_size
from arbora.operators import caches, compare, dedup, emptydirs, junk, overlap, rollup
from arbora.plans.actions import plan_duplicates, plan_paths
from arbora.sources.roots import roots_of_homes
from arbora.sources.tables import catalog, tree_of
from arbora.streaming import stream_duplicates, what_has_arrived

GLOBS = ("f[0-4]*.txt", "*[^t]", "~[!$]*", "f?7.*", "[~]WRL*.[a-c]?k", "\\~\\$f1*")


def _trees(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    entries = catalog(spark, sf_dir)
    return tree_of(entries, "t0"), tree_of(entries, "t1")


def _dups(spark, sf_dir, mode):
    return dedup.find_duplicates(*_trees(spark, sf_dir), mode)


def _only(mode, flip):
    def run(spark, sf_dir):
        a, b = _trees(spark, sf_dir)
        return compare.only_in(b, a, mode).select("rel") if flip else compare.only_in(a, b, mode).select("rel")

    return run


def _all(mode, report="all"):
    return lambda spark, sf_dir: compare.compare_trees(*_trees(spark, sf_dir), mode, report)


def _dup(mode):
    return lambda spark, sf_dir: _dups(spark, sf_dir, mode).select("reference_abs", "abs", "size")


def _summary(spark, sf_dir):
    out = None
    for mode in dedup.MODE_KEYS:
        one = dedup.duplicate_summary(_dups(spark, sf_dir, mode)).select(F.lit(mode).alias("mode"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def _groups(spark, sf_dir):
    return dedup.group_duplicates(_dups(spark, sf_dir, "hash"))


def _union(spark, sf_dir):
    """The two trees as two cleanup roots, and t1 once more: nothing is merged."""
    a, b = _trees(spark, sf_dir)
    return a.unionByName(b).unionByName(b).groupBy("root").agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"))


def _empty(spark, sf_dir):
    a, b = _trees(spark, sf_dir)
    gone = dedup.find_duplicates(a, b, "hash").select(F.lit("t1").alias("tree"), "rel")
    return emptydirs.empty_dirs(b, gone).select("dir", "depth")


def _empty_two_roots(spark, sf_dir):
    """Both trees as two roots of one cleanup; only files below the second go."""
    a, b = _trees(spark, sf_dir)
    gone = dedup.find_duplicates(a, b, "hash").select(F.lit("cleanup").alias("tree"), "root", "rel")
    return emptydirs.empty_dirs(a.unionByName(b).withColumn("tree", F.lit("cleanup")), gone).select("root", "dir", "depth")


def _root_matches(spark, sf_dir):
    """t1 below a root that is itself a cache directory, t0 below one that isn't."""
    root = F.when(F.col("tree") == "t1", "/home/user/.cache").otherwise("/srv/package cache")
    return caches.cache_sizes(catalog(spark, sf_dir).withColumn("root", root)).select("root", "match", "path", "size", "n_files")


def _ordered_diff(spark, sf_dir):
    """The lines of a comparison with their place in the report."""
    return global_ordinal(compare.compare_trees(*_trees(spark, sf_dir)), ["side", "rel"], "place")


def _ordered_dups(spark, sf_dir):
    """Duplicates with their place in the plan: by group, then by path."""
    return global_ordinal(_groups(spark, sf_dir).select("group_id", "abs"), ["group_id", "abs"], "place")


def _human(spark, sf_dir):
    sizes = catalog(spark, sf_dir).select("size").distinct()
    scaled = sizes.select(F.explode(F.array(*(F.col("size") * F.lit(1024**k).cast("bigint") for k in range(5)))).alias("n"))
    ties = spark.range(1).select(F.explode(F.array(*(F.lit(v).cast("bigint") for v in TIES))).alias("n"))
    return scaled.unionByName(ties).distinct().select("n", human_size(F.col("n")).alias("text"))


TIES = (-1, 0, 1023, 1024, 1280, 1536, 1792, 1048575, 1048576, 1310720, 1073741824, 1099511627776, 1649267441664)


def _sizes(depth=0):
    def run(spark, sf_dir):
        out = caches.cache_sizes(catalog(spark, sf_dir), depth)
        return out.select("path", "size", "n_files", human_size(F.col("size")).alias("text"))

    return run


def _names(spark, sf_dir):
    """Every distinct segment of the catalogue's paths, judged."""
    names = catalog(spark, sf_dir).select(F.explode(F.split("rel", "/")).alias("name")).distinct()
    return names.select("name", is_cache_name(F.col("name")).alias("is_cache"))


def _parts(spark, sf_dir):
    return catalog(spark, sf_dir).select("abs", "rel", "name", parent_path(F.col("rel")).alias("parent"), F.col("depth").cast("bigint").alias("depth"))


def _plan(move_to):
    return lambda spark, sf_dir: plan_duplicates(_groups(spark, sf_dir), move_to)


def _junk_plan(spark, sf_dir):
    return plan_paths(junk.find_junk(catalog(spark, sf_dir)).select(F.col("abs").alias("path")), "delete").select("action", "path")


def _cache_plan(spark, sf_dir):
    return plan_paths(caches.find_cache_dirs(catalog(spark, sf_dir)), "empty").select("action", "path")


def _report_counts(spark, sf_dir):
    a, b = _trees(spark, sf_dir)
    out = compare.compare_summary(a, b, "off")
    for mode in ("smart", "strict"):
        out = out.unionByName(compare.compare_summary(a, b, mode))
    return out


def _odd_tail(n: int = 0):
    """The text of a byte that is no UTF-8, chosen by the path."""
    k = (F.length("rel") * 31 + F.ascii(F.right("rel", F.lit(5))) + n) % 128
    return F.get(F.array(*(F.lit(chr(FIRST + i)) for i in range(128))), k)


def _byte_names(spark, sf_dir):
    """Names of t0 with such a byte at the end: their text, their bytes, and their place in the order of bytes."""
    names = tree_of(catalog(spark, sf_dir), "t0").select(F.concat("rel", _odd_tail()).alias("rel"))
    placed = global_ordinal(names.withColumn("_bytes", byte_order(F.col("rel"))), ["_bytes"], "place")
    return placed.select("rel", F.hex("_bytes").alias("bytes"), "place")


def _byte_diff(spark, sf_dir):
    """Some paths of t0 with such a byte against the same paths of t1 with the next byte: none is the other's."""
    ends = lambda n: F.when(F.col("rel").startswith("m/"), F.concat("rel", _odd_tail(n))).otherwise(F.col("rel"))
    a, b = (t.withColumn("rel", ends(n)) for n, t in enumerate(_trees(spark, sf_dir)))
    return compare.compare_trees(a, b).select("side", F.hex(byte_order(F.col("rel"))).alias("bytes"))


def _nested_roots(spark, sf_dir):
    """Both trees, t1 again, one of its directories as a root of its own, and the root above both: every file once."""
    a, b = _trees(spark, sf_dir)
    inner = b.filter("rel like 'en/%'").withColumns({"root": F.lit("/data/t1/en"), "rel": F.substring("rel", 4, 4096)})
    return a.unionByName(b).unionByName(b).unionByName(inner)


def _overlapping(spark, sf_dir):
    return overlap.owned_once(_nested_roots(spark, sf_dir)).groupBy("root").agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"))


def _owners(spark, sf_dir):
    """Every directory of the catalogue as a root, with the outermost one at or above it that lies below a tree's own root."""
    dirs = rollup.directory_totals(catalog(spark, sf_dir)).filter("dir <> ''").select(F.concat_ws("/", "root", "dir").alias("root"))
    return overlap.root_owners(dirs)


def _distinct_targets(spark, sf_dir):
    return caches.find_cache_dirs(_nested_roots(spark, sf_dir), distinct_targets=True)


def _totals(spark, sf_dir):
    return rollup.directory_totals(catalog(spark, sf_dir)).select("tree", "dir", "n_files", "bytes", "depth")


def _arrivals(spark, sf_dir):
    stored = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    # a glob, as a stream takes a directory or a glob, and the table may be one file
    return catalog(spark, sf_dir, spark.readStream.schema(stored).parquet(f"{sf_dir}/documents.parque[t]"))


def _stream_junk(spark, sf_dir):
    return what_has_arrived(junk.find_junk(_arrivals(spark, sf_dir)).select(F.col("abs").alias("path")), "junk")


def _stream_dups(spark, sf_dir):
    """t1 arriving as a stream, t0 the reference."""
    found = stream_duplicates(tree_of(_arrivals(spark, sf_dir), "t1"), _trees(spark, sf_dir)[0])
    return what_has_arrived(found.select("reference_abs", "abs", "size"), "duplicates")


def _roots(spark, sf_dir):
    """A user for each source."""
    users = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("/home/"), "source").alias("home")).distinct()
    return roots_of_homes(users, "linux")


QUERIES = {
    "scan_catalog": lambda s, d: catalog(s, d).select("tree", "rel", "size", "hash"),
    "path_parts": _parts,
    "tree_counts": lambda s, d: compare.tree_counts(catalog(s, d)),
    "off_only_a": _only("off", False),
    "off_only_b": _only("off", True),
    "smart_only_a": _only("smart", False),
    "smart_only_b": _only("smart", True),
    "strict_only_a": _only("strict", False),
    "strict_only_b": _only("strict", True),
    "compare_all_off": _all("off"),
    "compare_all_smart": _all("smart"),
    "compare_all_strict": _all("strict"),
    "compare_missing_a": _all("off", "missing_a"),
    "compare_missing_b": _all("off", "missing_b"),
    "compare_summary": _report_counts,
    "size_diff": lambda s, d: compare.size_differences(*_trees(s, d)),
    "size_candidates": lambda s, d: compare.shared_sizes(*_trees(s, d)),
    "size_groups": lambda s, d: compare.size_groups(catalog(s, d)),
    "hash_set": lambda s, d: compare.hash_set(_trees(s, d)[0]),
    "dup_path": _dup("path"),
    "dup_path_name": _dup("path+name"),
    "dup_path_hash": _dup("path+hash"),
    "dup_hash": _dup("hash"),
    "dup_groups": lambda s, d: _groups(s, d).select("group_id", "reference_abs", "abs"),
    "dup_summary": _summary,
    "dup_plan_delete": _plan(""),
    "dup_plan_move": _plan("/moved"),
    "cleanup_union": _union,
    "junk_files": lambda s, d: junk.find_junk(catalog(s, d)).select(F.col("abs").alias("path")),
    "junk_by_pattern": lambda s, d: junk.junk_by_part(catalog(s, d)),
    "junk_plan": _junk_plan,
    "cache_match": _names,
    "cache_topmost": lambda s, d: caches.find_cache_dirs(catalog(s, d)),
    "cache_sizes": _sizes(),
    "cache_depth3": _sizes(3),
    "cache_total": lambda s, d: caches.cache_total(caches.cache_sizes(catalog(s, d))),
    "cache_plan": _cache_plan,
    "cache_roots": _roots,
    "cache_distinct_targets": _distinct_targets,
    "dir_totals": _totals,
    "overlapping_roots": _overlapping,
    "root_owners": _owners,
    "glob_files": lambda s, d: junk.find_named(catalog(s, d), GLOBS).select(F.col("abs").alias("path")),
    "byte_names": _byte_names,
    "byte_diff": _byte_diff,
    "stream_junk": _stream_junk,
    "stream_duplicates": _stream_dups,
    "empty_dirs_after_dedup": _empty,
    "empty_dirs_two_roots": _empty_two_roots,
    "cache_root_matches": _root_matches,
    "compare_order": _ordered_diff,
    "dup_order": _ordered_dups,
    "relative_path": lambda s, d: catalog(s, d).select("abs", relative_path(F.col("abs"), F.col("root")).alias("rel")),
    "human_size": _human,
}

CATALOG = """
WITH base AS (
  SELECT 't' || CAST(doc_id % 2 AS VARCHAR) AS tree,
    concat_ws('/', lang, 'd' || CAST(doc_id // 2 % 3 AS VARCHAR),
      CASE doc_id // 2 % 7 WHEN 0 THEN 'Package Cache' WHEN 1 THEN 'GPUCache' WHEN 2 THEN 'go' WHEN 3 THEN 'src'
        WHEN 4 THEN 'TempZXPSign01' WHEN 5 THEN 'golang' ELSE 'docs' END,
      CASE doc_id // 2 % 5 WHEN 0 THEN '.cache' WHEN 1 THEN 'pip' ELSE 'data' END,
      (CASE WHEN doc_id % 11 = 0 THEN '~$' WHEN doc_id % 13 = 0 THEN '~WRL' ELSE '' END) || 'f'
        || CAST(doc_id // 2 AS VARCHAR)
        || (CASE WHEN doc_id % 17 = 0 THEN '.tmpl' WHEN doc_id % 19 = 0 THEN '.bak' WHEN doc_id % 23 = 0 THEN '.TMP'
            ELSE '.txt' END)) AS rel,
    text AS content, strlen(text) AS size
  FROM documents),
sides AS (SELECT 't0' AS tree UNION ALL SELECT 't1'),
everything AS (
  SELECT * FROM base
  UNION ALL SELECT tree, 'm/f' || CAST(doc_id AS VARCHAR), text, strlen(text) FROM documents, sides WHERE doc_id % 10 = 0
  UNION ALL SELECT tree, 'x/f' || CAST(doc_id AS VARCHAR), text || tree, strlen(text) + 2 FROM documents, sides WHERE doc_id % 10 = 3
  UNION ALL SELECT 't0', 'u/f' || CAST(doc_id AS VARCHAR), NULL, strlen(text) FROM documents WHERE doc_id % 25 = 1),
cat AS (
  SELECT tree, '/data/' || tree AS root, rel, '/data/' || tree || '/' || rel AS abs, string_split(rel, '/')[-1] AS name,
    len(string_split(rel, '/')) AS depth, CAST(size AS BIGINT) AS size, sha256(content) AS hash FROM everything),
a AS (SELECT * FROM cat WHERE tree = 't0'), b AS (SELECT * FROM cat WHERE tree = 't1')"""


def _only_sql(mode: str, x: str, y: str) -> str:
    no_path = f"NOT EXISTS (SELECT 1 FROM {y} q WHERE q.rel = p.rel)"
    no_hash = f"NOT EXISTS (SELECT 1 FROM {y} q WHERE q.hash = p.hash)"
    test = {"off": no_path, "smart": f"{no_path} AND {no_hash}", "strict": no_hash}[mode]
    return f"SELECT rel FROM {x} p WHERE {test}"


def _all_sql(mode: str) -> str:
    a, b = _only_sql(mode, "a", "b"), _only_sql(mode, "b", "a")
    return f"SELECT 'a' AS side, rel FROM ({a}) UNION ALL SELECT 'b', rel FROM ({b})"


def _dup_sql(mode: str) -> str:
    keys = dedup.MODE_KEYS[mode]
    on = " AND ".join(f"r.{k} = c.{k}" for k in keys)
    return (
        f"SELECT r.reference_abs, c.abs, c.size, c.rel FROM b c JOIN (SELECT {', '.join(keys)}, min(abs) AS reference_abs "
        f"FROM a GROUP BY {', '.join(keys)}) r ON {on}"
    )


def _summary_sql(mode: str) -> str:
    return (
        f"SELECT '{mode}' AS mode, count(DISTINCT reference_abs) AS n_groups, count(*) AS n_duplicates, "
        f"CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM ({_dup_sql(mode)})"
    )


_GROUPS = f"SELECT dense_rank() OVER (ORDER BY reference_abs) AS group_id, reference_abs, abs FROM ({_dup_sql('hash')})"


def _cache_test(s: str) -> str:
    low = f"lower({s})"
    return (
        f"({low} NOT IN ('package cache', 'slstore') AND (contains({low}, 'cache') OR {low} IN ('pip', 'consentoptions', "
        f"'webkit', 'bluestacks', 'pypa', 'squirreltemp', 'go', 'go-build', 'vcpkg') OR starts_with({low}, 'tempzxpsign') "
        f"OR starts_with({low}, 'photoshop temp') OR starts_with({low}, 'adobetemp')))"
    )


def _human_sql(n: str) -> str:
    even = lambda q, r, u: f"({q} + CASE WHEN {r} * 2 > {u} OR ({r} * 2 = {u} AND {q} % 2 <> 0) THEN 1 ELSE 0 END)"
    cases = []
    for k, (big, small) in ((4, ("TB", "GB")), (3, ("GB", "MB")), (2, ("MB", "KB")), (1, ("KB", "B"))):
        u, v = f"CAST({1024**k} AS HUGEINT)", f"CAST({1024 ** (k - 1)} AS HUGEINT)"
        t = even(f"(CAST({n} AS HUGEINT) * 10 // {u})", f"(CAST({n} AS HUGEINT) * 10 % {u})", u)
        s = even(f"({n} // {v})", f"({n} % {v})", v) if k > 1 else n
        cases.append(
            f"WHEN {n} >= {1024**k} THEN CAST({t} // 10 AS VARCHAR) || '.' || CAST({t} % 10 AS VARCHAR) || ' {big} (' "
            f"|| CAST({s} AS VARCHAR) || ' {small})'"
        )
    return f"CASE {' '.join(cases)} ELSE CAST({n} AS VARCHAR) || ' B' END"


def _cache_sql(depth: int = 0) -> str:
    limit = f" AND i <= {depth}" if depth else ""
    return f"""
SELECT '/data/' || tree || '/' || array_to_string(seg[1:i], '/') AS path, CAST(sum(size) AS BIGINT) AS size, count(*) AS n_files
FROM (SELECT tree, size, seg, list_min(list_filter(range(1, len(seg) + 1), lambda i: {_cache_test('seg[i]')}{limit})) AS i
      FROM (SELECT tree, size, string_split(rel, '/')[1:-2] AS seg FROM cat)) WHERE i IS NOT NULL GROUP BY 1"""


def _part_sql(part: str) -> str:
    return (
        f"SELECT '{part}' AS part, count(*) AS n_files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes "
        f"FROM cat WHERE contains(name, '{part}')"
    )


_ODD = "(length(rel) * 31 + ascii(right(rel, 5)))"
_JUNK = " OR ".join(f"contains(name, '{p}')" for p in JUNK_PARTS)
_ABOVE = "SELECT DISTINCT array_to_string(string_split(rel, '/')[1:i], '/') AS dir FROM {0}, (SELECT unnest(range(0, 20)) AS i) WHERE i < len(string_split(rel, '/'))"


def _summary_row(mode: str) -> str:
    count = lambda q: f"(SELECT count(*) FROM ({q}))"
    return (
        f"SELECT '{mode}' AS mode, (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, "
        f"{count(_only_sql(mode, 'a', 'b'))} AS only_a, {count(_only_sql(mode, 'b', 'a'))} AS only_b"
    )


_BODY = {
    "scan_catalog": "SELECT tree, rel, size, hash FROM cat",
    "path_parts": "SELECT abs, rel, name, array_to_string(string_split(rel, '/')[1:-2], '/') AS parent, CAST(depth AS BIGINT) AS depth FROM cat",
    "tree_counts": "SELECT tree, count(*) AS n_files FROM cat GROUP BY tree",
    **{f"{m}_only_{s}": _only_sql(m, s, t) for m in compare.MODES for s, t in (("a", "b"), ("b", "a"))},
    **{f"compare_all_{m}": _all_sql(m) for m in compare.MODES},
    "compare_missing_a": f"SELECT 'b' AS side, rel FROM ({_only_sql('off', 'b', 'a')})",
    "compare_missing_b": f"SELECT 'a' AS side, rel FROM ({_only_sql('off', 'a', 'b')})",
    "compare_summary": " UNION ALL ".join(_summary_row(m) for m in compare.MODES),
    "size_diff": "SELECT a.rel, a.size AS size_a, b.size AS size_b FROM a JOIN b ON a.rel = b.rel WHERE a.size <> b.size",
    "size_candidates": "SELECT size FROM a INTERSECT SELECT size FROM b",
    "size_groups": "SELECT tree, size, count(*) AS n_files, min(rel) AS first_rel, max(rel) AS last_rel FROM cat GROUP BY tree, size",
    "hash_set": "SELECT DISTINCT hash FROM a WHERE hash IS NOT NULL",
    **{
        f"dup_{n}": f"SELECT reference_abs, abs, size FROM ({_dup_sql(m)})"
        for n, m in (("path", "path"), ("path_name", "path+name"), ("path_hash", "path+hash"), ("hash", "hash"))
    },
    "dup_groups": _GROUPS,
    "dup_summary": " UNION ALL ".join(_summary_sql(m) for m in dedup.MODE_KEYS),
    "dup_plan_delete": f"SELECT group_id, 'delete' AS action, abs AS path, CAST(NULL AS VARCHAR) AS dest, false AS collides FROM ({_GROUPS})",
    "dup_plan_move": f"""SELECT group_id, 'move' AS action, path, dest, count(*) OVER (PARTITION BY dest) > 1 AS collides
FROM (SELECT group_id, abs AS path, '/moved/' || string_split(abs, '/')[-1] AS dest FROM ({_GROUPS}))""",
    "cleanup_union": "SELECT root, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT * FROM cat UNION ALL SELECT * FROM b) GROUP BY root",
    "junk_files": f"SELECT abs AS path FROM cat WHERE {_JUNK}",
    "junk_by_pattern": " UNION ALL ".join(_part_sql(p) for p in JUNK_PARTS),
    "junk_plan": f"SELECT 'delete' AS action, abs AS path FROM cat WHERE {_JUNK}",
    "cache_match": f"SELECT name, {_cache_test('name')} AS is_cache FROM (SELECT DISTINCT unnest(string_split(rel, '/')) AS name FROM cat)",
    "cache_topmost": f"SELECT path FROM ({_cache_sql()})",
    "cache_sizes": f"SELECT path, size, n_files, {_human_sql('size')} AS text FROM ({_cache_sql()})",
    "cache_depth3": f"SELECT path, size, n_files, {_human_sql('size')} AS text FROM ({_cache_sql(3)})",
    "cache_total": f"SELECT n_targets, bytes, {_human_sql('bytes')} AS text FROM (SELECT count(*) AS n_targets, CAST(sum(size) AS BIGINT) AS bytes FROM ({_cache_sql()}))",
    "cache_plan": f"SELECT 'empty' AS action, path FROM ({_cache_sql()})",
    "cache_roots": """SELECT root, max_depth FROM (VALUES ('/tmp', 0), ('/var/tmp', 0)) v(root, max_depth) WHERE EXISTS (SELECT 1 FROM documents WHERE source IS NOT NULL)
UNION ALL SELECT DISTINCT '/home/' || source || '/.cache', 0 FROM documents WHERE source IS NOT NULL""",
    "cache_distinct_targets": f"SELECT path FROM ({_cache_sql()})",
    "dir_totals": f"""SELECT tree, dir, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS bytes, CAST(CASE WHEN dir = '' THEN 0 ELSE len(string_split(dir, '/')) END AS INTEGER) AS depth
FROM (SELECT tree, size, array_to_string(string_split(rel, '/')[1:i], '/') AS dir FROM cat, (SELECT unnest(range(0, 20)) AS i) WHERE i < len(string_split(rel, '/'))) GROUP BY tree, dir""",
    "overlapping_roots": "SELECT root, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS bytes FROM cat GROUP BY root",
    "root_owners": f"""SELECT '/data/' || tree || '/' || dir AS root, '/data/' || tree || '/' || string_split(dir, '/')[1] AS owner
FROM (SELECT 't0' AS tree, dir FROM ({_ABOVE.format('a')}) UNION ALL SELECT 't1', dir FROM ({_ABOVE.format('b')})) WHERE dir <> ''""",
    "glob_files": r"""SELECT abs AS path FROM cat WHERE regexp_full_match(name, 'f[0-4].*\.txt|.*[^t]|~[!$].*|f.7\..*|~WRL.*\.[a-c].k|~\$f1.*')""",
    "byte_names": f"""SELECT rel || chr(CAST({FIRST} + k AS INTEGER)) AS rel, hex(encode(rel)) || printf('%02X', 128 + k) AS bytes,
  row_number() OVER (ORDER BY hex(encode(rel)) || printf('%02X', 128 + k)) AS place FROM (SELECT rel, {_ODD} % 128 AS k FROM a)""",
    "byte_diff": f"""SELECT side, bytes FROM (WITH x AS (SELECT hex(encode(rel)) || CASE WHEN starts_with(rel, 'm/') THEN printf('%02X', 128 + {_ODD} % 128) ELSE '' END AS bytes FROM a),
y AS (SELECT hex(encode(rel)) || CASE WHEN starts_with(rel, 'm/') THEN printf('%02X', 128 + ({_ODD} + 1) % 128) ELSE '' END AS bytes FROM b)
SELECT 'a' AS side, bytes FROM x WHERE bytes NOT IN (SELECT bytes FROM y) UNION ALL SELECT 'b', bytes FROM y WHERE bytes NOT IN (SELECT bytes FROM x))""",
    "stream_junk": f"SELECT abs AS path FROM cat WHERE {_JUNK}",
    "stream_duplicates": f"SELECT reference_abs, abs, size FROM ({_dup_sql('hash')})",
    "empty_dirs_after_dedup": f"""SELECT dir, CAST(CASE WHEN dir = '' THEN 0 ELSE len(string_split(dir, '/')) END AS INTEGER) AS depth
FROM ({_ABOVE.format('b')}) WHERE dir NOT IN (SELECT dir FROM ({_ABOVE.format('(SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.hash = b.hash)) kept')}))""",
    "empty_dirs_two_roots": f"""SELECT '/data/t1' AS root, dir, CAST(CASE WHEN dir = '' THEN 0 ELSE len(string_split(dir, '/')) END AS INTEGER) AS depth
FROM ({_ABOVE.format('b')}) WHERE dir NOT IN (SELECT dir FROM ({_ABOVE.format('(SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.hash = b.hash)) kept')}))""",
    "cache_root_matches": f"""SELECT '/home/user/.cache' AS root, '' AS match, '/home/user/.cache' AS path, CAST(sum(size) AS BIGINT) AS size, count(*) AS n_files FROM b
UNION ALL SELECT '/srv/package cache', path[10:], '/srv/package cache/' || path[10:], size, n_files FROM ({_cache_sql()}) WHERE starts_with(path, '/data/t0/')""",
    "compare_order": f"SELECT side, rel, row_number() OVER (ORDER BY side, rel) AS place FROM ({_all_sql('off')})",
    "dup_order": f"SELECT group_id, abs, row_number() OVER (ORDER BY group_id, abs) AS place FROM ({_GROUPS})",
    "relative_path": "SELECT abs, rel FROM cat",
    "human_size": f"""SELECT n, {_human_sql('n')} AS text FROM (
SELECT size * k AS n FROM (SELECT DISTINCT size FROM cat), (SELECT unnest([{', '.join(f'CAST({1024**k} AS BIGINT)' for k in range(5))}]) AS k)
UNION SELECT unnest([{', '.join(f'CAST({v} AS BIGINT)' for v in TIES)}]))""",
}

ORACLE_SQL = {k: f"{CATALOG}\n{v}" for k, v in _BODY.items()}
