"""How far the sources of a language are apart, and by which terms: DuckDB over shards, Spark over what they return.

1. Each task counts its texts' terms by (lang, source, term) in DuckDB, with the documents that hold them, and passes on sums.
2. The counts are hashed by (lang, term) into shards. DuckDB adds them up there and keeps the terms that a lang has in enough
   documents. Spark adds up the totals of groups and langs.
3. With the totals, each shard makes partial sums for the pairs of sources that share a term, the ten furthest terms of each
   source, and how often each smoothed share occurs. Spark adds up and ranks.

A term counts for every pair, also where neither source has it. With g(c, d) the divergence of counts c and d, a pair's sum is
V g(0, 0) + sum over terms that the first has of (g(c, 0) - g(0, 0)) + the same for the second + sum over shared terms of
(g(c, d) - g(c, 0) - g(0, d) + g(0, 0)). The two in the middle need only the distinct counts of a source, the last only shared
terms, so the work follows the occurrences and not terms times pairs. All arithmetic is on integers.

Terms are `[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`, A-Z lower-cased. A null text, lang or source is ''. A group without terms has
counts of 0. Repeated rows are documents of their own; equal values go by item; a text of any length is one row of a slice of
its own; extra columns don't matter; no rows, no result. A lang without kept terms has pairs of value 0 and no terms.
"""

import tempfile
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.llm.bytework import string_chunks
from arbora.llm.common import table, text_or_empty
from arbora.staging import stage

LEAST_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
SLICE, KEEP, MEMORY = 8 << 20, 1_000_000, "500MB"
BROADCAST_GROUPS = 50_000

#: What a byte of a text is in its terms: itself in lower case, or a space between terms.
TERM = np.full(256, 32, np.uint8)
TERM[97:123] = TERM[65:91] = np.arange(97, 123)
TERM[128:] = np.arange(128, 256)


class Shard:
    """A DuckDB in memory (spilling to the task's own temp folder) with one table that Arrow rows are added to."""

    def __init__(self, columns: str):
        self.folder = tempfile.TemporaryDirectory()
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": self.folder.name})
        self.con.execute(f"CREATE TABLE held ({columns})")
        self.con.execute("CREATE MACRO apart(a, b) AS (a - b) * (a - b) // (a + b)")
        self.rows = 0

    def add(self, batch: pa.RecordBatch | pa.Table, query: str = "SELECT * FROM batch") -> None:
        self.con.register("batch", batch if isinstance(batch, pa.Table) else pa.Table.from_batches([batch]))
        self.rows += self.con.execute(f"INSERT INTO held {query}").fetchone()[0]
        self.con.unregister("batch")

    def batches(self, query: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        yield from self.con.sql(query).to_arrow_table().cast(schema).to_batches(max_chunksize=1 << 16)

    def clear(self) -> None:
        self.con.execute("DELETE FROM held")
        self.rows = 0

    def __enter__(self) -> "Shard":
        return self

    def __exit__(self, *_) -> None:
        self.con.close()
        self.folder.cleanup()


def _schema(columns: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[t]) for n, t in (c.split() for c in columns.split(", "))])


def _duck(columns: str) -> str:
    return columns.replace("string", "VARCHAR").replace("long", "BIGINT")


PARTIAL = "lang string, source string, term string, docs long, n long"
_COUNT = """SELECT lang, source, term, count(*), sum(n) FROM (
  SELECT any_value(lang) AS lang, any_value(source) AS source, term, count(*) AS n
  FROM (SELECT line, lang, source, unnest(string_split(said, ' ')) AS term FROM batch) WHERE term <> '' GROUP BY line, term)
GROUP BY lang, source, term"""


def partial_counts(docs: DataFrame) -> DataFrame:
    """PARTIAL rows of (lang, source, text): sums over each task's documents, or over KEEP rows of them if they are more."""
    schema = _schema(PARTIAL)
    added_up = "SELECT lang, source, term, CAST(sum(docs) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS n FROM held GROUP BY ALL"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Shard(_duck(PARTIAL)) as shard:
            for b in batches:
                for first, data, offsets in string_chunks(b.column("text"), SLICE):
                    said = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(TERM[data]))
                    some = b.slice(first, len(said))
                    shard.add(pa.table({"line": np.arange(len(said)), "lang": some.column("lang"), "source": some.column("source"), "said": said}), _COUNT)
                    if shard.rows > KEEP:
                        yield from shard.batches(added_up, schema)
                        shard.clear()
            yield from shard.batches(added_up, schema)

    return docs.select("lang", "source", "text").mapInArrow(run, PARTIAL)


KEPT = "lang string, term string, source string, n long, total long, lead boolean"


def kept_counts(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """KEPT rows: occurrences of kept terms by source, with those in the lang; `lead` marks one row of each (lang, term)."""
    schema = _schema(KEPT)
    query = f"""WITH k AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS total, min(source) AS first FROM held GROUP BY lang, term HAVING sum(docs) >= {least_docs}),
      s AS (SELECT lang, term, source, CAST(sum(n) AS BIGINT) AS n FROM held GROUP BY lang, term, source)
      SELECT lang, term, source, n, total, source = first AS lead FROM s JOIN k USING (lang, term)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Shard(_duck(PARTIAL)) as shard:
            for b in batches:
                shard.add(b)
            yield from shard.batches(query, schema)

    return counts.repartition("lang", "term").mapInArrow(run, KEPT)


JOINED = "lang string, term string, source string, n long, total long, group_n long, lang_n long, v long"
FOUND = "kind string, lang string, a string, b string, value long, n long"


def shard_sums(joined: DataFrame, top: int = TOP) -> DataFrame:
    """FOUND rows of JOINED ones, by kind: `pair` (sources a < b, sum over shared terms), `share` (of source a, value times n),
    `term` (the furthest terms b of source a in this shard)."""
    schema = _schema(FOUND)
    share = lambda count, of: f"CAST(1 + (CAST({SCALE} AS HUGEINT) * ({count} + 2)) // ({of} + 2 * v) AS BIGINT)"
    view = f"CREATE VIEW p AS SELECT lang, term, source, {share('n', 'group_n')} AS p, {share('0', 'group_n')} AS none, {share('total', 'lang_n')} AS q FROM held"
    query = f"""
      SELECT 'pair' AS kind, x.lang AS lang, x.source AS a, y.source AS b,
        CAST(sum(apart(x.p, y.p) - apart(x.p, y.none) - apart(x.none, y.p) + apart(x.none, y.none)) AS BIGINT) AS value, count(*) AS n
      FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source < y.source GROUP BY 2, 3, 4
      UNION ALL SELECT 'share', lang, source, NULL, p, count(*) FROM p GROUP BY lang, source, p
      UNION ALL SELECT 'term', lang, source, term, value, 1 FROM (
        SELECT lang, source, term, apart(p, q) AS value, row_number() OVER (PARTITION BY lang, source ORDER BY apart(p, q) DESC, term) AS nth
        FROM p WHERE p > q) WHERE nth <= {top}"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Shard(_duck(JOINED)) as shard:
            for b in batches:
                shard.add(b)
            shard.con.execute(view)
            yield from shard.batches(query, schema)

    return joined.repartition("lang", "term").mapInArrow(run, FOUND)


def _apart(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: other sources (part `pair`, all ranks) and own terms (`term`, to rank `top`)."""
    docs = docs.select(*(text_or_empty(c).alias(c) for c in ("lang", "source", "text")))
    kept = stage(kept_counts(partial_counts(docs), least_docs), "kept")
    langs = kept.groupBy("lang").agg(F.count_if("lead").alias("v"), F.sum(F.when(F.col("lead"), F.col("total"))).alias("lang_n"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["group_n", "lang_n", "v"])
    groups = stage(groups.withColumn("none", F.expr(f"case when v > 0 then 1 + {2 * SCALE} div (group_n + 2 * v) else 1 end")), "groups")
    small = groups.count() <= BROADCAST_GROUPS
    hint = F.broadcast if small else lambda df: df
    columns = [c.split()[0] for c in JOINED.split(", ")]
    found = stage(shard_sums(kept.join(hint(groups), ["lang", "source"]).select(columns), top), "sums")

    other = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("other"))
    base = groups.join(hint(other), "lang").filter("source <> item").select("lang", "source", "item", (F.col("v") * _apart("none", "other")).alias("value"))
    shares = found.filter("kind = 'share'").groupBy("lang", F.col("a").alias("source"), F.col("value").alias("p")).agg(F.sum("n").alias("n"))
    shares = shares.join(hint(groups.select("lang", "source", "none")), ["lang", "source"]).join(hint(other), "lang").filter("source <> item")
    alone = shares.groupBy("lang", "source", "item").agg(F.sum(F.col("n") * (_apart("p", "other") - _apart("none", "other"))).alias("value"))
    shared = found.filter("kind = 'pair'").groupBy("lang", F.col("a").alias("source"), F.col("b").alias("item")).agg(F.sum("value").alias("value"))
    both_ways = alone.unionByName(shared)
    both_ways = both_ways.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("_p"), "value")
    pairs = base.unionByName(both_ways.select("lang", "_p.source", "_p.item", "value")).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    terms = found.filter("kind = 'term'").select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value")

    nth = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = [pairs.withColumn("rank", nth).withColumn("part", F.lit("pair")), terms.withColumn("rank", nth).filter(F.col("rank") <= top).withColumn("part", F.lit("term"))]
    return ranked[0].unionByName(ranked[1]).select("lang", "source", "part", "item", "value", "rank")


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: terms in at least 10 documents of their lang."""
    return audit(table(spark, sf_dir, "documents"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT lang, source, rid, term, count(*) AS n FROM (SELECT rid, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS n FROM t GROUP BY ALL HAVING count(*) >= {LEAST_DOCS}),
l AS (SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, CAST(coalesce(sum(t.n), 0) AS BIGINT) AS n, k.n AS total FROM g JOIN k USING (lang) LEFT JOIN t ON t.lang = g.lang AND t.source = g.source AND t.term = k.term GROUP BY ALL),
s AS (SELECT lang, source, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY ALL),
p AS (SELECT c.lang, c.source, c.term, c.n, CAST(1 + (CAST({SCALE} AS HUGEINT) * (c.n + 2)) // (s.n + 2 * l.v) AS BIGINT) AS p,
    CAST(1 + (CAST({SCALE} AS HUGEINT) * (c.total + 2)) // (l.n + 2 * l.v) AS BIGINT) AS q
  FROM c JOIN s USING (lang, source) JOIN l USING (lang)),
pairs AS (SELECT x.lang, x.source, y.source AS item, CAST(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS BIGINT) AS value
  FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
everything AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM everything)
WHERE part = 'pair' OR rank <= {TOP}
"""
