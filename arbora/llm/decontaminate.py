"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions alone.

Each benchmark item gives windows of WINDOW consecutive words (a shorter item is one window). To contain a window a
document must contain all its shingles, so the prefix that the set-join bound asks for is one shingle: the rarest one,
by its count over all documents. One pass over the texts finds the places of the windows' shingles, as (row, place,
shingle) without the texts; they give the counts, and those of rarest shingles are the candidates: each fixes where the
window would have to start. The length and positional bounds drop those that don't fit. Only rows with a candidate are
then read again, and the words there are compared exactly.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased. Windows are broadcast only if there are at
most BROADCAST_WINDOWS of them and BROADCAST_BYTES of words and ids, else joined by shuffle, and candidate rows' keys if there are at most
BROADCAST_ROWS. Shingles are exploded and filtered within one generated loop: nothing is built for those that meet no window.

A null text has no words and is clean; an item without words has no window; a null item_id hits but isn't listed;
repeated rows get equal results, repeated items count once; a text of any length is one row's words; extra columns don't
matter; empty tables give no rows.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.common import lower_ascii, row_key, table
from arbora.staging import stage

WINDOW, SHINGLE, BROADCAST_WINDOWS, BROADCAST_BYTES, BROADCAST_ROWS = 10, 3, 200_000, 64 << 20, 200_000
#: what parts words; A-Z belong to words, as they do once lower-cased
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text in their own case; null for a null text."""
    return F.array_remove(F.split(text, BREAK), "")


def _key(words: Column, at: Column, n: int) -> Column:
    """Hash of the n words from the 0-based place in lower case.

    lower() folds all of Unicode in one fast pass where only A-Z are asked for, so equal windows always share keys
    and the exact comparison decides. Past the end the hash is of fewer words; the positional bound drops those.
    """
    return F.xxhash64(*(F.lower(F.get(words, at + i)) for i in range(n)))


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(win_id, item_id, win, len, k): distinct windows, words lower-cased (A-Z), and the shingle length for them."""
    items = benchmark.select("item_id", words_of(lower_ascii(F.col("text"))).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    rows = items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("win")).distinct()
    rows = rows.withColumn("len", F.size("win")).withColumn("k", F.least("len", F.lit(SHINGLE)))
    return rows.withColumn("win_id", F.md5(F.array_join("win", " ")))


def _hint(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def _places(docs: DataFrame, vocabulary: DataFrame, ks: list[int], small: bool) -> DataFrame:
    """(key, p, k, s): rows of docs (key, w) have the shingle s of k words, one of the vocabulary's, at the 0-based place p.

    The outer form of explode keeps the optimizer from adding a filter that would split every text twice.
    """
    at = docs.select("key", "w", F.posexplode_outer("w").alias("p", "_first"))
    parts = []
    for k in ks:
        said = at.select("key", "p", _key(F.col("w"), F.col("p"), k).alias("s"))
        parts.append(said.join(_hint(vocabulary.filter(F.col("k") == k), small), "s").select("key", "p", "k", "s"))
    return reduce(DataFrame.unionByName, parts)


def hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(key, start, len, item_id): every place of every window in documents (key, w)."""
    wins = stage(windows(benchmark, size), "windows")
    width = F.octet_length(F.array_join("win", " ")) + F.coalesce(F.octet_length(F.col("item_id").cast("string")), F.lit(0))
    shape = wins.agg(F.count("*"), F.collect_set("k"), F.coalesce(F.sum(width), F.lit(0))).first()
    small, ks = shape[0] <= BROADCAST_WINDOWS and shape[2] <= BROADCAST_BYTES, sorted(shape[1]) or [SHINGLE]
    shingles = reduce(
        DataFrame.unionByName,
        (
            wins.filter(F.col("k") == k)
            .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("len") - k)))
            .withColumn("s", _key(F.col("win"), F.col("o"), k))
            for k in ks
        ),
    ).drop("item_id").distinct()
    shingles = stage(shingles, "shingles")
    found = stage(_places(docs, shingles.select("k", "s").distinct(), ks, small), "places")
    # the prefix of a window: its rarest shingle; a window with an unseen one can't occur
    seen = found.groupBy("k", "s").agg(F.count("*").alias("df"))
    ranked = shingles.join(_hint(seen, small), ["k", "s"])
    rarest = ranked.groupBy("win_id", "win", "len", "k").agg(F.min(F.struct("df", "s", "o")).alias("r"), F.count("*").alias("n_seen"))
    rarest = rarest.filter("n_seen = len - k + 1").select("win_id", F.array_join("win", " ").alias("said"), "len", "k", "r.s", "r.o")
    cand = found.join(_hint(rarest, small), ["k", "s"]).withColumn("start", F.col("p") - F.col("o")).filter("start >= 0")
    cand = stage(cand.select("key", "start", "len", "said", "win_id").distinct(), "candidates")
    rows = stage(cand.select("key").distinct(), "rows")
    few = rows.count() <= BROADCAST_ROWS
    # repeated rows are read once: they get equal results
    texts = stage(docs.join(_hint(rows, few), "key", "left_semi").dropDuplicates(["key"]), "texts")
    there = lower_ascii(F.array_join(F.slice("w", F.col("start") + 1, F.col("len")), " "))
    fits = (F.col("start") + F.col("len") <= F.size("w")) & (there == F.col("said"))
    sure = cand.join(texts, "key").filter(fits).select("key", "start", "len", "win_id")
    return sure.join(_hint(wins.select("win_id", "item_id"), small), "win_id").select("key", "start", "len", "item_id")


def _hit_words(spans: Column) -> Column:
    """Words covered by (start, len) spans, sorted by start."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(a, s):
        end = s["start"] + s["len"]
        return F.struct((a["n"] + F.greatest(end - F.greatest(a["end"], s["start"]), F.lit(0))).alias("n"), F.greatest(a["end"], end).alias("end"))

    return F.aggregate(spans, zero, step, lambda a: a["n"].cast("long"))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """key, n_hit, items (sorted ids as strings) of the contaminated documents among rows (doc_id, text)."""
    keyed = docs.select(row_key().alias("key"), words_of(F.col("text")).alias("w"))
    found = hits(keyed, benchmark, size)
    return found.groupBy("key").agg(
        F.sort_array(F.collect_set(F.struct("start", "len"))).alias("spans"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items")
    ).select("key", _hit_words(F.col("spans")).alias("n_hit"), "items")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold no window of any item, with their columns."""
    bad = contamination(docs.select("doc_id", "text"), benchmark).select(F.col("key").alias("_bad_key"))
    return docs.join(bad, row_key() == F.col("_bad_key"), "left_anti")


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n_words = F.when(F.col("text").isNull(), 0).otherwise(F.size(words_of(F.col("text")))).cast("long")
    base = docs.select("doc_id", row_key().alias("key"), n_words.alias("n_words"))
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    out = base.join(found, "key", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
    FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
h AS (SELECT rid, i, win.n, item_id FROM p JOIN win ON p.n = win.n AND p.s = win.s),
c AS (SELECT rid, count(DISTINCT x) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS x FROM h) GROUP BY rid),
k AS (SELECT rid, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS t FROM h) GROUP BY rid)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN k USING (rid)
"""
