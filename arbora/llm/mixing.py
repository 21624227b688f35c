"""Mixing sources to target weights by Poisson replication.

A source of n rows with target weight w gets a mean repetition rate of w * budget / n; each row is repeated as often
as a Poisson draw of that mean says, found by inverting the distribution at a uniform number hashed from the row and a
seed. Draws need no state: they can be recomputed anywhere and don't change when other rows do. Copies are dealt out
by a hash of row and copy and sorted by it within partitions: a global shuffle in one exchange.

The rates, one row a source, are counted and then broadcast if there are at most BROADCAST_SOURCES of them (about 1 KB each);
beyond that they are joined by source and a salt of the row, so that a source of any size is dealt over SALTS parts.

A mean above 16 is drawn as a sum of several equal Poisson draws. Null sources form one source of their own; null ids
and texts hash like values, rows equal in both draw alike, and their copies tie in no other way; a text of any length is
only hashed; sources without rows count for nothing; no rows, no result.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.common import packed, table, unpacked
from arbora.staging import stage

SEED, ALPHA, PIECE, TERMS = 7, 0.5, 16.0, 120
BROADCAST_SOURCES, SALTS = 10_000, 64


def _uniform(key: Column, *more: Column) -> Column:
    """52 bits of an MD5 as a number in [0, 1)."""
    digits = F.substring(F.md5(F.concat_ws("|", key, F.lit(str(SEED)), *more)), 1, 13)
    return F.conv(digits, 16, 10).cast("long").cast("double") / F.lit(float(2**52))


def _distribution(mean: Column) -> Column:
    """Cumulative Poisson probabilities of 0, 1, .. for a mean of at most PIECE."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        start,
        lambda s, k: F.struct(
            (s["p"] * mean / k).alias("p"), F.array_append(s["c"], F.element_at(s["c"], -1) + s["p"] * mean / k).alias("c")
        ),
        lambda s: s["c"],
    )


def rates(docs: DataFrame, weights: DataFrame | None = None, alpha: float = ALPHA, budget: float | None = None) -> DataFrame:
    """(src, n, rate) for each source of docs; src is null-safe ('s' + source, or 'n').

    weights: (source, weight) rows, which need not sum to 1 and in which a missing source weighs 0; None: weights
    in proportion to n ** alpha. budget: rows wanted in all; None: as many as there are.
    """
    src = lambda c: F.coalesce(F.concat(F.lit("s"), c), F.lit("n"))
    n = docs.groupBy(src(F.col("source")).alias("src")).agg(F.count("*").alias("n"))
    if weights is None:
        n = n.withColumn("w", F.pow("n", F.lit(alpha)))
    else:
        given = weights.groupBy(src(F.col("source")).alias("src")).agg(F.sum("weight").cast("double").alias("w"))
        n = n.join(given, "src", "left").fillna({"w": 0.0})
    all_n, all_w = n.agg(F.sum("n")).scalar(), n.agg(F.sum("w")).scalar()
    wanted = all_n if budget is None else F.lit(float(budget))
    return n.select("src", "n", F.coalesce(wanted * F.try_divide(F.col("w"), all_w) / F.col("n"), F.lit(0.0)).alias("rate"))


def mix(docs: DataFrame, weights: DataFrame | None = None, alpha: float = ALPHA, budget: float | None = None) -> DataFrame:
    """docs repeated to the target weights, with `copy` (0..) and `shuffle_key` (rows lie in its order within files)."""
    per = stage(rates(docs, weights, alpha, budget).withColumnRenamed("src", "_src"), "rates")
    few = per.count() <= BROADCAST_SOURCES
    pieces = F.greatest(F.ceil(F.col("rate") / PIECE), F.lit(1)).cast("int")
    per = per.withColumn("_pieces", pieces).select("_src", "_pieces", _distribution(F.col("rate") / F.col("_pieces")).alias("_cdf"))
    row = F.col("_arbora_row")
    key = F.md5(F.concat_ws("|", row["doc_id"].cast("string"), F.md5(F.coalesce(row["text"], F.lit("")))))
    rows = packed(docs).withColumn("_src", F.coalesce(F.concat(F.lit("s"), row["source"]), F.lit("n"))).withColumn("_key", key)
    if few:
        met = rows.join(F.broadcast(per), "_src")
    else:
        salted = per.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = rows.withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(SALTS)).cast("int")).join(salted, ["_src", "_salt"])
    # the draws first, one hash each; then each is looked up in the distribution
    draws = F.transform(F.sequence(F.lit(1), F.col("_pieces")), lambda j: _uniform(F.col("_key"), j.cast("string")))
    counts = F.transform(draws, lambda u: F.size(F.filter("_cdf", lambda c: c <= u)))
    times = F.aggregate(counts, F.lit(0), lambda a, b: a + b)
    drawn = met.select("_arbora_row", "_key", times.alias("_times")).filter("_times > 0")
    copies = drawn.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_times").cast("long") - 1)))
    copies = copies.withColumn("shuffle_key", F.md5(F.concat_ws("|", "_key", F.lit(f"copy{SEED}"), F.col("copy").cast("string"))))
    dealt = copies.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    return unpacked(dealt, "copy", "shuffle_key")


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, source weights in proportion to the square root of their size, as many rows as before."""
    return mix(table(spark, sf_dir, "documents"))


SQL = f"""
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, sum(n) OVER () * (pow(n, {ALPHA}) / sum(pow(n, {ALPHA})) OVER ()) / n AS rate FROM n),
p AS (SELECT source, rate / greatest(ceil(rate / {PIECE}), 1) AS mean, CAST(greatest(ceil(rate / {PIECE}), 1) AS BIGINT) AS pieces FROM r),
k AS (SELECT d.*, mean, md5(concat_ws('|', CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS key, unnest(range(1, pieces + 1)) AS j
      FROM documents d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
u AS (SELECT *, CAST('0x' || substr(md5(key || '|{SEED}|' || CAST(j AS VARCHAR)), 1, 13) AS BIGINT) / pow(2.0, 52) AS u FROM k),
terms AS (SELECT mean, i, sum(exp(-mean + i * ln(mean) - lgamma(i + 1))) OVER (PARTITION BY mean ORDER BY i) AS c
          FROM (SELECT DISTINCT mean FROM p), (SELECT unnest(range(0, {TERMS})) AS i)),
t AS (SELECT doc_id, text, lang, source, n_chars, key, j, (SELECT count(*) FROM terms WHERE terms.mean = u.mean AND c <= u.u) AS times FROM u),
s AS (SELECT doc_id, text, lang, source, n_chars, key, CAST(sum(times) AS BIGINT) AS times FROM t GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, copy, md5(key || '|copy{SEED}|' || CAST(copy AS VARCHAR)) AS shuffle_key
FROM (SELECT *, unnest(range(0, times)) AS copy FROM s)
"""
