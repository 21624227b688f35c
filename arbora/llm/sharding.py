"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns `vnodes` points of a ring of hashes; a row belongs to the arc that ends at the first point at or
after its key's hash. Arcs are filled in ring order: an arc's rows go to its owner while that has room, and what
overflows continues clockwise to the next shard with room. Capacities are ceil(load * n / shards), or at load 1 the
exact quotas (counts at most one apart).

Rows are ranked within an arc by a hash of the whole row, so the result depends on the rows alone, not on how they are
partitioned or read; rows equal in every column are interchangeable. An arc of many rows, such as that of one id with a
third of all, is cut into ranges of that hash of about PER_BUCKET rows and BUCKET_BYTES bytes, each ranked by one task; the
ranks are the same however it is cut. A row that is there more than HOT times, equal in every column (compared, not only
hashed), is made from one copy and its count, in pieces that any task can take. Only the counts of the ranges and
the HOT rows' hashes reach the driver: shards * vnodes + n / PER_BUCKET + bytes / BUCKET_BYTES + n / HOT numbers.

Slots are ranks within the shard, stepped through by a stride near the golden section of its size, so that rows of
neighbouring ranks, such as copies of a document, lie far apart. Nulls and empty texts hash like values, texts of any
length are only hashed, an empty table gives no rows, other columns named shard or slot are replaced.
"""

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.llm.common import packed, table, unpacked
from arbora.staging import discard, stage

SHARDS, VNODES, LOAD = 8, 64, 1.0
PER_BUCKET, BUCKET_BYTES, HOT, PIECE = 1 << 20, 256 << 20, 1 << 20, 1 << 14
RING_SEED = 1009
DIGITS = 15  # of an MD5: 60 bits


@dataclass(frozen=True)
class Ring:
    """Arc k ends at position points[k][0] and belongs to shard points[k][1]."""

    points: list[tuple[int, int]]
    shards: int

    @classmethod
    def build(cls, shards: int, vnodes: int) -> "Ring":
        """Points depend on shard and replica alone, so a shard that is added moves nothing between the others."""
        at = lambda s, v: int(hashlib.md5(f"{RING_SEED}|{s}|{v}".encode()).hexdigest()[:DIGITS], 16)
        return cls(sorted((at(s, v), s) for s in range(shards) for v in range(vnodes)), shards)

    def arc(self, position: Column) -> Column:
        """Index of the first point at or after position; past the last one, the first."""
        ends = np.array([p for p, _ in self.points])

        @F.pandas_udf("int")
        def find(pos: pd.Series) -> pd.Series:
            return pd.Series((np.searchsorted(ends, pos.to_numpy()) % len(ends)).astype("int32"))

        return find(position)


def quotas(n: int, shards: int, load: float) -> list[int]:
    if load <= 1:
        return [n // shards + (s < n % shards) for s in range(shards)]
    return [-int(-load * n // shards)] * shards


def place(counts: list[tuple[int, int, int]], ring: Ring, load: float) -> list[tuple[int, int, int, int, int, int]]:
    """(arc, bucket, first, last, shard, slot of first) intervals of ranks within each (arc, bucket).

    next_[k] is the nearest arc clockwise from k whose shard may still have room, with path halving, so the whole
    walk is near linear in arcs and buckets.
    """
    free = quotas(sum(c for *_, c in counts), ring.shards, load)
    used = [0] * ring.shards
    next_ = list(range(len(ring.points)))

    def open_arc(k: int) -> int:
        while True:
            while next_[k] != k:
                next_[k] = next_[next_[k]]
                k = next_[k]
            if free[ring.points[k][1]] > used[ring.points[k][1]]:
                return k
            next_[k] = (k + 1) % len(next_)
            k = next_[k]

    out = []
    for arc, bucket, n in sorted(counts):
        first = 1
        while first <= n:
            shard = ring.points[open_arc(arc)][1]
            take = min(n - first + 1, free[shard] - used[shard])
            out.append((arc, bucket, first, first + take - 1, shard, used[shard]))
            used[shard] += take
            first += take
    return out


def stride(n: int) -> int:
    """The least number from n * 0.618 on that has no divisor in common with n."""
    step = max(n * 618 // 1000, 1)
    while math.gcd(step, n) != 1:
        step += 1
    return step


def _number(text: Column, digits: int = DIGITS) -> Column:
    return F.conv(F.substring(text, 1, digits), 16, 10).cast("long")


#: columns whose text tells their values apart
_PLAIN = (T.StringType, T.NumericType, T.BooleanType, T.DateType, T.TimestampType)


def _said(row: Column, field: T.StructField) -> Column:
    """The column's text, after its length, so that no two rows are said alike; null apart."""
    value = row[field.name]
    text = value.cast("string") if isinstance(field.dataType, _PLAIN) else F.to_json(F.struct(value))
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _row_hash(row: Column, schema: T.StructType) -> Column:
    """MD5 over the row's columns."""
    return F.md5(F.concat(*(_said(row, f) for f in schema)))


def _copies(rows: DataFrame, schema: T.StructType, hashes: list[str]) -> set[str]:
    """Those of the hashes whose rows are all one row."""
    some = rows.join(F.broadcast(rows.sparkSession.createDataFrame([(h,) for h in hashes], "_hash string")), "_hash")
    said = F.concat(*(_said(F.col("_arbora_row"), f) for f in schema))
    ends = some.groupBy("_hash").agg(F.min(said).alias("_least"), F.max(said).alias("_most"))
    return {r["_hash"] for r in ends.filter("_least = _most").select("_hash").collect()}


def assign(docs: DataFrame, key: str = "doc_id", shards: int = SHARDS, vnodes: int = VNODES, load: float = LOAD) -> DataFrame:
    """docs with `shard` (int) and `slot` (long, gapless from 0 within a shard)."""
    spark = docs.sparkSession
    ring = Ring.build(shards, vnodes)
    row = F.col("_arbora_row")
    position = _number(F.md5(F.concat_ws("|", F.lit(str(RING_SEED + 1)), row[key].cast("string"))))
    rows = packed(docs).withColumn("_arc", ring.arc(position)).withColumn("_hash", _row_hash(row, docs.schema))
    wide = [F.octet_length(row[f.name]) for f in docs.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    width = sum((F.coalesce(w, F.lit(0)).cast("long") for w in wide), F.lit(8 * len(docs.columns)).cast("long"))
    keys = stage(rows.select("_arc", F.unhex("_hash").alias("_hash"), width.alias("_width")), "ring")
    hot = keys.groupBy("_arc", "_hash").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).collect()  # n / HOT rows at most
    same = _copies(rows, docs.schema, [r["_hash"].hex() for r in hot]) if hot else set()
    hot = [r for r in hot if r["_hash"].hex() in same]
    parts = [1] * (shards * vnodes)
    for r in keys.groupBy("_arc").agg(F.count("*").alias("n"), F.sum("_width").alias("bytes")).collect():
        parts[r["_arc"]] = max(-(-r["n"] // PER_BUCKET), -(-r["bytes"] // BUCKET_BYTES), 1)
    spots = [(r["_arc"], parts[r["_arc"]] + i, r["n"], r["_hash"].hex()) for i, r in enumerate(hot)]

    if max(parts) > 1:
        share = _number(F.col("_hash"), 13) / F.lit(float(1 << 52))
        bucket = F.floor(share * F.get(F.array(*map(F.lit, parts)), F.col("_arc"))).cast("int")
    else:
        bucket = F.lit(0)
    named = rows
    counted = keys.select("_arc", F.lower(F.hex("_hash")).alias("_hash"))
    if spots:
        big = F.broadcast(spark.createDataFrame([(h,) for *_, h in spots], "_hash string"))
        counted, named = counted.join(big, "_hash", "left_anti"), rows.join(big, "_hash", "left_anti")
    counts = [tuple(r) for r in counted.withColumn("_bucket", bucket).groupBy("_arc", "_bucket").count().collect()]
    discard(keys)
    spans = place(counts + [s[:3] for s in spots], ring, load)
    held = [0] * shards
    for _, _, first, last, shard, _ in spans:
        held[shard] += last - first + 1
    spans = [(*s, held[s[4]], stride(held[s[4]])) for s in spans]
    # at most shards * vnodes + shards intervals, and one for each further bucket
    spans = F.broadcast(spark.createDataFrame(spans, "_arc int, _bucket int, _first long, _last long, shard int, _slot long, _held long, _step long"))

    rank = F.row_number().over(Window.partitionBy("_arc", "_bucket").orderBy("_hash")).cast("long")
    placed = named.withColumn("_bucket", bucket).withColumn("_rank", rank)
    placed = placed.join(spans, ["_arc", "_bucket"]).filter("_rank between _first and _last")
    out = [*rows.columns, "shard", "_slot", "_rank", "_first", "_held", "_step"]
    placed = placed.select(out)
    if spots:
        ids = F.broadcast(spark.createDataFrame([(a, b, h) for a, b, _, h in spots], "_arc int, _bucket int, _hash string"))
        one = rows.join(ids, ["_arc", "_hash"]).groupBy("_arc", "_bucket", "_hash").agg(F.first("_arbora_row").alias("_arbora_row"))
        many = one.join(spans, ["_arc", "_bucket"])
        many = many.withColumn("_from", F.explode(F.sequence("_first", "_last", F.lit(PIECE).cast("long")))).repartition("_hash", "_from")
        many = many.withColumn("_rank", F.explode(F.sequence("_from", F.least(F.col("_from") + PIECE - 1, "_last"))))
        placed = placed.unionByName(many.select(out))
    nth = (F.col("_slot") + F.col("_rank") - F.col("_first")).cast("decimal(19,0)")
    return unpacked(placed.withColumn("slot", (nth * F.col("_step").cast("decimal(18,0)") % F.col("_held").cast("decimal(18,0)")).cast("long")), "shard", "slot")


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 8 shards under the law `rows`: counts at most one apart (load 1)."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    out = assign(docs)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


_CRC = ", ".join(f"CASE WHEN c{i} & 1 = 1 THEN xor(c{i} >> 1, 3988292384) ELSE c{i} >> 1 END AS c{i + 1}" for i in range(8))
SQL = f"""
WITH RECURSIVE crc AS (SELECT list(c8 ORDER BY c0) AS t FROM (SELECT CAST(range AS BIGINT) AS c0, {_CRC} FROM range(256))),
d AS (SELECT row_number() OVER () AS rid, doc_id, CAST(coalesce(strlen(text), 0) + 1 AS BIGINT) AS size,
    coalesce(xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295), 0) AS crc,
    CAST('0x' || substr(md5(concat_ws('|', '{RING_SEED + 1}', CAST(doc_id AS VARCHAR))), 1, {DIGITS}) AS BIGINT) AS pos FROM documents, crc),
pts AS (SELECT row_number() OVER (ORDER BY p, s) - 1 AS k, p, s FROM (
    SELECT s, CAST('0x' || substr(md5('{RING_SEED}|' || s || '|' || v), 1, {DIGITS}) AS BIGINT) AS p
    FROM (SELECT unnest(range({SHARDS})) AS s), (SELECT unnest(range({VNODES})) AS v))),
a AS (SELECT rid, doc_id, size, crc, md5(CASE WHEN doc_id IS NULL THEN '-' ELSE length(CAST(doc_id AS VARCHAR)) || ':' || doc_id END || length(CAST(size AS VARCHAR)) || ':' || size || length(CAST(crc AS VARCHAR)) || ':' || crc) AS h,
    (SELECT count(*) FROM pts WHERE p < pos) % {SHARDS * VNODES} AS k FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY h) AS rank FROM a),
total AS (SELECT list(n // {SHARDS} + CASE WHEN s < n % {SHARDS} THEN 1 ELSE 0 END ORDER BY s) AS q FROM (SELECT count(*) AS n FROM d), (SELECT unnest(range({SHARDS})) AS s)),
clock AS (SELECT k, list(s ORDER BY far) AS o FROM (SELECT x.k, y.s, min((y.k - x.k + {SHARDS * VNODES}) % {SHARDS * VNODES}) AS far FROM pts x, pts y GROUP BY ALL) GROUP BY k),
arcs AS (SELECT clock.k, o, coalesce(n, 0) AS n FROM clock LEFT JOIN (SELECT k, count(*) AS n FROM a GROUP BY k) USING (k)),
walk(k, used) AS (SELECT CAST(0 AS BIGINT), list_transform(range({SHARDS}), lambda s: CAST(0 AS BIGINT))
  UNION ALL SELECT k + 1, list_transform(range({SHARDS}), lambda s: used[s + 1] + takes[list_position(o, s)]) FROM (
    SELECT k, used, o, list_transform(range(1, {SHARDS + 1}), lambda i: CAST(greatest(0, least(f[i], n - coalesce(list_sum(f[1:i - 1]), 0))) AS BIGINT)) AS takes FROM (
      SELECT walk.k, used, o, n, list_transform(o, lambda s: q[s + 1] - used[s + 1]) AS f FROM walk JOIN arcs USING (k), total))),
fits AS (SELECT k, o, used, list_transform(range(1, {SHARDS + 1}), lambda i: CAST(greatest(0, least(f[i], n - coalesce(list_sum(f[1:i - 1]), 0))) AS BIGINT)) AS takes
  FROM (SELECT walk.k, used, o, n, list_transform(o, lambda s: q[s + 1] - used[s + 1]) AS f FROM walk JOIN arcs USING (k), total)),
spans AS (SELECT k, o[i] AS shard, takes[i] AS n, used[o[i] + 1] AS slot, 1 + coalesce(list_sum(takes[1:i - 1]), 0) AS first FROM fits, (SELECT unnest(range(1, {SHARDS + 1})) AS i)),
held AS (SELECT s, n, list_filter(range(greatest(n * 618 // 1000, 1), n + 2), lambda c: gcd(c, n) = 1)[1] AS step FROM (SELECT unnest(range({SHARDS})) AS s, unnest(q) AS n FROM total))
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard,
  CAST((CAST(slot + rank - first AS HUGEINT) * step) % held.n AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM r JOIN spans ON r.k = spans.k AND rank >= first AND rank < first + spans.n JOIN held ON held.s = shard
"""
