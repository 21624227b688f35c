"""Chat formatting by cumulative-snapshot collapse.

Logs often hold a conversation many times, as it grew. Each turn gets a hash of (ordinal, role, text); running sums
of it identify every prefix. A conversation that is a proper prefix of a longer one goes, of equal ones the smallest
id stays, and what stays is rendered.

Turns are sorted once, by ranges of (conv_id, turn, role, text), and numbered there; from then on only numbers and hashes are
handled, and the texts of conversations that stay are joined by number. Prefixes are aggregated before anything is joined, so a
first turn that opens most conversations is one row by then. Ordinals and running sums are taken within blocks of BLOCK
numbers and shifted by the sums of the blocks before, and rendering is by parts of PART turns, so a conversation of any
length, or of many turns with one and the same `turn`, is never one task's or one row's burden.

Null roles and texts are values of their own (rendered empty); ties in `turn` are ordered by role and text, a null
turn comes first; repeated rows are turns of their own; a null conv_id is one conversation; a text of any length is one
value; extra columns don't matter; no rows, no result. A mark of the template inside a role or text is broken by a
backslash, so that no text can forge a turn.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.llm.common import table
from arbora.staging import stage

BLOCK, PART, BEGIN = 256, 64, 32
HASHES = ["h1", "h2", "h3"]
# The template of a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _running(turns: DataFrame, sums: dict[str, str]) -> DataFrame:
    """Adds each output's running sum of its input column over the conversation, in blocks of turns."""
    key = ["conv_id", "_block"]
    within = Window.partitionBy(*key).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    blocks = Window.partitionBy("conv_id").orderBy("_block")
    totals = turns.groupBy(*key).agg(*(F.sum(v).alias(f"_t_{o}") for o, v in sums.items()))
    before = totals.select(
        F.col("conv_id").alias("_c"),
        F.col("_block").alias("_b"),
        *((F.sum(f"_t_{o}").over(blocks) - F.col(f"_t_{o}")).alias(f"_t_{o}") for o in sums),
    )
    run = turns.withColumns({f"_r_{o}": F.sum(v).over(within) for o, v in sums.items()})
    joined = run.join(before, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_block") == F.col("_b")))
    return joined.select(*turns.columns, *((F.col(f"_r_{o}") + F.col(f"_t_{o}")).alias(o) for o in sums))


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, role, text and _i, which grows with (conv_id, turn, role, text); staged, since range bounds are sampled."""
    order = ["conv_id", "turn", "role", "text"]
    # the bounds of the ranges reach the driver, so they hold beginnings only, which sort as the whole values do
    begins = F.left("role", F.lit(BEGIN)), F.when(F.coalesce(F.length("role"), F.lit(0)) < BEGIN, F.left("text", F.lit(BEGIN)))
    rows = conversations.select(*order).repartitionByRange("conv_id", "turn", *begins).sortWithinPartitions(*order)
    return stage(rows.select("conv_id", "role", "text", F.monotonically_increasing_id().alias("_i")), "turns")


def prefixes(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, _i, ordinal (1..) and the HASHES columns, the conversation up to this turn, for `numbered` turns."""
    said = F.xxhash64(F.col("role").isNull(), "role", F.col("text").isNull(), "text")
    other = F.xxhash64(F.lit(5), F.col("text").isNull(), "text", F.col("role").isNull(), "role")
    marks = turns.select("conv_id", "_i", said.alias("_x"), other.alias("_y"), F.floor(F.col("_i") / block).alias("_block"), F.lit(1).cast("long").alias("_one"))
    marks = stage(_running(marks, {"ordinal": "_one"}), "ordinals")
    for h in HASHES:  # 32 bits each: sums over 2^31 turns fit a long
        marks = marks.withColumn(f"_v_{h}", F.shiftrightunsigned(F.xxhash64(F.lit(h), "ordinal", "_x", "_y"), 32))
    return _running(marks, {h: f"_v_{h}" for h in HASHES}).select("conv_id", "_i", "ordinal", *HASHES)


def collapse(conversations: DataFrame) -> DataFrame:
    """conv_id, role, text, `ordinal` and `n_turns`: the turns of the maximal conversations."""
    texts = numbered(conversations)
    turns = stage(prefixes(texts), "prefixes")
    whole = turns.groupBy("conv_id").agg(F.max(F.struct("ordinal", *HASHES)).alias("_end")).select("conv_id", "_end.*")
    ends = whole.groupBy("ordinal", *HASHES).agg(
        F.min("conv_id").alias("first_id"), F.max(F.col("conv_id").isNull()).alias("has_null")
    )
    # prefixes that some longer conversation has: one row each, however many have it
    inner = turns.join(whole.select(F.col("conv_id").alias("_c"), F.col("ordinal").alias("n_turns")), F.col("conv_id").eqNullSafe(F.col("_c")))
    inner = inner.drop("_c")
    longer = inner.filter("ordinal < n_turns").select("ordinal", *HASHES).distinct()
    kept = ends.join(longer, ["ordinal", *HASHES], "left_anti").select(F.when(~F.col("has_null"), F.col("first_id")).alias("_c"))
    left = inner.join(kept, inner["conv_id"].eqNullSafe(kept["_c"]), "left_semi").select("_i", "ordinal", "n_turns")
    return texts.join(left, "_i").select("conv_id", "role", "text", "ordinal", "n_turns")


def _safe(said: Column) -> Column:
    out = F.coalesce(said, F.lit(""))
    for mark in (OPEN, CLOSE.strip()):
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return out


def render(turns: DataFrame, part: int = PART) -> DataFrame:
    """conv_id, part (0..), n_turns, first_ordinal, text: parts of at most `part` turns, to be concatenated in order."""
    piece = F.concat(F.lit(OPEN), _safe(F.col("role")), F.lit("\n"), _safe(F.col("text")), F.lit(CLOSE))
    rows = turns.select("conv_id", "n_turns", F.floor((F.col("ordinal") - 1) / part).cast("long").alias("part"), "ordinal", piece.alias("piece"))
    grouped = rows.groupBy("conv_id", "part", "n_turns").agg(F.array_sort(F.collect_list(F.struct("ordinal", "piece"))).alias("p"))
    return grouped.select("conv_id", "part", "n_turns", F.col("p")[0]["ordinal"].alias("first_ordinal"), F.array_join("p.piece", "").alias("text"))


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations."""
    return render(collapse(table(spark, sf_dir, "conversations")))


_SAFE = "replace(replace(coalesce({0}, ''), '<|im_start|>', '<\\|im_start|>'), '<|im_end|>', '<\\|im_end|>')"
SQL = f"""
WITH t AS (SELECT conv_id, row_number() OVER w AS ordinal, count(*) OVER (PARTITION BY conv_id) AS n_turns,
    {_SAFE.format('role')} AS role, {_SAFE.format('text')} AS text,
    md5(string_agg(CASE WHEN role IS NULL THEN 'n' ELSE 'r' || md5(role) END || CASE WHEN text IS NULL THEN 'n' ELSE 't' || md5(text) END, ',')
      OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST ROWS UNBOUNDED PRECEDING)) AS h
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
kept AS (SELECT CASE WHEN bool_or(conv_id IS NULL) THEN NULL ELSE min(conv_id) END AS conv_id FROM t WHERE ordinal = n_turns
  AND NOT EXISTS (SELECT 1 FROM t l WHERE l.h = t.h AND l.ordinal = t.ordinal AND l.n_turns > t.n_turns) GROUP BY h)
SELECT t.conv_id, (ordinal - 1) // {PART} AS part, n_turns, min(ordinal) AS first_ordinal,
  string_agg('{OPEN}' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY ordinal) AS text
FROM t JOIN kept ON t.conv_id IS NOT DISTINCT FROM kept.conv_id GROUP BY ALL
"""
