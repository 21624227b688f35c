"""Quality rules as a bitmask ledger, in DataFrame functions alone.

Every rule is evaluated once; the ledger keeps each document's measurements and one bit for each rule it fails. A
policy is a named, versioned mask: a document is rejected if it fails a rule of the mask. Verdicts of other policies,
and what each rule alone decides (ablation), come from the ledger by bitwise tests and sums, without the texts.

Words are `[^\\x20\\x09-\\x0D]+` of the whole text. A null or empty text has no words and fails the first rule. Rows
are judged one by one: ties, repeated rows and extra columns change nothing, and no rows give no result.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.common import packed, table, text_or_empty, unpacked

SPACE = r"[\x20\x09-\x0D]+"

#: name -> (bit, SQL condition that fails it); bits are never reused
RULES = {
    "few_words": (0, "n_words < 50"),
    "repeated_words": (1, "100 * n_repeat_words > 50 * n_words"),
    "symbols": (2, "10 * n_symbols > n_words"),
    "duplicate_lines": (3, "n_lines >= 4 and 100 * n_dup_lines > 30 * n_lines"),
    "word_length": (4, "n_words > 0 and (word_chars < 2 * n_words or word_chars > 12 * n_words)"),
    "shouting": (5, "n_words > 0 and 10 * n_marks > 3 * n_words"),
}
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "duplicate_lines"),
    "v2": tuple(RULES),
}
POLICY = "v2"


def mask(policy: str) -> int:
    return sum(1 << RULES[r][0] for r in POLICIES[policy])


def _with_repeats(rows: DataFrame) -> DataFrame:
    """rows (_words, n_words) with `_places`: sorted places of the 3-word windows that are there more than once, some given twice.

    Each window's hash, and its place in as many low bits as the document needs, make one long, so that a primitive sort brings
    equal hashes together; the words of neighbours are then compared. If windows of one hash differ, this document's
    windows are sorted themselves. Every step is a column of its own: within a lambda an expression would run for each element.
    """
    n = F.col("n_words").cast("int")
    places, neighbours = F.sequence(F.lit(0), n - 3), F.sequence(F.lit(1), n - 3)
    window = lambda i: [F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)]
    shift = lambda way, x: F.call_function(way, x, F.col("_bits"))
    at = lambda c, i: F.get(F.col(c), i)
    place = lambda x: x.bitwiseAND(F.col("_low"))
    said = lambda x: F.concat_ws(" ", *window(place(x).cast("int")))

    rows = rows.withColumn("_bits", F.length(F.bin("n_words")))
    rows = rows.withColumn("_low", shift("shiftleft", F.lit(1).cast("long")) - 1)
    hashed = F.transform(places, lambda i: shift("shiftleft", F.xxhash64(*window(i))).bitwiseOR(i.cast("long")))
    rows = rows.withColumn("_hashed", F.when(n >= 4, F.sort_array(hashed)))
    rows = rows.withColumn("_alike", F.filter(neighbours, lambda i: shift("shiftright", at("_hashed", i)) == shift("shiftright", at("_hashed", i - 1))))
    rows = rows.withColumn("_alike", F.when(n >= 4, F.col("_alike")))
    rows = rows.withColumn("_differ", F.coalesce(F.exists("_alike", lambda i: said(at("_hashed", i)) != said(at("_hashed", i - 1))), F.lit(False)))
    whole = F.transform(places, lambda i: F.struct(F.concat_ws(" ", *window(i)).alias("w"), i.cast("long").alias("p")))
    rows = rows.withColumn("_whole", F.when(F.col("_differ"), F.sort_array(whole)))
    exact = F.filter(neighbours, lambda i: at("_whole", i)["w"] == at("_whole", i - 1)["w"])
    both = F.when(F.col("_differ"), F.flatten(F.transform(exact, lambda i: F.array(at("_whole", i)["p"], at("_whole", i - 1)["p"]))))
    both = both.otherwise(F.flatten(F.transform("_alike", lambda i: F.array(place(at("_hashed", i)), place(at("_hashed", i - 1))))))
    return rows.withColumn("_places", F.sort_array(both)).drop("_bits", "_low", "_hashed", "_alike", "_differ", "_whole")


def _covered(places: Column) -> Column:
    """Words covered by 3-word windows at the sorted places."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last"))
    step = lambda a, p: F.struct((a["n"] + F.least(F.lit(3).cast("long"), p - a["last"])).alias("n"), p.alias("last"))
    return F.aggregate(places, start, step, lambda a: a["n"])


def measure(rows: DataFrame, text: Column) -> DataFrame:
    """rows with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_marks (all long)."""
    whole = text_or_empty(text)
    lines = F.filter(F.split(whole, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    out = rows.select(
        "*",
        F.array_remove(F.split(whole, SPACE), "").alias("_words"),
        lines.alias("_lines"),
        F.length(F.regexp_replace(whole, SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(whole, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.regexp_count(whole, F.lit(r"!![\x20\x09-\x0D]")).cast("long").alias("n_marks"),
    )
    out = out.select(
        *(c for c in out.columns if c not in ("_lines",)),
        F.size("_words").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
    )
    out = _with_repeats(out).withColumn("n_repeat_words", F.coalesce(_covered(F.col("_places")), F.lit(0).cast("long")))
    return out.drop("_words", "_places")


def ledger(docs: DataFrame) -> DataFrame:
    """docs with the measurements and `fail_bits` (long)."""
    rows = measure(packed(docs), F.col("_arbora_row")["text"])
    bits = reduce(
        lambda a, b: a.bitwiseOR(b),
        (F.when(F.expr(cond), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long") for bit, cond in RULES.values()),
    )
    rows = rows.withColumn("fail_bits", bits)
    return unpacked(rows, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_marks", "fail_bits")


def apply_policy(book: DataFrame, policy: str = POLICY) -> DataFrame:
    """The ledger with base_failed and kept under a policy."""
    fails = lambda m: F.col("fail_bits").bitwiseAND(F.lit(m).cast("long")) != 0
    return book.withColumns({"base_failed": fails(mask("base")), "kept": ~fails(mask("base") | mask(policy))})


def ablation(book: DataFrame, policy: str = POLICY) -> DataFrame:
    """For each rule of a policy: documents that fail it, that only it rejects, and that would be kept without it.

    One pass over the ledger; a single row of sums is turned into one row for each rule.
    """
    m = mask(policy)
    bits = F.col("fail_bits").bitwiseAND(F.lit(m).cast("long"))
    sums = [F.count("*").alias("n"), F.count_if(bits == 0).alias("kept"), F.bit_or("fail_bits").alias("seen"), F.bit_and("fail_bits").alias("common")]
    for r in POLICIES[policy]:
        one = 1 << RULES[r][0]
        sums += [F.count_if(bits.bitwiseAND(F.lit(one).cast("long")) != 0).alias(f"f_{r}"), F.count_if(bits == one).alias(f"o_{r}")]
    rows = F.array(
        *(F.struct(F.lit(r).alias("rule"), F.col(f"f_{r}").alias("n_failed"), F.col(f"o_{r}").alias("n_only"), (F.col("kept") + F.col(f"o_{r}")).alias("kept_without")) for r in POLICIES[policy])
    )
    return book.agg(*sums).select(F.lit(policy).alias("policy"), "n", "kept", "seen", "common", F.inline(rows))


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")
    return apply_policy(book).select(*cols)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
r AS (SELECT row_number() OVER () AS rid, doc_id, text, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(regexp_extract_all(text, '!![\x20\x09-\x0D]')) AS n_marks FROM d),
g AS (SELECT rid, unnest(range(1, n_words - 1)) AS i, unnest(list_transform(range(1, n_words - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) AS g
    FROM r WHERE n_words >= 3),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + o) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS o) GROUP BY rid),
m AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, n_lines, n_marks FROM r LEFT JOIN cov USING (rid)),
b AS (SELECT *, CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 12 * n_words) THEN 16 ELSE 0 END
    + CASE WHEN n_words > 0 AND 10 * n_marks > 3 * n_words THEN 32 ELSE 0 END AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept,
  CAST(fail_bits AS BIGINT) AS fail_bits FROM b
"""
