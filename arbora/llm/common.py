"""What several operators share: tables, byte-exact text columns, clash-free rows."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of text that a Python worker holds at a time, unless the session says otherwise.
BATCH_BYTES = 8 << 20
# Fixed values.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ROW = "_arbora_row"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Limits Arrow batches by bytes from now on: 10,000 whole texts at a time are too many for a worker. A session that has set the limit keeps it."""
    key, usual = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
    if spark.conf.get(key) == usual:
        spark.conf.set(key, str(BATCH_BYTES))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character untouched."""
    return F.translate(text, UPPER, LOWER)


def text_or_empty(text: Column | str = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """What identifies a row up to repetition: 128 bits of its id and its text. Rows that share both get equal results."""
    said = F.when(F.col(text).isNull(), F.lit("n")).otherwise(F.concat(F.lit("t"), text))
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), said)))


def packed(df: DataFrame) -> DataFrame:
    """One struct column holding the row, so that working columns can't clash with it."""
    return df.select(F.struct(*(df[c] for c in df.columns)).alias(ROW))


def unpacked(df: DataFrame, *outs: str) -> DataFrame:
    """The packed row's columns followed by `outs`; an output replaces a column of its name."""
    low = {c.lower() for c in outs}
    own = [c for c in df.schema[ROW].dataType.fieldNames() if c.lower() not in low]
    return df.select(*(F.col(ROW)[c].alias(c) for c in own), *outs)
