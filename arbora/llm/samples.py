"""A bounded sample of labelled documents for training on the driver."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def labelled(docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int) -> list[tuple[str, int]]:
    """(text, label) of at most per_class documents of each class, those of least hashed id among the labelled rows
    that `train` (over labels.doc_id) lets through. Ids without a document, null texts and null labels are left out."""
    known = labels.filter(train & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("_y"))
    ids = None
    for y in (0, 1):
        some = known.filter(F.col("_y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        ids = some if ids is None else ids.unionByName(some)
    ids = ids.withColumnRenamed("doc_id", "_id")
    # at most 2 * per_class ids
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).filter("text is not null")
    one = rows.groupBy("doc_id").agg(F.min_by("text", F.md5("text")).alias("text"), F.max("_y").alias("_y"))
    found = {r.doc_id: (r.text, r._y) for r in one.collect()}
    return [found[k] for k in sorted(found)]
