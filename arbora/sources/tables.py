"""A virtual file catalogue over the `documents` table.

Each document becomes one to four entries of the trees t0 (reference) and t1 (cleanup): its own file, for some
ids a pair with equal paths and content (`m/`) or equal paths and sizes but other content (`x/`), and for some an
unreadable file (`u/`, null hash). No document is left out.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions.hashing import content_hash
from arbora.functions.paths import base_name, join_path, path_depth


def _own_path() -> Column:
    half = F.expr("doc_id div 2")
    pick = lambda n, names: F.get(F.array(*map(F.lit, names)), (half % n).cast("int"))
    head = F.when(F.expr("doc_id % 11 = 0"), "~$").when(F.expr("doc_id % 13 = 0"), "~WRL").otherwise("")
    tail = (
        F.when(F.expr("doc_id % 17 = 0"), ".tmpl")
        .when(F.expr("doc_id % 19 = 0"), ".bak")
        .when(F.expr("doc_id % 23 = 0"), ".TMP")
        .otherwise(".txt")
    )
    return F.concat_ws(
        "/",
        F.col("lang"),
        F.concat(F.lit("d"), (half % 3).cast("string")),
        pick(7, ("Package Cache", "GPUCache", "go", "src", "TempZXPSign01", "golang", "docs")),
        pick(5, (".cache", "pip", "data", "data", "data")),
        F.concat(head, F.lit("f"), half.cast("string"), tail),
    )


def catalog(spark: SparkSession, sf_dir: str, documents: DataFrame | None = None) -> DataFrame:
    """tree, root, rel, abs, name, is_dir, depth, size, hash; content is hashed in the scan and goes no further.

    documents: a stream of the table, say, instead of the table itself.
    """
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"))
    size = F.octet_length("text").cast("bigint")
    whole = content_hash(F.col("text"))

    def entry(tree: Column, rel: Column, size: Column, digest: Column) -> Column:
        return F.struct(tree.alias("tree"), rel.alias("rel"), size.alias("size"), digest.alias("hash"))

    def pair(folder: str, size: Column, digest) -> Column:
        return F.array(
            *(entry(F.lit(t), F.concat(F.lit(folder + "/"), name), size, digest(t)) for t in ("t0", "t1"))
        )

    own = entry(F.concat(F.lit("t"), (F.col("doc_id") % 2).cast("string")), _own_path(), size, F.col("_h"))
    lost = entry(F.lit("t0"), F.concat(F.lit("u/"), name), size, F.lit(None).cast("string"))
    none = F.array().cast("array<struct<tree:string,rel:string,size:bigint,hash:string>>")
    entries = F.concat(
        F.array(own),
        F.when(F.expr("doc_id % 10 = 0"), pair("m", size, lambda t: F.col("_h")))
        .when(F.expr("doc_id % 10 = 3"), pair("x", size + 2, lambda t: content_hash(F.concat("text", F.lit(t)))))
        .otherwise(none),
        F.when(F.expr("doc_id % 25 = 1"), F.array(lost)).otherwise(none),
    )
    flat = (
        (spark.read.parquet(f"{sf_dir}/documents.parquet") if documents is None else documents)
        .withColumn("_h", whole)
        .select(F.explode(entries).alias("e"))
        .select("e.*")
    )
    root = F.concat(F.lit("/data/"), F.col("tree"))
    return flat.select(
        "tree",
        root.alias("root"),
        "rel",
        join_path(root, F.col("rel")).alias("abs"),
        base_name(F.col("rel")).alias("name"),
        F.lit(False).alias("is_dir"),
        path_depth(F.col("rel")).alias("depth"),
        "size",
        "hash",
    )


def tree_of(entries: DataFrame, tree: str) -> DataFrame:
    return entries.filter(F.col("tree") == tree)
