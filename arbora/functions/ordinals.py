"""A gapless global ordinal without a single-task sort."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbora.staging import stage


def global_ordinal(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """Add `name`, 1.. in the order of the columns `by`, which must identify rows.

    Rows are range-partitioned and staged (range bounds are sampled, so both uses must see one result); each
    partition is numbered on its own and shifted by the sizes of those before it, one row a partition.
    """
    parts = stage(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "ordinal")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    shift = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_shift"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*by))
    return (
        parts.withColumn("_rank", rank.cast("bigint"))
        .join(F.broadcast(shift), "_part")
        .withColumn(name, F.col("_rank") + F.col("_shift"))
        .drop("_part", "_rank", "_shift")
    )
