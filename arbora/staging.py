"""Cutting lineage through a folder that driver and executors share."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, a fresh local one in local mode (tests), else an error:
    executors on other machines would each write a folder of their own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="arbora-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Unlike localCheckpoint this survives lost executors; unlike checkpoint() the files are columnar and
    compressed. Shuffle files of the write are dropped as soon as it ends, so a chain of staged steps needs the
    disk of one step, not of all.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/arbora/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._arbora_path = path
    return out


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(staged: DataFrame) -> None:
    """Delete a staged table that no later query reads."""
    _delete(staged.sparkSession, staged._arbora_path)


def cleanup(spark: SparkSession) -> None:
    """Delete all that this application has staged. Results that read staged tables must have been written by then."""
    _delete(spark, f"{shared_dir(spark)}/arbora/{spark.sparkContext.applicationId}")
