"""The stateless and stream-static operators over a stream of file entries.

An entry is judged when it arrives. Nothing is remembered between batches: junk is a filter, and duplicates are looked up in a
reference that is fixed while the stream runs.
"""

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.operators.dedup import MODE_KEYS
from arbora.operators.junk import find_junk
from arbora.staging import shared_dir

__all__ = ["find_junk", "stream_duplicates", "what_has_arrived"]


def stream_duplicates(arrivals: DataFrame, reference: DataFrame, mode: str = "hash") -> DataFrame:
    """Arriving files that a fixed reference already holds: a stream-static join without state."""
    keys = MODE_KEYS[mode]
    best = reference.groupBy(*keys).agg(F.min("abs").alias("reference_abs"))
    return arrivals.join(best, keys)


def what_has_arrived(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all that is there now, in as many batches as its source makes, and reads back what came out.

    Each batch's rows and the progress are written in the shared folder, so a run that is cut off goes on where it was.
    """
    spark = stream.sparkSession
    place = f"{shared_dir(spark)}/arbora/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{place}/progress").option("path", f"{place}/rows").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/rows")
