"""The one row type every operator reads."""

from pyspark.sql import types as T

#: size of a directory that can't be listed; other directories have a null size
UNLISTED = -1

#: `size` is null for a file that can't be examined. `hash` is null until it is computed, and stays null for unreadable files.
FILE_ENTRY = T.StructType(
    [
        T.StructField("tree", T.StringType(), False),
        T.StructField("root", T.StringType(), False),
        T.StructField("rel", T.StringType(), False),
        T.StructField("abs", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("is_dir", T.BooleanType(), False),
        T.StructField("depth", T.IntegerType(), False),
        T.StructField("size", T.LongType(), True),
        T.StructField("raw_path", T.BinaryType(), True),
    ]
)
