"""Binary files of self-delimiting frames, written and read by Spark on any file system.

Spark has no sink for raw bytes, but its text sink writes a string column byte for byte and a
separator after each row. With a separator that the format skips, each row is a piece of the file.
Writing goes through Spark's commit protocol: a lost task leaves no half-written file behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_frames(pieces: DataFrame, column: str, path: str, separator: str, per_file: int) -> None:
    """The binary column is written as it is, row after row, `per_file` rows to a file. File names are in the order of
    partitions and, within one, of rows."""
    pieces.select(F.col(column).cast("string").alias("value")).write.option("lineSep", separator).option("maxRecordsPerFile", per_file).text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of every file; a file is one row, which is why `write_frames` bounds it."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
