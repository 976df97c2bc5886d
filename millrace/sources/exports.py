"""Pipeline exports: one JSON file, one row (SRC12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.delimited import decode_bytes
from millrace.sources.files import read_binary


def read_pipeline_exports(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """`path, text` of each export file; bytes that are no text give a null. Parse with `catalog.exports.parse_exports`."""
    files = read_binary(spark, path, glob).select(F.col("_metadata.file_path").alias("path"), "content")
    return decode_bytes(files)
