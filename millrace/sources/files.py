"""Plain file scans (SRC1, SRC4-SRC6, SRC11)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.paths import WORKING_PREFIX, base_name

#: Files that are asked of the file system at a time.
AT_ONCE = 16


def file_starts(files: DataFrame, length: int) -> Iterator[tuple[str, bytes]]:
    """The name (as in `_metadata.file_path`) and the first bytes, at most `length`, of each file of a scan. Only these
    bytes are read, by the driver's threads; the names are those of the listing that every scan begins with."""
    spark = files.sparkSession
    path, conf, uri = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration(), spark._jvm.java.net.URI

    def start(name: str) -> tuple[str, bytes]:
        # The listing writes `file:///a` where the metadata has `file:/a`.
        parts = uri(name)
        source = path(parts.getScheme(), parts.getAuthority(), parts.getPath())
        stream = source.getFileSystem(conf).open(source)
        try:
            return source.toUri().toString(), bytes(b for b in (stream.read() for _ in range(length)) if b >= 0)
        finally:
            stream.close()

    with ThreadPoolExecutor(AT_ONCE) as pool:
        yield from pool.map(start, files.inputFiles())


def read_binary(spark: SparkSession, paths: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """One row per file: `path, modificationTime, length, content`. A missing path is an error."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(paths if isinstance(paths, str) else list(paths))


def list_files(spark: SparkSession, folder: str, skip_prefix: str | None = WORKING_PREFIX) -> DataFrame:
    """Inventory of a folder without reading any content; working copies are left out."""
    files = read_binary(spark, folder).select(
        base_name(F.col("path")).alias("file_name"), "path", "length", "modificationTime"
    )
    return files.filter(~F.col("file_name").startswith(skip_prefix)) if skip_prefix else files


def find_file(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Inventory row of one file; no row when it is not there."""
    return list_files(spark, folder, skip_prefix=None).filter(F.col("file_name") == name)


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    header: bool = True,
    infer: bool = False,
    multi_line: bool = False,
) -> DataFrame:
    """Without a schema all columns are texts; `infer` reads the data once more to find types. `multi_line` takes
    fields with line breaks; a file is then read by one task. Doubled quotes are one quote."""
    reader = spark.read.options(header=header, multiLine=multi_line, quote='"', escape='"')
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", infer).csv(path)


def read_json(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    max_records: int | None = None,
    order: Sequence[str] = (),
) -> DataFrame:
    """JSON lines; the record cap takes the first rows of `order` when one is given."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    docs = reader.json(path)
    if max_records is None:
        return docs
    return (docs.orderBy(*order) if order else docs).limit(max_records)


def read_parquet(spark: SparkSession, path: str, merge_schema: bool = False) -> DataFrame:
    return spark.read.option("mergeSchema", merge_schema).parquet(path)
