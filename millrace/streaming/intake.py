"""New files of a folder, each taken once; sources are retired after their batch (STR0, SNK8)."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.routing import with_export_flag
from millrace.sinks.writers import StepFailed, with_retries
from millrace.sources.delimited import decode_bytes

BINARY_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def new_files(
    spark: SparkSession,
    folder: str,
    retire: str | None = None,
    retired_to: str | None = None,
    max_files: int = 10_000,
) -> DataFrame:
    """Stream of `path, modified, text`; bytes that are no text give a null. `retire`: `delete` or `archive`
    (then `retired_to` is the folder) once a batch has been finished; files of the last batch go in the
    next run. `run_and_retire` takes away those of all batches, and then needs no `retire` here."""
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILES).option("maxFilesPerTrigger", max_files)
    if retire:
        reader = reader.option("cleanSource", retire)
    if retired_to:
        reader = reader.option("sourceArchiveDir", retired_to)
    files = reader.load(folder).select(
        F.col("_metadata.file_path").alias("path"), F.col("modificationTime").alias("modified"), "content"
    )
    return decode_bytes(files)


def run_available(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process all files that are there, then end. A run that was cut off continues where it stopped."""
    query = (
        stream.writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_and_retire(
    stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, ledger: str,
    retired_to: str | None = None, retries: int = 2, interval: float = 1.0,
) -> int:
    """`run_available`, then every file that was taken goes: deleted, or moved to `retired_to`. Gives their number.

    Each batch writes the paths of its files to `ledger` when it has done its work, and a batch is retired once the
    run has ended, when no batch can be repeated any more. A pass that was cut off is finished by the next run.
    """

    def noted(files: DataFrame, batch_id: int) -> None:
        batch(files, batch_id)
        files.select("path").write.mode("overwrite").parquet(f"{ledger}/{TAKEN}/{batch_id}")

    run_available(stream, noted, checkpoint)
    return retire_taken(stream.sparkSession, ledger, retired_to, retries, interval)


def retire_taken(spark: SparkSession, ledger: str, retired_to: str | None = None, retries: int = 2, interval: float = 1.0) -> int:
    """Delete or move the files of the ledger's batches that are not retired yet; call it when no stream is running.

    Each file is tried again `retries` times. A file that is absent, or stays after all tries, is an error, which comes
    when the others are gone. A batch is marked when its turn begins and when it ends: if a pass was cut off in between,
    files that are absent in the next one are those it had retired. The paths pass through the driver in blocks.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(ledger).getFileSystem(spark._jsc.hadoopConfiguration())

    def marked(kind: str) -> set[int]:
        folder = path(ledger, kind)
        return {int(f.getPath().getName()) for f in files.listStatus(folder)} if files.exists(folder) else set()

    begun, ended, done, failed = marked(BEGUN), marked(ENDED), 0, []
    for batch_id in sorted(marked(TAKEN) - ended):
        # The write of a batch may have been cut off; it is repeated then.
        if not files.exists(path(f"{ledger}/{TAKEN}/{batch_id}/_SUCCESS")):
            continue
        again = batch_id in begun
        files.create(path(f"{ledger}/{BEGUN}/{batch_id}"), True).close()
        taken = (r.path for r in spark.read.schema("path string").parquet(f"{ledger}/{TAKEN}/{batch_id}").toLocalIterator())
        gone, left = _retire(spark, taken, again, retired_to, retries, interval)
        done, failed = done + gone, (failed + left)[:SHOWN]
        if not left:
            files.create(path(f"{ledger}/{ENDED}/{batch_id}"), True).close()
    if failed:
        raise StepFailed("retire sources", "absent or not to be removed: " + "; ".join(failed))
    return done


TAKEN, BEGUN, ENDED = "taken", "begun", "ended"
#: Files that an error names.
SHOWN = 20
#: Files that are asked of the file system at a time, and paths in the driver's memory.
AT_ONCE, BLOCK = 16, 4096


def _retire(spark: SparkSession, taken: Iterable[str], again: bool, retired_to: str | None, retries: int, interval: float):
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    uri = spark._jvm.java.net.URI

    def one(name: str) -> str | None:
        # Paths of file metadata are encoded as in a URI.
        source = path(uri(name))
        store = source.getFileSystem(conf)

        def act() -> bool:
            if not store.exists(source):
                return False
            if retired_to is None:
                ok = store.delete(source, False)
            else:
                target = path(retired_to + source.toUri().getPath())
                store.mkdirs(target.getParent())
                ok = store.rename(source, target)
            if not ok:
                raise OSError(f"{name} stays")
            return True

        try:
            return None if with_retries(act, retries, interval) or again else f"{name} (absent)"
        except Exception as error:
            return f"{name} ({error})"

    gone, left = 0, []
    taken = iter(taken)
    with ThreadPoolExecutor(AT_ONCE) as pool:
        while block := list(islice(taken, BLOCK)):
            failures = [f for f in pool.map(one, block) if f]
            gone, left = gone + len(block) - len(failures), (left + failures)[:SHOWN]
    return gone, left


def intake_to(target: str) -> Callable[[DataFrame, int], None]:
    """Batch function: files go to `target`, parted by validity. A repeated batch replaces its own rows."""

    def write(files: DataFrame, batch_id: int) -> None:
        flagged = with_export_flag(files).withColumn("batch_id", F.lit(batch_id))
        (
            flagged.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id", "is_export")
            .parquet(target)
        )

    return write


def read_intake(spark: SparkSession, target: str) -> DataFrame:
    """What the runs so far have put there."""
    return spark.read.parquet(target).withColumn("is_export", F.col("is_export").cast("boolean"))
