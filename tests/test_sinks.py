import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from millrace.operators import updates
from millrace.plans.request_export import request_export, write_request_export
from millrace.session import new_shared_dir
from millrace.sinks import archive, writers
from millrace.sinks.outbox import Notice, Run, notification_rows


def test_guard(spark):
    assert writers.guard_non_empty(spark.range(1), "x").count() == 1
    with pytest.raises(writers.StepFailed, match="write file: no rows"):
        writers.guard_non_empty(spark.range(0), "write file")


def test_step_name_in_failures():
    with pytest.raises(writers.StepFailed, match="outer: boom") as info:
        with writers.named_step("outer"):
            raise RuntimeError("boom")
    assert info.value.step == "outer"
    with pytest.raises(writers.StepFailed, match="^inner"):
        with writers.named_step("outer"), writers.named_step("inner"):
            raise RuntimeError("boom")


@pytest.mark.parametrize("fails, retries, ok", [(0, 0, True), (2, 2, True), (2, 1, False), (3, 2, False)])
def test_retries(fails, retries, ok):
    calls = []

    def action():
        calls.append(1)
        if len(calls) <= fails:
            raise OSError("not yet")
        return "done"

    if ok:
        assert writers.with_retries(action, retries, interval=0) == "done" and len(calls) == fails + 1
    else:
        with pytest.raises(OSError):
            writers.with_retries(action, retries, interval=0)
        assert len(calls) == retries + 1


def test_insert_never_creates(spark):
    for write in (writers.insert_into, writers.truncate_load):
        with pytest.raises(writers.StepFailed, match="does not exist"):
            write(spark.range(1), "no_such_table")
    assert not spark.catalog.tableExists("no_such_table")


def test_failed_load_keeps_old_rows(spark):
    folder = new_shared_dir(spark, "load-test")
    name = "load_" + folder[-32:]
    spark.sql(f"CREATE TABLE {name} (id BIGINT) USING parquet LOCATION '{folder}'")
    writers.truncate_load(spark.range(5), name)
    stop = F.when(F.col("id") == 77, F.raise_error(F.lit("cannot read")).cast("bigint")).otherwise(F.col("id"))
    with pytest.raises(Exception, match="cannot read"):
        writers.truncate_load(spark.range(100).select(stop.alias("id")), name)
    assert spark.table(name).count() == 5
    writers.truncate_load(spark.table(name).filter("id > 2"), name)
    assert sorted(r.id for r in spark.table(name).collect()) == [3, 4]


def test_load_writes_once_and_moves_the_table(spark):
    base = new_shared_dir(spark, "move-test")
    name = "move_" + base[-32:]

    def place():
        return json.loads(spark.sql(f"DESCRIBE TABLE EXTENDED {name} AS JSON").first()[0])["location"].removeprefix("file:")

    spark.sql(f"CREATE TABLE {name} (id BIGINT, `a b` STRING) USING json LOCATION '{base}'")
    seen = []
    for n in (5, 3):
        before, rows = place(), spark.range(n).select(F.lit("x").alias("a b"), F.col("id").cast("int"), F.lit(1).alias("more"))
        seen.append(writers.observed_write(rows, lambda df: writers.truncate_load(df, name)))
        assert not os.path.exists(before) and place().startswith(f"{base}-load-") and len(place()) == len(base) + 38
        assert sorted(map(tuple, spark.table(name).collect())) == [(i, "x") for i in range(n)]
    assert seen == [5, 3]
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith(f"{name}_load_")]
    writers.truncate_load(spark.range(1).select("id", F.lit("y").alias("a b")), name, in_place=True)
    assert [tuple(r) for r in spark.table(name).collect()] == [(0, "y")]


def test_load_of_a_table_with_partitions(spark):
    folder = new_shared_dir(spark, "parts-test")
    name = "parts_" + folder[-32:]
    spark.sql(f"CREATE TABLE {name} (id BIGINT, p BIGINT) USING parquet PARTITIONED BY (p) LOCATION '{folder}'")
    for n in (7, 4):
        writers.truncate_load(spark.range(n).select((F.col("id") % 3).alias("p"), "id"), name)
        assert sorted(map(tuple, spark.table(name).collect())) == [(i, i % 3) for i in range(n)]


def test_append_creates(spark):
    folder = new_shared_dir(spark, "append-test")
    name = "append_" + folder[-32:]
    spark.range(0).write.option("path", folder).saveAsTable(name)
    writers.append_table(spark.range(2), name)
    writers.append_table(spark.range(3), name)
    assert spark.table(name).count() == 5
    writers.drop_table(spark, name)
    assert not spark.catalog.tableExists(name)


def test_observed_count(spark, tmp_path):
    assert writers.observed_write(spark.range(7), lambda df: writers.write_json(df, str(tmp_path / "j"))) == 7
    assert writers.observed_write(spark.range(0), lambda df: writers.write_csv(df, str(tmp_path / "c"))) == 0


def test_error_report_falls_back(spark, tmp_path):
    rows = spark.createDataFrame([("a", "b")], "column1 string, column2 string")
    first = writers.write_error_report(rows, str(tmp_path))
    assert first.endswith("/error_reports_error_1_rows.csv")
    second = writers.write_error_report(rows, str(tmp_path))
    assert second.endswith("/error_error_reports_error_1_rows.csv")
    assert spark.read.csv(second, header=True).first().asDict() == {"column1": "a", "column2": "b"}


def test_csv_lines(spark):
    rows = spark.createDataFrame([(1, 'a "b", c', None), (2, "plain", "x")], "`n o` int, t string, u string")
    body = sorted(r.line for r in writers.csv_format(rows).collect())
    assert body == ['1,"a ""b"", c",', "2,plain,x"]
    top = writers.csv_format(rows, header=True).filter("is_header").collect()
    assert [r.line for r in top] == ["n o,t,u"]


def archived(spark, folder):
    return sorted(map(tuple, archive.read_archive(spark, folder).select("yyyymm", "name", "v", "body").collect()))


def test_archive(spark, tmp_path):
    folder = str(tmp_path / "archive")

    def run(rows, at):
        df = spark.createDataFrame(rows, "name string, v int, body string")
        archive.archive_write(df, folder, "name", ["v"], at=F.lit(at).cast("timestamp"))

    run([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "b"), ("e", 1, "")], "2024-01-31 23:59:59")
    run([("c", 1, "c")], "2024-02-01 00:00:00")
    january = [("202401", "a", 2, "new"), ("202401", "b", 1, "b"), ("202401", "e", 1, "")]
    assert archived(spark, folder) == [*january, ("202402", "c", 1, "c")]
    # an older file that comes later replaces nothing; of equal stamps the last run wins
    run([("b", 0, "older")], "2024-01-05 00:00:00")
    assert archived(spark, folder) == [*january, ("202402", "c", 1, "c")]
    run([("b", 1, "again")], "2024-01-05 00:00:00")
    january[1] = ("202401", "b", 1, "again")
    assert archived(spark, folder) == [*january, ("202402", "c", 1, "c")]
    run([("b", 0, "again")], "2024-01-05 00:00:00")
    assert archived(spark, folder) == [*january, ("202402", "c", 1, "c")]
    plan = archive.read_archive(spark, folder).filter("yyyymm = '202402'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan


def test_archive_path(spark):
    path = archive.archive_path("/out/", F.lit("a.txt"), F.lit("2024-03-01").cast("timestamp"))
    assert spark.range(1).select(path).first()[0] == "/out/202403/a.txt"


def test_message_with_missing_values(spark):
    none = F.lit(None).cast("string")
    run = Run(F.lit("a;b"), none, none, F.lit("/x/"), F.lit("p"), F.lit("2024-01-01").cast("timestamp"))
    rows = notification_rows(spark.range(1), Notice("s", "o", {"File": none}), run)
    row = rows.first()
    assert row.receiver == "a,b" and "File: <br>" in row.body and "\\x\\202401" in row.body


def test_request_export_files(spark, tmp_path):
    queue = spark.createDataFrame([(1, "new"), (2, "new")], "id int, status string")
    items = spark.createDataFrame([(1, "m", 0, "d"), (1, "f", 1, None)], "id int, kind string, bad int, detail string")
    ids = spark.createDataFrame([(1,)], "id int")
    run = request_export(queue, ids, items, "id", "kind", {"m": "m", "f": "f"}, F.col("bad") == 1, "detail", share=True)
    report = write_request_export(run, str(tmp_path))
    assert report and glob.glob(report + "/part-*")
    assert [r.value for r in spark.read.text(f"{tmp_path}/export").collect()] == ["1,m,0,d,Fulfilled"]
    assert writers.read_runs(spark, f"{tmp_path}/log").first().status == "complete"
    none = request_export(queue, ids.limit(0), items, "id", "kind", {"m": "m"}, F.col("bad") == 1, "detail")
    with pytest.raises(writers.StepFailed, match="write export"):
        write_request_export(none, str(tmp_path))


def test_a_failed_run_leaves_the_archive(spark, tmp_path):
    folder = str(tmp_path / "archive")
    rows = spark.createDataFrame([("a", 1, "first"), ("b", 1, "first")], "name string, v int, body string")
    at = F.lit("2024-03-01").cast("timestamp")
    archive.archive_write(rows, folder, "name", ["v"], at=at)
    stop = F.when(F.col("name") == "b", F.raise_error(F.lit("cannot read")).cast("string")).otherwise(F.lit("second"))
    with pytest.raises(Exception, match="cannot read"):
        archive.archive_write(rows.withColumn("body", stop), folder, "name", ["v"], at=at)
    assert {(r.name, r.body) for r in archive.read_archive(spark, folder).collect()} == {("a", "first"), ("b", "first")}
    # a run that was cut off before its marker
    extra = spark.read.parquet(folder).filter("name = 'a'").withColumn("_archived_run", F.lit(9_000_000_000_000_000_000)).withColumn("body", F.lit("half"))
    extra.write.mode("append").partitionBy("yyyymm", "_archived_run").parquet(folder)
    assert {(r.name, r.body) for r in archive.read_archive(spark, folder).collect()} == {("a", "first"), ("b", "first")}
    archive.archive_write(rows.filter("name = 'a'").withColumn("body", F.lit("third")), folder, "name", ["v"], at=at)
    into = str(tmp_path / "compact")
    archive.compact_archive(spark, folder, into, "name", ["v"])
    for place in (folder, into):
        assert {(r.name, r.body) for r in archive.read_archive(spark, place).collect()} == {("a", "third"), ("b", "first")}
    assert archive.read_archive(spark, folder, replaced=True).count() == 3 and archive.read_archive(spark, into, replaced=True).count() == 2


def test_csv_header_is_quoted(spark):
    rows = spark.createDataFrame([("1", "2")], ["a,b", 'c"'])
    assert [r.line for r in writers.csv_format(rows, header=True).orderBy(F.desc("is_header")).collect()] == ['"a,b","c"""', "1,2"]


class _Cluster:
    """What the folder needs of a session, with the master of a cluster."""

    class conf:
        @staticmethod
        def get(key, default=None):
            return default

    class sparkContext:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None


def test_a_cluster_must_name_its_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        new_shared_dir(_Cluster, "x")


def test_queue_and_log_come_from_one_join(spark):
    queue = spark.createDataFrame([(i,) for i in range(6)] + [(None,)], "k int")
    done = spark.createDataFrame([(1,), (1,), (4,), (9,)], "k int")
    log, rest = updates.move_matched(queue, done, ["k"])
    assert sorted(r.k for r in log.collect()) == [1, 4]
    assert sorted((r.k is None, r.k) for r in rest.collect()) == [(False, 0), (False, 2), (False, 3), (False, 5), (True, None)]
    plan = updates.with_destination(queue, done, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_log_of_runs(spark, tmp_path):
    """A repeated run is there once, a failed one not at all."""
    folder = str(tmp_path / "log")
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id int")
    with pytest.raises(writers.StepFailed):
        writers.read_runs(spark, folder)
    writers.append_run(rows(1, 2), folder, "first.a")
    writers.append_run(rows(7), folder, "second")
    broken = rows(3).withColumn("id", F.raise_error(F.lit("no")).cast("int"))
    with pytest.raises(Exception, match="no"):
        writers.append_run(broken, folder, "first.a")
    read = lambda: sorted((r.run, r.id) for r in writers.read_runs(spark, folder).collect())
    assert read() == [("first.a", 1), ("first.a", 2), ("second", 7)]
    writers.append_run(rows(1, 5), folder, "first.a")
    assert read() == [("first.a", 1), ("first.a", 5), ("second", 7)]
