"""Files and sinks (SRC1, SRC4-SRC6, SRC11, SNK1-SNK7, SNK10, SNK11, MET1)."""

from pyspark.sql import functions as F

from millrace.functions.dates import month_stamp
from millrace.functions.text import lines
from millrace.session import new_shared_dir
from millrace.sinks import archive, writers
from millrace.sources import files
from millrace.sources.exports import read_pipeline_exports
from millrace.streaming.intake import intake_to, new_files, read_intake, run_and_retire, run_available
from queries.registry import query, table


@query("SELECT sum(strlen(c_name) + 1)::BIGINT AS bytes, count(*) AS lines FROM customer")
def binary_scan(spark, sf):
    """Whole files as bytes."""
    folder = new_shared_dir(spark, "binary")
    table(spark, sf, "customer").select("c_name").write.option("maxRecordsPerFile", 100_000).text(folder)
    content = F.col("content").cast("string")
    return files.read_binary(spark, folder).agg(
        F.sum("length").alias("bytes"),
        F.sum(F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))).cast("bigint").alias("lines"),
    )


@query("SELECT 'customers' AS file_name, sum(strlen(c_name) + 1)::BIGINT AS bytes FROM customer")
def file_inventory(spark, sf):
    """Sizes without reading content; names are those of the writer, so only their kind is shown."""
    folder = new_shared_dir(spark, "inventory")
    table(spark, sf, "customer").select("c_name").write.text(folder)
    listed = files.list_files(spark, folder)
    kind = F.when(F.col("file_name").startswith("part-") & F.col("file_name").endswith(".txt"), "customers")
    return listed.groupBy(kind.alias("file_name")).agg(F.sum("length").alias("bytes"))


@query("SELECT 'text' AS kind, CAST(o_orderkey AS VARCHAR) AS line FROM orders")
def stream_intake_files(spark, sf):
    """Files taken by a stream that ends when all are processed, each once; their lines afterwards."""
    folder, target, state = (new_shared_dir(spark, name) for name in ("stream-in", "stream-out", "stream-state"))
    keys = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string"))
    keys.write.option("maxRecordsPerFile", 10_000).text(folder)
    for _ in range(2):
        run_available(new_files(spark, folder), intake_to(target), state)
    kind = F.when(F.col("is_export"), "export").otherwise("text").alias("kind")
    found = read_intake(spark, target).select(kind, F.explode(lines(F.col("text"))).alias("line"))
    return found


@query("SELECT 'kept' AS part, CAST(c_custkey AS VARCHAR) AS line FROM customer UNION ALL SELECT 'files left', '0'")
def stream_intake_retired(spark, sf):
    """Files of several batches are deleted when the run that took them has ended, those of its last batch too."""
    folder, target, state, ledger = (new_shared_dir(spark, f"retire-{name}") for name in ("in", "out", "state", "ledger"))
    keys = table(spark, sf, "customer").select(F.col("c_custkey").cast("string"))
    keys.write.option("maxRecordsPerFile", 10_000).text(folder)
    run_and_retire(new_files(spark, folder, max_files=2), intake_to(target), state, ledger)
    found = read_intake(spark, target).select(F.lit("kept").alias("part"), F.explode(lines(F.col("text"))).alias("line"))
    left = files.list_files(spark, folder).agg(F.count(F.lit(1)).cast("string").alias("line"))
    return found.unionByName(left.select(F.lit("files left").alias("part"), "line"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN NULL ELSE text END AS text FROM documents")
def read_undecodable_files(spark, sf):
    """Files of three kinds: plain, with UTF-8 marks, and with bytes that are no text, which gives a null for the file."""
    folder = new_shared_dir(spark, "charsets")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    for rest, name, prefix in ((0, "bad", "FF"), (1, "plain", ""), (2, "marked", "EFBBBF")):
        own = docs.filter(F.col("doc_id") % 3 == rest)
        raw = F.concat(F.unhex(F.lit(prefix)), F.encode(F.concat_ws("\x1d", F.col("doc_id").cast("string"), "text"), "UTF-8"))
        own.select(raw.cast("string").alias("value")).write.mode("append").option("lineSep", "\x1e").text(f"{folder}/{name}")
    texts = read_pipeline_exports(spark, f"{folder}/*")
    rows = texts.filter("text IS NOT NULL").select(F.explode(F.split("text", "\x1e")).alias("row")).filter("row <> ''")
    part = F.split(F.regexp_replace("row", "\ufeff", ""), "\x1d")
    good = rows.select(part[0].cast("bigint").alias("doc_id"), part[1].alias("text"))
    return docs.select("doc_id").join(good, "doc_id", "left")


@query("SELECT count(*) AS n, 'load customers: no rows to write' AS failure, 2::BIGINT AS attempts FROM customer")
def named_failure(spark, sf):
    """A step that fails comes out under its name; one that fails once is tried again."""
    customers, calls = table(spark, sf, "customer"), []

    def count():
        calls.append(1)
        if len(calls) == 1:
            raise OSError("not yet")
        return customers.count()

    try:
        with writers.named_step("load customers"):
            writers.guard_non_empty(customers.filter("c_custkey < 0"), "load customers")
    except writers.StepFailed as error:
        failure = str(error)
    rows = writers.with_retries(count, retries=3, interval=0)
    facts = [F.lit(rows).cast("bigint").alias("n"), F.lit(failure).alias("failure"), F.lit(len(calls)).cast("bigint").alias("attempts")]
    return customers.limit(1).select(*facts)


@query("SELECT 'found' AS place, count(*) AS bytes FROM (SELECT unnest(range(sum(strlen(c_name) + 1)::BIGINT)) FROM customer) UNION ALL SELECT 'none', 0")
def find_one_file(spark, sf):
    folder = new_shared_dir(spark, "find")
    table(spark, sf, "customer").select("c_name").coalesce(1).write.text(folder)
    name = files.list_files(spark, folder).filter("file_name LIKE 'part-%'").first().file_name
    size = F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")
    there = files.find_file(spark, folder, name).agg(size).select(F.lit("found").alias("place"), "bytes")
    return there.unionByName(files.find_file(spark, folder, "absent").agg(size).select(F.lit("none").alias("place"), "bytes"))


ORDERS_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"


@query(ORDERS_SQL)
def roundtrip_csv(spark, sf):
    folder, orders = new_shared_dir(spark, "csv"), table(spark, sf, "orders")
    writers.write_csv(orders, folder)
    return files.read_csv(spark, folder, orders.schema)


@query("SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, o_orderstatus, o_totalprice FROM orders")
def roundtrip_csv_inferred(spark, sf):
    """Types found by one more pass over the files."""
    folder = new_shared_dir(spark, "csv-inferred")
    writers.write_csv(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), folder)
    return files.read_csv(spark, folder, infer=True)


@query("SELECT doc_id, text, lang FROM documents")
def roundtrip_csv_texts(spark, sf):
    """Whole texts with line breaks, quotes and backslashes."""
    folder = new_shared_dir(spark, "csv-texts")
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    writers.write_csv(docs, folder)
    return files.read_csv(spark, folder, docs.schema, multi_line=True)


@query(ORDERS_SQL)
def roundtrip_json(spark, sf):
    folder, orders = new_shared_dir(spark, "json"), table(spark, sf, "orders")
    writers.write_json(orders, folder)
    return files.read_json(spark, folder, orders.schema)


@query("SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 1000")
def read_json_capped(spark, sf):
    """The record cap of the reader, made stable by an order."""
    folder = new_shared_dir(spark, "json-capped")
    writers.write_json(table(spark, sf, "events").select("event_id", "user_id"), folder)
    return files.read_json(spark, folder, "event_id bigint, user_id bigint", max_records=1000, order=["event_id"])


@query(ORDERS_SQL)
def roundtrip_parquet(spark, sf):
    folder = new_shared_dir(spark, "parquet")
    writers.write_parquet(table(spark, sf, "orders"), folder)
    return files.read_parquet(spark, folder)


@query(
    """
SELECT s_suppkey AS id, s_name AS name, NULL AS segment FROM supplier
UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer
"""
)
def read_parquet_merged(spark, sf):
    """Two writes with different columns, read with a merged schema."""
    folder = new_shared_dir(spark, "merged")
    writers.write_parquet(table(spark, sf, "supplier").selectExpr("s_suppkey AS id", "s_name AS name"), folder)
    customers = table(spark, sf, "customer").selectExpr("c_custkey AS id", "c_name AS name", "c_mktsegment AS segment")
    writers.write_parquet(customers, folder, mode="append")
    return files.read_parquet(spark, folder, merge_schema=True).select("id", "name", "segment")


def _new_table(spark, purpose, columns):
    folder = new_shared_dir(spark, purpose)
    name = f"{purpose}_{folder[-32:]}"
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet LOCATION '{folder}'")
    return name


@query("SELECT c_custkey, c_name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def insert_into_table(spark, sf):
    """Two appends to an existing table, the second with its columns in another order."""
    name = _new_table(spark, "insert", "c_custkey BIGINT, c_name STRING")
    writers.insert_into(table(spark, sf, "customer"), name)
    writers.insert_into(table(spark, sf, "supplier").selectExpr("s_name AS c_name", "s_suppkey AS c_custkey"), name)
    return spark.table(name)


@query("SELECT c_custkey, c_name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def append_table_rows(spark, sf):
    """Two appends to a catalog table, by column name."""
    name = _new_table(spark, "append", "c_custkey BIGINT, c_name STRING")
    writers.append_table(table(spark, sf, "customer").select("c_custkey", "c_name"), name)
    writers.append_table(table(spark, sf, "supplier").selectExpr("s_suppkey AS c_custkey", "s_name AS c_name"), name)
    return spark.table(name)


@query("SELECT s_suppkey, s_name FROM supplier")
def truncate_load_table(spark, sf):
    """The second load replaces the first."""
    name = _new_table(spark, "truncate", "s_suppkey BIGINT, s_name STRING")
    writers.truncate_load(table(spark, sf, "customer").selectExpr("c_custkey AS s_suppkey", "c_name AS s_name"), name)
    writers.truncate_load(table(spark, sf, "supplier"), name)
    return spark.table(name)


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def guarded_write(spark, sf):
    folder = new_shared_dir(spark, "guarded")
    finished = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus")
    writers.write_parquet(writers.guard_non_empty(finished, "finished orders"), folder)
    return spark.read.parquet(folder)


@query("SELECT l_returnflag, count(*) AS n, (SELECT count(*) FROM lineitem) AS observed FROM lineitem GROUP BY l_returnflag")
def observed_write(spark, sf):
    """The count comes from the write."""
    folder = new_shared_dir(spark, "observed")
    rows = writers.observed_write(table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag"), lambda df: writers.write_parquet(df, folder))
    counts = spark.read.parquet(folder).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("observed", F.lit(rows).cast("bigint"))


@query(
    """
SELECT c_custkey, c_acctbal, (SELECT 'error_reports_error_' || count(*) || '_rows.csv' FROM customer WHERE c_acctbal < 0) AS report
FROM customer WHERE c_acctbal < 0
"""
)
def error_report(spark, sf):
    bad = table(spark, sf, "customer").filter("c_acctbal < 0").select("c_custkey", "c_acctbal")
    path = writers.write_error_report(bad, new_shared_dir(spark, "errors"))
    report = files.read_csv(spark, path, "c_custkey bigint, c_acctbal double")
    return report.withColumn("report", F.lit(path.rsplit("/", 1)[1]))


@query(
    """
SELECT yyyymm, o_custkey, o_orderkey, o_orderdate FROM (
  SELECT strftime(o_orderdate, '%Y%m') AS yyyymm, o_custkey, o_orderkey, o_orderdate,
         row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y%m'), o_custkey
                            ORDER BY o_orderdate DESC, o_orderkey DESC) AS r
  FROM orders)
WHERE r = 1
"""
)
def archive_months(spark, sf):
    """Two runs into one archive. A customer stands for a file name: of the versions of a month the last one by
    its date wins, whichever run brought it."""
    folder = new_shared_dir(spark, "archive")
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    month = month_stamp(F.col("o_orderdate"))
    for rows in (orders.filter("o_orderstatus = 'F'"), orders.filter("o_orderstatus <> 'F'")):
        archive.archive_write(rows.drop("o_orderstatus"), folder, "o_custkey", ["o_orderdate", "o_orderkey"], stamp=month)
    return archive.read_archive(spark, folder).select("yyyymm", "o_custkey", "o_orderkey", "o_orderdate")


@query(
    """
SELECT strftime(o_orderdate, '%Y%m') AS yyyymm, count(DISTINCT o_custkey) AS files FROM orders
WHERE strftime(o_orderdate, '%Y%m') >= '199801' GROUP BY 1
"""
)
def archive_pruned(spark, sf):
    """A filter on the month reads only those folders."""
    folder = new_shared_dir(spark, "archive-pruned")
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    archive.archive_write(orders, folder, "o_custkey", ["o_orderdate", "o_orderkey"], stamp=month_stamp(F.col("o_orderdate")))
    late = archive.read_archive(spark, folder).filter("yyyymm >= '199801'")
    return late.groupBy("yyyymm").agg(F.count(F.lit(1)).alias("files"))
