"""The composed jobs (SNK9, RTE1, JN3, UPD1, UPD2, AGG1)."""

from pyspark.sql import functions as F

from millrace.operators.sets import union
from millrace.plans.archive_notify import archive_and_notify, messages, notices, with_request_count
from millrace.plans.request_export import rejected, request_export, write_request_export
from millrace.session import new_shared_dir
from millrace.sinks.archive import read_archive
from millrace.sinks.outbox import Run, sender_address, with_content
from millrace.sinks.writers import append_run, read_runs
from queries.registry import query, table

INSTANT = "2024-07-15 18:05:09"


def run_facts():
    run = Run(
        recipients=F.concat(F.lit("a"), F.col("FileId").cast("string"), F.lit("@example.org;b@example.org")),
        sender=sender_address("flow", F.lit("Test"), "example.org"),
        executed_by=F.lit("operator"),
        archive_folder=F.lit("/out/archive/"),
        process=F.lit("nightly"),
        at=F.lit(INSTANT).cast("timestamp"),
        cc=F.when(F.col("FileId") % 2 == 0, F.concat(F.lit("c"), F.col("FileId").cast("string"), F.lit("@example.org"))),
        bcc=F.lit("audit@example.org;log@example.org"),
        attachments=F.concat(F.lit("/out/"), F.col("file_name")),
    )
    facts = {"Server": F.lit("files.example.org"), "File": F.col("file_name"), "Rows": F.col("RequestCount")}
    return run, facts


def customer_files(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("FileId"), F.col("c_name").alias("file_name"))


def finished_requests(spark, sf):
    """Every customer but those in debt, with the number of its finished orders, which may be 0."""
    orders = table(spark, sf, "orders")
    done = F.count(F.when(F.col("o_orderstatus") == "F", 1))
    counts = orders.groupBy(F.col("o_custkey").alias("FileId")).agg(done.alias("n"))
    rest = table(spark, sf, "customer").select(F.when(F.col("c_acctbal") >= 0, F.col("c_custkey")).alias("FileId"))
    listed = rest.filter("FileId IS NOT NULL")
    return listed.join(counts, "FileId", "left").select("FileId", F.coalesce("n", F.lit(0)).alias("requestCount"))


REQUESTS_SQL = """
SELECT c_custkey AS id, c_name AS file_name, coalesce(n, 0) AS cnt
FROM customer LEFT JOIN (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS n FROM orders GROUP BY 1)
ON o_custkey = c_custkey WHERE c_acctbal >= 0
"""
FOOT_SQL = """'<p>Executed on: ' || strftime(TIMESTAMP '2024-07-15 13:05:09', '%Y-%m-%d %I:%M:%S %p')
  || '</p><p>Executed by: operator</p><p>Archived files: \\out\\archive\\202407</p><p>Process: nightly</p></body></html>'"""


BODY_SQL = f"""CASE WHEN cnt > 0 THEN '<html><body>The export completed.<br>Server: files.example.org<br>File: ' || file_name
  || '<br>Rows: ' || cnt || '<br>' ELSE '<html><body>Nothing was exported because of validation errors.<br>' END || {FOOT_SQL}"""


@query(
    f"""
SELECT id AS "FileId", file_name, cnt AS "RequestCount", CASE WHEN cnt > 0 THEN 'output0' ELSE 'output1' END AS route,
       'flowTest@example.org' AS sender, 'a' || id || '@example.org,b@example.org' AS receiver,
       CASE WHEN id % 2 = 0 THEN 'c' || id || '@example.org' END AS cc, 'audit@example.org,log@example.org' AS bcc,
       '/out/' || file_name AS attachments,
       CASE WHEN cnt > 0 THEN 'Export completed' ELSE 'Export warning' END AS subject,
       {BODY_SQL} AS body,
       'HTML text' AS message_type, 100 AS batch_size, 3 AS retries
FROM ({REQUESTS_SQL})
"""
)
def outbox_messages(spark, sf):
    """Files that no request lists have a null count and get no message."""
    run, facts = run_facts()
    counted = with_request_count(customer_files(spark, sf), finished_requests(spark, sf))
    return messages(counted, notices(facts), run)


@query(
    f"""
SELECT id AS "FileId", CASE WHEN cnt > 0 THEN 'Export completed' ELSE 'Export warning' END || chr(10) || {BODY_SQL} AS content
FROM ({REQUESTS_SQL}) WHERE cnt > 0
"""
)
def outbox_content(spark, sf):
    """Only messages with a sender have content."""
    run, facts = run_facts()
    counted = with_request_count(customer_files(spark, sf), finished_requests(spark, sf))
    sent = messages(counted, notices(facts), run)
    return with_content(sent.withColumn("sender", F.when(F.col("RequestCount") > 0, F.col("sender")))).select("FileId", "content")


@query(
    f"""
SELECT 'archived' AS kind, '202407' AS detail, count(*) AS n FROM customer
UNION ALL SELECT 'message', CASE WHEN cnt > 0 THEN 'Export completed' ELSE 'Export warning' END, count(*) FROM ({REQUESTS_SQL}) GROUP BY 2
"""
)
def archive_notify_job(spark, sf):
    folder = new_shared_dir(spark, "notify-archive")
    run, facts = run_facts()
    arrived = customer_files(spark, sf).withColumn("modificationTime", F.lit(INSTANT).cast("timestamp"))
    sent = archive_and_notify(arrived, finished_requests(spark, sf), folder, run, facts)
    archived = read_archive(spark, folder)
    return union(
        archived.groupBy(F.lit("archived").alias("kind"), F.col("yyyymm").alias("detail")).agg(F.count(F.lit(1)).alias("n")),
        sent.groupBy(F.lit("message").alias("kind"), F.col("subject").alias("detail")).agg(F.count(F.lit(1)).alias("n")),
    )


def export_run(spark, sf, share=False):
    queue = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    valid = table(spark, sf, "orders").filter("o_orderpriority <> '5-LOW'").select("o_orderkey")
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_linestatus", "l_returnflag")
    items = items.withColumn("detail", F.when(F.col("l_partkey") % 2 == 0, F.col("l_partkey")))
    run = request_export(
        queue, valid, items, "o_orderkey", "l_linestatus", {"finished": "F", "open": "O"},
        F.col("l_returnflag") == "R", "detail", share,
    )
    return run, queue, valid


@query(
    """
SELECT 'export' AS part, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority <> '5-LOW') AND l_returnflag <> 'R'
UNION ALL SELECT 'summary', count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority <> '5-LOW') AND l_returnflag <> 'R'
UNION ALL SELECT 'log', count(*) FROM orders WHERE o_orderpriority <> '5-LOW'
UNION ALL SELECT 'errors', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority <> '5-LOW') AND l_returnflag = 'R'
"""
)
def request_export_written(spark, sf):
    """The parts of the job as files, read again."""
    folder = new_shared_dir(spark, "request-export")
    report = write_request_export(export_run(spark, sf, share=True)[0], folder)
    n = F.count(F.lit(1)).alias("n")
    return union(
        spark.read.text(f"{folder}/export").agg(n).select(F.lit("export").alias("part"), "n"),
        spark.read.csv(f"{folder}/summary", header=True).agg(n).select(F.lit("summary").alias("part"), "n"),
        read_runs(spark, f"{folder}/log").agg(n).select(F.lit("log").alias("part"), "n"),
        spark.read.csv(report, header=True).agg(n).select(F.lit("errors").alias("part"), "n"),
    )


VALID_SQL = "SELECT o_orderkey FROM orders WHERE o_orderpriority <> '5-LOW'"


@query(
    f"""
SELECT l_orderkey AS o_orderkey, count(*) FILTER (WHERE l_linestatus = 'F') AS finished, count(*) FILTER (WHERE l_linestatus = 'O') AS open
FROM lineitem WHERE l_orderkey IN ({VALID_SQL}) AND l_returnflag <> 'R' GROUP BY 1
"""
)
def request_export_summary(spark, sf):
    return export_run(spark, sf)[0].summary


@query(
    f"""
SELECT l_orderkey || ',' || l_partkey || ',' || l_linestatus || ',' || l_returnflag || ',' ||
       CASE l_partkey % 2 WHEN 0 THEN l_partkey::VARCHAR ELSE '' END || ',Fulfilled' AS line
FROM lineitem WHERE l_orderkey IN ({VALID_SQL}) AND l_returnflag <> 'R'
"""
)
def request_export_lines(spark, sf):
    return export_run(spark, sf)[0].export_lines


@query(
    f"""
SELECT 'requests' AS part, count(*) AS n FROM orders WHERE o_orderpriority <> '5-LOW'
UNION ALL SELECT 'nulls in errors', count(*) FROM lineitem WHERE l_orderkey IN ({VALID_SQL}) AND l_returnflag = 'R' AND l_partkey % 2 = 1
UNION ALL SELECT 'errors', count(*) FROM lineitem WHERE l_orderkey IN ({VALID_SQL}) AND l_returnflag = 'R'
UNION ALL SELECT 'log complete', count(*) FROM orders WHERE o_orderpriority <> '5-LOW'
UNION ALL SELECT 'queue ' || o_orderstatus, count(*) FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY 1
UNION ALL SELECT 'rejected', count(*) FROM orders WHERE o_orderpriority = '5-LOW'
"""
)
def request_export_counts(spark, sf):
    """All branches of the job, reconciled."""
    run, queue, valid = export_run(spark, sf, share=True)
    n = F.count(F.lit(1)).alias("n")
    return union(
        run.request_count.select(F.lit("requests").alias("part"), F.col("RequestCount").alias("n")),
        run.error_count.select(F.lit("nulls in errors").alias("part"), F.col("ErrorCount").alias("n")),
        run.errors.groupBy(F.lit("errors").alias("part")).agg(n),
        run.log.groupBy(F.concat(F.lit("log "), "status").alias("part")).agg(n),
        run.queue.groupBy(F.concat(F.lit("queue "), "status").alias("part")).agg(n),
        rejected(queue, valid, "o_orderkey").groupBy(F.lit("rejected").alias("part")).agg(n),
    )


@query(
    """
SELECT run, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM (SELECT o_orderkey, CASE WHEN o_orderdate < DATE '1996-01-01' THEN 'early' ELSE 'late' END AS run FROM orders)
GROUP BY run
"""
)
def log_repeated_runs(spark, sf):
    """Two runs into one log, the first of which is repeated after it had written too little: it is there once."""
    folder = new_shared_dir(spark, "run-log")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    early = orders.filter("o_orderdate < DATE '1996-01-01'")
    for name, rows in (("early", early.filter("o_orderkey % 2 = 0")), ("late", orders.filter("o_orderdate >= DATE '1996-01-01'")), ("early", early)):
        append_run(rows, folder, name)
    return read_runs(spark, folder).groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))
