"""Scan, decode and stage (SRC2, SRC3, RTE2, RTE3, SNK2, AGG2, MET1)."""

from pyspark.sql import functions as F

from millrace.operators.aggregates import count_rows
from millrace.operators.routing import split_errors
from millrace.operators.sets import union
from millrace.plans.staging_load import load_staging, staged_from_files, staged_from_lines
from millrace.session import new_shared_dir
from millrace.sources.delimited import CORRUPT, decode_bytes, parse_delimited, parse_text, with_parsed_line
from queries.registry import query, table


def order_lines(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.select(F.concat_ws("^", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority").alias("line"))


ORDER_FIELDS = ("order_key", "status", "priority")
ORDER_ROWS = """
SELECT CAST(o_orderkey AS VARCHAR) AS order_key, o_orderstatus AS status, o_orderpriority AS priority FROM orders
"""


@query(ORDER_ROWS)
def stage_parse_caret(spark, sf):
    return staged_from_lines(order_lines(spark, sf), "line", ORDER_FIELDS).rows


@query('SELECT count(*) AS "rowCount" FROM orders HAVING count(*) > 0')
def stage_row_count(spark, sf):
    lines = table(spark, sf, "orders").select(F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("line"))
    return staged_from_lines(lines, "line").count


@query(ORDER_ROWS)
def stage_parse_files(spark, sf):
    folder = new_shared_dir(spark, "staging-in")
    order_lines(spark, sf).write.text(folder)
    return staged_from_files(spark, folder, ORDER_FIELDS).rows


@query(
    """
SELECT 'good' AS view, CASE n_chars % 4 WHEN 1 THEN 'd' || doc_id || '^' || lang ELSE 'd' || doc_id END AS record,
       NULL AS line
FROM documents WHERE n_chars % 4 <> 0
UNION ALL
SELECT 'bad', 'd' || doc_id, 'd' || doc_id || '^' || lang FROM documents WHERE n_chars % 4 = 0
"""
)
def parse_error_split(spark, sf):
    docs = table(spark, sf, "documents")
    plain = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    two = F.concat(plain, F.lit("^"), "lang")
    case = F.col("n_chars") % 4
    line = (
        F.when(case == 0, two)
        .when(case == 1, F.concat(F.lit('"'), two, F.lit('"')))
        .when(case == 2, F.concat(F.lit(" "), plain, F.lit("  ")))
        .otherwise(plain)
    )
    parsed = with_parsed_line(docs.select(line.alias("line")), "line", ("record",)).select("record", CORRUPT)
    good, bad = split_errors(parsed)
    return union(
        good.select(F.lit("good").alias("view"), "record", F.lit(None).cast("string").alias("line")),
        bad.select(F.lit("bad").alias("view"), "record", F.col(CORRUPT).alias("line")),
    )


@query(
    """
SELECT 'in table' AS metric, count(*) AS n FROM orders
UNION ALL SELECT 'observed', count(*) FROM orders
UNION ALL SELECT 'bad', 0
"""
)
def stage_load_job(spark, sf):
    """The whole job: files to table, with the count taken from the write."""
    source, target, bad = (new_shared_dir(spark, name) for name in ("staging-in", "staging-table", "staging-bad"))
    table(spark, sf, "orders").select(F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))).write.text(source)
    name = "staging_" + target[-32:]
    spark.sql(f"CREATE TABLE {name} (FileRecord STRING) USING parquet LOCATION '{target}'")
    observed = load_staging(spark, source, name, bad)
    bad_rows = spark.read.schema("FileRecord string").csv(bad, header=True)
    return union(
        count_rows(spark.table(name)).select(F.lit("in table").alias("metric"), "n"),
        spark.range(1).select(F.lit("observed").alias("metric"), F.lit(observed).cast("bigint").alias("n")),
        count_rows(bad_rows).select(F.lit("bad").alias("metric"), "n"),
    )


@query("SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN NULL ELSE text END AS text FROM documents")
def decode_bom(spark, sf):
    """UTF-8, UTF-8 with mark, UTF-16 with mark, and bytes that are no text."""
    text = F.col("text")
    content = (
        F.when(F.col("doc_id") % 4 == 0, F.encode(text, "UTF-8"))
        .when(F.col("doc_id") % 4 == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8")))
        .when(F.col("doc_id") % 4 == 2, F.encode(text, "UTF-16"))
        .otherwise(F.concat(F.encode(text, "UTF-8"), F.unhex(F.lit("FF"))))
    )
    return decode_bytes(table(spark, sf, "documents").select("doc_id", content.alias("content")))


@query(
    """
SELECT doc_id, u.line_no, trim(u.line) AS record
FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, line_no)
WHERE trim(u.line) <> ''
"""
)
def parse_text_lines(spark, sf):
    """Every line of every document as a record with its number."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    good, _ = split_errors(parse_text(docs, "text", ("record",)))
    return good.select("doc_id", "line_no", "record")


@query("SELECT CAST(p_partkey AS VARCHAR) AS part_key, p_name AS part_name FROM part")
def parse_header_files(spark, sf):
    """Files whose first line is a header."""
    folder = new_shared_dir(spark, "header-in")
    part = table(spark, sf, "part")
    fields = ("part_key", "part_name")
    part.select(F.col("p_partkey").cast("string").alias("part_key"), F.col("p_name").alias("part_name")).write.csv(
        folder, header=True, sep="^"
    )
    return split_errors(parse_delimited(spark, folder, fields, header=True))[0]
