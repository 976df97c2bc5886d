"""Joins, aggregates, ordered operators, updates, tables (JN, AGG, WIN, SRT, LIM, UPD, SRC7-SRC10, UDF3)."""

from pyspark.sql import functions as F

from millrace.operators import aggregates, joins, ordering, updates
from millrace.operators.sets import union
from millrace.session import new_shared_dir
from millrace.sources.tables import NamedQuery, TableFunction, literal_rows, query_view, read_table, same_key, sql_query
from queries.registry import query, table


@query(
    """
SELECT o.o_orderkey, o.o_custkey, c.c_name, c.c_mktsegment
FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o.o_custkey = c.c_custkey
"""
)
def lookup_passthrough(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf, "customer").filter("c_acctbal > 0")
    return joins.lookup(
        orders, customers.select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment"), "o_custkey"
    ).select("o_orderkey", "o_custkey", "c_name", "c_mktsegment")


@query("SELECT c.c_custkey AS o_custkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
def lookup_result_only(spark, sf):
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return joins.lookup(table(spark, sf, "orders").select("o_custkey"), customers, "o_custkey", False, False)


@query(
    """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, o_custkey, o_orderstatus
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""
)
def enrich_inner(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus")
    return joins.join_equi(lines, orders, "l_orderkey")


@query(
    """
SELECT o_orderkey, o_orderstatus, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
       THEN 'log' ELSE 'queue' END AS place
FROM orders
"""
)
def queue_to_log(spark, sf):
    queue = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    done = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return updates.with_destination(queue, done, ["o_orderkey"], "place")


@query(
    """
SELECT o_orderkey, CASE WHEN hit THEN 'complete' ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN hit THEN 'returned' END AS note
FROM (SELECT o_orderkey, o_orderstatus,
             EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS hit FROM orders)
"""
)
def update_status(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    keys = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    changes = {"o_orderstatus": F.lit("complete"), "note": F.lit("returned")}
    return updates.update_matched(orders, keys, ["o_orderkey"], changes)


@query(
    """
SELECT user_id, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END)::BIGINT AS clicks,
       sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)::BIGINT AS purchases
FROM events GROUP BY user_id
"""
)
def summary_by_type(spark, sf):
    values = {"clicks": "click", "purchases": "purchase"}
    return aggregates.conditional_count(table(spark, sf, "events"), ["user_id"], "event_type", values)


@query(
    """
SELECT d.lang, count(*) FILTER (WHERE l.quality IS NULL) AS unlabelled
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang
"""
)
def null_count(spark, sf):
    labelled = joins.lookup(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), "doc_id")
    return aggregates.count_nulls(labelled, "quality", "unlabelled", ["lang"])


@query(
    """
SELECT d.lang, count(l.quality) AS labelled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang
"""
)
def present_count(spark, sf):
    labelled = joins.lookup(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), "doc_id")
    return aggregates.count_column(labelled, "quality", "labelled", ["lang"])


@query('SELECT o_orderstatus, count(o_orderkey) AS "RequestCount" FROM orders GROUP BY o_orderstatus')
def request_count(spark, sf):
    return aggregates.count_column(table(spark, sf, "orders"), "o_orderkey", "RequestCount", ["o_orderstatus"])


@query("SELECT count(*) AS n FROM lineitem")
def count_all_rows(spark, sf):
    return aggregates.count_rows(table(spark, sf, "lineitem"))


@query("SELECT o_orderpriority AS priority FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 1")
def first_scalar(spark, sf):
    return aggregates.first_value(table(spark, sf, "orders"), "o_orderpriority", ["o_orderdate", "o_orderkey"], "priority")


@query(
    """
SELECT event_id, user_id, row_number() OVER w AS row_num, lag(event_type, 1) OVER w AS delayed
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
"""
)
def lag_rownum(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    windows = ordering.running(events, ["user_id"], ["ts", "event_id"], row_number="row_num", previous={"delayed": "event_type"})
    return windows.select("event_id", "user_id", "row_num", "delayed")


@query(
    """
SELECT event_id, row_number() OVER w AS delayed_row_id, lag(event_id, 1) OVER w AS delayed_row
FROM events WINDOW w AS (ORDER BY ts, event_id)
"""
)
def lag_rownum_whole_table(spark, sf):
    """One sequence over all rows."""
    events = table(spark, sf, "events").select("event_id", "ts")
    windows = ordering.running(events, [], ["ts", "event_id"], row_number="delayed_row_id", previous={"delayed_row": "event_id"})
    return windows.drop("ts")


@query(
    """
SELECT event_id, user_id, count(event_id) OVER (PARTITION BY user_id ORDER BY event_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lower_ids
FROM events
"""
)
def running_lower_count(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id")
    return ordering.running(events, ["user_id"], ["event_id"], count_before={"lower_ids": "event_id"})


@query(
    """
SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events)
WHERE r - 1 <= 1
"""
)
def lower_count_at_most_one(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id")
    counted = ordering.running(events, ["user_id"], ["event_id"], count_before={"lower_ids": "event_id"})
    return counted.filter("lower_ids <= 1").select("event_id", "user_id")


@query(
    """
SELECT l_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS total_count
FROM (SELECT o_orderkey AS l_orderkey, * FROM orders)
"""
)
def running_total_count(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
    counted = ordering.running(orders, ["o_custkey"], ["o_orderdate", "l_orderkey"], row_number="total_count")
    return counted.select("l_orderkey", "o_custkey", "total_count")


@query(
    """
SELECT doc_id, CASE WHEN r = 1 THEN source || '.json' ELSE source || '_' || (r - 1) || '.json' END AS unique_name
FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents)
"""
)
def unique_names(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.concat("source", F.lit(".json")).alias("name"))
    return ordering.unique_names(docs, "name", ["doc_id"]).select("doc_id", "unique_name")


@query(
    """
WITH taken AS (
  SELECT DISTINCT d.source, CASE WHEN l.toxic = 1 THEN 0 ELSE l.doc_id % 9 + 1 END AS k
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE l.toxic = 1 OR l.doc_id % 5 = 0),
arrivals AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id)
         - CASE WHEN EXISTS (SELECT 1 FROM taken t WHERE t.source = d.source AND t.k = 0) THEN 0 ELSE 1 END AS wish
  FROM documents d),
sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
free AS (
  SELECT source, k, row_number() OVER (PARTITION BY source ORDER BY k) AS nth
  FROM (SELECT s.source, u.k FROM sizes s, unnest(generate_series(1, s.n + 10)) AS u(k)) c
  WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.source = c.source AND t.k = c.k))
SELECT a.doc_id, a.source || CASE WHEN a.wish = 0 THEN '' ELSE '_' || f.k END || '.json' AS unique_name
FROM arrivals a LEFT JOIN free f ON f.source = a.source AND f.nth = a.wish
"""
)
def unique_names_taken(spark, sf):
    """Some names and some numbers exist already."""
    docs = table(spark, sf, "documents").select("doc_id", "source")
    labels = table(spark, sf, "labels").filter("toxic = 1 OR doc_id % 5 = 0")
    number = F.when(F.col("toxic") == 1, "").otherwise(F.concat(F.lit("_"), (F.col("doc_id") % 9 + 1).cast("string")))
    taken = joins.join_equi(labels, docs, "doc_id").select(F.concat("source", number, F.lit(".json")).alias("name"))
    arrivals = docs.select("doc_id", F.concat("source", F.lit(".json")).alias("name"))
    return ordering.unique_names(arrivals, "name", ["doc_id"], taken).select("doc_id", "unique_name")


@query("SELECT * FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 10 OFFSET 5)")
def tail_n_offset(spark, sf):
    return ordering.tail(table(spark, sf, "events"), ["ts", "event_id"], n=10, offset=5)


@query("SELECT * FROM events ORDER BY event_id LIMIT 1000")
def limit_sorted(spark, sf):
    return ordering.limit(table(spark, sf, "events"), 1000, ["event_id"])


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_name, c_custkey")
def sort_ascending(spark, sf):
    return ordering.sort_ascending(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_name", "c_custkey")


@query(
    """
SELECT o_orderkey, w.weight FROM orders o
JOIN (VALUES ('1-URGENT', 5), ('2-HIGH', 4), ('3-MEDIUM', 3)) w(priority, weight) ON o.o_orderpriority = w.priority
""",
    name="literal_rows",
)
def literal_rows_join(spark, sf):
    weights = literal_rows(spark, [("1-URGENT", 5), ("2-HIGH", 4), ("3-MEDIUM", 3)], "o_orderpriority string, weight int")
    return joins.join_equi(table(spark, sf, "orders"), weights, "o_orderpriority").select("o_orderkey", "weight")


@query(
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = 5 AND o_orderdate >= DATE '1995-01-01'",
    name="query_view",
)
def query_view_args(spark, sf):
    return query_view(
        table(spark, sf, "orders"),
        "order_rows",
        "SELECT o_orderkey, o_orderstatus FROM order_rows WHERE o_custkey = :id AND o_orderdate >= to_date(:first_day)",
        {"id": 5, "first_day": "1995-01-01"},
    )


@query(
    """
SELECT c_mktsegment, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderstatus = 'F' GROUP BY c_mktsegment
"""
)
def named_query(spark, sf):
    orders_of_status = NamedQuery(
        "orders_of_status",
        """SELECT c_mktsegment, count(*) AS orders FROM {o} JOIN {c} ON o_custkey = c_custkey
           WHERE o_orderstatus = :status GROUP BY c_mktsegment""",
    )
    frames = {"o": table(spark, sf, "orders"), "c": table(spark, sf, "customer")}
    return orders_of_status(spark, frames, status="F")


@query("SELECT user_id, count(*) AS events, min(event_id) AS first_event FROM events WHERE event_type = 'click' GROUP BY user_id")
def sql_over_frames(spark, sf):
    return sql_query(
        spark,
        """SELECT user_id, count(*) AS events, min(event_id) AS first_event FROM {events}
           WHERE event_type = :kind GROUP BY user_id""",
        {"kind": "click"},
        events=table(spark, sf, "events"),
    )


@query("SELECT * FROM supplier")
def table_scan(spark, sf):
    """A catalog table read by its name."""
    target = new_shared_dir(spark, "supplier-table")
    name = "supplier_" + target[-32:]
    table(spark, sf, "supplier").write.parquet(target)
    spark.catalog.createTable(name, path=target, source="parquet")
    return read_table(spark, name)


@query(
    """
SELECT c.*, o.* FROM (SELECT c_custkey, c_name, c_acctbal FROM customer) AS c LEFT JOIN LATERAL
  (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c.c_custkey AND o_totalprice > 20 * c.c_acctbal
   ORDER BY o_totalprice DESC, o_orderkey LIMIT 3) AS o ON true
"""
)
def select_for_each(spark, sf):
    """A SELECT run for each customer: the three dearest orders above a limit that depends on the customer."""
    customers = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    return sql_query(
        spark,
        f"""SELECT o_orderkey, o_totalprice FROM {{orders}} WHERE {same_key("o_custkey", "input.c_custkey")}
            AND o_totalprice > :times * input.c_acctbal ORDER BY o_totalprice DESC, o_orderkey LIMIT 3""",
        {"times": 20},
        input=customers,
        pass_through=True,
        orders=table(spark, sf, "orders"),
    )


@query(
    """
SELECT r.* FROM customer AS c CROSS JOIN LATERAL (SELECT count(*) AS n_orders, sum(o_totalprice::DECIMAL(18, 2))::DOUBLE AS total, min(o_orderkey) AS first_order
  FROM orders WHERE o_custkey = c.c_custkey AND o_orderdate >= DATE '1995-01-01') AS r
"""
)
def select_for_each_alone(spark, sf):
    """The result alone, of a SELECT that aggregates."""
    return sql_query(
        spark,
        f"""SELECT count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total, min(o_orderkey) AS first_order
            FROM {{orders}} WHERE {same_key("o_custkey", "input.c_custkey")} AND o_orderdate >= to_date(:first_day)""",
        {"first_day": "1995-01-01"},
        input=table(spark, sf, "customer"),
        orders=table(spark, sf, "orders"),
    )


def dear_orders(spark, sf):
    return TableFunction(
        spark,
        "dear_orders",
        "customer_key BIGINT, least DOUBLE",
        "o_orderkey BIGINT, o_totalprice DOUBLE",
        f"""SELECT o_orderkey, o_totalprice FROM {{orders}} WHERE {same_key("o_custkey", "customer_key")} AND o_totalprice > least
            ORDER BY o_totalprice DESC, o_orderkey LIMIT 2""",
        orders=table(spark, sf, "orders"),
    )


@query(
    """
SELECT c.c_custkey, c.c_mktsegment, o.* FROM customer AS c JOIN LATERAL
  (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c.c_custkey AND o_totalprice > 10 * c.c_acctbal
   ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) AS o ON true
"""
)
def table_function_for_each(spark, sf):
    """A table function called for each row, with columns and an expression as arguments."""
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    found = dear_orders(spark, sf).for_each(customers, "input.c_custkey", "10 * input.c_acctbal", keep_empty=False)
    return found.drop("c_acctbal")


@query(
    """
SELECT c.c_custkey, r.* FROM customer AS c CROSS JOIN LATERAL (SELECT count(*) AS orders, max(o_totalprice) AS dearest FROM
  (SELECT o_totalprice FROM orders WHERE o_custkey = c.c_custkey AND o_totalprice > 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) AS o) AS r
"""
)
def table_function_nested(spark, sf):
    """A table function that calls another one."""
    dear_orders(spark, sf)
    summary = TableFunction(
        spark,
        "dear_orders_summary",
        "customer_key BIGINT",
        "orders BIGINT, dearest DOUBLE",
        "SELECT count(*), max(o_totalprice) FROM dear_orders(customer_key, 1000D)",
    )
    return summary.for_each(table(spark, sf, "customer").select("c_custkey"), "input.c_custkey")
