"""Row operators: mapping, filters, routes (PRJ, FLT, RTE1-RTE3, SET, SC1-SC7, SC19, SC20, UDF1, UDF2)."""

from pyspark.sql import functions as F

from millrace.functions import choice
from millrace.functions.text import formatted, joined, part_at, replaced
from millrace.operators import filters, mapping, routing, sets
from millrace.operators.aggregates import distinct_rows, row_count
from millrace.operators.joins import anti_join, lookup, semi_join
from millrace.sources.tables import query_view
from queries.registry import query, table


@query("SELECT o_orderkey, o_totalprice FROM orders")
def checked_rows(spark, sf):
    """The policy that stops at the first bad row: here there is none."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return routing.fail_on_errors(orders, F.col("o_totalprice") < 0, "a price below zero")


@query("SELECT c_custkey AS id, upper(c_name) AS name, c_nationkey AS nation, lower(c_mktsegment) AS segment FROM customer")
def mapper_project(spark, sf):
    """Nested targets, unmapped fields dropped."""
    docs = mapping.mapper(
        table(spark, sf, "customer"),
        [
            ("$id", F.col("c_custkey")),
            ("$name", F.upper("c_name")),
            ("$home.nation", F.col("c_nationkey")),
            ("$home.segment", F.lower("c_mktsegment")),
        ],
    )
    return docs.select("id", "name", "home.nation", "home.segment")


@query("SELECT *, lower(c_mktsegment) AS segment FROM customer")
def mapper_passthrough(spark, sf):
    return mapping.mapper(table(spark, sf, "customer"), [("$segment", F.lower("c_mktsegment"))], pass_through=True)


@query(
    """
SELECT c_custkey AS id, upper(c_name) AS name, CAST(CAST(CAST(c_nationkey AS VARCHAR) AS INTEGER) + 1 AS VARCHAR) AS age,
       TRY_CAST(substr(c_name, 10) AS BIGINT) AS number, TRY_CAST(c_mktsegment AS BIGINT) AS no_number
FROM customer
"""
)
def row_map_cast(spark, sf):
    texts = table(spark, sf, "customer").withColumn("age", F.col("c_nationkey").cast("string"))
    mapped = mapping.row_map(
        texts,
        {
            "id": F.col("c_custkey"),
            "name": F.upper("c_name"),
            "age": (F.col("age").cast("int") + 1).cast("string"),
            "number": F.substring("c_name", 10, 20),
            "no_number": F.col("c_mktsegment"),
        },
    )
    return mapping.cast_columns(mapped, {"number": "bigint", "no_number": "bigint"}, tolerant=True)


@query(
    """
SELECT p_partkey, p_name AS product_name, p_brand, p_size, p_retailprice, 'Fulfilled' AS status, p_size + 1 AS next_size
FROM part
"""
)
def add_constant_expr(spark, sf):
    return mapping.chain(
        table(spark, sf, "part"),
        lambda df: mapping.drop_columns(df, ["p_type"]),
        lambda df: mapping.rename(df, {"p_name": "product_name"}),
        lambda df: mapping.add_constant(df, "status", "Fulfilled"),
        lambda df: mapping.increment(df, "p_size", "next_size"),
    )


@query("SELECT p_brand, p_partkey FROM part")
def select_exit(spark, sf):
    return mapping.select_columns(table(spark, sf, "part"), ["p_brand", "p_partkey"])


@query("SELECT * FROM supplier")
def select_all_identity(spark, sf):
    return mapping.select_all(table(spark, sf, "supplier"))


@query(
    """
SELECT o_orderkey, o_orderpriority, true AS is_valid FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
"""
)
def validate_ids_list(spark, sf):
    valid = ["1-URGENT", "2-HIGH"]
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    flagged = mapping.flag(orders, "is_valid", F.col("o_orderpriority").isin(valid))
    return filters.where(flagged, F.col("is_valid"))


@query(
    """
SELECT o_orderkey, o_custkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
       THEN 'valid' ELSE 'rejected' END AS verdict
FROM orders
"""
)
def validate_ids_semi(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    ids = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return sets.union(
        semi_join(orders, ids, "o_custkey").withColumn("verdict", F.lit("valid")),
        anti_join(orders, ids, "o_custkey").withColumn("verdict", F.lit("rejected")),
    )


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice > 1000 AND o_orderpriority <> '5-LOW'")
def filter_compare(spark, sf):
    """Equality, comparison and inequality; all of it reaches the scan."""
    orders = filters.where_in(table(spark, sf, "orders"), "o_orderstatus", ["F", "O"])
    return filters.where(orders, (F.col("o_totalprice") > 1000) & (F.col("o_orderpriority") != "5-LOW")).select("o_orderkey")


@query("SELECT * FROM labels WHERE quality = 1 OR toxic = 1")
def filter_any_flag(spark, sf):
    return filters.where_any(table(spark, sf, "labels"), ["quality", "toxic"], lambda c: c == 1)


@query(
    """
SELECT d.doc_id, CASE WHEN l.quality IS NULL THEN 'null' ELSE 'present' END AS state
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""
)
def filter_nulls(spark, sf):
    labelled = lookup(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")
    return sets.union(
        filters.where_null(labelled, "quality").select("doc_id", F.lit("null").alias("state")),
        filters.where_not_null(labelled, "quality").select("doc_id", F.lit("present").alias("state")),
    )


@query(
    """
SELECT * FROM (SELECT page_id, string_split(url, '/')[4] AS lang FROM pages WHERE string_split(url, '/')[4] IN ('en', 'fr')) AS temp
"""
)
def subquery_filter(spark, sf):
    return query_view(
        table(spark, sf, "pages"),
        "page_rows",
        """SELECT * FROM (SELECT page_id, get(split(url, '/'), 3) AS lang FROM page_rows
           WHERE get(split(url, '/'), 3) IN (:first, :second)) AS temp""",
        {"first": "en", "second": "fr"},
    )


@query(
    """
SELECT page_id, CASE WHEN string_split(url, '/')[1] = 'http:' THEN 'account_dev'
                     WHEN starts_with(string_split(url, '/')[3], 'm.') THEN 'account_qa' ELSE 'account_prod' END AS account,
       string_split(url, '/')[9] AS part_nine
FROM pages
"""
)
def case_env(spark, sf):
    """Account by environment; a part that a path lacks is null."""
    url = F.col("url")
    account = choice.case_chain(
        [(part_at(url, "/", 0) == "http:", "account_dev"), (part_at(url, "/", 2).startswith("m."), "account_qa")],
        "account_prod",
    )
    return table(spark, sf, "pages").select("page_id", account.alias("account"), part_at(url, "/", 8).alias("part_nine"))


@query(
    """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'other' END AS setting FROM orders
"""
)
def config_lookup(spark, sf):
    config = F.create_map(F.lit("F"), F.lit("finished"), F.lit("O"), F.lit("open"))
    setting = choice.config_value(config, F.col("o_orderstatus"), "other")
    return table(spark, sf, "orders").select("o_orderkey", setting.alias("setting"))


@query(
    """
SELECT d.doc_id,
       'doc ' || d.doc_id || ' quality ' || coalesce(CAST(l.quality AS VARCHAR), '') AS message,
       'q' || CAST(l.quality AS VARCHAR) AS quality_key,
       coalesce(CAST(l.toxic AS VARCHAR), 'unknown') AS toxic_text
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""
)
def concat_nulls(spark, sf):
    """A null part makes a key null and leaves a message whole."""
    labelled = lookup(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")
    return labelled.select(
        "doc_id",
        joined("doc ", F.col("doc_id"), " quality ", F.col("quality"), null_as="").alias("message"),
        joined("q", F.col("quality")).alias("quality_key"),
        choice.value_or("unknown", F.col("toxic").cast("string")).alias("toxic_text"),
    )


BALANCE_ROUTES = """
SELECT c_custkey, 'paid' AS route FROM customer WHERE c_acctbal > 0
UNION ALL SELECT c_custkey, 'due' FROM customer WHERE c_acctbal <= 0
UNION ALL SELECT c_custkey, 'rich' FROM customer WHERE c_acctbal > 5000
"""


def balance_routes():
    balance = F.col("c_acctbal")
    return [(balance > 0, "paid"), (balance <= 0, "due"), (balance > 5000, "rich")]


@query(BALANCE_ROUTES)
def route_all_match(spark, sf):
    routed = routing.route(table(spark, sf, "customer"), balance_routes())
    return sets.union(*[df.select("c_custkey", F.lit(name).alias("route")) for name, df in routed.items()])


@query(BALANCE_ROUTES)
def route_single_pass(spark, sf):
    return routing.with_route(table(spark, sf, "customer"), balance_routes()).select("c_custkey", "route")


@query("SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'rich' WHEN c_acctbal > 0 THEN 'paid' ELSE 'due' END AS route FROM customer")
def route_first_match(spark, sf):
    paid, due, rich = balance_routes()
    routed = routing.route(table(spark, sf, "customer"), [rich, paid, due], first_match=True)
    return sets.union(*[df.select("c_custkey", F.lit(name).alias("route")) for name, df in routed.items()])


@query(
    """
SELECT d.doc_id, CASE WHEN l.quality > 0 THEN 'output0' WHEN l.quality <= 0 THEN 'output1' ELSE 'rest' END AS route
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""
)
def route_null_otherwise(spark, sf):
    """Nulls match no comparison; the rest output takes them."""
    labelled = lookup(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")
    routes = [(F.col("quality") > 0, "output0"), (F.col("quality") <= 0, "output1")]
    routed = routing.route(labelled, routes, otherwise="rest")
    return sets.union(*[df.select("doc_id", F.lit(name).alias("route")) for name, df in routed.items()])


@query("SELECT 'row' AS branch, c_custkey AS n FROM customer UNION ALL SELECT 'count', count(*) FROM customer")
def copy_branches(spark, sf):
    first, second = routing.copy(table(spark, sf, "customer"))
    return sets.union_positional(
        first.select(F.lit("row").alias("branch"), F.col("c_custkey").alias("n")),
        row_count(second).select(F.lit("count"), "rowCount"),
    )


@query(
    """
SELECT c_mktsegment, count(*) AS n, (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS kept FROM customer
WHERE c_acctbal > 0 GROUP BY c_mktsegment
"""
)
def copy_kept(spark, sf):
    """Two actions on one flow that is stored once."""
    first, second = routing.copy(table(spark, sf, "customer").filter("c_acctbal > 0").select("c_mktsegment"), keep=True)
    kept = first.count()
    return second.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")).withColumn("kept", F.lit(kept).cast("bigint"))


@query(
    """
SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, NULL AS segment FROM supplier
UNION ALL BY NAME
SELECT c_mktsegment AS segment, c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer
"""
)
def union_by_name(spark, sf):
    suppliers = table(spark, sf, "supplier").selectExpr("s_suppkey AS id", "s_name AS name", "s_acctbal AS balance")
    customers = table(spark, sf, "customer").selectExpr(
        "c_mktsegment AS segment", "c_custkey AS id", "c_name AS name", "c_acctbal AS balance"
    )
    return sets.union(suppliers, customers)


@query("SELECT lang AS a, source AS b FROM documents UNION ALL SELECT source, lang FROM documents")
def union_positional(spark, sf):
    docs = table(spark, sf, "documents")
    return sets.union_positional(docs.selectExpr("lang AS a", "source AS b"), docs.select("source", "lang"))


@query("SELECT DISTINCT lang, source FROM documents", name="distinct_rows")
def distinct_rows_lang_source(spark, sf):
    return distinct_rows(table(spark, sf, "documents").select("lang", "source"))


@query("SELECT page_id, replace(url, 'example', '') AS path, replace(replace(url, '/', '\\'), ';', ',') AS shown FROM pages")
def path_replace(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id",
        replaced(url, "example", "").alias("path"),
        replaced(replaced(url, "/", "\\"), ";", ",").alias("shown"),
    )


@query("SELECT o_orderkey, printf('%d,%s,%s', o_orderkey, o_orderstatus, o_orderpriority) AS line FROM orders")
def format_row(spark, sf):
    line = formatted("%d,%s,%s", F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority"))
    return table(spark, sf, "orders").select("o_orderkey", line.alias("line"))


@query("SELECT c_custkey, lower(c_mktsegment) AS segment FROM customer WHERE c_acctbal > 0")
def script_transform(spark, sf):
    def user_step(df):
        return df.filter("c_acctbal > 0").select("c_custkey", F.lower("c_mktsegment").alias("segment"))

    return mapping.script(table(spark, sf, "customer"), user_step)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) * 2 AS doubled FROM events")
def script_record_batches(spark, sf):
    """User code without a Column form, over record batches."""

    def double_k(batches):
        import json

        for batch in batches:
            yield batch.assign(doubled=[json.loads(p)["k"] * 2 for p in batch["props"]])[["event_id", "doubled"]]

    return mapping.script_batches(table(spark, sf, "events").select("event_id", "props"), double_k, "event_id bigint, doubled bigint")


@query(
    """
SELECT c_nationkey, count(*) AS customers FROM customer WHERE c_acctbal > 0 GROUP BY c_nationkey HAVING count(*) > 1
"""
)
def step_chain(spark, sf):
    return mapping.chain(
        table(spark, sf, "customer"),
        lambda df: df.filter("c_acctbal > 0"),
        lambda df: df.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers")),
        lambda df: df.filter("customers > 1"),
    )
