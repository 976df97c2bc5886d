"""Tables, SQL over frames, and literal rows (SRC7-SRC10, UDF3)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def sql_query(
    spark: SparkSession,
    sql: str,
    args: Mapping | None = None,
    input: DataFrame | None = None,
    pass_through: bool = False,
    keep_empty: bool = True,
    **frames: DataFrame,
) -> DataFrame:
    """A SELECT with bound parameters (`:id`) over tables, or over frames named in braces (`{orders}`).

    Values are never put into the text. With `input` the SELECT runs once for each of its rows, whose fields it names as
    `input.field`; ordering and limits hold for each row. Its result comes with the row if `pass_through`, a field of the result
    in the place of the row's of that name, and alone otherwise; rows without a result stay, with nulls, if `keep_empty`.

    Spark turns this into joins. Write keys with `same_key`: it tells Spark to join on them before it looks at other
    conditions. A SELECT that would compare every input row with every row of a table is refused.
    """
    if input is None:
        return spark.sql(sql, args=dict(args or {}), **frames)
    return _for_each(spark, f"({sql})", args, input, pass_through, keep_empty, frames)


def same_key(inner: str, outer: str) -> str:
    """SQL text: a key of a SELECT's table is the same as a field of the row it runs for (null is no key).

    Written as a plain equality, Spark takes the key out of the SELECT and joins it afterwards: all other conditions are
    then tried on every pair of rows, and in a table function a limit would hold for all keys together.
    """
    return f"(struct({inner}) = struct({outer}) AND {inner} IS NOT NULL)"


def _for_each(spark, call: str, args, input: DataFrame, pass_through: bool, keep_empty: bool, frames) -> DataFrame:
    source = f"FROM {{input}} AS input {'LEFT' if keep_empty else 'INNER'} JOIN LATERAL {call} AS result ON true"
    found = spark.sql(f"SELECT result.* {source}", args=dict(args or {}), input=input, **frames)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    if "NestedLoopJoin" in plan or "CartesianProduct" in plan:
        raise ValueError("the query would compare all rows with all rows: write its keys with same_key")
    if not pass_through:
        return found
    taken = {c.lower() for c in found.columns}
    kept = [f"input.`{c}`" for c in input.columns if c.lower() not in taken]
    return spark.sql(f"SELECT {', '.join([*kept, 'result.*'])} {source}", args=dict(args or {}), input=input, **frames)


def query_view(df: DataFrame, view: str, sql: str, args: Mapping | None = None) -> DataFrame:
    """SQL over the rows of the step before, under a view name."""
    df.createOrReplaceTempView(view)
    return df.sparkSession.sql(sql, args=dict(args or {}))


def literal_rows(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType | str) -> DataFrame:
    """A short inline table, as constants of the plan: its size is known, and no task has to make it."""
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(field.dataType).alias(field.name) for field in fields])
    records = [
        F.struct(*[F.lit(value).cast(field.dataType).alias(field.name) for value, field in zip(row, fields)])
        for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*records)))


def jdbc_query(
    spark: SparkSession,
    url: str,
    query: str,
    properties: Mapping[str, str] | None = None,
    split_on: tuple[str, object, object, int] | None = None,
) -> DataFrame:
    """A database query. `split_on` = (column, lowest, highest, parts) lets many tasks read it at once."""
    return spark.read.format("jdbc").options(**jdbc_options(url, query, properties, split_on)).load()


def jdbc_options(url, query, properties=None, split_on=None) -> dict[str, str]:
    options = {"url": url, **(properties or {})}
    if split_on is None:
        return {**options, "query": query}
    column, lowest, highest, count = split_on
    return {
        **options,
        "dbtable": f"({query}) q",
        "partitionColumn": column,
        "lowerBound": str(lowest),
        "upperBound": str(highest),
        "numPartitions": str(count),
    }


class TableFunction:
    """A query as a SQL table function of the session, in the place of a stored procedure: `SELECT * FROM name(1)`,
    `FROM flow, LATERAL name(flow.key)`, or inside another function.

    `parameters` and `returns` are as in SQL (`key BIGINT, least DOUBLE`); frames named in braces become views of the session
    under `name_frame`. Keys that are parameters are written with `same_key`.
    """

    def __init__(self, spark: SparkSession, name: str, parameters: str, returns: str, sql: str, **frames: DataFrame):
        self.spark, self.name = spark, name
        views = {key: f"{name}_{key}" for key in frames}
        for key, df in frames.items():
            df.createOrReplaceTempView(views[key])
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({returns}) RETURN {sql.format(**views)}")

    def __call__(self, *values) -> DataFrame:
        """One call; values are bound, not put into the text."""
        marks = {f"value{k}": v for k, v in enumerate(values)}
        return self.spark.sql(f"SELECT * FROM {self.name}({', '.join(':' + m for m in marks)})", args=marks)

    def for_each(self, input: DataFrame, *fields: str, pass_through: bool = True, keep_empty: bool = True) -> DataFrame:
        """A call for each row of `input`, with expressions over its fields (`input.field`) as arguments."""
        return _for_each(self.spark, f"{self.name}({', '.join(fields)})", None, input, pass_through, keep_empty, {})

    def drop(self) -> None:
        self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {self.name}")


class NamedQuery:
    """A query kept under a name and called with arguments, in the place of a stored procedure."""

    def __init__(self, name: str, sql: str):
        self.name = name
        self.sql = sql

    def __call__(self, spark: SparkSession, frames: Mapping[str, DataFrame] | None = None, **args) -> DataFrame:
        return sql_query(spark, self.sql, args, **(frames or {}))
