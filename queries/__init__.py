"""The registered queries: each is a Spark job over the given tables, with the SQL that gives the same rows."""

from queries import catalog, exchange, jobs, loading, rows, tables, texts  # noqa: F401
from queries.registry import ORACLES, QUERIES  # noqa: F401
