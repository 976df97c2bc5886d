"""Shapes of plans: what reaches the scan, and what must not be there."""

import re

import pytest

from queries import QUERIES

FOLDER = "/root/testdata/sf0.001"

# Queries that act, or write files, while they are built are looked at by what they read back.
LAZY = [
    "stage_parse_caret", "stage_row_count", "parse_error_split", "mapper_project", "filter_compare", "route_all_match",
    "route_single_pass", "lookup_passthrough", "enrich_inner", "queue_to_log", "update_status", "summary_by_type", "lag_rownum",
    "running_lower_count", "assemble_turns", "redact_secrets", "catalog_steps", "catalog_links", "catalog_inner_values",
    "intake_triage", "outbox_messages", "request_export_lines",
]


def plan(spark, name):
    return QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_and_no_python(spark, name):
    text = plan(spark, name)
    for part in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas", "ExistingRDD"):
        assert part not in text


@pytest.mark.parametrize(
    "name, columns",
    [
        ("stage_row_count", {"o_orderkey"}),
        ("summary_by_type", {"user_id", "event_type"}),
        ("route_single_pass", {"c_custkey", "c_acctbal"}),
        ("filter_compare", {"o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"}),
        ("count_all_rows", set()),
    ],
)
def test_only_needed_columns_are_read(spark, name, columns):
    (schema,) = re.findall(r"ReadSchema: struct<(.*?)>", plan(spark, name))
    assert {c.split(":")[0] for c in schema.split(",") if c} == columns


def test_filters_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    text = plan(spark, "filter_compare")
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", text).group(1)
    assert "In(o_orderstatus" in pushed and "GreaterThan(o_totalprice,1000" in pushed and "o_orderpriority" in pushed


@pytest.mark.parametrize("name", ["lag_rownum", "running_lower_count", "running_total_count"])
def test_windows_shuffle_the_rows_once(spark, name):
    text = plan(spark, name)
    assert "SinglePartition" not in text and "SortMergeJoin" not in text
    # Whole rows cross one exchange; the others carry counts per key or chunk into a broadcast.
    big = text.split("BroadcastExchange")[0]
    assert big.count("Exchange hashpartitioning") == 1


def test_single_pass_routes_scan_once(spark):
    assert plan(spark, "route_single_pass").count("FileScan") == 1
    assert plan(spark, "route_all_match").count("FileScan") == 3


def test_catalog_parses_only_what_it_uses(spark):
    assert "StructField(link_map" not in plan(spark, "catalog_steps")
    assert "StructField(snap_map" not in plan(spark, "catalog_links")
