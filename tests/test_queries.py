"""Every registered query at the smallest scale against its SQL."""

import importlib
import importlib.util
import os
import re
from pathlib import Path

import pytest

from queries import ORACLES, QUERIES
from tests.compare import connect, difference

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
MAY_BE_EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def tables():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, tables, name):
    assert name in ORACLES
    assert difference(QUERIES[name](spark, FOLDER), tables, ORACLES[name]) is None


@pytest.mark.parametrize("name", list(QUERIES))
def test_sql_gives_rows(tables, name):
    assert name in MAY_BE_EMPTY or tables.sql(f"SELECT count(*) FROM ({ORACLES[name]}) AS q").fetchall()[0][0] > 0


def test_entry(spark):
    path = Path(__file__).resolve().parent.parent / "__spark_entry__.py"
    spec = importlib.util.spec_from_file_location("spark_entry", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert module.entry(spark).columns == ["rowCount"]
    assert set(QUERIES) <= set(module.queries()) and set(ORACLES) <= set(module.oracle_sql())


def test_coverage_table_names_every_query():
    text = (Path(__file__).resolve().parent.parent / "COVERAGE.md").read_text()
    named = set(re.findall(r"`([a-z_]+)`", text))
    assert set(QUERIES) <= named


def test_coverage_table_names_real_functions():
    text = (Path(__file__).resolve().parent.parent / "COVERAGE.md").read_text()
    for row in text.splitlines():
        if not row.startswith("| ") or row.startswith("| Id"):
            continue
        module = None
        for name in re.findall(r"`([A-Za-z_.]+)", row.split("|")[2]):
            if "." in name:
                package, _, last = name.rpartition(".")
                try:
                    module = importlib.import_module(f"millrace.{package}")
                    assert hasattr(module, last) or importlib.import_module(f"millrace.{name}")
                except ModuleNotFoundError:
                    module = importlib.import_module(f"millrace.{name}")
            elif module is not None:
                assert hasattr(module, name), name
