"""Every core query with SQL gives what DuckDB gives, on the smallest tables; those without SQL run."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tests.parity import compare, connection
from tracewell.plans import registry

SF = "/root/testdata/sf0.001"
LARGER = dict.fromkeys(("p4_found", "p4_table", "p4_names"), "/root/testdata/sf0.01")  # names that only few files show can't be told
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return {d: connection(d) for d in {SF, *LARGER.values()}}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_gives_what_sql_gives(spark, con, name):
    sf = LARGER.get(name, SF)
    assert compare(spark, con[sf], name, registry.queries()[name], registry.oracle_sql()[name], sf) in ("", "both are empty")


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    df = registry.queries()[name](spark, SF)
    assert df.columns
    df.collect()


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
