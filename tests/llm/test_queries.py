import os

import pytest

from tests.parity import compare, connection
from tracewell.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() >= 0


@pytest.mark.parametrize("name", sorted(set(queries.ORACLES) - {"p8_held"}))
def test_query_gives_what_sql_gives(spark, name):
    assert compare(spark, connection(SF), name, queries.QUERIES[name], queries.ORACLES[name], SF) in ("", "both are empty")


def test_columns_are_as_agreed(spark):
    assert queries.QUERIES["p2_found"](spark, SF).dtypes == [("transcript_id", "bigint"), ("defect", "string")]
    assert queries.QUERIES["p9_found"](spark, SF).dtypes == [("doc_id_a", "bigint"), ("doc_id_b", "bigint")]
