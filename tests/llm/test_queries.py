import os

import pytest

import __spark_entry__ as entry_points
from check_oracle import compare

SF = "/root/testdata/sf0.001"


def test_every_operator_has_its_query():
    names = entry_points.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
@pytest.mark.parametrize("name", [n for n in entry_points.oracle_sql() if n.startswith("op")])
def test_query_matches_its_sql(spark, name):
    ok, note = compare(spark, SF, name)
    assert ok, note
