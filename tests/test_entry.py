import os

import pytest

import __spark_entry__ as entry_points
from check_oracle import compare

SF = "/root/testdata/sf0.001"
SAMPLE = ["time_gap_segments", "thread_conversations", "references", "message_pairs", "request_periods", "trivial_merge", "topics", "top_words", "session_stream"]


def test_every_oracle_belongs_to_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert len(entry_points.queries()) > 70


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_its_sql(spark, name):
    ok, note = compare(spark, SF, name)
    assert ok, note


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
