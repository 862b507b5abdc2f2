from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from threadloom.session import build_session  # noqa: E402

MIN = 60_000_000


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", cores=4, shuffle_partitions=4)
    # Small Arrow batches make streamed operators meet batch borders.
    session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield session


@pytest.fixture(scope="session")
def chat(spark):
    """Build a message table from ``(minute, user, text, options)`` rows."""

    def make(rows, channel="C1"):
        out = []
        for n, row in enumerate(rows):
            minute, user, text, *rest = row
            more = rest[0] if rest else {}
            out.append((n, more.get("channel", channel), round(minute * MIN), user, more.get("subtype"), text,
                        round(more["thread"] * MIN) if "thread" in more else None))
        return spark.createDataFrame(out, "msg_id long, channel string, ts_us long, user_id string, subtype string, text string, thread_us long")

    return make


@pytest.fixture(scope="session")
def conv_table(spark):
    """Build a conversation roll-up from dicts with minutes."""

    def make(rows):
        full = []
        for r in rows:
            full.append((r.get("channel", "C1"), r["id"], r.get("kind", "m"), 0 if r.get("kind") == "t" else 1, round(r["start"] * MIN),
                         round(r["end"] * MIN), r.get("count", 5), r.get("own", 0), r.get("bot", False), r.get("chars", 500), r.get("work", False)))
        return spark.createDataFrame(full, "channel string, conv_id string, kind string, kind_rank int, start_us long, end_us long, message_count long, "
                                           "user_message_count long, is_bot boolean, chars long, has_work boolean")

    return make
