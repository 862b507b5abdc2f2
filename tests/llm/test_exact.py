import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import exact, fuse


def expected(rows):
    groups, left = {}, {}
    for doc, text in rows:
        groups.setdefault(text or "", []).append(doc)
    out = []
    for doc, text in rows:
        ids = [d for d in groups[text or ""] if d is not None]
        keep = max(ids, default=None)
        first = left.setdefault(text or "", set())
        kept = doc == keep and "kept" not in first
        if kept:
            first.add("kept")
        out.append((doc, keep, len(groups[text or ""]), kept, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(1, "a"), (2, "b"), (3, "a"), (40, "a"), (41, None), (5, ""), (42, "B"), (43, "b "), (6, "only"), (44, "é"), (7, "e\u0301"), (45, "x" * 50_000), (8, "x" * 50_000), (46, "new"), (46, "new"), (47, "new"),
        (9, "old twice"), (9, "old twice"), (None, "lost"), (None, "a"), (None, "lost")] + [(100 + i, "hot") for i in range(40)] + [(10 + i, "hot") for i in range(20)]


@pytest.mark.parametrize("snapshot", ["doc_id < 40", "false", "true", "doc_id % 2 = 0"])
def test_groups(docs, snapshot):
    got = exact.exact_groups(docs(ROWS), F.expr(snapshot)).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")))
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(ROWS)


def test_byte_check_tells_colliding_texts_apart(docs, monkeypatch):
    for most in (200_000, 0):
        monkeypatch.setattr(exact, "BROADCAST_DIGESTS", most)
        got = exact.exact_groups(docs(ROWS), F.col("doc_id") < 40, digest=lambda t: F.unhex(F.sha2(F.substring(t, 1, 1), 256)))
        assert sorted((tuple(r)[:4] for r in got.collect()), key=str) == sorted((r[:4] for r in expected(ROWS)), key=str)


def test_empty_table(docs):
    assert exact.exact_groups(docs([]), F.lit(True)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 100, 5_000, 70_000])
def test_fuse_filter(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**63, n).astype(np.uint64)
    blob = fuse.build(np.concatenate([keys, keys[: n // 2]]))
    assert fuse.holds(blob, keys).all()
    others = rng.integers(2**63, 2**64 - 1, 50_000, dtype=np.uint64)
    assert fuse.holds(blob, others).mean() < (0.01 if n else 1e-9)
    if n >= 5_000:
        assert len(blob) * 8 < 11 * n
