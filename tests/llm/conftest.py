import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _row string, _h long, _hash string, mark long, n int"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from ``(doc_id, text[, lang[, source]])``, with columns whose names the operators use themselves."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else "s", len(r[1] or ""), "x", 7, "y", 1, 2) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def words():
    """Seeded nonsense words."""
    import random

    def make(n, seed, size=300):
        rng = random.Random(seed)
        return [f"w{rng.randrange(size)}" for _ in range(n)]

    return make
