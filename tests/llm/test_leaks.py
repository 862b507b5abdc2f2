import re

import pytest

from threadloom.llm import leaks

ITEM = "item_id long, text string, _hash long"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(rows, items):
    out = []
    for doc, text in rows:
        words, hit, found = terms(text), set(), set()
        for item, said in items:
            said = terms(said)
            n = min(10, len(said))
            windows = {tuple(said[i:i + n]) for i in range(len(said) - n + 1)} if n else set()
            for i in range(len(words) - n + 1):
                if tuple(words[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found.add("" if item is None else str(item))
        out.append((doc, len(words), len(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast", [2_000_000, 0])
def test_every_shared_span_is_found(spark, docs, words, broadcast):
    items = [(1, " ".join(words(40, 1))), (2, " ".join(words(40, 1)[20:] + words(25, 2))), (10, " ".join(words(10, 3))), (3, "short item of five words"), (4, "Solo"),
             (5, None), (6, "--- !"), (7, "short item of five words"), (None, " ".join(words(12, 4))), (8, "a a a a a a a a a a a a a a"), (9, "nine words are here to be found as whole"), (11, "é" * 3 + " b c")]
    base = words(40, 1)
    rows = [(1, " ".join(words(30, 8) + base[5:15] + words(30, 9))), (2, " ".join(base[5:14])), (3, " ".join(w.upper() + "," for w in base)), (4, "x SOLO! solo short item of five words"),
            (5, None), (6, ""), (7, "a " * 50), (8, " ".join(words(10, 3)) + " - " + " ".join(base[30:])), (9, " ".join(words(12, 4)[2:])), (10, "...Nine words are here, to be found as whole; ééé B\tc"),
            (11, " ".join(words(4000, 77) + base[:10] + words(3000, 78))), (12, " ".join(words(300, 5))), (12, " ".join(words(300, 5))), (13, "solo"), (13, "other text"), (None, "solo")]
    got = leaks.decontaminate(docs(rows), spark.createDataFrame([(*i, 5) for i in items], ITEM), broadcast_hashes=broadcast)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got.collect()), key=str)
    assert got == expected(rows, items)


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], ITEM)
    assert [tuple(r)[2:4] for r in leaks.decontaminate(docs([(1, "a b c")]), none).collect()] == [(3, 0)]
    some = spark.createDataFrame([(1, "a b c", 5)], ITEM)
    assert leaks.decontaminate(docs([]), some).count() == 0
