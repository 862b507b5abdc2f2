import hashlib
import random

import numpy as np
import pytest

from threadloom.llm import substrings
from threadloom.llm.grams import utf8


def expected(rows):
    """Every window against all earlier starts; rows that share an id are places of one document."""
    raws = [(-(1 << 63) if d is None else d, (t or "").encode()) for d, t in rows]
    first = {}
    for doc, raw in raws:
        for p in range(len(raw) - 99):
            w = raw[p:p + 100]
            first[w] = min(first.get(w, (doc, p)), (doc, p))
    out = []
    for (doc, raw), (name, _) in zip(raws, rows):
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if first[raw[p:p + 100]] < (doc, p):
                gone[p:p + 100] = b"\1" * 100
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((name, len(raw), sum(gone), runs, kept, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(words, seed):
    rng = random.Random(seed)
    line = lambda n: " ".join(words(n, rng.randrange(10**9), 10**6))
    shared, boiler = line(60), line(18)
    texts = [line(80) for _ in range(8)]
    for _ in range(25):
        parts = [line(rng.randrange(1, 40)) for _ in range(3)]
        cut = rng.randrange(len(shared) - 50)
        parts.insert(rng.randrange(4), shared[cut: cut + rng.randrange(90, 200)])
        if rng.random() < 0.5:
            parts.insert(rng.randrange(4), boiler)
        texts.append("\n".join(parts))
    texts += [texts[3], texts[3] + "x", "a" * 350, "b" + "a" * 120, "ab" * 130, "ab" * 49 + "abc", "x" * 99, "", None, "é" * 80, "zé" * 70 + "é" * 60, (line(12) + "\n") * 6, texts[9].upper()]
    rng.shuffle(texts)
    return [(7 * i - 40, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_removed_bytes(docs, words, seed):
    rows = corpus(words, seed)
    assert sorted((tuple(r) for r in substrings.without_repeats(docs(rows)).collect()), key=str) == expected(rows)


def test_shared_and_null_ids_and_empty_table(docs, words):
    text = " ".join(words(60, 5, 10**6))
    rows = [(5, text), (5, text), (5, "head " + text), (None, text[40:]), (9, text), (9, "other")]
    assert sorted((tuple(r) for r in substrings.without_repeats(docs(rows)).collect()), key=str) == expected(rows)
    assert substrings.without_repeats(docs([])).count() == 0


@pytest.mark.parametrize("batch", [1, 7, 64])
def test_family_of_levels_finds_what_one_array_finds(words, batch):
    """Whatever the size of batches, and so whichever levels merge, the repeated windows are the same."""
    import pyarrow as pa

    texts = [(t or "") for _, t in corpus(words, 3)]
    data, offsets = utf8(pa.array(texts))
    found, doc = substrings.anchors(data, offsets)
    pieces = np.zeros(len(found), substrings.PIECE)
    for name in ("gram", "at", "left", "windows"):
        pieces[name] = found[name]
    pieces["doc"] = doc
    order = np.lexsort((pieces["at"], pieces["doc"]))
    pieces = pieces[order]
    after, before = np.zeros((len(pieces), 100), np.uint8), np.zeros((len(pieces), substrings.WIDTH - 1), np.uint8)
    for i, p in enumerate(pieces):
        raw = np.frombuffer(texts[p["doc"]].encode(), np.uint8)
        at, left = int(p["at"]), int(p["left"])
        end = at - left + int(p["windows"]) - 1 + 100
        after[i, :end - at] = raw[at:end]
        before[i, :left] = raw[at - left:at][::-1]
    family, hits = substrings.SuffixFamily(), []
    for a in range(0, len(pieces), batch):
        hits.append(family.add(substrings.Level(pieces[a:a + batch], after[a:a + batch], before[a:a + batch])))
    sizes = [len(level) for level in family.levels]
    assert all(a > b for a, b in zip(sizes, sizes[1:])) and sum(sizes) == len(pieces)
    hits, seen = np.concatenate(hits), {}
    for p, hit in zip(pieces, hits):
        raw = texts[p["doc"]].encode()
        for k in range(int(p["windows"])):
            start = int(p["at"]) - int(p["left"]) + k
            window = raw[start:start + 100]
            assert hit[int(p["left"]) - k] == (window in seen), (p, k)
            seen.setdefault(window, start)


def hot_line(words):
    """A line of 70 bytes, or 99 of them, in every text, with other words around it; some of the surroundings repeat."""
    around = lambda seed: " ".join(words(12, seed, 10**6))
    lines = [" ".join(words(30, 7, 10**6))[:n] for n in (70, 99)]
    return [(3 * i if i % 17 else None, f"{around(i % 90)} {lines[i % 2]} {around(1000 + i % 70)}") for i in range(160)]


@pytest.mark.parametrize("hot", [1, 20, 10**6])
def test_hot_strings_keep_the_result(docs, words, hot):
    for rows in (hot_line(words), corpus(words, 4)):
        assert sorted((tuple(r) for r in substrings.without_repeats(docs(rows), hot=hot, pieces=50).collect()), key=str) == expected(rows)


def test_no_range_gathers_a_hot_string(docs, words):
    """Stretches of one string with many surroundings meet in no single range."""
    from pyspark.sql import functions as F

    around = lambda seed: " ".join(words(30, seed, 10**6))
    line = " ".join(words(30, 7, 10**6))[:70]
    rows = docs([(i, f"{around(i)} {line} {around(1000 + i)}") for i in range(600)]).withColumn("mark", F.xxhash64("text"))
    _, opened = substrings.repeated_spans(rows, 8, hot=100)
    groups = substrings.to_compare(rows, opened, pieces=500)
    sizes = groups.groupBy("range").agg(F.sum(F.length("pieces")).alias("n")).toPandas()["n"] / substrings.PIECE.itemsize
    assert len(sizes) > 20 and sizes.max() < 1000 and sizes.max() < 2 * sizes.mean()
