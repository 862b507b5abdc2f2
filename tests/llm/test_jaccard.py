import random
import re

import pytest

from threadloom.llm import jaccard


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 4]) for i in range(len(words) - 3)} or ({tuple(words)} if words else set())


def expected(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (doc, _), x in zip(rows, label):
        least[x] = min(least.get(x, doc), doc)
    return sorted((doc, len(s), least[x]) for (doc, _), s, x in zip(rows, sets, label))


def corpus(words, seed):
    """Groups of near copies around the threshold, exact copies, a passage that many share, short and odd texts."""
    rng, rows = random.Random(seed), []
    passage = words(30, 999)
    for g in range(6):
        base = words(rng.randrange(20, 90), seed * 100 + g, 4000)
        for _ in range(rng.randrange(2, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            rows.append(" ".join(copy))
    rows += [" ".join(passage + words(40, seed * 7 + i, 4000)) for i in range(12)]
    rows += ["", None, " \t\n", "one", "One", "one two three", "ONE two\tthree", "é É", "a b c d", "A  b c\x0bd", "a b c d e"]
    rows += [rows[0]] * 3 + ["x " * 400, "x " * 401]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(1000 + 7 * o, t) for o, t in zip(order, rows)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components(docs, words, seed, monkeypatch):
    if seed == 2:  # nearly every shared shingle is common
        real = jaccard.common_shingles
        monkeypatch.setattr(jaccard, "common_shingles", lambda *a: real(*a, common=1))
    if seed == 3:  # only the most common few are told
        real = jaccard.common_shingles
        monkeypatch.setattr(jaccard, "common_shingles", lambda *a: real(*a, common=1, most=5))
        monkeypatch.setattr(jaccard, "SHINGLES_PER_TASK", 100)  # blocks are dealt out by pairs of parts
    rows = corpus(words, seed)
    got = sorted(tuple(r)[:3] for r in jaccard.near_copies(docs(rows)).collect())
    assert got == expected(rows)


def test_repeated_rows_null_ids_and_empty_tables(docs):
    text = "a b c d e f g h"
    got = sorted(tuple(r)[:3] for r in jaccard.near_copies(docs([(5, text), (5, text), (9, text), (2, "z"), (3, None)])).collect())
    assert got == [(2, 1, 2), (3, 0, 3), (5, 5, 5), (5, 5, 5), (9, 5, 5)]
    got = {tuple(r)[:3] for r in jaccard.near_copies(docs([(None, text), (4, text), (6, "y")])).collect()}
    assert got == {(None, 5, None), (4, 5, None), (6, 1, 6)}
    assert jaccard.near_copies(docs([])).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_divide_skip_and_bitmaps_against_all_pairs(seed):
    import numpy as np

    rng = np.random.default_rng(seed)
    pool = np.sort(rng.integers(0, 2**63, 400).astype(np.uint64))
    core = np.sort(rng.choice(pool, 60, replace=False))
    sets = []
    for _ in range(60):
        own = rng.choice(pool, rng.integers(1, 12), replace=False)
        sets.append(np.unique(np.concatenate([rng.choice(core, rng.integers(40, 61), replace=False), own])))
    linked = {(i, j) for i in range(60) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}

    def classes(edges):
        label = list(range(60))
        for a, b in edges:
            old, new = label[a], label[b]
            label = [new if x == old else x for x in label]
        return {frozenset(i for i in range(60) if label[i] == x) for x in label}

    assert linked
    assert classes(jaccard.links([(i, s.tobytes()) for i, s in enumerate(sets)])) == classes(linked)
    perhaps = classes(jaccard.may_link([(i, len(s), jaccard._bitmap(s)) for i, s in enumerate(sets)]))
    assert all(any(c <= p for p in perhaps) for c in classes(linked))


@pytest.mark.parametrize("rounds", [1, 3])
def test_large_lists_and_blocks_in_parts(docs, words, rounds, monkeypatch):
    """Parts of two members, so that most links are found in later rounds or at the end."""
    monkeypatch.setattr(jaccard, "MEMBERS_PER_TASK", 2)
    monkeypatch.setattr(jaccard, "SHINGLES_PER_TASK", 100)
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    rows = corpus(words, 5)
    assert sorted(tuple(r)[:3] for r in jaccard.near_copies(docs(rows)).collect()) == expected(rows)


def test_a_group_of_edited_copies_is_not_compared_as_all_pairs(docs, words, monkeypatch):
    """What goes to the tasks grows with the group, not with its square."""
    monkeypatch.setattr(jaccard, "SHINGLES_PER_TASK", 2_000)
    real, sent = jaccard._grouped, []

    def counted(rows, keys, work, columns, *more):
        if "set" in columns:
            sent.append(rows.count())
        return real(rows, keys, work, columns, *more)

    monkeypatch.setattr(jaccard, "_grouped", counted)
    base, rows = words(200, 77, 4000), []
    for i in range(80):
        copy = list(base)
        copy[2 * i] = f"new{i}"
        rows.append((i, " ".join(copy)))
    got = jaccard.near_copies(docs(rows)).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 80
    assert sum(sent) <= 4 * 80  # pairs of parts sent each of the 80 16 times


def test_word_hashes_are_no_sum_of_powers(spark, docs):
    """Thue-Morse words and their opposites: no linear hash modulo a power of two tells them apart."""
    from threadloom.llm import grams

    rows, texts = [], []
    for n in (64, 1024, 4096):
        bits = [bin(i).count("1") % 2 for i in range(n)]
        texts += ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)]
    rows = [(i, f"{t} {t} {t} {t} {t}") for i, t in enumerate(texts)]
    assert all(r.component_id == r.doc_id for r in jaccard.near_copies(docs(rows)).collect())
    for words in (["a" * n for n in range(1, 80)], [f"w{i}" for i in range(5000)], ["x" * 63 + c for c in "abc"] + ["x" * 64 + c for c in "abc"], ["é", "\u00e8", "ab", "ba"]):
        import pyarrow as pa

        data, offsets = grams.utf8(pa.array([" ".join(words), words[0].upper() if words[0].isascii() else words[0]]))
        found = grams.Words(data, offsets, grams.SPACED)
        assert len(set(found.hash[:-1].tolist())) == len(words) and found.hash[-1] == found.hash[0]
        alone = [int(grams.Words(*grams.utf8(pa.array([w])), grams.SPACED).hash[0]) for w in words[:30]]
        assert alone == [int(h) for h in found.hash[:len(alone)]]
