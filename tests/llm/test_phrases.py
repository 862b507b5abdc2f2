import random
import re
from collections import Counter

import numpy as np
import pytest

from threadloom.llm import phrases, quotient


def expected(rows, least, most=2_000):
    """Contract by brute force, in whole Python numbers."""
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            f.update((lang or "und", *words[i:i + k]) for k in range(1, 6) for i in range(len(words) - k + 1))
    out = []
    for lang in n:
        mine = {p[1:]: c for p, c in f.items() if p[0] == lang and c >= least}
        scored = []
        for p, a in mine.items():
            if len(p) == 1 or any(c >= a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, c in mine.items() if len(q) > len(p)):
                continue
            score, k = min((1000 * a * n[lang] // (mine[p[:k]] * mine[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), a, mine[p[:k]], mine[p[k:]], n[lang], score))
        out += [(lang, i + 1, s[2].decode(), *s[3:]) for i, s in enumerate(sorted(scored)[:most])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for i in range(120):
        words = [rng.choice(["New", "york", "the", "a", "of", "é", "ß1", "city's", "x" * 40, f"w{rng.randrange(400)}"]) for _ in range(rng.randrange(60))]
        text = "".join(w + rng.choice([" ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", ":"]) for w in words)
        out.append((i, text + " new york city" * rng.randrange(3), rng.choice(["en", "de", None])))
    return out + [(200, None, "en"), (201, "", None), (202, " ., \n", "fr"), (203, "a a a a a a a a", "de"), (203, "a a a a a a a a", "de"), (None, "new York", "en"), (204, "the end " * 5000, "en")]


@pytest.mark.parametrize("at_once, told", [(2_000_000, 4_000_000), (7, 0)])
def test_same_as_brute_force(spark, docs, rows, monkeypatch, at_once, told):
    monkeypatch.setattr(phrases, "WORDS_AT_ONCE", at_once)
    monkeypatch.setattr(phrases, "PAIRS_TOLD", told)
    monkeypatch.setattr(phrases, "RUNS_PER_RANGE", 3_000)
    got = sorted(tuple(r) for r in phrases.collocations(docs(rows).repartition(3), least=4, most=15).collect())
    assert got == expected(rows, 4, 15) and len(got) > 20


def test_empty_and_rare(spark, docs):
    assert phrases.collocations(docs([])).count() == 0
    assert phrases.collocations(docs([(1, "a b c", "en"), (2, None, None)])).count() == 0
    assert phrases.collocations(docs([(1, "a. " * 200, "en")])).count() == 0  # frequent words, no phrase


def test_filters_lose_nothing():
    rng = np.random.default_rng(3)
    for n, bits in ((2, 5), (5, 17), (5, 25), (3, 31), (2, 32), (4, 12), (4, 16), (2, 1), (1, 64)):
        wide = quotient.widths(n, bits)
        ids = [rng.integers(1, min(1 << min(bits, 62), 40), 5_000) if bits > 1 else rng.integers(0, 2, 5_000) for _ in range(n)]
        lanes = quotient.permuted(quotient.packed(ids, bits), wide)
        assert all(int(lane.max()) < 1 << w for lane, w in zip(lanes, wide))
        back = quotient.unpacked(quotient.restored(lanes, wide), n, bits)
        assert all((a == b).all() for a, b in zip(ids, back))
        halves = [quotient.encode(*quotient.counted([lane[s] for lane in lanes]), wide) for s in (slice(0, 1000), slice(1000, None))]
        keys, counts = quotient.merged([*halves, quotient.encode([lane[:0] for lane in lanes], np.zeros(0, np.int64), wide), *[halves[0]] * 300])
        told = dict(zip(zip(*(c.tolist() for c in quotient.unpacked(quotient.restored(keys, wide), n, bits))), counts.tolist()))
        want = Counter(zip(*(c.tolist() for c in ids)))
        want.update({k: 300 * v for k, v in Counter(zip(*(c[:1000].tolist() for c in ids))).items()})
        assert told == want
        assert (keys[0][1:] >= keys[0][:-1]).all()


def test_every_value_has_a_place_of_its_own():
    for width in (1, 2, 3, 8, 13):
        values = np.arange(1 << width, dtype=np.uint64)
        assert sorted(quotient.permuted([values], [width])[0].tolist()) == values.tolist()


def test_equal_first_lanes_are_told_apart():
    one, two = np.array([7, 7, 7, 3], np.uint64), np.array([2, 1, 2, 9], np.uint64)
    keys, counts = quotient.counted([one, two])
    assert [k.tolist() for k in keys] == [[3, 7, 7], [9, 1, 2]] and counts.tolist() == [1, 1, 2]
