import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadloom.llm import langid

PARTS = {"en": "the and ing th er on re tion ent of hat".split(), "de": "der ung sch ich ein keit zu ver ö ß ä".split(), "ru": "ого что ние ста при нов ска".split()}


def corpus(n, seed=1):
    rng, rows = random.Random(seed), []
    for i in range(n):
        lang = list(PARTS)[i % 3]
        text = " ".join("".join(rng.choices(PARTS[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(4, 60)))
        rows.append((i, text.capitalize(), lang))
    return rows


@pytest.fixture(scope="module")
def model(docs):
    return langid.train(docs(corpus(240)))


def test_held_out_accuracy(docs, model):
    rows = corpus(120, seed=9)
    got = langid.predict(docs(rows), model).select("doc_id", "lang", "_language.*").toDF("doc_id", "truth", "lang", "score", "loss", "rejected").collect()
    assert sum(r.lang == r.truth for r in got) >= 118
    assert sum(r.rejected for r in got) == 0 and all(0 <= r.score <= 1 for r in got)


def test_odd_texts(docs, model):
    rows = [(1, None), (2, ""), (3, "123 !?\n"), (4, "e"), (5, "漢字仮名交じり文の長い文章です" * 4), (6, "THE AND " * 5000), (6, "der ung"), (None, "ение что")]
    got = {(r.doc_id, r.text): r["_language"] for r in langid.predict(docs(rows), model).collect()}
    for doc, text in rows[:3]:
        assert (got[doc, text].lang, got[doc, text].score, got[doc, text].rejected) == ("und", 0.0, True)
    assert got[4, "e"].lang in PARTS and not got[4, "e"].rejected
    assert got[5, rows[4][1]].rejected
    assert (got[6, rows[5][1]].lang, got[6, "der ung"].lang, got[None, "ение что"].lang) == ("en", "de", "ru")


def test_nothing_to_learn_and_empty_table(docs, model):
    none = langid.train(docs([(1, "text", None), (2, None, "en"), (3, "", "de")]))
    assert [r["_language"].lang for r in langid.predict(docs([(1, "text")]), none).collect()] == ["und"]
    assert langid.predict(docs([]), model).count() == 0


def test_probabilities_follow_the_definition():
    """Against interpolated Kneser-Ney written out with dictionaries."""
    import pandas as pd

    text = {"a": "  abab cab ", "b": "  bbca ab"}
    counts = {}
    for lang, said in text.items():
        for i in range(2, len(said)):
            counts[lang, said[i - 2:i + 1]] = counts.get((lang, said[i - 2:i + 1]), 0) + 1
    model = langid.fit(pd.DataFrame([(k[0], k[1], n) for k, n in counts.items()], columns=["lang", "gram", "n"]), order=3)
    letters = {g for _, g3 in counts for g in g3[2]}

    def probability(lang, gram):
        own = {g: n for (x, g), n in counts.items() if x == lang}
        for _ in range(3 - len(gram)):
            shorter = {}
            for g in own:
                shorter[g[1:]] = shorter.get(g[1:], 0) + 1
            own = shorter
        below = probability(lang, gram[1:]) if len(gram) > 1 else 1 / (len(letters) + 1)
        total = sum(n for g, n in own.items() if g[:-1] == gram[:-1])
        if not total:
            return below
        kinds = sum(1 for g in own if g[:-1] == gram[:-1])
        return max(own.get(gram, 0) - 0.75, 0) / total + 0.75 * kinds / total * below

    for gram in ("aba", "bab", "zab", "abz", "cbc", " ab", "zzz", "bca"):
        points = np.array([ord(c) for c in gram], np.uint32)
        got = model.losses(points, np.array([2]))[0]
        assert np.allclose(np.exp(got), [probability("a", gram), probability("b", gram)], rtol=1e-4), gram
    assert sum(probability("a", "ab" + c) for c in letters) < 1


def test_reduced_texts():
    from threadloom.llm.grams import utf8

    points, starts = langid.reduced(*utf8(pa.array(["A1 b!", "", "--", "É  ñ", None])), 3)
    said = ["".join(map(chr, points[a:b])) for a, b in zip(starts, starts[1:])]
    assert said == ["  a b ", "  ", "  ", "  é ñ", "  "]


def test_a_language_that_was_not_learned_is_rejected(docs):
    """Leave one out: nearly all of it goes, next to nothing of the others."""
    parts = PARTS | {"fr": "les que eau tion oir ment ais eux ch pas".split()}

    def made(n, seed):
        rng = random.Random(seed)
        return [(i, " ".join("".join(rng.choices(parts[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(15, 80))), lang) for i in range(n) for lang in [list(parts)[i % 4]]]

    learn, test = made(800, 2), made(400, 3)
    for left in ("fr", "de"):
        model = langid.train(docs([r for r in learn if r[2] != left]))
        got = langid.predict(docs(test), model).select("lang", "_language.rejected").toDF("truth", "rejected").collect()
        out, rest = [r.rejected for r in got if r.truth == left], [r.rejected for r in got if r.truth != left]
        assert sum(out) >= 0.8 * len(out) and sum(rest) <= 0.01 * len(rest)


def test_sample_is_bounded_by_rows_and_takes_any_id(docs):
    rows = corpus(900)
    for ids in (lambda i: None, lambda i: 7, lambda i: i):
        sample = langid.training_sample(docs([(ids(i), *r[1:]) for i, r in enumerate(rows)]), docs_per_language=100).toPandas()
        assert sample.groupby("lang").size().to_dict() == {"de": 100, "en": 100, "ru": 100} and sample["apart"].sum() == 30
    same = langid.training_sample(docs([(1, "der und", "de")] * 50 + [(2, None, "de"), (3, "", "de"), (4, "x", None)]), docs_per_language=20)
    assert same.count() == 20
    model = langid.train(docs([(None, *r[1:]) for r in corpus(240)]))
    assert model.languages == sorted(PARTS) and all(x < float("inf") for x in model.limit)
