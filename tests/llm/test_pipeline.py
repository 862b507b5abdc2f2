import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from threadloom.llm import mixing

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_stages_against_brute_force(spark, docs, tmp_path, words):
    """Four languages of nonsense, near copies, a benchmark passage, junk: what stays is known row by row."""
    from tests.llm.test_jaccard import expected as components
    from tests.llm.test_langid import corpus

    rng = random.Random(5)
    rows = [(d, t, lang, f"s{d % 3}") for d, t, lang in corpus(150, seed=3)]
    item = "Thering thand onthe reent hater ofing tionth ering onon thatre enthe andre"
    rows += [(200, "theing " + item + " andhat", "en", "s0"), (201, None, "en", "s1"), (202, "12345 !!!", None, "s1"), (203, "漢字仮名交じり文の長い文章です" * 4, None, "s2")]
    rows += [(300 + i, rows[i][1] + " ", rows[i][2], "s1") for i in range(10)] + [(0, *rows[0][1:])]
    table = docs(rows)
    sf = str(tmp_path)
    table.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")

    known = [r for r in rows if r[0] not in (201, 202, 203)]
    label = {}
    for doc, _, component in components([r[:2] for r in known]):
        label[doc] = component
    single = {r[0]: r for r in known if label[r[0]] == r[0]}
    clean = {d: r for d, r in single.items() if item.lower() not in (r[1] or "").lower()}
    assert set(single) - set(clean) == {200}

    stage = table
    for (name, f), want in zip(corpus_pipeline.STAGES[:3], (known, list(single.values()), list(clean.values()))):
        stage = f(spark, stage, sf)
        assert stage.columns == table.columns
        assert sorted((r.doc_id, r.text) for r in stage.collect()) == sorted((r[0], r[1]) for r in want), name
    copies = {r.doc_id: r.copies for r in mixing.mix(docs(list(clean.values()))).collect()}

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, want = 0, []
    for doc in sorted(clean):
        ids = np.array(library.encode(clean[doc][1], add_special_tokens=False).ids + [1], "<u4")
        for _ in range(copies[doc]):
            want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()), key=lambda r: r[1]) == want


def test_empty_documents(spark, docs, tmp_path):
    docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_by_five_words_and_80_percent(spark, docs, words):
    """Pairs between the stage's measure and that of op3: each is linked by one of the two only."""
    from threadloom.llm import jaccard

    def share(a, b, k):
        x, y = ({tuple(t.split()[i:i + k]) for i in range(len(t.split()) - k + 1)} for t in (a, b))
        return len(x & y) / len(x | y)

    base = [f"a{i}" for i in range(100)]
    apart = base[:30] + ["x"] + base[31:70] + ["y"] + base[71:]  # 86 / 106 of five words, 89 / 105 of four
    assert share(" ".join(base), " ".join(apart), 5) > 0.8 and share(" ".join(base), " ".join(apart), 4) < 0.85
    far = [f"b{i}" for i in range(100)]
    farther = far[:20] + ["x"] + far[21:50] + ["y"] + far[51:80] + ["z"] + far[81:]
    assert share(" ".join(far), " ".join(farther), 5) < 0.8
    rows = [(1, " ".join(base)), (2, " ".join(apart)), (3, " ".join(far)), (4, " ".join(farther))]
    stage = dict(corpus_pipeline.STAGES)["near_copies"]
    assert sorted(r.doc_id for r in stage(spark, docs(rows), "").collect()) == [1, 3, 4]
    assert {r.doc_id: r.component_id for r in jaccard.near_copies(docs(rows)).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}


def test_rows_that_share_an_id_are_kept_or_dropped_by_their_own_text(spark, docs, words):
    a, b, c, d = (" ".join(words(60, seed)) for seed in (11, 12, 13, 14))
    rows = [(1, a), (5, a), (5, b), (7, c), (7, c + " more"), (8, b + " x"), (9, d), (9, d), (None, c), (None, None), (4, None), (4, ""), (6, "")]
    stage = dict(corpus_pipeline.STAGES)["near_copies"]
    got = sorted(((r.doc_id, r.text) for r in stage(spark, docs(rows), "").collect()), key=str)
    assert [r for r in got if r[1]] == sorted([(1, a), (5, b), (9, d), (None, c)], key=str)
    assert sorted(str(r[0]) for r in got if not r[1]) in (["4", "4", "6", "None"], ["4", "6", "None"])
