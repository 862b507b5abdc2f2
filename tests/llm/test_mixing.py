import re

import pytest

from threadloom.llm import mixing


def reshared(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by the rule itself: cut at the cap, hand the excess on by weight, again until nothing is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total = share * sum(sizes.values())
    full = set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        rest = sum(weight[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else left * weight[s] / rest for s in names}
        over = {s for s in names if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


CASES = {
    "uneven": [(i, "a b c d"[: 1 + 2 * (i % 4)], None, ["hot", "hot", "x", "y", None, "é", "Z"][i % 7]) for i in range(300)],
    "one source": [(i, "a b", None, "s") for i in range(10)],
    "hot": [(i, "w " * 9, None, "a" if i % 10 else f"b{i}") for i in range(200)],
    "nulls": [(1, None, None, "a"), (2, "", None, "a"), (3, " \t ", None, None), (None, "x y", None, None), (4, "x\x0by\x0cz\xa0q", None, "b")],
    "repeated rows": [(1, "a b", None, "s")] * 5 + [(i, "c", None, "t") for i in range(5)],
}


@pytest.mark.parametrize("name", CASES)
def test_targets_and_words_taken(docs, name):
    rows = CASES[name]
    got = [r.asDict() for r in mixing.mix(docs(rows)).collect()]
    assert len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    target = reshared(sizes)
    for source, size in sizes.items():
        mine = [g for g in got if g["source"] == source]
        assert {g["source_size"] for g in mine} == {size}
        assert mine[0]["target"] == pytest.approx(target[source], abs=1e-6)
        by_id = {}
        for g in mine:
            by_id[g["doc_id"]] = by_id.get(g["doc_id"], 0) + g["size"]
        assert abs(sum(g["taken"] for g in mine) - target[source]) <= max(by_id.values()) / 2 + 1e-6
    assert all(0 <= g["taken"] <= 2 * g["size"] and g["taken"] == g["copies"] * g["size"] for g in got)


def test_reruns_agree_and_rows_are_repeated(docs):
    table = docs(CASES["uneven"])
    copies = {r.doc_id: r.copies for r in mixing.mix(table).collect()}
    assert copies == {r.doc_id: r.copies for r in mixing.mix(table.repartition(7)).collect()}
    out = mixing.mixed(table)
    assert out.columns == table.columns
    found = {}
    for r in out.collect():
        found[r.doc_id] = found.get(r.doc_id, 0) + 1
    assert found == {d: n for d, n in copies.items() if n}


def test_empty_table(docs):
    assert mixing.mix(docs([])).count() == 0 and mixing.mixed(docs([])).count() == 0
