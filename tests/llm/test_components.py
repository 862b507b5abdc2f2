import random

import pytest

from threadloom.llm.components import components


@pytest.mark.parametrize("shape", ["path", "random", "star", "nothing"])
def test_against_union_find(spark, shape):
    rng = random.Random(shape)
    ids = rng.sample(range(-500, 500), 300)
    edges = {"path": list(zip(ids, ids[1:])), "random": [tuple(rng.choices(ids, k=2)) for _ in range(260)], "star": [(ids[0], x) for x in ids] * 2, "nothing": []}[shape]
    label = {x: x for e in edges for x in e}
    for a, b in edges:
        low, high = sorted((label[a], label[b]))
        label = {x: low if v == high else v for x, v in label.items()}
    table = spark.createDataFrame(edges, "a long, b long").repartition(9)
    assert {r.node: r.label for r in components(table).collect()} == label
