"""Merging by vectors: the threshold join against all pairs, and vectors inside a run."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import MIN
from tests.test_folds_and_merging import SCOPE, make_pairs_input
from tests.test_summary import DAY, WORK, build  # noqa: F401
from threadloom.operators import merging, texts


def cosine(a, b):
    norm = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(y * y for y in b))
    return sum(x * y for x, y in zip(a, b)) / norm if norm else 0.0


def all_pairs(rows, vectors):
    """The rules written out over every pair."""
    rows = sorted(rows, key=lambda r: (r["start"], 0 if r.get("kind") == "t" else 1, r["id"]))
    out = {}
    for i, a in enumerate(rows):
        for b in rows[i + 1:]:
            if a["channel"] != b["channel"]:
                continue
            x, y = set(a["refs"]), set(b["refs"])
            sim = len(x & y) / len(x | y) if x | y else 0
            v, w = vectors.get(a["id"]), vectors.get(b["id"])
            if v is not None and w is not None:
                sim = 0.6 * sim + 0.4 * max(0.0, cosine(v, w))
            p, q = set(a["people"]), set(b["people"])
            same = p == q if len(p) == len(q) == 1 else bool(p | q) and len(p & q) / len(p | q) >= 0.7
            gap, dm = abs(b["start"] - a["end"]), a["channel"].startswith("D")
            near = same and gap <= (180 if dm else 90) and sim >= (0.05 if dm else 0.2)
            if gap <= 15 or near or (gap <= (360 if same else 240) and sim >= (0.2 if same else 0.4)):
                out[a["id"], b["id"]] = round(sim, 6)
    return out


def some(spark, conv_table, seed, n, size, filled):
    rng = random.Random(seed)
    rows = [{"id": f"c{i:03d}", "start": (s := rng.randrange(0, 3000)), "end": s + rng.choice([0, 3, 60, 500]), "channel": rng.choice(["C1", "C1", "D2"]),
             "people": rng.sample(["U1", "U2"], rng.randrange(1, 3)), "refs": rng.sample(["#1", "#2", "P-1", "P-2"], rng.choice([0, 0, 0, 1, 2])), "kind": rng.choice("mt")} for i in range(n)]
    vectors = {}
    for r in rows:
        kind = rng.random()
        if kind < 0.1:
            continue
        v = [0.0] * size
        if kind > 0.15:  # some are zero
            for d in rng.sample(range(size), min(size, filled)):
                v[d] = rng.choice([-1, 1, 1, 2, 5]) * rng.choice([1.0, 0.25])
        vectors[r["id"]] = None if kind > 0.97 else v
    table = spark.createDataFrame([(next(r["channel"] for r in rows if r["id"] == k), k, v) for k, v in vectors.items()], "channel string, conv_id string, embedding array<float>")
    return rows, vectors, make_pairs_input(spark, conv_table, rows), table


@pytest.mark.parametrize("seed, size, filled", [(1, 40, 3), (2, 12, 4), (3, 6, 6)])
def test_edges_match_all_pairs(spark, conv_table, seed, size, filled):
    rows, vectors, args, table = some(spark, conv_table, seed, 60, size, filled)
    got = merging.merge_edges(*args, SCOPE, vectors=table)
    assert {(r.left_id, r.right_id): round(r.similarity, 6) for r in got.collect()} == all_pairs(rows, vectors)
    assert set(all_pairs(rows, vectors)) - set(all_pairs(rows, {})), "vectors lift some pairs"


def test_candidates_are_far_fewer_than_the_pairs_of_a_window(spark, conv_table):
    rows, vectors, (conv, _, _), table = some(spark, conv_table, 7, 250, 60, 3)
    rules = merging.MergeRules()
    window = merging.near_pairs(conv, SCOPE, rules.widest()).count()
    found = {(r.left_id, r.right_id) for r in merging.close_vector_pairs(conv, table, SCOPE, rules).collect()}
    assert len(found) < window / 5
    channel = {r["id"]: r["channel"] for r in rows}
    for r in merging.near_pairs(conv, SCOPE, rules.widest()).collect():
        a, b = vectors.get(r.left_id), vectors.get(r.right_id)
        asked = min(s for w, s in rules.asked(channel[r.left_id].startswith("D")) if r.gap_us <= w * MIN) / 0.4
        if a is not None and b is not None and cosine(a, b) >= asked:
            assert (r.left_id, r.right_id) in found


def test_rules_that_ask_for_nothing_or_never_look_at_vectors(spark, conv_table):
    _, _, (conv, _, _), table = some(spark, conv_table, 8, 20, 8, 2)
    assert merging.close_vector_pairs(conv, table, SCOPE, merging.MergeRules(embedding_weight=0)).count() == 0
    free = merging.MergeRules(proximity_similarity=0, direct_similarity=0, same_author_similarity=0, similarity_threshold=0)
    assert merging.close_vector_pairs(conv, table, SCOPE, free).count() == 0 and free.unconditional() == 360
    assert merging.close_vector_pairs(conv, table.limit(0), SCOPE, merging.MergeRules()).count() == 0


def test_a_run_merges_by_what_is_said(spark, build):  # noqa: F811
    other = "Lunch menu ideas with soup noodles salad bread cheese"
    rows = [(DAY, "U1", WORK), (DAY + 200, "U1", WORK + " again"), (DAY + 700, "U1", other), (DAY + 205, "U2", "hm", {"thread": DAY + 200})]
    plain = build(rows)
    assert plain.topics.count() == plain.conv.count() and plain.conv_vectors is None
    run = build(rows, embedder=texts.hashed_words(64), embedding_model="words")
    assert run.topics.count() == run.conv.count() - 1
    merged = run.topic_summaries.filter("segments_merged = 2").collect()
    assert len(merged) == 1 and merged[0].message_count == 2
    made = run.new_vectors
    assert made.count() == run.conv_texts.select("text_hash").distinct().count()

    def refused(said):
        raise AssertionError("nothing is new")

    stored = made.withColumn("model", F.lit("words"))
    again = build(rows, embedder=refused, vectors=stored, embedding_model="words")
    assert again.new_vectors.count() == 0 and again.topics.count() == run.topics.count()
    other_model = build(rows, vectors=stored, embedding_model="another")
    assert other_model.topics.count() == plain.topics.count()


def test_text_of_a_merged_conversation_has_all_its_rows_in_order(spark, build):  # noqa: F811
    rows = [(DAY + 5, "U2", "before"), (DAY + 10, "U2", f"{WORK} <@U1>"), (DAY + 11, "U1", f"on it {WORK}", {"thread": DAY + 10}), (DAY + 12, "U1", f"in channel {WORK}"),
            (DAY + 300, "U2", f"alone {WORK}"), (DAY + 301, "U1", "yes", {"thread": DAY + 300})]
    run = build(rows, embedder=texts.hashed_words())
    said = {r.conv_id: r.embed_text for r in run.conv_texts.collect()}
    found = sorted(said.values())
    assert f"alone {WORK} yes" in found and any(t.startswith("before ") and WORK in t for t in found)
    assert set(said) == {r.conv_id for r in run.conv.collect()}
