import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import MIN
from threadloom.operators import folds, merging
from threadloom.operators.components import connected_components

SCOPE = ["channel"]


def outcome(mapping):
    return {r.conv_id: r.cluster_id for r in mapping.collect()}


def plain_fold(rows, mode):
    """The ordered rule as a loop over a list, for comparison."""
    todo = [dict(r, ids=[r["id"]]) for r in sorted(rows, key=lambda r: (r["start"], r["id"]))]
    kept, result, merged = [], {}, 0
    small = lambda c: c["bot"] if mode == "bot" else c["count"] <= 2 and c["chars"] < 100
    takes = lambda o, c: not o["bot"] if mode == "bot" else o["count"] > c["count"]

    def join(a, b):
        return {"id": a["id"], "ids": a["ids"] + b["ids"], "start": min(a["start"], b["start"]), "end": max(a["end"], b["end"]), "count": a["count"] + b["count"],
                "chars": a["chars"] + b["chars"], "bot": a["bot"] and b["bot"], "work": a["work"] or b["work"]}

    for i, c in enumerate(todo):
        if c is None:
            continue
        if small(c):
            if kept and abs(c["start"] - kept[-1]["end"]) <= 30 and takes(kept[-1], c):
                kept[-1] = join(kept[-1], c)
                merged += 1
                continue
            if i + 1 < len(todo) and abs(todo[i + 1]["start"] - c["end"]) <= 30 and takes(todo[i + 1], c):
                todo[i + 1] = join(c, todo[i + 1])
                merged += 1
                continue
            if mode == "trivial" and not c["work"]:
                result.update({m: None for m in c["ids"]})
                continue
        kept.append(c)
    for c in kept:
        result.update({m: c["id"] for m in c["ids"]})
    return result, merged


@pytest.mark.parametrize("mode", ["bot", "trivial"])
@pytest.mark.parametrize("seed", range(4))
def test_fold_matches_a_plain_loop(conv_table, mode, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(120):
        start = rng.choice([rng.randrange(0, 2500), rng.randrange(0, 300)])
        count = rng.randrange(1, 5)
        rows.append({"id": f"c{i:03d}", "start": start, "end": start + rng.choice([0, 5, 30, 90]), "count": count, "bot": rng.random() < 0.5,
                     "chars": rng.choice([20, 99, 100]), "work": rng.random() < 0.2})
    want, merged = plain_fold(rows, mode)
    found = (folds.merge_bots if mode == "bot" else folds.merge_trivial)(conv_table(rows), SCOPE)
    assert outcome(found) == want
    assert found.filter("merged").count() == merged


@pytest.mark.parametrize("mode", ["bot", "trivial"])
@pytest.mark.parametrize("seed, rows_of_a_chunk", [(1, 1), (2, 3), (3, 10)])
def test_chunks_of_a_long_island_are_stitched(conv_table, monkeypatch, mode, seed, rows_of_a_chunk):
    """One island of close conversations, cut almost everywhere, against the plain loop."""
    monkeypatch.setattr(folds, "CHUNK_ROWS", rows_of_a_chunk)
    rng, rows, at = random.Random(seed), [], 0
    for i in range(150):
        at += rng.choice([1, 5, 29, 30, 31])
        bot = not (rows and rows[-1]["bot"]) if rng.random() < 0.7 else rng.random() < 0.6
        rows.append({"id": f"c{i:03d}", "start": at, "end": at + rng.choice([0, 0, 2, 40]), "count": rng.choice([1, 1, 2, 2, 3, 9]), "bot": bot, "chars": rng.choice([20, 99, 100]), "work": rng.random() < 0.3})
    rows += [dict(r, id=f"d{r['id']}", channel="C2") for r in rows[:40]]
    for channel in ("C1", "C2"):
        want, merged = plain_fold([r for r in rows if r.get("channel", "C1") == channel], mode)
        found = (folds.merge_bots if mode == "bot" else folds.merge_trivial)(conv_table(rows), SCOPE).filter(F.col("channel") == channel)
        assert outcome(found) == want and found.count() == len(want)
        assert found.filter("merged").count() == merged


def test_a_long_island_goes_to_many_chunks_and_lone_rows_to_none(conv_table, monkeypatch):
    monkeypatch.setattr(folds, "CHUNK_ROWS", 20)
    rows = [{"id": f"c{i:04d}", "start": i * 10, "end": i * 10 + 1, "bot": i % 2 == 1} for i in range(400)] + [{"id": f"e{i}", "start": 9_000 + 100 * i, "end": 9_000 + 100 * i, "bot": i % 2 == 0} for i in range(30)]
    placed = folds.islands(conv_table(rows), SCOPE, F.col("is_bot"), 30 * MIN)
    assert placed.filter("alone").count() == 30 and placed.filter("NOT alone").select("island").distinct().count() == 1
    assert outcome(folds.merge_bots(conv_table(rows), SCOPE)) == plain_fold(rows_with_defaults(rows), "bot")[0]


def rows_with_defaults(rows):
    return [{"count": 5, "chars": 500, "work": False, **r} for r in rows]


def test_bot_cases(conv_table):
    def run(*rows):
        return outcome(folds.merge_bots(conv_table([{"id": i, "start": s, "end": e, "bot": b} for i, s, e, b in rows]), SCOPE))

    assert run(("b", 0, 1, True), ("h", 31, 40, False)) == {"b": "b", "h": "b"}, "forward keeps the bot's id, 30 minutes still merge"
    assert run(("h", 0, 1, False), ("b", 31, 31, True)) == {"h": "h", "b": "h"}
    assert run(("h", 0, 1, False), ("b", 31.1, 32, True)) == {"h": "h", "b": "b"}
    assert run(("b1", 0, 1, True), ("b2", 2, 3, True), ("h", 5, 6, False)) == {"b1": "b1", "b2": "b2", "h": "b2"}
    assert run(("h1", 0, 0, False), ("b1", 1, 1, True), ("b2", 2, 5, True), ("h2", 6, 7, False)) == {"h1": "h1", "b1": "h1", "b2": "h1", "h2": "h2"}


def test_trivial_cases(conv_table):
    def run(*rows, **more):
        return outcome(folds.merge_trivial(conv_table([{"id": i, "start": s, "end": s, "count": n, "chars": c, "work": w} for i, s, n, c, w in rows]), SCOPE, **more))

    assert run(("a", 0, 1, 10, False), ("b", 5, 1, 10, False)) == {"a": None, "b": None}, "equal counts do not merge"
    assert run(("a", 0, 1, 100, False)) == {"a": "a"}, "a hundred characters are not trivial"
    assert run(("a", 0, 1, 99, True)) == {"a": "a"} and run(("a", 0, 1, 99, False), drop_orphans=False) == {"a": "a"}
    assert run(("a", 0, 1, 10, False), ("b", 30, 2, 10, False)) == {"a": "a", "b": "a"}, "a pair grows out of being trivial"
    assert run(("a", 0, 3, 10, False), ("b", 30, 2, 10, False), ("c", 60.5, 1, 5, False)) == {"a": "a", "b": "a", "c": None}


def make_pairs_input(spark, conv_table, rows):
    conv = conv_table(rows)
    people = spark.createDataFrame([(r.get("channel", "C1"), r["id"], u) for r in rows for u in r["people"]] or [], "channel string, conv_id string, user_id string")
    refs = spark.createDataFrame([(r.get("channel", "C1"), r["id"], v, not v.startswith("U")) for r in rows for v in r["refs"]], "channel string, conv_id string, value string, comparable boolean")
    return conv, refs, people


def plain_edges(rows):
    rows = sorted(rows, key=lambda r: (r["start"], 0 if r.get("kind") == "t" else 1, r["id"]))
    out = {}
    for i, a in enumerate(rows):
        for b in rows[i + 1:]:
            if a.get("channel", "C1") != b.get("channel", "C1"):
                continue
            x, y = ({v for v in r["refs"] if not v.startswith("U")} for r in (a, b))
            sim = len(x & y) / len(x | y) if x | y else 0
            p, q = set(a["people"]), set(b["people"])
            same = p == q if len(p) == len(q) == 1 else bool(p | q) and len(p & q) / len(p | q) >= 0.7
            gap, dm = abs(b["start"] - a["end"]), a.get("channel", "C1").startswith("D")
            adjacent, prox = gap <= 15, same and gap <= (180 if dm else 90) and sim >= (0.05 if dm else 0.2)
            if adjacent or prox or (gap <= (360 if same else 240) and sim >= (0.2 if same else 0.4)):
                out[a["id"], b["id"]] = "adjacent" if adjacent and not same else "proximity" if prox and sim < 0.2 else "same_author" if same and sim < 0.4 else None
    return out


@pytest.mark.parametrize("seed", range(3))
def test_edges_match_all_pairs(spark, conv_table, seed):
    rng = random.Random(seed)
    rows = [{"id": f"c{i:02d}", "start": (s := rng.randrange(0, 1500)), "end": s + rng.choice([0, 3, 60, 500]), "channel": rng.choice(["C1", "C1", "D2"]),
             "people": rng.sample(["U1", "U2", "U3"], rng.randrange(0, 4)), "refs": rng.sample(["#1", "#2", "#3", "P-1", "P-2", "P-3", "P-4", "U1"], rng.randrange(0, 8)),
             "kind": rng.choice("mt")} for i in range(45)]
    got = merging.merge_edges(*make_pairs_input(spark, conv_table, rows), SCOPE)
    assert {(r.left_id, r.right_id): r.merged_by for r in got.collect()} == plain_edges(rows)


def test_limits_of_the_merge_windows(spark, conv_table):
    row = lambda i, s, refs, people=("U1",), **k: {"id": i, "start": s, "end": s, "refs": list(refs), "people": list(people), **k}
    found = lambda *rows: merging.merge_edges(*make_pairs_input(spark, conv_table, list(rows)), SCOPE).collect()
    assert len(found(row("a", 0, []), row("b", 15, [], ("U2",)))) == 1 and not found(row("a", 0, []), row("b", 15.1, [], ("U2",)))
    assert len(found(row("a", 0, ["#1"]), row("b", 360, ["#1"]))) == 1 and not found(row("a", 0, ["#1"]), row("b", 360.1, ["#1"]))
    assert len(found(row("a", 0, ["#1"]), row("b", 240, ["#1"], ("U2",)))) == 1 and not found(row("a", 0, ["#1"]), row("b", 240.1, ["#1"], ("U2",)))


def test_proximity_counts_only_in_direct_channels(spark, conv_table):
    many = [f"P-{i}" for i in range(10)]
    for channel, label in ("D1", "proximity"), ("C1", None):
        rows = [{"id": "a", "start": 0, "end": 0, "refs": many, "people": ["U1"], "channel": channel},
                {"id": "b", "start": 100, "end": 100, "refs": ["P-0"], "people": ["U1"], "channel": channel}]
        got = merging.merge_edges(*make_pairs_input(spark, conv_table, rows), SCOPE).collect()
        assert [r.merged_by for r in got] == ([label] if label else [])


def test_vectors_can_lift_a_pair(spark, conv_table):
    rows = [{"id": "a", "start": 0, "end": 0, "refs": [], "people": ["U1"]}, {"id": "b", "start": 100, "end": 100, "refs": [], "people": ["U1"]}]
    vectors = spark.createDataFrame([("C1", "a", [1.0, 0.0]), ("C1", "b", [1.0, 0.0])], "channel string, conv_id string, embedding array<float>")
    args = make_pairs_input(spark, conv_table, rows)
    assert merging.merge_edges(*args, SCOPE).count() == 0
    assert merging.merge_edges(*args, SCOPE, vectors=vectors).first().similarity == pytest.approx(0.4)


def test_owner_in_both_is_the_same_author(spark):
    pairs = spark.createDataFrame([("C1", "a", "b"), ("C1", "a", "c")], "channel string, left_id string, right_id string")
    people = spark.createDataFrame([("C1", "a", u) for u in ("U1", "U2")] + [("C1", "b", u) for u in ("U1", "U3", "U4")] + [("C1", "c", "U5")], "channel string, conv_id string, user_id string")
    owned = spark.createDataFrame([("C1", "a"), ("C1", "b")], "channel string, conv_id string")
    assert {r.right_id: r.same_author for r in merging.with_same_author(pairs, people, SCOPE, owned).collect()} == {"b": True, "c": False}
    assert {r.right_id: r.same_author for r in merging.with_same_author(pairs, people, SCOPE).collect()} == {"b": False, "c": False}


@pytest.mark.parametrize("kind", ["random", "chain", "star"])
def test_components_match_union_find(spark, kind):
    rng = random.Random(5)
    n = 60
    edges = {"random": [(rng.randrange(n), rng.randrange(n)) for _ in range(40)], "chain": [(i, i + 1) for i in range(n)], "star": [(0, i) for i in range(1, n)] + [(70, 71)]}[kind]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_topic_end_is_the_end_of_the_last_starting_member(spark, conv_table):
    conv = conv_table([{"id": "long", "start": 0, "end": 500, "count": 2}, {"id": "late", "start": 100, "end": 110, "count": 3, "kind": "t"}, {"id": "alone", "start": 900, "end": 901}])
    edges = spark.createDataFrame([("C1", "long", "late")], "channel string, left_id string, right_id string")
    rows = {r.topic_id: r for r in merging.topic_roll_up(conv, merging.topic_members(conv, edges, SCOPE), SCOPE).collect()}
    assert set(rows) == {"long", "alone"}
    top = rows["long"]
    assert (top.end_us, top.max_end_us, top.message_count, top.has_threads, top.conversations) == (110 * MIN, 500 * MIN, 5, True, 2)
