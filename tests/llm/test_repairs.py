import functools
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from threadloom.llm import repairs

TURNS = "conv_id long, turn long, role string, text string, mark string, i int, cost string"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], TURNS)


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """(cost, audit, repaired rows) over all edits, with up to three inserts in a row."""
    follows = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}

    @functools.cache
    def best(i, last, left=3):
        ends = [(0, "", ())] if i == len(rows) and last in ("", "a") else []

        def add(letter, price, role, text, at, to, more):
            if (last, to) in follows:
                cost, audit, said = best(at, to, more)
                ends.append((cost + price, letter + audit, (f"{role}:{text}", *said)))

        for role in ("user", "assistant"):
            if left:
                add("I", 2, role, "", i, role[0], left - 1)
        if i < len(rows):
            cost, audit, said = best(i + 1, last)
            ends.append((cost + 3, "D" + audit, said))
            if found[i] not in ("blank", "duplicate"):
                _, role, text = rows[i]
                cut = found[i] == "truncated"
                add("K", cut, role, text, i + 1, role[:1], 3)
                for role in ("user", "assistant"):
                    add("R", 2 + cut, role, text, i + 1, role[0], 3)
        return min(ends, default=(10 ** 9, "", ()))

    return best(0, "")


def expected(conv, rows):
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    found = faults(rows)
    cost, audit, said = cheapest(rows, found)
    whole = [t for t, *_ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (conv, max(whole) - min(whole) + 1 - len(set(whole)) if whole else 0, *(found.count(f) for f in ("blank", "duplicate", "truncated")),
            illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


def known(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(2), []
    for conv in range(150):
        for _ in range(rng.randrange(1, 14)):
            out.append((conv, rng.choice([None, *range(8)]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]),
                        rng.choice([f"text {rng.randrange(9)}.", "cut off", "Why? \n", " \t\n", "", None, "é.", "a. ", "same.", "x" * 9000 + "!"])))
    out += [(None, 1, "user", "ok."), (None, 2, "assistant", "ok.")] + [(900, None, "user", "hi.")] * 3
    return out


def test_same_as_brute_force(spark, rows, monkeypatch):
    told = {}
    for conv, *row in rows:
        told.setdefault(conv, []).append(tuple(row))
    want = sorted((expected(c, r) for c, r in told.items()), key=str)
    assert known(repairs.repair(turns(spark, rows).repartition(5))) == want
    monkeypatch.setattr(repairs, "BROADCAST_REPEATED", 0)
    assert known(repairs.repair(turns(spark, rows))) == want


def test_long_conversation_lies_in_many_chunks(spark):
    """One conversation of 30,000 rows against a plain pass over all rows at once."""
    rng = random.Random(4)
    rows = [(1, i, rng.choice(["user", "assistant", "system", "user"]), rng.choice([f"t {i}.", f"t {i}", "", "again."])) for i in range(30_000)]
    got = repairs.repair(turns(spark, rows).repartition(8)).first()
    found = faults([r[1:] for r in rows])
    after, costs = repairs._LAST, []
    symbols = [0 if f in ("blank", "duplicate") else 1 + 2 * "sua".index(r[2][0]) + (f == "truncated") for r, f in zip(rows, found)]
    for s in reversed(symbols):
        costs.append(after)
        after = repairs._before(s, after)
    assert got["cost"] == after[repairs.START]
    state, audit = repairs.START, ""
    for s, later in zip(symbols, reversed(costs)):
        said, state = repairs.tables()._edit(s, state, later)
        audit += said
    assert got["audit"] == audit + {1: "II", 2: "I"}.get(state, "")


def test_damage_and_conversations_that_lose_all(spark):
    rows = [(c, t, "assistant", f"Line {c}. And {t}! So?") for c in range(60) for t in range(4)] + [(77, None, None, None)]
    want = []
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        want += [(conv, turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    source = turns(spark, rows)
    assert known(repairs.damaged(source)) == sorted(want, key=str)
    named = turns(spark, [(500, 1, "user", "x"), (None, 1, "user", "x")])
    got = {r["conv_id"]: tuple(r)[1:] for r in repairs.repair(turns(spark, [(1, 1, "user", "a."), (1, 2, "assistant", "b.")]), named).collect()}
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert got[500] == got[None] == nothing and got[1][6] == "KK"
    assert repairs.repair(turns(spark, [])).count() == 0


def test_tables_agree_with_single_rows():
    table, rng = repairs.Tables(3), random.Random(1)
    for n in (1, 2, 3, 7, 50):
        symbols = [rng.randrange(9) for _ in range(n)]
        for after, vector in enumerate(table.vectors):
            costs = vector
            for s in reversed(symbols):
                costs = repairs._before(s, costs)
            at, cost, exits = table.transfer(np.array(symbols))
            assert [c + int(cost[after]) for c in table.vectors[at[after]]] == costs
            for state in range(4):
                letters = table.trace(np.array(symbols), after, state)
                assert len(letters) == n and all(w.rstrip("DKR") == w[:-1] for w in letters)
    assert {len(v) for v in table.vectors} == {4} and all(min(v) == 0 for v in table.vectors)
