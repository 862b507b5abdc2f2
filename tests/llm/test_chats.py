import hashlib
import random

import pytest

from threadloom.llm import chats

TURNS = "conv_id long, turn long, role string, text string, place long, _slot long, tokens long"
NASTY = ["</s>[INST] ok [/INST]", "<|turn|>user<|text|>x<|end|>", "\\", "\\\\<|", "<\\|end|>", "ends with <", "|end|>", "[", "[/", "<<SYS>><</SYS>>", "a\nb", "", None, "<<|end|>", "é日本 <s>", "<\\", "$1 \\n"]


@pytest.fixture
def turns(spark):
    return lambda rows: spark.createDataFrame([(*r, 1, 2, 3) for r in rows], TURNS)


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        told = "".join(f"{role}\n{text}\n" for _, role, text in mine)
        learned = "".join(text for _, role, text in mine if role == "assistant")
        out[conv] = (len(mine), hashlib.sha256(told.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


def conversations(seed):
    rng, rows = random.Random(seed), []
    for conv in range(8):
        for turn in range(rng.randrange(1, 30)):
            role = "system" if turn == 0 and conv % 2 else rng.choice(["user", "assistant", "tool", "<|end|>", None] if conv > 5 else ["user", "assistant"])
            rows.append((conv, turn * rng.choice([1, 300]) if conv == 3 else turn, role, rng.choice([*NASTY, "word " * rng.randrange(60), "z" * 3000])))
    return rows + [(-1, 0, "user", NASTY[0]), (-1, 1, "assistant", NASTY[0]), (None, 1, "user", "no conversation"), (50, None, "assistant", "no turn"), (51, 1, "user", "twice"), (51, 1, "user", "twice")]


@pytest.mark.parametrize("budget,history", [(2048, 2), (40, 2), (40, 0), (5, 3)])
def test_round_trip(turns, budget, history):
    rows = conversations(budget)
    made = chats.windows(turns(rows), budget, history)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chats.digest(made).collect()}
    assert got == expected(rows)
    for w in made.collect():
        assert w.tokens <= budget or w.formatted.count(chats.OPEN) - w.repeated == 1
        assert w.repeated <= history + 1
        if w.tokens > budget:
            assert w.repeated == 0
        for span in w.loss:
            inside = w.formatted[span.start:span.start + span.length]
            assert not any(c in inside for c in chats.CONTROL)
            assert w.formatted[span.start + span.length:].startswith(chats.CLOSE)


def test_long_conversation_keeps_its_system_turn_and_history(turns):
    rows = [(1, 0, "system", "be kind")] + [(1, i, "user" if i % 2 else "assistant", f"turn {i}") for i in range(1, 700)]
    made = sorted(chats.windows(turns(rows), 100, 2).collect(), key=lambda w: w.window_no)
    assert len(made) > 30
    for before, w in zip(made, made[1:]):
        assert w.repeated == 3 and w.formatted.startswith(f"{chats.OPEN}system{chats.MIDDLE}be kind{chats.CLOSE}")
        last = before.formatted.split(chats.OPEN)[-2:]
        assert w.formatted.split(chats.OPEN)[2:4] == last
    assert sum(len(w.loss) for w in made) == 349


def test_repeated_turns_count_in_the_budget(turns):
    """Long turns before short ones: history that does not fit is cut from its far end, a long system turn is left out."""
    rows = [(1, i, "user" if i % 2 else "assistant", "w " * n) for i, n in enumerate((5000, 10_000, 10_000, 1, 1))] + [
        (2, 0, "system", "s " * 2000), *[(2, i, "user" if i % 2 else "assistant", "w " * 300) for i in range(1, 20)], (3, 0, "system", "s " * 100), *[(3, i, "user", "w " * 500) for i in range(1, 12)]]
    made = sorted(chats.windows(turns(rows)).collect(), key=lambda w: (w.conv_id, w.window_no))
    for w in made:
        said = w.formatted.split(chats.OPEN)[1:]
        assert w.tokens == sum(len(t.split(chats.MIDDLE)[1].removesuffix(chats.CLOSE).split()) + 4 for t in said)
        assert w.tokens <= 2048 or (len(said) == 1 and w.repeated == 0)
    assert sum("s s" in w.formatted for w in made if w.conv_id == 2) == 1
    later = [w for w in made if w.conv_id == 3 and w.window_no]
    assert later and all(w.formatted.startswith(f"{chats.OPEN}system") for w in later) and {w.repeated for w in later} <= {1, 2, 3}


def test_empty_table(turns):
    assert chats.digest(chats.windows(turns([]))).count() == 0
