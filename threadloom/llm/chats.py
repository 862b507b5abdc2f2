"""Chat formatting in budgeted windows (operator 9).

Turns are placed by prefix sums of their tokens: the sums cut a conversation into bins of equal size, a turn that lies in one
bin joins the window of that bin, a turn across an edge has a window of its own. So every window is turn-aligned, and no turn has
to wait for the one before it. A bin is three quarters of the budget; the rest is for what windows after the first repeat, the system turn and the
last turns before them, as far as all of it fits. So no window passes the budget unless a single new turn does. Only new assistant
turns are targets of the loss, so each is learned once. On the test tables windows of long conversations are about half full.

The output of a window is one string of marked turns. Control strings inside texts are broken by a backslash after their first
character, and backslashes doubled, which :func:`unescape` takes back.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

OPEN, MIDDLE, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that a text must not bring into the output by itself. The template's own all begin with ``<|``.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
SLOT = 256
#: The part of the budget that new turns are cut by.
NEW_TURNS = 0.75
WORDS = r"\S+"


def escape(text: Column) -> Column:
    pieces = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL)
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({pieces})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def turn_text(role: Column, text: Column) -> Column:
    """One marked turn."""
    return F.concat(F.lit(OPEN), escape(role), F.lit(MIDDLE), escape(text), F.lit(CLOSE))


def placed(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, place, tokens, until)``: position from 1 and tokens up to and with the turn.

    Tokens are words plus four for the marks. Windows run inside ``(conv_id, turn // 256)`` and a carry of one row per such slot
    completes them, so a very long conversation is split.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "tokens", (F.regexp_count("text", F.lit(WORDS)) + 4).cast("long")).withColumn("_slot", F.floor(F.coalesce("turn", F.lit(0)) / SLOT))
    carry = rows.groupBy("conv_id", "_slot").agg(F.count(F.lit(1)).alias("_rows"), F.sum("tokens").alias("_sum"))
    before = Window.partitionBy("conv_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = carry.select(F.col("conv_id").alias("_conv"), F.col("_slot").alias("_at"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows"),
                           F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_sum"))
    inside = Window.partitionBy("conv_id", "_slot").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = rows.withColumn("_n", F.count(F.lit(1)).over(inside)).withColumn("_t", F.sum("tokens").over(inside)).join(
        carried, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_slot") == F.col("_at")))
    return joined.select("conv_id", "turn", "role", "text", (F.col("_rows") + F.col("_n")).alias("place"), "tokens", (F.col("_sum") + F.col("_t")).alias("until"))


def windows(turns: DataFrame, budget: int = 2048, history: int = 2) -> DataFrame:
    """``(conv_id, window_no, formatted, repeated, tokens, loss)``, one row per window.

    ``repeated`` leading turns were in an earlier window. ``loss`` holds the spans ``(start, length)``, in code points of
    ``formatted`` from 0, of the texts of new assistant turns. ``tokens`` counts all turns of the window; it is above ``budget`` only
    if a single new turn is. The system turn is repeated if it fits beside the new turns, then of the ``history`` turns before them as many,
    from the nearest on, as fit too; a longer system turn is left out. A turn's place is by ``turn``, nulls first, then role and text. Null role and text count as
    empty, a null ``conv_id`` is a conversation of its own, repeated rows are turns of their own, an empty table gives no windows,
    other columns are not used.
    """
    rows = placed(turns)
    width = max(1, int(budget * NEW_TURNS))
    first_bin, last_bin = F.floor((F.col("until") - F.col("tokens")) / width), F.floor((F.col("until") - 1) / width)
    rows = rows.withColumn("window_no", (first_bin * 2 + (first_bin != last_bin).cast("long")).cast("long"))
    new = rows.select("conv_id", "window_no", "place", "role", "text", "tokens", F.lit(True).alias("new"))

    # A window is asked for under the place of its first turn: the turns just before it, and the system turn, go there again.
    begin = rows.groupBy("conv_id", "window_no").agg(F.min("place").alias("_first"), (F.lit(budget) - F.sum("tokens")).alias("_room")).filter(F.col("_first") > 1)
    last = [F.col("_first") - back for back in range(1, history + 1)]
    wanted = begin.select(F.col("conv_id").alias("_conv"), "window_no", F.explode(F.array_distinct(F.array(F.lit(1).cast("long"), *last))).alias("_place"), "_first", "_room")
    again = rows.drop("window_no").join(wanted, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("place") == F.col("_place"))).filter(
        (F.col("place") >= F.col("_first") - history) | (F.col("role") == "system"))
    # At most one turn more than the history in a window: the system turn first, then the nearest, as long as they fit.
    system = (F.col("place") == 1) & (F.col("role") == "system")
    nearest = Window.partitionBy("conv_id", "window_no").orderBy(F.when(system, 0).otherwise(1), F.desc("place")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = again.filter(~system | (F.col("tokens") <= F.col("_room"))).withColumn("_used", F.sum("tokens").over(nearest)).filter(F.col("_used") <= F.col("_room"))
    old = fits.select("conv_id", "window_no", "place", "role", "text", "tokens", F.lit(False).alias("new"))

    head = F.length(F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE)))
    marked = new.unionByName(old).select("conv_id", "window_no", "tokens", F.struct(
        "place", turn_text(F.col("role"), F.col("text")).alias("marked"), head.alias("head"), "new",
        (F.col("new") & (F.col("role") == "assistant")).alias("target")).alias("t"))
    gathered = marked.groupBy("conv_id", "window_no").agg(F.array_sort(F.collect_list("t")).alias("t"), F.sum("tokens").alias("tokens"))
    with_ends = gathered.withColumn("formatted", F.array_join(F.transform("t", lambda x: x["marked"]), "")).withColumn("_ends", F.expr(
        "aggregate(t, array(0L), (a, x) -> array_append(a, element_at(a, -1) + length(x.marked)))"))
    spans = F.filter(F.transform("t", lambda x, i: F.when(x["target"], F.struct(
        (F.get("_ends", i) + x["head"]).cast("long").alias("start"), (F.length(x["marked"]) - x["head"] - len(CLOSE)).cast("long").alias("length")))),
        lambda x: x.isNotNull())
    return with_ends.select("conv_id", "window_no", "formatted", F.size(F.filter("t", lambda x: ~x["new"])).cast("long").alias("repeated"), "tokens", spans.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``(conv_id, window_no, turns, learned, chars)`` parsed from windows: the new turns ``(role, text)`` and the unescaped texts under
    the loss mask, both in order. Works on the strings and spans alone."""
    turn = rf"(?s){re.escape(OPEN)}(.*?){re.escape(MIDDLE)}(.*?){re.escape(CLOSE)}"
    roles, texts = F.regexp_extract_all("formatted", F.lit(turn), 1), F.regexp_extract_all("formatted", F.lit(turn), 2)
    both = F.transform(F.arrays_zip(roles.alias("role"), texts.alias("text")), lambda x: F.struct(
        unescape(x["role"]).alias("role"), unescape(x["text"]).alias("text")))
    new = F.slice(both, (F.col("repeated") + 1).cast("int"), F.size(both))
    learned = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select("conv_id", "window_no", new.alias("turns"), learned.alias("learned"), F.length("formatted").cast("long").alias("chars"))


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation, from windows read back: number of turns, hashes of all turns and of all learned text, and sizes.

    A hash over a whole conversation needs its text in one value; each window is reduced to its two strings before that.
    """
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    parts = read_back(formatted).select("conv_id", "chars", F.size("turns").alias("_n"), F.struct("window_no", told.alias("told"), F.array_join("learned", "").alias("learned")).alias("_w"))
    whole = parts.groupBy("conv_id").agg(F.sum("_n").alias("n_turns"), F.array_sort(F.collect_list("_w")).alias("_w"), F.sum("chars").alias("formatted_chars"))
    joined = lambda field: F.array_join(F.transform("_w", lambda x: x[field]), "")
    return whole.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.sha2(joined("told"), 256).alias("turns_sha256"),
                        F.length(joined("learned")).cast("long").alias("loss_chars"), F.sha2(joined("learned"), 256).alias("loss_sha256"),
                        F.col("formatted_chars").cast("long").alias("formatted_chars"))
