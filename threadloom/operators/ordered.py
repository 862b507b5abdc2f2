"""Ordered operators that do not put a whole key into one task.

A plain ``Window.partitionBy(channel)`` sends all rows of a busy channel to one task. The helper here
cuts every key into fixed-width time slots: neighbours, counters and running values are computed inside
``(key, slot)`` and completed with a carry, one row per ``(key, slot)``, that comes from a partially
aggregated group-by. Only that small carry table is windowed by key alone; its size follows the length of
the calendar, not the number of rows.

A slot may still hold most rows of a table. Where ``most_rows`` is given, slots with more rows are cut further (:func:`sub_slots`), and the
carry runs over slots and their parts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from threadloom.functions.clock import HOUR_US, slot
from threadloom.session import cut_lineage

#: Rows of one key and slot from which operators over raw messages cut it into parts.
HOT_ROWS = 1_000_000
#: Quantiles asked for in a hot slot; a slot of more than so many times the bound gets parts larger than it.
QUANTILES = 255


def _cuts(rows: DataFrame, keys: list[str], value: str, most_rows: int) -> DataFrame:
    """Distinct values that cut the rows of each key into parts of about ``most_rows``, in order; only for keys with more."""
    quantiles = F.percentile_approx(value, [i / (QUANTILES + 1) for i in range(1, QUANTILES + 1)], F.lit(4 * QUANTILES))
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), quantiles.alias("_q")).filter(F.col("_n") > most_rows)
    number = F.least(F.lit(QUANTILES), F.ceil(F.col("_n") / most_rows)).cast("int")
    picked = F.transform(F.sequence(F.lit(1), number), lambda i: F.element_at("_q", F.greatest(F.lit(1), F.floor(i * QUANTILES / (number + 1))).cast("int")))
    return found.select(*keys, F.array_sort(F.array_distinct(picked)).alias("_at"))


def _part(value: str) -> Column:
    """Which part a value is in: two for each cut below it, and one more for a cut's own value, so that ties stay together."""
    below = F.aggregate("_at", F.lit(0), lambda n, c: n + F.when(c < F.col(value), 2).when(c == F.col(value), 1).otherwise(0))
    return F.coalesce(below, F.lit(0))


def sub_slots(rows: DataFrame, keys: Sequence[str], order: Sequence[str], most_rows: int) -> DataFrame:
    """Add ``_s1`` and ``_s2`` to rows with a ``_slot``: parts of slots that hold more than ``most_rows`` rows, in the order of ``order``.

    Hot slots are cut at quantiles of the first column; rows that all share one of its values are cut at quantiles of the second, if that is a
    number. Counts are one partial aggregate; quantiles are taken in hot slots only. Without any, both are 0 for nothing more than the count.
    """
    keys = [*keys, "_slot"]
    hot = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most_rows).select(*keys)
    if hot.isEmpty():
        return rows.withColumns({"_s1": F.lit(0), "_s2": F.lit(0)})
    hot = cut_lineage(hot)

    def marked(some: DataFrame, ids: list[str], value: str, within: DataFrame, name: str) -> DataFrame:
        # Hot keys are few, at most as many as the table has times most_rows.
        cuts = cut_lineage(_cuts(within, ids, value, most_rows))
        return some.join(F.broadcast(cuts) if cuts.limit(10_001).count() <= 10_000 else cuts, ids, "left").withColumn(name, _part(value)).drop("_at")

    first = marked(rows, keys, order[0], rows.join(F.broadcast(hot) if hot.limit(10_001).count() <= 10_000 else hot, keys, "left_semi"), "_s1")
    numbers = ("tinyint", "smallint", "int", "bigint", "float", "double", "timestamp")
    if len(order) < 2 or dict(rows.dtypes)[order[1]] not in numbers:
        return first.withColumn("_s2", F.lit(0))
    same = first.filter(F.col("_s1") % 2 == 1)
    ids = [*keys, "_s1"]
    return marked(first, ids, order[1], same, "_s2").withColumn("_s2", F.when(F.col("_s1") % 2 == 1, F.col("_s2")).otherwise(0))


def ordered(
    df: DataFrame,
    keys: Sequence[str],
    *,
    ts: str = "ts_us",
    tie: Sequence[str] = ("msg_id",),
    width_us: int = HOUR_US,
    prev: Mapping[str, Column] | None = None,
    following: Mapping[str, Column] | None = None,
    running_sum: Mapping[str, Column] | None = None,
    max_before: Mapping[str, Column] | None = None,
    number: str | None = None,
    before: str | None = None,
    most_rows: int | None = None,
) -> DataFrame:
    """Add ordered columns per ``keys`` in the order ``(ts, *tie)``.

    ``prev``/``following``: value of the row just before/after. ``running_sum``: inclusive running sum.
    ``max_before``: maximum over all earlier rows. ``number``: 1-based position. ``before``: how many rows
    have a strictly smaller ``ts``. Keys must not be null. ``most_rows``: slots with more rows are cut into parts.
    """
    prev, following = dict(prev or {}), dict(following or {})
    running_sum, max_before = dict(running_sum or {}), dict(max_before or {})
    keys, order = list(keys), [ts, *tie]
    place, counted = F.struct(*order), number or before

    work = df.withColumn("_slot", slot(ts, width_us))
    if most_rows is None:
        cells, split = ["_slot"], ["_slot"]
    else:
        work, cells, split = sub_slots(work, keys, order, most_rows), ["_slot", "_s1", "_s2"], ["_slot", "_s1"]
    parts: list[Column] = [F.count(F.lit(1)).alias("_rows")]
    if prev:
        parts.append(F.max_by(F.struct(*[c.alias(n) for n, c in prev.items()]), place).alias("_last"))
    if following:
        parts.append(F.min_by(F.struct(*[c.alias(n) for n, c in following.items()]), place).alias("_first"))
    parts += [F.sum(c).alias(f"_sum_{n}") for n, c in running_sum.items()]
    parts += [F.max(c).alias(f"_max_{n}") for n, c in max_before.items()]

    by_slot = Window.partitionBy(*keys).orderBy(*cells)
    earlier = by_slot.rowsBetween(Window.unboundedPreceding, -1)
    carry: list[Column] = []
    if counted:
        carry.append(F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"))
        # Parts of one value of ts have the same rows before them.
        together = Window.partitionBy(*keys).orderBy(*split).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        carry.append((F.sum("_rows").over(together) - F.sum("_rows").over(Window.partitionBy(*keys, *split))).alias("_rows_below"))
    if prev:
        carry.append(F.lag("_last").over(by_slot).alias("_carry_last"))
    if following:
        carry.append(F.lead("_first").over(by_slot).alias("_carry_first"))
    carry += [F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_carry_sum_{n}") for n in running_sum]
    carry += [F.max(f"_max_{n}").over(earlier).alias(f"_carry_max_{n}") for n in max_before]
    carried = work.groupBy(*keys, *cells).agg(*parts).select(*keys, *cells, *carry)

    inside = Window.partitionBy(*keys, *cells).orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    strictly = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = work.join(carried, [*keys, *cells])
    position = F.row_number().over(inside)
    added: dict[str, Column] = {}
    for n, c in prev.items():
        added[n] = F.when(position > 1, F.lag(c).over(inside)).otherwise(F.col("_carry_last")[n])
    if following:
        is_last = F.lead(F.lit(1)).over(inside).isNull()
        for n, c in following.items():
            added[n] = F.when(is_last, F.col("_carry_first")[n]).otherwise(F.lead(c).over(inside))
    for n, c in running_sum.items():
        added[n] = F.col(f"_carry_sum_{n}") + F.coalesce(F.sum(c).over(so_far), F.lit(0))
    for n, c in max_before.items():
        added[n] = F.greatest(F.col(f"_carry_max_{n}"), F.max(c).over(strictly))
    if number:
        added[number] = (F.col("_rows_before") + position).cast("long")
    if before:
        ranked = Window.partitionBy(*keys, *cells).orderBy(ts)
        added[before] = (F.col("_rows_below") + F.rank().over(ranked) - 1).cast("long")
    return out.select(*df.columns, *[c.alias(n) for n, c in added.items()])


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int | None, name: str = "rank") -> DataFrame:
    """First ``n`` rows per key, all of them with ``None``. Spark turns the rank filter into a per-task limit before the shuffle,
    so a busy key sends at most ``n`` rows from each task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(name, F.row_number().over(w))
    return ranked if n is None else ranked.filter(F.col(name) <= n)
