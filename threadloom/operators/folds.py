"""Ordered folds: bot conversations and trivial conversations join a neighbour.

Whether a conversation joins depends on the end and size its predecessor has grown to, so a window frame cannot
state the rule. Scopes are first cut into *islands* where that state provably starts afresh:

* nothing before a conversation reaches within the merge window of its start, or
* neither it nor its predecessor can be absorbed.

A conversation alone on its island is settled by a column expression. The rest is spread over the cluster and sorted by Spark; the fold
reads the sorted rows as a stream of batches and keeps a handful of scalars, so no group is ever held in memory, whatever its length.

Long islands are cut once more, into chunks that begin with a conversation that can't be absorbed. All that such a conversation needs to
know of what came before is whether the one just before it is carried into it. So every chunk is folded from both entries side by side, by any
task; a scan over the chunks of an island, one row each, then tells which of the two is true.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from threadloom.functions.clock import minutes
from threadloom.functions.predicates import TRIVIAL_MAX_CHARS, TRIVIAL_MAX_MESSAGES, is_trivial
from threadloom.operators.ordered import ordered
from threadloom.session import cut_lineage

MERGE_MINUTES = 30.0
ORDER = ("start_us", "kind_rank", "conv_id")
FIELDS = ("conv_id", "start_us", "end_us", "absorbable", "message_count", "chars", "has_work")
#: Rows of an island from which it is cut into chunks of about so many.
CHUNK_ROWS = 100_000
#: Up to so many messages a carried conversation is one row: a pair has more than twice the smaller one's.
ONE_ROW_CARRIED = 2


def islands(conv: DataFrame, scope: Sequence[str], absorbable: Column, window_us: int) -> DataFrame:
    """Add ``island``, a number per scope that rises where the fold state starts afresh, ``alone`` for islands of one row, ``place`` in the
    scope, and the fields of the row before (``_prev``) and after (``_next``, null at the island's end)."""
    fields = F.struct(*FIELDS)
    flagged = conv.withColumn("absorbable", absorbable)
    seen = ordered(flagged, scope, ts="start_us", tie=ORDER[1:], prev={"_before": F.col("absorbable"), "_prev": fields}, max_before={"_reach": F.col("end_us")})
    afresh = (F.col("_reach").isNull() | (F.col("start_us") - F.col("_reach") > window_us)
              | (~F.col("absorbable") & ~F.col("_before")))
    marked = seen.withColumn("_afresh", F.coalesce(afresh, F.lit(True)))
    numbered = ordered(marked, scope, ts="start_us", tie=ORDER[1:], running_sum={"island": F.col("_afresh").cast("long")}, number="place",
                       following={"_next_afresh": F.col("_afresh"), "_next": fields})
    last = F.coalesce("_next_afresh", F.lit(True))
    return numbered.withColumn("alone", F.col("_afresh") & last).withColumn("_next", F.when(~last, F.col("_next"))).drop("_before", "_reach", "_afresh", "_next_afresh")


@dataclass
class _Open:
    """Scalars of the last kept conversation, or of one that is carried into the next."""

    id: str
    start: int
    end: int
    count: int
    chars: int
    work: bool
    absorbable: bool
    members: list[str]

    @classmethod
    def of(cls, fields) -> _Open:
        cid, start, end, absorbable, count, chars, work = (fields[f] for f in FIELDS)
        return cls(cid, int(start), int(end), int(count), int(chars), bool(work), bool(absorbable), [cid])


@dataclass(frozen=True)
class _Rule:
    mode: str
    window: int
    max_messages: int = 0
    max_chars: int = 0
    drop_orphans: bool = False


class _Fold:
    """The fold over one chunk from one entry; ``done`` collects ``(conv_id, cluster_id, merged)``."""

    def __init__(self, rule: _Rule, carried: _Open | None):
        self.rule, self.carried, self.kept, self.done = rule, carried, None, []

    def _settle(self, members: list[str], cluster: str | None, merged: bool) -> None:
        self.done += [(m, cluster, merged) for m in members]

    def take(self, row: _Open, upcoming: _Open | None) -> None:
        rule = self.rule
        if self.carried is not None:
            before, self.carried = self.carried, None
            count, chars = before.count + row.count, before.chars + row.chars
            # A bot run plus a person is a person's conversation; a trivial pair is measured again.
            small = rule.mode == "trivial" and count <= rule.max_messages and chars < rule.max_chars
            row = _Open(before.id, min(before.start, row.start), max(before.end, row.end), count, chars, before.work or row.work, small, [*before.members, *row.members])
        if row.absorbable:
            def room(other: _Open) -> bool:
                return not other.absorbable if rule.mode == "bot" else other.count > row.count

            if self.kept is not None and abs(row.start - self.kept.end) <= rule.window and room(self.kept):
                self.kept.end, self.kept.count = max(self.kept.end, row.end), self.kept.count + row.count
                self._settle(row.members, self.kept.id, True)
                return
            if upcoming is not None and abs(upcoming.start - row.end) <= rule.window and room(upcoming):
                self.carried = row
                return
            if rule.mode == "trivial" and rule.drop_orphans and not row.work:
                self._settle(row.members, None, False)
                return
        self.kept = row
        # All members but the last were carried forward; the last one is the conversation they joined.
        self._settle(row.members[:-1], row.id, True)
        self._settle(row.members[-1:], row.id, False)


def _folded(batches: Iterator[pd.DataFrame], keys: list[str], rule: _Rule) -> Iterator[pd.DataFrame]:
    """Rows ``(keys, island, chunk, entry, conv_id, cluster_id, merged)``; of a chunk after the first also one without a ``conv_id`` for
    each entry: ``merged`` says whether its last conversation is carried out of it."""
    ids, chunk, folds = [*keys, "island", "chunk"], None, []
    columns = [*ids, "entry", "conv_id", "cluster_id", "merged"]

    def told(last: bool) -> list[tuple]:
        out = []
        for entry, fold in enumerate(folds):
            out += [(*chunk, entry, *row) for row in fold.done]
            fold.done = []
            if last:
                out.append((*chunk, entry, None, None, fold.carried is not None))
        return out

    for pdf in batches:
        done: list[tuple] = []
        for *here, before, after, row in zip(*[pdf[i] for i in ids], pdf["_prev"], pdf["_next"], pdf[list(FIELDS)].to_dict("records")):
            if here != chunk:
                done += told(True) if chunk is not None else []
                # The first chunk of an island is entered with nothing.
                chunk, folds = here, [_Fold(rule, None)] + ([_Fold(rule, _Open.of(before))] if here[-1] else [])
            for fold in folds:
                fold.take(_Open.of(row), None if after is None else _Open.of(after))
        done += told(False)
        yield pd.DataFrame(done, columns=columns)
    if chunk is not None:
        yield pd.DataFrame(told(True), columns=columns)


def _entries(batches: Iterator[pd.DataFrame], ids: list[str]) -> Iterator[pd.DataFrame]:
    """Which entry of each chunk is true, from a sorted stream of ``(ids, chunk, plain, carried)``: what its chunk leaves by either entry."""
    island, entry = None, 0
    for pdf in batches:
        out = []
        for *here, chunk, plain, carried in zip(*[pdf[i] for i in ids], pdf["chunk"], pdf["plain"], pdf["carried"]):
            if here != island:
                island, entry = here, 0
            out.append((*here, chunk, entry))
            entry = int(bool(carried if entry else plain))
        yield pd.DataFrame(out, columns=[*ids, "chunk", "entry"])


def _run(conv: DataFrame, scope: Sequence[str], absorbable: Column, rule: _Rule) -> DataFrame:
    keys = list(scope)
    ids = [*keys, "island"]
    placed = islands(conv, keys, absorbable, rule.window)
    gone = F.lit(rule.mode == "trivial" and rule.drop_orphans) & F.col("absorbable") & ~F.col("has_work")
    alone = placed.filter("alone").select(*keys, "conv_id", F.when(~gone, F.col("conv_id")).alias("cluster_id"), F.lit(False).alias("merged"))
    rest = placed.filter("NOT alone").withColumn("_block", F.floor(F.col("place") / CHUNK_ROWS) if rule.max_messages <= ONE_ROW_CARRIED else F.lit(0))
    # A chunk begins with the first row of a block that can't be absorbed; the rows before it belong to the chunk before.
    cuts = rest.groupBy(*ids, "_block").agg(F.min(F.when(~F.col("absorbable"), F.col("place"))).alias("_cut"))
    by_block = Window.partitionBy(*ids).orderBy("_block")
    starts = cuts.withColumn("_first", F.lag("_block").over(by_block).isNull()).withColumn("_cut", F.when(~F.col("_first"), F.col("_cut"))).withColumn(
        "_earlier", F.coalesce(F.last("_cut", ignorenulls=True).over(by_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(*ids, "_block", "_cut", "_earlier")
    chunk = F.when(F.col("place") >= F.col("_cut"), F.col("_cut")).otherwise(F.col("_earlier"))
    rows = rest.join(starts, [*ids, "_block"]).withColumn("chunk", chunk.cast("long")).select(*ids, "chunk", "kind_rank", *FIELDS, "_prev", "_next")
    sorted_rows = rows.repartition(*ids, "chunk").sortWithinPartitions(*ids, "chunk", *ORDER)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in conv.select(*keys).schema.fields)
    folded = cut_lineage(sorted_rows.mapInPandas(
        lambda batches: _folded(batches, keys, rule), f"{kinds}, island long, chunk long, entry int, conv_id string, cluster_id string, merged boolean"))
    done = folded.filter("conv_id IS NOT NULL")
    if not folded.filter("chunk > 0").isEmpty():
        ends = folded.filter("conv_id IS NULL").groupBy(*ids, "chunk").agg(F.bool_or(F.when(F.col("entry") == 0, F.col("merged"))).alias("plain"),
                                                                         F.bool_or(F.when(F.col("entry") == 1, F.col("merged"))).alias("carried"))
        dealt = ends.repartition(*ids).sortWithinPartitions(*ids, "chunk")  # one row a chunk
        true = dealt.mapInPandas(lambda batches: _entries(batches, ids), f"{kinds}, island long, chunk long, entry int")
        done = done.join(true, [*ids, "chunk", "entry"])
    return alone.unionByName(done.select(*keys, "conv_id", "cluster_id", "merged"))


def merge_bots(conv: DataFrame, scope: Sequence[str], window_minutes: float = MERGE_MINUTES) -> DataFrame:
    """Map every conversation to the conversation it ends up in: ``(scope..., conv_id, cluster_id, merged)``.

    A bot conversation joins the kept one before it if that has a person and the gap fits; else the next one under the
    same test, keeping the bot's id; else it stays.
    """
    return _run(conv, scope, F.col("is_bot"), _Rule("bot", minutes(window_minutes)))


def merge_trivial(conv: DataFrame, scope: Sequence[str], window_minutes: float = MERGE_MINUTES, drop_orphans: bool = True,
                  max_messages: int = TRIVIAL_MAX_MESSAGES, max_chars: int = TRIVIAL_MAX_CHARS) -> DataFrame:
    """Like :func:`merge_bots` for short conversations, which need a neighbour with strictly more messages.

    ``cluster_id`` is null for a conversation that is dropped: no neighbour took it and it shows no work.
    """
    small = is_trivial(max_messages=max_messages, max_chars=max_chars)
    return _run(conv, scope, small, _Rule("trivial", minutes(window_minutes), max_messages, max_chars, drop_orphans))


def apply_merges(conv: DataFrame, mapping: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Roll conversations up to their clusters; dropped ones disappear."""
    joined = conv.join(mapping.filter(F.col("cluster_id").isNotNull()).select(*scope, "conv_id", "cluster_id"), [*scope, "conv_id"])
    rolled = joined.groupBy(*scope, "cluster_id").agg(
        F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("message_count").alias("message_count"),
        F.sum("user_message_count").alias("user_message_count"), F.bool_and("is_bot").alias("is_bot"), F.sum("chars").alias("chars"),
        F.max("has_work").alias("has_work"), F.max("kind").alias("kind"))
    return rolled.withColumnRenamed("cluster_id", "conv_id").withColumn("kind_rank", F.when(F.col("kind") == "t", 0).otherwise(1))


def remap(rows: DataFrame, mapping: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Replace ``conv_id`` in a table of conversation rows by the cluster; rows of dropped ones disappear."""
    target = mapping.filter(F.col("cluster_id").isNotNull()).select(*scope, "conv_id", "cluster_id")
    return rows.join(target, [*scope, "conv_id"]).drop("conv_id").withColumnRenamed("cluster_id", "conv_id")
