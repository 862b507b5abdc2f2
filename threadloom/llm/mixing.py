"""Mix sources to target weights with hash-threshold histograms (operator 1).

Every document has a 48-bit hash of its id. A source takes each document ``copies`` whole times and those with a hash below
the source's threshold once more. The threshold comes from histograms: words by source and by the next 12 bits of the hash;
the bucket in which the budget runs out is the boundary, and only its documents are counted again by the following 12 bits.
Four levels reach single hash values, so nothing is ever sorted. Every histogram has at most 4,096 rows a source and is summed
before its shuffle, so a source with most of the rows costs no more than the others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from threadloom.llm.common import boxed, small_side, unboxed
from threadloom.session import cut_lineage

BITS, LEVELS = 12, 4
WORD = r"[^\x20\x09-\x0D]+"
#: A table of sources up to this many rows is sent to every task; a larger one is joined by a shuffle.
BROADCAST_SOURCES = 100_000


def sized(docs: DataFrame, seed: str = "") -> DataFrame:
    """``(doc_id, source, size, _h)``: words of the whole text (null: 0) and a hash of the id (null: that of an empty string)."""
    size = F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit(WORD))).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), hashed(seed).alias("_h"))


def hashed(seed: str = "") -> Column:
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, BITS * LEVELS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, one row per source.

    Sources in code point order, null last, get the weights in turn and share ``share`` times all words. No target is above
    ``most`` times its source; what is cut off goes to the others by weight. That end state is one water level: sorted by the
    level at which they are full, sources below the level take all they may and the others weight times level.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    full_first = Window.orderBy("_full", "_no")
    upto, beyond = full_first.rowsBetween(Window.unboundedPreceding, -1), full_first.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    placed = sizes.withColumn("_no", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("_no") % len(weights) + 1).cast("int"))
    levels = placed.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * most).withColumn("_full", F.col("_cap") / F.col("_w")).withColumn(
        "_level", (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(upto), F.lit(0))) / F.sum("_w").over(beyond))
    # The first source that its level does not fill: the levels of those after it may be lower still.
    level = F.min(F.when(F.col("_level") <= F.col("_full"), F.struct("_full", "_no", "_level"))).over(everything)
    found = levels.withColumn("_at", level["_level"])
    open_ = F.col("_at").isNotNull() & (F.col("_full") >= F.col("_at"))
    return found.select("source", "source_size", F.when(open_, F.col("_w") * F.col("_at")).otherwise(F.col("_cap").cast("double")).alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: str = "") -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, taken)``, one row per row of ``docs``.

    ``copies`` says how often the mix takes the document, ``taken`` is copies times size; ``copies`` is never above ``most``.
    The words taken from a source differ from its target by at most half the words under one hash value: half a document, or
    half of the rows that share an id, which go in or stay out together. Reruns agree, and a higher target only adds documents.
    Null and empty texts have size 0, a null source is a source of its own, an empty table gives no rows, other columns are
    not used.
    """
    rows = cut_lineage(sized(docs, seed))
    return _joined(rows, _thresholds(rows, weights, share, most)).select(
        "doc_id", "source", "size", F.col("_size").alias("source_size"), F.col("_target").alias("target"), _copies().alias("copies"), (_copies() * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: str = "") -> DataFrame:
    """The rows of ``docs``, each as often as :func:`mix` takes it. Only the sources' thresholds are joined; texts stay where they are."""
    state = _thresholds(cut_lineage(sized(docs, seed)), weights, share, most)
    taken = _joined(boxed(docs, "source", hashed(seed).alias("_h")), state).withColumn("_copies", _copies()).filter(F.col("_copies") > 0)
    return unboxed(taken.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int")))))


def _thresholds(rows: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """One row per source: whole copies, budget left, and the hash value at which it runs out."""
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = cut_lineage(goals.withColumn("_whole", whole).withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size")).withColumn(
        "_path", F.lit(0).cast("long")).withColumn("_before", F.lit(0).cast("long")).withColumn("_tie", F.lit(0).cast("long")))
    for level in range(1, LEVELS + 1):
        state = cut_lineage(_refined(rows, state, level))
    return state


def _joined(rows: DataFrame, state: DataFrame) -> DataFrame:
    side = small_side(state.withColumnsRenamed({"source": "_source", "source_size": "_size", "target": "_target"}), BROADCAST_SOURCES)
    return rows.join(side, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def _refined(rows: DataFrame, state: DataFrame, level: int) -> DataFrame:
    """One histogram of the boundary bucket of each source; its own boundary bucket is the new one."""
    above, below = BITS * (LEVELS - level + 1), BITS * (LEVELS - level)
    inside = _joined(rows, state).filter(F.shiftright("_h", above) == F.col("_path"))
    histogram = inside.groupBy("source", F.shiftright("_h", below).alias("_bucket")).agg(F.sum("size").alias("_n"), F.first("_rest").alias("_rest"),
                                                                                         F.first("_before").alias("_before"))
    order = Window.partitionBy("source").orderBy("_bucket")
    running = histogram.withColumn("_until", F.col("_before") + F.sum("_n").over(order))
    edge = running.filter(F.col("_until") > F.col("_rest")).groupBy("source").agg(
        F.min_by(F.struct("_bucket", (F.col("_until") - F.col("_n")).alias("before"), "_n"), "_bucket").alias("_edge")).withColumnRenamed("source", "_of")
    out = state.join(edge, F.col("source").eqNullSafe(F.col("_of")), "left")
    # Without an edge the budget takes the whole source: the path stays null and every comparison with it is settled by _copies.
    return out.select("source", "source_size", "target", "_whole", "_rest", F.col("_edge._bucket").alias("_path"), F.col("_edge.before").alias("_before"),
                      F.col("_edge._n").alias("_tie"))


def _copies():
    over, under = F.col("_before") + F.col("_tie") - F.col("_rest"), F.col("_rest") - F.col("_before")
    once_more = F.when(F.col("_rest") <= 0, False).when(F.col("_path").isNull(), True).otherwise(
        (F.col("_h") < F.col("_path")) | ((F.col("_h") == F.col("_path")) & (over < under)))
    return F.col("_whole") + once_more.cast("long")
