"""Which conversations belong together: candidate pairs, merge rules, topics.

Candidates are never "every pair of a group". Two conversations can only merge inside a time window, so the
end of the first and the start of the second are put into slots of that width and only neighbouring slots of one
scope meet; above the adjacency window they must also share a reference, so there the join key holds the reference
value. Sizes and intersections are counted, not collected into arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from threadloom.functions import similarity
from threadloom.functions.clock import minutes, slot
from threadloom.functions.predicates import is_direct_channel
from threadloom.operators.components import connected_components
from threadloom.session import cut_lineage

ORDER = ("start_us", "kind_rank", "conv_id")


@dataclass(frozen=True)
class MergeRules:
    """Windows in minutes and lowest similarities; every value can be overridden."""

    adjacent_minutes: float = 15
    proximity_minutes: float = 90
    proximity_similarity: float = 0.20
    direct_minutes: float = 180
    direct_similarity: float = 0.05
    same_author_minutes: float = 360
    same_author_similarity: float = 0.20
    similarity_minutes: float = 240
    similarity_threshold: float = 0.40
    reference_weight: float = similarity.REFERENCE_WEIGHT
    embedding_weight: float = similarity.EMBEDDING_WEIGHT

    def widest(self) -> float:
        return max(self.adjacent_minutes, self.proximity_minutes, self.direct_minutes, self.same_author_minutes, self.similarity_minutes)

    def unconditional(self) -> float:
        """Widest window in which no similarity is asked for."""
        rules = [(self.proximity_minutes, self.proximity_similarity), (self.direct_minutes, self.direct_similarity),
                 (self.same_author_minutes, self.same_author_similarity), (self.similarity_minutes, self.similarity_threshold)]
        return max([self.adjacent_minutes, *[w for w, s in rules if s <= 0]])

    def asked(self, direct: bool) -> list[tuple[float, float]]:
        """``(minutes, similarity)`` of the rules for direct or other channels that ask for a similarity."""
        near = (self.direct_minutes, self.direct_similarity) if direct else (self.proximity_minutes, self.proximity_similarity)
        rules = [near, (self.same_author_minutes, self.same_author_similarity), (self.similarity_minutes, self.similarity_threshold)]
        return [r for r in rules if r[1] > 0]


def _sides(conv: DataFrame, scope: Sequence[str], extra: Sequence[str], window_us: int) -> tuple[DataFrame, DataFrame]:
    """The two sides of a band join: ends in their own slot, starts in the slot and its two neighbours."""
    place = F.struct(*ORDER)
    left = conv.select(*scope, *extra, F.col("conv_id").alias("left_id"), place.alias("_left"), F.col("end_us").alias("_end"),
                       slot("end_us", window_us).alias("_band"))
    here = slot("start_us", window_us)
    right = conv.select(*scope, *extra, F.col("conv_id").alias("right_id"), place.alias("_right"), F.col("start_us").alias("_start"),
                        F.explode(F.array(here - 1, here, here + 1)).alias("_band"))
    return left, right


def _in_band(pairs: DataFrame, window_us: int) -> DataFrame:
    gap = F.abs(F.col("_start") - F.col("_end"))
    return pairs.filter((F.col("_left") < F.col("_right")) & (gap <= window_us)).withColumn("gap_us", gap)


def near_pairs(conv: DataFrame, scope: Sequence[str], window_minutes: float) -> DataFrame:
    """Pairs (earlier, later) whose gap, end to start in absolute value, is within the window."""
    window_us = minutes(window_minutes)
    left, right = _sides(conv, scope, (), window_us)
    return _in_band(left.join(right, [*scope, "_band"]), window_us).select(*scope, "left_id", "right_id", "gap_us")


def shared_reference_pairs(conv: DataFrame, conv_refs: DataFrame, scope: Sequence[str], window_minutes: float = 360) -> DataFrame:
    """Pairs within the window that share at least one reference, with their overlap score.

    An inverted index on ``(scope, reference, time slot)``; the size of the intersection is the number of
    rows a pair gets, added up with a partial aggregate.
    """
    window_us = minutes(window_minutes)
    ids = [*scope, "conv_id"]
    values = conv_refs.filter("comparable").select(*ids, "value")
    sizes = values.groupBy(*ids).agg(F.count(F.lit(1)).alias("_size"))
    placed = values.join(conv.select(*ids, "start_us", "end_us", "kind_rank"), ids).join(sizes, ids)
    left, right = _sides(placed, scope, ("value", "_size"), window_us)
    left, right = left.withColumnRenamed("_size", "_left_size"), right.withColumnRenamed("_size", "_right_size")
    met = _in_band(left.join(right, [*scope, "value", "_band"]), window_us)
    counted = met.groupBy(*scope, "left_id", "right_id", "gap_us", "_left_size", "_right_size").agg(F.count(F.lit(1)).alias("shared"))
    return counted.withColumn("similarity", similarity.jaccard_from_sizes(F.col("shared"), F.col("_left_size"), F.col("_right_size"))).drop(
        "_left_size", "_right_size")


#: Room for rounding in bounds of cosines.
_SLACK = 1e-9


def _needed_cosine(rules: MergeRules, gap: Column | None) -> Column:
    """The lowest cosine with which a pair that shares no reference can pass a rule at a gap, or at any gap."""
    def lowest(direct: bool) -> Column:
        parts = [F.lit(s / rules.embedding_weight) if gap is None else F.when(gap <= minutes(w), s / rules.embedding_weight) for w, s in rules.asked(direct)]
        return F.least(*parts, F.lit(None).cast("double"), F.lit(None).cast("double"))

    return F.when(is_direct_channel(), lowest(True)).otherwise(lowest(False))


def heavy_dimensions(vectors: DataFrame, ids: Sequence[str], rules: MergeRules) -> DataFrame:
    """``(ids..., _dim, _x, _rest)``: the heaviest dimensions of each unit vector, signed, and the norm of all its others.

    So many are kept that the others have less than half the norm that any pair needs as a cosine: two vectors without a kept dimension in
    common can't reach it. Zero vectors have none.
    """
    entries = F.filter(F.transform("embedding", lambda x, i: F.struct(F.abs(x.cast("double")).alias("m"), F.when(x > 0, i + 1).otherwise(-1 - i).alias("dim"))), lambda e: e["m"] > 0)
    rows = vectors.select(*ids, F.sort_array(entries, asc=False).alias("_e"), (_needed_cosine(rules, None) / 2 * (1 - 1e-6)).alias("_most"))
    total = F.aggregate("_e", F.lit(0.0), lambda a, e: a + e["m"] * e["m"])
    rows = rows.withColumn("_total", total).filter("_total > 0 AND _most IS NOT NULL").withColumn("_limit", F.col("_most") * F.col("_most") * F.col("_total"))
    start = F.struct(F.col("_total").alias("left"), F.lit(0).alias("n"))
    cut = F.aggregate("_e", start, lambda a, e: F.when(a["left"] > F.col("_limit"), F.struct((a["left"] - e["m"] * e["m"]).alias("left"), (a["n"] + 1).alias("n"))).otherwise(a))
    rows = rows.withColumn("_cut", cut)
    norm = F.sqrt("_total")
    return rows.select(*ids, F.explode(F.slice("_e", F.lit(1), F.col("_cut.n"))).alias("_e"), norm.alias("_norm"), F.sqrt(F.greatest(F.col("_cut.left"), F.lit(0.0)) / F.col("_total")).alias("_rest")).select(
        *ids, F.col("_e.dim").alias("_dim"), (F.col("_e.m") / F.col("_norm")).alias("_x"), "_rest")


def close_vector_pairs(conv: DataFrame, vectors: DataFrame, scope: Sequence[str], rules: MergeRules) -> DataFrame:
    """Pairs inside the widest window whose vectors may lift them over a threshold without a shared reference.

    An exact cosine-threshold join. The heaviest dimensions are filed under ``(scope, time slot, dimension, sign)``; what two vectors
    have in common there, with the norms of what is not filed, bounds their cosine from above, and pairs under what their gap asks
    for are dropped. Where the lists would hold more pairs than the window itself, as with dense vectors, the window's pairs are taken.
    """
    scope, window_us = list(scope), minutes(rules.widest())
    if rules.embedding_weight <= 0 or not (rules.asked(True) or rules.asked(False)):
        return near_pairs(conv.limit(0), scope, rules.widest())
    ids = [*scope, "conv_id"]
    placed = vectors.filter(F.col("embedding").isNotNull()).join(conv.select(*ids, "start_us", "end_us", "kind_rank"), ids)
    heavy = cut_lineage(heavy_dimensions(placed, [*ids, "start_us", "end_us", "kind_rank"], rules))
    band = slot("end_us", window_us).alias("_b")
    squares = lambda rows, *more: rows.groupBy(*scope, *more, band).agg(F.pow(F.count(F.lit(1)).cast("double"), 2).alias("_n")).agg(F.sum("_n")).first()[0] or 0.0
    if squares(heavy, "_dim") > squares(placed):  # two numbers
        return near_pairs(placed, scope, rules.widest())
    left, right = _sides(heavy, scope, ("_dim", "_x", "_rest"), window_us)
    left, right = (side.withColumnsRenamed({"_x": f"_x{k}", "_rest": f"_rest{k}"}) for k, side in ((1, left), (2, right)))
    met = _in_band(left.join(right, [*scope, "_dim", "_band"]), window_us)
    common = met.groupBy(*scope, "left_id", "right_id", "gap_us").agg(F.sum(F.col("_x1") * F.col("_x2")).alias("_dot"), F.first("_rest1").alias("_rest1"), F.first("_rest2").alias("_rest2"))
    bound = F.col("_dot") + F.col("_rest2") * F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("_rest1") * F.col("_rest1"))) + F.col("_rest1")
    return common.filter(bound >= _needed_cosine(rules, F.col("gap_us")) - _SLACK).select(*scope, "left_id", "right_id", "gap_us")


def with_same_author(pairs: DataFrame, people: DataFrame | Callable[[DataFrame], DataFrame], scope: Sequence[str], owned: DataFrame | None = None) -> DataFrame:
    """Add ``same_author`` to pairs of conversations from their long participant table.

    ``owned``: ``(scope..., conv_id)`` of the conversations the requesting user takes part in. Pairs of two such conversations are
    settled by that alone; participants are compared only for the other pairs. ``people`` may be a function that gives the numbers of participants
    ``(scope..., left_id, right_id, _ln, _rn, _common)`` of the pairs it is asked for, so that those of others are never listed.
    """
    scope, ids = list(scope), [*scope, "conv_id"]
    if owned is not None:
        for side in ("left", "right"):
            pairs = pairs.join(owned.select(*scope, F.col("conv_id").alias(f"{side}_id"), F.lit(True).alias(f"_{side}_own")),
                               [*scope, f"{side}_id"], "left")
        both = F.coalesce("_left_own", F.lit(False)) & F.coalesce("_right_own", F.lit(False))
        flagged = pairs.withColumn("_both", both).drop("_left_own", "_right_own")
        settled = flagged.filter("_both").drop("_both").withColumn("same_author", F.lit(True))
        rest = flagged.filter(~F.col("_both")).drop("_both")
        if not callable(people):
            asked = rest.select(*scope, F.explode(F.array("left_id", "right_id")).alias("conv_id")).distinct()
            people = people.join(asked, ids, "left_semi")
        return settled.unionByName(with_same_author(rest, people, scope))
    zero = F.lit(0)
    flag = similarity.same_author(F.coalesce("_common", zero), F.coalesce("_ln", zero), F.coalesce("_rn", zero))
    if callable(people):
        pairs = cut_lineage(pairs)
        return pairs.join(people(pairs), [*scope, "left_id", "right_id"], "left").withColumn("same_author", flag).drop("_ln", "_rn", "_common")
    sizes = people.groupBy(*ids).agg(F.count(F.lit(1)).alias("_n"))
    members = people.select(*ids, "user_id")
    common = (pairs.select(*scope, "left_id", "right_id")
              .join(members.withColumnRenamed("conv_id", "left_id"), [*scope, "left_id"])
              .join(members.withColumnRenamed("conv_id", "right_id"), [*scope, "right_id", "user_id"])
              .groupBy(*scope, "left_id", "right_id").agg(F.count(F.lit(1)).alias("_common")))
    wide = (pairs.join(sizes.withColumnsRenamed({"conv_id": "left_id", "_n": "_ln"}), [*scope, "left_id"], "left")
            .join(sizes.withColumnsRenamed({"conv_id": "right_id", "_n": "_rn"}), [*scope, "right_id"], "left")
            .join(common, [*scope, "left_id", "right_id"], "left"))
    return wide.withColumn("same_author", flag).drop("_ln", "_rn", "_common")


def merge_edges(conv: DataFrame, conv_refs: DataFrame, people: DataFrame | Callable[[DataFrame], DataFrame], scope: Sequence[str], rules: MergeRules = MergeRules(),
                owned: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """Pairs that the rules join, with ``gap_us``, ``similarity``, ``same_author`` and the counter label ``merged_by``.

    ``vectors``: optional ``(scope..., conv_id, embedding)``. A vector alone can lift a pair over a threshold; such pairs are found by
    :func:`close_vector_pairs`. A null vector, and a conversation without one, leave the reference score as it is.
    """
    near = near_pairs(conv, scope, rules.unconditional())
    if vectors is not None:
        near = near.unionByName(close_vector_pairs(conv, vectors, scope, rules))
    near = near.withColumn("similarity", F.lit(None).cast("double"))
    sharing = shared_reference_pairs(conv, conv_refs, scope, rules.widest()).drop("shared")
    pairs = near.unionByName(sharing).groupBy(*scope, "left_id", "right_id", "gap_us").agg(
        F.coalesce(F.max("similarity"), F.lit(0.0)).alias("similarity"))
    if vectors is not None:
        pairs = (pairs.join(vectors.withColumnsRenamed({"conv_id": "left_id", "embedding": "_a"}), [*scope, "left_id"], "left")
                 .join(vectors.withColumnsRenamed({"conv_id": "right_id", "embedding": "_b"}), [*scope, "right_id"], "left")
                 .withColumn("similarity", similarity.hybrid(F.col("similarity"), F.col("_a"), F.col("_b"),
                                                             rules.reference_weight, rules.embedding_weight)).drop("_a", "_b"))
    judged = with_same_author(cut_lineage(pairs) if callable(people) else pairs, people, scope, owned)
    adjacent, near_enough, similar = _rule_columns(rules)
    label = (F.when(adjacent & ~F.col("same_author"), "adjacent")
             .when(near_enough & (F.col("similarity") < rules.same_author_similarity), "proximity")
             .when(F.col("same_author") & (F.col("similarity") < rules.similarity_threshold), "same_author"))
    return judged.filter(adjacent | near_enough | similar).withColumn("merged_by", label)


def _rule_columns(rules: MergeRules) -> tuple[Column, Column, Column]:
    gap, score, same = F.col("gap_us"), F.col("similarity"), F.col("same_author")
    direct = is_direct_channel()
    window = F.when(direct, minutes(rules.direct_minutes)).otherwise(minutes(rules.proximity_minutes))
    least = F.when(direct, rules.direct_similarity).otherwise(rules.proximity_similarity)
    adjacent = gap <= minutes(rules.adjacent_minutes)
    near_enough = same & (gap <= window) & ((least == 0) | (score >= least))
    similar = F.when(same, (gap <= minutes(rules.same_author_minutes)) & (score >= rules.same_author_similarity)).otherwise(
        (gap <= minutes(rules.similarity_minutes)) & (score >= rules.similarity_threshold))
    return adjacent, near_enough, similar


def topic_members(conv: DataFrame, edges: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Map ``(scope..., conv_id) -> topic_id``; the topic is named after its first member in conversation order."""
    labels = connected_components(edges.select(F.col("left_id").alias("a"), F.col("right_id").alias("b")))
    labelled = conv.select(*scope, *ORDER).join(labels.withColumnRenamed("node", "conv_id"), "conv_id", "left").withColumn(
        "_label", F.coalesce("label", "conv_id"))
    heads = labelled.groupBy(*scope, "_label").agg(F.min_by("conv_id", F.struct(*ORDER)).alias("topic_id"))
    return labelled.join(heads, [*scope, "_label"]).select(*scope, "conv_id", "topic_id")


def topic_roll_up(conv: DataFrame, members: DataFrame, scope: Sequence[str]) -> DataFrame:
    """One row per topic. ``end_us`` is the end of the member that starts last; ``max_end_us`` the latest end."""
    return conv.join(members, [*scope, "conv_id"]).groupBy(*scope, "topic_id").agg(
        F.min("start_us").alias("start_us"), F.max_by("end_us", F.struct(*ORDER)).alias("end_us"), F.max("end_us").alias("max_end_us"),
        F.sum("message_count").alias("message_count"), F.sum("user_message_count").alias("user_message_count"),
        F.max(F.col("kind") == "t").alias("has_threads"), F.count(F.lit(1)).alias("conversations"))


def consolidation_statistics(original: DataFrame, bot_map: DataFrame, trivial_map: DataFrame, edges: DataFrame, topics: DataFrame,
                             scope: Sequence[str]) -> DataFrame:
    """Counters per scope. The merge-type counters count qualifying pairs, not merges."""
    scope = list(scope)
    parts = [
        original.groupBy(*scope).agg(F.count(F.lit(1)).alias("original_conversations")),
        bot_map.groupBy(*scope).agg(F.count_if("merged").alias("bots_merged")),
        trivial_map.groupBy(*scope).agg(F.count_if("merged").alias("trivial_merged"),
                                        F.count_if(F.col("cluster_id").isNull()).alias("trivial_dropped")),
        edges.groupBy(*scope).agg(*[F.count_if(F.col("merged_by") == n).alias(f"{n}_merged") for n in ("adjacent", "proximity", "same_author")]),
        topics.groupBy(*scope).agg(F.count(F.lit(1)).alias("consolidated_groups"),
                                   F.sum(F.col("conversations") - 1).alias("reference_groups_merged")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, scope, "left")
    return out.na.fill(0)
