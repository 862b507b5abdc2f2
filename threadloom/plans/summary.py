"""Summaries of all requesting users in one job: collect, cut, merge, describe.

Threads are the only data several users share. Everything about a thread that does not depend on the user, its span, counts,
authors, references, words and first lines, is computed once per ``(thread, period)`` and joined to the users who took part; thread
messages are not copied per user.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window, functions as F

from threadloom.functions import references as refs
from threadloom.functions.predicates import MENTION_CONTEXT, channel_type, has_work_indicator
from threadloom.functions.rendering import in_order, iso_time, line_breaks, message_lines
from threadloom.operators import collection, context, folds, late, links, merging, names, segments, texts, words
from threadloom.operators.ordered import first_n
from threadloom.plans import prompts
from threadloom.session import cut_lineage, stored

OWNER = ["owner_id", "period_no"]
SCOPE = [*OWNER, "channel"]
CONV = [*SCOPE, "conv_id"]
TOPIC = [*SCOPE, "topic_id"]
THREAD = ["period_no", "channel", "thread_us"]
# Attachment fields a prompt line can show.
ATTACHMENT_FIELDS = ("fallback", "text", "title", "author_name", "author_id", "channel_name", "from_url")
Boundaries = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Limits:
    """Numbers and switches of a run. Every cut can be lifted with ``None``; the defaults are those of the original."""

    gap_minutes: float = 60.0
    #: Shorter segments are not cut at topic boundaries.
    least_for_boundaries: int = segments.MIN_MESSAGES_FOR_BOUNDARIES
    mention_context: bool = True
    segment_context: bool = True
    #: Lines of a topic in a prompt of its own and in a batch.
    group_lines: int | None = prompts.GROUP_LINES
    batch_lines: int | None = prompts.BATCH_LINES
    batch_size: int = prompts.BATCH_SIZE
    #: Batches up to this size are asked topic by topic.
    single_up_to: int = prompts.SINGLE_UP_TO
    #: Prompts given to the model function at once.
    call_size: int | None = prompts.CALL_SIZE
    #: Words that name a topic without a model.
    topic_words: int | None = 3
    #: Characters of a conversation that the embedding function gets.
    embed_chars: int | None = texts.EMBED_CHARS


class UserSummaries:
    """Lazy tables of a summary run.

    ``messages`` as in the message table; ``periods``: ``(owner_id, period_no, start_us, end_us, tz)``; ``people``: the user directory;
    ``channels``: channel records with ``user``; ``members``: ``(channel, place, user_id)`` of group channels. ``model``: text model
    function, or none for the built-in summary. ``boundaries``: maps message pairs to decisions, or none for no extra cuts.
    ``rules`` and ``limits``: thresholds, cuts and switches. ``embedder``: maps texts of conversations to vectors, or none; ``vectors``: a
    vector table whose rows of ``embedding_model`` are used again. With either, conversations also merge by what they say;
    ``new_vectors`` are those that the table should take up.
    """

    def __init__(self, messages: DataFrame, periods: DataFrame, people: DataFrame, channels: DataFrame, members: DataFrame, base: str,
                 model: prompts.TextModel | None = None, boundaries: Boundaries | None = None, rules: merging.MergeRules = merging.MergeRules(), limits: Limits = Limits(),
                 embedder: texts.Embedder | None = None, vectors: DataFrame | None = None, embedding_model: str = "default"):
        self.messages, self.periods, self.people, self.channels, self.members = messages, periods, people, channels, members
        self.base, self.model, self.boundaries, self.rules, self.limits = base, model, boundaries, rules, limits
        self.embedder, self.stored, self.embedding_model = embedder, vectors, embedding_model

    # Collection

    @cached_property
    def sent(self) -> DataFrame:
        return cut_lineage(collection.own_messages(self.messages, self.periods))

    @cached_property
    def shared(self) -> DataFrame:
        """Messages of participated threads, once per thread and distinct period."""
        joined = collection.participated_threads(self.messages, self.periods)
        spans = self.periods.select("period_no", "start_us", "end_us").distinct()
        wanted = joined.select(*THREAD).distinct().join(spans, "period_no")
        rows = segments.thread_messages(self.messages).join(wanted, ["channel", "thread_us"]).filter(F.col("ts_us").between(F.col("start_us"), F.col("end_us")))
        return cut_lineage(rows.drop("start_us", "end_us"))

    @cached_property
    def threads(self) -> DataFrame:
        """Participated threads with messages in the period, with the conversation id of each user."""
        joined = collection.participated_threads(self.messages, self.periods).join(self.shared.select(*THREAD).distinct(), THREAD)
        return cut_lineage(joined.withColumn("conv_id", F.concat_ws(":", "owner_id", "period_no", "channel", F.lit("t"), F.col("thread_us").cast("string"))))

    @cached_property
    def activity(self) -> DataFrame:
        return cut_lineage(collection.channel_activity(self.sent, collection.mentions(self.messages, self.periods), self.threads))

    # Conversations

    @cached_property
    def main(self) -> DataFrame:
        """Own channel messages with their conversation id."""
        tagged = segments.gap_segments(segments.main_messages(self.sent), SCOPE, self.limits.gap_minutes)
        name = [F.col(c) for c in SCOPE] + [F.lit("m"), F.col("seg_start_us").cast("string")]
        if self.boundaries is not None:
            ids = [*SCOPE, "seg_no"]
            tagged = cut_lineage(tagged)
            sizes = tagged.groupBy(*ids).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= self.limits.least_for_boundaries)
            pairs = segments.message_pairs(tagged.join(sizes.drop("_n"), ids, "left_semi"), ids)
            tagged = segments.split_at_boundaries(tagged, self.boundaries(pairs), ids)
            name.append(F.col("sub_no").cast("string"))
        return cut_lineage(tagged.withColumn("conv_id", F.concat_ws(":", *name)).drop("seg_no", "seg_start_us", "sub_no", "place"))

    @cached_property
    def context(self) -> DataFrame:
        """Context messages per conversation, without those the conversation has already."""
        positions = stored(context.channel_positions(self.messages).select("channel", "place", "before", "msg_id", "ts_us", "user_id", "text"), "positions")
        zones = self.periods.select("owner_id", "period_no", "tz")
        asked = context.mentioned_in(self.shared, THREAD).withColumn("owner_id", F.col("mentioned"))
        mentions = asked.join(self.threads, [*THREAD, "owner_id"]).join(zones, OWNER)
        earlier = context.look_back(mentions, positions, tz=F.col("tz")).select(*CONV, "thread_us", "context.*", F.lit(MENTION_CONTEXT).alias("subtype"))
        fresh = earlier.join(self.shared.select(*THREAD, "ts_us").distinct(), [*THREAD, "ts_us"], "left_anti").drop("thread_us")
        own = self.main.groupBy(*CONV).agg(F.count(F.lit(1)).alias("message_count"), F.count(F.lit(1)).alias("user_message_count"),
                                           F.min(F.struct("ts_us", "msg_id")).alias("_f")).withColumn("kind", F.lit("m"))
        own = own.select("*", F.col("_f.ts_us").alias("first_us"), F.col("_f.msg_id").alias("first_msg")).drop("_f")
        parts = [part for part, wanted in ((fresh, self.limits.mention_context), (context.short_segment_context(own, positions, CONV), self.limits.segment_context)) if wanted]
        return cut_lineage(parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0] if parts else fresh.limit(0))

    @cached_property
    def original(self) -> DataFrame:
        """Conversation roll-up with context added."""
        main = segments.roll_up(self.main, CONV, "owner_id").withColumn("kind", F.lit("m"))
        own = self.shared.groupBy(*THREAD, F.col("user_id").alias("owner_id")).agg(F.count(F.lit(1)).alias("_own"))
        thread = segments.roll_up(self.shared, THREAD).drop("user_message_count").join(self.threads, THREAD).join(own, [*THREAD, "owner_id"], "left")
        thread = thread.withColumn("user_message_count", F.coalesce("_own", F.lit(0))).withColumn("kind", F.lit("t")).drop("_own", "thread_us")
        added = self.context.groupBy(*CONV).agg(
            F.min("ts_us").alias("_lo"), F.count(F.lit(1)).alias("_n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("_chars"),
            F.max(has_work_indicator()).alias("_work"), F.bool_and(F.col("user_id").isNull()).alias("_bot"))
        rows = main.unionByName(thread).join(added, CONV, "left")
        zero, no = F.lit(0), F.lit(False)
        return cut_lineage(rows.select(
            *CONV, "kind", F.when(F.col("kind") == "t", 0).otherwise(1).alias("kind_rank"), F.least("start_us", "_lo").alias("start_us"), "end_us",
            (F.col("message_count") + F.coalesce("_n", zero)).alias("message_count"), "user_message_count",
            (F.col("is_bot") & F.coalesce("_bot", F.lit(True))).alias("is_bot"), (F.col("chars") + F.coalesce("_chars", zero)).alias("chars"),
            (F.col("has_work") | F.coalesce("_work", no)).alias("has_work")))

    # Merging

    @cached_property
    def bot_map(self) -> DataFrame:
        return cut_lineage(folds.merge_bots(self.original, SCOPE))

    @cached_property
    def trivial_map(self) -> DataFrame:
        return cut_lineage(folds.merge_trivial(cut_lineage(folds.apply_merges(self.original, self.bot_map, SCOPE)), SCOPE))

    @cached_property
    def placed(self) -> DataFrame:
        """``(scope, conv_id, cluster_id)`` of the conversations that were kept."""
        first = self.bot_map.select(*SCOPE, "conv_id", F.col("cluster_id").alias("_mid"))
        second = self.trivial_map.filter(F.col("cluster_id").isNotNull()).select(*SCOPE, F.col("conv_id").alias("_mid"), "cluster_id")
        return cut_lineage(first.join(second, [*SCOPE, "_mid"]).drop("_mid"))

    @cached_property
    def conv(self) -> DataFrame:
        """Conversations after the bot and trivial merges."""
        return cut_lineage(folds.apply_merges(self.original, self.placed, SCOPE))

    @cached_property
    def conv_refs(self) -> DataFrame:
        own = refs.conversation_references(self.main.select(*CONV, "text").unionByName(self.context.select(*CONV, "text")), CONV)
        thread = refs.conversation_references(self.shared, THREAD).join(self.threads, THREAD).select(*CONV, "value", "comparable")
        return cut_lineage(folds.remap(own.unionByName(thread), self.placed, SCOPE).groupBy(*CONV, "value").agg(F.max("comparable").alias("comparable")))

    @cached_property
    def _thread_people(self) -> DataFrame:
        return segments.participants(self.shared, THREAD).drop("first_seen")

    @property
    def _own_authors(self) -> DataFrame:
        """``(scope, conv_id, user_id)`` of channel messages and context, with repeats."""
        return self.main.select(*CONV, "user_id").unionByName(self.context.filter(F.col("user_id").isNotNull()).select(*CONV, "user_id"))

    def _sets(self, threads: DataFrame, ids: list[str], first: str) -> DataFrame:
        """``(ids..., set_id, _threads)`` from ``(ids..., thread_us)``: all that are made of the same threads of a period have one set of participants."""
        grouped = threads.groupBy(*ids).agg(F.array_sort(F.collect_set("thread_us")).alias("_threads"))
        sets = grouped.groupBy("period_no", "channel", "_threads").agg(F.min(F.struct("owner_id", first)).alias("_of"))
        return cut_lineage(grouped.join(sets, ["period_no", "channel", "_threads"]).select(
            *ids, "_threads", F.to_json(F.struct("period_no", "channel", "_of")).alias("set_id")))

    def _people_of(self, sets: DataFrame) -> DataFrame:
        """``(set_id, user_id)`` of the threads of a set; one row per participant."""
        threads = sets.select("period_no", "channel", "set_id", "_threads").distinct().withColumn("thread_us", F.explode("_threads"))
        return cut_lineage(threads.join(self._thread_people, THREAD).select("set_id", "user_id").distinct())

    def common_people(self, pairs: DataFrame) -> DataFrame:
        """Numbers of participants ``(scope, left_id, right_id, _ln, _rn, _common)`` of pairs of merged conversations.

        Participants are those of a set of threads and, apart from them, a few others. Two sets are compared once for all pairs that have them.
        """
        asked = cut_lineage(pairs.select(*SCOPE, F.explode(F.array("left_id", "right_id")).alias("conv_id")).distinct())
        placed = self.placed.join(asked.withColumnRenamed("conv_id", "cluster_id"), [*SCOPE, "cluster_id"], "left_semi")
        sets = self._sets(folds.remap(self.threads.select(*CONV, "thread_us"), placed, SCOPE), CONV, "conv_id")
        people = self._people_of(sets)
        has = asked.join(sets.select(*CONV, "set_id"), CONV, "left")
        others = cut_lineage(folds.remap(self._own_authors, placed, SCOPE).distinct().join(has, CONV).join(people, ["set_id", "user_id"], "left_anti").select(*CONV, "user_id"))
        set_sizes = people.groupBy("set_id").agg(F.count(F.lit(1)).alias("_s"))
        sizes = has.join(set_sizes, "set_id", "left").join(others.groupBy(*CONV).agg(F.count(F.lit(1)).alias("_o")), CONV, "left").select(
            *CONV, "set_id", (F.coalesce("_s", F.lit(0)) + F.coalesce("_o", F.lit(0))).alias("_n"))
        ids = [*SCOPE, "left_id", "right_id"]
        side = lambda rows, k, n: rows.withColumnsRenamed({"conv_id": f"{k}_id", "set_id": f"{k}_set", "_n": n})
        both = cut_lineage(pairs.select(*ids).distinct().join(side(sizes, "left", "_ln"), [*SCOPE, "left_id"]).join(side(sizes, "right", "_rn"), [*SCOPE, "right_id"]))
        named = lambda k: people.withColumnRenamed("set_id", f"{k}_set")
        met = both.select("left_set", "right_set").distinct().join(named("left"), "left_set").join(named("right"), ["right_set", "user_id"]).groupBy("left_set", "right_set").agg(
            F.count(F.lit(1)).alias("_c"))
        left, right = (both.join(others.withColumnRenamed("conv_id", f"{k}_id"), [*SCOPE, f"{k}_id"]) for k in ("left", "right"))
        parts = [both.join(met, ["left_set", "right_set"]).select(*ids, "_c")]
        parts += [some.select(*ids, F.lit(1).cast("long").alias("_c")) for some in (
            left.join(named("right"), ["right_set", "user_id"]), right.join(named("left"), ["left_set", "user_id"]),
            left.join(others.withColumnRenamed("conv_id", "right_id"), [*SCOPE, "right_id", "user_id"]))]
        found = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).groupBy(*ids).agg(F.sum("_c").alias("_common"))
        return both.select(*ids, "_ln", "_rn").join(found, ids, "left")

    @cached_property
    def conv_texts(self) -> DataFrame:
        """The hash of what each merged conversation says, and the part an embedding function gets. A thread that was merged with nothing
        and got no context is read once for all its users."""
        order, keep = ["ts_us", "msg_id"], self.limits.embed_chars
        several = self.placed.groupBy(*SCOPE, "cluster_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
        mixed = self.placed.join(several, [*SCOPE, "cluster_id"], "left_semi").select(*CONV).unionByName(self.context.select(*CONV)).distinct()
        alone = self.threads.join(mixed, CONV, "left_anti").join(self.placed.select(*CONV, "cluster_id"), CONV)
        said = texts.conversation_texts(self.shared.join(alone.select(*THREAD).distinct(), THREAD, "left_semi"), THREAD, order, keep_chars=keep)
        told = said.join(alone.select(*THREAD, "owner_id", "cluster_id"), THREAD).withColumnRenamed("cluster_id", "conv_id").drop("thread_us")
        rows = [part.select(*CONV, *order, "text") for part in (self.main, self.context, self.shared.join(self.threads.join(mixed, CONV, "left_semi"), THREAD))]
        own = texts.conversation_texts(folds.remap(rows[0].unionByName(rows[1]).unionByName(rows[2]), self.placed, SCOPE), CONV, order, keep_chars=keep)
        return cut_lineage(told.select(*own.columns).unionByName(own))

    @cached_property
    def new_vectors(self) -> DataFrame:
        """``(text_hash, embedding)`` made in this run; an embedding is null where the function failed."""
        if self.embedder is None:
            return self._stored.select("text_hash", "embedding").limit(0)
        return cut_lineage(texts.embed_missing(self.conv_texts, self._stored, self.embedding_model, self.embedder, self.limits.call_size))

    @property
    def _stored(self) -> DataFrame:
        if self.stored is not None:
            return self.stored
        return self.messages.sparkSession.createDataFrame([], "text_hash string, model string, embedding array<float>")

    @cached_property
    def conv_vectors(self) -> DataFrame | None:
        """``(scope, conv_id, embedding)`` of conversations with a vector, or none if the run has neither vectors nor a function."""
        if self.embedder is None and self.stored is None:
            return None
        known = self._stored.select("text_hash", "model", "embedding").unionByName(self.new_vectors.withColumn("model", F.lit(self.embedding_model)))
        return cut_lineage(texts.with_vectors(self.conv_texts, known, self.embedding_model).filter(F.col("embedding").isNotNull()).select(*CONV, "embedding"))

    @cached_property
    def edges(self) -> DataFrame:
        wrote = self.original.filter(F.col("user_message_count") > 0).select(*CONV)
        seen = self.context.filter(F.col("user_id") == F.col("owner_id")).select(*CONV)
        owned = folds.remap(wrote.unionByName(seen), self.placed, SCOPE).distinct()
        return cut_lineage(merging.merge_edges(self.conv, self.conv_refs, self.common_people, SCOPE, self.rules, owned, self.conv_vectors))

    @cached_property
    def topic_map(self) -> DataFrame:
        return cut_lineage(merging.topic_members(self.conv, self.edges, SCOPE))

    @cached_property
    def topics(self) -> DataFrame:
        return cut_lineage(merging.topic_roll_up(self.conv, self.topic_map, SCOPE))

    @cached_property
    def statistics(self) -> DataFrame:
        return merging.consolidation_statistics(self.original, self.bot_map, self.trivial_map, self.edges, self.topics, SCOPE)

    # Description

    @cached_property
    def topic_of(self) -> DataFrame:
        """``(scope, conv_id, topic_id)`` from the conversations before merging."""
        return cut_lineage(self.placed.join(self.topic_map.withColumnRenamed("conv_id", "cluster_id"), [*SCOPE, "cluster_id"]).drop("cluster_id"))

    @cached_property
    def topic_sets(self) -> DataFrame:
        """``(topic, set_id)`` of topics with threads: topics that are made of the same threads of a period have one set of participants."""
        return self._sets(self.threads.join(self.topic_of, CONV), TOPIC, "topic_id")

    @cached_property
    def set_people(self) -> DataFrame:
        """``(set_id, user_id)`` of the threads of a set; one row per participant, listed once for all topics of the set."""
        return self._people_of(self.topic_sets)

    @cached_property
    def set_sizes(self) -> DataFrame:
        """How many names the list of a set has, how many characters and how many line breaks."""
        return cut_lineage(names.at_names(self.set_people, self.people).groupBy("set_id").agg(
            F.count(F.lit(1)).alias("_set_n"), F.sum(F.length("at_name")).alias("_set_chars"), F.sum(line_breaks("at_name")).alias("_set_breaks")))

    @cached_property
    def set_lists(self) -> DataFrame:
        """``(set_id, _set)``: the sorted names of each set. Topics only name their set until they are shown."""
        return names.at_names(self.set_people, self.people).groupBy("set_id").agg(F.sort_array(F.collect_list("at_name")).alias("_set"))

    @cached_property
    def topic_lists(self) -> DataFrame:
        """Participants of topics that aren't those of their set of threads, and the set."""
        own = self._own_authors.join(self.topic_of, CONV).select(*TOPIC, "user_id").distinct()
        more = own.join(self.topic_sets.drop("_threads"), TOPIC, "left").join(self.set_people, ["set_id", "user_id"], "left_anti")
        listed = names.at_names(more, self.people).groupBy(*TOPIC).agg(
            F.count(F.lit(1)).alias("_own_n"), F.array_sort(F.collect_list(F.struct("at_name", "user_id"))).alias("_own"))
        return cut_lineage(listed.join(self.topic_sets.drop("_threads"), TOPIC, "full"))

    @cached_property
    def owners_in_sets(self) -> DataFrame:
        """``(topic, _me)``: the owner's names, where the owner is a participant of the topic's set of threads."""
        mine = self.topic_sets.select(*TOPIC, "set_id").join(self.set_people.withColumnRenamed("user_id", "owner_id"), ["set_id", "owner_id"])
        return names.at_names(mine, self.people, "owner_id").groupBy(*TOPIC).agg(F.collect_list("at_name").alias("_me"))

    @cached_property
    def topic_lines(self) -> DataFrame:
        """The lines a prompt can show, rendered: the first ``group_lines`` of a topic."""
        keep = ["msg_id", "ts_us", "user_id", "text", "subtype"]
        extra = [c for c in ("attachments",) if c in self.messages.columns]
        head = first_n(self.shared, THREAD, ["ts_us", "msg_id"], self.limits.group_lines).join(self.threads, THREAD).select(*CONV, *keep, *extra)
        rows = self.main.select(*CONV, *keep, *extra).unionByName(head).unionByName(self.context.select(*CONV, *keep), allowMissingColumns=True)
        placed = cut_lineage(first_n(rows.join(self.topic_of, CONV), TOPIC, ["ts_us", "msg_id", "conv_id"], self.limits.group_lines, "line_no"))
        return cut_lineage(message_lines(self._with_linked(placed), self.people, [*TOPIC, "line_no"]))

    def _with_linked(self, placed: DataFrame) -> DataFrame:
        """Give messages without attachments the messages they link to as attachments."""
        key, missing = [*TOPIC, "line_no"], F.lit(None).cast("string")

        def attachment(item: Column, present: tuple[str, ...]) -> Column:
            return F.struct(*[(item[f] if f in present else missing).alias(f) for f in ATTACHMENT_FIELDS])

        none = F.array().cast(f"array<struct<{','.join(f'{f}:string' for f in ATTACHMENT_FIELDS)}>>")
        if "attachments" in placed.columns:
            present = tuple(placed.schema["attachments"].dataType.elementType.names)
            placed = placed.withColumn("attachments", F.coalesce(F.transform("attachments", lambda a: attachment(a, present)), none))
        else:
            placed = placed.withColumn("attachments", none)
        found = links.linked_messages(placed, self.messages, key, SCOPE, has_attachments=F.size("attachments") > 0)
        linked = found.select(*key, F.struct("at", attachment(F.struct("text", "author_id", "from_url"), ("text", "author_id", "from_url")).alias("a")).alias("_l")).groupBy(*key).agg(
            F.transform(F.array_sort(F.collect_list("_l")), lambda row: row["a"]).alias("_linked"))
        return placed.join(linked, key, "left").withColumn("attachments", F.coalesce("_linked", "attachments")).drop("_linked")

    @cached_property
    def top_words(self) -> DataFrame:
        """The most frequent words per topic, from word counts of its own messages and per thread."""
        def counted(rows: DataFrame, ids: list[str]) -> DataFrame:
            return words.count_words(rows, ids, ["ts_us", "msg_id"])

        said = self.main.select(*CONV, "ts_us", "msg_id", "text").unionByName(self.context.select(*CONV, "ts_us", "msg_id", "text"))
        own = counted(said.join(self.topic_of, CONV).select(*TOPIC, "ts_us", "msg_id", "text"), TOPIC)
        placed = self.threads.select(*CONV, "thread_us").join(self.topic_of, CONV).select(*TOPIC, "thread_us")
        thread = counted(self.shared, THREAD).join(placed, THREAD).select(*own.columns)
        by_topic = own.unionByName(thread).groupBy(*TOPIC, "word").agg(F.sum("n").alias("n"), F.min("first_place").alias("first_place"))
        return first_n(by_topic, TOPIC, [F.desc("n"), "first_place"], self.limits.topic_words).groupBy(*TOPIC).agg(in_order(["rank"], "word").alias("words"))

    @cached_property
    def described(self) -> DataFrame:
        """Topics with everything a prompt or the built-in summary needs; of a channel's name only its parts."""
        shared_refs = self.conv_refs.join(self.topic_map, CONV).select(*TOPIC, "value").distinct().groupBy(*TOPIC).agg(
            F.array_sort(F.collect_list("value")).alias("shared_refs"))
        # Only numbers here: the lists of a large thread are long, and not all sinks show them.
        people = self.topic_lists.join(self.set_sizes.select("set_id", "_set_n"), "set_id", "left").select(
            *TOPIC, (F.coalesce("_set_n", F.lit(0)) + F.coalesce("_own_n", F.lit(0))).alias("participant_count"))
        members = self.conv.select(*CONV, "start_us", "kind_rank").join(self.topic_map, CONV)
        urls = self.conv.select("conv_id", links.permalink(self.base, ts_us="start_us").alias("link"))
        linked = links.topic_links(members, urls, TOPIC, ["start_us", "kind_rank", "conv_id"])
        marked = self.context.select(*CONV).distinct().join(self.topic_of, CONV).select(*TOPIC, F.lit(True).alias("has_context")).distinct()
        out = self.topics.join(shared_refs, TOPIC, "left").join(people, TOPIC, "left").join(linked, TOPIC, "left").join(marked, TOPIC, "left")
        out = out.join(self.channel_parts[0], ["owner_id", "channel"], "left").join(self.periods.select(*OWNER, "tz"), OWNER)
        out = out.join(self.people.select(F.col("user_id").alias("owner_id"), "shown_name"), "owner_id", "left")
        none = F.array().cast("array<string>")
        return cut_lineage(
            out.withColumn("owner_name", F.coalesce("shown_name", "owner_id")).withColumn("has_context", F.coalesce("has_context", F.lit(False)))
            .withColumn("participant_count", F.coalesce("participant_count", F.lit(0)))
            .withColumn("shared_refs", F.coalesce("shared_refs", none))
            .withColumn("start_text", iso_time(F.col("start_us"), F.col("tz"))).withColumn("end_text", iso_time(F.col("end_us"), F.col("tz"))).drop("shown_name"))

    @cached_property
    def channel_parts(self) -> tuple[DataFrame, DataFrame]:
        """Parts of the channels' names for their owners, and the texts of group channels that long names are cut from."""
        parts, texts = names.channel_name_parts(self.activity, self.channels, self.members, self.people)
        return cut_lineage(parts), cut_lineage(texts)

    @property
    def channel_names(self) -> DataFrame:
        return names.with_channel_names(*self.channel_parts).select("owner_id", "channel", "channel_name")

    def with_channel_names(self, rows: DataFrame) -> DataFrame:
        """Put names together from their parts. Names of group channels are long, so this is the last step before they are shown."""
        return names.with_channel_names(rows, self.channel_parts[1])

    def prompt_rows(self, lines: int | None = None) -> DataFrame:
        shown = self.topic_lines if lines is None else self.topic_lines.filter(F.col("line_no") <= lines)
        texts = shown.groupBy(*TOPIC).agg(F.array_join(in_order(["line_no"], "line"), "\n").alias("messages_text"))
        return self.described.join(texts, TOPIC)

    @cached_property
    def batches(self) -> DataFrame:
        return cut_lineage(prompts.topic_batches(self.topics.select(*TOPIC, "start_us"), SCOPE, ["start_us", "topic_id"],
                                                 self.limits.batch_size, self.limits.single_up_to))

    @cached_property
    def answers(self) -> DataFrame | None:
        """``(topic, summary)`` from the model: batches first, then one by one what a batch did not give."""
        if self.model is None:
            return None
        rows = self.prompt_rows(self.limits.batch_lines).join(self.batches.select(*TOPIC, "batch_no", "place_in_batch", "single"), TOPIC)
        # Prompts and answers can be long, so they go through the model and are taken apart in the task that made them.
        asked = prompts.batch_prompts(rows.filter(~F.col("single")), SCOPE, self.channel_parts[1])
        told = prompts.run_model(asked, self.model, call_size=self.limits.call_size, keep=False)
        found = told.select(*SCOPE, "topics", F.posexplode(prompts.parse_summaries("response", F.col("asked"))).alias("_at", "summary"))
        here = F.array_distinct(F.filter("topics", lambda t: t["place"] == F.col("_at") + 1))
        batched = cut_lineage(found.select(*SCOPE, F.explode(here).alias("_t"), "summary").select(*SCOPE, "_t.topic_id", "summary"))
        left = self.with_channel_names(self.prompt_rows().join(batched, TOPIC, "left_anti")).withColumn("channel_name", F.coalesce("channel_name", "channel"))
        one = prompts.run_model(left.select(*TOPIC, prompts.group_prompt().alias("prompt")), self.model, call_size=self.limits.call_size, keep=False)
        return batched.unionByName(cut_lineage(one.select(*TOPIC, prompts.parse_summary("response").alias("summary")).filter(F.col("summary").isNotNull())))

    @cached_property
    def topic_facts(self) -> DataFrame:
        """One described topic per row, by the model or, where it gave nothing, by the built-in summary; in place of ``participants`` it has
        ``people``: the set of threads whose participants they are, the names to add and to leave out, how many names and line breaks they have."""
        rows = self.described.join(self.top_words, TOPIC, "left").join(self.topic_lists.drop("_own_n"), TOPIC, "left").join(self.set_sizes, "set_id", "left")
        none, nobody = F.array().cast("array<string>"), F.array().cast("array<struct<at_name:string,user_id:string>>")
        top, out = F.coalesce("words", none), none
        if self.answers is None:
            rows = rows.withColumn("summary", F.lit(None).cast(f"struct<{prompts.SUMMARY_FIELDS.replace(' ', ':').replace(',:', ',')}>"))
        else:
            rows = rows.join(self.answers, TOPIC, "left").join(self.owners_in_sets, TOPIC, "left")
            # The requesting user is left out of a model's summary, which is told from their side, and kept in the built-in one.
            out = F.when(F.col("summary").isNotNull(), F.coalesce("_me", none)).otherwise(none)
        told = F.col("summary").isNotNull()
        pick = lambda name, fallback: F.when(told, F.col(f"summary.{name}")).otherwise(fallback)
        own = F.transform(F.filter(F.coalesce("_own", nobody), lambda p: ~told | (p["user_id"] != F.col("owner_id"))), lambda p: p["at_name"])
        breaks = lambda listed: line_breaks(F.array_join(listed, ""))
        people = F.struct("set_id", own.alias("own"), out.alias("out"), (F.coalesce("_set_n", F.lit(0)) + F.size(own) - F.size(out)).alias("n"),
                          (F.coalesce("_set_breaks", F.lit(0)) + breaks(own) - breaks(out)).alias("breaks"))
        return rows.select(
            *TOPIC, "tz", pick("narrative", prompts.fallback_narrative(top, F.col("participant_count"))).alias("narrative_summary"), "start_us", "end_us",
            F.col("start_text").alias("start_time"), F.col("end_text").alias("end_time"), "message_count", F.col("user_message_count").alias("user_messages"),
            people.alias("people"), pick("keyEvents", none).alias("key_events"),
            pick("references", F.col("shared_refs")).alias("references"), F.col("summary.outcome").alias("outcome"),
            F.when(told & (F.size("summary.nextActions") > 0), F.col("summary.nextActions")).alias("next_actions"),
            pick("timesheetEntry", prompts.fallback_entry(top)).alias("timesheet_entry"), F.col("primary_link").alias("slack_link"),
            F.when(F.size("links") > 1, F.col("links")).alias("slack_links"), F.when(F.col("conversations") > 1, F.col("conversations")).alias("segments_merged"))

    @cached_property
    def topic_summaries(self) -> DataFrame:
        """:attr:`topic_facts` with ``participants``."""
        rows = self.topic_facts.withColumn("set_id", F.col("people.set_id")).join(self.set_lists, "set_id", "left")
        return rows.select(*[participants(F.col("_set"), F.col("people")).alias("participants") if c == "people" else c for c in self.topic_facts.columns])

    @cached_property
    def long_lists(self) -> DataFrame:
        """What summaries of a period name: lists of participants, and texts of group channels under ``#channel``."""
        sets = self.topic_sets.select("period_no", "set_id").distinct().join(self.set_lists, "set_id").join(self.set_sizes, "set_id")
        texts = self.channel_facts.filter(F.col("_cuts").isNotNull()).select("period_no", "channel").distinct().join(self.channel_parts[1], "channel")
        return cut_lineage(sets.select("period_no", F.col("set_id").alias("ref"), F.col("_set_chars").alias("size"), F.col("_set").alias("items")).unionByName(
            texts.select("period_no", F.concat(F.lit("#"), "channel").alias("ref"), F.length("_members").cast("long").alias("size"), F.array("_members").alias("items"))))

    def with_participants(self, rows: DataFrame) -> DataFrame:
        """Rows of :attr:`topic_facts` with ``participants``, as :attr:`topic_summaries` has them, without moving the lists with the rows."""
        named = rows.withColumn("refs", F.array_compact(F.array("people.set_id")))
        return late.with_lists(cut_lineage(named), self.long_lists, ["period_no"]).withColumn("participants", participants(F.get("lists", F.lit(0)), F.col("people"))).drop("refs", "lists")

    @cached_property
    def channel_facts(self) -> DataFrame:
        """Kept channels with the parts of their names, counts and consolidation counters; ``place`` ranks them by activity."""
        kept = collection.kept_channels(self.activity)
        busy = F.desc(F.col("messages_sent") + F.col("mentions_received") + F.col("threads"))
        # One row per channel of a user, so this window holds the channels of one person.
        ranked = kept.withColumn("place", F.row_number().over(Window.partitionBy(*OWNER).orderBy(busy, "channel")))
        kinds = self.channels.select(F.col("id").alias("channel"), channel_type().alias("channel_type"))
        return (ranked.join(self.channel_parts[0], ["owner_id", "channel"], "left").join(kinds, "channel", "left")
                .join(self.statistics, SCOPE, "left").withColumn("channel_type", F.coalesce("channel_type", F.lit("public_channel"))))

    @property
    def channel_summaries(self) -> DataFrame:
        """:attr:`channel_facts` with names."""
        return self.with_channel_names(self.channel_facts)

    @cached_property
    def totals(self) -> DataFrame:
        given = collection.reactions_given(self.messages, self.periods) if "reactions" in self.messages.columns else (
            self.activity.select(*OWNER).limit(0))
        return collection.totals(self.activity, given)


def condense(topics: DataFrame, key_events: int | None = 3) -> DataFrame:
    """The short form: at most so many key events (``None``: all), no list of links, no number of merged segments."""
    kept = F.col("key_events") if key_events is None else F.slice("key_events", 1, key_events)
    return topics.withColumn("key_events", kept).drop("slack_links", "segments_merged")


def participants(listed: Column, people: Column) -> Column:
    """Sorted names of participants from the list of their set of threads and the ``people`` of a topic."""
    none = F.array().cast("array<string>")

    def without(some: Column, name: Column) -> Column:
        at = F.array_position(some, name).cast("int")
        return F.concat(F.slice(some, F.lit(1), at - 1), F.slice(some, at + 1, F.size(some) - at))

    kept = F.when(F.size(people["out"]) > 0, F.aggregate(people["out"], F.coalesce(listed, none), without)).otherwise(F.coalesce(listed, none))
    return F.when(F.size(people["own"]) > 0, F.sort_array(F.concat(kept, people["own"]))).otherwise(kept)


def summary_documents(run: UserSummaries, generated_at: Column) -> DataFrame:
    """One nested document per user and period, ready for ``write.json``.

    Documents are put together with the names of their long lists, so only short rows are gathered; each then gets its lists in the task that gives it out.
    """
    topics = run.topic_facts
    fields = [c for c in topics.columns if c not in (*TOPIC, "tz", "start_us", "end_us")]
    nested = topics.groupBy(*SCOPE).agg(F.transform(F.array_sort(F.collect_list(F.struct("start_us", "topic_id", F.struct(*fields).alias("t")))), lambda r: r["t"]).alias("topics"))
    stats = {"original_segments": "original_conversations", "consolidated_topics": "consolidated_groups", "bot_messages_merged": "bots_merged",
             "trivial_messages_merged": "trivial_merged", "adjacent_merged": "adjacent_merged", "proximity_merged": "proximity_merged",
             "same_author_merged": "same_author_merged"}
    empty = F.array().cast(nested.schema["topics"].dataType)
    channel = F.struct(
        F.col("channel").alias("channel_id"), *names.NAME_PARTS, "channel_type", F.struct("messages_sent", "mentions_received", "threads").alias("interactions"),
        F.coalesce("topics", empty).alias("topics"), F.struct(*[F.coalesce(v, F.lit(0)).alias(k) for k, v in stats.items()]).alias("consolidation_stats"))
    listed = run.channel_facts.join(nested, SCOPE, "left").groupBy(*OWNER).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", channel.alias("c")))), lambda r: r["c"]).alias("channels"))
    spans = run.periods.select(*OWNER, "start_us", "end_us", "tz")
    counts = ["total_channels", "total_messages", "mentions_received", "threads_participated", "reactions_given"]
    rows = spans.join(run.totals, OWNER, "left").join(listed, OWNER, "left").select(
        *OWNER, "start_us", "end_us", "tz", *counts, F.coalesce("channels", F.array().cast(listed.schema["channels"].dataType)).alias("channels"))
    text_of = lambda c: F.concat(F.lit("#"), c["channel_id"])
    refs = F.concat(F.flatten(F.transform("channels", lambda c: F.transform(c["topics"], lambda t: t["people"]["set_id"]))),
                    F.transform(F.filter("channels", lambda c: c["_cuts"].isNotNull()), text_of))
    full = late.with_lists(cut_lineage(rows.withColumn("refs", F.array_distinct(F.array_compact(refs)))), run.long_lists, ["period_no"])
    found = lambda ref: F.get("lists", (F.array_position("refs", ref) - 1).cast("int"))

    def shown_topic(t: Column) -> Column:
        return F.struct(*[participants(found(t["people"]["set_id"]), t["people"]).alias("participants") if f == "people" else t[f].alias(f) for f in fields])

    def shown_channel(c: Column) -> Column:
        name = names.channel_name(F.get(found(text_of(c)), F.lit(0)), lambda n: c[n])
        return F.struct(c["channel_id"].alias("channel_id"), name.alias("channel_name"), c["channel_type"].alias("channel_type"), c["interactions"].alias("interactions"),
                        F.transform(c["topics"], shown_topic).alias("topics"), c["consolidation_stats"].alias("consolidation_stats"))

    return full.select(
        *OWNER, F.struct(generated_at.alias("generated_at"), F.lit("2.0.0").alias("schema_version"), F.struct(
            F.col("owner_id").alias("user_id"), iso_time(F.col("start_us"), F.col("tz")).alias("period_start"), iso_time(F.col("end_us"), F.col("tz")).alias("period_end"),
            F.col("tz").alias("timezone")).alias("request")).alias("metadata"),
        F.struct(*[F.coalesce(c, F.lit(0)).alias(c) for c in counts]).alias("summary"), F.transform("channels", shown_channel).alias("channels"))


def write_documents(documents: DataFrame, path: str) -> None:
    documents.write.mode("overwrite").partitionBy("owner_id", "period_no").json(path)
