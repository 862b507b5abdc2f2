"""N-gram Jaccard join by T-occurrence search with DivideSkip (operator 3).

Which documents share at least ``percent`` of their word shingles? No step looks at all pairs.

1. Shingle counts over all documents, exchanged as packed blocks, give the shingles of more than ``COMMON`` documents.
2. Documents with equal sets are one class. Every class files a prefix of its set: as many shingles, common ones last, that two
   linked sets must share one. Lists of one class are dropped, equal lists kept once.
3. Inside a list, pairs are tested by sizes and parity bitmaps, which bound the overlap from above and never lose a link. A list
   gives a spanning forest of the pairs that pass; its components over all lists are the blocks in which links can lie.
4. Each class goes to its block with its whole set once. There the block's inverted index is searched for every class: short lists
   are merged, the longest ones probed by binary search (DivideSkip), and overlaps counted exactly. A block gives a spanning forest
   of its links.

A list or block too large for one task is dealt out by a hash of the member, so that every task joins what it has; what is still
apart is dealt out again by other hashes, and in the end what lies outside the largest component meets all others (:func:`_forest`).
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from threadloom.llm.common import small_side
from threadloom.llm.components import components
from threadloom.llm.grams import SPACED, Words, blocks, chained, give_back, spread, utf8
from threadloom.session import cut_lineage

#: The measure of ``op3_near_copies``; other callers give their own.
SHINGLE = 4
PERCENT = 85
#: A shingle in more documents than this is common and comes last in every prefix.
COMMON = 32
#: So many common shingles are told to every task at most (12 bytes each); the threshold rises until they fit. Which shingles count
#: as common changes the length of lists, never the result.
MOST_COMMON = 1 << 20
DOCS_PER_RANGE = 4_096
#: Shingles a task holds before it gives them out by range, and at least so many for each range.
FLUSH, FLUSH_PER_RANGE = 500_000, 64
#: Shingles, 8 bytes each, of the classes that a task searches; its arrays need some ten times that.
SHINGLES_PER_TASK = 1 << 20
#: Members of a list that a task pairs.
MEMBERS_PER_TASK = 1 << 13
#: Times that a large list or block is dealt out by hashes before what is left apart meets all others.
ROUNDS = 3
BROADCAST_MEMBERS = 200_000
#: Binary searches made at once.
PROBES = 1 << 20


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted hashes of distinct ``k``-word shingles of each text; of fewer words, their sequence as one; of none, empty."""
    words = Words(data, offsets, SPACED)
    grams, first, out = words.grams(k), words.first.tolist(), []
    for a, b in zip(first, first[1:]):
        found = grams[a:b - k + 1].copy() if b - a >= k else chained(words.hash[a:b], b - a)[:1]
        found.sort()
        out.append(found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) > 1 else found)
    return out


def prefix_size(n: int, percent: int = PERCENT) -> int:
    """Of two sets that overlap in at least ``percent`` of either, each has one of the other's first so many elements."""
    return n - -(-n * percent // 100) + 1 if n else 0


def _flat(column: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    for a, _, data, offsets in blocks(*utf8(column)):
        yield a, shingle_sets(data, offsets, k)


def _range_of(tokens: np.ndarray, ranges: int) -> np.ndarray:
    return ((tokens >> np.uint64(32)) % np.uint64(ranges)).astype(np.uint32)


def _dealt(which: np.ndarray, ranges: int, *columns: np.ndarray) -> Iterator[tuple]:
    """Values packed by range."""
    order = np.argsort(which, kind="stable")
    ends = np.cumsum(np.bincount(which, minlength=ranges)).tolist()
    sorted_ = [c[order] for c in columns]
    for r, (a, b) in enumerate(zip([0, *ends], ends)):
        if b > a:
            yield (r, *(c[a:b].tobytes() for c in sorted_))


def common_shingles(docs: DataFrame, ranges: int, k: int = SHINGLE, common: int = COMMON, most: int = MOST_COMMON) -> tuple[np.ndarray, np.ndarray]:
    """Keys, ``range << 32 | low half of the hash``, and document counts of common shingles, by key."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def give() -> pa.RecordBatch:
            tokens = np.concatenate(held)
            rows = list(_dealt(_range_of(tokens, ranges), ranges, tokens.astype(np.uint32)))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary()))], names=["range", "tokens"])

        for batch in batches:
            for _, sets in _flat(batch.column(0), k):
                held += [s for s in sets if len(s)]
                count += sum(map(len, sets))
                if count >= max(FLUSH, FLUSH_PER_RANGE * ranges):
                    yield give()
                    held, count = [], 0
        if held:
            yield give()
        give_back()

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        tokens = np.frombuffer(b"".join(pdf["tokens"]), np.uint32).copy()
        tokens.sort()
        edges = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1], [True]]))
        n = np.diff(edges)
        return pd.DataFrame({"key": (int(pdf["range"].iloc[0]) << 32) + tokens[edges[:-1][n > common]].astype(np.int64), "n": n[n > common]})

    found = cut_lineage(docs.select("text").mapInArrow(deal, "range int, tokens binary").groupBy("range").applyInPandas(count, "key long, n long"))
    steps = sorted((row[0], row[1]) for row in found.groupBy(F.floor(F.log2("n") * 4)).count().collect())  # four rows per doubling
    least, left = steps[0][0] if steps else 0, sum(n for _, n in steps)
    for step, n in steps:
        if left <= most:
            break
        least, left = step + 1, left - n
    kept = found.filter(F.floor(F.log2("n") * 4) >= least).toPandas().sort_values("key")
    return kept["key"].to_numpy(np.uint64), kept["n"].to_numpy(np.uint32)


def _bitmap(tokens: np.ndarray) -> bytes:
    """Parity of the elements that fall on each bit; half as many bits as elements or more, a power of two."""
    bits = 1 << max(6, (max(1, len(tokens) - 1) // 2).bit_length())
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def prefixes(docs: DataFrame, ranges: int, common: tuple[np.ndarray, np.ndarray], k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, text_mark, n, mark, prefix, bitmap)`` of every document; ``mark`` is equal for equal sets."""
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = sent.value
        perhaps = np.zeros(1 << 20, bool)
        perhaps[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        for batch in batches:
            for a, sets in _flat(batch.column(2), k):
                out, tokens = [], np.concatenate(sets)
                rank = np.zeros(len(tokens), np.uint32)
                some = np.flatnonzero(perhaps[(tokens & np.uint64((1 << 20) - 1)).astype(np.int64)])
                if len(some):
                    wanted = (_range_of(tokens[some], ranges).astype(np.uint64) << np.uint64(32)) | (tokens[some] & np.uint64(0xFFFFFFFF))
                    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                    hit = keys[at] == wanted
                    rank[some[hit]] = counts[at[hit]]
                mixed, place = spread(tokens), 0
                for found in sets:
                    n, p = len(found), prefix_size(len(found), percent)
                    own = rank[place:place + n]
                    first = found[np.argsort(own, kind="stable")[:p]] if own.any() else found[:p]
                    mark = int(mixed[place:place + n].sum(dtype=np.uint64)).to_bytes(8, "little") + int(np.bitwise_xor.reduce(mixed[place:place + n]) if n else 0).to_bytes(8, "little")
                    out.append((n, mark + n.to_bytes(4, "little"), first.tobytes(), _bitmap(found)))
                    place += n
                columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, len(sets)).columns[:2], *columns], names=["doc_id", "text_mark", "n", "mark", "prefix", "bitmap"])
        give_back()

    return docs.select("doc_id", "text_mark", "text").mapInArrow(run, "doc_id long, text_mark long, n long, mark binary, prefix binary, bitmap binary")


def shared_lists(classes: DataFrame, ranges: int) -> DataFrame:
    """``(list, rep)``: members of prefix lists of two classes or more; lists with the same members are one."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = batch.column(1).to_pylist()
            tokens = np.frombuffer(b"".join(packed), np.uint64)
            reps = np.repeat(np.array(batch.column(0).to_pylist(), np.int64), [len(p) // 8 for p in packed])
            rows = list(_dealt(_range_of(tokens, ranges), ranges, tokens, reps))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["range", "tokens", "reps"])

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        tokens, reps = np.frombuffer(b"".join(pdf["tokens"]), np.uint64), np.frombuffer(b"".join(pdf["reps"]), np.int64)
        order = np.argsort(tokens, kind="stable")
        tokens, reps = tokens[order], reps[order]
        edges = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1], [True]]))
        size = np.diff(edges)
        marks = np.add.reduceat(spread(reps.astype(np.uint64) + np.uint64(1)), edges[:-1])
        marks = np.where(size > 1, spread(marks + size.astype(np.uint64)), 0)
        _, one = np.unique(marks, return_index=True)
        one = one[size[one] > 1]
        at = np.repeat(edges[:-1][one] - np.concatenate([[0], np.cumsum(size[one])])[:-1], size[one]) + np.arange(size[one].sum())
        return pd.DataFrame({"list": np.repeat(marks[one], size[one]).astype(np.int64), "rep": reps[at]})

    return classes.select("rep", "prefix").mapInArrow(deal, "range int, tokens binary, reps binary").groupBy("range").applyInPandas(gather, "list long, rep long").distinct()


def _grouped(rows: DataFrame, keys: list[str], work, columns: list[str], schema: str, names: list[str], types: list[pa.DataType]) -> DataFrame:
    """Run ``work`` on the rows of each key, as lists of the columns, read as a stream of sorted rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            out: list[tuple] = []
            for *here, row in zip(*[batch.column(i).to_pylist() for i in range(len(keys))], zip(*[c.to_pylist() for c in batch.columns[len(keys):]])):
                if here != key:
                    if len(held) > 1:
                        out += work(held)
                    key, held = here, []
                held.append(row)
            yield made(out)
        yield made(work(held) if len(held) > 1 else [])
        give_back()

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(names), types)], names=names)

    return rows.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _folded(words: np.ndarray, size: int) -> np.ndarray:
    while len(words) > size:
        half = len(words) // 2
        words = words[:half] ^ words[half:]
    return words


class _Joined:
    """Labels of members, equal for those that are joined; a join renames the smaller side."""

    def __init__(self, known: list[int]):
        _, self.label = np.unique(np.array(known, np.int64), return_inverse=True)
        self.members: list[list[int]] = [[] for _ in range(int(self.label.max()) + 1)]
        for i, x in enumerate(self.label.tolist()):
            self.members[x].append(i)

    def join(self, i: int, j: int) -> bool:
        """Whether they were apart."""
        a, b = int(self.label[i]), int(self.label[j])
        if a == b:
            return False
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        self.label[self.members[b]] = a
        self.members[a] += self.members[b]
        self.members[b] = []
        return True


def may_link(members: list[tuple], percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of ``(rep, n, bitmap[, label])`` that sizes and bitmaps don't rule out.

    Members of equal labels count as joined already; without labels all are apart.
    """
    members.sort(key=lambda m: (m[1], m[0]))
    sizes = np.array([m[1] for m in members])
    maps = [np.frombuffer(m[2], np.uint64) for m in members]
    width = np.array([len(m) for m in maps])
    joined, edges = _Joined([m[3] if len(m) > 3 else m[0] for m in members]), []
    label = joined.label
    folded: dict[int, np.ndarray] = {}
    for i in range(len(members) - 1):
        n = int(sizes[i])
        upto = int(np.searchsorted(sizes, n * 100 // percent, "right"))
        others = i + 1 + np.flatnonzero(label[i + 1:upto] != label[i])
        if not len(others):
            continue
        w = len(maps[i])
        if w not in folded:
            wide = np.flatnonzero((width == w) | (width == 2 * w))
            table = np.zeros((len(members), w), np.uint64)
            for j in wide.tolist():
                table[j] = _folded(maps[j], w)
            folded = {w: table}
        apart = np.bitwise_count(folded[w][others] ^ folded[w][i]).sum(1, dtype=np.int64)
        # With overlap o: apart <= n + m - 2 o, and a link needs 100 o >= percent (n + m - o).
        overlap = (n + sizes[others] - apart) // 2
        for j in others[overlap * (100 + percent) >= percent * (n + sizes[others])].tolist():
            if joined.join(i, j):
                edges.append((members[i][0], members[j][0]))
    return edges


def links(members: list[tuple], percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the linked pairs of ``(rep, set[, label])``, by DivideSkip over an inverted index of the members.

    Sets come in order of size. Of a set x and a later y a link takes an overlap of ``t(x, y) >= t(x, x)``. The ``l`` longest lists of x
    are set aside; then y is at least ``t(x, y) - l`` times in the others, which are merged. What passes is looked up in the long
    lists by binary search, all of it at once. Members of equal labels count as joined already; without labels all are apart.
    """
    members.sort(key=lambda m: (len(m[1]), m[0]))
    sets = [np.frombuffer(m[1], np.uint64) for m in members]
    sizes, count = np.array([len(s) for s in sets]), len(sets)
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(count), sizes)
    order = np.argsort(tokens, kind="stable")  # lists keep members in order
    tokens, owner = tokens[order], owner[order]
    keys, start, which = np.unique(tokens, return_index=True, return_inverse=True)
    stop = np.append(start[1:], len(tokens))
    postings = which * count + owner  # sorted: list by list, member by member
    joined, edges = _Joined([m[2] if len(m) > 2 else m[0] for m in members]), []
    label = joined.label
    for i, found in enumerate(sets[:-1]):
        n = int(sizes[i])
        upto = int(np.searchsorted(sizes, n * 100 // percent, "right"))
        if not (label[i + 1:upto] != label[i]).any():
            continue
        lists = np.searchsorted(keys, found)
        length = stop[lists] - start[lists]
        need = -(-percent * (n + sizes[i + 1:upto]) // (100 + percent))
        longest = int(length.max())
        aside = min(int(need[0]) - 1, int(need[0] / (0.0085 * math.log2(longest + 1) + 1))) if longest > 8 else 0
        by_length = np.argsort(length, kind="stable")
        short, long_ = lists[by_length[:n - aside]], lists[by_length[n - aside:]]
        width = stop[short] - start[short]
        at = np.repeat(start[short] - np.concatenate([[0], np.cumsum(width)])[:-1], width) + np.arange(width.sum())
        times = np.bincount(owner[at], minlength=count)[i + 1:upto]
        others = np.flatnonzero((times >= need - aside) & (label[i + 1:upto] != label[i]))
        if not len(others):
            continue
        overlap = times[others]
        for a in range(0, len(others) if len(long_) else 0, step := max(1, PROBES // max(1, len(long_)))):
            asked = (long_[:, None] * count + (others[a:a + step] + i + 1)).ravel()
            places = np.minimum(np.searchsorted(postings, asked), len(postings) - 1)
            overlap[a:a + step] += (postings[places] == asked).reshape(len(long_), -1).sum(0)
        for j in (others[overlap >= need[others]] + i + 1).tolist():
            if joined.join(i, j):
                edges.append((members[i][0], members[j][0]))
    return edges


def near_copies(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id, text_mark, stays)``, one row per row of ``docs``; linked are documents that share at least
    ``percent`` of their distinct ``shingle``-word shingles.

    Null and empty texts have no shingles and are linked with nothing, each its own component. ``component_id`` is the smallest
    ``doc_id`` reachable by links, through equal texts too. Ids must be integers. Rows that share one are documents of their own, told
    apart by ``text_mark``, the ``xxhash64`` of the text; ``stays`` marks the rows with the smallest id and mark of each component, of equal rows all. A null
    ``doc_id`` comes first: its row takes part, under the smallest long, and a component with it is named null. An empty table gives
    no rows; other columns are not used.
    """
    least = F.lit(-(1 << 63))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), least).alias("doc_id"), F.xxhash64(text).alias("text_mark"), text.alias("text"))
    ranges = max(8, math.ceil(docs.count() / DOCS_PER_RANGE))
    told = cut_lineage(prefixes(rows, ranges, common_shingles(rows, ranges, shingle), shingle, percent))
    # A class has a number of its own, and the text of its first document stands for it.
    classes = cut_lineage(told.filter("n > 0").groupBy("mark").agg(
        F.min(F.struct("doc_id", "text_mark")).alias("first"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bitmap").alias("bitmap")).withColumn(
        "rep", F.monotonically_increasing_id()))

    lists = cut_lineage(shared_lists(classes, ranges).select(F.col("list").alias("group"), "rep", F.lit(1).cast("long").alias("weight")))
    described = classes.select("rep", "n", "bitmap")
    two = "a long, b long", ["a", "b"], [pa.int64(), pa.int64()]
    perhaps = _forest(lists, MEMBERS_PER_TASK, lambda dealt: _grouped(
        dealt.join(described, "rep"), ["group", "part"], functools.partial(may_link, percent=percent), ["rep", "n", "bitmap", "label"], *two))
    placed = components(perhaps).select(F.col("node").alias("rep"), F.col("label").alias("group"))
    members = cut_lineage(placed.join(classes.select("rep", F.col("n").alias("weight")), "rep").select("group", "rep", "weight"))
    firsts = classes.select("rep", "first.doc_id", "first.text_mark")
    linked = _forest(members, SHINGLES_PER_TASK, lambda dealt: _grouped(
        _with_sets(rows, dealt, firsts, shingle), ["group", "part"], functools.partial(links, percent=percent), ["rep", "set", "label"], *two))
    placed = cut_lineage(components(linked).select(F.col("node").alias("rep"), "label").join(classes.select("rep", "mark", "first"), "rep").select("label", "mark", "first"))
    smallest = placed.groupBy("label").agg(F.min("first").alias("of"))
    named = placed.join(smallest, "label").select("mark", "of")
    alone = classes.select("mark", "first").join(named, "mark", "left").select("mark", F.coalesce("of", "first").alias("of"))
    out = told.select("doc_id", "text_mark", "mark", "n").join(alone, "mark", "left").select(
        F.nullif(F.col("doc_id"), least).alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif(F.coalesce("of.doc_id", "doc_id"), least).alias("component_id"), "text_mark",
        (F.col("of").isNull() | (F.col("of") == F.struct("doc_id", "text_mark"))).alias("stays"))
    return out


def _forest(members: DataFrame, capacity: int, within) -> DataFrame:
    """Spanning edges ``(a, b)`` of all groups of ``members (group, rep, weight)``.

    ``within`` takes ``(group, part, rep, label)`` and gives spanning edges of the pairs it finds in each part; members of equal labels
    are joined already. A group of more than ``capacity`` is dealt out once over its parts by a hash of the member. Only groups with
    members still apart are dealt again, by another hash. After ``ROUNDS`` times the members outside of the group's largest component,
    in blocks, meet all members, so every pair that is apart is looked at, and no pair inside the largest component is.
    """
    def number(total: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil(total / capacity)).cast("int")

    def mixed(of: str, turn: int) -> Column:
        return F.pmod(F.xxhash64("rep", F.lit(turn)), of)

    sizes = members.groupBy("group").agg(F.sum("weight").alias("_total")).filter(F.col("_total") > capacity)
    large = cut_lineage(sizes.select("group", number(F.col("_total")).alias("_parts")))
    parts = members.join(small_side(large, BROADCAST_MEMBERS), "group", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    found = within(parts.select("group", mixed("_parts", 0).alias("part"), "rep", F.col("rep").alias("label")))
    if large.isEmpty():
        return found
    found, open_ = cut_lineage(found), cut_lineage(parts.filter("_parts > 1"))
    for turn in range(1, ROUNDS + 1):
        label = components(found).select(F.col("node").alias("rep"), "label")
        told = open_.select("group", "rep", "weight", "_parts").join(label, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        by_label = told.groupBy("group", "label").agg(F.sum("weight").alias("_of"))
        largest = by_label.groupBy("group").agg(F.max_by("label", F.struct("_of", "label")).alias("_main"), F.count(F.lit(1)).alias("_labels"),
                                                (F.sum("_of") - F.max("_of")).alias("_rest")).filter("_labels > 1")
        open_ = cut_lineage(told.join(largest, "group"))
        if open_.isEmpty():
            return found
        if turn < ROUNDS:
            found = cut_lineage(found.unionByName(within(open_.select("group", mixed("_parts", turn).alias("part"), "rep", "label"))))
    halves = open_.select("group", "rep", "label", (F.col("label") != F.col("_main")).alias("_out"), (F.col("_parts") * 2).alias("_all"), number(F.col("_rest") * 2).alias("_outer"))
    placed = halves.withColumns({"_i": mixed("_all", ROUNDS), "_o": mixed("_outer", ROUNDS + 1)})
    to = lambda outer, own: outer.cast("long") * (1 << 31) + own
    met = F.transform(F.sequence(F.lit(0), F.col("_outer") - 1), lambda o: to(o, F.col("_i")))
    meets = F.when(F.col("_out"), F.transform(F.sequence(F.lit(0), F.col("_all") - 1), lambda i: to(F.col("_o"), i))).otherwise(F.array().cast("array<bigint>"))
    return found.unionByName(within(placed.select("group", F.explode(F.array_union(met, meets)).alias("part"), "rep", "label")))


def _with_sets(rows: DataFrame, dealt: DataFrame, firsts: DataFrame, k: int) -> DataFrame:
    """``(group, part, label, rep, set)``: the shingles of each member beside where it goes; a text is split once, and sent as its set."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, found in _flat(batch.column(2), k):
                packed = pa.array([s.tobytes() for s in found], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.slice(a, len(found)).columns[:2], packed], names=["rep", "to", "set"])

    kind = "array<struct<group:bigint,part:bigint,label:bigint>>"
    to = dealt.groupBy("rep").agg(F.collect_list(F.struct("group", F.col("part").cast("long").alias("part"), "label")).alias("to"))
    asked = cut_lineage(to.join(firsts, "rep"))
    texts = rows.join(small_side(asked, BROADCAST_MEMBERS), ["doc_id", "text_mark"]).select("rep", "to", "text")
    return texts.mapInArrow(sets, f"rep long, to {kind}, set binary").select("rep", F.explode("to").alias("_to"), "set").select("_to.*", "rep", "set")
