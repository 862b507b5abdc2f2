"""Phrase collocations (operator 11).

Only words, and then only pairs, that are frequent enough can be part of a frequent phrase, so texts become sequences of ids of
frequent words with a gap wherever another word or the end of a piece stands. Runs of two to five ids are counted by every task in
counting quotient filters (:mod:`quotient`), cut by ranges of the quotient; the filters of one range are merged from all tasks, and
what reaches the count leaves them as ids again. Scores and containment are joins of the frequent phrases with their own parts.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from threadloom.llm import quotient
from threadloom.llm.grams import blocks, give_back, utf8
from threadloom.session import cut_lineage, shared_folder

LONGEST, LEAST = 5, 100
#: Bytes of text cut into words at once.
BLOCK = 1 << 20
#: Frequent words (some 30 bytes each) told to every task at once; more are told part by part, in as many passes over the texts.
WORDS_AT_ONCE = 2_000_000
#: Frequent pairs (8 or 16 bytes each) told to every task up to this many; with more, longer phrases are counted without that check.
PAIRS_TOLD = 4_000_000
#: Runs held by a task before they are sorted into filters.
RUNS_HELD = 4_000_000
#: Runs that one range of quotients stands for at most, on average.
RUNS_PER_RANGE = 2_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_ENDS
_WORD[[0x20, 0x09]] = False


def _cut(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of some texts in lower case, the text each is in, and whether each follows the word before it in one piece."""
    data, n = _LOWER[data], len(data)
    inside, edge = _WORD[data], np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    start = np.flatnonzero(inside & (edge[:-1] | ~before))
    end = np.flatnonzero(inside & (edge[1:] | ~after)) + 1
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))
    piece = np.searchsorted(np.flatnonzero(_ENDS[data]), start)
    follows = np.zeros(len(start), bool)
    follows[1:] = (doc[1:] == doc[:-1]) & (piece[1:] == piece[:-1])
    places = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(places), pa.py_buffer(data[inside]))
    return words, doc, follows


def word_counts(docs: DataFrame) -> DataFrame:
    """``(lang, word, f)`` of all words of ``docs (lang, text)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            lang_of = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b, data, offsets in blocks(*utf8(batch.column(1)), BLOCK):
                words, doc, _ = _cut(data, offsets)
                if not len(words):
                    continue
                coded = words.dictionary_encode()
                keys, counts = np.unique(lang_of[a:b][doc] * len(coded.dictionary) + coded.indices.to_numpy(), return_counts=True)
                lang, word = np.divmod(keys, len(coded.dictionary))
                yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang)), coded.dictionary.take(pa.array(word)).cast(pa.string()),
                                                  pa.array(counts.astype(np.int64))], names=["lang", "word", "f"])
        give_back()

    return docs.select("lang", "text").mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def numbered(words: DataFrame) -> DataFrame:
    """Rows of a written table with a column ``id`` from 1 without gaps: places inside partitions, and a carry of one row per partition."""
    placed = cut_lineage(words.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(carry), F.col("_part") == F.col("_p")).select(*words.columns, (F.col("_before") + F.col("_at") + 1).alias("id"))


def encoded(docs: DataFrame, words: DataFrame, known: int) -> DataFrame:
    """``(ids binary)``: each text as 32-bit ids of ``words (lang, word, id)``, 0 where a run ends: another word, or the end of a piece."""
    spark, out = docs.sparkSession, docs.select("lang", "text", F.lit(None).cast("binary").alias("ids"))
    parts = max(1, math.ceil(known / WORDS_AT_ONCE))
    for part in range(parts):
        told = words.filter(F.col("id") % parts == part).select("lang", "word", "id").toArrow().combine_chunks()  # at most WORDS_AT_ONCE rows, or near it
        out = out.mapInArrow(_coder(spark.sparkContext.broadcast(told), part == parts - 1), "lang string, text string, ids binary")
    return out.select("ids")


def _coder(dictionary, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, tables = dictionary.value, {}
        for lang in pc.unique(told["lang"]).to_pylist():
            mine = told.filter(pc.equal(told["lang"], lang))
            tables[lang] = mine["word"].combine_chunks().cast(pa.large_string()), np.append(mine["id"].to_numpy(), 0).astype(np.int32)
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            lang_of = langs.indices.to_numpy(zero_copy_only=False)
            old, out = batch.column(2), []
            for a, b, data, offsets in blocks(*utf8(batch.column(1)), BLOCK):
                words, doc, follows = _cut(data, offsets)
                coded = words.dictionary_encode()
                which, of_word, ids = coded.indices.to_numpy(), lang_of[a:b][doc], np.zeros(len(words), np.int32)
                for code in np.unique(of_word).tolist():
                    if (lang := langs.dictionary[code].as_py()) in tables:
                        said, numbers = tables[lang]
                        at = pc.fill_null(pc.index_in(coded.dictionary, value_set=said), len(said)).to_numpy()
                        mine = of_word == code
                        ids[mine] = numbers[at][which[mine]]
                # A gap goes before every word that follows no other, so that a text's ids alone say where runs end.
                slots = np.cumsum(1 + ~follows.astype(bool))
                line = np.zeros(int(slots[-1]) if len(slots) else 0, np.int32)
                if len(slots):
                    line[slots - 1] = ids
                ends = np.concatenate([[0], slots])[np.searchsorted(doc, np.arange(len(offsets)))]
                for i, (x, y) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                    earlier = old[a + i].as_py()
                    out.append((line[x:y] if earlier is None else np.maximum(line[x:y], np.frombuffer(earlier, np.int32))).tobytes())
            texts = pa.nulls(len(batch), pa.string()) if last else batch.column(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, pa.array(out, pa.binary())], names=["lang", "text", "ids"])
        give_back()

    return run


def frequent_runs(ids: DataFrame, sizes: list[int], bits: int, ranges: int, least: int, pairs=None) -> DataFrame:
    """``(ids array<long>, f)``: runs of ids without a gap of the given sizes that occur ``least`` times or more.

    ``pairs`` may hold the permuted lanes of all frequent pairs, in order; a run with another pair in it is passed over.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = defaultdict(list), 0

        def filters() -> Iterator[pa.RecordBatch]:
            rows = []
            for n, parts in held.items():
                lanes, counts = quotient.counted([np.concatenate(c) for c in zip(*parts)])
                wide = quotient.widths(n, bits)
                inner = np.array([-(-i * (1 << wide[0]) // ranges) for i in range(1, ranges)], np.uint64)
                edges = [0, *np.searchsorted(lanes[0], inner).tolist(), len(counts)]
                rows += [(n, i, quotient.encode([lane[x:y] for lane in lanes], counts[x:y], wide)) for i, (x, y) in enumerate(zip(edges[:-1], edges[1:])) if y > x]
            held.clear()
            for at in range(0, len(rows), 256):
                size, place, raw = zip(*rows[at:at + 256])
                yield pa.RecordBatch.from_arrays([pa.array(size, pa.int32()), pa.array(place, pa.int32()), pa.array(raw, pa.binary())], names=["n", "range", "filter"])

        for batch in batches:
            column = batch.column(0)
            for at in range(0, len(column), 256):
                parts = [np.frombuffer(v.as_buffer(), np.int32) for v in column.slice(at, 256)]
                line = np.concatenate([np.concatenate([p, np.zeros(1, np.int32)]) for p in parts])
                for n, lanes in _runs(line, sizes, bits, pairs):
                    held[n].append(lanes)
                    number += len(lanes[0])
                if number >= RUNS_HELD:
                    yield from filters()
                    number = 0
        yield from filters()
        give_back()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        lanes, counts = quotient.merged(list(pdf["filter"]))
        enough = counts >= least
        columns = quotient.unpacked(quotient.restored([lane[enough] for lane in lanes], quotient.widths(n, bits)), n, bits)
        return pd.DataFrame({"ids": list(np.stack(columns, 1)) if len(columns[0]) else [], "f": counts[enough]})

    return ids.select("ids").mapInArrow(count, "n int, range int, filter binary").groupBy("n", "range").applyInPandas(merge, "ids array<long>, f long")


def _runs(line: np.ndarray, sizes: list[int], bits: int, pairs) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Permuted lanes of the runs in a line of ids."""
    full = line > 0
    two = full[:-1] & full[1:]
    if pairs is not None and len(two):
        at = np.flatnonzero(two)
        two[at] = _among(quotient.permuted(quotient.packed([line[at], line[at + 1]], bits), quotient.widths(2, bits)), pairs.value)
    whole = two
    for n in range(2, max(sizes) + 1):
        if n > 2:
            whole = whole[:-1] & two[n - 2:]
        if not len(whole):
            return
        if n in sizes:
            at = np.flatnonzero(whole)
            yield n, quotient.permuted(quotient.packed([line[at + j] for j in range(n)], bits), quotient.widths(n, bits))


def _among(lanes: list[np.ndarray], known: list[np.ndarray]) -> np.ndarray:
    """Which keys are among known ones in order; a pair has one or two lanes, equal first lanes with other second ones are let through."""
    if not len(known[0]):
        return np.zeros(len(lanes[0]), bool)
    return known[0][np.minimum(np.searchsorted(known[0], lanes[0]), len(known[0]) - 1)] == lanes[0]


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, words, f)`` of all phrases of 1 to ``longest`` words that occur ``least`` times, and ``(lang, n)``, all words of each language."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counts = word_counts(texts)
    path = shared_folder(spark, "phrase-words")
    counts.write.parquet(path)
    counts = spark.read.parquet(path)
    totals = cut_lineage(counts.groupBy("lang").agg(F.sum("f").alias("n")))
    words = cut_lineage(numbered(counts.filter(F.col("f") >= least)))
    known = words.count()
    one = words.select("lang", F.col("word").alias("phrase"), F.array("word").alias("words"), "f")
    if not known or longest < 2:
        return one, totals
    bits = max(1, known.bit_length())
    path = shared_folder(spark, "phrase-ids")
    encoded(texts, words, known).write.parquet(path)
    ids = spark.read.parquet(path)
    said = totals.agg(F.sum("n")).first()[0]  # one number
    ranges = max(1, math.ceil(said / RUNS_PER_RANGE))
    pairs = cut_lineage(frequent_runs(ids, [2], bits, ranges, least))
    found, told = pairs, None
    if longest > 2:
        if pairs.limit(PAIRS_TOLD + 1).count() <= PAIRS_TOLD:
            both = pairs.select(F.col("ids")[0].alias("a"), F.col("ids")[1].alias("b")).toArrow()  # at most PAIRS_TOLD
            lanes = quotient.permuted(quotient.packed([both["a"].to_numpy(), both["b"].to_numpy()], bits), quotient.widths(2, bits))
            told = spark.sparkContext.broadcast([np.sort(lanes[0])])
        found = pairs.unionByName(cut_lineage(frequent_runs(ids, list(range(3, longest + 1)), bits, ranges, least, told)))
    places = found.select("ids", "f", F.posexplode("ids").alias("_at", "id")).join(words.select("id", "lang", "word"), "id")
    spelled = places.groupBy("ids").agg(F.first("f").alias("f"), F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("_at", "word"))).alias("w"))
    several = spelled.select("lang", F.transform("w", lambda x: x["word"]).alias("words"), "f").select("lang", F.array_join("words", " ").alias("phrase"), "words", "f")
    return cut_lineage(one.unionByName(several)), totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, most: int = 2_000) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``most`` best phrases of each language, as the contract of the query says.

    A phrase of ``a`` occurrences is cut into two parts of ``l`` and ``r``; its score is that of its worst cut,
    ``floor(1000 * a * n / (l * r))`` in whole numbers of up to 38 digits, with ``n`` words of its language. A phrase with a longer one
    around it as often as itself is dropped. Null texts are empty, a null ``lang`` counts as ``und``, repeated rows count again, ``doc_id`` and
    other columns are not used, an empty table gives no rows. Scores tie by ``a`` and the phrase's bytes. Texts may have any length: words
    are cut in blocks, one long text is a block.
    """
    table, totals = frequent_phrases(docs, least, longest)
    candidates = table.filter(F.size("words") > 1)
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.expr(
        "transform(sequence(1, size(words) - 1), k -> struct(k, array_join(slice(words, 1, k), ' ') AS x, array_join(slice(words, k + 1, size(words)), ' ') AS y))")).alias("c"))
    cuts = cuts.select("lang", "phrase", "a", "c.k", "c.x", "c.y")
    left, right = (table.select("lang", F.col("phrase").alias(key), F.col("f").alias(name)) for key, name in (("x", "l"), ("y", "r")))
    whole = cuts.join(left, ["lang", "x"]).join(right, ["lang", "y"]).join(totals, "lang")
    scored = whole.withColumn("score", F.expr("cast((cast(1000 as decimal(38,0)) * a * n) div (cast(l as decimal(38,0)) * r) as long)"))
    worst = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("w"), F.first("a").alias("a"), F.first("n").alias("n"))
    # A phrase inside a longer one of the same count is also inside one that is a word longer, with that count.
    inner = candidates.filter(F.size("words") > 2).select("lang", "f", F.explode(F.expr(
        "array(array_join(slice(words, 1, size(words) - 1), ' '), array_join(slice(words, 2, size(words)), ' '))")).alias("phrase"))
    around = inner.groupBy("lang", "phrase").agg(F.max("f").alias("_f"))
    kept = worst.join(around, ["lang", "phrase"], "left").filter(F.col("_f").isNull() | (F.col("_f") < F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    flat = kept.select("lang", "phrase", "a", F.col("w.l").alias("l"), F.col("w.r").alias("r"), "n", F.col("w.score").alias("score"))
    return flat.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
