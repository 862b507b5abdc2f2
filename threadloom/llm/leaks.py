"""Benchmark decontamination by winnowing (operator 4).

Words are hashed in runs of ``k``; in every window of ``n - k + 1`` neighbouring runs the smallest hash is kept, the last one of
equals. A span of ``n`` shared words holds one such window on both sides, so both keep the same run: no shared span is missed.
Kept runs of documents join those of the benchmark by hash, with the words around them, and a hit is extended word by word.
Items of fewer than ``n`` words are looked for as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from threadloom.llm.common import small_side
from threadloom.llm.grams import LETTERED, Words, blocks, utf8
from threadloom.session import cut_lineage

N, K = 10, 5
#: Up to this many distinct benchmark hashes (8 bytes each) are sent to every task, which then gives out only runs that are
#: among them; with more, every kept run goes to the join.
BROADCAST_HASHES = 2_000_000
#: Benchmark runs with their words (about 300 bytes each) up to this many rows go to every task for the join.
BROADCAST_RUNS = 50_000
FOUND = "`{key}` {kind}, _text long, _words long, _at int, _need int, _hash long, _left array<string>, _core array<string>, _right array<string>"


def kept_runs(words: Words, n: int = N, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Winnowing: (word, hash) of the runs that are smallest in some window."""
    hashes, windows = words.grams(k), np.flatnonzero(words.whole(n))
    least, place = hashes[windows], windows.copy()
    for step in range(1, n - k + 1):
        other = hashes[windows + step]
        smaller = other <= least
        least[smaller], place[smaller] = other[smaller], windows[smaller] + step
    chosen = np.zeros(len(hashes), bool)
    chosen[place] = True
    at = np.flatnonzero(chosen)
    return at, hashes[at]


def _around(words: Words, at: int, k: int, reach: int) -> tuple[list[str], list[str], list[str]]:
    """The words of a run, and up to ``reach`` words on both sides, nearest first."""
    doc = words.doc[at]
    low, high = max(int(words.first[doc]), at - reach), min(int(words.first[doc + 1]), at + k + reach)
    said = [words.text(i) for i in range(low, high)]
    return said[:at - low][::-1], said[at - low:at - low + k], said[at - low + k:]


def _runs(rows: DataFrame, key: str, short: list[int], known, items: bool, n: int, k: int) -> DataFrame:
    """A row without a run for every text, then rows of runs. ``_need`` is how many words in a row make a hit: ``n`` for a kept run,
    or the length of a short item, which is taken as one run; in documents every run of such a length."""
    kind = rows.schema[key].dataType.simpleString()
    names = ["_text", "_words", "_at", "_need", "_hash", "_left", "_core", "_right"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), *[pa.list_(pa.string())] * 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if known is None else known.value
        for batch in batches:
            which, out = [], []
            for a, _, data, offsets in blocks(*utf8(batch.column(1))):
                words = Words(data, offsets, LETTERED)
                sizes, marks = np.diff(words.first), _text_marks(data, offsets)
                which += range(a, a + len(sizes))
                out += [(m, s, None, None, None, None, None, None) for m, s in zip(marks.tolist(), sizes.tolist())]
                found = [(n, k, *kept_runs(words, n, k))]
                for length in short:
                    at = np.flatnonzero(words.whole(length) & ((sizes == length)[words.doc] if items else True))
                    found.append((length, length, at, words.grams(length)[at]))
                for need, length, at, hashes in found:
                    if wanted is not None and len(at):
                        hit = wanted[np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)] == hashes
                        at, hashes = at[hit], hashes[hit]
                    for word, value in zip(at.tolist(), hashes.astype(np.int64).tolist()):
                        doc = int(words.doc[word])
                        which.append(a + doc)
                        out.append((int(marks[doc]), int(sizes[doc]), word - int(words.first[doc]), need, value, *_around(words, word, length, need - length)))
            ids = batch.column(0).take(pa.array(which, pa.int64()))
            columns = zip(*out) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(v, t) for v, t in zip(columns, types))], names=[key, *names])

    return rows.select(key, "text").mapInArrow(run, FOUND.format(key=key, kind=kind))


def _text_marks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` of each whole text, which tells apart rows that share an id."""
    raw = data.tobytes()
    return np.array([xxhash.xxh64_intdigest(raw[a:b], 42) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], np.uint64).astype(np.int64)


def _shared(a: str, b: str):
    """How many words two sides have in common, from the run outwards."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(differs == 0, F.size(a)).otherwise(differs - 1).cast("int")


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N, k: int = K, broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """``(doc_id, text_mark, n_words, n_hit, items)``, one row per row of ``docs``; ``text_mark`` is ``xxhash64`` of the text.

    A window is ``n`` consecutive words of an item, or a shorter item that is not empty as a whole; ``n_hit`` counts the document's
    words inside any occurrence of a window, ``items`` are the ids, as strings in order, of the items with one. Null and empty
    texts have no words and no hits; items without words fit nothing; a null ``item_id`` counts as the empty string; equal items
    count under each id. Rows that share a ``doc_id`` are told apart by text, and equal rows give equal results, one each. Empty
    tables on either side are fine; other columns are not used.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    sizes = _runs(items, "item_id", [], None, True, n, k).filter(F.col("_at").isNull() & F.col("_words").between(1, n - 1))
    short = sorted(row[0] for row in sizes.select("_words").distinct().collect())  # lengths below n
    index = cut_lineage(_runs(items, "item_id", short, None, True, n, k).filter(F.col("_at").isNotNull()))
    hashes, known = index.select("_hash").distinct(), None
    if hashes.limit(broadcast_hashes + 1).count() <= broadcast_hashes:
        values = np.array([row[0] for row in hashes.collect()] or [0], np.int64).astype(np.uint64)
        known = docs.sparkSession.sparkContext.broadcast(np.sort(values))
    found = cut_lineage(_runs(docs, "doc_id", short, known, False, n, k))

    runs = found.filter(F.col("_at").isNotNull()).dropDuplicates(["doc_id", "_text", "_at", "_need"])
    other = index.select("item_id", "_hash", "_need", F.col("_left").alias("_left2"), F.col("_core").alias("_core2"), F.col("_right").alias("_right2"))
    met = runs.join(small_side(other, BROADCAST_RUNS), ["_hash", "_need"]).filter(F.col("_core") == F.col("_core2")).withColumns(
        {"_l": _shared("_left", "_left2"), "_r": _shared("_right", "_right2"), "_c": F.size("_core")})
    spans = met.filter(F.col("_l") + F.col("_c") + F.col("_r") >= F.col("_need")).select(
        "doc_id", "_text", (F.col("_at") - F.col("_l")).alias("_from"), (F.col("_at") + F.col("_c") + F.col("_r")).alias("_to"), "item_id")
    hits = cut_lineage(spans.distinct())

    order = Window.partitionBy("doc_id", "_text").orderBy("_from").rowsBetween(Window.unboundedPreceding, -1)
    covered = hits.groupBy("doc_id", "_text", "_from").agg(F.max("_to").alias("_to")).withColumn(
        "_new", F.greatest(F.lit(0), F.col("_to") - F.greatest("_from", F.coalesce(F.max("_to").over(order), F.lit(0)))))
    words_hit = covered.groupBy("doc_id", "_text").agg(F.sum("_new").alias("n_hit"))
    told = hits.groupBy("doc_id", "_text").agg(F.array_sort(F.collect_set("item_id")).alias("items")).withColumnsRenamed({"doc_id": "_d", "_text": "_t"})
    result = words_hit.join(told, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_text") == F.col("_t"))).select("_d", "_t", "n_hit", "items")

    rows = found.filter(F.col("_at").isNull()).select("doc_id", "_text", "_words")
    return rows.join(result, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_text") == F.col("_t")), "left").select(
        "doc_id", F.col("_text").alias("text_mark"), F.col("_words").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))
