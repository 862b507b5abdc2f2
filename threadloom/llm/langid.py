"""Language identification by interpolated Kneser-Ney character models (operator 7).

Texts are reduced to letters, folded to lower case, with one blank for whatever lies between; each text starts after blanks. A
model of order ``ORDER`` is fitted per language. For all languages together, the n-grams of each order and the contexts are kept
as sorted 64-bit hashes beside a row of log-probabilities, one column a language, so a character costs one search in most cases
and goes down one order for each one it misses. The language with the lowest cross-entropy a character is the answer.

The model is small: it is fitted on at most ``DOCS_PER_LANGUAGE`` whole texts of each language, those with the smallest hash of id and
text. A tenth of them is kept out of the counts and calibrates the rejection.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from threadloom.llm.grams import blocks, give_back, spread, utf8
from threadloom.session import cut_lineage

ORDER = 4
DOCS_PER_LANGUAGE = 1_000
DISCOUNT = 0.75
UNKNOWN = "und"
#: A text is rejected beyond this quantile of the deviations of its language's calibration texts, times a slack, and never below a least
#: number of deviations.
QUANTILE, SLACK, LEAST_LIMIT = 0.995, 1.25, 4.0
#: Smallest spread assumed between texts of a language, in nats a character.
LEAST_SPREAD = 0.1
_FACTORS = [np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


@functools.cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: is it a letter, and its lower-case letter where that is one code point."""
    letters, folded = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            letters[i] = True
            low = c.lower()
            if len(low) == 1:
                folded[i] = ord(low)
    return letters, folded


def reduced(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the reduced texts, each after ``order - 1`` blanks, and where each text begins and the last one ends."""
    letters, folded = _characters()
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    letter = letters[points]
    before = np.zeros(len(points), bool)
    before[1:] = letter[:-1]
    before[heads[:-1][heads[:-1] < len(points)]] = False
    kept = letter | before
    sizes = np.concatenate([[0], np.cumsum(kept)])[heads]
    pad = order - 1
    starts = sizes + pad * np.arange(len(offsets))
    out = np.full(starts[-1], 32, np.uint32)
    places = np.arange(sizes[-1]) + np.repeat(pad * np.arange(1, len(offsets)), np.diff(sizes))
    out[places] = np.where(letter, folded[points], 32)[kept]
    return out, starts


def _hashes(points: np.ndarray, ends: np.ndarray, first: int, last: int) -> np.ndarray:
    """Hashes of the characters ``first`` to ``last`` places before ``ends``, nearest first; 0 is the character itself."""
    total = np.zeros(len(ends), np.uint64)
    for j, back in enumerate(range(first, last + 1)):
        total += (points[ends - back].astype(np.uint64) + np.uint64(1)) * _FACTORS[j]
    return spread(total)


class Table(NamedTuple):
    """Sorted hashes with a row of values each."""

    keys: np.ndarray
    values: np.ndarray
    index: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> Table:
        order = np.argsort(keys)
        keys = keys[order]
        return cls(keys, values[order], np.searchsorted(keys, np.arange(1 << 16, dtype=np.uint64) << np.uint64(48)).astype(np.int64))

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Rows of hashes, -1 for those that are not there: from the first key with the same leading 16 bits on, step by step."""
        if not len(self.keys):
            return np.full(len(wanted), -1)
        last = len(self.keys) - 1
        at = np.minimum(self.index[wanted >> np.uint64(48)], last)
        key = self.keys[at]
        row = np.where(key == wanted, at, -1)
        open_ = np.flatnonzero((key < wanted) & (at < last))
        at = at[open_]
        while len(open_):
            at = at + 1
            key, want = self.keys[at], wanted[open_]
            hit = key == want
            row[open_[hit]] = at[hit]
            more = (key < want) & (at < last)
            open_, at = open_[more], at[more]
        return row


class Model(NamedTuple):
    languages: list[str]
    grams: list[Table]  # by order, from 1
    contexts: list[Table]  # what a miss of that order costs
    floor: np.ndarray  # of a character never seen
    level: np.ndarray  # per language: mean cross-entropy of calibration texts,
    wide: np.ndarray  # their deviation, and the deviation of one character
    noise: np.ndarray
    limit: np.ndarray  # largest deviation accepted

    def losses(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log-probability of the character at each of ``ends``, a column per language."""
        out = np.zeros((len(ends), len(self.languages)), np.float32)
        open_ = np.arange(len(ends))
        for order in range(len(self.grams), 0, -1):
            here = ends[open_]
            row = self.grams[order - 1].find(_hashes(points, here, 0, order - 1))
            hit = row >= 0
            out[open_[hit]] += self.grams[order - 1].values[row[hit]]
            open_, here = open_[~hit], here[~hit]
            if not len(open_):
                return out
            if order > 1:
                row = self.contexts[order - 1].find(_hashes(points, here, 1, order - 1))
                hit = row >= 0
                out[open_[hit]] += self.contexts[order - 1].values[row[hit]]
        out[open_] += self.floor
        return out


def _levels(grams: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per order from the highest: n-grams with counts, below the highest the number of different characters before them."""
    levels = [(grams, counts)]
    while levels[-1][0].shape[1] > 1:
        levels.append(np.unique(levels[-1][0][:, 1:], axis=0, return_counts=True))
    return levels[::-1]


def fit(counts: pd.DataFrame, order: int = ORDER) -> Model:
    """A model without calibration from rows ``(lang, gram, n)``; every gram has ``order`` characters."""
    languages = sorted(counts["lang"].unique())
    by_language = []
    for lang in languages:
        part = counts[counts["lang"] == lang]
        codes = np.frombuffer("".join(part["gram"]).encode("utf-32-le"), np.uint32).reshape(-1, order)
        by_language.append(_levels(codes, part["n"].to_numpy(np.float64)))
    grams, contexts, lower = [], [], None
    characters = len(np.unique(np.concatenate([x[0][0] for x in by_language]))) + 1 if languages else 1
    floor = np.zeros(len(languages), np.float32)
    for m in range(1, order + 1):
        union = np.unique(np.concatenate([x[m - 1][0] for x in by_language]), axis=0) if languages else np.zeros((0, m), np.uint32)
        ends = np.arange(len(union)) * m + m - 1
        keys, heads = _hashes(union.ravel(), ends, 0, m - 1), _hashes(union.ravel(), ends, 1, m - 1)
        below = np.full((len(union), len(languages)), 1 / characters) if lower is None else np.exp(lower.values[lower.find(_hashes(union.ravel(), ends, 0, m - 2))].astype(np.float64))
        all_heads, head_of = np.unique(heads, return_inverse=True)
        probability, missed = np.zeros_like(below), np.ones((len(all_heads), len(languages)))
        for i, x in enumerate(by_language):
            own, n = x[m - 1]
            own_keys = _hashes(own.ravel(), np.arange(len(own)) * m + m - 1, 0, m - 1)
            seen = np.zeros(len(union))
            places = np.argsort(keys)
            seen[places[np.searchsorted(keys, own_keys, sorter=places)]] = n
            total = np.bincount(head_of, weights=seen, minlength=len(all_heads))
            kinds = np.bincount(head_of, weights=seen > 0, minlength=len(all_heads))
            known = total > 0
            missed[known, i] = DISCOUNT * kinds[known] / total[known]
            share = np.divide(np.maximum(seen - DISCOUNT, 0), total[head_of], out=np.zeros(len(union)), where=known[head_of])
            probability[:, i] = share + missed[head_of, i] * below[:, i]
        lower = Table.of(keys, np.log(probability).astype(np.float32))
        grams.append(lower)
        contexts.append(Table.of(all_heads, np.log(missed).astype(np.float32)))
        if m == 1 and len(missed):
            floor = np.log(missed[0] / characters).astype(np.float32)
    blank = np.zeros(len(languages))
    return Model(languages, grams, contexts, floor, blank, blank, blank, blank + np.inf)


def cross_entropies(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: scored characters, cross-entropy in each language, variance of a character in each."""
    sizes, means, variances = [], [], []
    order = len(model.grams)
    for _, _, data, offsets in blocks(*utf8(column)):
        points, starts = reduced(data, offsets, order)
        n = np.diff(starts) - (order - 1)
        ends = np.arange(n.sum()) + np.repeat(np.arange(1, len(starts)) * (order - 1), n)
        loss = -model.losses(points, ends)
        edges = np.concatenate([[0], np.cumsum(n)])
        many = np.maximum(n, 1)[:, None]

        def mean(values: np.ndarray) -> np.ndarray:
            sums = np.zeros((len(n), values.shape[1]))
            some = n > 0
            if some.any():
                sums[some] = np.add.reduceat(values, edges[:-1][some], axis=0, dtype=np.float64)
            return sums / many

        first = mean(loss)
        sizes.append(n)
        means.append(first)
        variances.append(np.maximum(mean(loss * loss) - first * first, 0))
    give_back()
    if not sizes:
        empty = np.zeros((0, len(model.languages)))
        return np.zeros(0, np.int64), empty, empty
    return np.concatenate(sizes), np.concatenate(means), np.concatenate(variances)


def _deviation(model: Model, best: np.ndarray, loss: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (loss - model.level[best]) / np.sqrt(model.wide[best] ** 2 + model.noise[best] ** 2 / np.maximum(n, 1))


def calibrate(model: Model, losses: pd.DataFrame) -> Model:
    """Levels and limits from ``(lang, n, loss, variance)`` of texts that were not counted, in their own language; a language without any
    takes the largest of the others."""
    found = [np.zeros(len(model.languages)) for _ in range(4)]
    for i, lang in enumerate(model.languages):
        own = losses[(losses["lang"] == lang) & (losses["n"] > 0)]
        if not len(own):
            continue
        n, loss = own["n"].to_numpy(), own["loss"].to_numpy()
        weight = n / n.sum()
        found[0][i] = (loss * weight).sum()
        found[1][i] = max(LEAST_SPREAD, np.sqrt((weight * (loss - found[0][i]) ** 2).sum()))
        found[2][i] = max(0.5, np.sqrt((weight * own["variance"].to_numpy()).sum()))
        part = model._replace(level=found[0], wide=found[1], noise=found[2])
        found[3][i] = max(LEAST_LIMIT, SLACK * np.quantile(_deviation(part, np.full(len(own), i), loss, n), QUANTILE))
    for values in found:
        if len(values):
            values[found[3] == 0] = values.max()
    if len(model.languages) and not found[3].any():
        return model._replace(wide=np.ones(len(model.languages)), limit=np.full(len(model.languages), np.inf))
    return model._replace(level=found[0], wide=found[1], noise=found[2], limit=found[3])


def training_sample(rows: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """``(lang, text, apart)``: at most so many rows of a language, those with the smallest hashes of id and text; a tenth is set apart.

    A count a language gives the share of hashes that holds twice as many; only those rows are ranked, so no task ranks more however
    many rows and tasks there are. Rows with a null or empty text or a null language are left out; those with a null id, or that share
    one, are rows like others.
    """
    teach = rows.select("lang", "text", F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit("language")).alias("_h")).filter(
        F.col("lang").isNotNull() & (F.length("text") > 0))
    sizes = teach.groupBy(F.col("lang").alias("_of")).agg(F.count(F.lit(1)).alias("_rows"))
    share = F.least(F.lit(1.0), 2.0 * docs_per_language / F.col("_rows") + 1e-9)

    def inside(bounds: DataFrame) -> DataFrame:
        few = bounds.limit(10_001).count() <= 10_000
        return teach.join(F.broadcast(bounds) if few else bounds, F.col("lang") == F.col("_of")).filter(F.shiftrightunsigned("_h", 11).cast("double") <= F.col("_share") * float(1 << 53))

    # Copies have one hash, in the share or out of it together: a language that is left short by them is ranked whole.
    bounds = cut_lineage(sizes.withColumn("_share", share))
    kept = inside(bounds).groupBy("_of").agg(F.count(F.lit(1)).alias("_kept"))
    short = F.coalesce("_kept", F.lit(0)) < F.least(F.lit(docs_per_language), "_rows")
    few = inside(cut_lineage(bounds.join(kept, "_of", "left").select("_of", F.when(short, 1.0).otherwise(F.col("_share")).alias("_share"))))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_h", "text"))
    return few.withColumn("_n", place).filter(F.col("_n") <= docs_per_language).select("lang", "text", (F.col("_n") % 10 == 0).alias("apart"))


def train(rows: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, order: int = ORDER) -> Model:
    """Fit a model on ``rows (doc_id, text, lang)``, see :func:`training_sample`.

    Only n-gram counts, and three numbers for each text that calibrates, reach the driver: both are bounded by the number of sampled
    texts and of languages. With fewer than ten texts a language has none apart, and takes the limits of the others.
    """
    sample = cut_lineage(training_sample(rows, docs_per_language))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in dict.fromkeys(langs.tolist()):
                for _, _, data, offsets in blocks(*utf8(batch.column(1).filter(pa.array(langs == lang)))):
                    points, starts = reduced(data, offsets, order)
                    n = np.diff(starts) - (order - 1)
                    ends = np.arange(n.sum()) + np.repeat(np.arange(1, len(starts)) * (order - 1), n)
                    if not len(ends):
                        continue
                    grams, times = np.unique(np.stack([points[ends - back] for back in range(order - 1, -1, -1)], axis=1), axis=0, return_counts=True)
                    said = grams.astype("<u4").tobytes().decode("utf-32-le")
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array([said[i:i + order] for i in range(0, len(said), order)]),
                                                      pa.array(times, pa.int64())], names=["lang", "gram", "n"])

    counts = sample.filter(~F.col("apart")).select("lang", "text").mapInArrow(count, "lang string, gram string, n long")
    model = fit(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas(), order)
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {lang: i for i, lang in enumerate(sent.value.languages)}
        for batch in batches:
            n, means, variances = cross_entropies(sent.value, batch.column(1))
            at = np.array([place.get(lang, -1) for lang in batch.column(0).to_pylist()], np.int64)
            some = np.flatnonzero(at >= 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), pa.array(n[some].astype(np.int64)), pa.array(means[some, at[some]].astype(np.float64)),
                                              pa.array(variances[some, at[some]].astype(np.float64))], names=["lang", "n", "loss", "variance"])

    apart = sample.filter("apart").select("lang", "text").mapInArrow(judge, "lang string, n long, loss double, variance double")
    return calibrate(model, apart.toPandas())


def identify(model: Model, spark) -> callable:
    """A function from a text column to ``struct<lang, score, loss, rejected>``.

    ``lang`` is the language of the lowest cross-entropy a character, the first by name of equals, and ``und`` for null and for texts
    without a letter, or when nothing was learned; these are rejected with score 0. ``score`` is the share of the answer among the
    languages, from the evidence of at most 30 characters. ``rejected`` also marks texts that are further from their language than
    nearly all calibration texts, by a margin. Nothing but the text is looked at.
    """
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang string, score double, loss double, rejected boolean")
    def told(column: pa.Array) -> pa.Array:
        model = sent.value
        names = np.array([*model.languages, UNKNOWN], object)
        n, means, _ = cross_entropies(model, column)
        best = np.full(len(column), len(model.languages))
        score, loss, rejected = np.zeros(len(column)), np.full(len(column), np.nan), np.ones(len(column), bool)
        some = np.flatnonzero(n > 0) if model.languages else np.zeros(0, np.int64)
        if len(some):
            means, best[some] = means[some], means[some].argmin(1)
            loss[some] = means.min(1)
            score[some] = 1 / np.exp(-(means - means.min(1, keepdims=True)) * np.minimum(n[some], 30)[:, None]).sum(1)
            rejected[some] = _deviation(model, best[some], loss[some], n[some]) > model.limit[best[some]]
        return pa.StructArray.from_arrays([pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(loss, mask=np.isnan(loss)), pa.array(rejected)],
                                          names=["lang", "score", "loss", "rejected"])

    return lambda text: told(F.col(text) if isinstance(text, str) else text)


def held_out() -> Column:
    """Rows kept for testing."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a column ``_language`` as of :func:`identify`."""
    return docs.withColumn("_language", identify(model, docs.sparkSession)("text"))
