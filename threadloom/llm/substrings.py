"""Removal of repeated byte strings with a logarithmic family of suffix arrays (operator 6).

A byte goes if a string of ``L`` bytes over it also starts earlier, in a document with a smaller id or earlier in the same one.

1. Sampling: the ``L``-byte window at each place picks the smallest hash of the ``G``-byte strings in it, the last of equals. Equal
   windows pick the same place in them, their anchor. Windows next to each other with one anchor form its stretch.
2. Anchors meet by the hash of their string. Stretches that are equal as a whole to an earlier one are repeated as a whole. Only
   stretches that meet different ones under the same hash are fetched as bytes.
3. There, batches in corpus order get suffix arrays of what follows their anchors and of what precedes them, read backwards, with
   longest common prefixes; a batch is merge-scanned with itself and with every level of the index, then becomes a level, and levels
   of equal size merge. Two windows are equal where both common prefixes reach to their ends. Ranges hold a bounded number of
   stretches, so that few batches meet in one; those of a string with very many surroundings are dealt out window by window.

Texts move once, in the join that fetches stretches; the last step reads the same exchange.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from threadloom.llm.grams import blocks, spread, utf8
from threadloom.session import cut_lineage

L, G = 100, 16
WIDTH = L - G + 1
#: Bytes of text whose anchors meet in one range, and stretches compared in one.
BYTES_PER_RANGE, PIECES_PER_RANGE = 48_000_000, 32_768
BATCH = 65_536
#: A string with more different stretches than this is dealt out by the bytes of each window.
HOT = 16_384
#: Anchors a task holds before it gives them out by range, and at least so many for each range.
FLUSH, FLUSH_PER_RANGE = 250_000, 64

RECORD = np.dtype([("gram", "<u8"), ("whole", "<u8"), ("at", "<u4"), ("left", "u1"), ("windows", "u1")])
#: An anchor whose stretch must be compared; ``hot``: window by window.
OPEN = np.dtype([("gram", "<u8"), ("at", "<u4"), ("left", "u1"), ("windows", "u1"), ("hot", "?")])
#: ``gram`` deals out; ``known``: windows that are repeated for certain and come without text.
PIECE = np.dtype([("gram", "<u8"), ("doc", "<i8"), ("mark", "<i8"), ("at", "<u4"), ("left", "u1"), ("windows", "u1"), ("known", "?")])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Records of the anchors of a block, ``at`` counted from the text's begin, and the text each is in."""
    n = len(data)
    if n < L:
        return np.zeros(0, RECORD), np.zeros(0, np.int64)
    eights = np.ndarray((n - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))  # the eight bytes from each place on
    grams = spread(spread(eights[:n - G + 1]) + eights[8:])
    value, place = (grams >> np.uint64(32)).astype(np.uint32), np.arange(len(grams), dtype=np.int32)
    size = 1
    while 2 * size <= WIDTH:
        value, place = _smaller(value, place, size)
        size *= 2
    value, place = _smaller(value, place, WIDTH - size)
    last = np.repeat(offsets[1:], np.diff(offsets))
    begins = np.flatnonzero(np.arange(n - L + 1) + L <= last[:n - L + 1])
    if not len(begins):
        return np.zeros(0, RECORD), np.zeros(0, np.int64)
    chosen = place[begins]
    run = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (begins[1:] != begins[:-1] + 1)]))
    first, end = begins[run], begins[np.append(run[1:], len(begins)) - 1]
    doc = np.searchsorted(offsets, first, "right") - 1
    out = np.zeros(len(run), RECORD)
    out["gram"], out["at"] = grams[chosen[run]], chosen[run] - offsets[doc]
    out["left"], out["windows"] = chosen[run] - first, end - first + 1
    # A stretch is hashed string by string, the last one up to its end; every step mixes all bits.
    whole = spread(out["left"].astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + out["windows"].astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))
    size = end + L - first
    for step in range(0, int(size.max()) - G + 1, G):
        some = np.flatnonzero(size >= step + G)
        whole[some] = spread(whole[some] ^ grams[first[some] + step])
    out["whole"] = spread(whole ^ spread(grams[end + L - G] + np.uint64(1)))
    return out, doc


def _smaller(value: np.ndarray, place: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """The smaller of each value and the one ``step`` further; the further one of equals."""
    right = value[step:] <= value[:len(value) - step]
    return np.where(right, value[step:], value[:len(value) - step]), np.where(right, place[step:], place[:len(place) - step])


def _packed(columns: list[np.ndarray], which: np.ndarray, ranges: int) -> Iterator[tuple]:
    order = np.argsort(which, kind="stable")
    ends = np.cumsum(np.bincount(which, minlength=ranges)).tolist()
    sorted_ = [c[order] for c in columns]
    for r, (a, b) in enumerate(zip([0, *ends], ends)):
        if b > a:
            yield (r, *(c[a:b].tobytes() for c in sorted_))


def _by_document(docs: np.ndarray, marks: np.ndarray, values: np.ndarray) -> pd.DataFrame:
    """One row per document with its values packed."""
    order = np.lexsort((marks, docs))
    docs, marks, values = docs[order], marks[order], values[order]
    cut = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (marks[1:] != marks[:-1])])) if len(docs) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(docs))
    return pd.DataFrame({"doc_id": docs[cut], "mark": marks[cut], "packed": [values[a:b].tobytes() for a, b in zip(cut.tolist(), ends.tolist())]})


def _sampled(rows: DataFrame, ranges: int) -> DataFrame:
    """``(range, records, docs, marks)``: anchors of whole texts, packed by range of their hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def give() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*held)]
            out = list(_packed(columns, (columns[0]["gram"] % np.uint64(ranges)).astype(np.uint32), ranges))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), *[pa.binary()] * 3))], names=["range", "records", "docs", "marks"])

        for batch in batches:
            ids, marks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for a, _, data, offsets in blocks(*utf8(batch.column(2))):
                found, doc = anchors(data, offsets)
                if len(found):
                    held.append((found, ids[a + doc], marks[a + doc]))
                    count += len(found)
                if count >= max(FLUSH, FLUSH_PER_RANGE * ranges):
                    yield give()
                    held, count = [], 0
        if held:
            yield give()

    return rows.select("doc_id", "mark", "text").mapInArrow(run, "range int, records binary, docs binary, marks binary")


def _met(pdf: pd.DataFrame, hot: int = HOT) -> pd.DataFrame:
    """Anchors of one range: spans that are repeated as a whole, and anchors whose stretches must be compared.

    ``asked`` is -1 for spans; for anchors, how many pieces are to be compared, told once a range.
    """
    found = np.frombuffer(b"".join(pdf["records"]), RECORD)
    docs, marks = (np.frombuffer(b"".join(pdf[c]), "<i8") for c in ("docs", "marks"))
    order = np.argsort(found["gram"], kind="stable")
    gram = found["gram"][order]
    edge = np.concatenate([[True], gram[1:] != gram[:-1], [True]])
    order = order[~(edge[:-1] & edge[1:])]  # strings that occur once
    found, docs, marks = found[order], docs[order], marks[order]
    start = found["at"].astype(np.int64) - found["left"]
    order = np.lexsort((start, docs, found["whole"], found["gram"]))
    found, docs, marks, start = found[order], docs[order], marks[order], start[order]
    if not len(found):
        return pd.DataFrame({"doc_id": [], "mark": [], "packed": [], "asked": []})
    gram, whole = found["gram"], found["whole"]
    new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (whole[1:] != whole[:-1])])
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    later = (docs > docs[first]) | (start > start[first])
    spans = np.stack([start, start + found["windows"] + L - 1], axis=1)
    _, group = np.unique(gram, return_inverse=True)
    different = np.bincount(group, weights=new)[group]
    ask = ~later & (different > 1)
    opened = np.zeros(ask.sum(), OPEN)
    for name in ("gram", "at", "left", "windows"):
        opened[name] = found[name][ask]
    opened["hot"] = different[ask] > hot
    anchors_ = _by_document(docs[ask], marks[ask], opened)
    asked = np.zeros(len(anchors_), np.int64)
    asked[:1] = np.where(opened["hot"], opened["windows"], 1).sum()
    return pd.concat([_by_document(docs[later], marks[later], spans[later]).assign(asked=-1), anchors_.assign(asked=asked)])


class Level:
    """Stretches in corpus order with both suffix arrays: ``after`` from the anchor on, ``before`` it and backwards."""

    def __init__(self, pieces: np.ndarray, after: np.ndarray, before: np.ndarray, sorted_after: np.ndarray | None = None, sorted_before: np.ndarray | None = None):
        self.pieces, self.after, self.before = pieces, after, before
        self.sorted_after = _suffix_order(after) if sorted_after is None else sorted_after
        self.sorted_before = _suffix_order(before) if sorted_before is None else sorted_before

    def __len__(self) -> int:
        return len(self.pieces)

    def merged(self, later: Level) -> Level:
        both = [np.concatenate([getattr(self, x), getattr(later, x)]) for x in ("pieces", "after", "before")]
        orders = [_merged_order(rows, np.concatenate([mine, theirs + len(self)])) for rows, mine, theirs in (
            (both[1], self.sorted_after, later.sorted_after), (both[2], self.sorted_before, later.sorted_before))]
        return Level(*both, *orders)


def _words(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of numbers with the same order."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, :rows.shape[1]] = rows
    return wide.view(">u8").astype(np.uint64)


def _suffix_order(rows: np.ndarray) -> np.ndarray:
    return np.lexsort(_words(rows).T[::-1])


def _merged_order(rows: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Two sorted runs, one behind the other, merged; the stable sort finds the runs."""
    words = _words(rows[two])
    return two[np.lexsort(words.T[::-1])]


def _common(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Longest common prefix of each row, in order, with the one before; -1 for the first."""
    ranked = rows[order]
    differs = ranked[1:] != ranked[:-1]
    common = np.where(differs.any(1), differs.argmax(1), rows.shape[1])
    return np.concatenate([[-1], common])


def repeats(level: Level, since: int) -> np.ndarray:
    """For the stretches from ``since`` on: which of their windows equal an earlier one, a column per distance to the anchor."""
    pieces = level.pieces
    n, out = len(pieces), np.zeros((len(pieces) - since, WIDTH), bool)
    if n < 2:
        return out
    after, before = _common(level.after, level.sorted_after), _common(level.before, level.sorted_before)
    left, least = pieces["left"].astype(np.int64), pieces["left"].astype(np.int64) - pieces["windows"] + 1
    classes = np.empty((2, n), np.int64)
    place_after, place_before = np.empty(n, np.int64), np.empty(n, np.int64)
    place_after[level.sorted_after], place_before[level.sorted_before] = np.arange(n), np.arange(n)
    for distance in range(WIDTH):
        rows = np.flatnonzero((least <= distance) & (distance <= left))
        if not len(rows) or rows[-1] < since:
            continue
        classes[0], classes[1] = np.cumsum(after < L - distance), np.cumsum(before < distance)
        _, first, which = np.unique(classes[0][place_after[rows]] * (n + 1) + classes[1][place_before[rows]], return_index=True, return_inverse=True)
        one = rows[first[which]]
        earlier = (pieces["doc"][one] < pieces["doc"][rows]) | (pieces["at"][one] < pieces["at"][rows])
        hit = rows[earlier & (rows >= since)]
        out[hit - since, distance] = True
    return out


class SuffixFamily:
    """Levels of geometrically growing size. Batches come in corpus order."""

    def __init__(self) -> None:
        self.levels: list[Level] = []

    def add(self, batch: Level) -> np.ndarray:
        """Repeated windows of the batch, against itself and all levels; then the batch is a level."""
        found = repeats(batch, 0)
        for level in self.levels:
            found |= repeats(level.merged(batch), len(level))
        self.levels.append(batch)
        while len(self.levels) > 1 and len(self.levels[-2]) <= len(self.levels[-1]):
            last = self.levels.pop()
            self.levels[-1] = self.levels[-1].merged(last)
        return found


def _compared(pdf: pd.DataFrame) -> pd.DataFrame:
    """Spans of the repeated windows among the open stretches of one range."""
    pieces = np.frombuffer(b"".join(pdf["pieces"]), PIECE)
    text = np.frombuffer(b"".join(pdf["text"]), np.uint8)
    size = np.where(pieces["known"], 0, pieces["windows"].astype(np.int64) + L - 1)
    begin = np.cumsum(size) - size
    order = np.lexsort((pieces["at"], pieces["doc"]))
    known = pieces[order[pieces["known"][order]]]
    order = order[~pieces["known"][order]]
    start = known["at"].astype(np.int64) - known["left"]
    family, docs, marks = SuffixFamily(), [known["doc"]], [known["mark"]]
    spans = [np.stack([start, start + known["windows"] + L - 1], axis=1)]
    for a in range(0, len(order), BATCH):
        some = order[a:a + BATCH]
        batch, left = pieces[some], pieces["left"][some].astype(np.int64)
        anchor, reach = begin[some] + left, size[some] - left
        columns = np.arange(L)
        after = np.where(columns < reach[:, None], text[np.minimum(anchor[:, None] + columns, len(text) - 1)], 0).astype(np.uint8)
        columns = np.arange(1, WIDTH)
        before = np.where(columns <= left[:, None], text[np.maximum(anchor[:, None] - columns, 0)], 0).astype(np.uint8)
        hit = family.add(Level(batch, after, before))[:, ::-1]  # by place in the text
        padded = np.zeros((len(batch), WIDTH + 2), np.int8)
        padded[:, 1:-1] = hit
        edges = np.diff(padded, axis=1)
        row, first = np.nonzero(edges == 1)
        _, stop = np.nonzero(edges == -1)
        # Column c of the turned table is the window whose anchor is WIDTH - 1 - c bytes in.
        at = batch["at"].astype(np.int64)[row] - (WIDTH - 1)
        docs.append(batch["doc"][row])
        marks.append(batch["mark"][row])
        spans.append(np.stack([at + first, at + stop - 1 + L], axis=1))
    return _by_document(np.concatenate(docs), np.concatenate(marks), np.concatenate(spans).astype(np.int64))


def repeated_spans(rows: DataFrame, ranges: int, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, mark, packed)`` twice: spans repeated as whole stretches, and open anchors, with ``asked``, from ``(doc_id, mark, text)``."""
    met = _sampled(rows, ranges).groupBy("range").applyInPandas(lambda pdf: _met(pdf, hot), "doc_id long, mark long, packed binary, asked long")
    met = cut_lineage(met)
    return met.filter("asked < 0").drop("asked"), met.filter("asked >= 0")


def _window_pieces(pieces: np.ndarray, starts: np.ndarray, raws: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Pieces of one window each, dealt out by its bytes.

    Of equal windows only the earliest travel with their bytes; the others are repeated for certain.
    """
    first: dict[bytes, tuple[int, int]] = {}
    for doc, start, windows, raw in zip(pieces["doc"].tolist(), starts.tolist(), pieces["windows"].tolist(), raws):
        for s in range(start, start + windows):
            window, place = raw[s:s + L], (doc, s)
            if first.setdefault(window, place) > place:
                first[window] = place
    of, from_, windows, known, deal, chunks = [], [], [], [], [], []
    for i, (doc, start, n, raw) in enumerate(zip(pieces["doc"].tolist(), starts.tolist(), pieces["windows"].tolist(), raws)):
        for s in range(start, start + n):
            window = raw[s:s + L]
            later = first[window] < (doc, s)
            if later and known and known[-1] and of[-1] == i and from_[-1] + windows[-1] == s:
                windows[-1] += 1
                continue
            of.append(i)
            from_.append(s)
            windows.append(1)
            known.append(later)
            deal.append(xxhash.xxh3_64_intdigest(window if not later else b"%d %d" % (doc, s)))
            chunks.append(b"" if later else window)
    out = pieces[of]
    out["left"] = out["at"].astype(np.int64) - np.array(from_, np.int64)
    out["windows"], out["known"], out["gram"] = windows, known, np.array(deal, np.uint64)
    return out, chunks


def _fetched(texts: DataFrame, ranges: int) -> DataFrame:
    """``(range, pieces, text)``: the bytes of open stretches, from rows with ``doc_id, mark, text`` and a list of packed anchors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, parts, chunks, hot, raws = [], [], [], [], []
            for doc, mark, text, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if not packed:
                    continue
                raw, want = text.encode("utf-8"), np.frombuffer(b"".join(packed), OPEN)
                piece = np.zeros(len(want), PIECE)
                for name in ("gram", "at", "left", "windows"):
                    piece[name] = want[name]
                piece["doc"], piece["mark"] = doc, mark
                if want["hot"].any():
                    hot.append(piece[want["hot"]])
                    raws += [raw] * len(hot[-1])
                    piece = piece[~want["hot"]]
                start = piece["at"].astype(np.int64) - piece["left"]
                parts.append(piece)
                chunks += [raw[a:b] for a, b in zip(start.tolist(), (start + piece["windows"] + L - 1).tolist())]
            if hot:
                some = np.concatenate(hot)
                piece, more = _window_pieces(some, some["at"].astype(np.int64) - some["left"], raws)
                parts.append(piece)
                chunks += more
            if parts:
                pieces = np.concatenate(parts)
                which = (pieces["gram"] % np.uint64(ranges)).astype(np.uint32)
                order = np.argsort(which, kind="stable")
                ends = np.cumsum(np.bincount(which, minlength=ranges)).tolist()
                for r, (a, b) in enumerate(zip([0, *ends], ends)):
                    if b > a:
                        out.append((r, pieces[order[a:b]].tobytes(), b"".join([chunks[i] for i in order[a:b].tolist()])))
            types = (pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 3, types)], names=["range", "pieces", "text"])

    return texts.select("doc_id", "mark", "text", "packed").mapInArrow(run, "range int, pieces binary, text binary")


def _by_doc(packed: DataFrame) -> DataFrame:
    """What is packed for a document, one row per range at most, in one list."""
    return packed.groupBy("doc_id", "mark").agg(F.collect_list("packed").alias("packed"))


def to_compare(rows: DataFrame, opened: DataFrame, pieces: int = PIECES_PER_RANGE) -> DataFrame:
    """``(range, pieces, text)``: open stretches with their bytes, about ``pieces`` of them in a range."""
    asked = opened.agg(F.sum("asked")).first()[0] or 0
    return _fetched(rows.join(_by_doc(opened), ["doc_id", "mark"], "left"), max(8, math.ceil(asked / pieces)))


def _cut(raw: bytes, packed: list[bytes]) -> tuple[int, int, bytes]:
    """Removed bytes, removed runs and what is left."""
    spans = np.frombuffer(b"".join(packed), "<i8").reshape(-1, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    head = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    starts, ends = spans[head, 0].tolist(), reach[np.append(np.flatnonzero(head)[1:] - 1, len(spans) - 1)].tolist()
    kept = b"".join(raw[a:b] for a, b in zip([0, *ends], [*starts, len(raw)]))
    return len(raw) - len(kept), len(starts), kept


def without_repeats(docs: DataFrame, hot: int = HOT, pieces: int = PIECES_PER_RANGE) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256)``, one row per row of ``docs``.

    ``kept`` holds the remaining bytes, which may cut a character. Strings are judged on the input. A null text counts as empty;
    texts under 100 bytes stay whole. A null ``doc_id`` comes first. Rows that share an id count as places of one document: of equal
    strings at the same place in both, none is earlier, at different places the further one goes. Ids must be integers. An empty
    table gives no rows; other columns are not used. ``hot`` and ``pieces`` change how the work is dealt out, never the result.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id", F.xxhash64("text").alias("mark"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    whole, opened = repeated_spans(rows, max(8, math.ceil(size / BYTES_PER_RANGE)), hot)
    compared = to_compare(rows, opened, pieces).groupBy("range").applyInPandas(_compared, "doc_id long, mark long, packed binary")
    spans = _by_doc(whole.unionByName(compared))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, packed in zip(*(c.to_pylist() for c in batch.columns)):
                raw = text.encode("utf-8")
                removed, runs, kept = _cut(raw, packed) if packed else (0, 0, raw)
                out.append((None if doc == -(1 << 63) else doc, len(raw), removed, runs, kept, hashlib.sha256(kept).hexdigest()))
            types = (*[pa.int64()] * 4, pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, types)],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return rows.join(spans, ["doc_id", "mark"], "left").select("doc_id", "text", "packed").mapInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
