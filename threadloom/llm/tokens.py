"""Token ids in wavelet-matrix files (operator 2).

Documents are dealt by ranges of ``doc_id``, tokenized, and written in order as shards of about eight million ids. A shard file
is one wavelet matrix: a bit-plane per bit of the id, the planes cut into compressed pieces, each plane with counts of ones for
every 512 bits. From the one file :class:`Shard` gives any id, counts ids in a span and finds the k-th place of an id, unpacking
only the pieces it touches.

Layout, little-endian: ``WAVE0001``, length of the header (u4), header (JSON: sizes, zeros per plane, place and length of every
section), sections. Spark writes each shard as the only line of a text file, so a line end follows the last section; files come
from Spark's committer, and a task that is run again leaves no second copy.
"""

from __future__ import annotations

import itertools
import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from threadloom.llm.grams import LONG, blocks, give_back, utf8, word_hashes
from threadloom.session import cut_lineage

MAGIC = b"WAVE0001"
SHARD_TOKENS = 8_000_000
PIECE = 1 << 16  # bytes of a plane compressed together
STEP = 512  # bits between stored counts
RUN = 1 << 18  # ids dealt by a bit at once
END_ID = 1
#: Words remembered with their ids in each Python worker, some 40 bytes each in arrays; of a full store the half that was met most often
#: stays. Words of more than LONG bytes are not remembered, so the store's size has a bound whatever the texts are.
WORDS_KEPT = 400_000
#: Bytes encoded at once; each time the new words are merged into the store.
BLOCK = 1 << 20
#: Words given to the library as one text.
TOGETHER = 256
#: Texts are cut at blanks and line ends only: what else counts as white space is left to the library.
PIECES = np.ones(256, bool)
PIECES[[0x20, 0x0A]] = False
#: How the given tokenizer splits what is left after normal forms. No alternative goes on from a letter to a mark, or from a mark other than
#: an apostrophe to a letter, and a digit stands alone: texts may be cut there, and letters alone are one split.
SPLITS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: ASCII letters and digits, and letters of two bytes (as lead * 256 + next) that every normal form here and lower-casing leave one letter.
FIRM, FIRM_PAIRS = np.zeros(256, bool), np.zeros(1 << 16, bool)
FIRM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
FIRM_PAIRS[[int.from_bytes(c.encode()) for c in map(chr, [*range(0xC0, 0x180), *range(0x388, 0x3CF), *range(0x400, 0x460)])
            if c.isalpha() and len(c.lower()) == 1 and unicodedata.normalize("NFC", c) == c]] = True


class WordTokenizer:
    """Ids of whole texts, each distinct piece between blanks given to the library once and known again as a whole.

    Right for tokenizers that drop white space before they split and so never join two pieces, as those here do.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallel part
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items() if t.special}
        self.mark, self.mark_id = next(iter(special.items()), (None, None))
        if self.mark and any(s[0] != self.mark[0] for s in special):
            self.mark = None  # special tokens of several kinds: every word goes alone
        #: Whether the tokenizer makes letters small before all else that sees their case.
        self.folds = _lower_cases(self.library)
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        #: Marks at which words are cut, none if it is not known how the tokenizer splits; and which ids end a split.
        self.cuts = _marks(self.library)
        self.last = _last_ids(self.library, vocabulary) if self.cuts is not None else None
        self.narrow = max(vocabulary.values(), default=0) < 1 << 16
        del vocabulary
        give_back()
        # Words by place: bytes one behind the other, ids one behind the other, in how many blocks they were; and their sorted hashes with places.
        self.letters, self.letter_ends = np.zeros(0, np.uint8), np.zeros(1, np.uint32)
        self.flat, self.ends, self.met = np.zeros(0, np.uint16 if self.narrow else np.uint32), np.zeros(1, np.uint32), np.zeros(0, np.int32)
        self.keys, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def _thin(self) -> None:
        """Forget words that few blocks had."""
        least = 2
        while (self.met >= least).sum() > WORDS_KEPT // 2:
            least *= 2
        stays = self.met >= least
        for flat, ends in (("letters", "letter_ends"), ("flat", "ends")):
            size = np.diff(getattr(self, ends))
            setattr(self, flat, getattr(self, flat)[np.repeat(stays, size)])
            setattr(self, ends, np.concatenate([[0], np.cumsum(size[stays])]).astype(np.uint32))
        there = stays[self.places]
        self.keys, self.places = self.keys[there], (np.cumsum(stays, dtype=np.int32) - 1)[self.places[there]]
        self.met = np.ones(int(stays.sum()), np.int32)

    def _find(self, keys: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Places of words, -1 for unknown ones. Words with the hash of a known one are compared byte by byte."""
        found = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return found
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        place, size = self.places[at], np.diff(offsets)
        start = self.letter_ends[place].astype(np.int64)
        some = np.flatnonzero((self.keys[at] == keys) & (self.letter_ends[place + 1] - start == size))
        place, size = place[some], size[some]
        differs = data[_spans(offsets[some], size)] != self.letters[_spans(start[some], size)]
        same = np.add.reduceat(differs, np.cumsum(size) - size, dtype=np.int64) == 0 if len(some) else np.zeros(0, bool)  # no word is empty
        found[some[same]] = place[same]
        return found

    def _coded(self, words: list[str], alone: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one behind the other, and how many each has.

        Many words go to the library as one text with a special token after each, by which the ids are cut again; words that may hold
        a special token themselves go ``alone``.
        """
        if alone:
            ids = [self.library.encode(w, add_special_tokens=False).ids for w in words]
            return np.fromiter(itertools.chain.from_iterable(ids), np.uint32), np.array([len(i) for i in ids], np.int64)
        # One text after the other: what the library holds of a text is many times its ids.
        ids, sizes = zip(*(self._together(words[i:i + TOGETHER]) for i in range(0, len(words), TOGETHER)))
        return np.concatenate(ids), np.concatenate(sizes)

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given to the library as one text. Words of letters only have one split each, and need no special token between them:
        the ids that end a split tell them apart. If there are more of those than words, a letter has become several characters."""
        if self.last is not None and "".join(words).isalpha():
            ids = np.array(self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
            upto = np.flatnonzero(self.last[ids]) + 1
            if len(upto) == len(words):
                return ids, np.diff(upto, prepend=0)
        ids = np.array(self.library.encode_batch_fast([f" {self.mark} ".join([*words, ""])], add_special_tokens=False)[0].ids, np.uint32)
        marks = np.flatnonzero(ids == self.mark_id)
        if len(marks) != len(words):
            raise RuntimeError("the tokenizer joins words across a special token")
        return np.delete(ids, marks), np.diff(marks, prepend=-1) - 1

    def _asked(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids of words from the library: for some of the words at a time, which they are, their ids, and how many each has."""
        kind = np.array([2 if self.mark is None or self.mark[0] in w else not w.isalpha() for w in words], np.int8)
        for k in range(3):
            some = np.flatnonzero(kind == k)
            if len(some):
                yield some, *self._coded([words[i] for i in some.tolist()], k == 2)

    def _keep(self, keys: np.ndarray, data: np.ndarray, offsets: np.ndarray, flat: np.ndarray, ends: np.ndarray, new: np.ndarray) -> None:
        """Remember new words, given by their numbers among all of a block. Of words with one hash one is kept."""
        new = new[np.diff(offsets)[new] <= LONG]
        if len(self.met) + len(new) > WORDS_KEPT:
            self._thin()
        new = new[np.sort(np.unique(keys[new], return_index=True)[1])]
        if len(self.keys):
            new = new[self.keys[np.minimum(np.searchsorted(self.keys, keys[new]), len(self.keys) - 1)] != keys[new]]
        new = new[:max(0, WORDS_KEPT - len(self.met))]
        if not len(new):
            return
        size, count = np.diff(offsets)[new], np.diff(ends)[new]
        order = np.argsort(keys[new])
        at = np.searchsorted(self.keys, keys[new][order])
        self.keys, self.places = np.insert(self.keys, at, keys[new][order]), np.insert(self.places, at, (len(self.met) + order).astype(np.int32))
        self.letters, self.letter_ends = np.concatenate([self.letters, data[_spans(offsets[new], size)]]), np.concatenate([self.letter_ends, (int(self.letter_ends[-1]) + np.cumsum(size)).astype(np.uint32)])
        self.flat, self.ends = np.concatenate([self.flat, flat[_spans(ends[new], count)]]), np.concatenate([self.ends, (int(self.ends[-1]) + np.cumsum(count)).astype(np.uint32)])
        self.met = np.concatenate([self.met, np.ones(len(new), np.int32)])

    def _ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words one behind the other, and where those of each begin and the last end."""
        data, offsets = utf8(words)
        keys = word_hashes(data, offsets[:-1], offsets[1:])
        place = self._find(keys, data, offsets)
        new, known = np.flatnonzero(place < 0), np.flatnonzero(place >= 0)
        place = place[known]
        self.met[place] += 1
        parts = [(new[some], ids, count) for some, ids, count in self._asked(words.take(pa.array(new)).to_pylist())]
        size = np.zeros(len(keys), np.int64)
        start = self.ends[place].astype(np.int64)
        size[known] = self.ends[place + 1] - start
        for some, _, count in parts:
            size[some] = count
        ends = np.concatenate([[0], np.cumsum(size)])
        flat = np.empty(ends[-1], self.flat.dtype)
        flat[_spans(ends[known], size[known])] = self.flat[_spans(start, size[known])]
        for some, ids, count in parts:
            flat[_spans(ends[some], count)] = ids
        self._keep(keys, data, offsets, flat, ends, new)
        return flat, ends

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a block of texts, each with ``end_id`` behind, and their number for each text."""
        # Words that only differ in case have the ids of the small one.
        words, first = pieces(data, offsets, self.mark.encode()[0] if self.folds and self.mark else None, self.cuts)
        coded = words.dictionary_encode()
        which = coded.indices.to_numpy()
        flat, ends = self._ids(coded.dictionary)
        # A document's end is one more word, after its last.
        docs = len(offsets) - 1
        last = first[1:] + np.arange(docs)
        plain = np.ones(len(which) + docs, bool)
        plain[last] = False
        start, size = np.zeros(len(plain), np.int64), np.ones(len(plain), np.int64)
        start[plain] = ends[which]
        size[plain] = ends[which + 1] - ends[which]
        upto = np.cumsum(size)
        flat = flat if len(flat) else np.zeros(1, flat.dtype)
        ids = (flat if end_id <= np.iinfo(flat.dtype).max else flat.astype(np.uint32))[_spans(start, size)]
        ids[upto[last] - 1] = end_id
        return ids, np.diff(upto[last], prepend=0)


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of spans, one behind the other."""
    upto = np.cumsum(sizes)
    places = np.repeat(starts - (upto - sizes), sizes)
    places += np.arange(len(places))
    return places


def _steps(part, many: str) -> list[dict]:
    """The steps of a tokenizer's normalizer or pre-tokenizer; its state is small, while the JSON of the whole holds the vocabulary."""
    state = json.loads(part.__getstate__()) if part else {}
    return state[many] if state.get("type") == "Sequence" else [state]


def _lower_cases(library) -> bool:
    """Whether a tokenizer lower-cases all texts, after nothing but normal forms and white space, and has no added token that is
    matched in normalised texts, where small letters may be one and capitals none."""
    blank = lambda step: step.get("type") == "Replace" and step["pattern"] == {"Regex": "\\s+"} and step["content"] == " "
    kinds = ["blank" if blank(step) else step.get("type") for step in _steps(library.normalizer, "normalizers")]
    before = kinds[:kinds.index("Lowercase")] if "Lowercase" in kinds else None
    return before is not None and set(before) <= {"NFC", "NFD", "NFKC", "NFKD", "blank"}


def _marks(library) -> np.ndarray | None:
    """The bytes of ASCII marks beside which a tokenizer always splits if a letter or digit is on the other side: all but the apostrophe
    and what special tokens are made of. None unless it lower-cases after no more than NFC, splits by ``SPLITS`` and goes on by bytes."""
    kinds = [step.get("type") for step in _steps(library.normalizer, "normalizers")]
    splits, added = _steps(library.pre_tokenizer, "pretokenizers"), library.get_added_tokens_decoder().values()
    known = [{"type": "Split", "pattern": {"Regex": SPLITS}, "behavior": "Removed", "invert": True},
             {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
    if splits != known or not _lower_cases(library) or kinds[-1] != "Lowercase" or not set(kinds) <= {"NFC", "Replace", "Lowercase"}:
        return None
    if any(t.normalized or t.single_word for t in added):
        return None
    cuts = np.zeros(256, bool)
    cuts[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True
    cuts[[0x27, *(b for t in added for b in t.content.encode())]] = False
    return cuts


def _last_ids(library, vocabulary: dict[str, int]) -> np.ndarray | None:
    """For every id, whether it ends a split; None unless every split ends with one such id and has no other."""
    from tokenizers.models import BPE
    from tokenizers.pre_tokenizers import ByteLevel

    model = library.model
    suffix = getattr(model, "end_of_word_suffix", None)
    if not isinstance(model, BPE) or not suffix or model.dropout or model.ignore_merges or any(c + suffix not in vocabulary for c in ByteLevel.alphabet()):
        return None
    last = np.zeros(max(vocabulary.values()) + 1, bool)
    last[[i for word, i in vocabulary.items() if word.endswith(suffix)]] = True
    return last


def _beside(data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Where bytes marked in ``cuts`` meet a letter or digit: the later byte of the two."""
    at, n = np.flatnonzero(cuts[data]), len(data)
    before, after = at[at > 0], at[at < n - 1] + 1
    ahead, behind = data[np.maximum(before - 2, 0)].astype(np.int64), data[np.minimum(after + 1, n - 1)]
    firm = FIRM[data[before - 1]] | FIRM_PAIRS[ahead << 8 | data[before - 1]]
    return np.concatenate([before[firm], after[FIRM[data[after]] | FIRM_PAIRS[data[after].astype(np.int64) << 8 | behind]]])


def pieces(data: np.ndarray, offsets: np.ndarray, mark: int | None = None, cuts: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray]:
    """What stands between blanks and ends of lines, and the first such piece of each text, one more for the end.

    If a byte ``mark`` is given, A-Z become small in pieces of ASCII without it; with ``cuts``, pieces also end where such a byte meets a
    letter or digit.
    """
    n = len(data)
    inside, edge = PIECES[data], np.zeros(n + 1, bool)
    edge[offsets] = True
    if cuts is not None and n:
        edge[_beside(data, cuts)] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    start = np.flatnonzero(inside & (edge[:-1] | ~before))
    end = np.flatnonzero(inside & (edge[1:] | ~after)) + 1
    places, letters = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64), data[inside]
    if mark is not None:
        big = (letters >= 65) & (letters <= 90)
        apart = np.flatnonzero((letters >= 128) | (letters == mark))
        whole = np.zeros(len(start), bool)
        whole[np.searchsorted(places, apart, "right") - 1] = True
        big &= ~np.repeat(whole, end - start)
        letters[big] += 32
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(places), pa.py_buffer(letters)), np.searchsorted(start, offsets)


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def _dealt(values: np.ndarray, bits: np.ndarray, zeros: int) -> np.ndarray:
    """The values without the bit, then those with it, each in their order. By places, a run at a time: twice as fast as by masks."""
    out, low, high = np.empty_like(values), 0, zeros
    for i in range(0, len(values), RUN):
        run, bit = values[i:i + RUN], bits[i:i + RUN]
        ones, others = np.flatnonzero(bit), np.flatnonzero(~bit)
        out[high:high + len(ones)], out[low:low + len(others)] = run[ones], run[others]
        low, high = low + len(others), high + len(ones)
    return out


def _undealt(values: np.ndarray, bits: np.ndarray, zeros: int) -> np.ndarray:
    """:func:`_dealt` undone."""
    out, low, high = np.empty_like(values), 0, zeros
    for i in range(0, len(values), RUN):
        run, bit = out[i:i + RUN], bits[i:i + RUN]
        ones, others = np.flatnonzero(bit), np.flatnonzero(~bit)
        run[ones], run[others] = values[high:high + len(ones)], values[low:low + len(others)]
        low, high = low + len(others), high + len(ones)
    return out


def pack(ids: np.ndarray, doc_ids: list, sizes: np.ndarray, part: int, number: int) -> bytes:
    """The bytes of a shard."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    sections: list[bytes] = []
    place = 0

    def put(raw: bytes) -> list[int]:
        nonlocal place
        sections.append(raw)
        place += len(raw)
        return [place - len(raw), len(raw)]

    levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    rest, tokens = ids.astype(np.uint16 if levels <= 16 else np.uint32, copy=False), len(ids)
    del ids
    planes, zeros = [], []
    for level in range(levels - 1, -1, -1):
        bits = (rest & rest.dtype.type(1 << level)) != 0
        raw = np.packbits(bits, bitorder="little")
        padded = np.zeros(-(-len(raw) // (STEP // 8)) * (STEP // 8), np.uint8)
        padded[:len(raw)] = raw
        ones = np.bitwise_count(padded.view(np.uint64)).reshape(-1, STEP // 64).sum(1)
        before = np.concatenate([[0], np.cumsum(ones)]).astype("<u4")
        data = padded.tobytes()
        planes.append({"counts": put(squeeze(before.tobytes())), "pieces": [put(squeeze(data[i:i + PIECE])) for i in range(0, len(data), PIECE)]})
        zeros.append(int(tokens - before[-1]))
        rest = _dealt(rest, bits, zeros[-1])
    docs = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
    header = {"tokens": tokens, "docs": len(doc_ids), "part": part, "number": number, "zeros": zeros, "planes": planes,
              "doc_ids": put(squeeze(docs)), "null_ids": [i for i, d in enumerate(doc_ids) if d is None], "sizes": put(squeeze(sizes.astype("<i8").tobytes()))}
    head = json.dumps(header).encode()
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, *sections])


class Shard:
    """Reads a shard from its bytes."""

    def __init__(self, raw: bytes):
        import zstandard

        if raw[:8] != MAGIC:
            raise ValueError("not a shard of token ids")
        self._unpack = zstandard.ZstdDecompressor().decompress
        size = int.from_bytes(raw[8:12], "little")
        self.head, self._raw, self._base = json.loads(raw[12:12 + size]), raw, 12 + size
        self.tokens, self.zeros = self.head["tokens"], self.head["zeros"]
        self._counts: dict[int, np.ndarray] = {}
        self._pieces: dict[tuple[int, int], np.ndarray] = {}

    def _section(self, place: list[int]) -> bytes:
        return self._unpack(self._raw[self._base + place[0]:self._base + place[0] + place[1]])

    def documents(self) -> tuple[list, np.ndarray]:
        """Ids of the documents in order, and the number of token ids of each."""
        ids: list = np.frombuffer(self._section(self.head["doc_ids"]), "<i8").tolist()
        for i in self.head["null_ids"]:
            ids[i] = None
        return ids, np.frombuffer(self._section(self.head["sizes"]), "<i8")

    def _ones(self, level: int) -> np.ndarray:
        if level not in self._counts:
            self._counts[level] = np.frombuffer(self._section(self.head["planes"][level]["counts"]), "<u4")
        return self._counts[level]

    def _piece(self, level: int, piece: int) -> np.ndarray:
        if (level, piece) not in self._pieces:
            self._pieces[level, piece] = np.frombuffer(self._section(self.head["planes"][level]["pieces"][piece]), np.uint8)
        return self._pieces[level, piece]

    def _step(self, level: int, step: int) -> np.ndarray:
        """The bits of one step."""
        byte = step * STEP // 8
        return np.unpackbits(self._piece(level, byte // PIECE)[byte % PIECE:byte % PIECE + STEP // 8], bitorder="little")

    def _rank(self, level: int, i: int) -> int:
        """Ones before place ``i`` of a plane."""
        step, rest = divmod(i, STEP)
        return int(self._ones(level)[step]) + (int(self._step(level, step)[:rest].sum()) if rest else 0)

    def _select(self, level: int, bit: int, k: int) -> int:
        """The place of the ``k``-th (from 0) such bit of a plane."""
        ones = self._ones(level).astype(np.int64)
        before = ones if bit else np.arange(len(ones)) * STEP - ones
        step = int(np.searchsorted(before, k, "right")) - 1
        return step * STEP + int(np.flatnonzero(self._step(level, step) == bit)[k - int(before[step])])

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        value = 0
        for level, zeros in enumerate(self.zeros):
            ones, bit = self._rank(level, i), int(self._step(level, i // STEP)[i % STEP])
            value, i = value * 2 + bit, zeros + ones if bit else i - ones
        return value

    def _span(self, token: int, a: int, b: int) -> tuple[int, int]:
        if token >> len(self.zeros):
            return 0, 0
        for level, zeros in enumerate(self.zeros):
            ones_a, ones_b = self._rank(level, a), self._rank(level, b)
            a, b = (zeros + ones_a, zeros + ones_b) if token >> (len(self.zeros) - 1 - level) & 1 else (a - ones_a, b - ones_b)
        return a, b

    def count(self, token: int, a: int = 0, b: int | None = None) -> int:
        """How often an id stands in ``[a, b)``."""
        a, b = self._span(token, a, self.tokens if b is None else b)
        return b - a

    def find(self, token: int, k: int) -> int:
        """The place of the ``k``-th (from 0) occurrence of an id."""
        a, b = self._span(token, 0, self.tokens)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level in range(len(self.zeros) - 1, -1, -1):
            bit = token >> (len(self.zeros) - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def all(self) -> np.ndarray:
        """All ids: the stable splits undone from the lowest plane up."""
        rest = np.zeros(self.tokens, np.uint16 if len(self.zeros) <= 16 else np.uint32)
        for level in range(len(self.zeros) - 1, -1, -1):
            packed = np.concatenate([np.frombuffer(self._section(p), np.uint8) for p in self.head["planes"][level]["pieces"]] or [np.zeros(0, np.uint8)])
            bits = np.unpackbits(packed, count=self.tokens, bitorder="little").view(bool)
            zeros = self.zeros[level]
            rest[zeros:] |= rest.dtype.type(1 << (len(self.zeros) - 1 - level))
            rest = _undealt(rest, bits, zeros)
        return rest.astype(np.uint32)


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> None:
    """Write the token ids of ``docs (doc_id, text)`` under ``path``, in ascending order of ``doc_id``, nulls first.

    Each document, also a null or empty one, ends with ``end_id``. A document is never cut: a shard has ``shard_tokens`` ids or more
    only by its last document. Rows that share an id follow each other, by text. An empty table writes no shard. Other columns are
    not used.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, number = tokenizer(vocabulary), TaskContext.get().partitionId(), 0
        ids, sizes, names, held = [], [], [], 0

        def joined() -> np.ndarray:
            every = np.concatenate(ids)
            ids.clear()
            return every

        def shard() -> pa.RecordBatch:
            nonlocal sizes, names, held, number
            raw = pack(joined(), names, np.concatenate(sizes), part, number)
            sizes, names, held, number = [], [], 0, number + 1
            give_back()
            return pa.RecordBatch.from_arrays([pa.array([raw], pa.large_binary())], names=["shard"])

        for batch in batches:
            for a, b, data, offsets in blocks(*utf8(batch.column(1)), BLOCK):
                found, counts = coder.encode(data, offsets, end_id)
                ids.append(found)
                sizes.append(counts)
                names += batch.column(0).slice(a, b - a).to_pylist()
                held += len(found)
                give_back()  # the store's arrays are written anew with each block; what they leave would add up to several times the store
                if held >= shard_tokens:
                    yield shard()
        if names:
            yield shard()
        give_back()

    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    # Arrow's binary becomes a string without a check of its bytes; one row a file.
    shards = ordered.mapInArrow(run, "shard binary").select(F.col("shard").cast("string"))
    shards.write.option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(part, number, place, doc_id, ids)`` of shards under ``path``: one row per document, ``ids`` with the end id."""
    return _read(spark, path, "ids array<int>", lambda ids: ids.astype(np.int32).tolist(), pa.list_(pa.int32()))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)``, one row per document: ids of all documents before it, its own, and the unsigned
    crc32 of its ids as little-endian unsigned 32-bit integers."""
    import zlib

    found = cut_lineage(_read(spark, path, "ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), pa.int64()))
    sums = found.groupBy("part", "number").agg(F.sum("n_tokens").alias("_n"))  # one row per shard
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("part").alias("_p"), F.col("number").alias("_q"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return found.join(starts, (F.col("part") == F.col("_p")) & (F.col("number") == F.col("_q"))).select(
        "doc_id", (F.col("_start") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def _read(spark: SparkSession, path: str, column: str, value, kind: pa.DataType) -> DataFrame:
    names = ["part", "number", "place", "doc_id", "begin", "n_tokens", column.split()[0]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                shard = Shard(raw.as_buffer().to_pybytes())
                ids, (docs, sizes) = shard.all(), shard.documents()
                ends = np.cumsum(sizes)
                n = len(docs)
                values = [value(ids[b - s:b]) for b, s in zip(ends.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array([shard.head["part"]] * n, pa.int32()), pa.array([shard.head["number"]] * n, pa.int32()),
                                                  pa.array(range(n), pa.int32()), pa.array(docs, pa.int64()), pa.array(ends - sizes, pa.int64()),
                                                  pa.array(sizes, pa.int64()), pa.array(values, kind)], names=names)
        give_back()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, f"part int, number int, place int, doc_id long, begin long, n_tokens long, {column}")
