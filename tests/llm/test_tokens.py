import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from threadloom.llm import tokens
from threadloom.llm.grams import utf8
from threadloom.session import shared_folder

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, "It's 12,5 <|endoftext|> x<|startoftext|>y < |", "áb  c\n\nd\te\x1cf\x85g h", "İSTANBUL ΟΔΟΣ ſ ﬁ", "日本語 テキスト 👩‍👩‍👧", "word " * 3000, "x" * 5000, "<|EndOfText|>"]


def expected(rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    start, out = 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("shard_tokens", [1, 5000, 10**9])
def test_round_trip_of_files(spark, docs, shard_tokens):
    rows = [(i * 3 % 17, t) for i, t in enumerate(ODD)] + [(None, "no id"), (40, "same id b"), (40, "same id a"), (41, "twice"), (41, "twice")]
    path = shared_folder(spark, "tokens")
    tokens.write_tokens(docs(rows), path, VOCABULARY, shard_tokens=shard_tokens)
    got = sorted(map(tuple, tokens.read_digests(spark, path).collect()), key=lambda r: r[1])
    assert got == expected(rows)
    ids = {(r.doc_id, len(r.ids)) for r in tokens.read_tokens(spark, path).collect()}
    assert ids == {(r[0], r[2]) for r in got}


def test_words_that_a_sum_of_powers_takes_for_equal(spark, docs):
    """Thue-Morse words and their opposites have equal polynomial hashes modulo any power of two; other words of one length besides."""
    rows = []
    for n in (64, 1024, 4096):
        bits = [bin(i).count("1") % 2 for i in range(n)]
        rows += [(len(rows), " ".join(["".join("ab"[b] for b in bits)] * 2)), (len(rows) + 1, "".join("ba"[b] for b in bits))]
    path = shared_folder(spark, "tokens")
    tokens.write_tokens(docs(rows), path, VOCABULARY)
    assert sorted(map(tuple, tokens.read_digests(spark, path).collect()), key=lambda r: r[1]) == expected(rows)


def test_a_cleared_word_store_gives_the_same_ids(monkeypatch):
    whole = tokens.WordTokenizer(VOCABULARY).encode(*utf8(pa.array(ODD, pa.string())), 1)
    monkeypatch.setattr(tokens, "WORDS_KEPT", 3)
    again = tokens.WordTokenizer(VOCABULARY)
    for i, text in enumerate(ODD):
        ids, n = again.encode(*utf8(pa.array([text], pa.string())), 1)
        place = whole[1][:i].sum()
        assert n[0] == whole[1][i] and (ids == whole[0][place:place + n[0]]).all()


@pytest.mark.parametrize("n", [1, 63, 512, 513, 70_000])
def test_wavelet_matrix(n):
    ids = np.random.default_rng(n).integers(0, 49_408, n).astype(np.uint32)
    ids[n // 3: n // 2] = 7
    shard = tokens.Shard(tokens.pack(ids, [1, None], np.array([n // 2, n - n // 2]), 0, 0))
    assert (shard.all() == ids).all()
    for i in range(0, n, max(1, n // 40)):
        assert shard[i] == ids[i]
    for token in {7, int(ids[0]), int(ids[-1]), 49_407, 1 << 20}:
        places = np.flatnonzero(ids == token)
        assert shard.count(token) == len(places)
        assert shard.count(token, n // 4, n // 2) == ((places >= n // 4) & (places < n // 2)).sum()
        for k in range(0, len(places), max(1, len(places) // 10)):
            assert shard.find(token, k) == places[k]
        with pytest.raises(IndexError):
            shard.find(token, len(places))
    assert shard.documents()[0] == [1, None]


def test_empty_table(spark, docs):
    path = shared_folder(spark, "tokens")
    tokens.write_tokens(docs([]), path, VOCABULARY)
    assert tokens.read_digests(spark, path).count() == 0


def test_words_that_differ_in_case_are_learnt_once():
    path = public_tokenizers.path("word_bpe_49k.json")
    coder, asked = tokens.WordTokenizer(path), []
    coded = coder._coded
    coder._coded = lambda words, alone: asked.extend(words) or coded(words, alone)
    texts = ["Thorn thorn THORN, thorn, Thorn", "THORN \u0130x Stra\u00dfe STRASSE", "<|ENDOFTEXT|> <|endoftext|> THORN"]
    for _ in range(2):
        raw = [t.encode() for t in texts]
        ids, sizes = coder.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 1)
        want = [[*coder.library.encode(t, add_special_tokens=False).ids, 1] for t in texts]
        assert ids.tolist() == sum(want, []) and sizes.tolist() == [len(w) for w in want]
    assert len(asked) == len(set(asked)) and sum(w.lower() == "thorn" for w in asked) == 1


def test_the_word_store_stays_small():
    """Idle workers keep the store beside all other stages: some 40 bytes a word, and none for long words."""
    texts = [" ".join(f"w{i:x}q{i * 7919 % 65536:x}" for i in range(a, a + 4_000)) for a in range(0, 40_000, 4_000)] + [" ".join("y" * 500 + str(i) for i in range(2_000))]
    coder = tokens.WordTokenizer(VOCABULARY)
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        for text in texts:
            ids, sizes = coder.encode(*utf8(pa.array([text], pa.string())), 1)
            assert ids.tolist() == [*coder.library.encode(text, add_special_tokens=False).ids, 1] and sizes.tolist() == [len(ids)]
            del ids, sizes
        assert tracemalloc.get_traced_memory()[0] - before < 80 * 40_000
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("kept", [0, 3, 40])
def test_words_of_one_hash_are_told_apart(monkeypatch, kept):
    monkeypatch.setattr(tokens, "word_hashes", lambda data, start, end: ((end - start) % 2).astype(np.uint64))
    monkeypatch.setattr(tokens, "WORDS_KEPT", kept)
    coder = tokens.WordTokenizer(VOCABULARY)
    texts = [*(t or "" for t in ODD), "ab ba cd Ab x y", "ba ab z", "y x ab dc"]
    for text in [*texts, *texts[::-1], *texts]:
        ids, sizes = coder.encode(*utf8(pa.array([text], pa.string())), 70_000)
        assert ids.tolist() == [*coder.library.encode(text, add_special_tokens=False).ids, 70_000] and sizes.tolist() == [len(ids)]


def whole(library, text):
    return [*library.encode(text, add_special_tokens=False).ids, 1]


class Listening:
    """The library, and what it was asked at once."""

    def __init__(self, library):
        self.library, self.texts = library, []

    def __getattr__(self, name):
        return getattr(self.library, name)

    def encode_batch_fast(self, texts, **more):
        self.texts += texts
        return self.library.encode_batch_fast(texts, **more)


def test_words_are_cut_at_marks_and_letters_go_without_special_tokens():
    coder = tokens.WordTokenizer(VOCABULARY)
    coder.library = Listening(coder.library)
    text = "thorn, thorn. (thorn) Thorn; thorn:thorn été, été Über über. слово! слово"
    ids, _ = coder.encode(*utf8(pa.array([text])), 1)
    assert ids.tolist() == whole(coder.library, text)
    letters = [t for t in coder.library.texts if any(c.isalpha() for c in t.replace(coder.mark, ""))]
    assert [sorted(t.split()) for t in letters] == [sorted(["thorn", "été", "Über", "über", "слово"])]


def test_cut_words_have_the_ids_of_whole_texts():
    """Beside marks: contractions, combining characters before and after, letters that become two when small, digits, special tokens, blanks of other kinds."""
    import random

    parts = ["a", "Z", "s", "t", "re", "'", "''", ",", ".", "\"", "=", "<", "|", ">", "-", "_", "1", "23", "é", "×", "÷", "İ", "ŉ", "́", "̸", "̇", "Σ", "ς", "ж", "҂",
             "ſ", "µ", "ª", "٠", "क़", "क़", "Å", "가", "가", "中", "，", " ", " ", "\x1c", "\x85", "\t", " ", "\n", "<|endoftext|>", "<|STARTOFTEXT|>", "\U0001f469‍"]
    rng = random.Random(5)
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 12))) for _ in range(4_000)] + [x + m + y for m in ",'.=" for x in parts for y in parts]
    for coder in (tokens.WordTokenizer(VOCABULARY) for _ in range(2)):
        for a in range(0, len(texts), 700):
            ids, sizes = coder.encode(*utf8(pa.array(texts[a:a + 700])), 1)
            want = [whole(coder.library, t) for t in texts[a:a + 700]]
            assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])
        rng.shuffle(texts)


def test_a_letter_that_becomes_several_characters_is_told_apart():
    """Small İ is a letter and a mark, U+0958 a letter and a sign: two splits each, though all are letters."""
    coder = tokens.WordTokenizer(VOCABULARY)
    words = ["x", "İz", "y", "aİb", "क़", "zz"]
    ids, sizes = coder._coded(words, False)
    want = [whole(coder.library, w)[:-1] for w in words]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


def test_other_tokenizers_are_not_cut():
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    library = Tokenizer.from_file(VOCABULARY)
    assert tokens._marks(library)[0x2C] and not tokens._marks(library)[[0x27, 0x3C, 0x7C, 0x3E, 0x61, 0x20]].any()
    usual = library.normalizer
    library.normalizer = normalizers.Sequence([normalizers.NFKD(), normalizers.Lowercase()])
    assert tokens._marks(library) is None
    library.normalizer = usual
    library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    assert tokens._marks(library) is None


def test_a_tokenizer_is_opened_in_little_memory():
    """Every worker opens one while the JVM's heap is full; the whole of the vocabulary's JSON in Python objects took some 20 MB."""
    tokens.WordTokenizer(VOCABULARY)
    tracemalloc.start()
    try:
        tokens.WordTokenizer(VOCABULARY)
        assert tracemalloc.get_traced_memory()[1] < 10_000_000
    finally:
        tracemalloc.stop()


def test_bits_are_dealt_in_runs(monkeypatch):
    monkeypatch.setattr(tokens, "RUN", 700)
    ids = np.random.default_rng(3).integers(0, 49_408, 10_001).astype(np.uint32)
    ids[:1500], ids[5000:6000] = 0, 65_535
    assert (tokens.Shard(tokens.pack(ids, [4], np.array([len(ids)]), 0, 0)).all() == ids).all()
