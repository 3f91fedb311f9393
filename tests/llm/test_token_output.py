import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lamella.llm import token_output as T
from tests.llm.corpus import frame, texts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def odd():
    return [
        "  two  spaces \n and\nlines ", "tab\tone", "don't we'll 's", "<|endoftext|> a <|endoftext|>", "x <|endo", " nb sp em ", "a   b", "\x1cfs \x1c x", "é è 中文 字 😀 end",
        " lead", "trail ", " ", "   ", "\n", "a  b", "12 3 45a b6", "... !? a! b", "​ z ​", "a\r\n b",
    ]


def test_pieces_give_the_ids_of_whole_texts():
    plain, cached = Tokenizer.from_file(PATH), T.CachedEncoder(PATH)
    every = odd() + [t or "" for _, t in texts(6)]
    for _ in range(2):
        got = [np.frombuffer(x, cached.kind).tolist() for x in cached.encode(pa.array(every))]
        assert got == [plain.encode(t, add_special_tokens=False).ids for t in every]


def test_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "BLOCK_BYTES", 2000)
    rows = texts(7) + [(300 + i, t) for i, t in enumerate(odd())]
    out = T.write_tokens(frame(spark, rows), str(tmp_path / "c"), PATH)
    got = T.read_summaries(spark, out).collect()
    plain = Tokenizer.from_file(PATH)
    want = sorted(((i, plain.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0))
    assert len(got) == len(want)
    starts = {}
    for r in sorted(got, key=lambda r: r.start):
        starts.setdefault(r.doc_id, []).append((r.start, r.n_tokens, r.ids_crc32))
    at, seen = 0, {}
    for i, ids in want:
        seen.setdefault(i, []).append((len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [i for i, _ in want]
    assert {k: sorted(x[1:] for x in v) for k, v in starts.items()} == {k: sorted(v) for k, v in seen.items()}
    assert T.read_document(spark, out, 5) == [next(ids for i, ids in want if i == 5)]
    assert sorted(T.read_document(spark, out, 2)) == sorted(ids for i, ids in want if i == 2)


def test_other_dictionary_is_refused(spark, tmp_path):
    out = T.write_tokens(frame(spark, texts(8)), str(tmp_path / "c"), PATH)
    sha, _ = T._dictionary(spark, out)
    with pytest.raises(ValueError, match="needs dictionary"):
        T._inflater(sha, b"")("0" * 64, 1, b"")


def test_empty(spark, tmp_path):
    out = T.write_tokens(frame(spark, texts(8)).limit(0), str(tmp_path / "c"), PATH)
    assert T.read_summaries(spark, out).count() == 0


def test_any_mix_of_signs():
    """Texts of every kind of sign that the cuts look at, against the tokenizer itself."""
    signs = [" ", " ", "\n", "\t", "\r", "a", "B", "the", "'", "'s", "'ll", ".", ",", "1", "é", "×", "÷", "ǅ", "́", "中", "　", " ", " ", " ", "ड", "😀", "<|", "<|endoftext|>", "\x1c", "\x85", "​", "\x00", "가"]
    rng = random.Random(5)
    plain, cached = Tokenizer.from_file(PATH), T.CachedEncoder(PATH)
    every = ["".join(rng.choices(signs, k=rng.randrange(12))) for _ in range(4000)]
    got = [np.frombuffer(x, cached.kind).tolist() for x in cached.encode(pa.array(every))]
    for text, ids, want in zip(every, got, plain.encode_batch(every, add_special_tokens=False), strict=True):
        assert ids == want.ids, repr(text)


def test_other_pattern_is_encoded_whole():
    path, text = public_tokenizers.path("word_bpe_49k.json"), "Some words, and  more.\nEnd"
    assert np.frombuffer(T.CachedEncoder(path).encode(pa.array([text]))[0], "<u2").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
