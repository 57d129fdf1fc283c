"""Packing's look-ups and pieces: less work per word, the tokenizer's ids."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from vocspark.llm import packing

ODD = ["İstanbul", "naïve×2÷3", "éclair", "<|endoftext|>", "don't,", "straße.%%%", "漢字", "a\u0085b", "ŉ", "½", "x" * 70, "É,$$$"]


@pytest.fixture
def name():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_words_of_one_text_are_told_plain_together(name, monkeypatch):
    tok, _, size = packing._tokenizer(name)
    asked, real = [], packing.plain
    monkeypatch.setattr(packing, "plain", lambda b: asked.append(b) or real(b))
    words = [f"word{i}ü.".encode() for i in range(2 * packing.JOINED_WORDS)]
    got = packing.encode_words(words, tok, size)
    assert len(asked) == 2
    words += [w.encode() for w in ODD]
    got |= packing.encode_words(words[-300:], tok, size)
    for w in words:
        assert np.frombuffer(got[w], "<u4").tolist() == tok.encode(w.decode(), add_special_tokens=False).ids


def test_gaps():
    assert packing.gaps_of([]) == packing.gaps_of([b"a"]) == []
    assert packing.gaps_of([None, b"", None, b"a", None]) == [0, 2, 4]


@pytest.mark.parametrize("end_id", [2, 70_000])
def test_pieces_of_whole_texts(name, end_id):
    tok = packing._tokenizer(name)[0]
    texts = [None, "", " \n", "a", "the " * 6, "the " * 7, "the " * 8, " ".join(ODD * 3), "the a the b " + ODD[0]]
    ids = [None, 5, 5, -1, 2**40, 7, 8, 9, 10]
    b = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts)], ["doc_id", "text"])
    got = [x for out in packing._pieces(name, 8, end_id)(iter([b])) for x in out.to_pylist()]
    want = []
    for d, t in zip(ids, texts, strict=True):
        every = [*tok.encode(t or "", add_special_tokens=False).ids, end_id]
        want += [(d, s, every[s:s + 8], len(every)) for s in range(0, len(every), 8)]
    assert len(got) == len(want)
    for x, (d, s, piece, total) in zip(got, want, strict=True):
        assert (x["doc_id"], x["start"], x["length"], x["doc_tokens"]) == (d, s, len(piece), total)
        assert x["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes())
        assert (x["ids"] is None) == (len(piece) == 8)
        if x["ids"]:
            assert np.frombuffer(x["ids"][1:], f"<u{x['ids'][0]}").tolist() == piece
