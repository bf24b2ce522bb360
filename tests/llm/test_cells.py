"""Texts cut into cells: each distinct cell is encoded once, whatever stands around it."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from tallyweir.llm import pieces, token_files


def test_words_are_encoded_by_cut():
    encoder = token_files.WordEncoder(token_files.default_vocabulary_path())
    encoder.encode_batch(["Alpha, alpha;\nALPHA. alpha's 12 \"'s", "(alpha) 21"])
    assert set(encoder.words) == {"alpha", ",", ";", ".", "'s", "1", "2", "\"'", "s", "(", ")"}


def test_cuts_agree_with_the_library():
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    encoder = token_files.WordEncoder(token_files.default_vocabulary_path())
    parts = ["a", "K", "'", "'s", "'VE", "'re", "'r", "'lls", "''s", "\"'s", "'m1", "é", "É", "́", "ª", "\xad", "ǅ", "½", "中", "İ", " ", "\n", "\r\n", "<|endoftext|>", "9'9"]
    random.seed(4)
    texts = ["", " ", *["".join(random.choices(parts, k=random.randint(0, 12))) for _ in range(5000)]]
    for start in range(0, len(texts), 700):
        part = texts[start : start + 700]
        assert encoder.encode_batch(part) == [np.array(e.ids, encoder.dtype).tobytes() for e in library.encode_batch(part, add_special_tokens=False)]


def test_another_pattern_goes_to_the_library(tmp_path):
    spec = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    path = tmp_path / "other.json"
    path.write_text(spec.replace("|'d|", "|'d|'em|"), encoding="utf-8")
    library, encoder = tokenizers.Tokenizer.from_file(str(path)), token_files.WordEncoder(str(path))
    texts = ["let 'em go, let'em", "I'd  say\n'em"]
    assert encoder.encode_batch(texts) == [np.array(e.ids, encoder.dtype).tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]


def test_chunks_end_where_no_piece_goes_on():
    model = pieces.PieceModel(pieces.default_model_path())
    pieces._digests(model, ["alpha, (alpha)\n12", "alpha;"])
    mark = pieces.MARK
    assert set(model.chunks) == {f"{mark}alpha", "alpha", ",", f"{mark}(", ")", "\n", "1", "2", ";"}


@pytest.mark.parametrize("told_apart", [pieces.TOLD_APART, 30])
def test_chunks_agree_with_the_library(monkeypatch, told_apart):
    monkeypatch.setattr(pieces, "TOLD_APART", told_apart)
    path = pieces.default_model_path()
    library, model = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceModel(path)
    parts = ["a", "alpha", "Don't", "é", "e\u0301", "中", "\u4e2d\u6587", "🙂", "𐍈", "\x00", "\ufffd", pieces.MARK, " ", "   ", "\n", "\t", "12", "....", "==", "(", "\xa0", "<s>", "</s>", "<0x41>"]
    random.seed(6)
    texts = [None, "", " ", *["".join(random.choices(parts, k=random.randint(0, 14))) for _ in range(4000)]]
    for start in range(0, len(texts), 500):
        part = texts[start : start + 500]
        for text, (n, ids_hash, decoded_hash) in zip(part, pieces._digests(model, part), strict=True):
            ids = [*library.encode(text or ""), library.eos_id()]
            listed = " ".join(map(str, ids)).encode()
            assert (n, ids_hash) == (len(ids), hashlib.sha256(listed).hexdigest())
            assert decoded_hash == hashlib.sha256(library.decode(ids).encode()).hexdigest()
            assert start or model.encode(text) == ids
