"""Grams of many texts at once, and links of blocks of candidates."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import xxhash

from tallyweir.llm import jaccard


def test_grams_of_many_texts_hash_each_word_once(monkeypatch):
    random.seed(32)
    parts = ["A", "b", "É", "ß", "\x1c", "\x85", "\xa0", " ", "  ", "\n", "\t\x0b", "\x0c\r", "İ", "中", "🙂", "Zz[", "\x00"]
    texts = [None, "", " ", "\n", *["".join(random.choices(parts, k=random.randint(0, 30))) for _ in range(800)], None, "end"]
    for a in range(0, len(texts), 9):
        some = pa.array(["another text before", *texts[a : a + 9]], pa.string()).slice(1)
        for text, found in zip(texts[a : a + 9], jaccard.gram_sets(some), strict=True):
            assert np.array_equal(found, jaccard.grams(text))
    assert jaccard.gram_sets(pa.array([], pa.string())) == []
    hashed = []
    monkeypatch.setattr(xxhash, "xxh3_64_intdigest", lambda word, real=xxhash.xxh3_64_intdigest: hashed.append(word) or real(word))
    jaccard.gram_sets(pa.array(["One two three four five six one two"] * 50))
    assert len(hashed) == 7 and set(hashed) == {b"one", b"two", b"three", b"four", b"five", b"six"}  # "two" ends a text once without a blank


def test_links_of_blocks_against_brute_force():
    random.seed(33)
    for _ in range(200):
        query = np.unique(np.array(random.choices(range(60), k=random.randint(1, 40)), np.uint64))
        block = [np.unique(np.array([g if random.random() < 0.9 else 99 for g in query.tolist()][: random.randint(0, 40)], np.uint64)) for _ in range(12)]
        both = [len(np.intersect1d(query, s)) for s in block]
        want = [i for i, s in enumerate(block) if len(s) and 100 * both[i] >= 75 * (len(query) + len(s) - both[i])]
        assert sorted(jaccard.linked(query, block)) == want
