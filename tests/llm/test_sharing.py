"""Candidates are counted on their short lists before whole texts are fetched for them."""

from __future__ import annotations

import random
from itertools import combinations

from tallyweir.llm import jaccard


def links(texts):
    """Linked pairs of texts, by their sets."""
    sets = {i: set(jaccard.grams(t).tolist()) for i, t in texts.items()}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) > 0}


def test_texts_are_fetched_for_pairs_that_can_link_only(spark, monkeypatch):
    random.seed(3)
    blocks = [[f"w{b}-{k}" for k in range(25)] for b in range(80)]
    dealt = [b for _ in range(4) for b in random.sample(range(80), 80)]
    texts = {i: " ".join(w for b in dealt[8 * i : 8 * i + 8] for w in blocks[b]) for i in range(40)}
    texts |= {100 + i: texts[i].replace(" ", f" new{i} ", 1) for i in range(5)}  # near copies
    rows = {"candidates": 0, "wanted": 0}
    plain = jaccard.stored_ids

    def watched(df, name):
        out = plain(df, name)
        if name in rows:
            rows[name] += out.count()
        return out

    monkeypatch.setattr(jaccard, "stored_ids", watched)
    found = jaccard.jaccard_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert links(texts) == {(i, 100 + i) for i in range(5)}
    assert {r.id: r.component_id for r in found} == {i: i % 100 for i in texts}
    assert rows["candidates"] > 40 and rows["wanted"] <= 2 * 5 + 2, rows


def test_no_linked_pair_is_left_out(spark):
    random.seed(5)
    texts = {}
    for i in range(12):  # chains that lose words at either end or change some, down to the threshold and below it
        words = [f"{random.choice('abc')}{random.randrange(40 + 60 * i)}" for _ in range(12 + 25 * i)]
        for k in range(12):
            cut = words[len(words) * k // 60 : len(words) - len(words) * (k % 3) // 40]
            texts[100 * i + k] = " ".join("z" if random.random() < 0.002 * k else w for w in cut)
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    first = jaccard.stored(jaccard._first_pass(docs), "sets")
    lists = jaccard._short_lists(docs, jaccard._rarity(first), jaccard.PERCENT, 4)
    true = links(texts)
    near = [(a, b) for a, b in combinations(sorted(texts), 2) if a // 100 == b // 100]
    kept = {(r.a, r.b) for r in jaccard._sharing(spark.createDataFrame(near, "a long, b long"), lists, jaccard.PERCENT).collect()}
    assert true <= kept and len(true) > 100 and len(kept) < len(near)
