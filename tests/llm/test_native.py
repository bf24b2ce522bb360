"""The operators made of DataFrame functions alone: against plain Python on whole texts, with odd rows."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from tallyweir.llm import decontaminate, licenses, pii, quality
from tallyweir.llm.text import covered, let, repeated_windows, words
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [(None, None), (1, None), (2, ""), (3, " \t\n\x0b "), (4, "one"), (5, "a b c d e " * 400), (6, "a b c d e " * 400), (6, "a b c d e " * 400)]


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.fixture(scope="module")
def texts(spark, folder):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    return rows + [(10_000 + i, t) for i, (_, t) in enumerate(ODD)]


def frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + extra)


def test_windows_and_cover(spark):
    rows = [("a b a b a b a b",), ("x y z",), ("p q r s t u v p q r s t",), ("",)]
    df = spark.createDataFrame(rows, "t string").select(let(words(F.col("t")), lambda w: repeated_windows(w, 5)).alias("s"))
    assert [r.s for r in df.collect()] == [[0, 1, 2, 3], [], [0, 7], []]
    assert [r[0] for r in df.select(covered(F.col("s"), 5)).collect()] == [8, 0, 10, 0]


def test_quality_measures(spark, texts):
    found = {r.doc_id: r for r in quality.ledger(frame(spark, texts)).collect()}
    for doc, text in texts:
        t = text or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = {k + j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(5)}
        r = found[doc]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r.n_lines, r.n_dup_lines, r.n_repeat_words) == (len(lines), len(lines) - len(set(lines)), len(hit))
        assert bool(r.failed_bits & quality.POLICIES["base"]) == (len(w) < 10 or 100 * len(hit) > 20 * len(w))


def test_quality_clashes_and_ablations(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, None, "y")], "doc_id int, text string, n_words string")
    rows = quality.ledger(df).orderBy("doc_id").collect()
    assert [r.n_words for r in rows] == [1, 0]
    cases = {(r.policy, r.rule): (r.n_failed, r.n_failed_alone) for r in quality.ablations(quality.ledger(df)).collect()}
    assert cases["base", "few_words"] == (2, 2) and cases["base", "repeated_words"] == (0, 0)
    assert quality.ledger(df.limit(0)).count() == 0


def test_quality_keeps_clean_texts_without_blanks_and_tables(spark):
    chinese = "\n".join("这是一篇没有空格的干净文章的第" + chr(0x4E00 + i) + "段" + "内容各不相同而且句子都很长" * 3 + chr(0x5E00 + i) for i in range(14))
    rows = [
        (1, chinese), (2, chinese + "\nhttps://example.org/" + "path/" * 12), (3, "\n".join(f"| name{i} | {i * 7} |" for i in range(20))),
        (4, "|name|value|\n|---|---|\n" + "\n".join(f"|n{i}|{i * 7}|" for i in range(20))), (5, "\n".join(f"a{i} | b{i} | c{i}" for i in range(20))),
        (6, " ".join(f"{i}" + "Zm9vYmFy" * 8 for i in range(12))), (7, "\n".join(f"x{i}### y{i}$$$ ||| |" for i in range(20))), (8, "\n".join(f"| #{i} | #{i}# |" for i in range(20))),
    ]
    passed = quality.ledger(frame(spark, rows)).withColumns({p: quality.passes(p) for p in ("base", "v1", "v3")}).collect()
    assert all(r.base for r in passed) and not any(r.v1 for r in passed if r.doc_id != 5)
    assert [r.doc_id for r in sorted(passed) if r.v3] == [1, 2, 3, 4, 5]


def brute_overlap(docs, items):
    win = set()
    for item, text in items:
        w = ITEM_WORD.findall(ascii_lower(text or ""))
        win |= {(item, tuple(w[i : i + 13])) for i in range(max(1, len(w) - 12)) if w}
    by = {}
    for item, x in win:
        by.setdefault(x, set()).add(item)
    sizes = {len(x) for x in by}
    out = {}
    for doc, text in docs:
        w = ITEM_WORD.findall(ascii_lower(text or ""))
        hit, ids = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if found := by.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    ids |= found
        out[doc] = (len(w), len(hit), sorted(str(i) for i in ids if i is not None), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("broadcast_rows", [decontaminate.BROADCAST_ROWS, 0])
def test_contamination(spark, folder, texts, broadcast_rows):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    items += [(900, "Öne"), (901, "tWo words"), (902, None), (903, ""), (None, "one"), (901, "two WORDS"), (904, "a b c d e " * 4)]
    docs = [*texts, (20_000, "öne Öne and two-words; one"), (20_001, "Two Words"), (20_002, items[0][1].upper() + " x " * 1000)]
    got = decontaminate.contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), broadcast_rows=broadcast_rows)
    expected = brute_overlap(docs, items)
    rows = got.collect()
    assert len(rows) == len(docs)
    assert {r.doc: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in rows} == expected


def test_contamination_empty(spark):
    none = frame(spark, [])
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.contamination(none, items).count() == 0
    assert [r.n_hit for r in decontaminate.contamination(frame(spark, [(1, "a b")]), items.limit(0)).collect()] == [0]


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, match):
    digits = [int(c) for c in match if c.isdigit() and c.isascii()]
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        doubled = [d * 2 - 9 * (d > 4) if i % 2 else d for i, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def test_base_spans(spark, texts):
    random.seed(7)
    rows = [(i, t) for i, (_, t) in enumerate(texts)]
    rows += [(50_000 + i, "".join(random.choice("a@._%+-0123456789 ()é😀\nb") for _ in range(random.randint(0, 90)))) for i in range(2000)]
    rows += [(60_000 + i, "é " + "".join(random.choice(["", "", " ", "-"]) + str(random.randint(0, 9)) for _ in range(random.randint(14, 21)))) for i in range(800)]
    rows += [(70_000, "1" * 30_000 + " x@" + "y" * 20_000), (70_001, "a@b.c " * 2000), (70_002, "+1 " + "(" * 20_000), (70_003, "a@b.c_d@e.f"), (70_004, "1.2.3.4.5.6.7.8")]
    found = pii.spans(frame(spark, rows), kinds=pii.BASE_KINDS).collect()
    for r in found:
        expected = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, r.text or "") if valid(k, m[0])]
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"]] == expected, r.text[:100]


def test_added_kinds_and_redaction(spark):
    rows = [
        (1, "IBAN DE89 3704 0044 0532 0130 00 or DE88370400440532013000"), (2, "SSN 123-45-6789, part 123-45-6789"),
        (3, "+4912345678@a.b.cd x"), (4, None), (5, "é a@b.co"),
    ]
    out = {r.doc_id: r for r in pii.redact(frame(spark, rows)).collect()}
    assert [s["kind"] for s in out[1]["spans"]] == ["iban"]
    assert out[1].redacted == "IBAN [IBAN] or DE88370400440532013000"
    assert out[3].redacted == "[EMAIL+PHONE] x" or out[3].redacted == "[PHONE+EMAIL] x"
    assert out[4].redacted is None and out[4]["spans"] == []
    assert out[5].redacted == "é [EMAIL]"
    clash = spark.createDataFrame([("a@b.co", 3)], "text string, spans int")
    assert pii.redact(clash).first().redacted == "[EMAIL]"
    assert pii.redact(frame(spark, [])).count() == 0


def test_license_versions_limits_and_bodies(spark):
    cc, gnu = "This work is licensed under a Creative Commons Attribution", "This work is licensed under the GNU "
    rows = [
        ("All rights reserved.", ["all-rights-reserved"]), (gnu + "General Public License, version 2", ["gpl-2.0"]), (gnu + "General Public License, version 3", ["gpl-3.0"]),
        (gnu + "Affero General Public License, version 3", ["agpl-3.0"]), (gnu + "Lesser General Public License, version 2.1", ["lgpl-2.1"]),
        (cc + " 4.0 International License", ["cc-by-4.0"]), (cc + "-NonCommercial-ShareAlike 4.0 International License", ["cc-by-nc-sa-4.0"]),
        (cc + "-ShareAlike 4.0 International License", ["cc-by-sa-4.0"]), (cc + "-NonCommercial-NoDerivatives 4.0 International License", ["cc-by-nc-nd-4.0"]),
        ("either version 2 of the License, GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", ["gpl-2.0"]),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ["isc"]),
        ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", ["mit"]),
        ("GNU General Public License, version 3, or Apache License, Version 2.0", ["apache-2.0", "gpl-3.0"]), ("GNU General Public License, version 4", []), ("CC BY-NC-SA 4.0", ["cc-by-nc-sa-4.0"]), ("CC0 1.0 Universal", ["cc0-1.0"]),
    ]
    out = {r.doc: r.licenses for r in licenses.scan(frame(spark, [(i, t) for i, (t, _) in enumerate(rows)])).collect()}
    assert out == {i: found for i, (_, found) in enumerate(rows)}
    assert all(len(ITEM_WORD.findall(t)) <= licenses.STRIDE for _, t, _ in licenses.TEMPLATES)


def test_license_scan(spark):
    word = " filler"
    rows = [
        (1, "x" + word * 40 + " Licensed under the Apache License, Version 2.0." + word * 40), (2, None), (3, ""), (4, "the MIT License"),
        (5, "Released under the MIT License. " * 200), (None, "licensed UNDER cc by-nc 4.0"), (6, "Licensed under CC BY 4.0"), (8, "SPDX-License-Identifier: GPL-3.0-or-later"), (9, "This tool is licensed under GPLv3."), (10, "CC BY-SA 3.0 and CC BY-NC 4.0"),
        (7, "Permission is hereby granted, free of charge, to any person obtaining one copy of this software and associated documentation files"),
    ]
    out = {r.doc: r.licenses for r in licenses.scan(frame(spark, rows)).collect()}
    assert out == {1: ["apache-2.0"], 2: [], 3: [], 4: [], 5: ["mit"], None: ["cc-by-nc-4.0"], 6: ["cc-by-4.0"], 7: ["mit"], 8: ["gpl-3.0"], 9: ["gpl-3.0"], 10: ["cc-by-nc-4.0", "cc-by-sa-3.0"]}
    own = spark.createDataFrame([("two", "only two"), ("none", ""), ("null", None)], "license string, text string")
    asked = spark.createDataFrame([("a-2", "the a license version 2 of it", "version 2"), ("long", "w " * 30 + "x y z", "x y z|w w")], "license string, text string, required string")
    texts = frame(spark, [(1, "The A license, version 2 of it"), (2, "The A license, version 3 of it"), (3, "w " * 30 + "x y z")])
    assert {r.doc: r.licenses for r in licenses.scan(texts, asked).collect()} == {1: ["a-2"], 2: [], 3: ["long"]}
    assert [r.licenses for r in licenses.scan(frame(spark, [(1, "Only two."), (1, "Only two.")]), own).collect()] == [["two"]]
    assert licenses.scan(frame(spark, [])).count() == 0
