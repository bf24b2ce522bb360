"""The operators with Python in the tasks: against the libraries, brute force, or held-out labels, with odd rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from tallyweir.llm import classifier, jaccard, links, pages, pieces, queries, repeats, token_files

ODD = [(900, None), (901, ""), (902, "x"), (903, " \n\t "), (904, "a b c d"), (905, "A b C d"), (906, "a b c d e"), (907, "ab " * 3000)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def texts(spark, folder):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()] + ODD


# --- pieces -----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces_equal_the_library(library):
    model = pieces.PieceModel(pieces.default_model_path())
    random.seed(1)
    raw = [p.replace(pieces.MARK, " ") for p in model.pieces]
    makers = [
        lambda: "".join(random.choice("abcdeaeiou the\n  ") for _ in range(random.randint(0, 60))),
        lambda: "".join(random.choice(raw) for _ in range(random.randint(1, 8))),
        lambda: "".join(random.choice("aab") for _ in range(random.randint(0, 60))),
        lambda: "".join(chr(random.choice([32, 0x2581, 10, 9, 0, 0xE9, 0x4E2D, 0x1F600, 65, random.randint(1, 0xD7FF)])) for _ in range(20)),
        lambda: " " * random.randint(0, 40) + random.choice(["the", "\n", "", "=", "-----------", "0000"]) * random.randint(1, 5),
    ]
    for make in makers:
        for _ in range(1500):
            text = make()
            assert model.encode(text, end=False) == library.encode(text), text
    for _ in range(3000):
        ids = [random.choice([0, 1, 2, random.randint(3, 258), random.randint(259, 31999)]) for _ in range(random.randint(0, 9))]
        assert model.decode(ids) == library.decode(ids), ids


def test_round_trip_digests(spark, texts, library):
    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()

    rows = {r.doc_id: r for r in pieces.round_trip_digests(frame(spark, texts)).collect()}
    for doc, text in texts:
        ids = [*library.encode(text or ""), 2]
        assert (rows[doc].n_tokens, rows[doc].ids_sha256) == (len(ids), sha(" ".join(map(str, ids))))
        assert rows[doc].decoded_sha256 == sha(library.decode(ids))


def test_pieces_columns(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "Hi  you", None)], "id int, text string, ids string")
    out = pieces.encode(df).orderBy("id").collect()
    assert out[0].ids == [2]
    assert [r.decoded for r in pieces.decode(pieces.encode(df)).orderBy("id").collect()] == ["", "Hi  you"]
    assert pieces.encode(df.limit(0)).count() == 0


# --- token files ------------------------------------------------------------------------------------------------------


def test_token_files(spark, texts):
    lib = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    random.seed(3)
    parts = ["a", "I'll", "don't", "É", "é", "ß", "İ", "Σ", " ", "  ", "\n", "\t", "\x85", "\xa0", "\x1c", "<|endoftext|>", "<|", "12", "²", "中", "🙂", "__!", "'T"]
    rows = texts + [(2000 + i, "".join(random.choice(parts) for _ in range(random.randint(0, 14)))) for i in range(1500)]
    rows += [(None, None), (5, ""), (5, "a"), (5, "a"), (-3, "z")]
    folder = token_files.shared_folder(spark, "test")
    index = token_files.write(frame(spark, rows), folder, end_id=1, partitions=5)
    assert len(index["parts"]) > 1
    back = token_files.read(spark, folder, index).orderBy("start").collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert len(back) == len(rows)
    start = 0
    for (doc, text), r in zip(ordered, back, strict=True):
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (doc, start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert index["ids"] == start


def test_token_files_of_nothing(spark):
    folder = token_files.shared_folder(spark, "test")
    index = token_files.write(frame(spark, []), folder)
    assert index["docs"] == 0 and token_files.checksums(spark, folder, index).count() == 0


# --- repeated strings -------------------------------------------------------------------------------------------------


def brute_repeats(rows, length):
    seen = Counter(b[k : k + length] for _, t in rows for b in [(t or "").encode()] for k in range(len(b) - length + 1))
    out = {}
    for doc, t in rows:
        b = (t or "").encode()
        mask = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                mask[k : k + length] = b"\1" * length
        runs = [(k, next((j for j in range(k, len(b)) if not mask[j]), len(b))) for k in range(len(b)) if mask[k] and (not k or not mask[k - 1])]
        out[doc] = (len(b), runs, bytes(x for x, m in zip(b, mask, strict=True) if not m))
    return out


def test_repeats_of_documents(spark, texts):
    got = repeats.without_repeats(frame(spark, texts)).collect()
    assert {r.id: (r.n_bytes, [(s["first"], s["end"]) for s in r.removed], bytes(r.kept)) for r in got} == brute_repeats(texts, 400)


def test_repeats_in_dense_texts(spark):
    random.seed(2)
    base = ["".join(random.choice("abcé ") for _ in range(random.randint(50, 600))) for _ in range(12)]

    def piece():
        kind, b = random.random(), random.choice(base)
        return b if kind < 0.4 else b[random.randint(0, 40) : random.randint(41, 300)] if kind < 0.7 else "".join(random.choice("xyz") for _ in range(random.randint(0, 30)))

    rows = [(i, "".join(piece() for _ in range(random.randint(0, 4)))) for i in range(250)]
    rows += [(1000, None), (1001, ""), (1002, "a" * 3000), (1003, "ab" * 700), (1004, "b" * 81), (1005, "a" * 79), (1006, "ab" * 40)]
    got = repeats.without_repeats(frame(spark, rows), length=80, reach=40).collect()
    assert {r.id: (r.n_bytes, [(s["first"], s["end"]) for s in r.removed], bytes(r.kept)) for r in got} == brute_repeats(rows, 80)
    assert repeats.without_repeats(frame(spark, [])).count() == 0
    both = repeats.repeat_digests(frame(spark, [(None, "q" * 500), (None, "r" * 100)])).orderBy("n_bytes").collect()
    assert [r.id for r in both] == [None, None] and [len(r.removed) for r in both] == [0, 1]


def test_phrases_do_not_depend_on_segments(monkeypatch):
    raw = np.frombuffer(random.Random(4).randbytes(5000), np.uint8)

    def strings():
        return sorted((int(f), int(la)) for g, c, first, last in repeats.phrases(raw) for f, la in zip(first, last, strict=True))

    whole = strings()
    assert whole[0][0] == 0 and whole[-1][1] == 5000 - 400 and all(a[1] + 1 == b[0] for a, b in itertools.pairwise(whole))
    monkeypatch.setattr(repeats, "SEGMENT", 700)
    cut = strings()
    assert cut[0][0] == 0 and cut[-1][1] == 4600 and all(a[1] + 1 == b[0] for a, b in itertools.pairwise(cut))


# --- Jaccard components -----------------------------------------------------------------------------------------------


def gram_set(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", w) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = [(d, gram_set(t)) for d, t in rows]
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, s), (b, t) in itertools.combinations(sets, 2):
        both = len(s & t)
        if s and t and 100 * both >= 75 * (len(s) + len(t) - both):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return {d: (len(s), root(d)) for d, s in sets}


def test_components_of_documents(spark, texts):
    got = jaccard.jaccard_components(frame(spark, texts)).collect()
    assert {r.id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts)


def test_components_of_many_near_copies(spark):
    random.seed(11)
    vocabulary = [f"w{i}" for i in range(4000)]
    base = [random.choice(vocabulary) for _ in range(90)]
    rows = []
    for i in range(260):
        words = list(base)
        for _ in range(random.randint(0, 5)):
            words[random.randrange(90)] = random.choice(vocabulary)
        rows.append((i, " ".join(words[: random.randint(70, 90)])))
    passage = " ".join(random.choice(vocabulary) for _ in range(40))
    rows += [(1000 + i, passage + " " + " ".join(random.choice(vocabulary) for _ in range(random.randint(4, 40)))) for i in range(120)]
    rows += [(2000 + i, "same text of many words in one row") for i in range(50)] + ODD
    got = jaccard.jaccard_components(frame(spark, rows)).collect()
    assert {r.id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)
    assert jaccard.jaccard_components(frame(spark, [])).count() == 0


def test_divide_skip():
    random.seed(5)
    for _ in range(300):
        lists = [sorted(random.sample(range(40), random.randint(0, 30))) for _ in range(random.randint(1, 12))]
        least = random.randint(1, len(lists))
        seen = Counter(x for ids in lists for x in ids)
        for n_long in range(len(lists) + 1):
            assert jaccard.t_occurrence(lists, least, n_long) == {x: n for x, n in seen.items() if n >= least}


def test_components_of_chains(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)] + [(200, 300 + i) for i in range(50)]
    out = {r.id: r.component for r in links.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {out[i] for i in range(41)} == {0} and {out[i] for i in (100, 101, 103)} == {100} and out[349] == 200


# --- pages ------------------------------------------------------------------------------------------------------------


def test_simple_tree_matching():
    def tree(x):
        return pages.measured(pages.parse(x))

    a, b = tree("<div><p>1<p>2<ul><li>x</ul></div>"), tree("<div><p>1<h2>n</h2><p>2<ul><li>x<li>y</ul></div>")
    pairs = pages.align(a, b)
    assert sorted(pairs.values()) == sorted(set(pairs.values())) and len(pairs) == 6
    assert pages.match_size(a, b, {}) == 6


def test_page_text(spark):
    def page(i):
        return (
            f'<body><div id=top>My Site</div><ul class="menu"><li><a href=x>a{i}</a></ul><div><h1>T{i}</h1><p>Hello <b>bold</b>{i} &amp; x<br>y'
            f'<p>second{i}<div class=tagline>Read our terms</div></div><div class="comments"><p>c{i}</p></div><form>f</form><script>var x="<p>"</script></body>'
        )

    rows = [(i, f"http://h/{i}", page(i)) for i in range(8)]
    rows += [(100, None, None), (101, "x", ""), (102, "http://o/q", "<p>unclosed <a"), (103, "http://q/q", "a < b <3 x"), (102, "http://o/q", "<p>unclosed <a")]
    rows += [(104, "http://z/1", "<html><article><header><h1>Head</h1></header><p>one&nbsp; two &lt;&#233;<aside>no</aside><li>three</article><footer>f</footer>")]
    df = spark.createDataFrame([(*r, "kept") for r in rows], "page_id long, url string, html string, host string")
    out = {r.page_id: r for r in pages.extract(df).collect()}
    assert all(out[i].text == f"T{i}\nHello bold{i} & x y\nsecond{i}" for i in range(8))
    assert (out[100].text, out[101].text, out[102].text, out[103].text) == ("", "", "unclosed <a", "a < b <3 x")
    assert out[104].text == "Head\none two <é\nthree" and out[104].host == "kept" and out[104].n_chars == len(out[104].text)
    assert pages.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "body, outer, article",
    [
        ("single no-sidebar", "", "post"), ("has-cookie-notice", "", "post"), ("", "", "post has-comments"), ("", "content with-sidebar", "post"),
        ("sidebar login", "", "post"), ("", "", "related"), ("", "content sidebar", "post"), ("ads", "widget", "share"),
    ],
)
def test_page_text_under_names_of_other_parts(body, outer, article):
    def text(inner):
        return "\n".join(pages.blocks(pages.measured(pages.parse(f'<html class="{body}"><body class="{body}">{inner}</body></html>')), set()))

    rest = '<div class="comments"><p>late</p></div><div class="cookie-banner">ok?</div>'
    assert text(f'<div class="{outer}"><article class="{article}"><h1>Head</h1><p>Body of the text.</p>{rest}</article></div>{rest}') == "Head\nBody of the text."
    assert text(f'<div class="no-sidebar with-{article}"><h1>Head</h1><p>Body.</p></div>{rest}') == "Head\nBody."
    assert text(f'<div><p>Body of the page.</p></div><div id="comments"><article class="{article}">late</article></div>') == "Body of the page."
    assert text(f'<main class="{article}"><p>Body.</p></main>') == "Body." and text("<p>a</p><article hidden>b</article>") == "a"


def test_page_text_of_several_layouts(spark):
    def first(i):
        return f'<body><div class="top"><div>Our motto</div></div><div class="post"><p>One {i} text</p></div></body>'

    def second(i):
        return f'<body><section><p>Other motto</p></section><section class="entry"><h2>Head {i}</h2><p>Two {i}</p></section></body>'

    rows = [(0, "http://h/0", ""), (1, "http://h/1", "<html><body></body></html>"), (2, "http://h/2", "<body><h1>Error 500</h1></body>")]
    rows += [(10 + i, f"http://h/{i}", first(i)) for i in range(9)] + [(30 + i, f"http://h/{i}", second(i)) for i in range(9)]
    out = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (out[0], out[1], out[2]) == ("", "", "Error 500")
    assert all(out[10 + i] == f"One {i} text" and out[30 + i] == f"Head {i}\nTwo {i}" for i in range(9))


def test_page_text_of_near_copies(spark):
    same = "".join(f"<p>Constant paragraph {k} of the article, in every copy of it.</p>" for k in range(4))
    kept = "\n".join(f"Constant paragraph {k} of the article, in every copy of it." for k in range(4))

    def rows(host, first, page, n=12):
        return [(first + i, f"http://{host}/{i}", page(i)) for i in range(n)]

    data = rows("a", 0, lambda i: f"<body><div>Motto</div><article><p>Seen {i} times</p>{same}</article></body>")
    data += rows("b", 100, lambda i: f"<body><div><p>Seen {i} times</p>{same}</div></body>")
    data += rows("c", 200, lambda i: f"<body><div>Motto of c</div><div><p>Heading</p>{same if i < 10 else f'<p>Another text, number {i}</p>' * 4}</div></body>")
    data += rows("d", 300, lambda i: f"<body><article><h2>Summary</h2><p>Text {i}</p></article></body>")
    out = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert all(out[i] == f"Seen {i} times\n{kept}" and out[100 + i] == f"Seen {i} times\n{kept}" for i in range(12))
    assert all(kept in out[200 + i] for i in range(10)) and all(out[300 + i] == f"Summary\nText {i}" for i in range(12))


# --- classifier -------------------------------------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    rows = queries.op10_quality_score(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (rows.predicted == rows.quality).mean() > 0.97 > rows.quality.mean() + 0.05


def test_classifier_without_labels_and_odd_rows(spark):
    docs = frame(spark, [(1, None), (2, ""), (3, "some words"), (3, "some words")])
    labels = spark.createDataFrame([(3, 1), (3, 0), (9, 1), (1, None)], "doc_id long, quality int")
    none = classifier.fit(docs, labels.limit(0))
    assert {r.score for r in classifier.score(docs, none).collect()} == {0.5}
    some = classifier.fit(docs, labels)
    out = classifier.score(docs.withColumn("score", F.lit("old")), some).collect()
    assert len(out) == 4 and all(0 <= r.score <= 1 for r in out)
    assert classifier.score(docs.limit(0), some).count() == 0
