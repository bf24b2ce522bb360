"""Tree matching against brute force, and the parts of pages that are no main text."""

from __future__ import annotations

import random
from functools import lru_cache

import pytest

from tallyweir.llm import pages


def tree(rng, depth):
    node = pages.Node(rng.choice("abc"))
    if depth:
        node.content += [tree(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return node


def brute_match(a, b):
    """Largest match by trying every way to pair the children in order."""
    if (a.tag, a.names) != (b.tag, b.names):
        return 0
    xs, ys = a.children(), b.children()

    @lru_cache(None)
    def best(i, j):
        if i == len(xs) or j == len(ys):
            return 0
        return max(best(i + 1, j), best(i, j + 1), brute_match(xs[i], ys[j]) + best(i + 1, j + 1))

    return 1 + best(0, 0)


def test_tree_matching_against_brute_force():
    rng = random.Random(8)
    for _ in range(400):
        a, b = pages.measured(tree(rng, 3)), pages.measured(tree(rng, 3))
        assert pages.match_size(a, b, {}) == brute_match(a, b)
        if a.tag == b.tag:
            pairs = pages.align(a, b)
            assert len(pairs) == brute_match(a, b) and len(set(pairs.values())) == len(pairs)
            tags = {n.place: n.tag for n in pages.nodes(b)}
            assert all(tags[pairs[n.place]] == n.tag for n in pages.nodes(a) if n.place in pairs)


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<article><p>One <span class='ad'>Buy <b>now</b> this</span>two <a class='share' href='/s'>Share it</a></p></article>", "One two"),
        ("<article><p>One</p><p style='display: none'>gone</p><div><span hidden>gone</span>two</div></article>", "One\ntwo"),
        ("<article><p>Code <span class='comment'># kept</span></p></article>", "Code # kept"),
        ("<article><p>One</p><div class='related-stories'><a href='/x'>Other</a></div></article>", "One"),
        ("<article><h1>Own</h1><p>Body</p></article><article><h3><a href='/o'>Other story</a></h3><p>Teaser</p></article>", "Own\nBody"),
        ("<article><h2><a href='/a'>A</a></h2><p>x</p></article><article><h2><a href='/b'>B</a></h2><p>y</p></article>", "A\nx\nB\ny"),
        ("<div><p>Text</p><div class='thread'><p>A reader says</p></div><ul><li><a href='/1'>Source one</a></li></ul></div>", "Text\nSource one"),
        ("<article><p>Open <span class='ad'>never closed</p><p>next</p></article>", "Open\nnext"),
        ("<article><p>a</p>" + "<p>long text here</p>" * 3000 + "</article>", "a" + "\nlong text here" * 3000),
    ],
)
def test_parts_without_main_text(body, text):
    assert "\n".join(pages.blocks(pages.measured(pages.parse(f"<html><body>{body}</body></html>")), set())) == text


def test_constant_lines_inside_articles_need_many_pages(spark):
    def page(k, host):
        return f"<html><body><article><h1>Title {k}</h1><p>Read this and all our other {'stories' if k else 'news'} with one account</p><p>{f'word{k} ' * 40}</p></article></body></html>", host

    rows = [(k, f"http://big.org/{k}", page(1 + k, "big")[0].replace(f"Title {1 + k}", f"Title {k}")) for k in range(30)]
    rows += [(100 + k, f"http://few.org/{k}", page(1 + k, "few")[0]) for k in range(8)]
    out = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert all("one account" not in out[k] and out[k].startswith(f"Title {k}\nword") for k in range(30))
    assert all("one account" in out[100 + k] for k in range(8))  # eight pages are too few to tell
