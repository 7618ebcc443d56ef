"""Blocks of pages with skipped, unclosed and deeply nested elements."""

import re

import numpy as np
import pytest

from pulsegrid.llm import html_extract


def read(page):
    return [(b[0], b[1]) for b in html_extract.blocks_of(page)]


@pytest.mark.parametrize("tag", ["svg", "select", "object", "noscript", "template"])
def test_skipped_elements_end_where_they_end(tag):
    assert read(f"<p>a</p><{tag} class='i'><g>not this</g></{tag} ><p>the rest</p>") == [("a", 0), ("the rest", 0)]
    assert read(f"<div><{tag}></div><p>the rest</p>") == [("the rest", 0)]
    assert ("the rest", 0) in read(f"<p>a</p><{tag}><p>the rest</p>")


def test_self_closed_svg():
    assert read('<p>a</p><svg class="i"/><p>the rest</p>') == [("a", 0), ("the rest", 0)]
    blocks = html_extract.blocks_of("<p><a href='x'><svg><path d='m'/></svg>all linked</a></p>")
    assert [(b[0], b[3]) for b in blocks] == [("all linked", 10)]


def test_raw_text_goes_to_its_end():
    for tag in ("script", "style", "textarea", "iframe"):
        assert read(f"<p>a</p><{tag}>x <p>y</p></{tag}><p>b</p>") == [("a", 0), ("b", 0)]
        assert read(f"<p>a</p><{tag}>x <p>y</p>") == [("a", 0)]


@pytest.mark.parametrize("depth", [10, 2000, 20_000])
def test_deep_elements_keep_hints(depth):
    inside = "<div>" * depth + "<nav>menu</nav><article>story</article><p>plain</p>" + "</div>" * depth
    assert read(f"<article>{inside}<p>more</p></article><p>end</p>") == [("menu", -1), ("story", 1), ("plain", 1), ("more", 1), ("end", 0)]
    assert read("<aside>" + "<div>" * depth + "x" + "</div>" * depth + "<p>y</p></aside>") == [("x", -1), ("y", -1)]


SENTENCE = "the quick fox went over the hill, and it was seen by many people that day."


def page(i):
    menu = "".join(f"<li><a href=/{j}>word{j}</a></li>" for j in range(4 + i % 3))
    body = "".join(f"<p>Part {k}: {SENTENCE * (1 + (i + k) % 3)}</p>" for k in range(3 + i % 4))
    return f"<body><nav><ul>{menu}</ul></nav><div class='ad'>Buy number {i} now.</div><article><h1>Story {i} of them</h1>{body}<p>So it is.</p></article><footer>&copy; {i} all of us</footer></body>"


@pytest.fixture(scope="module")
def model(spark):
    return html_extract.fit(spark.createDataFrame([(page(i),) for i in range(40)] * 2, "html string"), "html", 60)


def test_the_cut_mends_what_the_classifier_gets_wrong(model):
    """No class names, no semantic tags: single blocks look wrong, their neighbours in the DOM tell."""
    linked = f"<p><a href=x>{SENTENCE[:30]}</a></p>"
    plain = f"<div><ul><li><a href=1>Home</a></li><li>Read all of it.</li><li><a href=2>About</a></li></ul></div><div><h1>A title</h1><p>A {SENTENCE}</p>{linked}<p>Ok</p><p>B {SENTENCE}</p></div><div>&copy; 2020 | us</div>"
    blocks = html_extract.blocks_of(plain)
    truth = [b[0] not in ("Home", "Read all of it.", "About", "© 2020 | us") for b in blocks]
    weights = html_extract.START.copy()
    alone, cut = html_extract.labelled(blocks, weights, 2.0)
    assert alone.tolist() != truth and cut.tolist() == truth
    fitted = html_extract.labelled(blocks, *model)[1]
    assert fitted.tolist() == truth


def test_hints_do_not_decide_alone(model):
    """A hint can be outweighed: the cost of a block is finite and below what its neighbours can bring up."""
    blocks = html_extract.blocks_of(f"<article><p>A {SENTENCE}</p></article>")
    shown, hidden = (html_extract.features(b) @ model[0] for b in (blocks, html_extract.unhinted(blocks)))
    assert 0 < shown[0] - hidden[0] < 4 and abs(shown[0]) < 8


@pytest.mark.parametrize(
    "html, want",
    [
        (f"<nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>T</h1><p>A {SENTENCE}</p><p>Be.</p><div class=comments><p>C {SENTENCE}</p><p>Nice one.</p></div></article>", f"T A {SENTENCE} Be."),
        (f"<div class=content><h1>T</h1><p>A {SENTENCE}</p><ul><li>one point</li><li>two</li></ul></div><section id=comments><p>C {SENTENCE}</p></section><aside><p>D {SENTENCE}</p></aside>", f"T A {SENTENCE} one point two"),
        (f"<main><article><header><h1>T</h1><p>By Ann</p></header><p>A {SENTENCE}</p><div class='ad'>Buy {SENTENCE}</div><p>B {SENTENCE}</p><form>Name <button>Go</button></form></article></main>", f"T By Ann A {SENTENCE} B {SENTENCE}"),
        (f"<div class='cookie-notice'><p>We use cookies. {SENTENCE}</p></div><header><h1>Site</h1></header><article><p>A {SENTENCE}</p></article><footer><p>F {SENTENCE}</p></footer>", f"A {SENTENCE}"),
    ],
)
def test_pages_of_other_makes(model, html, want):
    assert html_extract.main_text(html, *model)[0] == want


def test_extraction_is_the_least_energy_over_all_labellings(spark, model):
    """The whole operator against brute force: costs and edges as defined, every labelling of every small page tried."""
    pages = [page(i).replace("class='ad'", "") for i in range(6)] + [re.sub("(nav|article|footer)>", "div>", page(i)) for i in range(3)] + ["<div>a<p>b.</p>c, d</div>" * 2, "", None]

    def brute(html):
        blocks = html_extract.blocks_of(html)[:14]
        costs = np.clip(html_extract.features(blocks) @ model[0], -6, 6) if blocks else []
        edges = html_extract.smoothness(blocks, model[1])
        best = min(range(1 << len(blocks)), key=lambda m: sum(abs(c) for i, c in enumerate(costs) if (c > 0) != bool(m >> i & 1)) + sum(w for i, j, w in edges if (m >> i & 1) != (m >> j & 1)))
        return " ".join(b[0] for i, b in enumerate(blocks) if best >> i & 1)

    docs = spark.createDataFrame([(i, "u", h, "x") for i, h in enumerate(pages)], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_extract.extract(docs.union(docs), model).collect()}
    assert got == {i: brute(h) for i, h in enumerate(pages)}


def test_distances_in_the_dom():
    steps = [b[6] for b in html_extract.blocks_of("<div><p>a</p><p>b</p><ul><li>c</li></ul></div><p>d</p>")]
    assert steps == [2, 2, 3, 4]


def test_fit_without_pages(spark):
    weights, strength = html_extract.fit(spark.createDataFrame([(None,)], "html string"), "html", 10)
    assert (weights == html_extract.START).all() and strength == 1.0
    assert html_extract.main_text(page(3), weights, strength)[0].startswith("Story 3 of them Part 0")
