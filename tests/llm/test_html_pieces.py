"""The scan of a page against a pattern that says what a piece is, and its time on broken pages."""

import random
import re
import time

import pytest

from pulsegrid.llm import html_extract

PIECE = re.compile(
    r"<!--(?:.*?-->|.*)|<(script|style|textarea|iframe)(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>(?:.*?</\1(?=[\s/>])[^>]*>|.*)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|([^<]+)|<",
    re.DOTALL | re.IGNORECASE,
)


def by_pattern(page):
    for m in PIECE.finditer(page):
        if m[5] is not None or m[0] == "<":
            yield m[0], "", False, ""
        elif m[3] is not None:
            yield None, m[3].lower(), bool(m[2]), m[4]


PARTS = ["<p", "<", ">", "/", "</p>", "'", '"', " class=a", "text", "<!--", "-->", "<!", "<?x", "<script", "</script", "</SCRIPT >", "<style>", "</style>", " ", "\n", "<a href='x>y'>", "<b:c", "=", "é", "<div id=\"a'b\">", "<svg/>", "<textarea ", "</textarea>"]


def test_pieces_are_those_of_the_pattern():
    rng = random.Random(11)
    for _ in range(30_000):
        page = "".join(rng.choice(PARTS) for _ in range(rng.randrange(14)))
        assert list(html_extract.pieces(page)) == list(by_pattern(page)), page


def spent(page):
    began = time.process_time()
    sum(1 for _ in html_extract.pieces(page))
    return time.process_time() - began


@pytest.mark.parametrize("part", ["<p class='", "<a ", "<p class='\"", "</", "<!x ", "<script '", "<script>", "</script ", "<script>x</script ", "<", "<!--", "<p \"'>'", "&amp"])
def test_broken_pages_take_time_in_proportion(part):
    page = part * (1_000_000 // len(part))
    whole, half = spent(page), spent(page[: len(page) // 2])
    assert whole < 6 and whole < 4 * half + 0.5
    assert spent("<p>ok</p>" + page + "<p>after</p>") < 8
