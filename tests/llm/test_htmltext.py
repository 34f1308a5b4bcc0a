"""Main text: pages with and without an article, markup with end tags left out, and a second extractor over whole tables."""

import html.parser
import os

import duckdb
import pytest

from factloom.llm import htmltext
from factloom.llm.htmltext import main_text

MENUS = (
    "<body><p>Menu</p>" + "".join(f"<p><a href=/{w}>{w}</a></p>" for w in ("Home", "News", "Contact")) + "<h1>A title</h1><p>The first paragraph says something.</p><p><a href=x>A link alone</a></p>"
    "<p>The second one says <a href=y>more</a>.</p><p>Ah.</p>" + "".join(f"<p><a href=/{w}>{w} more of it</a></p>" for w in ("See", "Read", "Buy")) + "<p>Closing words.</p></body>"
)


def test_windows_decide_without_an_article():
    assert main_text(MENUS) == "A title\nThe first paragraph says something.\nA link alone\nThe second one says more.\nAh.\nClosing words."


def test_windows_decide_in_an_article():
    page = "<article><h1>Title</h1><p>Some words of text here.</p><ul>" + "<li><a href=#>Another article to read</a>" * 4 + "</ul><p>The end.</p></article><div>Text outside of it.</div>"
    assert main_text(page) == "Title\nSome words of text here.\nThe end."


def test_without_sums_the_result_is_another(monkeypatch):
    monkeypatch.setattr(htmltext, "window_sums", lambda weights, *_: [1] * len(weights))
    assert "Home" in main_text(MENUS)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<html><title>x</title><p>Real text here", "Real text here"),
        ("<html><head><meta charset=utf-8><title>T</title><body><p>One.<p>Two.", "One.\nTwo."),
        ("<head><meta charset=utf-8>Words without a body", "Words without a body"),
        ("<article><p class=share>Share<p>Real text</article>", "Real text"),
        ("<article><p>A text.<section class='related-work'><h2>Related work</h2><p>Others did much, too.</section></article>", "A text.\nRelated work\nOthers did much, too."),
        ("<article><p>A text.<div class='related-posts'><p>Others did much, too.</div></article>", "A text."),
        ("<article><p>A text.<div class='ad-work'><p><a>Buy this now</a> and here.</div></article>", "A text."),
        ("<div class='page has-sidebar'><div class='sidebar-right'><main><p>Text in main.</p></main></div></div><div>Outside.</div>", "Text in main."),
        ("<table><tr><td>Cell one<td>Cell two<tr><td>x</table>", "Cell one\nCell two\nx"),
        ("<ul class=menu><li>a<li>b</ul><p>c", "c"),
        ("<ul><li class=ad>a<li>b</ul><p>c", "b\nc"),
        ("<p>a &amp; b&nbsp; c<p>d <b>e</b>f&#33;", "a & b c\nd ef!"),
        ("<article><p>Some words.</p><script>if (a < b) { t = '</p>' }</script><p>After it.</p><svg><text>no</text></svg></article>", "Some words.\nAfter it."),
        ("<article>Long enough.<article class=comment>I think so, too, and say it in many words.</article></article>", "Long enough."),
        ("<article>Hi.</article><div>A text outside of the article of more than fifty times as many characters: " + "and so on " * 30 + "</div>", None),
        ("<!-- <p>no</p> --><p>yes", "yes"),
        ("<nav>only a menu</nav>", ""),
        ("</p></div><p>1 < 2 & 3", "1 < 2 & 3"),
        ("", ""),
        (None, ""),
    ],
)
def test_pages(page, text):
    got = main_text(page)
    assert got == text if text is not None else got.startswith("Hi.\nA text outside")


def test_long_pages():
    inside = "<p>" + "word " * 200_000 + "</p>"
    deep = "<b>" * 20_000 + "<p>x" * 20_000
    assert main_text(f"<article>{inside}</article>") == "word " * 199_999 + "word"
    assert main_text(f"<article>{deep}</article>") == "\n".join(["x"] * 20_000)


class _Second(html.parser.HTMLParser):
    """Text of the article's blocks, by the standard library's parser: for pages that mark all else."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks = False, [[]]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag not in ("b", "i", "a", "em", "span"):
            self.blocks.append([])

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        if tag not in ("b", "i", "a", "em", "span"):
            self.blocks.append([])

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1].append(data)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_a_second_extractor_agrees_on_whole_tables(sf):
    path = f"/root/testdata/{sf}/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    for page_id, page in duckdb.sql(f"SELECT page_id, html FROM '{path}'").fetchall():
        second = _Second()
        second.feed(page)
        want = [" ".join("".join(b).split()) for b in second.blocks]
        assert main_text(page) == "\n".join(w for w in want if w), page_id
