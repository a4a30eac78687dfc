"""Main text of pages whose markup is easily misread."""

from __future__ import annotations

import time

import pytest

from burnwatch.llm import html_text


def test_letters_that_grow_when_lowered():
    page = "<title>" + "İ" * 40 + "</TITLE><article><script>x</Script><p>İlk söz, burada.</p><p>Son söz.</p></article>"
    assert html_text.main_text(page) == "İlk söz, burada.\n\nSon söz."


@pytest.mark.parametrize(
    "outer",
    ['div class="overflow-hidden"', 'div class="no-sidebar"', "div class='x with-sidebar'", 'div class="header-fixed"', "form action='/'", "div class=sidebar", "div title='is hidden here'"],
)
@pytest.mark.parametrize("inner", ["article", 'article class="post overflow-hidden"', "main", "div class=x"])
def test_one_word_on_an_outer_tag(outer, inner):
    tags = outer.split()[0], inner.split()[0]
    page = f"<body><{outer}><{inner}><p>One text, here.</p><nav>no</nav></{tags[1]}></{tags[0]}></body>"
    wanted = "" if (outer, inner) == ("div class=sidebar", "div class=x") else "One text, here."
    assert html_text.main_text(page) == wanted


@pytest.mark.parametrize("outer", ["div hidden", 'div class="a" HIDDEN=""', "div style='display: none'", "div aria-hidden=true", "nav", "aside"])
def test_hidden_articles_stay_away(outer):
    page = f"<{outer}><article><p>No.</p></article></{outer.split()[0]}><p>Yes, this.</p>"
    assert html_text.main_text(page) == "Yes, this."


def test_articles_of_a_sidebar_beside_the_main_one():
    page = "<div class=sidebar><article><p>No.</p></article></div><div class=page-header><p>No.</p></div><article><p>Yes.</p></article>"
    assert html_text.main_text(page) == "Yes."


@pytest.mark.parametrize("name", ["entry-title", "post-title", "content-meta", "entry"])
def test_a_named_heading_is_not_the_content(name):
    page = f'<body><h1 class="{name}">Head</h1><p>A first sentence, with words.</p><p>A second one, with words.</p></body>'
    assert html_text.main_text(page) == "Head\n\nA first sentence, with words.\n\nA second one, with words."


def test_paragraphs_of_links_and_short_items_in_an_article():
    page = "<article><p class=x><a href=/>A linked sentence.</a></p><ul><li>short</ul><div>" + "Long, " * 90 + "</div><div class=y><a>more</a></div></article>"
    assert html_text.main_text(page).startswith("A linked sentence.\n\nshort\n\nLong, Long") and "more" not in html_text.main_text(page)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>One <script>x()</script>two three, four.</p>", "One two three, four."),
        ("<p>Let <math><mi>x</mi></math> be <svg/>ok.</p>", "Let x be ok."),
        ("<p>A <math><mfrac><mn>1</mn><mn>2</mn></mfrac><annotation encoding=tex>\\frac12</annotation></math> cup.</p>", "A 12 cup."),
        ("<p>a<noscript><p>no</p></noscript>b <svg><text>no</text></svg>c</p>", "ab c"),
    ],
)
def test_what_stands_inside_a_block_does_not_end_it(page, text):
    assert html_text.main_text(page) == text


LONG = "A long paragraph of text, with several words and marks. " * 5


def test_items_and_cells_beside_long_paragraphs_stay():
    inside = f"<p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><ul><li>one</li><li>two</li></ul><table><tr><td>cell</td></tr></table>"
    found = html_text.main_text(f"<body><div>{inside}</div><nav><a href=x>no</a></nav><ul>{'<li><a href=x>link</a></li>' * 9}</ul></body>")
    assert found.split("\n\n")[3:] == ["one", "two", "cell"]


def test_names_only_weight():
    """The same page with `article` renamed has the same text, and a long text beside an article is still under the threshold."""
    head = '<body><nav><a href=a>a</a></nav><div class="ad">Buy this now, please.</div>'
    page = f"{head}<article><h1>Head</h1><p>{LONG}</p><p>Of.</p></article><footer>c</footer></body>"
    wanted = f"Head\n\n{LONG.strip()}\n\nOf."
    assert html_text.main_text(page) == wanted
    assert html_text.main_text(page.replace("article", "div")) == wanted
    beside = f"<body><article><h1>Head</h1><p>{LONG}</p></article><div><p>Some other text, of few words.</p></div></body>"
    assert html_text.main_text(beside) == f"Head\n\n{LONG.strip()}"


def test_renaming_articles_changes_no_given_page(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    assert pages
    for page in pages:
        renamed = page.replace("<article", "<div").replace("</article", "</div")
        assert html_text.main_text(renamed) == html_text.main_text(page) != ""


@pytest.mark.parametrize("shape", ["siblings", "deep", "stray"])
def test_time_grows_with_the_page_only(shape):
    """Some hundred thousand bytes to a megabyte with 20,000 paths."""
    part = {"siblings": "<div class=c{0}>some text of block {0}, as it is</div>", "deep": "<div class=c{0}>t{0} ", "stray": "<div>t{0}</p></span></td></b>"}[shape]
    page = "<body>" + "".join(part.format(i) for i in range(20_000)) + "</body>"
    start = time.process_time()
    assert html_text.main_text(page)
    assert time.process_time() - start < 4
