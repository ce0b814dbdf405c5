"""Regions of pages: what the clusters of ratios choose, and what names leave out."""

import numpy as np
import pytest

from strandline.llm import html_extract

TEXT = ["The river carried small boats past quiet villages while farmers worked in the warm fields.", "Children sang of summer near old stone walls, and nobody hurried home before the evening came.", "Short.", "A last paragraph ends the story with a calm and rather long sentence about the weather."]
ARTICLE = "".join(f"<p>{t}</p>" for t in TEXT)
LINKS = "".join(f"<div><a href='/{i}'>Go {i}</a> <a href='/x'>more</a></div>" for i in range(9))
WANT = "\n".join(TEXT)


@pytest.mark.parametrize(
    "page",
    [
        f"<body><nav>Menu</nav><div class='layout with-sidebar'>{ARTICLE}</div></body>",
        f"<body><div id='page-header-below' class='content'>{ARTICLE}</div><footer>f</footer></body>",
        f"<body><div class='post comments-enabled'>{ARTICLE}</div><div class='comment-list'><p>I think that this is long enough to be read as a text.</p></div></body>",
        f"<body><form action='/'><div class='site-header'>Top</div><div>{ARTICLE}</div></form></body>",
        f"<body><article>{ARTICLE}</article><form><p>Your name and your mail, please</p></form></body>",
        f"<body><div class='main-nav'>Start</div><div>{ARTICLE}</div><div class='cookie-notice'>We use cookies on this page, as you may know.</div></body>",
        f"<main>{ARTICLE}<div id='comments'><article class='comment'><p>A comment that is long enough to look like a paragraph of text.</p></article></div></main>",
        f"<body>{LINKS}<div><section>{ARTICLE}</section></div>{LINKS}</body>",
    ],
)
def test_article_is_kept(page):
    assert html_extract.main_text(page) == WANT


def test_parts_of_an_article_stay():
    inside = ARTICLE.replace("<p>Short.</p>", "<div class='share-price-report'><p>Short.</p></div>")
    assert html_extract.main_text(f"<body><article>{inside}</article></body>") == WANT
    assert html_extract.main_text(f"<body><div>{inside}</div></body>") == WANT
    assert html_extract.main_text(f"<div>{LINKS}</div><div><h2>Head</h2>{ARTICLE}</div>") == "Head\n" + WANT


def test_clusters_choose_the_region(monkeypatch):
    """Without the threshold all lines are content, and links without a name that tells what they are come along."""
    page = f"<body>{LINKS}<div>{ARTICLE}</div>{LINKS}</body>"
    assert html_extract.main_text(page) == WANT
    monkeypatch.setattr(html_extract, "content", lambda lines: np.ones(len(lines), bool))
    assert "Go 3" in html_extract.main_text(page)


def test_breaks_part_words_and_not_blocks():
    assert html_extract.main_text("<article><p>one<br>two <br/> three<hr>four</p><p>five</p></article>") == "one two three\nfour\nfive"


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "<p>A text deep inside of very many containers is found as well.</p>"
    long = "<article>" + "<p>many words in a very long page</p>" * 20_000 + "</article>"
    rows = [(1, "u", deep, "x"), (2, "u", long, "x"), (2, "u", long, "x"), (None, None, "<nav>m</nav>", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extract.extract(df).collect()
    assert [(r.page_id, r.n_chars) for r in sorted(got, key=lambda r: r.n_chars)] == [(None, 0), (1, 60), (2, 20_000 * 31 - 1), (2, 20_000 * 31 - 1)]
    assert html_extract.extract(df.limit(0)).count() == 0
