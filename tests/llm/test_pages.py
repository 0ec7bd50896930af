"""Main text of pages."""

import time
import tracemalloc

import pytest

from flawsieve.llm.html_extraction import extract, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
<article><h1>Title &amp; more</h1><p><b>First<br><p>Second   line,
with <i>in</i>line.</p><p>Third.</p><div class="comments"><p>A reader says hello, and more than that.</p></div></article>
<aside>Beside</aside><form><label>Name</label></form><div class="ad">Buy.</div><footer>&copy; us</footer></body></html>"""


def test_article():
    assert main_text(PAGE) == "Title & more\nFirst\nSecond line, with inline.\nThird."


def test_without_article():
    body = "".join(f"<p>Sentence {i}, which is long enough, goes on and on.</p>" for i in range(5))
    page = f"<body><div id='menu'><a>Home</a><a>About</a></div><div>{body}</div><div class=footer>x</div></body>"
    assert main_text(page).split("\n") == [f"Sentence {i}, which is long enough, goes on and on." for i in range(5)]


SENTENCES = [f"Sentence {i}, which is long enough, goes on and on." for i in range(5)]
TEXT = "".join(f"<p>{s}</p>" for s in SENTENCES)


def test_ratios_decide_inside_an_article():
    links = "<ul class='topics'><li><a href='/a'>One topic</a></li><li><a href='/b'>Two topics</a></li></ul>"
    bar = "<div class='tools'><a href='/t'>Tweet</a> <a href='/m'>Mail</a></div>"
    page = f"<body><article><h1>Title</h1>{TEXT}{links}{bar}<section><h2>Shop</h2><div class='x'><a>Best offers</a></div></section><ul><li>Two eggs</li><li>Flour</li></ul><p>See <a>this</a>.</p></article>"
    assert main_text(page).split("\n") == ["Title", *SENTENCES, "Two eggs", "Flour", "See this."]
    assert main_text("<main><h1>Only a title</h1></main>") == "Only a title"
    assert main_text("<article><p><a href='/'>Only a link.</a></p></article>") == "Only a link."


def test_names_are_weights():
    inner = f"<article>{TEXT}<section class='social-policy'><p>On policy, briefly.</p></section><div id='related-work'><p>Others did, too.</p></div><div class='share'><p>Share it.</p></div></article>"
    wanted = [*SENTENCES, "On policy, briefly.", "Others did, too."]
    for around in ("class='has-sidebar'", "id='no-comments'", "class='widget'", "class='page sidebar'"):
        assert main_text(f"<body><div {around}>{inner}</div><div class='ad'>Buy.</div></body>").split("\n") == wanted
    for element in ("div class='widget'", "form id='page'", "div class='content social'"):
        assert main_text(f"<body><{element}>{TEXT}</{element.split()[0]}></body>").split("\n") == SENTENCES
    assert main_text(f"<body><article>{TEXT}<div class='comments'><p>A reader, at length, says hello.</p></div></article>").split("\n") == SENTENCES


@pytest.mark.parametrize("name", [
    "reader-comments", "comments-section", "comment-list", "user-comments", "left-sidebar", "sidebar-right", "main-menu",
    "site-notice", "related-posts", "social-links", "share-buttons", "readerComments", "comments",
])
def test_compound_names(name):
    beside = f"<div class='x {name}'><p>Some reader, at some length, says this and that, and more.</p><p>Another, too.</p></div>"
    for page in (f"<article>{TEXT}{beside}</article>", f"<article>{TEXT}</article>{beside}", f"<div>{TEXT}</div>{beside}"):
        assert main_text(f"<body>{page}</body>").split("\n") == SENTENCES
    for prefix in ("no", "has"):
        assert main_text(f"<article><div id='{prefix}-{name}'>{TEXT}</div></article>").split("\n") == SENTENCES
    long = "<p>" + "A reader goes on, and on, and on. " * 20 + "</p>"
    assert main_text(f"<article><div>{TEXT * 20}</div><div class='{name}'>{long * 3}</div></article>").split("\n") == SENTENCES * 20


@pytest.mark.parametrize("tags", ["<div>", "<div class=ad>", "<p><b>", "<ul><li>", "<i><div><b>", "<article>", "<td><b>", "</i><b>", "<div></section>"])
def test_deep_pages(tags):
    def seconds(n):
        page = f"<i>{tags * (n // len(tags))}{TEXT}{'</i></td></section>' * (n // 20)}"
        tracemalloc.start()
        at = time.process_time()
        text = main_text(page)
        took, most = time.process_time() - at, tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert all(s in text for s in SENTENCES)
        return took, most

    (small, little), (large, much) = seconds(100_000), seconds(400_000)
    assert large < 12 * small + 0.5
    assert much < 6 * little and much < 1000 * 400_000


def test_awkward_pages(spark):
    rows = [(1, "u", None, 1), (2, None, "", 2), (3, "u", "<p", 3), (4, "u", "<article><p>cut off &am", 4), (None, "u", "<" * 5000, 5), (4, "u", "<article><p>cut off &am", 4)]
    got = {(r.page_id, r.text, r.n_chars) for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string, text long")).collect()}
    assert {(1, "", 0), (2, "", 0), (4, "cut off &am", 11)} <= got and len(got) == 5
