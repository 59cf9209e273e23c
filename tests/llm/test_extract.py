import time

import pytest

from pairwell.llm.extract import extracted, main_text

LONG = ("word " * 40).strip()


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


CASES = [
    (None, ""),
    ("", ""),
    (" \n ", ""),
    ("plain text < 5 and > 3", "plain text < 5 and > 3"),
    ("<p>a", "a"),
    (page("<div>tiny</div>"), "tiny"),
    (
        page(
            "<header><h1>Site</h1></header><nav><a>x</a></nav><!-- ad --><main><header><h1>Title</h1></header>"
            "<p>A &amp; B&#432; &eacute;<p>C<br>D<aside>side</aside><p>E</main>"
            '<section class="comments"><article><p>hi</article></section><footer>f</footer>'
        ),
        "Title\nA & Bư é\nC D\nE",
    ),
    (
        page(
            f'<div id="top-nav"><a>Home</a> <a>News</a></div><div><h1>Head</h1><p>{LONG}</p><p>short</p></div>'
            f'<div class="cookieNotice">We use cookies {LONG}</div><div>© foot</div>'
        ),
        f"Head\n{LONG}\nshort",
    ),
    (
        page(
            '<script>var t="</p><article>";</script><article><p>one<form><p>f</form><p>two <a href="x>y">link</a> end'
            '<script>if(a<b){"</p>"}</script> tail<div class="ad-box">x</div>after \t\n &nbsp;all</article>'
        ),
        "one\ntwo link end tail\nafter all",
    ),
    (page("<article><table><tr><td>x<td>y</table><ul><li>1<li>2</ul></article>"), "x\ny\n1\n2"),
    (page('<article><h1>A<p><b>B <i>c</b> d</article><div class="ad">ad text</div>'), "A\nB c d"),
    (page('<p class="lead">shadow of a header download</p>'), "shadow of a header download"),
]


@pytest.mark.parametrize("html, expected", CASES)
def test_main_text(html, expected):
    assert main_text(html) == expected


def test_an_advert_that_never_closes_does_not_take_the_article():
    assert "text" in main_text(page('<p><div class="ad">never closed<article><p>text</p></article>'))


@pytest.mark.parametrize("html", ["<div ", "<p>", "<b>", '<a href="', "<!--", "<script>", "<script></script", "<", "<b></i>"])
def test_hostile_pages_take_linear_time(html):
    start = time.process_time()
    main_text(html * 20_000)
    assert time.process_time() - start < 10


def test_columns(spark):
    rows = [(k, html, "x") for k, (html, _) in enumerate(CASES)] + [(None, CASES[4][0], "y"), (0, None, "x")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = sorted((str(r.page_id), r.main_text, r.text) for r in extracted(pages).collect())
    assert got == sorted((str(i), main_text(h), t) for i, h, t in rows)
    assert extracted(pages.limit(0)).count() == 0
    assert sorted((str(r.page_id), r.text) for r in extracted(pages, text="text").collect()) == [(i, m) for i, m, _ in got]


NAMED = [
    '<div style="overflow:hidden" data-role="navigation"><p>{0}</p></div>',
    '<div><p><a href="/item?id=social">{0}</a> {0}</p></div>',
    '<div><p>{0} <a href="/a/hidden-gems">{0}</a></p></div>',
    '<div class="with-sidebar"><div><p>{0}</p></div><div class="sidebar">side</div></div>',
    '<div class="category-social"><section><article><p>{0}</p></article></section></div>',
    '<div class="page widget"><div id="ad">ad</div><article><p>{0}</p></article></div>',
]


@pytest.mark.parametrize("body", NAMED)
def test_one_word_does_not_drop_the_article(body):
    text = " ".join([LONG] * body.count("{0}"))
    assert main_text(page(body.format(LONG) + '<div class="comments">c</div>')) == text


def test_real_roles_and_names_still_count():
    for attributes in ('role="navigation"', "hidden", "aria-hidden=true", "class='x social'", "ID=sidebar"):
        assert main_text(page(f"<div><p>{LONG}</p></div><div {attributes}><p>{LONG[:100]}</p></div>")) == LONG


@pytest.mark.parametrize("order", [1, -1])
def test_long_text_beside_article_teasers(order):
    parts = [f"<div><h1>Head</h1><p>{LONG}</p><p>{LONG} end</p></div>", "<article><a href=x>More</a> teaser</article>" * 3]
    assert main_text(page("".join(parts[::order]))) == f"Head\n{LONG}\n{LONG} end"


def test_a_marked_article_with_a_surge_is_kept_whole():
    article = f"<article><h1>Title</h1><aside>x</aside><p>{LONG}</p><form>f</form><p><a href=x>link</a></p></article>"
    assert main_text(page(f"<div>before</div>{article}<div>after</div>")) == f"Title\n{LONG}\nlink"
    assert main_text(page(f"{article}<div><p>{LONG} outside</p></div>")) == f"Title\n{LONG}\nlink\n{LONG} outside"


def test_a_gap_inside_the_container_does_not_end_the_text():
    ad, foot = "<div class=ad>x</div>", "<div><p>© foot</p></div>"
    assert main_text(page(f"<div><p>{LONG}</p>{ad}<p>Short closing line.</p></div>{foot}")) == f"{LONG}\nShort closing line."
    body = f"<div><h1>Title</h1><p>2 May</p>{ad}<p>{LONG}</p><form>f</form><ul><li>one</ul><aside>a</aside>loose{ad}<p>end</div>"
    assert main_text(page(f"<div>top</div>{ad}{body}{ad}{foot}")) == f"Title\n2 May\n{LONG}\none\nloose\nend"


LONG = "The long paragraph of the article goes on and on with words that tell something about the matter at hand, as prose does."


@pytest.mark.parametrize(
    "page, expected",
    [
        # Names that parts of articles have as well: the text decides.
        (f'<article><p>{LONG}</p><section id="discussion"><h2>Discussion</h2><p>{LONG}</p></section></article>', [LONG, "Discussion", LONG]),
        (f'<article><p>{LONG}</p><div class="related-work"><p>{LONG}</p></div><p class="notice">{LONG}</p></article>', [LONG] * 3),
        (f'<article><p>{LONG}</p><div class="related"><a href="x">{LONG}</a><a href="y">{LONG}</a></div></article>', [LONG]),
        (f'<article><p>{LONG}</p><div class="comments"><p>{LONG} Thanks!</p></div><div class="ad">Buy</div></article>', [LONG]),
        # Inline parts of a sentence.
        (f"<article><p>{LONG}</p><p>See <label>this</label> and <math><mi>x</mi><mo>=</mo><mn>1</mn></math>.</p></article>", [LONG, "See this and x=1."]),
        # What is left out of an element does not end it, but menus and bare lines beside the article do not belong to it.
        (f"<div><div><p>{LONG}</p></div><div class=ad>x</div><div><p>Short closing line.</p></div></div>", [LONG, "Short closing line."]),
        (f"<div><div><h1>Title</h1></div><aside>side</aside><div><p>{LONG}</p></div></div>", ["Title", LONG]),
        (f"<div><div>Site name</div><nav>n</nav><div><p>{LONG}</p></div><footer>f</footer><div>copyright line</div></div>", [LONG]),
    ],
)
def test_what_belongs_to_an_article(page, expected):
    assert main_text(page).split("\n") == expected
