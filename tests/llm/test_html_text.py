import random
import re
import time

import html
import pytest

from tablelens.llm.html_text import extract_main_text, main_text

LONG = "This sentence, like the next one, is long enough to count, and it has commas, too. " * 3


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<html><body></body></html>", ""), ("<nav><p>Menu, menu, menu</p></nav>", ""),
    ("<p>One &amp; two&nbsp;three</p>", "One & two three"),
    ("<article><h1>Head</h1><p>a <b>b</b>c\n d<br>e<p>f</article><footer>x</footer>", "Head a bc d e f"),
    ("<p>x</p><!-- <p>no</p> --><script>var t='</p>';</script><style>p{}</style>", "x"),
    ("<p>unclosed <b>bold", "unclosed bold"), ("text < 5 and > 3", "text < 5 and > 3"),
    ("<P CLASS='note'>UPPER</P>", "UPPER"), ("<p title=\"a>b\">q</p>", "q"),
])
def test_small_pages(page, text):
    assert main_text(page) == text


def test_boilerplate_goes_and_the_article_stays():
    page = f"""<html><head><title>T</title></head><body class="has-sidebar"><header><h1>Site, name, here</h1></header>
    <div id="site-menu"><a href=/>Home</a><a href=/b>Blog</a></div><div class="cookie-notice"><p>{LONG}</p></div>
    <div class="columns"><div class="content"><h2>Title</h2><p>First. {LONG}</p><div class="ad-box">Buy, buy, buy</div>
    <ul><li>point one</li><li>point two</li></ul><p>Last. {LONG}</p>
    <ul class="x"><li><a href=/1>related one</a></li><li><a href=/2>related two</a></li></ul></div>
    <aside><p>{LONG}</p></aside></div><form><p>{LONG}</p></form>
    <section id="comments"><div class="comment"><p>Reader, says, {LONG}</p></div></section><footer><p>{LONG}</p></footer></body></html>"""
    expected = f"Title First. {LONG}point one point two Last. {LONG}"
    assert main_text(page) == " ".join(expected.split())


ARTICLE = f"<h2 id=related-work>Related</h2><p>One. {LONG}</p><p>Two. {LONG}</p>"


@pytest.mark.parametrize("before, after", [
    (f'<div class="{name}">{tag}', f"{end}</div>")
    for name in ("content-sidebar-wrap", "layout-right-sidebar", "elementor-widget x", "overflow-hidden", "hidden md:block", "search")
    for tag, end in [("", ""), ("<main>", "</main>"), ("<article>", "</article>")]
])
def test_wrappers_with_marks_keep_their_article(before, after):
    page = f"<body>{before}{ARTICLE}{after}<div class='sidebar'><p>Not, this.</p></div></body>"
    assert main_text(page) == " ".join(f"Related One. {LONG} Two. {LONG}".split())


def test_widgets_of_one_article_stay():
    widgets = "".join(f"<div class='elementor-element elementor-widget'><p>{k}. {LONG}</p></div>" for k in range(6))
    assert main_text(f"<div>{widgets}</div>") == " ".join(f"{k}. {LONG}" for k in range(6)).replace("  ", " ").strip()


@pytest.mark.parametrize("piece, text", [
    ('<section id="discussion"><p>Talk.</p></section>', "Talk."), ('<h2 id="search-algorithm">Search</h2>', "Search"),
    ('<p>a <span class="search-highlight">b</span> c</p>', "a b c"), ('<p title="a hidden gem">d</p>', "d"),
    ('<p data-x="the hidden cost">e</p>', "e"), ("<p hidden>f</p>", ""), ('<p style="color:red;display:none">g</p>', ""),
    ('<div id="related"><a href=x>h</a></div>', ""), ('<div class="sidebar"><p>i</p></div>', ""),
])
def test_marks_inside_an_article(piece, text):
    page = f"<article><p>One. {LONG}</p>{piece}<p>Two. {LONG}</p></article>"
    assert main_text(page) == " ".join(f"One. {LONG} {text} Two. {LONG}".split())


def test_long_comments_do_not_hide_a_short_article():
    page = f"<div class='post'><p>Short, {LONG}</p></div><div id='comments' class='comments'>" + f"<div class=comment><p>{LONG}</p></div>" * 4 + "</div>"
    assert main_text(page) == " ".join(f"Short, {LONG}".split())


@pytest.mark.parametrize("head", [
    "<title>T</title><body>", "<title>T</title><meta charset=utf-8><body class=x>", "<title>T</title>", "<title>T</title></head><body>",
    "<title>T <b>x</b></title><link rel=x><script>1</script>", "<title>T<body>",
])
def test_a_head_without_end_tag_ends_at_the_body(head):
    assert main_text(f"<html><head>{head}<p>One, two.</p><p>Three.</p></html>") == "One, two. Three."


@pytest.mark.parametrize("before, after", [
    ("<form id=aspnetForm runat=server><input type=hidden><div>", "<button>Go</button></div></form>"),
    ("<form id=aspnetForm><main>", "</main></form>"), ("<form><fieldset>", "</fieldset></form>"),
    ("<form action=search><input name=q>", ""), ("<form action=search><input name=q><article>", "</article>"),
    ("<form><label>Mail</label><input></form>", ""),
])
def test_forms_around_the_article_keep_it(before, after):
    page = f"<body>{before}<p>One. {LONG}</p><p>Two. {LONG}</p>{after}</body>"
    assert main_text(page) == " ".join(f"One. {LONG} Two. {LONG}".split())


@pytest.mark.parametrize("pieces", [
    ["<h1>", "Title", "</h1><div><p>", f"A. {LONG}", "</p><p>", f"B. {LONG}", "</p></div>"],
    ["<h1>", "Title", "</h1><div><div><p>", f"A. {LONG}", "</p><p>", f"B. {LONG}", "</p></div></div>"],
    ["<div><p>", "Short, one.", "</p></div><div><p>", "Short two.", "</p></div>"],
    ["<div><p>", f"A. {LONG}", "</p></div><h2>", "Next", "</h2><div><p>", "B.", "</p></div>"],
    ["<p>", "Lead.", "</p><ul><li>", "one", "</li><li>", "two", "</li></ul><div><p>", f"A. {LONG}", "</p></div><pre>", "x = 1", "</pre><blockquote>",
     "Quote.", "</blockquote><table><tr><td>", "cell", "</td></tr></table>"],
    ["", "Loose text.", "<div><p>", f"A. {LONG}", "</p><p>", "B.", "</p></div>", "More <b>loose</b> text.", "<div><p>", f"C. {LONG}", "</p></div>"],
])
def test_pages_without_article_element_keep_their_whole_article(pieces):
    links = "<div><a href=x>Other</a> <a href=y>pages</a></div>"
    expected = " ".join(re.sub("<[^>]*>", "", " ".join(pieces[1::2])).split())
    body = "".join(pieces)
    for page in (body, f"{body}{links}", f"{links}{body}", f"<div>{links}</div>{body}{links}"):
        assert main_text(f"<body>{page}</body>") == expected


def test_sections_of_an_article_stay_together():
    page = f"<main><article><section><p>A. {LONG}</p></section><section><p>B.</p></section></article><article class=comment><p>C</p></article></main>"
    assert main_text(page) == " ".join(f"A. {LONG} B.".split())


def test_siblings_of_the_best_container_are_kept():
    page = f"<body><div><p>A. {LONG}</p><p>{LONG}</p></div><div><p>B. {LONG}</p></div><div><a href=/>c</a> <a href=/>d</a></div></body>"
    text = main_text(page)
    assert "A." in text and "B." in text and not text.endswith("d")


def test_hostile_pages_end():
    assert main_text("<a " * 30_000) == main_text("<a " * 30_000)
    assert main_text("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    assert len(main_text("<p>" + "word " * 400_000)) == 2_000_000 - 1


def test_given_pages_give_their_article(spark):
    rows = extract_main_text(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).collect()
    for row in rows:
        article = re.search(r"<article>(.*?)(</article>|$)", row.html, re.S)[1]
        plain = re.sub("<[^>]*>", "", re.sub("</?(p|h1|br)>", " ", article))
        assert row.text == " ".join(html.unescape(plain).split()) and row.n_chars == len(row.text)


def test_rows_nulls_and_clashing_names(frame):
    table = frame([(1, None, "old", 9), (None, "<p>a</p>", None, 9), (None, "<p>a</p>", None, 9)], "page_id long, html string, text string, N_CHARS int")
    rows = extract_main_text(table).orderBy("html").collect()
    assert [(r.text, r.n_chars) for r in rows] == [("", 0), ("a", 1), ("a", 1)] and len(rows[0]) == 4
    assert extract_main_text(table.limit(0)).count() == 0


@pytest.mark.parametrize("page", [
    "<b>x" * 250_000, "<div>" * 60_000 + "</span>" * 60_000 + "end", "<p><div>" + "<b>x" * 60_000 + "<p>y" * 60_000, "<a href=q>x" * 90_000,
    "<header>x" * 60_000, "<ul><li>x" * 60_000, "</b>" * 250_000, "<table><tr><td>x" * 40_000,
])
def test_a_megabyte_of_unclosed_or_unmatched_tags_takes_seconds(page):
    started = time.process_time()
    assert isinstance(main_text(page), str)
    assert time.process_time() - started < 5


def test_random_markup_never_fails():
    rng = random.Random(1)
    tags = "p div b a i span ul li h1 h2 table tr td article main header footer nav form section head body html blockquote pre br img em dl dt".split()
    for _ in range(3000):
        parts = []
        for _ in range(rng.randint(1, 60)):
            tag, kind = rng.choice(tags), rng.random()
            parts.append(f"<{tag}>" if kind < 0.45 else f"</{tag}>" if kind < 0.7 else rng.choice(["word, two words " * rng.randint(1, 9), "x", "\n"]))
        assert isinstance(main_text("".join(parts)), str)
