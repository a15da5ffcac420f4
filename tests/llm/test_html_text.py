import random
import time

import pytest

from emberline.llm.html_text import _tokens, blocks, extract_text

PAGES = "page_id long, url string, html string, text string"

FULL = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header><h1>Site</h1><p>A tagline of the site with enough words in it to look like text for all of us who read</p></header>
<nav><ul><li><a href="/">Home</a><li><a href="/n">News</a></ul></nav>
<div class="cookie-notice">We use cookies on this site to make it work better for you and for our many partners.</div>
<article class="post"><h2>Head &amp; line</h2><p>First para<b>graph</b> &lt;b&gt; with <a href="x">a link</a>&nbsp;and
 more.<p>Short.</p><!-- <p>comment</p> --><ul><li>one<li>two</ul><script>if (a<b) { x = "</p>" }</script>
<aside><p>Related: some very long text that would look like the main text of the article to a reader</p></aside>
<div class="ad-slot">Buy now</div><form><label>Name</label><input><button>Send</button></form><p>Last &#233;&#x1F600; one.</p>
<section id="comments"><article class="comment"><p>I think this is a great article and I read it twice on the way to work</p></article></section>
</article><div class="sidebar"><p>Side text</p></div><footer>&copy; x</footer></body></html>"""


def texts(spark, rows):
    return {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(rows, PAGES)).collect()}


def test_article_without_what_surrounds_it(llm):
    got = texts(llm, [(1, "u", FULL, "clash"), (2, "u", None, None), (3, None, "", None), (4, "u", "<article>cut off < here & there <b", None), (None, "u", "<main><p>x</p></main>", None)])
    assert got == {1: "Head & line First paragraph <b> with a link and more. Short. one two Last é😀 one.", 2: "", 3: "", 4: "cut off < here & there <b", None: "x"}


def test_pages_without_names_go_by_words_and_links(llm):
    long = "A paragraph that goes on for a while and has enough words to count as the main text of this page, we hope."
    page = f"<p><a href=1>one</a> <a href=2>two</a></p><p>{long}</p><p>{long}</p><p><a href=3>three</a></p>"
    assert texts(llm, [(1, "u", page, None)]) == {1: f"{long} {long}"}


def test_counts_and_repeats(llm):
    rows = [(1, "u", "<article><p>é 😀</p></article>", None)] * 2
    assert [(r["n_chars"], r["n_blocks"]) for r in extract_text(llm.createDataFrame(rows, PAGES)).collect()] == [(3, 1)] * 2
    assert extract_text(llm.createDataFrame([], PAGES)).collect() == []


def test_long_and_broken_markup_ends():
    assert blocks("<p>" * 20000 + "x")[0][0] == "x"
    assert blocks("<b>" * 5000 + "x" + "</i>" * 5000)[0][0] == "x"
    assert blocks("<script>never ends <p>x") == [] and blocks("a<br>b<!-- never ends") and blocks("<![CDATA[x]]>")[0][0] == "x"
    assert [b[0] for b in blocks('<a href="a>b" title=\'c>d\'>x</a> y')] == ["x y"]


def test_link_lists_in_an_article_go_and_linked_paragraphs_on_plain_pages_stay(llm):
    long = "A paragraph that goes on for a while and has enough words to count as the main text of this page, we hope."
    linked = f"{long} It has <a href=1>a link of many words that stand</a> in it too and goes on."
    menu = "<ul>" + "".join(f"<li><a href={i}>menu entry {i}</a>" for i in range(6)) + "</ul>"
    notice = "<p>Please read our terms before you go on to these pages.</p>"
    plain = linked.replace("<a href=1>", "").replace("</a>", "")
    rows = [
        (1, f"<article>{menu}<p>{long}</p><p>{linked}</p>{menu}<p>Short.</p><ul><li>one<li>two</ul><p>{long}</p>{menu}</article>", f"{long} {plain} Short. one two {long}"),
        (2, f"<div class=content><h2>Head</h2><p>{long}</p><p><a href=1>One linked line</a></p><p>{long}</p></div>", f"Head {long} One linked line {long}"),
        (3, f"<p>{long}</p><p>{linked}</p><p>{long}</p><p>It ends here.</p>{menu}", f"{long} {plain} {long} It ends here."),
        (5, f"<h1>The title</h1><p>{long}</p><p>{long}</p>", f"The title {long} {long}"),
        (6, f"{menu}<h1>The title</h1><p>{long}</p><p>{long}</p>", f"The title {long} {long}"),
        (4, f"{menu}{notice}{menu}<p>{long}</p><p>{long}</p>", f"{long} {long}"),
    ]
    assert texts(llm, [(i, "u", page, None) for i, page, _ in rows]) == {i: want for i, _, want in rows}


@pytest.mark.parametrize(
    "piece", ["<a", '<a "', "<a ' \"", "<!--", "</b", "<b>", "<b></i>", "<b><div><i></b>", "<a href=\"x", "<p class='a", "<script", "<![CDATA[", "<p", '<a <b "c" \'d\'', "&", "<a" + " " * 50]
)
def test_time_grows_with_the_page(piece):
    size = 200_000
    for page in (piece * (size // len(piece)), '<a "' + "'" * size, "<a " + '"' * (size + 1), piece * (size // len(piece)) + '">"', "<i>" * (size // 6) + piece * (size // len(piece) // 2)):
        start = time.process_time()
        blocks(page)
        assert time.process_time() - start < 5


def test_tags_end_as_a_search_from_each_of_them_says():
    def end(page, at):
        while at < len(page):
            if page[at] == ">":
                return at + 1
            if page[at] in "\"'" and page.find(page[at], at + 1) >= 0:
                at = page.find(page[at], at + 1)
            at += 1
        return None

    rnd = random.Random(5)
    for _ in range(3000):
        page = "".join(rnd.choice("<<a/>\"' =b") for _ in range(rnd.randint(1, 25)))
        want, at = [], 0
        while (at := page.find("<", at)) >= 0:
            begin = at + 1 + (page[at + 1 : at + 2] == "/")
            stop = end(page, begin) if page[begin : begin + 1].isalpha() else None
            if stop:
                want.append((at, stop))
            at = stop or at + 1
        assert [t[:2] for t in _tokens(page)] == want, page


def test_names_that_say_what_a_text_is_about_do_not_drop_it(llm):
    long = "A paragraph that goes on for a while and has enough words to count as the main text of this page, we hope."
    said = "<p>I think this is a great article and I read it twice on the way to work this morning.</p>"
    rows = [
        (f'<article class="post category-legal tag-social"><p>{long}</p></article>', long),
        (f'<div class="content social-impact"><p>{long}</p><p>{long}</p></div>', f"{long} {long}"),
        (f'<article><p>{long}</p><div class="reader-comments-section">{said}</div></article>', long),
        (f'<article><p>{long}</p><div class="user-comment-list">{said}</div><div id="comments2">{said}</div></article>', long),
        (f'<article><header><h1>The title</h1><p>By someone, on a day in May, five minutes to read all of it</p></header><p>{long}</p></article>', f"The title {long}"),
        (f'<main class="promo"><p>{long}</p></main>', long),
        (f'<article class="has-comments no-sidebar"><p>{long}</p><div class="share-bar">Share it with all your friends</div></article>', long),
        (f'<div class="content"><p>{long}</p><div class="content sidebar">{said}</div></div>', long),
        (f'<header class="top"><p>{long}</p></header><article><p>{long}</p><footer>{said}</footer></article>', long),
        (f'<div class="comment-thread"><article class="comment">{said}</article></div><article><p>{long}</p></article>', long),
    ]
    assert texts(llm, [(i, "u", page, None) for i, (page, _) in enumerate(rows)]) == {i: want for i, (_, want) in enumerate(rows)}
