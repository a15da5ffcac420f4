"""Main text of HTML pages: flat text blocks, classified by a decision tree over their neighbourhood."""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Elements whose content is no text.
SKIPPED = frozenset("script style noscript template svg math iframe object canvas audio video select textarea button head title".split())
#: Elements that never have content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Inline elements; all others end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements that are not the article by their kind.
ASIDE_TAGS = frozenset("nav footer aside form menu dialog".split())
#: Words in a class, id or role that say the same.
ASIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies copyright "
    "disclaimer discussion disqus footer footnav form gdpr legal login menu menubar modal nav navbar navigation newsletter notice notices "
    "overlay pager pagination paywall popup privacy promo promoted promotion recommended related reply replies respond search share sharing sidebar signup "
    "skip social sponsor sponsored subscribe subscription tags toc toolbar topbar widget widgets".split()
)
#: These count as comments wherever the article starts.
COMMENT_NAMES = frozenset("comment comments commentlist discussion disqus reply replies respond".split())
ARTICLE_NAMES = frozenset("article main post story entry content body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that the start of another of their kind closes.
SELF_CLOSING = frozenset("p li dt dd td th tr option".split())

#: A tag without a ``<`` in it whose quotes are closed, as nearly all are.
_PLAIN = re.compile(r"""<(/?)([a-zA-Z][^\s/>"'<]*+)((?:[^>"'<]|"[^"<]*+"|'[^'<]*+')*+)>""")
_NAME = re.compile(r"<(/?)(?=[a-zA-Z])")
_REST = re.compile(r"[^\s/>]*")
_SPECIAL = re.compile("[>\"']")
#: A name that begins with one of these says what the element is about, or what it has, not what it is.
ABOUT = frozenset("has with no is js category cat tag topic".split())
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-label)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)

FEATURES = ("words", "link_density", "prev_words", "prev_link_density", "next_words", "next_link_density", "aside", "article", "heading")
BLOCK = "array<struct<text:string, words:double, link_density:double, prev_words:double, prev_link_density:double, next_words:double, next_link_density:double, aside:double, article:double, heading:double>>"

#: The labelled table: the features of a block, then 1 for main text. ``aside`` and ``article`` say whether the block stands
#: in an element of such a kind or name, ``heading`` whether it is one. Rows without either describe pages without names. Link
#: lists within an article are no main text, so that under the name of an article links and neighbours decide.
LABELLED = """
6 1.0 6 1.0 6 1.0 1 0 0 0
1 1.0 0 0.0 1 1.0 1 0 0 0
1 1.0 1 1.0 1 1.0 1 0 0 0
1 1.0 1 1.0 8 0.0 1 0 0 0
8 0.0 1 1.0 12 0.0 1 0 0 0
40 0.0 12 0.0 30 0.0 1 0 0 0
120 0.0 80 0.0 90 0.0 1 0 0 0
15 0.2 60 0.0 0 0.0 1 0 0 0
12 0.0 80 0.0 0 0.0 1 0 0 0
25 0.1 90 0.0 20 0.0 1 0 0 0
60 0.0 20 0.0 18 0.0 1 1 0 0
18 0.0 90 0.0 70 0.0 1 1 0 0
4 1.0 90 0.0 4 1.0 1 1 0 0
35 0.0 2 0.0 40 0.0 1 1 0 0
3 0.0 50 0.0 30 0.0 1 1 1 0
3 0.0 2 1.0 30 0.0 1 0 1 0
70 0.0 40 0.0 90 0.0 1 0 0 0
30 0.0 60 0.0 45 0.0 1 1 0 0
9 0.0 5 0.0 60 0.0 1 0 0 0
22 0.0 70 0.0 9 0.0 1 1 0 0
50 0.0 100 0.0 3 1.0 1 0 0 0
14 0.0 3 1.0 110 0.0 1 0 0 0
5 0.0 3 1.0 12 0.0 1 0 0 0
100 0.0 30 0.0 0 0.0 1 1 0 0
6 0.0 120 0.0 6 0.0 1 1 0 0
17 0.0 0 0.0 100 0.0 1 0 0 0
45 0.1 9 0.0 80 0.0 1 0 0 0
2 0.0 45 0.0 2 0.0 1 1 0 0
90 0.0 90 0.0 40 0.0 1 1 0 0
28 0.0 12 0.5 28 0.0 1 0 0 0
12 0.0 8 0.0 10 0.0 0 1 1 1
3 0.0 60 0.0 80 0.0 0 1 1 1
6 0.5 70 0.0 60 0.0 0 1 1 1
90 0.0 10 0.0 70 0.0 0 1 0 1
2 0.0 90 0.0 60 0.0 0 1 0 1
1 0.0 60 0.0 3 0.0 0 1 0 1
1 0.0 2 0.0 1 0.0 0 1 0 1
30 0.3 20 0.0 60 0.0 0 1 0 1
25 0.6 40 0.0 50 0.0 0 1 0 1
10 0.0 90 0.0 12 0.0 0 1 0 1
5 1.0 40 0.0 40 0.0 0 1 0 1
1 1.0 40 0.0 40 0.0 0 1 0 1
8 0.0 60 0.0 0 0.0 0 1 0 1
200 0.05 100 0.0 0 0.0 0 1 0 1
4 0.0 100 0.0 12 0.0 0 1 0 1
12 0.0 40 0.0 4 1.0 0 1 0 1
60 0.0 50 0.0 3 1.0 0 1 0 1
3 0.0 30 0.0 2 1.0 0 1 0 1
90 0.1 3 1.0 5 0.9 0 1 0 1
8 0.0 0 0.0 6 0.5 0 1 0 1
2 1.0 6 0.0 5 1.0 0 1 0 1
4 0.6 2 1.0 1 1.0 0 1 0 1
60 0.0 95 0.0 8 0.0 0 1 0 1
15 0.0 120 0.0 20 0.0 0 1 0 1
35 0.0 88 0.0 25 0.0 0 1 0 1
3 0.0 4 0.0 20 0.0 0 1 0 1
75 0.0 20 0.0 9 0.0 0 1 0 1
20 1.0 90 0.0 6 0.0 0 1 0 1
1 0.0 110 0.0 1 0.0 0 1 0 1
50 0.0 5 0.0 5 0.0 0 1 0 1
12 0.0 15 0.0 0 0.0 0 1 0 1
80 0.0 10 0.0 60 0.0 0 0 0 1
150 0.02 60 0.0 90 0.0 0 0 0 1
45 0.1 80 0.0 70 0.0 0 0 0 1
30 0.0 40 0.0 50 0.0 0 0 0 1
25 0.0 3 0.0 40 0.0 0 0 0 1
22 0.0 90 0.0 3 1.0 0 0 0 1
18 0.0 60 0.0 70 0.0 0 0 0 1
40 0.0 30 0.0 2 1.0 0 0 0 1
28 0.0 2 1.0 2 1.0 0 0 0 1
60 0.1 10 0.9 4 1.0 0 0 0 1
18 0.0 40 0.0 3 0.9 0 0 0 1
20 0.0 2 1.0 0 0.0 0 0 0 1
9 0.0 70 0.0 80 0.0 0 0 0 1
5 0.0 60 0.0 40 0.0 0 0 0 1
7 0.0 4 1.0 60 0.0 0 0 1 1
4 0.0 60 0.0 60 0.0 0 0 1 1
10 0.0 0 0.0 40 0.0 0 0 1 1
3 1.0 3 1.0 3 1.0 0 0 0 0
1 1.0 1 1.0 1 1.0 0 0 0 0
12 0.9 10 0.9 10 0.9 0 0 0 0
30 0.8 25 0.8 20 0.9 0 0 0 0
40 0.7 30 0.8 20 0.9 0 0 0 0
6 0.5 2 1.0 3 1.0 0 0 0 0
2 0.0 1 1.0 1 1.0 0 0 0 0
5 0.0 2 1.0 3 1.0 0 0 0 0
4 0.0 90 0.0 0 0.0 0 0 0 0
8 0.2 80 0.0 0 0.0 0 0 0 0
2 1.0 24 0.0 24 0.0 0 0 0 0
2 1.0 60 0.0 40 0.0 0 0 0 0
3 0.9 80 0.0 0 0.0 0 0 0 0
5 0.8 0 0.0 90 0.0 0 0 0 0
2 1.0 40 0.0 2 1.0 0 0 0 0
8 0.7 70 0.0 30 0.0 0 0 0 0
15 0.8 50 0.0 70 0.0 0 0 0 0
1 0.0 2 1.0 40 0.0 0 0 0 0
6 0.0 4 0.0 2 0.0 0 0 0 0
3 0.0 2 0.0 4 0.0 0 0 0 0
3 0.0 2 1.0 2 1.0 0 0 1 0
2 0.0 90 0.0 2 1.0 0 0 1 0
6 1.0 6 1.0 6 1.0 0 1 0 0
3 1.0 3 1.0 3 1.0 0 1 0 0
1 1.0 1 1.0 1 1.0 0 1 0 0
2 1.0 2 1.0 2 1.0 0 1 0 0
8 1.0 9 1.0 7 1.0 0 1 0 0
12 0.9 10 0.9 10 0.9 0 1 0 0
5 0.8 6 0.9 4 1.0 0 1 0 0
15 1.0 14 1.0 12 1.0 0 1 0 0
4 1.0 60 0.0 4 1.0 0 1 0 0
2 1.0 25 0.0 2 1.0 0 1 0 0
7 1.0 90 0.0 8 1.0 0 1 0 0
3 1.0 0 0.0 3 1.0 0 1 0 0
4 1.0 4 1.0 60 0.0 0 1 0 0
2 1.0 2 1.0 25 0.0 0 1 0 0
9 1.0 8 1.0 40 0.0 0 1 0 0
3 1.0 3 1.0 0 0.0 0 1 0 0
10 0.9 12 1.0 0 0.0 0 1 0 0
40 0.3 60 0.0 50 0.0 0 0 0 1
30 0.4 40 0.1 50 0.2 0 0 0 1
55 0.25 70 0.0 3 1.0 0 0 0 1
25 0.35 30 0.3 40 0.3 0 0 0 1
70 0.2 3 1.0 60 0.1 0 0 0 1
22 0.4 60 0.0 0 0.0 0 0 0 1
5 0.0 60 0.0 3 1.0 0 0 0 1
4 0.0 45 0.0 2 1.0 0 0 0 1
6 0.0 80 0.1 4 1.0 0 0 0 1
3 0.0 30 0.0 5 1.0 0 0 0 1
12 0.0 4 1.0 5 1.0 0 0 0 0
15 0.0 6 1.0 4 1.0 0 0 0 0
10 0.0 8 1.0 6 1.0 0 0 0 0
9 0.0 3 1.0 3 1.0 0 0 0 0
14 0.0 5 1.0 3 1.0 0 0 0 0
11 0.0 3 1.0 3 1.0 0 0 0 0
12 0.0 3 1.0 4 1.0 0 0 0 0
2 0.5 0 0.0 24 0.0 0 0 0 0
4 0.5 0 0.0 60 0.0 0 0 0 0
6 0.6 50 0.0 8 0.5 0 0 0 0
6 0.0 3 1.0 40 0.0 0 1 0 1
3 0.0 5 1.0 4 0.0 0 1 0 1
8 0.0 4 1.0 12 0.0 0 1 0 1
2 0.0 1 1.0 3 0.0 0 1 0 1
1 0.0 3 1.0 1 0.0 0 1 0 1
1 0.0 30 0.0 1 0.0 0 1 0 1
5 0.0 3 1.0 22 0.0 0 1 1 1
2 0.0 3 1.0 60 0.0 0 1 1 1
1 0.0 25 0.0 3 1.0 0 1 0 1
2 0.0 1 0.0 3 1.0 0 1 0 1
1 0.0 1 0.0 25 0.0 0 1 0 1
3 1.0 22 0.0 22 0.0 0 1 0 1
5 1.0 15 0.0 30 0.0 0 1 0 1
2 1.0 20 0.0 18 0.0 0 1 0 1
6 1.0 30 0.0 25 0.0 0 1 0 1
4 1.0 12 0.0 40 0.0 0 1 0 1
4 0.0 0 0.0 22 0.0 0 0 1 1
5 0.0 3 1.0 40 0.0 0 0 1 1
3 0.0 2 1.0 30 0.0 0 0 1 1
6 0.0 0 0.0 60 0.0 0 0 0 1
12 0.0 3 1.0 50 0.0 0 0 0 1
8 0.0 4 1.0 25 0.0 0 0 0 1
1 0.0 1 0.0 3 1.0 0 1 0 1
1 0.0 1 0.0 25 0.0 0 1 0 1
1 0.0 1 0.0 22 0.0 0 1 0 1
2 0.0 6 0.0 3 1.0 0 1 0 1
3 0.0 22 0.0 2 1.0 0 1 0 1
1 0.0 22 0.0 3 1.0 0 1 0 1
5 0.0 40 0.0 4 1.0 0 1 0 1
4 0.0 3 0.0 1 1.0 0 1 0 1
1 0.0 40 0.0 1 0.0 0 1 0 1
1 0.0 1 0.0 1 0.0 0 1 0 1
22 0.0 3 1.0 30 0.0 0 1 0 1
1 0.0 3 1.0 1 0.0 0 1 0 1
40 0.0 3 1.0 22 0.0 0 1 0 1
4 0.0 2 1.0 3 0.0 0 1 0 1
12 0.0 5 1.0 9 0.0 0 1 0 1
1 0.0 1 0.0 3 1.0 0 1 0 1
1 0.0 1 0.0 25 0.0 0 1 0 1
1 0.0 1 0.0 22 0.0 0 1 0 1
2 0.0 6 0.0 3 1.0 0 1 0 1
3 0.0 22 0.0 2 1.0 0 1 0 1
1 0.0 22 0.0 3 1.0 0 1 0 1
5 0.0 40 0.0 4 1.0 0 1 0 1
4 0.0 3 0.0 1 1.0 0 1 0 1
1 0.0 40 0.0 1 0.0 0 1 0 1
1 0.0 1 0.0 1 0.0 0 1 0 1
22 0.0 3 1.0 30 0.0 0 1 0 1
1 0.0 3 1.0 1 0.0 0 1 0 1
40 0.0 3 1.0 22 0.0 0 1 0 1
4 0.0 2 1.0 3 0.0 0 1 0 1
12 0.0 5 1.0 9 0.0 0 1 0 1
22 0.0 3 1.0 3 1.0 0 0 0 1
1 0.0 22 0.0 22 0.0 0 1 0 1
2 0.0 0 0.0 22 0.0 0 0 1 1
3 0.0 3 1.0 40 0.0 0 0 1 1
2 0.0 3 1.0 30 0.0 0 0 1 1
2 0.0 22 0.0 25 0.0 0 0 1 1
3 0.0 60 0.0 40 0.0 0 0 1 1
1 0.0 40 0.0 30 0.0 0 0 1 1
10 0.0 90 0.0 3 1.0 0 0 0 1
12 0.0 100 0.0 0 0.0 0 0 0 1
8 0.0 120 0.0 4 1.0 0 0 0 1
5 0.0 100 0.0 3 1.0 0 0 0 1
9 0.0 95 0.0 0 0.0 0 0 0 1
"""


class _Ends:
    """Where the tags of a page end: at the first ``>`` outside of quotes; a quote that is never closed is a character like others.

    Where a tag ends from a quote or ``>`` on does not depend on where it began, so each of them is looked at once for the whole page.
    """

    def __init__(self, page: str) -> None:
        self.page, self.special = page, [m.start() for m in _SPECIAL.finditer(page)]
        self.quotes = {q: [p for p in self.special if page[p] == q] for q in "\"'"}
        self.known: dict[int, int] = {}

    def after(self, at: int) -> int:
        """The place of the ``>`` that ends a tag which goes on at ``at``, or -1."""
        k, passed, found = bisect_left(self.special, at), [], -1
        while k < len(self.special):
            if k in self.known:
                found = self.known[k]
                break
            passed.append(k)
            place = self.special[k]
            if self.page[place] == ">":
                found = place
                break
            same = self.quotes[self.page[place]]
            closing = bisect_right(same, place)
            k = bisect_left(self.special, same[closing]) + 1 if closing < len(same) else k + 1
        self.known.update(dict.fromkeys(passed, found))
        return found


def _tokens(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, tag, is an end tag, attributes) of each piece of markup; without a tag, the last is the text of a CDATA section.

    Takes time in proportion to the page, whatever it holds: a ``<`` that begins no tag is found to be none without reading on.
    """
    ends, at = None, page.find("<")
    while at >= 0:
        stop = at + 1
        if plain := _PLAIN.match(page, at):
            stop = plain.end()
            yield at, stop, plain[2].lower(), bool(plain[1]), plain[3]
        elif page.startswith("<!--", at):
            close = page.find("-->", at + 4)
            stop = close + 3 if close >= 0 else len(page)
            yield at, stop, "", False, ""
        elif page.startswith("<![CDATA[", at):
            close = page.find("]]>", at)
            stop = close + 3 if close >= 0 else len(page)
            yield at, stop, "", False, page[at + 9 : close if close >= 0 else len(page)]
        elif page.startswith(("<!", "<?"), at):
            close = page.find(">", at)
            stop = close + 1 if close >= 0 else len(page)
            yield at, stop, "", False, ""
        elif begin := _NAME.match(page, at):
            ends = ends or _Ends(page)
            close = ends.after(begin.end())
            if close >= 0:
                name = _REST.match(page, begin.end(), close)
                stop = close + 1
                yield at, stop, name.group().lower(), bool(begin[1]), page[name.end() : close]
        at = page.find("<", stop)


def _kinds(tag: str, attrs: str) -> tuple[bool, bool, bool, bool]:
    """Whether an element is aside, a comment, an article or hidden by its tag, class, id or role.

    A comment word counts anywhere in a name, other words for what is aside only at its ends; in an element that is
    named as an article too they count only as whole names, and in an article element not at all.
    """
    aside, comment, article, hidden = tag in ASIDE_TAGS, False, tag in ("article", "main"), False
    if attrs and tag not in ("html", "body"):
        names = []
        for name, value in _ATTR.findall(attrs):
            if name.lower() == "hidden":
                hidden = True
            elif name.lower() != "aria-label":
                names += value.strip("\"'").lower().split()
        strict = any(one in ARTICLE_NAMES for one in names)
        for one in names:
            parts = re.split(r"[-_:]+|(?<=\D)(?=\d)", one)
            if parts[0] in ABOUT and one != parts[0]:
                continue
            whole = "".join(parts)
            ends = {whole} if strict else {parts[0], parts[-1], whole}
            comment = comment or bool({*parts, whole} & COMMENT_NAMES)
            aside = aside or (tag not in ("article", "main") and bool(ends & ASIDE_NAMES))
            article = article or (parts[-1] in ARTICLE_NAMES and not ends & ASIDE_NAMES)
    return aside, comment, article, hidden


class _Blocks:
    """Cuts a page into blocks of text at every tag that is not inline."""

    def __init__(self) -> None:
        self.blocks: list[list] = []
        self.parts: list[str] = []
        self.linked: list[str] = []
        #: open elements: tag, how many around it are aside, comments, articles and headers of articles
        self.open: list[tuple[str, int, int, int, int]] = [("", 0, 0, 0, 0)]
        #: how many block elements of a name are open, and, for each open block, how many inline ones since it began
        self.within: Counter[str] = Counter()
        self.inline: list[Counter[str]] = [Counter()]
        self.links, self.heading = 0, 0

    def text(self, raw: str) -> None:
        decoded = html.unescape(raw)
        self.parts.append(decoded)
        if self.links:
            self.linked.append(decoded)
        elif any(map(str.isspace, decoded)):
            self.linked.append(" ")  # links on either side are words of their own

    def flush(self) -> None:
        words = "".join(self.parts).split()
        if words:
            inside = len("".join(self.linked).split())
            _, aside, comment, article, header = self.open[-1]
            beside = aside or comment or (header and not self.heading)
            self.blocks.append([" ".join(words), float(len(words)), min(1.0, inside / len(words)), float(bool(beside)), float(article > 0), float(self.heading > 0)])
        self.parts, self.linked = [], []

    def start(self, tag: str, attrs: str) -> None:
        own_aside, own_comment, own_article, hidden = _kinds(tag, attrs)
        if tag in SELF_CLOSING and self.open[-1][0] == tag:
            self.end(tag)
        _, aside, comment, article, header = self.open[-1]
        if tag == "header":
            own_aside = not article
        if own_article and not own_aside and not own_comment and tag in ("article", "main") and not article:
            aside = 0  # a wrapper's name says nothing about the article in it
        state = (tag, aside + (own_aside or hidden), comment + own_comment, article + own_article, header + (tag == "header" and article > 0))
        if tag not in INLINE or own_aside or own_comment or hidden:
            self.flush()
        self.open.append(state)
        if tag in INLINE:
            self.inline[-1][tag] += 1
        else:
            self.within[tag] += 1
            self.inline.append(Counter())
        self.links += tag == "a"
        self.heading += tag in HEADINGS

    def end(self, tag: str) -> None:
        if not (self.inline[-1] if tag in INLINE else self.within)[tag]:
            return  # nothing of that name is open; an inline end tag closes nothing outside its block
        at = len(self.open) - 1
        while self.open[at][0] != tag:
            at -= 1
        if tag not in INLINE or self.open[at][1:3] != self.open[at - 1][1:3]:
            self.flush()
        while len(self.open) > at:
            name = self.open.pop()[0]
            self.links -= name == "a"
            self.heading -= name in HEADINGS
            if name in INLINE:
                self.inline[-1][name] -= 1
            else:
                self.within[name] -= 1
                self.inline.pop()


def blocks(page: str) -> list[tuple]:
    """The blocks of a page in its order: text, then FEATURES."""
    found, at = _Blocks(), 0
    for start, end, tag, closes, attrs in _tokens(page):
        if start < at:
            continue
        if start > at:
            found.text(page[at:start])
        at = end
        if not tag:
            if attrs:
                found.text(attrs)
        elif closes:
            if tag == "br":
                found.flush()
            elif tag not in VOID and tag not in SKIPPED:
                found.end(tag)
        elif tag in SKIPPED:
            if not attrs.endswith("/"):
                at = _skip(page, end, tag)
        elif tag in VOID:
            if tag not in ("wbr", "img"):
                found.flush()
        else:
            found.start(tag, attrs)
    if at < len(page):
        found.text(page[at:])
    found.flush()
    out = []
    for k, (text, words, density, aside, article, heading) in enumerate(found.blocks):
        before = found.blocks[k - 1] if k else (None, 0.0, 0.0)
        after = found.blocks[k + 1] if k + 1 < len(found.blocks) else (None, 0.0, 0.0)
        out.append((text, words, density, before[1], before[2], after[1], after[2], aside, article, heading))
    return out


def _skip(page: str, at: int, tag: str) -> int:
    """Where the content of a skipped element ends; an element that never ends takes the rest of the page."""
    end = re.compile(rf"</{re.escape(tag)}\s*>|\Z" if tag not in ("head", "title") else rf"</{tag}\s*>|<body\b|\Z", re.I).search(page, at)
    return end.end() if end.group().startswith("</") else end.start()


def train(spark: SparkSession, table: str = LABELLED) -> tuple:
    """The decision tree learned from a labelled table: (feature, threshold, low branch, high branch) or (verdict,)."""
    rows = [list(map(float, line.split())) for line in table.strip().splitlines()]
    data = spark.createDataFrame([(Vectors.dense(r[:-1]), r[-1]) for r in rows], ["features", "label"]).coalesce(1)
    model = DecisionTreeClassifier(maxDepth=7, maxBins=64, minInstancesPerNode=2, seed=7).fit(data)

    def node(at) -> tuple:
        if at.getClass().getSimpleName() == "LeafNode":
            return (bool(at.prediction()),)
        return FEATURES[at.split().featureIndex()], at.split().threshold(), node(at.leftChild()), node(at.rightChild())

    return node(model._java_obj.rootNode())


def main_block(tree: tuple, block: Column) -> Column:
    """Whether the tree takes ``block`` for main text."""
    if len(tree) == 1:
        return F.lit(tree[0])
    name, threshold, low, high = tree
    return F.when(block[name] <= threshold, main_block(low, block)).otherwise(main_block(high, block))


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` (code points) and ``n_blocks``: one row per row of ``pages`` (``page_id``,
    ``url``, ``html``).

    A page is cut into flat blocks of text at every tag that is not inline. A decision tree, trained on a small labelled
    table, judges each block by its words and link density, those of its neighbours, and whether the elements around it
    are an article or something beside it. Main blocks are joined by one space. Character references are
    decoded and white space within a block becomes one space. A null, empty or malformed html is read as far as it goes;
    without main text ``text`` is empty; repeated rows give repeated results; other columns are ignored.
    """
    tree = train(pages.sparkSession)
    rows = pages.select("page_id", "url", F.col("html").cast("binary").alias("html"))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    names = [f.split(":")[0].strip() for f in BLOCK[len("array<struct<") : -2].split(",")]
    block_type = pa.list_(pa.struct([pa.field(n, pa.string() if n == "text" else pa.float64()) for n in names]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                found = [[dict(zip(names, b, strict=True)) for b in blocks((h.as_py() or b"").decode("utf-8", "replace"))] for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, block_type)], names=["page_id", "url", "blocks"])

    cut = rows.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, blocks {BLOCK}")
    main = F.transform(F.filter("blocks", lambda b: main_block(tree, b)), lambda b: b["text"])
    text = F.array_join(main, " ")
    return cut.select("page_id", "url", text.alias("text"), F.size(main).cast("long").alias("n_blocks")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks"
    )
