"""Block classification on pages of other layouts than the labelled ones, and blocks against a plain HTML parser."""

import random
import re
import time
from html.parser import HTMLParser

import numpy as np
import pytest

from gridweave.llm import html_text
from gridweave.llm.queries import table

#: Pages that no labelled one was made from. §n: about n words; data-main marks text.
HELD_OUT = [
    '<body class="single-post"><div id="page"><header id="masthead" class="site-header"><div class="site-branding"><a>§2</a><p>§6</p></div><nav id="site-navigation"><ul><li><a>§1</a></li><li><a>§2</a></li></ul></nav></header><div id="content" class="site-content"><main id="main"><article id="post-12" class="post-12 post hentry"><header class="entry-header"><h1 data-main class="entry-title">§7</h1></header><div class="entry-content"><p data-main>§60</p><p data-main>§35 <a>§3</a> §10</p><h2 data-main>§4</h2><p data-main>§3</p><ul><li data-main>§8</li><li data-main>§5</li></ul><p data-main>§45</p></div></article><div id="comments" class="comments-area"><h2>§4</h2><ol class="comment-list"><li class="comment"><article><p>§30</p></article></li><li class="comment"><article><p>§22</p></article></li></ol><form><p>§8</p></form></div></main><aside id="secondary"><section class="widget"><h2>§2</h2><ul><li><a>§5</a></li></ul></section></aside></div><footer id="colophon"><div class="site-info">§9</div></footer></div></body>',
    '<body><div class="nav-bar"><a>§1</a> <a>§1</a> <a>§2</a></div><div class="story"><h1 data-main>§9</h1><p data-main>§25</p><p data-main>§40 <a>§2</a></p><p data-main>§4</p><div class="advertisement-inline">§6</div><p data-main>§50</p></div><div class="more-stories"><p><a>§6</a></p><p><a>§8</a></p></div><div class="page-footer"><p>§14</p></div></body>',
    "<body><table><tr><td><a>§1</a></td><td><a>§2</a></td></tr></table><table><tr><td><h2 data-main>§5</h2><p data-main>§70</p><p data-main>§30</p><p data-main>§55</p></td></tr></table><p><a>§2</a> | <a>§2</a> | <a>§3</a></p></body>",
    '<body><main><h1 data-main>§6</h1><p data-main>§33</p><pre data-main>§25</pre><p data-main>§12 <a>§2</a> §20</p><table><tr><td data-main>§2</td><td data-main>§6</td></tr></table><p data-main>§2</p></main><footer><ul><li><a>§2</a></li></ul><p>§8</p></footer></body>',
    '<body><div role="banner"><a>§3</a></div><div class="layout two-columns"><div class="column"><article><p data-main>§18</p><p data-main>§1</p><blockquote><p data-main>§28</p></blockquote><p data-main>§44</p></article></div><div class="column sidebar-right"><h4>§2</h4><p>§10 <a>§2</a></p></div></div><div role="contentinfo">§11</div></body>',
    '<body><div class="cookie-consent"><p>§30</p><button>§1</button></div><nav><a>§1</a><a>§2</a></nav><div class="article-wrapper no-ads"><h1 data-main>§8</h1><div data-main>§38</div><div data-main>§5</div><div data-main>§52</div></div><div class="newsletter-box"><p>§18</p></div><div class="footer-links"><a>§2</a><a>§2</a></div></body>',
    "<body><h1 data-main>§4</h1><p data-main>§30</p><p data-main>§8</p><p data-main>§26</p></body>",
    '<body><ul><li><a>§2</a></li><li><a>§1</a></li><li><a>§2</a></li></ul><div><h1 data-main>§6</h1><p data-main>§42</p><p data-main>§37</p><ul><li data-main>§9</li><li data-main>§12</li></ul><p data-main>§31</p></div><ul><li><a>§6</a></li><li><a>§5</a></li></ul></body>',
    '<body><header><h1><a>§2</a></h1></header><main><section class="lead"><h2 data-main>§7</h2><p data-main>§21</p></section><section><p data-main>§48</p><figure><img><figcaption data-main>§9</figcaption></figure><p data-main>§6</p></section><section class="share-buttons"><a>§1</a><a>§1</a></section></main><section class="related-articles"><h3>§2</h3><article><a>§7</a></article><article><a>§6</a></article></section></body>',
    '<body><div id="top-ad">§7</div><div id="breadcrumb"><a>§1</a> &gt; <a>§2</a></div><div id="story-body"><h1 data-main>§8</h1><p data-main><a>§2</a> §28</p><p data-main>§17</p><p data-main>§3</p><p data-main>§64</p></div><div id="disqus_thread"><div class="post-message"><p>§26</p></div><div class="post-message"><p>§14</p></div></div><div id="legal">§16</div></body>',
    '<body><article class="has-image with-sidebar"><h1 data-main>§5</h1><p data-main>§4</p><p data-main>§90</p><aside class="pullquote"><p>§9</p></aside><p data-main>§66</p><footer><p>§5 <a>§2</a></p></footer></article><section id="reply-list"><div class="reply"><p>§19</p></div></section></body>',
    '<body><form name="all"><div class="top-nav"><a>§1</a> <a>§2</a> <a>§1</a></div><div class="body-copy"><h1 data-main>§6</h1><p data-main>§45</p><p data-main>§30</p><p data-main>§52</p></div><div class="bottom-links"><a>§2</a> <a>§2</a></div></form></body>',
    "<body><table><tr><td><a>§1</a><td><a>§2</a><tr><td><h1 data-main>§5</h1><p data-main>§60<p data-main>§40<p data-main>§33<tr><td><a>§2</a><td><a>§1</a></table></body>",
    '<body><nav><a>§1</a><a>§1</a></nav><main><article><h2 data-main>§5</h2><p data-main>§40</p><p data-main>§28</p></article><article><h2 data-main>§4</h2><p data-main>§35</p><p data-main>§31</p></article></main><footer>§9</footer></body>',
    '<body><div class="noticia"><h1 data-main>§7</h1><p data-main>§48</p><p data-main>§26</p><p data-main>§39</p></div><div id="lista-comentarios"><p>§24</p><p>§31</p></div><div class="pie"><a>§2</a> <a>§1</a></div></body>',
    '<body><header class="page"><article><h1 data-main>§6</h1><p data-main>§38</p><p data-main>§44</p></article></header><div class="product-reviews"><p>§26</p><p>§33</p></div></body>',
    '<body><div class="popup-overlay"><div class="modal"><p>§12</p></div></div><div class="wrap"><div class="menu"><a>§1</a><a>§1</a><a>§1</a></div><div class="text"><p data-main>§29</p><p data-main>§51</p><p data-main>§7</p><p data-main>§43</p></div></div><div class="copyright-line">§6</div></body>',
]


def filled(page, rng):
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    return re.sub(r"§(\d+)", lambda m: " ".join(word() for _ in range(max(1, round(int(m[1]) * rng.uniform(0.7, 1.4))))), page)


def test_other_layouts():
    """Words kept rightly: the figures in README are printed by this test with -s."""
    rng, model = random.Random(3), html_text.text_model()
    right = kept = marked = 0
    for page in HELD_OUT * 5:
        page = filled(page, rng)
        text = [b.text for b in html_text.blocks(page) if b.marked]
        got = model.main_text(page.replace("data-main", "")).split("\n\n")
        size = lambda parts: sum(len(p.split()) for p in parts)
        right, kept, marked = right + size(t for t in got if t in text), kept + size(got), marked + size(text)
    print(f"\nheld-out pages: precision {right / kept:.3f}, recall {right / marked:.3f} of words")
    assert right / kept > 0.95 and right / marked > 0.95


@pytest.mark.parametrize("around", ['<div class="content has-sidebar">', '<div id="search-content">', '<div data-id="ad-17">', '<div title="class=ad">', '<div class="no-comments">', '<section class="ad-free story">'])
def test_names_around_an_article(around):
    words = "some words that make a line of text long enough to be a paragraph of it "
    page = f"<body><nav><a>home</a></nav>{around}<article><h1>A title here</h1><p>First with <a href=x>a link</a> in it</p><p>{words * 3}</p><p>Of.</p></article></div></section><div>All rights reserved by us</div></body>"
    want = ["A title here", "First with a link in it", (words * 3).strip(), "Of."]
    assert html_text.text_model().main_text(page).split("\n\n") == want
    plain = page.replace("article>", "div>")
    assert html_text.text_model().main_text(plain).split("\n\n")[:4] == want


def test_what_holds_the_text_is_not_outside():
    words = "some words that make a line of text long enough to be a paragraph of it " * 2
    one = f"<h1>A title here</h1><p>{words}</p><p>And {words}</p>"
    want = ["A title here", words.strip(), "And " + words.strip()]
    model = html_text.text_model()
    for begin, end in (("<form><div class=content>", "</div></form>"), ("<form><main>", "</main></form>"), ("<header><article>", "</article></header>"), ("<body><form id=all><table><tr><td>", "</table></form>")):
        assert model.main_text(f"{begin}{one}{end}").split("\n\n") == want, begin
    two = f"<nav><a>home</a></nav><article>{one}</article><article>{one}</article><footer>all rights</footer>"
    assert model.main_text(two).split("\n\n") == want * 2
    for name in ("user-reviews", "comentarios", "kommentare", "comments"):
        assert model.main_text(f'<div class="story">{one}</div><div class="{name}"><p>{words}</p><p>{words}</p></div>').split("\n\n") == want, name


def test_open_elements_take_linear_time():
    """Cells and rows end those before them; a page twice as long takes about twice the time."""
    found = html_text.blocks("<table><tr><td>one<td>two<div>three<tr><td>four</table><p>five")
    assert [b.text for b in found] == ["one", "two", "three", "four", "five"]
    assert [[e.name for e in b.around if e.name] for b in found] == [["table", "tr", "td"], ["table", "tr", "td"], ["table", "tr", "td", "div"], ["table", "tr", "td"], ["p"]]
    nested = html_text.blocks("<table><tr><td>a<table><tr><td>b<td>c</table>d<td>e</table>")
    assert [(b.text, [e.name for e in b.around].count("td")) for b in nested] == [("a", 1), ("b", 2), ("c", 2), ("d", 1), ("e", 1)]
    for page in ("<table>" + "<tr><td>cell <td>two" * 60_000, "<div>" * 60_000 + "text", '<div class="a b"><p>some text' * 30_000, "<form><ul>" * 30_000 + "<li>x" * 30_000):
        began = time.process_time()
        html_text.text_model().main_text(page)
        assert time.process_time() - began < 20


def test_links_around_blocks():
    cases = {
        "<a href=x><div>Next story</div></a><p>text</p>": [1, 0],
        "<a><h3>one</h3><p>two</p></a><p>three</p>": [1, 1, 0],
        "<p><a>open <p>next": [1, 0],
        "<div><a><p>in</p></div><p>out</p>": [1, 0],
        "<p>a <a>b</a> c</p>": [1 / 3],
    }
    for page, want in cases.items():
        assert [b.linked / b.words for b in html_text.blocks(page)] == pytest.approx(want), page


class Plain(HTMLParser):
    """Blocks of tidy pages: text between tags that are not inline, with the number of its words in links."""

    def __init__(self):
        super().__init__()
        self.out, self.text, self.skip, self.link = [], [], 0, False

    def close_block(self):
        words = " ".join(t for t, _ in self.text).split()
        if words:
            self.out.append((" ".join("".join(t for t, _ in self.text).split()), sum(len(t.split()) for t, inside in self.text if inside)))
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in html_text.DROPPED:
            self.skip += 1
        elif tag == "a":
            self.link = True
        elif tag == "br":
            self.text.append((" ", False))
        elif tag not in html_text.INLINE:
            self.close_block()

    def handle_endtag(self, tag):
        if tag in html_text.DROPPED:
            self.skip -= 1
        elif tag == "a":
            self.link = False
        elif tag not in html_text.INLINE:
            self.close_block()

    def handle_data(self, data):
        if not self.skip:
            self.text.append((data, self.link))


def test_blocks_and_features_of_whole_pages(spark):
    """Every page of the table, against a parser that looks at one tag after another and features found by loops."""
    model = html_text.text_model()
    for row in table(spark, "/root/testdata/sf0.01", "pages").collect():
        found, plain = html_text.blocks(row.html), Plain()
        plain.feed(row.html or "")
        plain.close()
        plain.close_block()
        assert [(b.text, b.linked) for b in found] == plain.out
        if not found:
            continue
        features = html_text.block_features(found, model.odds)
        for k, b in enumerate(found):
            words = [min(len(x.text.split()), 40) if x else 0 for x in (b, found[k - 1] if k else None, found[k + 1] if k + 1 < len(found) else None)]
            links = [x.linked / len(x.text.split()) if x else 0 for x in (b, found[k - 1] if k else None, found[k + 1] if k + 1 < len(found) else None)]
            near = max([min(len(x.text.split()), 40) for j, x in enumerate(found) if 0 < abs(j - k) < 4 and x.linked / len(x.text.split()) < 0.34], default=0)
            assert np.allclose(features[k, [0, 1, 2, 3, 4, 5, 10]], [words[0], links[0], words[1], links[1], words[2], links[2], near])
        inside = [b.text for b in found if any(e.name == "article" for e in b.around)]
        assert model.main_text(row.html) == "\n\n".join(inside)
