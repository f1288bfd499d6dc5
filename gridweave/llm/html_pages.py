"""Labelled pages for the block classifier: layouts put together from parts, filled with sentences of varying length.

``§n`` stands for about n words and ``(a|b)`` in a class or id for one of several usual names. Blocks with ``data-main``
are text. Of eight pages six keep their tags and names, one has names alone and one neither, so that word counts and links
have to tell. Of eight pages one is the article and nothing else.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

_AD = "(ad|ads|advert|advertisement|adverts|banner|promo|promotion|sponsored|sponsor|werbung|anzeige|publicidad|publicite)"
_SAID = "(comments|commentlist|discussion|disqus|reviews|ratings|comentarios|opiniones|commentaires|avis|kommentare|bewertungen)"

#: Before the article.
TOPS = (
    "<header><h1>§3</h1><p>§8</p></header><nav><ul><li><a>§1</a></li><li><a>§2</a></li><li><a>§1</a></li><li><a>§1</a></li></ul></nav>",
    f'<nav><ul><li><a>§1</a></li><li><a>§1</a></li><li><a>§2</a></li></ul></nav><div class="{_AD}">§9</div>',
    '<div class="(header|masthead|topbar|toolbar)"><a>§3</a> §5</div><div id="(menu|nav|navbar|navigation)" role="navigation"><a>§1</a> <a>§1</a> <a>§2</a> <a>§1</a></div>',
    '<div class="(cookie|cookies|consent|gdpr|notice|notices)-(banner|box|bar)" role="(alert|dialog)"><p>§25</p><a>§1</a></div><header><a>§2</a><form><label>§1</label></form></header>',
    '<table><tr><td><a>§2</a></td><td><a>§1</a></td><td><a>§1</a></td></tr></table><p><a>§3</a> <a>§2</a> <a>§2</a></p>',
    '<div class="(breadcrumb|breadcrumbs)"><a>§1</a> / <a>§2</a> / §3</div><div class="(alert|warning|popup|modal|overlay)"><p>§14</p></div>',
    "<header><nav><a>§2</a><a>§1</a></nav><p>§20</p></header>",
    '<div class="(skip|skiplink)"><a>§3</a></div><form class="(search|searchform)" role="search"><p>§6</p></form>',
    f'<div class="{_AD}-(slot|unit|box)"><p>§16</p></div><ul><li><a>§2</a></li><li><a>§1</a></li><li><a>§3</a></li></ul>',
    "",
    "",
)
#: Around it.
WRAPS = (
    ("<article>", "</article>"),
    ("<article><div>", "</div></article>"),
    ('<div class="(wrap|site|layout)"><article class="post">', "</article></div>"),
    ("<main><article>", "</article></main>"),
    ('<div class="content">', "</div>"),
    ('<div class="(main|page|wrapper) has-sidebar"><div class="(post|entry|story|article)">', "</div></div>"),
    ('<main><div class="(row|container)"><div class="(entry|post|body)-content">', "</div></div></main>"),
    ('<div id="(content|primary)"><article class="(post|hentry)">', "</article></div>"),
    ("<table><tr><td>", "</td></tr></table>"),
    ("<div><div>", "</div></div>"),
    ("<section><div>", "</div></section>"),
    ("<form><div>", "</div></form>"),
    ('<form id="(aspnetform|form1)"><div class="(content|main)">', "</div></form>"),
    ("<header><main>", "</main></header>"),
    ("", ""),
)
#: The article itself, some with what is not of it between.
BODIES = (
    "<h1 data-main>§7</h1><p data-main>§30</p><p data-main>§1</p><p data-main>§2</p><p data-main>§60</p><ul><li data-main>§6</li><li data-main>§9</li></ul><p data-main>§3</p>",
    "<h1 data-main>§6</h1><p data-main>§40</p><p data-main>§2</p><p data-main>§25 <a>§2</a></p><h2 data-main>§3</h2><p data-main>§50</p><p data-main>§4</p>",
    f'<header><h1 data-main>§9</h1><p data-main>§14</p></header><p data-main>§70</p><div class="{_AD}">§8</div><p data-main>§45</p><aside><p>§20</p></aside><p data-main>§5</p><blockquote data-main>§18</blockquote>',
    "<h1 data-main>§5</h1><p data-main>§20 <a>§6</a> §4</p><p data-main>§55 <a>§3</a> §8</p><p data-main>§2</p><p data-main>§40</p>",
    '<h2 data-main>§6</h2><p data-main>§22</p><p data-main>§5</p><p data-main>§33</p><div class="(share|sharing|social|compartir|partager|teilen)"><a>§1</a> <a>§1</a></div>',
    "<p data-main><a>§4</a> §16</p><p data-main>§30</p><table><tr><td data-main>§3</td><td data-main>§4</td></tr><tr><td data-main>§2</td><td data-main>§5</td></tr></table><h3 data-main>§2</h3><p data-main>§12 <a>§6</a></p>",
    "<h1 data-main>§8</h1><p data-main>§1</p>",
    f'<h1 data-main>§6</h1><div data-main>§45</div><div data-main>§28</div><div class="(newsletter|subscribe|subscription|signup)"><p>§16</p></div><div data-main>§60</div><figure><figcaption data-main>§8</figcaption></figure><ol><li data-main>§14</li><li data-main>§20</li></ol><div class="{_AD}"><p>§12 <a>§3</a></p></div><div data-main>§9</div>',
    "<h1 data-main>§4</h1><p data-main>§8</p>",
    "<div data-main>§40</div>",
    "<div data-main>§3</div>",
    "<h1 data-main>§2</h1><p data-main>§40</p><p><a>§5</a></p><p data-main>§4</p><p data-main>§30</p><p><a>§2</a> <a>§4</a></p><p data-main>§25</p>",
    "<h2 data-main>§5</h2><p data-main>§35</p><a><div>§3</div></a><p data-main>§50</p><p data-main>§4</p>",
    "<h1 data-main>§7</h1><p data-main>§90</p><pre data-main>§30</pre><p data-main>§4</p><dl><dt data-main>§2</dt><dd data-main>§14</dd></dl><p data-main>§110</p><p data-main>§6 <a>§3</a></p>",
)
#: Behind it.
TAILS = (
    '<div class="(related|recommended|recommendations|relacionados|similaires|verwandte)"><h3>§2</h3><p><a>§7</a></p><p><a>§5</a></p><p>§18</p></div>',
    "<aside><h2>§3</h2><ul><li><a>§5</a></li><li><a>§6</a></li></ul><p>§30</p></aside>",
    f'<section id="{_SAID}"><h2>§2</h2><div class="(comment|reply)"><p>§30</p></div><div class="(comment|reply)"><p>§6</p></div><div class="comment-(body|content)"><p>§60</p></div><form><label>§2</label><p>§7</p></form></section>',
    f'<div class="{_SAID}"><h3>§2</h3><p>§40</p><p>§22</p></div>',
    f'<div id="(user|customer|reader|leser)-{_SAID}"><div><p>§30</p></div><div><p>§50</p></div></div>',
    '<div class="(sidebar|widget|widgets|seitenleiste|lateral)"><h3>§2</h3><p>§15</p><p><a>§4</a></p></div>',
    "<div><a>§2</a> | <a>§2</a></div><p><a>§3</a></p>",
    '<ol class="(comments|replies)"><li class="comment"><article class="comment-body"><p>§25</p></article></li><li class="comment"><article class="comment-body"><p>§40</p></article></li></ol><div id="respond"><h3>§3</h3></div>',
    '<a><div>§4</div></a><a><div>§6</div></a><div class="(pagination|pager)"><a>§1</a> <a>§1</a></div>',
    '<form><p>§12</p></form><div class="(login|subscribe|newsletter)"><p>§9</p></div>',
    "<ul><li><a>§6</a></li><li><a>§8</a></li><li><a>§7</a></li></ul>",
    "",
    "",
    "",
    "",
)
FOOTERS = (
    "<footer>§20</footer>",
    '<div id="(footer|foot)"><p>§12</p></div>',
    "<footer><p>§10 <a>§2</a></p></footer>",
    '<div class="(copyright|legal|disclaimer)">§9</div>',
    "<footer><p>§35</p><ul><li><a>§2</a></li><li><a>§1</a></li></ul></footer>",
    '<div role="contentinfo"><p>§6</p><a>§1</a> <a>§2</a> <a>§1</a></div>',
    '<div class="(footer|site-footer)"><p>§40</p></div>',
    "",
    "",
    "",
)

_TAGS = re.compile(r"(</?)(?:header|nav|aside|footer|article|main|section|form|figure|figcaption)\b")
_NAMES = re.compile(r' (?:class|id|role)="[^"]*"')
_LONG = re.compile(r"§\d\d")
_CHOICE = re.compile(r"\(([^)]*)\)")
_FILL = re.compile(r"§(\d+)")


def labelled_pages(n: int = 960, seed: int = 7) -> Iterator[str]:
    """``n`` pages. Every part occurs equally often, in another company each time."""
    rng = random.Random(seed)
    kinds = (TOPS, WRAPS, BODIES, TAILS, FOOTERS)
    order = [[k for _ in range(-(-n // len(kind))) for k in rng.sample(range(len(kind)), len(kind))] for kind in kinds]
    for i in range(n):
        top, (begin, end), body, tail, foot = (kind[o[i]] for kind, o in zip(kinds, order, strict=True))
        if i % 8 == 5:
            top = tail = foot = ""
        if i % 8 in (2, 6):
            # Without tags and names nothing tells paragraphs of notices, asides, readers and footers from text.
            bare = lambda part: _LONG.search(part) and (i % 8 == 6 or not _NAMES.search(part))  # noqa: B023, E731
            top, tail, foot = ("" if bare(part) else part for part in (top, tail, foot))
        if "<article" in tail and "<article" not in begin:
            tail = tail.replace("article", "div")
        # A part behind the article stands within its wrapper now and then.
        page = f"<body>{top}{begin}{body}{tail}{end}{foot}</body>" if i % 7 < 2 else f"<body>{top}{begin}{body}{end}{tail}{foot}</body>"
        page = _CHOICE.sub(lambda m: rng.choice(m[1].split("|")), page)
        if i % 8 in (2, 6):
            page = _TAGS.sub(r"\1div", page)
        if i % 8 == 6:
            page = _NAMES.sub("", page)
        scale = rng.choice((0.5, 1.0, 1.6, 3.0))
        yield _FILL.sub(lambda m: " ".join(["word"] * max(1, round(int(m[1]) * (scale * rng.uniform(0.7, 1.3) if int(m[1]) > 3 else 1)))), page)
