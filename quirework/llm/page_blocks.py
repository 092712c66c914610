"""A web page as a row of text blocks, each marked as furniture, undecided, or part of the article.

One pass over the tags, with the end tags that HTML lets pages leave out.  Nothing here looks at other pages.
"""

import functools
import html
import re

#: What a block is: part of the furniture, not told by the markup, inside the element that holds the article.
FURNITURE, OPEN, ARTICLE = 0, 1, 2

# Elements and roles of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var".split())
_HIDDEN = frozenset(
    "script style title textarea noscript template iframe svg math object canvas audio video select noframes xmp".split())
_TO_THE_END = frozenset("script style title textarea noframes xmp".split())
#: Elements that end where one of the same group begins.
_GROUPS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_LISTS = frozenset("ul ol menu dl table".split())
_FURNITURE_TAGS = frozenset("nav footer aside form button dialog menu fieldset".split())
_FURNITURE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
#: Words of class names and ids that mark furniture; those of the second list do so outside an article only.
_FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar widget related recommended footer copyright cookie cookies consent gdpr notice popup modal "
    "newsletter subscribe signup paywall share sharing social comment comments disqus replies respond pagination pager "
    "login search skip banner".split())
_OUTER_WORDS = frozenset("header masthead topbar".split())
_NOT = frozenset("with without has no not".split())

_TAG = re.compile(
    r"""<!--(?:.*?(?:-->|\Z))|<[!?][^>]*>?|</?([A-Za-z][^\s/>]*)((?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|["'=])*+)>?""", re.S)
_ATTRIBUTE = re.compile(r"""([A-Za-z-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@functools.lru_cache(20_000)
def _marks(attributes: str) -> tuple[bool, bool, bool]:
    """(furniture, furniture outside an article, main element) by a tag's attributes."""
    inner = outer = main = False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id"):
            for part in value.split():
                words = {w.lower() for w in _NAME_WORDS.findall(part)}
                if not words & _NOT:
                    inner |= bool(words & _FURNITURE_WORDS)
                    outer |= bool(words & _OUTER_WORDS)
        elif name == "role":
            inner |= value.lower() in _FURNITURE_ROLES
            main |= value.lower() == "main"
        elif name == "itemprop":
            main |= value == "articleBody"
            inner |= value == "comment"
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            inner = True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            inner = True
    return inner, outer, main


_PLAIN, _BY_NAME, _BY_TAG = 0, 1, 2


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, kind) of every block of text that is not hidden, in page order: character references decoded, white
    space as one space, ends trimmed, no empty blocks.

    A page with an ``article`` or ``main`` element (or ``role=main``, ``itemprop=articleBody``) that isn't furniture
    itself has its article there; all else on it is furniture.  On other pages blocks are furniture or undecided.
    ``main`` goes before ``article``.  Furniture is told by element, role, class or id; an element that is so by its name
    only, or a form, and has the article inside, is not.  A ``header`` inside the article belongs to it.
    """
    # Nodes: parent, how it is marked as furniture, whether it may hold the article (2: main), whether headers count.
    parent, marked, holds, outer = [0], [_PLAIN], [0], [False]
    stack = [("", 0)]
    found: list[tuple[str, int]] = []
    pieces: list[str] = []
    at, size = 0, len(page)
    # Furniture inside a line of text: where it begins in ``pieces``, its element and how deep that is nested.
    cut, cut_name, cut_depth = None, "", 0

    def emit(part, node):
        text = " ".join("".join(part).split())
        if text:
            found.append((text, node))

    def flush():
        nonlocal cut
        if pieces:
            emit(pieces[:cut], stack[-1][1])
            if cut is not None:
                emit(pieces[cut:], -1)
                cut = 0
            pieces.clear()

    def close(names, stop=frozenset()):
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                del stack[k:]
                return
            if stack[k][0] in stop:
                return

    while at < size:
        start = page.find("<", at)
        if start < 0:
            start = size
        if start > at:
            text = page[at:start]
            pieces.append(html.unescape(text) if "&" in text else text)
        if start == size:
            break
        tag = _TAG.match(page, start)
        if tag is None:
            pieces.append("<")
            at = start + 1
            continue
        at = tag.end()
        name = tag[1]
        if name is None:
            continue
        name = name.lower()
        if page[start + 1] == "/":
            if name in _BLOCK:
                flush()
            if name not in _INLINE:
                close((name,))
                cut = None
            elif cut is not None and name == cut_name:
                cut_depth -= 1
                if not cut_depth:
                    emit(pieces[cut:], -1)
                    del pieces[cut:]
                    cut = None
            continue
        attributes = tag[2]
        if name in _HIDDEN:
            end = re.compile(f"</{name}(?=[\\s/>])[^>]*>?", re.I).search(page, at)
            if end:
                at = end.end()
            elif name in _TO_THE_END:
                at = size
            continue
        if name in _BLOCK:
            flush()
        elif name == "br":
            pieces.append(" ")
        if name in _VOID:
            continue
        marks = _marks(attributes) if attributes and name not in ("html", "body") else (False, False, False)
        if name in _INLINE:
            if cut is not None:
                cut_depth += name == cut_name
            elif marks[0]:
                cut, cut_name, cut_depth = len(pieces), name, 1
            continue
        if name in _GROUPS:
            close(_GROUPS[name], _LISTS)
        elif name in _BLOCK:
            close(("p",), _BLOCK - {"p"})
        node = len(parent)
        parent.append(stack[-1][1])
        marked.append(_BY_TAG if name in _FURNITURE_TAGS and name != "form" else
                      _BY_NAME if marks[0] or name == "form" else _PLAIN)
        holds.append(2 if name == "main" or marks[2] else 1 if name == "article" else 0)
        outer.append(name == "header" or marks[1])
        stack.append((name, node))
    flush()
    return _decide(found, parent, marked, holds, outer)


def _decide(found, parent, marked, holds, outer):
    count = len(parent)
    for node in range(count):
        if holds[node] and marked[node] == _PLAIN:
            up, clear = parent[node], True
            while up:
                clear &= marked[up] != _BY_TAG and not (marked[up] and holds[up])
                up = parent[up]
            up = parent[node]
            while clear and up:
                marked[up], outer[up], up = _PLAIN, False, parent[up]
    inside, gone = [0] * count, [False] * count
    for node in range(1, count):  # parents come before their children
        up = parent[node]
        gone[node] = gone[up] or marked[node] != _PLAIN or outer[node] and not inside[up]
        inside[node] = 0 if gone[node] else max(inside[up], holds[node])
    level = max((inside[n] for _, n in found if n >= 0), default=0)
    if level:
        return [(t, ARTICLE if n >= 0 and inside[n] >= level else FURNITURE) for t, n in found]
    return [(t, FURNITURE if n < 0 or gone[n] else OPEN) for t, n in found]
