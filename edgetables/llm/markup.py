"""HTML to blocks of text, by the tags alone."""

from __future__ import annotations

import html
import re

#: Elements whose content is never text of the page.
RAW = frozenset({"script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "textarea", "title", "head"})
#: Elements whose content is read to the matching end tag, whatever it looks like.
VERBATIM = frozenset({"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"})
#: Elements around an article.
FRAME = frozenset({"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "label", "fieldset"})
#: Elements that break the line of text.
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p "
    "pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements without content.
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role that name what stands around an article.
FRAME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation "
    "menu breadcrumb breadcrumbs header masthead footer sidebar aside cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup login search share sharing social comment "
    "comments respond reply replies disqus discussion related recommended widget toolbar pagination pager form "
    "contentinfo complementary hidden".split()
)
#: Elements, and words of id, class and role, that name an article.
ARTICLE = frozenset({"article", "main"})
#: Elements whose start tag closes an open paragraph.
ENDS_P = BLOCK - {"br", "legend", "optgroup", "option", "title"}
#: Elements that a start tag of the same kind closes.
CLOSES_ITSELF = frozenset({"p", "li", "dt", "dd", "tr", "td", "th", "option"})

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>?|[^<]+|<", re.S
)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"\s+")

#: Elements that a document's head may hold.
HEAD = frozenset("base link meta noscript script style template title".split())

OPEN, FRAMED, INSIDE = 0, 1, 2  # what is known of a block: nothing, around an article, in an article


def hidden(attributes: str) -> bool:
    """Whether an attribute hides the element."""
    for name, *values in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name == "hidden" or (name == "aria-hidden" and "true" in values):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", "".join(values), re.I):
            return True
    return False


def frame_words(attributes: str, inside: bool = False) -> bool:
    """Whether a class, the id, the role or a hiding attribute tell that this is not the article.

    Names count whole: ``has-sidebar`` is no ``sidebar``.  ``inside`` an article a
    header is its own heading.
    """
    for name, *values in ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id", "role"):
            found = FRAME_WORDS.intersection(html.unescape("".join(values)).lower().split())
            if found and not (inside and found == {"header"}):
                return True
    return hidden(attributes)


def blocks(page: str) -> list[tuple[str, int, int]]:
    """``(text, what is known of it, segment)`` of every non-empty block in page order.

    A segment is a stretch of the page without the start or end of an element that
    frames or holds an article, or carries a class or an id.  Where no article
    stands outside the frames, the outermost frames that hold one are wrappers and
    frame nothing; where nothing at all stands outside them, forms are.
    """
    wrappers: set[int] = set()
    while True:
        out, around, forms = _blocks(page, wrappers)
        states = {state for _, state, _ in out}
        more = set() if INSIDE in states else around or (set() if OPEN in states else forms)
        if not more:
            return out
        wrappers |= more


def _blocks(page: str, wrappers: set[int]) -> tuple[list[tuple[str, int, int]], set[int], set[int]]:
    """The blocks, and where the outermost frames start that hold an article, and those that are forms.

    Elements that start at ``wrappers`` frame nothing.
    """
    frames: list[tuple[int, int, bool]] = []  # depth and start of the outermost frame around, whether it may be a wrapper
    around: set[int] = set()
    forms: set[int] = set()
    out: list[tuple[str, int, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # element, state inside it, whether it bounds a segment
    state, segment, at = OPEN, 0, 0

    def close():
        text = SPACE.sub(" ", "".join(parts)).strip()
        parts.clear()
        if text and state >= 0:
            out.append((text, state, segment))

    while at < len(page):
        token = TOKEN.match(page, at)
        start, at = at, token.end()
        tag = token[2]
        if tag is None:
            if token[0][0] != "<" or token[0] == "<":
                if state >= 0:
                    parts.append(html.unescape(token[0]))
            continue
        tag = tag.lower()
        if token[1]:
            place = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if tag in BLOCK:
                close()
            if place is not None:
                if any(bounds for _, _, bounds in stack[place:]):
                    close()
                    segment += 1
                del stack[place:]
                state = stack[-1][1] if stack else OPEN
            continue
        if tag in BLOCK:
            close()
        if tag in ENDS_P:
            place = len(stack) - 1
            while place >= 0 and stack[place][0] not in BLOCK and stack[place][0] != "button":
                place -= 1
            if place >= 0 and stack[place][0] == "p":
                if any(bounds for _, _, bounds in stack[place:]):
                    segment += 1
                del stack[place:]
                state = stack[-1][1] if stack else OPEN
        if tag in EMPTY:
            continue
        if tag in VERBATIM:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if stack and stack[-1][0] == "head" and tag not in HEAD:
            stack.pop()
            state = OPEN
        if tag in CLOSES_ITSELF and stack and stack[-1][0] == tag:
            stack.pop()
            state = stack[-1][1] if stack else OPEN
        inner, attributes = state, token[3]
        if tag in RAW:
            inner = -1
        elif state >= 0 and state != FRAMED:
            if tag in ("html", "body") or start in wrappers:
                pass
            elif tag in ARTICLE and not (attributes and frame_words(attributes)):
                inner = INSIDE
            elif tag == "header" and state == INSIDE:
                inner = INSIDE  # the heading of the article itself
            elif tag in FRAME or (attributes and frame_words(attributes, state == INSIDE)):
                inner = FRAMED
            elif attributes and re.search(r"""\brole\s*=\s*["']?main\b""", attributes, re.I):
                inner = INSIDE
        while frames and frames[-1][0] >= len(stack):
            frames.pop()
        if state == OPEN and inner == FRAMED:
            frames.append((len(stack), start, not (attributes and hidden(attributes))))
            if tag == "form" and frames[-1][2]:
                forms.add(start)
        elif state == FRAMED and frames and frames[-1][2] and tag in ARTICLE and not (attributes and frame_words(attributes)):
            around.add(frames[-1][1])
        bounds = inner != state or tag in FRAME or tag in ARTICLE or ("class" in attributes or "id" in attributes)
        if bounds:
            close()
            segment += 1
        stack.append((tag, inner, bounds))
        state = inner
    close()
    return out, around, forms
