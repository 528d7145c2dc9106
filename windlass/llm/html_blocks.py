"""Leaf blocks of a page: a forgiving one-pass parse, and the features of a block."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

# Fixed values of HTML: elements whose content is no text of the page, elements without content, and inline elements.
RAW = frozenset("script style template textarea title iframe select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var math mi mo mn ms mtext mrow msup msub msubsup mfrac msqrt mroot munder mover semantics svg text tspan object audio video canvas".split())
CLOSED_BY = {"p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
             "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
_NAME_OF = re.compile(r"/?[a-zA-Z][^\s/>]*")
_PLAIN = re.compile(r"[^>\"']*")
#: Open elements beyond so many are not kept apart, as in browsers: it bounds the work per tag.
DEEP = 512
_ATTR = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_NAME = re.compile(r"[a-z]+")
_SHOUT = re.compile(r"©|copyright|all rights|cookie|subscribe|newsletter|sign up|log ?in|privacy|terms of|advert|sponsor|share this|repl(?:y|ies)|comments?\b|read more|posted by", re.I)


class Block:
    """A run of text between block boundaries, with its open elements."""

    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple[tuple[str, tuple[str, ...]], ...], text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


class _Tags:
    """Finds where tags end, in time that grows with the page only.

    A quote counts where it opens a value, after an equals sign, and is closed before the page's last `>`; any other is an
    ordinary character, so that a quote that was left open hides no more than its tag.
    """

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")

    def end(self, at: int) -> int:
        """The position of the `>` that ends the tag whose name ends at `at`; -1 where there is none."""
        page, last = self.page, self.last
        while at <= last:
            at = _PLAIN.match(page, at).end()
            if at > last or page[at] == ">":
                break
            back = at - 1
            while page[back] in " \t\n\r\f":
                back -= 1
            close = page.find(page[at], at + 1, last) if page[back] == "=" else -1
            at = close + 1 if close >= 0 else at + 1
        return at if at <= last else -1


def _tokens(page: str) -> Iterator[tuple[str | None, str, int]]:
    """(text, "", end) or (None, inside of a tag, end) in page order; comments and declarations are left out.

    The caller may send back a position to go on from.
    """
    tags, at, n = _Tags(page), 0, len(page)
    while at < n:
        if page[at] != "<":
            end = page.find("<", at)
            end = n if end < 0 else end
            go = yield page[at:end], "", end
        elif page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = n if end < 0 else end + 3
            go = None
        elif page[at + 1 : at + 2] in ("!", "?") and at < tags.last:
            end = page.find(">", at) + 1
            go = None
        else:
            name = _NAME_OF.match(page, at + 1) if at < tags.last else None
            end = tags.end(name.end()) + 1 if name else 0
            if end:
                go = yield None, page[at + 1 : end - 1], end
            else:
                end = at + 1
                go = yield "<", "", end
        at = end if go is None else go


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in page order, white space folded; blocks without text are left out.

    Comments, markup and the content of RAW elements never are text; that of math, noscript, object or svg is. An end tag
    closes what was left open inside it; one without a start is ignored; a line break is white space.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = 0
    in_link = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = "".join(parts)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                out.append(Block(tuple(x for x in stack if x[0] not in INLINE), text, linked))
            parts.clear()
        linked = 0

    lower, tokens, go = None, _tokens(page), None
    opened: dict[str, int] = {}

    def close_from(k: int) -> None:
        nonlocal in_link
        for name, _ in stack[k:]:
            opened[name] -= 1
            in_link -= name == "a"
        del stack[k:]

    while True:
        try:
            text, inside, at = tokens.send(go)
        except StopIteration:
            break
        go = None
        if text is not None:
            parts.append(text)
            if in_link:
                linked += len(text)
            continue
        m = _NAME_OF.match(inside)
        name, attrs = m.group(), inside[m.end() :]
        if name[0] == "/":
            tag = name[1:].lower()
            if tag not in INLINE:
                flush()
            if opened.get(tag):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        close_from(k)
                        break
                    if tag in INLINE and stack[k][0] not in INLINE:
                        break
            continue
        tag = name.lower()
        if tag in RAW:
            lower = page.lower() if lower is None else lower
            end = lower.find("</" + tag, at) if len(lower) == len(page) else -1
            if end < 0:
                found = re.compile("</" + tag, re.I).search(page, at)
                end = found.start() if found else len(page)
            go = page.find(">", end) + 1 or len(page)
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                parts.append(" ")
            continue
        if tag not in INLINE:
            flush()
            for k in range(len(stack) - 1, -1, -1):  # an end tag that may be left out
                if stack[k][0] in CLOSED_BY and tag in CLOSED_BY[stack[k][0]]:
                    close_from(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        words: tuple[str, ...] = ()
        if attrs and ("=" in attrs):
            words = tuple(dict.fromkeys(w for a in _ATTR.findall(attrs) for w in _NAME.findall(a.lower())))
        if (not attrs.endswith("/") or tag in INLINE) and len(stack) < DEEP:
            stack.append((tag, words))
            opened[tag] = opened.get(tag, 0) + 1
            in_link += tag == "a"
    flush()
    return out


def features_of(block: Block) -> list[str]:
    """Ancestor-tag and text features of a block, each once."""
    found = {"bias"}
    for tag, words in block.path:
        if tag not in ("html", "body"):
            found.add("tag:" + tag)
        for w in words:
            found.add("name:" + w)
    if block.path:
        found.add("leaf:" + block.path[-1][0])
    text = block.text
    n = text.count(" ") + 1
    found.add("words:" + ("1-3" if n < 4 else "4-9" if n < 10 else "10-24" if n < 25 else "25+"))
    share = block.linked / len(text)
    found.add("links:" + ("none" if share == 0 else "some" if share < 0.5 else "most"))
    found.add("stop:" + ("yes" if text[-1] in ".!?…。:;\"”»" else "no"))
    if _SHOUT.search(text):
        found.add("phrase" + (":short" if n < 25 else ":long"))
    if text.count(",") + text.count(".") >= 3:
        found.add("clauses")
    return sorted(found)
