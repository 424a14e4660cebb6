"""The blocks of text, the tokens and their depths of one HTML page."""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

import xxhash

_PART = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?/][^>]*>?|<[a-zA-Z][^<>]*\Z",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)

# Names of HTML elements by their part in a page.
_RAW = frozenset("script style textarea title noscript iframe template xmp noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
_ASIDE = frozenset("nav aside footer form button select dialog head svg menu option object".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
# Names of classes and ids that stand for what surrounds an article.
_AROUND = re.compile(
    r"(?:^|[-_])(?:ads?|adbox|adslot|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|footer|masthead|topbar|"
    r"cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|comments?|commentlist|disqus|repl(?:y|ies)|respond|"
    r"discussion|related|recommend\w*|share|sharing|social|widget|pagination|pager|toolbar|login|search|skip|copyright|legal|header)(?:$|[-_]|\d)",
    re.I,
)
_WITH = re.compile(r"^(?:with|has|no|without|is)[-_]", re.I)
_NEVER = frozenset("html body main article".split())


class Block(NamedTuple):
    place: int  # among the page's tokens
    text: str
    aside: bool  # inside a part that isn't the article's
    article: bool
    main: bool
    linked: int = 0  # characters of it inside links, about


class _Open(NamedTuple):
    name: str
    aside: bool
    article: bool
    main: bool
    path: int
    depth: int = 0  # block elements around its text, html and body not counted
    link: bool = False


def _h(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _is_aside(name: str, rest: str, within: _Open) -> bool:
    if name in _ASIDE or name == "header" and not within.article:
        return True
    if name == "article":
        return within.article  # an article in an article is a reader's comment
    if name in _NEVER or not rest:
        return False
    for m in _ATTRIBUTE.finditer(rest):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" and name not in ("a", "span", "i", "b"):
            return True
        if key == "role" and value.lower() in _ROLES:
            return True
        if key in ("class", "id") and any(_AROUND.search(c) and not _WITH.search(c) for c in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).split()):
            return not (name == "header" or name in ("h1", "h2", "h3") or within.article and re.fullmatch(r"(?i)[\w-]*header[\w-]*", value))
    return False


def parse(html: str) -> tuple[list[int], list[Block], list[int]]:
    """The page's tokens in order (hashes of elements with their paths, and of blocks of text with theirs), its blocks, and each token's depth: html and body have 0, a block that of what holds it and one more."""
    tokens: list[int] = []
    depths: list[int] = []
    blocks: list[Block] = []
    stack = [_Open("", False, False, False, 0)]
    # what a block says, and what inline parts set aside inside it say
    held: dict[bool, list[str]] = {False: [], True: []}
    owner = {False: stack[0], True: stack[0]}
    links = {False: 0, True: 0}

    def flush() -> None:
        for side in (False, True):
            whole = " ".join("".join(held[side]).split())
            held[side].clear()
            if whole:
                blocks.append(Block(len(tokens), whole, side, owner[side].article, owner[side].main, min(links[side], len(whole))))
                tokens.append(_h(f"{owner[side].path} {whole}"))
                depths.append(owner[side].depth + 1)
            links[side] = 0

    def add(piece: str) -> None:
        if piece:
            top = stack[-1]
            if not held[top.aside]:
                owner[top.aside] = top
            held[top.aside].append(unescape(piece))
            if top.link:
                links[top.aside] += len(held[top.aside][-1])

    at, end = 0, len(html)
    while at < end:
        m = _PART.search(html, at)
        if not m:
            add(html[at:])
            break
        add(html[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        block = name in _BLOCK
        if m["end"]:
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name), 0)
            if k:
                if block or any(x.name in _BLOCK for x in stack[k:]):
                    flush()
                del stack[k:]
            continue
        if name == "br":
            add(" ")
            continue
        if block:
            flush()
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name in ("p", *_BLOCK)), 0)
            if k and stack[k].name == "p":  # a block ends an open paragraph
                del stack[k:]
            if name in _CLOSES:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name in _CLOSES[name]:
                        del stack[i:]
                        break
                    if stack[i].name in _HOLDS[name]:
                        break
        within = stack[-1]
        aside = within.aside or _is_aside(name, m["rest"], within)
        path = _h(f"{within.path}/{name}") if block else within.path
        depth = within.depth + (block and name not in ("html", "body"))
        if block:
            tokens.append(path)
            depths.append(depth)
        if name in _RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, at)
            at = close.end() if close else end
            continue
        if name in _VOID or m["rest"].endswith("/") and name in ("path", "circle", "rect", "use"):
            continue
        is_main = within.main or name == "main" or "articlebody" in m["rest"].lower()
        stack.append(_Open(name, aside, within.article or name == "article" and not aside, is_main, path, depth, within.link or name == "a"))
    flush()
    return tokens, blocks, depths


def main_blocks(blocks: list[Block]) -> list[Block]:
    """The blocks of the article; without one those of the main part; without that all that aren't set aside."""
    own = [b for b in blocks if not b.aside]
    for part in ([b for b in own if b.article], [b for b in own if b.main]):
        if part:
            return part
    return own
