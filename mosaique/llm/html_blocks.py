"""HTML pages as blocks of text, by a tolerant scan of tags (used by operator 6)."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

#: Elements that begin and end a block, that hold no text of their own, that are never main text,
#: and that have no end tag.
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
NOISE = frozenset(
    "head title script style noscript template nav header footer aside form menu button select option textarea input iframe "
    "object embed svg canvas audio video dialog search noembed noframes map".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a new block ends when they are open.
CLOSED_BY_BLOCK = frozenset(["p", "h1", "h2", "h3", "h4", "h5", "h6"])
#: Words in class, id or role that mark menus, notices, adverts, forms and reader comments.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo cookie "
    "cookies complementary dialog disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices "
    "outbrain pagination popup promo promoted promotion related replies responses search share sharing sidebar signup social "
    "sponsor sponsored subscribe subscription taboola toolbar widget".split()
)
#: A quote delimits a value directly after an equals sign only; one that is never closed delimits nothing.
_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s]*))?")
_WORD = re.compile(r"[a-z]+|[0-9]+")
_SPACES = re.compile(r"\s+")
#: Open elements beyond which one that is neither noise nor main text is not noted as open, as browsers do; its text stays.
MOST_OPEN = 512


@dataclass
class Block:
    text: str
    #: Whether the block stands in an article or main element.
    main: bool
    #: Whether it stands in an element that is never main text.
    noise: bool


def _marked(attributes: str) -> bool:
    if "=" not in attributes and "hidden" not in attributes.lower():
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name in ("class", "id", "role") and any(w in MARKS for w in _WORD.findall(value)):
            return True
    return False


def blocks(page: str) -> list[Block]:
    """The page's blocks in order: character references decoded, white space as one space, trimmed, none empty.

    An article or main element below an element that is never main text is part of that. Marks of a class do not
    count on html, body, article and main. Unclosed elements end with the page or with an ancestor. Elements nested
    beyond MOST_OPEN lose their nesting, not their text, so the time grows with the page's length alone."""
    out: list[Block] = []
    parts: list[str] = []
    #: Open elements: name, and whether it is noise or main text.
    stack: list[tuple[str, bool, bool]] = []
    open_ = Counter()
    noise = main = 0

    def flush() -> None:
        if parts:
            text = _SPACES.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                out.append(Block(text, main > 0, noise > 0))

    def close(depth: int) -> None:
        nonlocal noise, main
        flush()
        for name, n, m in stack[depth:]:
            open_[name] -= 1
            noise -= n
            main -= m
        del stack[depth:]

    at = 0
    while at < len(page):
        found = _TAG.search(page, at)
        if not found:
            parts.append(page[at:])
            break
        if found.start() > at:
            parts.append(page[at : found.start()])
        at = found.end()
        if not found[2]:
            if found[0].startswith("<![CDATA["):
                parts.append(html.escape(found[0][9:].removesuffix("]]>")))
            continue
        name = found[2].lower()
        if found[1]:
            if name == "p" and not open_["p"] or name == "br":
                flush()
                continue
            depth = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name) if open_[name] else None
            if depth is not None:
                if name in BLOCK or any(stack[i][1] or stack[i][2] or stack[i][0] in BLOCK for i in range(depth, len(stack))):
                    # an inline end tag does not end the blocks around it
                    if name in BLOCK or name in NOISE or stack[depth][1]:
                        close(depth)
                    else:
                        open_[name] -= 1
                        del stack[depth]
                else:
                    open_.subtract(x[0] for x in stack[depth:])
                    del stack[depth:]
            elif name in BLOCK:
                flush()
            continue
        if name in BLOCK:
            flush()
            if name != "br" and stack and stack[-1][0] in CLOSED_BY_BLOCK and (stack[-1][0] == "p" or name == stack[-1][0]):
                close(len(stack) - 1)
            if name in ("li", "dt", "dd", "td", "th", "tr", "option") and stack and stack[-1][0] == name:
                close(len(stack) - 1)
        bad = name in NOISE or name not in ("html", "body", "article", "main") and _marked(found[3])
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|$)", re.I).search(page, at)
            inside = page[at : end.start() if end else len(page)]
            at = end.end() if end else len(page)
            if name in ("title", "textarea") and inside:
                flush()
                noise += 1
                parts.append(inside)
                flush()
                noise -= 1
            continue
        if name in VOID or found[3].endswith("/") and name not in BLOCK:
            continue
        if bad:
            flush()
        good = name in ("article", "main") and not noise and not bad
        if good:
            flush()
        if len(stack) >= MOST_OPEN and not bad and not good:
            continue
        stack.append((name, bad, good))
        open_[name] += 1
        noise += bad
        main += good
    flush()
    return out
