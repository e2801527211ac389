"""A small forgiving HTML reader: elements in page order with their parents, and the texts between them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title select option".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
ENDS_P = BLOCK - {"body", "head", "html", "tbody", "thead", "tfoot", "tr", "legend", "summary"}
SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table body html article section div".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<(?=/?[a-zA-Z])[^>]*\Z", re.S)
NAMING = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
LABEL = re.compile(r"""data-content\s*=\s*["']?([01])""")


@dataclass
class Page:
    tag: list[str] = field(default_factory=lambda: ["#root"])
    parent: list[int] = field(default_factory=lambda: [-1])
    attrs: list[str] = field(default_factory=lambda: [""])
    #: (element, text), and (element, None) wherever a block begins or ends, in page order
    stream: list[tuple[int, str | None]] = field(default_factory=list)


def read(html: str) -> Page:
    page = Page()
    stack = [0]
    at, n = 0, len(html)

    def text(a: int, b: int) -> None:
        if b > a:
            page.stream.append((stack[-1], unescape(html[a:b]) if "&" in html[a:b] else html[a:b]))

    def close(depth: int) -> None:
        while len(stack) > depth:
            k = stack.pop()
            if page.tag[k] in BLOCK:
                page.stream.append((k, None))

    while at < n:
        m = TOKEN.search(html, at)
        if not m:
            text(at, n)
            break
        text(at, m.start())
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if page.tag[stack[depth]] == name:
                    close(depth)
                    break
            continue
        if name in ENDS_P or name in SAME_ENDS:
            ends = SAME_ENDS.get(name, frozenset())
            for depth in range(len(stack) - 1, 0, -1):
                open_tag = page.tag[stack[depth]]
                if open_tag in ends or open_tag == "p" and name in ENDS_P:
                    close(depth)
                    break
                if open_tag in SCOPES:
                    break
        k = len(page.tag)
        page.tag.append(name)
        page.parent.append(stack[-1])
        page.attrs.append(m[3])
        if name in BLOCK:
            page.stream.append((k, None))
        if name in ("br", "td", "th"):  # cells of a row stay apart
            page.stream.append((stack[-1], " "))
        if name in VOID or m[3].endswith("/") and name not in BLOCK:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else n
            continue
        stack.append(k)
    close(1)
    return page


def blocks(page: Page, wanted: list[bool]) -> list[str]:
    """Texts of the wanted elements, block by block, white space made single and trimmed; empty blocks are left out."""
    out: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        joined = " ".join("".join(parts).split())
        if joined:
            out.append(joined)
        parts.clear()

    for k, piece in page.stream:
        if piece is None:
            flush()
        elif wanted[k]:
            parts.append(piece)
    flush()
    return out
