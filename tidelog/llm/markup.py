"""A small HTML tokenizer: balanced start, text and end events with the usual implied end tags."""

from __future__ import annotations

import re
from html import unescape

START, TEXT, END = 0, 1, 2

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup; of these, those whose content is text.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Start tag: the open elements it ends, and those at which the search stops.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select", "datalist")), "tbody": (("thead", "tbody", "tr", "td", "th"), ("table",)), "tfoot": (("tbody", "tr", "td", "th"), ("table",)),
}
_P_SCOPE = frozenset("table td th button caption object article section div".split())


def attributes(raw: str) -> dict[str, str]:
    """Attributes of a start tag by lower-case name; the first of a name counts."""
    out: dict[str, str] = {}
    for name, value in _ATTR.findall(raw):
        out.setdefault(name.lower(), unescape(value.strip("\"'")) if value else "")
    return out


def events(html: str) -> list[tuple]:
    """(START, tag, raw attributes), (TEXT, decoded text, ''), (END, tag, '') in order, balanced.

    Comments, declarations and the contents of scripts and styles are left out. Unclosed elements end with what holds
    them; end tags that match nothing are ignored.
    """
    out: list[tuple] = []
    stack: list[str] = []
    open_n: dict[str, int] = {}
    add, at, n = out.append, 0, len(html)

    def pop_to(k: int) -> None:
        while len(stack) > k:
            t = stack.pop()
            open_n[t] -= 1
            add((END, t, ""))

    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            break
        if m.start() > at:
            add((TEXT, unescape(html[at : m.start()]), ""))
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                add((TEXT, m[0][9:].removesuffix("]]>"), ""))
            continue
        tag = tag.lower()
        if m[1]:
            if open_n.get(tag):
                k = len(stack) - 1
                while stack[k] != tag:
                    k -= 1
                pop_to(k)
            continue
        if tag in CLOSES_P and open_n.get("p"):
            k = len(stack) - 1
            while k >= 0 and stack[k] != "p" and stack[k] not in _P_SCOPE:
                k -= 1
            if k >= 0 and stack[k] == "p":
                pop_to(k)
        if tag in _ENDS:
            ends, stops = _ENDS[tag]
            k = low = len(stack)
            while k > 0 and stack[k - 1] not in stops:
                k -= 1
                if stack[k] in ends:
                    low = k
            pop_to(low)
        raw = m[3]
        add((START, tag, raw))
        if tag in VOID or raw.endswith("/"):
            add((END, tag, ""))
        elif tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.I).search(html, at)
            if tag == "textarea":
                add((TEXT, unescape(html[at : close.start()]), ""))
            at = max(close.end(), at)
            add((END, tag, ""))
        else:
            stack.append(tag)
            open_n[tag] = open_n.get(tag, 0) + 1
    if at < n:
        add((TEXT, unescape(html[at:]), ""))
    pop_to(0)
    return out
