"""HTML as a tree, with implied end tags, on the standard library's tokenizer."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import escape
from html.parser import HTMLParser
from itertools import count, repeat

from quire.functions.constants import ALLOWED_TAGS

VOID = set("area base br col embed hr img input link meta source track wbr".split())
#: Open elements that the start of another one closes.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "option": {"option"},
}
CLOSE_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Elements that hold no content of the document.
DROPPED = set("script style nav footer header aside iframe noscript svg".split())


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)
    parent: "Node | None" = None

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def find(self, *tags: str):
        for c in self.children:
            if isinstance(c, Node):
                if c.tag in tags:
                    yield c
                yield from c.find(*tags)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root")

    def handle_starttag(self, tag, attrs):
        closes = CLOSES.get(tag, set()) | ({"p"} if tag in CLOSE_P else set())
        while self.at.tag in closes and self.at.parent:
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, parent=self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        node = self.at
        while node.parent and node.tag != tag:
            node = node.parent
        if node.parent:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def serialize(node: Node, drop: set[str] = DROPPED, keep=frozenset(ALLOWED_TAGS), away=("style", "class")) -> str:
    """HTML of a node's children: ``drop`` goes with its content, tags outside ``keep`` go alone."""
    out = []
    for c in node.children:
        if isinstance(c, str):
            out.append(escape(c, quote=False))
        elif c.tag in drop or (c.tag == "link" and c.attrs.get("rel") == "stylesheet"):
            continue
        else:
            inner = serialize(c, drop, keep, away)
            if c.tag in keep:
                attrs = "".join(f' {k}="{escape(v)}"' for k, v in c.attrs.items() if k not in away)
                out.append(f"<{c.tag}{attrs}>" if c.tag in VOID else f"<{c.tag}{attrs}>{inner}</{c.tag}>")
            else:
                out.append(inner)
    return "".join(out)


def standard_html(source: str, drop: set[str] = DROPPED, away=("style", "class")) -> tuple[str, str | None, str | None, str | None]:
    """(content in the dialect, title, author, language) of a page."""
    root = parse(source)
    title = next((n.text().strip() for n in root.find("title")), "") or None
    author = next((n.attrs.get("content") for n in root.find("meta") if n.attrs.get("name") == "author"), None) or None
    language = next((n.attrs.get("lang") for n in root.find("html")), None) or next((n.attrs.get("content") for n in root.find("meta") if n.attrs.get("http-equiv") == "content-language"), None) or None
    body = next(root.find("body"), root)
    return serialize(body, drop | {"head", "title"}, away=away).strip(), title, author, language


# ---- Markdown --------------------------------------------------------------------------------------
#
# A tree becomes runs: pieces of Markdown with breaks between them as objects of their own.  What an element adds is
# said by one entry of a table; elements without an entry are their contents.


class _Break:
    """A forced line end; it survives the joining of lines around it."""


BREAK = _Break()
Runs = list["str | _Break"]


def _written(runs: Runs) -> str:
    return "".join("\n" if r is BREAK else r for r in runs)


def _joined(text: str) -> str:
    return re.sub(r"\s*\n\s*", " ", text)


def _split(runs: Runs) -> list[str]:
    """The text between breaks."""
    parts = [""]
    for r in runs:
        if r is BREAK:
            parts.append("")
        else:
            parts[-1] += r
    return parts


def _trimmed(runs: Runs) -> Runs:
    """Runs without white space at either end; breaks there stay."""
    parts = _split(runs)
    parts[0] = parts[0].lstrip()
    parts[-1] = parts[-1].rstrip()
    return [x for part in parts for x in (BREAK, part)][1:]


def _contents(node: Node) -> Runs:
    return [run for c in node.children for run in ([c] if isinstance(c, str) else _RUNS.get(c.tag, _contents)(c))]


def _paragraph(node: Node) -> Runs:
    text = "\n".join(_joined(_written([part])) for part in _split(_trimmed(_contents(node))))
    return [text, "\n\n"] if text else []


def _between(mark: str):
    return lambda node: [mark, *_trimmed(_contents(node)), mark]


def _heading(level: int):
    return lambda node: [f"\n{'#' * level} {_joined(node.text()).strip()}\n\n"]


def _items(marks):
    def runs(node: Node) -> Runs:
        out: Runs = []
        for mark, item in zip(marks(), (c for c in node.children if isinstance(c, Node) and c.tag == "li"), strict=False):
            out += [mark, " ", *_trimmed(_contents(item)), "\n"]
        return [*out, "\n"]

    return runs


def _link(node: Node) -> Runs:
    name, target = _joined(node.text()).strip(), node.attrs.get("href")
    return [f"[{name}]({target})" if target else name]


def _quote(node: Node) -> Runs:
    return [run if run is BREAK else run.replace("\n", "\n> ") for run in ["> ", *_trimmed(_contents(node))]] + ["\n\n"]


def _fence(node: Node) -> Runs:
    return [f"\n```\n{next(node.find('code'), node).text()}\n```\n\n"]


def _code(node: Node) -> Runs:
    return [] if node.parent is not None and node.parent.tag == "pre" else [f"`{node.text()}`"]


def _grid(node: Node) -> Runs:
    """A pipe table as wide as its widest row, with the first row as head."""
    cells = [[cell.text().strip() for cell in row.find("th", "td")] for row in node.find("tr")]
    if not cells:
        return []
    width = max(map(len, cells))
    cells.insert(1, ["---"] * width)
    return ["".join("| " + " | ".join(row + [""] * (width - len(row))) + " |\n" for row in cells), "\n"]


_RUNS = {
    **{f"h{k}": _heading(k) for k in range(1, 7)},
    **dict.fromkeys(("strong", "b"), _between("**")), **dict.fromkeys(("em", "i"), _between("*")),
    "p": _paragraph, "br": lambda node: [BREAK], "hr": lambda node: ["\n---\n\n"], "a": _link, "table": _grid,
    "ul": _items(lambda: repeat("-")), "ol": _items(lambda: (f"{k}." for k in count(1))),
    "blockquote": _quote, "pre": _fence, "code": _code,
}


def markdown(source: str) -> str:
    """Markdown of HTML."""
    return _written(_trimmed(_contents(parse(source))))
