"""A small document tree over the standard HTML tokenizer, CSS selectors on it, and both as columns.

The tree repairs what pages commonly leave out: void elements, paragraphs, list items, table parts
and options that end where the next one starts, and anything still open at the end.
Selectors are groups of compounds (tag, .class, #id, [attr], [attr=value], *) joined by descendant
or child combinators; anything else is refused.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestack.errors import SelectorError

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: An open element of the value's names ends where the key starts, up to the barrier.
ENDS = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
} | {b: ({"p"}, {"button", "table", "td", "th"}) for b in BLOCKS}


@dataclass(eq=False)
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    parent: Node | None = None
    children: list[Node | str] = field(default_factory=list)

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def html(self) -> str:
        attrs = "".join(f' {k}="{html.escape(v)}"' for k, v in self.attrs.items())
        if self.tag in VOID:
            return f"<{self.tag}{attrs}>"
        raw = self.tag in ("script", "style")
        inner = "".join((c if raw else html.escape(c, quote=False)) if isinstance(c, str) else c.html() for c in self.children)
        return f"<{self.tag}{attrs}>{inner}</{self.tag}>"

    def nodes(self):
        """Elements below this one, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def select(self, selector: str) -> list[Node]:
        tests = _compiled(selector)
        return [n for n in self.nodes() if any(_fits(n, t) for t in tests)]

    def remove(self) -> None:
        if self.parent:
            self.parent.children.remove(self)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#document")

    def handle_starttag(self, tag, attrs):
        if tag in ENDS:
            names, barrier = ENDS[tag]
            n = self.at
            while n.parent and n.tag not in barrier:
                if n.tag in names:
                    self.at = n.parent
                n = n.parent
        node = Node(tag, {}, self.at)
        for k, v in attrs:
            node.attrs.setdefault(k, v or "")
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # outside void elements the slash means nothing

    def handle_endtag(self, tag):
        n = self.at
        while n.parent and n.tag != tag:
            n = n.parent
        if n.parent:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(markup: str | None) -> Node:
    builder = _Builder()
    builder.feed(markup or "")
    builder.close()
    return builder.root


# selectors -----------------------------------------------------------------------------------

_SIMPLE = re.compile(r"""\*|(?P<tag>[A-Za-z][\w-]*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:=\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[\w-]+))\s*)?\]""", re.X)
_cache: dict[str, list] = {}


def _compound(text: str) -> list[tuple[str, str, str | None]]:
    parts, at = [], 0
    while at < len(text):
        m = _SIMPLE.match(text, at)
        if not m or (m["tag"] and at):
            raise SelectorError(f"selector outside the supported grammar: {text!r}")
        if m["tag"]:
            parts.append(("tag", m["tag"].lower(), None))
        elif m["cls"]:
            parts.append(("class", m["cls"], None))
        elif m["id"]:
            parts.append(("attr", "id", m["id"]))
        elif m["attr"]:
            value = next((m[g] for g in ("dq", "sq", "bare") if m[g] is not None), None)
            parts.append(("attr", m["attr"].lower(), value))
        at = m.end()
    return parts


def _compiled(selector: str) -> list:
    """For each selector of the group: compounds from the last to the first, each with its combinator to the left."""
    if selector not in _cache:
        group = []
        for one in selector.split(","):
            steps = re.sub(r"\s*>\s*", " > ", one).split()
            chain, joint = [], " "
            for s in steps:
                if s == ">":
                    joint = ">"
                else:
                    chain.append((_compound(s), joint))
                    joint = " "
            if not chain or joint == ">" or chain[0][1] == ">":
                raise SelectorError(f"selector outside the supported grammar: {selector!r}")
            group.append(chain[::-1])
        _cache[selector] = group
    return _cache[selector]


def _is(node: Node, compound) -> bool:
    for kind, name, value in compound:
        if kind == "tag" and node.tag != name:
            return False
        if kind == "class" and name not in node.attrs.get("class", "").split():
            return False
        if kind == "attr" and (name not in node.attrs or (value is not None and node.attrs[name] != value)):
            return False
    return True


def _fits(node: Node, chain) -> bool:
    compound, joint = chain[0]
    if not _is(node, compound):
        return False
    if len(chain) == 1:
        return True
    above = node.parent
    while above and above.parent:
        if _fits(above, chain[1:]):
            return True
        if joint == ">":
            return False
        above = above.parent
    return False


# extraction ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Selector:
    """``css::text``, ``css::html`` or ``css::attr(name)``."""

    css: str
    what: str

    @classmethod
    def parse(cls, spec: str) -> Selector:
        css, mark, what = spec.strip().rpartition("::")
        css, what = css.strip(), what.strip()
        if not mark or not css:
            raise SelectorError(f"not of the form css::text, css::html or css::attr(name): {spec!r}")
        if what not in ("text", "html") and not re.fullmatch(r"attr\([A-Za-z_:][\w:.-]*\)", what):
            raise SelectorError(f"{what!r} is none of text, html and attr(name)")
        _compiled(css)
        return cls(css, what)

    def of(self, node: Node) -> str | None:
        """What is asked of a node; empty means none."""
        if self.what == "text":
            return squeeze(node.text()) or None
        if self.what == "html":
            return squeeze(node.html()) or None
        return node.attrs.get(self.what[5:-1].lower()) or None

    def first(self, root: Node) -> str | None:
        found = root.select(self.css)
        return self.of(found[0]) if found else None

    def all(self, root: Node) -> list[str]:
        return [v for n in root.select(self.css) if (v := self.of(n))]


def squeeze(text: str | None) -> str:
    return re.sub(r"\s+", " ", text or "").strip()


def extract_first(markup: Column, spec: str) -> Column:
    """What the first match of a selector gives, or null."""
    selector = Selector.parse(spec)

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: None if p is None else selector.first(parse(p)))

    return run(markup)


def extract_all(markup: Column, spec: str) -> Column:
    """What every match gives, empties left out."""
    selector = Selector.parse(spec)

    @F.pandas_udf("array<string>")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: [] if p is None else selector.all(parse(p)))

    return run(markup)
