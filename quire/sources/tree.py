"""A lenient element tree for pages: void elements, implied paragraph and item ends, raw elements; written back as markup."""

from __future__ import annotations

import html
import re

from quire.operators.flatten import RAW, tokens

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote center div dl dd dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table ul".split())


class Node:
    __slots__ = ("tag", "attrs", "kids", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None) -> None:
        self.tag, self.attrs, self.kids, self.parent = tag, attrs or {}, [], parent

    def walk(self):
        """Elements in document order, itself first."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(k for k in reversed(n.kids) if isinstance(k, Node))

    def find(self, tag: str) -> Node | None:
        return next((n for n in self.walk() if n.tag == tag), None)

    def text(self) -> str:
        return "".join(k if isinstance(k, str) else k.text() for k in self.kids)

    def drop(self) -> None:
        if self.parent:
            self.parent.kids = [k for k in self.parent.kids if k is not self]

    def swap(self, other: Node) -> None:
        if self.parent:
            self.parent.kids = [other if k is self else k for k in self.parent.kids]
            other.parent = self.parent

    def markup(self) -> str:
        if self.tag == "#document":
            return "".join(html.escape(k, quote=False) if isinstance(k, str) else k.markup() for k in self.kids)
        head = "<" + self.tag + "".join(f' {k}="{html.escape(v)}"' for k, v in self.attrs.items()) + ">"
        if self.tag in VOID:
            return head
        inner = "".join((k if self.tag in ("script", "style") else html.escape(k, quote=False)) if isinstance(k, str) else k.markup() for k in self.kids)
        return f"{head}{inner}</{self.tag}>"


def expand_closed(markup: str) -> str:
    """Elements that close themselves get an end tag, unless they are void."""
    return re.sub(r"<([A-Za-z][\w:.-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*?)\s*/>", lambda m: m[0] if m[1].lower() in VOID else f"<{m[1]}{m[2]}></{m[1]}>", markup)


def parse(markup: str) -> Node:
    root = Node("#document")
    open_ = [root]
    for t in tokens(markup):
        if t[0] == "text":
            open_[-1].kids.append(t[1])
        elif t[0] == "open":
            name = t[1]
            if name in BLOCKS and open_[-1].tag == "p":
                open_.pop()
            if name == "li" and open_[-1].tag == "li":
                open_.pop()
            n = Node(name, t[2], open_[-1])
            open_[-1].kids.append(n)
            if name not in VOID and not (t[3] and name not in RAW):
                open_.append(n)
        elif any(n.tag == t[1] for n in open_[1:]):
            while open_.pop().tag != t[1]:
                pass
    return root


def words(text: str) -> str:
    return " ".join(text.split())
