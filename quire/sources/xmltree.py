"""XML to trees of local names: declared charsets are honoured, HTML character references are known."""

from __future__ import annotations

import codecs
import re
from html.entities import html5
from xml.parsers import expat

from quire.sources.tree import Node

_KEEP = {"amp", "lt", "gt", "quot", "apos"}


def _known(m: re.Match) -> str:
    c = html5.get(m[1] + ";")
    return m[0] if m[1] in _KEEP or c is None else c


def declared(data: bytes) -> str | None:
    m = re.match(rb"<\?xml[^>]*\bencoding\s*=\s*[\"']([^\"']+)[\"']", data[:4096].lstrip(b" \t\r\n"))
    return m[1].decode("latin-1") if m else None


def decoded(data: bytes, fallback: str = "utf-8") -> tuple[str, str]:
    """(text, charset name) of an XML document."""
    data = data.removeprefix(b"\xef\xbb\xbf")
    name = declared(data)
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        name = "utf-16"
    if name is None:
        try:
            return data.decode("utf-8"), "UTF-8"
        except UnicodeDecodeError:
            return data.decode(fallback, "replace"), fallback
    try:
        info = codecs.lookup(name)
    except LookupError:
        raise ValueError(f"the encoding {name!r} is not supported") from None
    return data.decode(info.name, "replace"), "UTF-8" if info.name == "utf-8" else name.lower()


def parse(data: bytes, fallback: str = "utf-8") -> tuple[Node, str]:
    """(root element, charset name); damage and several roots are errors."""
    text, charset = decoded(data, fallback)
    text = re.sub(r"\A\s*<\?xml[^>]*\?>", "", text)
    text = re.sub(r"&([A-Za-z][A-Za-z0-9]*);", _known, text)
    top = Node("#document")
    open_ = [top]
    p = expat.ParserCreate("utf-8")
    p.buffer_text = True

    def start(name: str, attrs: dict) -> None:
        n = Node(name.rpartition(":")[2], {k.rpartition(":")[2]: v for k, v in attrs.items()} | {k: v for k, v in attrs.items() if ":" in k}, open_[-1])
        open_[-1].kids.append(n)
        open_.append(n)

    p.StartElementHandler = start
    p.EndElementHandler = lambda _: open_.pop()
    p.CharacterDataHandler = lambda t: open_[-1].kids.append(t)
    try:
        p.Parse(text.encode("utf-8", "replace"), True)
    except expat.ExpatError as e:
        raise ValueError(f"damaged XML: {e}") from None
    return top.kids[0], charset


def child(n: Node | None, tag: str) -> Node | None:
    return next((k for k in n.kids if isinstance(k, Node) and k.tag == tag), None) if n else None


def children(n: Node | None, tag: str | None = None) -> list[Node]:
    return [k for k in n.kids if isinstance(k, Node) and tag in (None, k.tag)] if n else []
