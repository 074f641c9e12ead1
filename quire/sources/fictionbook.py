"""FictionBook files: description, bodies written as markup, images from base64."""

from __future__ import annotations

import base64
import binascii
import html
import re

from quire.sources import images
from quire.sources.archive import Archive
from quire.sources.tree import Node, words
from quire.sources.xmltree import child, children, declared, parse

# Inline elements and what they are written as.
INLINE = {"emphasis": "em", "strong": "strong", "strikethrough": "s", "sup": "sup", "sub": "sub", "code": "code"}


def said(n: Node | None) -> str:
    return words(n.text()) if n else ""


class Writer:
    """Bodies as markup: each element has a rule, unknown containers are transparent."""

    def __init__(self, ids: dict[str, int], cover: str) -> None:
        self.ids, self.cover, self.first = ids, cover, True

    def body(self, n: Node, notes: bool) -> str:
        out = []
        for k in children(n):
            if not (notes and k.tag == "title"):
                out.append(("<mbp:pagebreak/>" if k.tag == "section" and not notes else "") + self.block(k, int(notes)))
        return "".join(out)

    def blocks(self, n: Node, depth: int) -> str:
        return "".join((html.escape(k) if k.strip() else "") if isinstance(k, str) else self.block(k, depth) for k in n.kids)

    def block(self, n: Node, depth: int) -> str:
        t = n.tag
        if t == "section":
            return self.blocks(n, depth + 1)
        if t == "title":
            k = min(max(depth, 1), 6)
            return f"<h{k}>{self.lines(n)}</h{k}>"
        if t in ("p", "text-author", "date"):
            return f"<p>{self.inside(n)}</p>"
        if t == "subtitle":
            return f"<p><strong>{self.inside(n)}</strong></p>"
        if t == "empty-line":
            return "<br>"
        if t in ("epigraph", "cite"):
            return f"<blockquote>{self.blocks(n, depth)}</blockquote>"
        if t == "poem":
            return f"<blockquote>{''.join(self.verse(k, depth) for k in children(n))}</blockquote>"
        if t == "stanza":
            return f"<blockquote>{self.verse(n, depth)}</blockquote>"
        if t == "table":
            rows = [" ".join(self.inside(c) for c in children(r) if c.tag in ("td", "th")) for r in children(n, "tr")]
            return "".join(f"<p>{r}</p>" for r in rows)
        return self.image(n) if t == "image" else self.blocks(n, depth)

    def verse(self, n: Node, depth: int) -> str:
        if n.tag == "title":
            return f"<p><strong>{self.lines(n)}</strong></p>"
        if n.tag != "stanza":
            return self.block(n, depth)
        out, begun = "<p>", False
        for k in children(n):
            if k.tag == "v":
                out, begun = out + ("<br>" if begun else "") + self.inside(k), True
            elif k.tag in ("title", "subtitle"):
                out += f"<strong>{self.lines(k)}</strong><br>"
        return out + "</p>"

    def lines(self, n: Node) -> str:
        out, begun = "", False
        for k in n.kids:
            if isinstance(k, str):
                out += html.escape(k) if k.strip() else ""
            elif k.tag == "p":
                out, begun = out + ("<br>" if begun else "") + self.inside(k), True
            elif k.tag == "empty-line":
                out += "<br>"
        return out

    def inside(self, n: Node) -> str:
        return "".join(html.escape(k) if isinstance(k, str) else self.inline(k) for k in n.kids)

    def inline(self, n: Node) -> str:
        if n.tag in INLINE:
            return f"<{INLINE[n.tag]}>{self.inside(n)}</{INLINE[n.tag]}>"
        if n.tag == "image":
            return self.image(n)
        href = n.attrs.get("href", "") if n.tag == "a" else ""
        return f'<a href="{html.escape(href)}">{self.inside(n)}</a>' if href and not href.startswith("#") else self.inside(n)

    def image(self, n: Node) -> str:
        ref, first, self.first = n.attrs.get("href", "").removeprefix("#"), self.first, False
        k = self.ids.get(ref)
        return "" if k is None or (first and ref == self.cover) else f'<img recindex="{k}">'


def describe(desc: Node | None) -> tuple[dict, str]:
    """(record, id of the cover); of repeated scalars the last counts."""
    r = {k: "" for k in ("title", "publisher", "description", "isbn", "published", "rights", "language", "asin", "compression")} | {"authors": [], "subjects": []}
    cover = ""
    for n in children(child(desc, "title-info")):
        if n.tag == "book-title":
            r["title"] = said(n)
        elif n.tag == "author":
            name = " ".join(s for f in ("first-name", "middle-name", "last-name") if (s := said(child(n, f)))) or said(child(n, "nickname"))
            r["authors"] += [name] if name else []
        elif n.tag == "annotation":
            r["description"] = said(n)
        elif n.tag == "date":
            r["published"] = said(n) or n.attrs.get("value", "").strip()
        elif n.tag == "lang":
            r["language"] = said(n)
        elif n.tag == "genre":
            r["subjects"] += [said(n)] if said(n) else []
        elif n.tag == "coverpage" and not cover and (pic := child(n, "image")):
            cover = pic.attrs.get("href", "").removeprefix("#")
    pub = child(desc, "publish-info")
    r["publisher"], r["isbn"] = said(child(pub, "publisher")), said(child(pub, "isbn"))
    r["published"] = r["published"] or said(child(pub, "year"))
    return r, cover


def decode(data: bytes) -> dict:
    try:
        root, charset = parse(data, "windows-1251")
    except ValueError as e:
        raise ValueError(f"this FictionBook file is damaged: {e}") from None
    record, cover = describe(child(root, "description"))
    res: list[tuple[int, str, bytes]] = []
    ids: dict[str, int] = {}
    for b in children(root, "binary"):
        try:
            raw = base64.b64decode(re.sub(r"[ \t\r\n]", "", b.text()), validate=True)
        except (binascii.Error, ValueError):
            continue
        if kind := images.sniff(raw):
            res.append((len(res) + 1, kind, raw))
            ids.setdefault(b.attrs.get("id", ""), len(res))
    w, out = Writer(ids, cover), []
    for i, b in enumerate(children(root, "body")):
        notes = i > 0 and b.attrs.get("name") == "notes"
        out.append(("<mbp:pagebreak/><h1>Notes</h1>" if notes else "") + w.body(b, notes))
    markup = "".join(out)
    name = "windows-1251" if charset == "windows-1251" and declared(data) is None else charset
    return record | {"format": "FictionBook 2", "encoding": name, "html": markup, "flows": [], "text_bytes": len(markup.encode()), "resources": res, "cover": ids.get(cover) if cover else None, "paged": False}


def decode_zipped(data: bytes) -> dict:
    a = Archive(data)
    name = next((n for n in a.names() if n.lower().endswith(".fb2")), None)
    if name is None:
        raise ValueError("this archive does not contain a FictionBook")
    return decode(a.read(name))
