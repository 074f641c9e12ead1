"""Single web pages and plain text files."""

from __future__ import annotations

import base64
import binascii
import html
import os
import re
from urllib.parse import unquote

from quire.sources import images
from quire.sources.tree import Node, expand_closed, parse, words

#: Largest image or stylesheet beside a page.
SIDE_LIMIT = 64 << 20
EMPTY = {k: "" for k in ("title", "publisher", "description", "isbn", "published", "rights", "language", "asin", "compression")}
# Frame lines of Project Gutenberg texts, Roman numerals, and the words that open a chapter heading.
START = r"(?im)^\*\*\* *START OF TH(?:E|IS) PROJECT GUTENBERG EBOOK[^\n]*$"
END = r"(?im)^\*\*\* *END OF"
ROMAN = r"(?i)^M{0,3}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})$"
KEYWORD = r"(?i)^(?:chapter|book|part|volume|prologue|epilogue|introduction|preface|foreword|afterword|appendix)(?![0-9A-Za-z_])(?:\s+(?:\d+|[ivxlcdm]+|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty))?(?:\s*[.:\-–—]\s*\S.*)?$"
_START, _END, _ROMAN, _CHAPTER = (re.compile(p) for p in (START, END, ROMAN, KEYWORD))
_FIELD = re.compile(r"(?im)^(Title|Author): *(.+)$")


def is_heading(line: str) -> bool:
    """Whether a paragraph of one line is a chapter heading."""
    if len(line) > 60 or not line:
        return False
    bare = line.removesuffix(".")
    if bare and len(bare.encode()) <= 7 and bare.lower() != "i" and _ROMAN.match(bare):
        return True
    return line[-1] not in ".,;:" and _CHAPTER.match(line) is not None


def decode_text(data: bytes) -> dict:
    data = data.removeprefix(b"\xef\xbb\xbf")
    try:
        text, charset = data.decode("utf-8"), "UTF-8"
    except UnicodeDecodeError:
        text, charset = "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in data), "Windows-1252"
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    record = EMPTY | {"authors": [], "subjects": []}
    if start := _START.search(text):
        for m in _FIELD.finditer(text[: start.start()]):
            v = m[2].strip()
            if m[1].lower() == "title":
                record["title"] = record["title"] or v
            elif v and not record["authors"]:
                record["authors"] = [v]
        text = text[start.end() :]
        if end := _END.search(text):
            text = text[: end.start()]
    out = []
    for para in re.split(r"\n(?:[^\S\n]*\n)+", "\n".join(x.strip() for x in text.split("\n"))):
        lines = [x for x in para.split("\n") if x]
        if lines:
            line = " ".join(lines)
            out.append(f"<mbp:pagebreak/><h2>{html.escape(line)}</h2>\n" if len(lines) == 1 and is_heading(line) else f"<p>{html.escape(line)}</p>\n")
    if not out:
        raise ValueError("this text file is empty")
    return record | {"format": "Plain text", "encoding": charset, "html": "".join(out), "flows": [], "text_bytes": len(text.encode()), "resources": [], "cover": None, "paged": False}


def page_charset(data: bytes) -> str:
    """The charset of a page: its mark, its declaration, UTF-8 if valid, else Windows-1252."""
    if data.startswith(b"\xef\xbb\xbf"):
        return "utf-8"
    m = re.search(rb"<meta[^>]+charset\s*=\s*[\"']?\s*([A-Za-z0-9_\-:]+)", data[:1024], re.I)
    name = m[1].decode("ascii").lower() if m else ""
    if name in ("iso-8859-1", "latin1", "ascii", "us-ascii"):
        name = "cp1252"
    try:
        return name if name and "x".encode(name) else page_guess(data)
    except LookupError:
        return page_guess(data)


def page_guess(data: bytes) -> str:
    try:
        data.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError:
        return "cp1252"


def data_image(ref: str) -> bytes | None:
    head, comma, rest = ref.partition(",")
    if not comma or not re.match(r"data:image/[^;]*;base64\Z", head, re.I):
        return None
    try:
        return base64.b64decode(re.sub(r"\s+", "", rest), validate=True)
    except (binascii.Error, ValueError):
        return None


def local_file(ref: str, folder: str | None) -> str | None:
    """A file inside the page's folder, None for anything elsewhere."""
    ref = re.split("[#?]", ref, maxsplit=1)[0]
    if folder is None or not ref or ref.startswith("//") or re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", ref):
        return None
    root = os.path.realpath(folder)
    path = os.path.realpath(os.path.join(root, unquote(ref).lstrip("/")))
    return path if path.startswith(root + os.sep) and os.path.isfile(path) and os.path.getsize(path) <= SIDE_LIMIT else None


def decode_page(data: bytes, folder: str | None = None) -> dict:
    charset = page_charset(data)
    root = parse(expand_closed(data.decode(charset, "replace").removeprefix("﻿")))
    record = EMPTY | {"authors": [], "subjects": []}
    if t := root.find("title"):
        record["title"] = words(t.text())
    if h := root.find("html"):
        record["language"] = h.attrs.get("lang", "").strip()
    seen: dict[str, int] = {}
    res: list[tuple[int, str, bytes]] = []
    flows: list[str] = []
    for n in list(root.walk()):
        a = n.attrs
        if n.tag == "meta":
            name, v = a.get("name", "").strip().lower(), a.get("content", "").strip()
            if name in ("author", "dc.creator") and v:
                record["authors"].append(v)
            elif name == "description":
                record["description"] = record["description"] or v
            elif name == "keywords":
                record["subjects"] += [x for k in v.split(",") if (x := k.strip())]
        elif n.tag == "script":
            n.drop()
        elif n.tag in ("style", "link"):
            css = "".join(k for k in n.kids if isinstance(k, str))
            if n.tag == "link" and "stylesheet" in a.get("rel", "").lower().split() and (p := local_file(a.get("href", ""), folder)):
                with open(p, "rb") as f:
                    css = f.read().decode("utf-8", "replace")
            if css := re.sub(r"@import[^;{}]*;", "", css).strip():
                flows.append(css)
        elif n.tag == "img":
            k = image_number(a.get("src", ""), folder, seen, res)
            if k:
                a.pop("src", None)
                a["recindex"] = str(k)
            else:
                n.drop()
        elif n.tag == "svg" and (pic := n.find("image")):
            k = image_number(pic.attrs.get("href") or pic.attrs.get("xlink:href", ""), folder, seen, res)
            n.swap(Node("img", {"recindex": str(k)})) if k else n.drop()
    markup = root.markup()
    return record | {"format": "HTML", "encoding": "UTF-8" if charset == "utf-8" else charset, "html": markup, "flows": flows, "text_bytes": len(markup.encode()), "resources": res, "cover": None, "paged": False}


def image_number(ref: str, folder: str | None, seen: dict[str, int], res: list) -> int:
    """The number of an image by its first reference; repeated references share it, unusable ones have 0."""
    raw, key = None, ref
    if ref[:5].lower() == "data:":
        raw = data_image(ref) if ref not in seen else b""
    elif path := local_file(ref, folder):
        key = path
        if key not in seen:
            with open(path, "rb") as f:
                raw = f.read()
    if key not in seen:
        kind = images.sniff(raw or b"")
        if kind:
            res.append((len(res) + 1, kind, raw))
        seen[key] = len(res) if kind else 0
    return seen[key]
