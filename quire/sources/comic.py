"""Comic archives: image entries in natural order become pages."""

from __future__ import annotations

import re

from quire.sources import images
from quire.sources.archive import Archive
from quire.sources.xmltree import child, parse


def natural(name: str) -> tuple:
    """A key in which digit runs compare by value; ties by the raw name."""
    parts = re.findall(r"[0-9]+|[^0-9]", name.lower())
    return [(0, len(p.lstrip("0")), p.lstrip("0")) if p[0].isdigit() else (ord(p) < 48 and -1 or 1, 0, p) for p in parts], name


def is_page(name: str) -> bool:
    parts = name.split("/")
    return parts[0] != "__MACOSX" and not any(p.startswith(".") for p in parts) and bool(re.search(r"\.(jpe?g|png|gif|bmp|webp)\Z", name, re.I))


def describe(a: Archive) -> dict:
    r = {k: "" for k in ("title", "publisher", "description", "isbn", "published", "rights", "language", "asin", "compression")} | {"authors": [], "subjects": []}
    info = next((n for n in a.names() if n.lower() == "comicinfo.xml"), None)
    if info is None:
        return r
    try:
        root, _ = parse(a.read(info))
    except ValueError:
        return r
    get = lambda tag: (n.text().strip() if (n := child(root, tag)) else "")
    many = lambda tag: [v for x in get(tag).split(",") if (v := x.strip())]
    r["title"] = get("Title") or (get("Series") + (f" #{get('Number')}" if get("Number") else "") if get("Series") else "")
    month = get("Month")
    r["published"] = get("Year") and get("Year") + (f"-{month.zfill(2) if len(month) == 1 else month}" if month else "")
    return r | {"authors": many("Writer"), "subjects": many("Genre"), "description": get("Summary"), "publisher": get("Publisher"), "language": get("LanguageISO")}


def decode(data: bytes) -> dict:
    a = Archive(data)
    res: list[tuple[int, str, bytes]] = []
    for name in sorted((n for n in a.names() if is_page(n)), key=natural):
        raw = a.read(name)
        if kind := images.sniff(raw):
            res.append((len(res) + 1, kind, raw))
    if not res:
        raise ValueError("this comic archive contains no images")
    markup = "".join(f'<html><body><img recindex="{k}" data-ebook-fullpage="1"></body></html>' for k, _, _ in res)
    return describe(a) | {"format": "Comic archive (CBZ)", "encoding": "UTF-8", "html": markup, "flows": [], "text_bytes": 0, "resources": res, "cover": 1, "paged": True}
