"""EPUB books: refusal of locked ones, package, images, reading order, contents, fixed pages, assembly into one markup."""

from __future__ import annotations

import re
from urllib.parse import unquote

from quire.sources import images
from quire.sources.archive import Archive, resolve
from quire.sources.tree import Node, expand_closed, parse as parse_page, words
from quire.sources.xmltree import child, children, parse as parse_xml
from quire.operators.flatten import tokens

# Lock files with their schemes, harmless algorithms, image types, elements that may become headings, pixel factor and default page.
LOCKS = {"META-INF/rights.xml": "Adobe ADEPT", "META-INF/sinf.xml": "Apple FairPlay", "META-INF/license.lcpl": "Readium LCP"}
FONT_ONLY = {"http://www.idpf.org/2008/embedding", "http://ns.adobe.com/pdf/enc#RC"}
IMAGE_TYPES = {"image/jpeg", "image/jpg", "image/png", "image/gif", "image/webp", "image/bmp"}
CONTAINERS = frozenset("div section article header blockquote li figure".split())
HEADABLE = CONTAINERS | frozenset("h1 h2 h3 h4 h5 h6 p".split())
PX, DEFAULT_PAGE = 0.75, (600.0, 800.0)


class Locked(ValueError):
    """The book is protected."""


def has(props: str | None, name: str) -> bool:
    return name in (props or "").split()


def refuse_locked(zip_: Archive) -> None:
    for name, scheme in LOCKS.items():
        if zip_.find(name):
            raise Locked(f"this EPUB is locked with {scheme} protection")
    if zip_.find("META-INF/encryption.xml"):
        try:
            root, _ = parse_xml(zip_.read("META-INF/encryption.xml"))
        except ValueError:
            raise Locked("this EPUB is locked with an unrecognised protection") from None
        for d in root.walk():
            if d.tag == "EncryptedData":
                m = child(d, "EncryptionMethod")
                if (m.attrs.get("Algorithm", "") if m else "") not in FONT_ONLY:
                    raise Locked("this EPUB is locked with an unrecognised protection")


def number(v: str) -> float:
    m = re.fullmatch(r"\s*(\+?\d+\.?\d*|\.\d+)\s*(?:px)?\s*", (v or "").lower())
    return n if m and 0 < (n := float(m[1])) <= 1e6 else 0.0


def viewport(text: str) -> tuple[float, float]:
    got = {k.strip().lower(): number(v) for k, eq, v in (p.partition("=") for p in re.split("[,;]", text or "")) if eq}
    return got.get("width", 0.0), got.get("height", 0.0)


def ok(size: tuple[float, float]) -> bool:
    return size[0] > 0 and size[1] > 0


def points(v: float) -> str:
    return repr(v).removesuffix(".0")


def body_of(page: Node) -> Node:
    return page.find("body") or page


def seen_text(n: Node) -> bool:
    return any(bool(k.strip()) if isinstance(k, str) else k.tag not in ("script", "style") and seen_text(k) for k in n.kids)


class Reader:
    def __init__(self, data: bytes) -> None:
        self.zip = Archive(data)
        refuse_locked(self.zip)
        self._package()
        self._images()

    # -- package
    def _package(self) -> None:
        try:
            root, _ = parse_xml(self.zip.read("META-INF/container.xml"))
        except KeyError:
            raise ValueError("this EPUB has no container file") from None
        files = [n.attrs for n in root.walk() if n.tag == "rootfile" and n.attrs.get("full-path")]
        files.sort(key=lambda a: a.get("media-type") != "application/oebps-package+xml")
        if not files:
            raise ValueError("this EPUB names no package file")
        self.opf = files[0]["full-path"]
        try:
            self.package, _ = parse_xml(self.zip.read(self.opf))
        except KeyError:
            raise ValueError("the package file is missing") from None
        self.manifest = [n.attrs | {"path": resolve(self.opf, n.attrs.get("href", ""))} for n in children(child(self.package, "manifest"), "item")]
        self.items: dict[str, dict] = {}
        for it in self.manifest:
            self.items.setdefault(it.get("id", ""), it)
        self.metas = children(child(self.package, "metadata"), "meta")
        self.guide = [n.attrs for n in children(child(self.package, "guide"), "reference")]
        self.paged = self._book_is_paged()

    def _book_is_paged(self) -> bool:
        for m in self.metas:
            if m.attrs.get("property") == "rendition:layout":
                return m.text().strip() == "pre-paginated"
        try:
            root, _ = parse_xml(self.zip.read("META-INF/com.apple.ibooks.display-options.xml"))
        except (KeyError, ValueError):
            return False
        return any(n.tag == "option" and n.attrs.get("name") == "fixed-layout" and n.text().strip() == "true" for n in root.walk())

    def record(self) -> dict:
        m = child(self.package, "metadata")
        every = lambda tag: [t for n in children(m, tag) if (t := n.text().strip())]
        first = lambda tag: next(iter(every(tag)), "")
        isbn = ""
        for n in children(m, "identifier"):
            v = n.text().strip()
            if v[:9].lower() == "urn:isbn:":
                isbn = v[9:].strip()
            elif n.attrs.get("scheme", "").strip().lower() == "isbn" and v:
                isbn = v
            if isbn:
                break
        about = first("description")
        if "<" in about:
            about = " ".join(w for t in tokens(about) if t[0] == "text" for w in t[1].split())
        return {
            "title": first("title"), "authors": every("creator"), "publisher": first("publisher"), "description": words(about), "isbn": isbn, "published": first("date"), "rights": first("rights"), "language": first("language"), "subjects": every("subject"), "asin": "", "compression": "", "encoding": "UTF-8",
            "format": ("EPUB 3" if self.package.attrs.get("version", "").strip().startswith("3") else "EPUB 2") + (" (fixed layout)" if self.paged else ""),
        }

    # -- images
    def _images(self) -> None:
        self.numbers: dict[str, int] = {}
        self.resources: list[tuple[int, str, bytes]] = []
        for it in self.manifest:
            p = self.zip.find(it["path"])
            if it.get("media-type", "").strip().lower() not in IMAGE_TYPES or p is None or it["path"] in self.numbers:
                continue
            data = self.zip.read(p)
            if kind := images.sniff(data):
                self.resources.append((len(self.resources) + 1, kind, data))
                self.numbers[it["path"]] = len(self.resources)

    def number_of(self, base: str, ref: str) -> int:
        return self.numbers.get(resolve(base, ref), 0) if ref else 0

    @staticmethod
    def image_ref(n: Node) -> str:
        return n.attrs.get("src", "") if n.tag == "img" else (n.attrs.get("href") or n.attrs.get("xlink:href", "")) if n.tag == "image" else ""

    def cover(self) -> int | None:
        for it in self.manifest:
            if has(it.get("properties"), "cover-image") and it["path"] in self.numbers:
                return self.numbers[it["path"]]
        for m in self.metas:
            if m.attrs.get("name", "").lower() == "cover":
                it = self.items.get(m.attrs.get("content", "").strip())
                if it and it["path"] in self.numbers:
                    return self.numbers[it["path"]]
        for r in self.guide:
            if r.get("type", "").lower() == "cover":
                target = resolve(self.opf, r.get("href", ""))
                if target in self.numbers:
                    return self.numbers[target]
                page = self.page(target)
                k = next((k for n in page.walk() if (k := self.number_of(target, self.image_ref(n)))), 0) if page else 0
                if k:
                    return k
        return None

    # -- reading order
    def page(self, path: str) -> Node | None:
        p = self.zip.find(path)
        if p is None:
            return None
        return parse_page(expand_closed(self.zip.read(p).removeprefix(b"\xef\xbb\xbf").decode("utf-8", "replace")))

    def spine(self) -> list[dict]:
        refs = [n.attrs for n in children(child(self.package, "spine"), "itemref")]
        refs.sort(key=lambda a: a.get("linear", "").strip().lower() == "no")  # stable: linear ones first
        out = []
        for r in refs:
            it = self.items.get(r.get("idref", ""))
            if not it or it.get("media-type", "").strip().lower() not in ("application/xhtml+xml", "text/html"):
                continue
            page = self.page(it["path"])
            if page is None:
                continue
            p = r.get("properties")
            fixed = True if has(p, "rendition:layout-pre-paginated") else False if has(p, "rendition:layout-reflowable") else self.paged
            out.append({"path": it["path"], "page": page, "fixed": fixed})
        return out

    # -- contents
    def navigation(self) -> tuple[Node, str] | None:
        for it in self.manifest:
            if has(it.get("properties"), "nav") and (page := self.page(it["path"])):
                return page, it["path"]
        return None

    def contents(self) -> dict[str, list[tuple[str, int]]]:
        """Targets by document: (fragment, depth)."""
        out: dict[str, list[tuple[str, int]]] = {}

        def add(base: str, href: str, depth: int) -> None:
            out.setdefault(resolve(base, href), []).append((unquote(href.partition("#")[2]), max(depth, 1)))

        def lists(n: Node, base: str, depth: int) -> None:
            for k in n.kids:
                if isinstance(k, Node):
                    if k.tag == "a" and k.attrs.get("href"):
                        add(base, k.attrs["href"], depth)
                    lists(k, base, depth + (k.tag == "ol"))

        if nav := self.navigation():
            page, path = nav
            if box := next((n for n in page.walk() if n.tag == "nav" and has(n.attrs.get("epub:type"), "toc")), None):
                lists(box, path, 0)
        if out:
            return out
        spine = child(self.package, "spine")
        it = self.items.get(spine.attrs.get("toc", "") if spine else "") or next((i for i in self.manifest if i.get("media-type") == "application/x-dtbncx+xml"), None)
        try:
            root, _ = parse_xml(self.zip.read(it["path"])) if it else (None, "")
        except (KeyError, ValueError):
            return out

        def marks(n: Node | None, depth: int) -> None:
            for p in children(n, "navPoint"):
                c = child(p, "content")
                if c and c.attrs.get("src"):
                    add(it["path"], c.attrs["src"], depth)
                marks(p, depth + 1)

        marks(child(root, "navMap"), 1)
        return out

    def cover_pages(self) -> set[str]:
        found = {resolve(self.opf, r.get("href", "")) for r in self.guide if r.get("type", "").lower() == "cover"}
        if nav := self.navigation():
            page, path = nav
            box = next((n for n in page.walk() if n.tag == "nav" and has(n.attrs.get("epub:type"), "landmarks")), None)
            found |= {resolve(path, n.attrs.get("href", "")) for n in (box.walk() if box else ()) if n.tag == "a" and has(n.attrs.get("epub:type"), "cover")}
        return found

    @staticmethod
    def first_block(n: Node) -> Node | None:
        """The innermost block that may be a heading around the first text in ``n``."""

        def search(x: Node) -> Node | None:
            for k in x.kids:
                if isinstance(k, str):
                    if k.strip():
                        return x
                elif k.tag not in ("script", "style") and (hit := search(k)):
                    return hit
            return None

        at = search(n)
        while at is not None and at is not n:
            if at.tag in HEADABLE:
                return at
            at = at.parent
        return None

    def mark_headings(self, page: Node, targets: list[tuple[str, int]]) -> None:
        ids: dict[str, Node] = {}
        for n in page.walk():
            if n.attrs.get("id"):
                ids.setdefault(n.attrs["id"], n)
        body, depth = body_of(page), {}
        for fragment, d in targets:
            n = ids.get(fragment) if fragment else None
            while n is not None and n is not body and n.tag not in HEADABLE:
                n = n.parent
            if n is None or n is body:
                n = self.first_block(body)
            elif n.tag in CONTAINERS:
                n = self.first_block(n) or n
            if n is not None:
                d = min(max(d, 1), 6)
                depth[n] = min(depth.get(n, d), d)
        for n, d in depth.items():
            n.attrs["data-ebook-heading"] = str(d)

    # -- pages
    def rewrite(self, doc: dict) -> None:
        """Images get their numbers; pictures in vector frames are unwrapped; scripts and images that lead nowhere go."""
        for n in list(doc["page"].walk()):
            if n.tag == "script":
                n.drop()
            elif n.tag == "svg" and (pic := n.find("image")):
                k = self.number_of(doc["path"], self.image_ref(pic))
                n.swap(Node("img", {"recindex": str(k)})) if k else n.drop()
            elif n.tag == "img" and "recindex" not in n.attrs:
                k = self.number_of(doc["path"], n.attrs.pop("src", ""))
                if k:
                    n.attrs["recindex"] = str(k)
                else:
                    n.drop()

    def only_cover(self, page: Node, cover: int) -> bool:
        b = body_of(page)
        return not seen_text(b) and [n.attrs.get("recindex") for n in b.walk() if n.tag == "img"] == [str(cover)]

    def own_size(self, doc: dict) -> tuple[float, float]:
        for n in doc["page"].walk():
            if n.tag == "meta" and n.attrs.get("name", "").lower() == "viewport" and ok(s := viewport(n.attrs.get("content", ""))):
                return s
        body = body_of(doc["page"])
        only = [k for k in body.kids if not isinstance(k, str) or k.strip()]
        if len(only) == 1 and isinstance(only[0], Node) and only[0].tag == "svg":
            a = only[0].attrs
            box = re.split(r"[,\s]+", a.get("viewbox", "").strip())
            for s in ((number(a.get("width", "")), number(a.get("height", ""))), (number(box[2]), number(box[3])) if len(box) == 4 else (0.0, 0.0)):
                if ok(s):
                    return s
        for m in self.metas:
            if m.attrs.get("property") == "rendition:viewport" and ok(s := viewport(m.text())):
                return s
        refs = self.shown(doc)
        if len(refs) == 1 and refs[0]:
            return tuple(map(float, images.pixels(self.resources[refs[0] - 1][2]) or (0, 0)))
        return 0.0, 0.0

    def shown(self, doc: dict) -> list[int]:
        return [self.number_of(doc["path"], r) for n in body_of(doc["page"]).walk() if (r := self.image_ref(n))]

    def sizes(self, docs: list[dict]) -> list[tuple[float, float]]:
        """Own size, else the last known one, else the first later one, else the default; in points."""
        own = [self.own_size(d) if d["fixed"] else (0.0, 0.0) for d in docs]
        last, out = (0.0, 0.0), []
        for i, d in enumerate(docs):
            s = next((x for x in (own[i], last, *own[i + 1 :]) if ok(x)), DEFAULT_PAGE) if d["fixed"] else (0.0, 0.0)
            last = s if d["fixed"] else last
            out.append((s[0] * PX, s[1] * PX))
        return out

    def styles(self, docs: list[dict]) -> list[str]:
        out, seen = [], set()
        for d in docs:
            for n in d["page"].walk():
                css = ""
                if n.tag == "link" and has(n.attrs.get("rel", "").lower(), "stylesheet"):
                    target = resolve(d["path"], n.attrs.get("href", ""))
                    if target in seen or self.zip.find(target) is None:
                        continue
                    seen.add(target)
                    try:
                        css = self.zip.read(target).decode("utf-8", "replace")
                    except ValueError:
                        continue
                elif n.tag == "style":
                    css = "".join(k for k in n.kids if isinstance(k, str))
                if css := re.sub(r"@import[^;{}]*;", "", css).strip():
                    out.append(css)
        return out

    def assemble(self) -> dict:
        docs = self.spine()
        if not docs:
            raise ValueError("this EPUB contains no chapters")
        cover, toc, covers, sizes = self.cover(), self.contents(), self.cover_pages(), None
        flows, sizes, parts = self.styles(docs), self.sizes(docs), []
        for i, d in enumerate(docs):
            if d["fixed"]:
                mark = f'<ebook:page width="{points(sizes[i][0])}" height="{points(sizes[i][1])}"></ebook:page>'
                refs = self.shown(d)
                if len(refs) == 1 and refs[0] and not seen_text(body_of(d["page"])):
                    inner = f'<img recindex="{refs[0]}" data-ebook-fullpage="1">'
                else:
                    self.rewrite(d)
                    inner = body_of(d["page"]).markup() if body_of(d["page"]).tag == "#document" else re.sub(r"\A<body[^>]*>|</body>\Z", "", body_of(d["page"]).markup())
                parts.append(f"<html><body>{mark}{inner}</body></html>")
                continue
            self.rewrite(d)
            if cover and not self.paged and (i == 0 or d["path"] in covers) and self.only_cover(d["page"], cover):
                continue
            self.mark_headings(d["page"], toc.get(d["path"], []))
            m = d["page"].markup()
            parts.append(m if d["page"].find("html") else f"<html><head></head><body>{m}</body></html>")
        markup = "".join(parts)
        return self.record() | {"html": markup, "flows": flows, "text_bytes": len(markup.encode()), "resources": self.resources, "cover": cover, "paged": self.paged}


def decode(data: bytes) -> dict:
    return Reader(data).assemble()
