"""Markup to an ordered table of blocks: a fold over tokens that no window can express, run as an Arrow kernel.

Each open element leaves a frame saying what to undo; a closing tag unwinds to the nearest element of its name, a stray one is ignored. Blocks hold spans of text with style bits and
outside links. Defined results: null and empty markup give no blocks; damaged markup is read as far as it goes; blocks carry ``pos`` from 1.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import styles
from quire.runtime import arrow_map

# Style bits, element sets and kinds.
BOLD, ITALIC, UNDERLINE, MONO, SMALL, SUPER, SUB = (1 << i for i in range(7))
INLINE = {"b": BOLD, "strong": BOLD, "i": ITALIC, "em": ITALIC, "cite": ITALIC, "var": ITALIC, "dfn": ITALIC, "u": UNDERLINE, "ins": UNDERLINE, "code": MONO, "tt": MONO, "kbd": MONO, "samp": MONO, "pre": MONO, "small": SMALL, "sup": SUPER, "sub": SUB}
DROPPED = frozenset("head style script title svg link meta guide".split())
VOID = frozenset("br hr img image meta link input area base col embed param source track wbr ebook:page".split())
PARAGRAPHS = frozenset("p div section article center tr td th table ul ol dl pre figure figcaption aside header footer".split())
BREAK = "\n"
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+)))?")
_CLASS = re.compile(r"(?:^|\s)h([1-6])(?![0-9A-Za-z_])|(?:^|\s)h([1-6])[-_]", re.I)
_BLANKS = re.compile("[ \t\n\r\f\v]+")
RAW = frozenset(("script", "style", "title", "textarea"))


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(text):
        v = next((g for g in m.groups()[1:] if g is not None), "")
        out[m[1].lower()] = html.unescape(v) if "&" in v else v
    return out


def tokens(markup: str):
    """('text', text), ('open', name, attributes, closed) and ('close', name) in order; raw elements hold no tags."""
    pos, n = 0, len(markup)
    while pos < n:
        m = _TOKEN.search(markup, pos)
        end = m.start() if m else n
        if end > pos:
            t = markup[pos:end]
            yield ("text", html.unescape(t) if "&" in t else t)
        if not m:
            return
        pos = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            yield ("close", name)
            continue
        closed = m[3].rstrip().endswith("/")
        yield ("open", name, attributes(m[3].rstrip().removesuffix("/")) if m[3].strip() else {}, closed)
        if name in RAW and not closed:
            e = re.compile(rf"</{name}\s*>", re.I).search(markup, pos)
            stop = e.start() if e else n
            if stop > pos:
                yield ("text", markup[pos:stop])
            pos = stop


def collapse(text: str) -> str:
    """Blank runs become one space; after that, fixed spaces become plain ones."""
    return _BLANKS.sub(" ", text).replace(" ", " ")


def resource_of(a: dict[str, str]) -> int:
    v = a.get("recindex", "").strip()
    if re.fullmatch(r"[+-]?\d+", v):
        return int(v)
    _, mark, rest = a.get("src", "").partition("kindle:embed:")
    if mark:
        rest = re.split(r"[?&#]", rest)[0].strip()
        if re.fullmatch(r"[0-9A-Va-v]+", rest):
            return int(rest, 32)
    return 0


def kind_of(name: str, a: dict[str, str]) -> tuple[str, int] | None:
    if len(name) == 2 and name[0] == "h" and name[1] in "123456":
        return "heading", int(name[1])
    if name in ("li", "dt", "dd"):
        return "list", 1
    if name == "blockquote":
        return "quote", 0
    if name in PARAGRAPHS:
        m = _CLASS.search(a.get("class", ""))
        return ("heading", int(m[1] or m[2])) if m else ("paragraph", 0)
    return None


def align_of(a: dict[str, str]) -> str:
    v = f"{a.get('align', '')} {a.get('style', '').replace(' ', '')} {a.get('class', '')}".lower()
    return "center" if "center" in v else "right" if "text-align:right" in v else ""


def bits_of(name: str, a: dict[str, str], props: dict) -> int:
    s = INLINE.get(name, 0)
    if css := a.get("style"):
        css = css.replace(" ", "").lower()
        s |= (BOLD if "font-weight:bold" in css else 0) | (ITALIC if "font-style:italic" in css else 0)
    return s | (BOLD if props.get("bold") else 0) | (ITALIC if props.get("italic") else 0) | (MONO if props.get("mono") else 0)


def new_block(kind: str, **more) -> dict:
    return {"kind": kind, "level": 0, "align": "", "spans": [], "resource": 0, "alt": "", "scale": 0.0, "margin_left": 0.0, "indent": 0.0, "full_page": False, "page_width": 0.0, "page_height": 0.0} | more


class Flow:
    """The fold: blocks so far, the block being filled, open frames, current style and link."""

    def __init__(self, css: styles.Sheet) -> None:
        self.css, self.blocks, self.now, self.frames = css, [], None, []
        self.hidden = self.bits = 0
        self.link, self.gap, self.documents = "", False, 0

    # -- filling a block
    def add(self, text: str, bits: int = 0, link: str = "") -> None:
        if self.now is None:
            self.now = new_block("paragraph")
        spans = self.now["spans"]
        if text != BREAK:
            tail = spans[-1][0] if spans else ""
            if self.gap:
                self.gap = False
                if spans and not text.startswith(" ") and not tail.endswith(" "):
                    text = " " + text
            if not spans or tail.endswith(" "):
                text = text.lstrip(" ")
                if not text:
                    return
            if spans and spans[-1][1:] == [bits, link] and tail != BREAK:
                spans[-1][0] += text
                return
        spans.append([text, bits, link])

    def flush(self) -> None:
        b, self.now, self.gap = self.now, None, False if self.now is not None else self.gap
        if b is None:
            return
        while b["spans"] and not b["spans"][-1][0].strip():
            b["spans"].pop()
        if b["spans"]:
            b["spans"][-1][0] = b["spans"][-1][0].rstrip(" ")
            if any(t.strip() for t, _, _ in b["spans"]):
                self.blocks.append(b)

    def page_break(self, w: float = 0.0, h: float = 0.0) -> None:
        self.flush()
        if self.blocks and self.blocks[-1]["kind"] == "page_break":
            if w:
                self.blocks[-1].update(page_width=w, page_height=h)
            return
        self.blocks.append(new_block("page_break", page_width=w, page_height=h))

    # -- tokens
    def text(self, t: str) -> None:
        if self.hidden:
            return
        t = collapse(t)
        if t and (self.now is not None or t.strip()):
            self.add(t, self.bits, self.link)

    def open(self, name: str, a: dict[str, str]) -> None:
        space, colon, local = name.partition(":")
        if colon:
            if name == "mbp:pagebreak":
                return self.page_break()
            if name == "ebook:page":
                w, h = (styles.number(a.get(k, "").strip()) or 0.0 for k in ("width", "height"))
                if not self.hidden and all(math.isfinite(x) and x > 0 for x in (w, h)):
                    self.page_break(w, h)
                return None
            name = local
        if self.hidden or name in DROPPED:
            if name not in VOID:
                self.frames.append((name, "hidden"))
                self.hidden += 1
            return None
        if name == "html":
            if self.documents:
                self.page_break()
            self.documents += 1
            return None
        if name == "br":
            return self.add(BREAK)
        if name == "hr":
            self.flush()
            self.blocks.append(new_block("rule"))
            return None
        if name in ("img", "image"):
            if (k := resource_of(a)) > 0:
                self.flush()
                self.blocks.append(new_block("image", resource=k, alt=a.get("alt", ""), align="center", full_page="data-ebook-fullpage" in a))
            return None
        props = self.css.lookup(name, a.get("class", ""))
        if props.get("break_before"):
            self.page_break()
        kind = kind_of(name, a) or (("paragraph", 0) if props.get("block") else None)
        if re.fullmatch(r"[+-]?\d+", mark := a.get("data-ebook-heading", "").strip()):
            kind = ("heading", min(max(int(mark), 1), 6))
        if kind:
            self.flush()
            level = max(1, sum(f[0] in ("ul", "ol") for f in self.frames)) if kind[0] == "list" else kind[1]
            self.now = new_block(kind[0], level=level, align=align_of(a) or props.get("align", ""), scale=props.get("scale", 0.0), margin_left=props.get("margin_left", 0.0), indent=props.get("indent", 0.0))
        elif props.get("margin_left", 0.0) > 0:
            self.gap = True
        adds = bits_of(name, a, props) & ~self.bits
        self.bits |= adds
        href = a.get("href", "") if name == "a" else ""
        linked = bool(href) and not href.startswith(("#", "kindle:"))
        if linked:
            self.link = href
        if name not in VOID:
            self.frames.append((name, "open", adds, linked, bool(kind), bool(props.get("break_after")), not kind and props.get("pad_right", 0.0) > 0))
        return None

    def close(self, name: str) -> None:
        name = name.partition(":")[2] or name
        if not any(f[0] == name for f in self.frames):
            return
        while True:
            f = self.frames.pop()
            if f[1] == "hidden":
                self.hidden = max(0, self.hidden - 1)
            else:
                _, _, adds, linked, block, after, gap = f
                self.bits &= ~adds
                if linked:
                    self.link = ""
                if block:
                    self.flush()
                self.gap = self.gap or gap
                if after:
                    self.page_break()
            if f[0] == name:
                return


def flatten(markup: str | None, sheets: tuple[str, ...] = ()) -> list[dict]:
    """The blocks of one markup string."""
    flow = Flow(styles.sheet(tuple(s for s in sheets if s)))
    for t in tokens(markup or ""):
        if t[0] == "text":
            flow.text(t[1])
        elif t[0] == "open":
            flow.open(t[1], t[2])
            if t[3]:
                flow.close(t[1])
        else:
            flow.close(t[1])
    flow.flush()
    return flow.blocks


def block_text(b: dict) -> str:
    return "".join(" " if t == BREAK else t for t, _, _ in b["spans"])


SPAN = "array<struct<text:string,style:int,link:string>>"
SCHEMA = f"book_id bigint, pos int, kind string, level int, align string, text string, spans {SPAN}, resource int, alt string, scale double, margin_left double, indent double, full_page boolean, page_width double, page_height double"
_COLS = ("kind", "level", "align", "resource", "alt", "scale", "margin_left", "indent", "full_page", "page_width", "page_height")
_TYPES = {"kind": pa.string(), "level": pa.int32(), "align": pa.string(), "resource": pa.int32(), "alt": pa.string(), "full_page": pa.bool_()}


def blocks(books: DataFrame) -> DataFrame:
    """The blocks table of ``books`` (book_id, html, flows); narrow, so it keeps the partitions of its input."""

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, pos, texts, spans, rest = [], [], [], [], {c: [] for c in _COLS}
        for book, markup, flows in zip(*(c.to_pylist() for c in b.columns)):
            for k, x in enumerate(flatten(markup, tuple(flows or ())), 1):
                ids.append(book)
                pos.append(k)
                texts.append(block_text(x))
                spans.append([{"text": t, "style": s, "link": ln} for t, s, ln in x["spans"]])
                for c in _COLS:
                    rest[c].append(x[c])
        st = pa.list_(pa.struct([("text", pa.string()), ("style", pa.int32()), ("link", pa.string())]))
        data = {"book_id": pa.array(ids, pa.int64()), "pos": pa.array(pos, pa.int32()), "text": pa.array(texts, pa.string()), "spans": pa.array(spans, st)} | {c: pa.array(rest[c], _TYPES.get(c, pa.float64())) for c in _COLS}
        names = [x.split()[0] for x in re.sub(r"<[^ ]*>", "", SCHEMA).split(", ")]
        return pa.RecordBatch.from_arrays([data[n] for n in names], names=names)

    return arrow_map(books.select("book_id", "html", "flows").where(F.col("html").isNotNull()), kernel, SCHEMA)
