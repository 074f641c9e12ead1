"""Stylesheets of books: the small subset of declarations that changes the layout of text.

Kept oddities: an at-rule ends at its first closing brace, so later rules inside it leak out; of ``tag.class`` the tag is ignored; ``a.b`` as a class is never
found; flags that one rule sets cannot be switched off by another.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

from quire.functions.layout import KEYWORDS, SCALE_LOW

FLAGS = ("bold", "italic", "mono", "block", "break_before", "break_after", "small")
VALUES = ("align", "scale", "margin_left", "pad_right", "indent")
_FLOAT = re.compile(r"[+-]?(?:\d+\.?\d*(?:e[+-]?\d+)?|\.\d+(?:e[+-]?\d+)?|inf(?:inity)?|nan)\Z", re.I)


def number(text: str) -> float | None:
    return float(text) if _FLOAT.match(text) else None


def size(value: str) -> float | None:
    """A font size as a multiple of the surrounding one."""
    if value in KEYWORDS:
        return KEYWORDS[value]
    for suffix, unit, absolute in (("%", 100.0, False), ("rem", 1.0, False), ("em", 1.0, False), ("pt", 12.0, True), ("px", 16.0, True)):
        if value.endswith(suffix):
            n = number(value[: -len(suffix)])
            if n is None or (absolute and not n > 0):
                return None
            return n / unit if n > 0 else SCALE_LOW
    return None


def length(value: str) -> float | None:
    """A length in em."""
    value = value.strip()
    for suffix, unit in (("rem", 1.0), ("em", 1.0), ("px", 16.0), ("pt", 12.0), ("%", 25.0)):
        if value.endswith(suffix):
            n = number(value[: -len(suffix)])
            return None if n is None else n / unit
    return 0.0 if value == "0" else None


def declarations(body: str) -> dict:
    """The properties that a rule's body sets."""
    p: dict = {}
    for part in body.split(";"):
        name, colon, value = part.partition(":")
        name, value = name.strip().lower(), value.strip().lower()
        if not colon or not value:
            continue
        if name == "text-align" and value in ("left", "right", "center"):
            p["align"] = value
        elif name == "font-size":
            n = size(value)
            if n is not None:
                p["scale"] = n
                p["small"] = n < 0.92
        elif name == "font-weight":
            if value in ("bold", "bolder") or (re.fullmatch(r"[+-]?\d+", value) and int(value) >= 600):
                p["bold"] = True
        elif name == "font-style" and value in ("italic", "oblique"):
            p["italic"] = True
        elif name == "font-family" and ("monospace" in value or "courier" in value):
            p["mono"] = True
        elif name == "display" and value == "block":
            p["block"] = True
        elif name in ("margin-left", "padding-left", "margin-right", "padding-right", "text-indent"):
            n = length(value)
            if n is not None:
                p["indent" if name == "text-indent" else "margin_left" if name.endswith("left") else "pad_right"] = n
        elif name == "page-break-before" and value in ("always", "left", "right"):
            p["break_before"] = True
        elif name == "page-break-after" and value == "always":
            p["break_after"] = True
    return p


def layered(base: dict, over: dict) -> dict:
    """``over`` on top of ``base``: set values win, flags only add up."""
    out = dict(base)
    for k in VALUES:
        v = over.get(k)
        if v not in (None, 0, 0.0) and not (isinstance(v, float) and math.isnan(v) and k != "scale"):
            out[k] = v
    for k in FLAGS:
        if over.get(k):
            out[k] = True
    return out


class Sheet:
    """Rules by tag and by class."""

    def __init__(self, sheets: tuple[str, ...] = ()) -> None:
        self.tags: dict[str, dict] = {}
        self.classes: dict[str, dict] = {}
        for s in sheets:
            self._read(re.sub(r"/\*.*?(?:\*/|\Z)", "", s or "", flags=re.S))

    def _read(self, css: str) -> None:
        for m in re.finditer(r"([^{]*)\{([^}]*)\}", css):
            head = m[1].strip()
            if head.startswith("@"):
                continue
            props = declarations(m[2])
            for sel in head.split(","):
                sel = sel.strip().lower()
                if not sel or re.search(r"[ >+~:\[*#]", sel):
                    continue
                tag, dot, cls = sel.partition(".")
                if not dot:
                    self.tags[tag] = layered(self.tags.get(tag, {}), props)
                elif cls:
                    self.classes[cls] = layered(self.classes.get(cls, {}), props)

    def lookup(self, tag: str, cls: str) -> dict:
        out = self.tags.get(tag, {})
        for c in cls.split():
            if (p := self.classes.get(c.lower())) is not None:
                out = layered(out, p)
        return out


@lru_cache(maxsize=512)
def sheet(sheets: tuple[str, ...]) -> Sheet:
    return Sheet(sheets)
