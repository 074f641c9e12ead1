"""Font metrics and subsets: TrueType tables read once in each worker; where no font file is found, the standard fonts with widths from a rule."""

from __future__ import annotations

import os
import struct
from functools import lru_cache

# Where font files lie; for each choice the families in order of preference with their files (regular, bold, italic, bold italic).
FOLDERS = (
    "/usr/share/fonts/truetype/dejavu", "/usr/share/fonts/truetype/liberation", "/usr/share/fonts/truetype/liberation2", "/usr/share/fonts/TTF", "/usr/share/fonts/truetype", "/usr/local/share/fonts",
    "/System/Library/Fonts/Supplemental", "/Library/Fonts", os.path.expanduser("~/Library/Fonts"), os.path.join(os.environ.get("WINDIR", "C:\\Windows"), "Fonts"),
)
FAMILIES = {
    "serif": (
        ("Georgia", ("georgia.ttf", "georgiab.ttf", "georgiai.ttf", "georgiaz.ttf")),
        ("Times New Roman", ("times.ttf", "timesbd.ttf", "timesi.ttf", "timesbi.ttf")),
        ("Times New Roman", ("Times New Roman.ttf", "Times New Roman Bold.ttf", "Times New Roman Italic.ttf", "Times New Roman Bold Italic.ttf")),
        ("DejaVu Serif", ("DejaVuSerif.ttf", "DejaVuSerif-Bold.ttf", "DejaVuSerif-Italic.ttf", "DejaVuSerif-BoldItalic.ttf")),
        ("Liberation Serif", ("LiberationSerif-Regular.ttf", "LiberationSerif-Bold.ttf", "LiberationSerif-Italic.ttf", "LiberationSerif-BoldItalic.ttf")),
    ),
    "sans": (
        ("Segoe UI", ("segoeui.ttf", "segoeuib.ttf", "segoeuii.ttf", "segoeuiz.ttf")),
        ("Arial", ("arial.ttf", "arialbd.ttf", "ariali.ttf", "arialbi.ttf")),
        ("Helvetica", ("Helvetica.ttf", "Helvetica-Bold.ttf", "Helvetica-Oblique.ttf", "Helvetica-BoldOblique.ttf")),
        ("DejaVu Sans", ("DejaVuSans.ttf", "DejaVuSans-Bold.ttf", "DejaVuSans-Oblique.ttf", "DejaVuSans-BoldOblique.ttf")),
        ("Liberation Sans", ("LiberationSans-Regular.ttf", "LiberationSans-Bold.ttf", "LiberationSans-Italic.ttf", "LiberationSans-BoldItalic.ttf")),
    ),
    "mono": (
        ("Consolas", ("consola.ttf", "consolab.ttf", "consolai.ttf", "consolaz.ttf")),
        ("DejaVu Sans Mono", ("DejaVuSansMono.ttf", "DejaVuSansMono-Bold.ttf", "DejaVuSansMono-Oblique.ttf", "DejaVuSansMono-BoldOblique.ttf")),
        ("Courier New", ("cour.ttf", "courbd.ttf", "couri.ttf", "courbi.ttf")),
    ),
}
# Endings of a font file's siblings (bold, italic, bold italic), and the standard fonts for where no file is found.
SIBLINGS = (("-Bold", "bd", "b", "-bold"), ("-Italic", "i", "-italic", "-Oblique"), ("-BoldItalic", "z", "bi", "-bolditalic"))
STANDARD = {"serif": ("Times-Roman", "Times-Bold", "Times-Italic", "Times-BoldItalic"), "sans": ("Helvetica", "Helvetica-Bold", "Helvetica-Oblique", "Helvetica-BoldOblique"), "mono": ("Courier", "Courier-Bold", "Courier-Oblique", "Courier-BoldOblique")}


def usable(path: str) -> bool:
    """Whether a file holds TrueType outlines; collections and other outlines are not read."""
    try:
        with open(path, "rb") as f:
            return f.read(4) in (b"\0\1\0\0", b"true")
    except OSError:
        return False


@lru_cache(maxsize=64)
def resolved(choice: str) -> tuple[str, str, tuple[str, ...]]:
    """(kind, name, files of the four faces) of a font choice: ``serif``, ``sans``, ``mono`` or a font file; anything else is ``serif``. A face without a file takes that of a plainer one; no files: a standard font."""
    kind = choice.strip().lower() or "serif"
    if kind not in FAMILIES and usable(choice):
        stem = os.path.splitext(choice)[0]
        options = [(os.path.basename(choice), [choice, *(next((p for e in ends if usable(p := f"{stem}{e}.ttf")), "") for ends in SIBLINGS)])]
        kind = "serif"
    else:
        kind = kind if kind in FAMILIES else "serif"
        options = [(name, [os.path.join(d, f) for f in files]) for name, files in FAMILIES[kind] for d in FOLDERS]
    for name, paths in options:
        if usable(paths[0]):
            regular, bold, italic, both = (p if p and usable(p) else "" for p in paths)
            return kind, name, (regular, bold or regular, italic or regular, both or bold or regular)
    return kind, STANDARD[kind][0], ()


class Font:
    """Advances by character, in thousandths of the size; ``data`` is None for a standard font."""

    def __init__(self, family: str, face: int) -> None:
        kind, self.title, files = resolved(family)
        self.family, self.face = family, face
        self.name = STANDARD[kind][face]
        self.data: bytes | None = None
        self.memo: dict[str, float] = {}
        if files:
            with open(files[face], "rb") as f:
                self._read(f.read())

    def _read(self, data: bytes) -> None:
        self.tables = {data[12 + 16 * i : 16 + 16 * i]: struct.unpack_from(">II", data, 20 + 16 * i) for i in range(struct.unpack_from(">H", data, 4)[0])}
        get = lambda t: data[self.tables[t][0] : sum(self.tables[t])]
        head, hhea, hmtx, cmap = get(b"head"), get(b"hhea"), get(b"hmtx"), get(b"cmap")
        self.units = struct.unpack_from(">H", head, 18)[0]
        self.box = struct.unpack_from(">4h", head, 36)
        self.long = struct.unpack_from(">h", head, 50)[0]
        self.ascent, self.descent = struct.unpack_from(">hh", hhea, 4)
        n = struct.unpack_from(">H", hhea, 34)[0]
        self.glyphs = struct.unpack_from(">H", get(b"maxp"), 4)[0]
        adv = [struct.unpack_from(">H", hmtx, 4 * i)[0] for i in range(n)]
        self.advance = adv + adv[-1:] * (self.glyphs - n)
        self.ids: dict[int, int] = {}
        for i in range(struct.unpack_from(">H", cmap, 2)[0]):
            plat, enc, off = struct.unpack_from(">HHI", cmap, 4 + 8 * i)
            form = struct.unpack_from(">H", cmap, off)[0]
            if form == 12 and plat in (0, 3):
                for k in range(struct.unpack_from(">I", cmap, off + 12)[0]):
                    a, b, g = struct.unpack_from(">III", cmap, off + 16 + 12 * k)
                    for c in range(a, b + 1):
                        self.ids[c] = g + c - a
            elif form == 4 and plat in (0, 3) and not self.ids:
                seg = struct.unpack_from(">H", cmap, off + 6)[0] // 2
                ends = struct.unpack_from(f">{seg}H", cmap, off + 14)
                starts = struct.unpack_from(f">{seg}H", cmap, off + 16 + 2 * seg)
                deltas = struct.unpack_from(f">{seg}h", cmap, off + 16 + 4 * seg)
                at = off + 16 + 6 * seg
                for k in range(seg):
                    r = struct.unpack_from(">H", cmap, at + 2 * k)[0]
                    for c in range(starts[k], ends[k] + 1):
                        if c == 0xFFFF:
                            continue
                        g = (c + deltas[k]) & 0xFFFF if not r else struct.unpack_from(">H", cmap, at + 2 * k + r + 2 * (c - starts[k]))[0]
                        if r and g:
                            g = (g + deltas[k]) & 0xFFFF
                        if g:
                            self.ids.setdefault(c, g)
        self.data = data

    def glyph(self, ch: str) -> int:
        return self.ids.get(ord(ch), 0)

    def _one(self, ch: str) -> float:
        if self.data is not None:
            return self.advance[self.glyph(ch)] * 1000 / self.units
        if self.family == "mono":
            return 600.0
        return 278.0 if ch in " .,;:'!|ilIjft()[]" else 833.0 if ch in "mwMW—" else 667.0 if ch.isupper() else 500.0

    def width(self, text: str, size: float) -> float:
        memo, total = self.memo, 0.0
        for ch in text:
            w = memo.get(ch)
            if w is None:
                w = memo[ch] = self._one(ch)
            total += w
        return total * size / 1000

    def subset(self, used: set[int]) -> bytes:
        """The font file with the outlines of used glyphs only; numbers stay the same."""
        data = self.data
        span = lambda t: data[self.tables[t][0] : sum(self.tables[t])]
        n, loca, glyf = self.glyphs, span(b"loca"), span(b"glyf")
        off = list(struct.unpack_from(f">{n + 1}I", loca)) if self.long else [2 * x for x in struct.unpack_from(f">{n + 1}H", loca)]
        want, todo = {0}, sorted(used)
        while todo:
            g = todo.pop()
            if g in want or g >= n:
                continue
            want.add(g)
            b = glyf[off[g] : off[g + 1]]
            if len(b) > 10 and struct.unpack_from(">h", b)[0] < 0:  # made of other glyphs
                at, more = 10, True
                while more:
                    flags, part = struct.unpack_from(">HH", b, at)
                    todo.append(part)
                    at += 4 + (4 if flags & 1 else 2) + (2 if flags & 8 else 4 if flags & 0x40 else 8 if flags & 0x80 else 0)
                    more = bool(flags & 0x20)
        body, new = bytearray(), []
        for g in range(n):
            new.append(len(body))
            if g in want:
                body += glyf[off[g] : off[g + 1]]
                body += b"\0" * (-len(body) % 4)
        new.append(len(body))
        keep = {t: span(t) for t in (b"head", b"hhea", b"hmtx", b"maxp", b"cvt ", b"fpgm", b"prep") if t in self.tables}
        keep[b"head"] = keep[b"head"][:50] + struct.pack(">h", 1) + keep[b"head"][52:]
        keep |= {b"loca": struct.pack(f">{n + 1}I", *new), b"glyf": bytes(body)}
        out, at = struct.pack(">IHHHH", 0x10000, len(keep), 128, 3, 16 * len(keep) - 128), 12 + 16 * len(keep)
        tail = b""
        for t in sorted(keep):
            out += t + struct.pack(">III", 0, at + len(tail), len(keep[t]))
            tail += keep[t] + b"\0" * (-len(keep[t]) % 4)
        return out + tail


@lru_cache(maxsize=16)
def font(family: str, face: int) -> Font:
    return Font(family, face)
