"""Laid-out pages as a PDF file: embedded font subsets, pictures as they are, links and an outline."""

from __future__ import annotations

import struct
import zlib

from quire.operators.fonts import font
from quire.operators.paginate import Laid
from quire.sources import images


def _text(s: str) -> bytes:
    return b"<FEFF" + s.encode("utf-16-be", "replace").hex().upper().encode() + b">"


class Writer:
    def __init__(self) -> None:
        self.objects: list[bytes] = []

    def add(self, body: bytes = b"") -> int:
        self.objects.append(body)
        return len(self.objects)

    def set(self, k: int, body: bytes) -> None:
        self.objects[k - 1] = body

    def stream(self, data: bytes, extra: bytes = b"", packed: bool = True) -> int:
        if packed:
            data, extra = zlib.compress(data, 6), extra + b" /Filter /FlateDecode"
        return self.add(b"<< /Length %d%s >>\nstream\n" % (len(data), extra) + data + b"\nendstream")

    def file(self, root: int) -> bytes:
        out, at = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), []
        for k, body in enumerate(self.objects, 1):
            at.append(len(out))
            out += b"%d 0 obj\n" % k + body + b"\nendobj\n"
        start = len(out)
        out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(at) + 1) + b"".join(b"%010d 00000 n \n" % x for x in at)
        return bytes(out + b"trailer\n<< /Size %d /Root %d 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(at) + 1, root, start))


def _picture(w: Writer, data: bytes) -> int | None:
    kind, size = images.sniff(data), images.pixels(data)
    if not size:
        return None
    head = b" /Type /XObject /Subtype /Image /Width %d /Height %d" % size
    if kind == "jpeg":
        parts = images.jpeg_parts(data) or 3
        space = {1: b"/DeviceGray", 4: b"/DeviceCMYK"}.get(parts, b"/DeviceRGB")
        return w.stream(data, head + b" /BitsPerComponent 8 /ColorSpace %s /Filter /DCTDecode" % space, False)
    if kind in ("gif", "bmp"):
        got = images.raster(data)
        return w.stream(got[2], head + b" /BitsPerComponent 8 /ColorSpace /DeviceRGB") if got else None
    if kind != "png" or len(data) < 33:
        return None
    depth, colour, _, _, laced = struct.unpack(">5B", data[24:29])
    chunks, pos = {}, 8
    while pos + 8 <= len(data):
        n, tag = struct.unpack(">I4s", data[pos : pos + 8])
        chunks[tag] = chunks.get(tag, b"") + data[pos + 8 : pos + 8 + n]
        pos += 12 + n
    if laced or b"IDAT" not in chunks or colour not in (0, 2, 3):
        return _flattened(w, size, depth, colour, laced, chunks, head)
    n = {0: 1, 2: 3, 3: 1}[colour]
    space = b"[/Indexed /DeviceRGB %d <%s>]" % (len(chunks.get(b"PLTE", b"")) // 3 - 1, chunks.get(b"PLTE", b"").hex().encode()) if colour == 3 else b"/DeviceRGB" if n == 3 else b"/DeviceGray"
    return w.stream(chunks[b"IDAT"], head + b" /BitsPerComponent %d /ColorSpace %s /Filter /FlateDecode /DecodeParms << /Predictor 15 /Colors %d /BitsPerComponent %d /Columns %d >>" % (depth, space, n, depth, size[0]), False)


def _flattened(w: Writer, size: tuple[int, int], depth: int, colour: int, laced: int, chunks: dict, head: bytes) -> int | None:
    """A picture with transparency, laid on white; other forms cannot be placed."""
    if laced or depth != 8 or colour not in (4, 6):
        return None
    try:
        raw = zlib.decompress(chunks.get(b"IDAT", b""))
    except zlib.error:
        return None
    n, width = (2 if colour == 4 else 4), size[0]
    row, before, out = width * n, bytearray(width * n), bytearray()
    for y in range(size[1]):
        line = raw[y * (row + 1) : (y + 1) * (row + 1)]
        if len(line) < row + 1:
            return None
        f, cur = line[0], bytearray(line[1:])
        for i in range(row):
            a, b, c = cur[i - n] if i >= n else 0, before[i], before[i - n] if i >= n else 0
            if f == 4:
                p = a + b - c
                add = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            else:
                add = (0, a, b, (a + b) // 2)[f] if f < 4 else 0
            cur[i] = (cur[i] + add) & 255
        for i in range(0, row, n):
            al = cur[i + n - 1]
            out += bytes((v * al + 255 * (255 - al)) // 255 for v in cur[i : i + n - 1])
        before = cur
    return w.stream(bytes(out), head + b" /BitsPerComponent 8 /ColorSpace %s" % (b"/DeviceGray" if n == 2 else b"/DeviceRGB"))


def refuse_lost(text: str) -> None:
    """A standard font shows Western European letters only: other texts are refused, never turned into question marks."""
    try:
        text.encode("cp1252")
    except UnicodeEncodeError as e:
        raise ValueError(f"no font file is installed that shows {text[e.start]!r}") from None


def write(laid: Laid, title: str = "", pictures: dict[int, bytes] | None = None) -> bytes:
    """The file of laid-out pages."""
    w, pictures = Writer(), pictures or {}
    root, tree = w.add(), w.add()
    used: dict[tuple[str, int], dict[int, str]] = {}
    placed: dict[int, int | None] = {}
    for p in laid.pages:
        for s in p.steps:
            if s[0] == "text":
                f = font(s[4], s[5])
                if f.data is None:
                    refuse_lost(s[3])
                seen = used.setdefault((s[4], s[5]), {})
                for ch in s[3]:
                    seen.setdefault(f.glyph(ch) if f.data is not None else ord(ch), ch)
            elif s[0] == "image" and s[1] not in placed:
                placed[s[1]] = _picture(w, pictures[s[1]]) if s[1] in pictures else None
    names = {k: b"F%d" % i for i, k in enumerate(sorted(used), 1)}
    fonts = b" ".join(b"/%s %d 0 R" % (names[k], _font(w, k, used[k])) for k in names)
    shown = b" ".join(b"/I%d %d 0 R" % (k, v) for k, v in placed.items() if v)
    res = w.add(b"<< /Font << %s >> /XObject << %s >> >>" % (fonts, shown))
    pages = []
    for p in laid.pages:
        out, links = [], []
        for s in p.steps:
            if s[0] == "text":
                _, x, y, t, fam, face, size, grey = s
                f = font(fam, face)
                code = b"<" + "".join(f"{f.glyph(c):04X}" for c in t).encode() + b">" if f.data is not None else b"<" + t.encode("cp1252", "replace").hex().encode() + b">"
                out.append(b"%s BT /%s %.2f Tf %.2f %.2f Td %s Tj ET" % (b"0.51 g" if grey else b"0 g", names[fam, face], size, x, p.height - y, code))
            elif s[0] == "image" and placed.get(s[1]):
                out.append(b"q %.2f 0 0 %.2f %.2f %.2f cm /I%d Do Q" % (s[4], s[5], s[2], p.height - s[3] - s[5], s[1]))
            elif s[0] == "line":
                out.append(b"0.67 G 0.5 w %.2f %.2f m %.2f %.2f l S" % (s[1], p.height - s[3], s[2], p.height - s[3]))
            elif s[0] == "underline":
                out.append(b"0 G 0.5 w %.2f %.2f m %.2f %.2f l S" % (s[1], p.height - s[3], s[2], p.height - s[3]))
            elif s[0] == "link":
                uri = s[1].encode("ascii", "ignore").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
                links.append(w.add(b"<< /Type /Annot /Subtype /Link /Border [0 0 0] /Rect [%.2f %.2f %.2f %.2f] /A << /S /URI /URI (%s) >> >>" % (s[2], p.height - s[3] - s[5], s[2] + s[4], p.height - s[3], uri)))
        body = w.stream(b"\n".join(out))
        marks = b" /Annots [%s]" % b" ".join(b"%d 0 R" % k for k in links) if links else b""
        pages.append(w.add(b"<< /Type /Page /Parent %d 0 R /MediaBox [0 0 %.2f %.2f] /Resources %d 0 R /Contents %d 0 R%s >>" % (tree, p.width, p.height, res, body, marks)))
    w.set(tree, b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(pages), b" ".join(b"%d 0 R" % k for k in pages)))
    outline = b""
    if laid.outline:
        top = w.add()
        ids = [w.add() for _ in laid.outline]
        for i, (k, (t, page, y)) in enumerate(zip(ids, laid.outline)):
            near = (b" /Prev %d 0 R" % ids[i - 1] if i else b"") + (b" /Next %d 0 R" % ids[i + 1] if i + 1 < len(ids) else b"")
            w.set(k, b"<< /Title %s /Parent %d 0 R /Dest [%d 0 R /XYZ null %.2f null]%s >>" % (_text(t), top, pages[page], laid.pages[page].height - y, near))
        w.set(top, b"<< /Type /Outlines /First %d 0 R /Last %d 0 R /Count %d >>" % (ids[0], ids[-1], len(ids)))
        outline = b" /Outlines %d 0 R /PageMode /UseOutlines" % top
    w.set(root, b"<< /Type /Catalog /Pages %d 0 R%s >>" % (tree, outline))
    return w.file(root)


def _font(w: Writer, key: tuple[str, int], seen: dict[int, str]) -> int:
    f = font(*key)
    if f.data is None:
        return w.add(b"<< /Type /Font /Subtype /Type1 /BaseFont /%s /Encoding /WinAnsiEncoding >>" % f.name.encode())
    k = 1000 / f.units
    name = b"QUIRES+" + f.name.encode()
    file = w.stream(f.subset(set(seen)))
    desc = w.add(b"<< /Type /FontDescriptor /FontName /%s /Flags 4 /FontBBox [%d %d %d %d] /ItalicAngle 0 /Ascent %d /Descent %d /CapHeight 700 /StemV 80 /FontFile2 %d 0 R >>" % (name, *(int(x * k) for x in f.box), int(f.ascent * k), int(f.descent * k), file))
    widths = b" ".join(b"%d [%d]" % (g, round(f.advance[g] * k)) for g in sorted(seen))
    part = w.add(b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /%s /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> /FontDescriptor %d 0 R /CIDToGIDMap /Identity /DW 600 /W [%s] >>" % (name, desc, widths))
    rows = b"\n".join(b"<%04X> <%s>" % (g, c.encode("utf-16-be").hex().upper().encode()) for g, c in sorted(seen.items()))
    cmap = w.stream(b"/CIDInit /ProcSet findresource begin 12 dict begin begincmap /CMapName /U def /CMapType 2 def 1 begincodespacerange <0000> <FFFF> endcodespacerange %d beginbfchar\n%s\nendbfchar endcmap end end" % (len(seen), rows))
    return w.add(b"<< /Type /Font /Subtype /Type0 /BaseFont /%s /Encoding /Identity-H /DescendantFonts [%d 0 R] /ToUnicode %d 0 R >>" % (name, part, cmap))
