"""Image kinds and pixel sizes from headers alone."""

from __future__ import annotations

import struct


def sniff(data: bytes) -> str:
    if len(data) < 8:
        return ""
    for kind, hit in (("jpeg", data[:3] == b"\xff\xd8\xff"), ("png", data[1:4] == b"PNG"), ("gif", data[:3] == b"GIF"), ("bmp", data[:2] == b"BM"), ("webp", len(data) >= 12 and data[:4] == b"RIFF" and data[8:12] == b"WEBP")):
        if hit:
            return kind
    return ""


def _jpeg_frame(data: bytes) -> tuple[int, int, int] | None:
    """(width, height, colour components) from the frame header, found by the lengths of the segments before it."""
    pos = 2
    while pos + 9 < len(data):
        if data[pos] != 0xFF:
            pos += 1
            continue
        mark = data[pos + 1]
        if mark == 0xFF or 0xD0 <= mark <= 0xD9 or mark == 0x01:
            pos += 1 if mark == 0xFF else 2
            continue
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            h, w, parts = struct.unpack(">HHB", data[pos + 5 : pos + 10])
            return w, h, parts
        pos += 2 + struct.unpack(">H", data[pos + 2 : pos + 4])[0]
    return None


def jpeg_parts(data: bytes) -> int | None:
    try:
        frame = _jpeg_frame(data)
    except (struct.error, IndexError):
        return None
    return frame[2] if frame else None


def placeable(data: bytes) -> bool:
    """Whether a file can be drawn: all JPEG; PNG without interlacing, 8 bits deep where it is transparent; GIF and BMP that can be read. WebP cannot."""
    kind = sniff(data)
    if kind == "png":
        return len(data) >= 29 and not data[28] and (data[25] in (0, 2, 3) or (data[24] == 8 and data[25] in (4, 6)))
    return kind == "jpeg" or (kind in ("gif", "bmp") and raster(data) is not None)


def raster(data: bytes) -> tuple[int, int, bytes] | None:
    """(width, height, RGB bytes) of a GIF's first picture or an uncompressed BMP, transparent points white; None where the file cannot be read."""
    try:
        return _gif(data) if sniff(data) == "gif" else _bmp(data)
    except (struct.error, IndexError, ValueError):
        return None


def _gif(data: bytes) -> tuple[int, int, bytes] | None:
    width, height, flags = struct.unpack("<HHB", data[6:11])
    pos = 13
    palette = b""
    if flags & 0x80:
        n = 3 << (flags & 7) + 1
        palette, pos = data[pos : pos + n], pos + n
    clear = None
    while data[pos] != 0x2C:
        if data[pos] != 0x21:
            return None
        if data[pos + 1] == 0xF9 and data[pos + 3] & 1:
            clear = data[pos + 6]
        pos += 2
        while data[pos]:
            pos += data[pos] + 1
        pos += 1
    x0, y0, w, h, flags = struct.unpack("<HHHHB", data[pos + 1 : pos + 10])
    pos += 10
    if flags & 0x80:
        n = 3 << (flags & 7) + 1
        palette, pos = data[pos : pos + n], pos + n
    least, packed = data[pos], bytearray()
    pos += 1
    while data[pos]:
        packed += data[pos + 1 : pos + 1 + data[pos]]
        pos += data[pos] + 1
    points = _lzw(bytes(packed), least, w * h)
    if len(points) < w * h or width * height > 1 << 26:
        return None
    order = [y for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(start, h, step)] if flags & 0x40 else range(h)
    colours = [palette[3 * i : 3 * i + 3] for i in range(len(palette) // 3)]
    out = bytearray(b"\xff" * (3 * width * height))
    for k, y in enumerate(order):
        row = b"".join(b"\xff\xff\xff" if c == clear else colours[c] for c in points[k * w : (k + 1) * w])
        at = 3 * ((y0 + y) * width + x0)
        if y0 + y < height and x0 + w <= width:
            out[at : at + len(row)] = row
    return width, height, bytes(out)


def _lzw(packed: bytes, least: int, n: int) -> bytes:
    """The first ``n`` bytes of a code stream with variable code lengths, low bits first."""
    end = (1 << least) + 1
    words: list[bytes] = []
    out, held, bits, size, last, pos = bytearray(), 0, 0, least + 1, b"", 0
    while len(out) < n:
        while bits < size:
            if pos >= len(packed):
                return bytes(out)
            held |= packed[pos] << bits
            bits, pos = bits + 8, pos + 1
        code, held, bits = held & (1 << size) - 1, held >> size, bits - size
        if code == end:
            break
        if code == end - 1:
            words, size, last = [bytes([i]) for i in range(1 << least)] + [b"", b""], least + 1, b""
            continue
        word = words[code] if code < len(words) else last + last[:1]
        out += word
        if last and len(words) < 4096:
            words.append(last + word[:1])
        if len(words) == 1 << size and size < 12:
            size += 1
        last = word
    return bytes(out)


def _bmp(data: bytes) -> tuple[int, int, bytes] | None:
    start, head = struct.unpack("<I", data[10:14])[0], struct.unpack("<I", data[14:18])[0]
    width, tall, _, depth, packed = struct.unpack("<iiHHI", data[18:34])
    height, stride = abs(tall), (width * depth + 31) // 32 * 4
    if packed not in (0, 3) or depth not in (8, 24, 32) or width <= 0 or width * height > 1 << 26 or len(data) < start + stride * height:
        return None
    palette = [data[i : i + 3][::-1] for i in range(14 + head, start, 4)]
    out = bytearray()
    for y in range(height):
        row = data[start + stride * (height - 1 - y if tall > 0 else y) :][:stride]
        if depth == 8:
            out += b"".join(palette[c] for c in row[:width])
        else:
            step, line = depth // 8, bytearray(3 * width)
            for c in range(3):
                line[c::3] = row[2 - c : step * width : step]
            out += line
    return width, height, bytes(out)


def pixels(data: bytes) -> tuple[int, int] | None:
    """(width, height), None where the header cannot be read."""
    try:
        kind = sniff(data)
        if kind == "png":
            return struct.unpack(">II", data[16:24])
        if kind == "gif":
            return struct.unpack("<HH", data[6:10])
        if kind == "bmp":
            w, h = struct.unpack("<ii", data[18:26])
            return abs(w), abs(h)
        if kind == "webp":
            tag = data[12:16]
            if tag == b"VP8X" and len(data) >= 30:
                return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
            if tag == b"VP8L" and len(data) >= 25:
                b = int.from_bytes(data[21:25], "little")
                return (b & 0x3FFF) + 1, (b >> 14 & 0x3FFF) + 1
            w, h = struct.unpack("<HH", data[26:30])
            return w & 0x3FFF, h & 0x3FFF
        if kind == "jpeg":
            frame = _jpeg_frame(data)
            return frame and frame[:2]
    except (struct.error, IndexError):
        pass
    return None
