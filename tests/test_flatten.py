import struct

import pytest

from quire.operators import styles
from quire.operators.flatten import BOLD, ITALIC, block_text, flatten
from quire.operators.paginate import Options, effective_scale, paginate
from quire.operators.pdf import write
from quire.sources import images


def kinds(markup, *css):
    return [(b["kind"], b["level"], block_text(b)) for b in flatten(markup, css)]


@pytest.mark.parametrize(
    "markup, want",
    [
        ("<h2>A  b</h2><p>c<br>d</p>", [("heading", 2, "A b"), ("paragraph", 0, "c d")]),
        ('<p class="h3">x</p>', [("heading", 3, "x")]),
        ("<ul><li>a<ul><li>b</ul></ul>", [("list", 1, "a"), ("list", 2, "b")]),
        ("<blockquote>q</blockquote><hr>", [("quote", 0, "q"), ("rule", 0, "")]),
        ("<p>a</p></div></b><p>b", [("paragraph", 0, "a"), ("paragraph", 0, "b")]),
        ("<head><title>t</title></head><script>'</p>'</script><p>z", [("paragraph", 0, "z")]),
        ("<html><p>a</p></html><html><p>b</p></html>", [("paragraph", 0, "a"), ("page_break", 0, ""), ("paragraph", 0, "b")]),
        ("<mbp:pagebreak/><mbp:pagebreak/><p>a", [("page_break", 0, ""), ("paragraph", 0, "a")]),
        ('<p data-ebook-heading="9">t</p>', [("heading", 6, "t")]),
        ("", []),
        (None, []),
    ],
)
def test_blocks(markup, want):
    assert kinds(markup) == want


def test_spans_links_images():
    (b,) = flatten('<p>x <b>y <i>z</b></i> <a href="http://a">l</a><a href="#n">m</a></p>')
    assert [(t, s) for t, s, _ in b["spans"]][:3] == [("x ", 0), ("y ", BOLD), ("z", BOLD | ITALIC)]
    assert [t for t, _, link in b["spans"] if link] == ["l"]
    assert [b["resource"] for b in flatten('<img recindex="00007"><img src="kindle:embed:000A?x"><img src="y.png">')] == [7, 10]


def test_styles_quirks():
    css = "/* c */ p.q{font-weight:700} @media x{a{b:c} i{text-align:center}} em{x:y} .a.b{font-style:italic} div > p{font-style:italic}"
    s = styles.Sheet((css,))
    assert s.classes["q"] == {"bold": True} and s.lookup("p", "q")["bold"]
    assert s.tags["i"] == {"align": "center"} and "em" not in s.tags
    assert s.lookup("p", "a b") == {} and "a.b" not in s.lookup("p", "a")
    assert styles.size("0.5rem") == 0.5 and styles.size("-3px") is None and styles.size("0%") == 0.5 and styles.length("8px") == 0.5 and styles.length("x") is None


@pytest.mark.parametrize("css, kind, level, want", [(0, "paragraph", 0, 1.0), (3, "paragraph", 0, 2.24), (9, "paragraph", 0, 2.4), (0.1, "paragraph", 0, 0.5), (0, "heading", 1, 1.75), (0, "heading", 9, 1.28), (0.6, "heading", 6, 1.0)])
def test_scale(css, kind, level, want):
    assert effective_scale(css, kind, level) == pytest.approx(want)


def test_pages_and_file():
    blocks = flatten("<h1>One</h1>" + "<p>Some words of text to fill the lines with. </p>" * 200 + "<h1>Two</h1><p>Пример ł</p>")
    laid = paginate(blocks, Options(), {"title": "T", "authors": ["A"]})
    assert laid.headings == 2 and len(laid.pages) > 3 and len(laid.outline) == 2
    data = write(laid, "T")
    assert data.startswith(b"%PDF-") and data.rstrip().endswith(b"%%EOF") and data.count(b"/Type /Page ") == len(laid.pages)
    assert len(paginate([], Options()).pages) == 1
    sized = paginate(flatten('<html><ebook:page width="300" height="450"></ebook:page><p>x</p></html><html><ebook:page width="300" height="450"></ebook:page><p>y</p></html>'), Options(), {"paged": True})
    assert [(p.width, p.height) for p in sized.pages] == [(300.0, 450.0), (300.0, 450.0)]


def picture(kind, w=40, h=20):
    if kind == "gif":  # clear code before every point keeps all codes three bits long
        codes = [c for i in range(w * h) for c in (4, i % 4)] + [5]
        bits = sum(c << 3 * i for i, c in enumerate(codes))
        body = bits.to_bytes(-(-3 * len(codes) // 8), "little")
        blocks = b"".join(bytes([len(body[i : i + 255])]) + body[i : i + 255] for i in range(0, len(body), 255))
        return b"GIF89a" + struct.pack("<HHBBB", w, h, 0x81, 0, 0) + bytes(range(12)) + b"," + struct.pack("<HHHHB", 0, 0, w, h, 0) + b"\2" + blocks + b"\0;"
    row = (bytes([1, 2, 3]) * w).ljust(-(-3 * w // 4) * 4, b"\0")
    return b"BM" + struct.pack("<IHHIIiiHHIIIIII", 0, 0, 0, 54, 40, w, h, 1, 24, 0, 0, 0, 0, 0, 0) + row * h


def test_pictures_are_read():
    gif, bmp = images.raster(picture("gif")), images.raster(picture("bmp"))
    assert gif[:2] == bmp[:2] == (40, 20) and gif[2][:15] == bytes([*range(12), 0, 1, 2]) and bmp[2] == bytes([3, 2, 1]) * 800
    assert images.raster(picture("gif")[:40]) is None and not images.placeable(b"RIFF\0\0\0\0WEBPVP8 ")


def test_front_pages_pictures_links_and_counts():
    pictures = {1: picture("gif"), 2: picture("bmp", 900, 30), 3: b"damaged file", 4: picture("gif")}
    html = '<html><h1>One</h1><p>See <a href="http://x/">the <u>place</u></a> here.</p><img recindex="00002"/><img recindex="00003"/><img recindex="00009"/><img recindex="00004" data-ebook-fullpage=""/><p>After</p></html>'
    book = {"title": "A Title", "authors": ["Ann", "", "Bo"], "publisher": " P ", "published": "1999", "cover_index": 1}
    o = Options(page_w=300, page_h=400, margins=(30.0,) * 4, font_size=10.0)
    laid = paginate(flatten(html), o, book, pictures)
    assert (laid.headings, laid.images, laid.dropped, len(laid.outline)) == (1, 3, 2, 1)
    cover, title = laid.pages[:2]
    image = next(s for s in cover.steps if s[0] == "image")
    assert image[1:] == pytest.approx((1, 0.0, 125.0, 300.0, 150.0))
    texts = {s[3]: s for s in title.steps if s[0] == "text"}
    assert texts["Title"][6] == 20.0 and texts["Title"][5] == 1 and texts["Ann,"][6] == 11.5 and texts["Ann,"][5] == 2 and texts["1999"][6] == 8.5 * 0.75
    assert texts["Title"][2] == pytest.approx(30 + 340 * 0.28 + 20 * 0.82) and texts["1999"][2] == pytest.approx(370 - 30 + 8.5 * 0.82)
    steps = [s for p in laid.pages for s in p.steps]
    assert sum(s[0] == "underline" for s in steps) == 1 and [s[1] for s in steps if s[0] == "link"] == ["http://x/"] * 2
    whole = next(p for p in laid.pages if any(s[0] == "image" and s[1] == 4 for s in p.steps))
    assert (whole.width, whole.height) == (30.0, 15.0) and whole is not laid.pages[-1] and any(s[0] == "text" and s[3] == "After" for s in laid.pages[-1].steps)
    assert paginate(flatten(html), o, {**book, "cover_index": 3}, pictures).dropped == 2
    assert write(laid, "T", pictures).count(b"/Subtype /Image") == 3
    bare = paginate(flatten("<p>x</p>"), Options(title_page=False))
    assert len(bare.pages) == 1 and [s[3] for s in bare.pages[0].steps if s[0] == "text"] == ["1", "x"]


def test_lines_fill_and_break():
    from quire.operators.paginate import Word, broken

    words = [Word(str(i), 0, "", 10.0, 5.0) for i in range(7)]
    assert [([w.text for w in ws], width) for ws, width in broken(words, 40.0, 25.0)] == [(["0", "1"], 25.0), (["2", "3", "4"], 40.0), (["5", "6"], 25.0)]
    assert [len(ws) for ws, _ in broken(words[:2], 3.0, 3.0)] == [1, 1]
    o = Options(title_page=False, page_numbers=False)
    blank = paginate(flatten("<p>a<br/><br/>b</p>"), o).pages[0].steps
    assert blank[1][2] - blank[0][2] == pytest.approx(2 * o.font_size * o.line_spacing)
    joined = paginate(flatten("<p><b>Note:</b> text</p>"), o).pages[0].steps
    assert joined[1][1] > joined[0][1] + 20


def test_fonts_by_choice(tmp_path, monkeypatch):
    import shutil

    from quire.operators import fonts

    kind, name, files = fonts.resolved("serif")
    assert kind == "serif" and (not files or len(files) == 4)
    if files:
        path = str(tmp_path / "My.ttf")
        shutil.copy(files[0], path)
        shutil.copy(files[1], str(tmp_path / "My-Bold.ttf"))
        assert fonts.resolved(path) == ("serif", "My.ttf", (path, str(tmp_path / "My-Bold.ttf"), path, str(tmp_path / "My-Bold.ttf")))
        laid = paginate(flatten("<p>x <b>y</b></p>"), Options(font=path))
        assert laid.font(Options(font=path)) == "My.ttf" and write(laid).startswith(b"%PDF")
        assert fonts.resolved(str(tmp_path / "none.ttf"))[1] == name
    monkeypatch.setattr(fonts, "FOLDERS", ())
    fonts.resolved.cache_clear()
    fonts.font.cache_clear()
    try:
        assert fonts.resolved("sans") == ("sans", "Helvetica", ())
        assert write(paginate(flatten("<p>é</p>"), Options())).startswith(b"%PDF")
        with pytest.raises(ValueError, match="font"):
            write(paginate(flatten("<p>Привет</p>"), Options()))
    finally:
        fonts.resolved.cache_clear()
        fonts.font.cache_clear()
