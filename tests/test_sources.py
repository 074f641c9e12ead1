import io
import struct
import zipfile
import zlib

import pytest

from quire.plans import naming
from quire.sources import comic, palm, reader
from quire.sources.archive import Archive, resolve
from quire.sources.epub import Locked, viewport
from quire.sources.pages import is_heading

PNG = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII5B", 13, b"IHDR", 3, 4, 8, 0, 0, 0, 0) + b"\0\0\0\0"
PNG += struct.pack(">I4s", 10, b"IDAT") + zlib.compress(b"\0\0\0\0" * 4)[:10] + b"\0\0\0\0"


def zipped(*entries):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        for n, d in entries:
            z.writestr(n, d)
    return b.getvalue()


def kindle(markup: bytes, compression=1, title=b"My Book", flags=0):
    head = bytearray(0x100)
    struct.pack_into(">HHIHH", head, 0, compression, 0, len(markup), 1, 4096)
    struct.pack_into(">II", head, 0x10, 0x4D4F4249, 0xE8)
    struct.pack_into(">I", head, 0x1C, 65001)
    struct.pack_into(">I", head, 0x24, 6)
    struct.pack_into(">II", head, 0x54, 0xC0, len(title))
    head[0xC0 : 0xC0 + len(title)] = title
    recs = [bytes(head), markup]
    out = bytearray(78)
    out[60:68] = b"BOOKMOBI"
    struct.pack_into(">H", out, 76, len(recs))
    at = 78 + 8 * len(recs)
    for r in recs:
        out += struct.pack(">II", at, 0)
        at += len(r)
    return bytes(out) + b"".join(recs)


def epub(opf_extra="", spine='<itemref idref="a"/>', files=(), version="3.0", metas=""):
    opf = f'<package version="{version}" xmlns:dc="d"><metadata><dc:title> </dc:title><dc:title>My</dc:title><dc:creator>Me</dc:creator><dc:identifier>urn:isbn:123</dc:identifier><dc:description>&lt;p&gt;a &lt;b&gt;b&lt;/b&gt;&lt;/p&gt;</dc:description>{metas}</metadata><manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/>{opf_extra}</manifest><spine toc="ncx">{spine}</spine></package>'
    return zipped(("mimetype", "application/epub+zip"), ("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/p.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'), ("O/p.opf", opf), ("O/a.xhtml", "<html><body><div id='t'><p>Chap</p><p>text</p></div></body></html>"), *files)


def test_detection():
    assert reader.detect(kindle(b"<p>x")) == "mobi" and reader.detect(b"\0" * 60 + b"TEXtREAd") == "mobi"
    assert reader.detect(epub()) == "epub" and reader.detect(zipped(("a.fb2", "x"))) == "fb2zip"
    assert reader.detect(zipped(("1.png", PNG), ("__MACOSX/._1.png", "x"))) == "cbz" and reader.detect(zipped(("a.txt", "x"))) == "unknown"
    assert reader.detect(b"\xef\xbb\xbf <FictionBook>", "x.txt") == "fb2" and reader.detect(b"x", "a.HTM") == "html" and reader.detect(b"x", "a.txt") == "text"
    with pytest.raises(ValueError):
        reader.detect(b"PK\x03\x04damaged")


def test_kindle():
    b = reader.decode(kindle(b"<html><p>hi</p></html>"))
    assert (b["title"], b["html"], b["compression"], b["format"]) == ("My Book", "<html><p>hi</p></html>", "none", "MOBI v6")
    with pytest.raises(ValueError):
        reader.decode(b"\0" * 60 + b"TEXtREAd" + b"\0" * 20)


def squeezed(text: bytes) -> bytes:
    """PalmDOC compression by longest earlier match, to check the reader by a round trip."""
    out, i = bytearray(), 0
    while i < len(text):
        best = max(((n, d) for d in range(1, min(i, 2047) + 1) for n in range(3, 11) if text[i : i + n] == (text[i - d : i] * n)[:n] and i + n <= len(text)), default=None)
        if best:
            out += struct.pack(">H", 0x8000 | best[1] << 3 | best[0] - 3)
            i += best[0]
        elif text[i] == 32 and i + 1 < len(text) and 0x40 <= text[i + 1] <= 0x7F:
            out.append(text[i + 1] ^ 0x80)
            i += 2
        elif text[i] == 0 or 9 <= text[i] <= 0x7F:
            out.append(text[i])
            i += 1
        else:
            out += b"\1" + text[i : i + 1]
            i += 1
    return bytes(out)


@pytest.mark.parametrize("text", [b"", b"one one one two", b"zzzzzzzzzzzzzzzzzzzzz", "żółw i żółw \0 x".encode(), b"a b c d e f " * 40])
def test_palmdoc_round_trip(text):
    assert palm.palmdoc(squeezed(text)) == text


@pytest.mark.parametrize("data, want", [(b"\x02qr", b"qr"), (b"\xf1", b" q"), (b"mn\x80\x0d", b"mn" + b"nnnnnnnn"), (b"\x9f\xf9q", b"q"), (b"\x07qr", b"qr"), (b"q\x80", b"q")])
def test_palmdoc(data, want):
    assert palm.palmdoc(data) == want


def huffed(phrases, plain):
    """A code record in which every phrase has an eight-bit code, and its dictionary."""
    first = b"".join(struct.pack(">I", 255 << 8 | 0x80 | 8) for _ in range(256))
    body, offsets = b"", []
    for p, whole in zip(phrases, plain):
        offsets.append(2 * len(phrases) + len(body))
        body += struct.pack(">H", len(p) | (0x8000 if whole else 0)) + p
    return b"HUFF" + struct.pack(">III", 24, 24, 24 + 1024) + b"\0" * 8 + first + b"\0" * 256, b"CDIC" + struct.pack(">III", 16, len(phrases), 8) + b"".join(struct.pack(">H", o) for o in offsets) + body


def test_trailers_and_huffman():
    assert palm.trimmed(b"wxyz\x07\x82", 2) == b"wxyz" and palm.trimmed(b"wxyz\x01", 1) == b"wxy" and palm.trimmed(b"\x84", 2) == b""
    code = lambda *ks: bytes(255 - k for k in ks)
    huff, cdic = huffed([b"tide ", b"mill ", code(0, 1, 0)], [True, True, False])
    h = palm.Huffman(huff, [cdic])
    assert h.expand(code(2, 1, 2)) == b"tide mill tide mill tide mill tide " and h.phrases[2] == (b"tide mill tide ", True)
    with pytest.raises(ValueError):
        h.expand(code(3))
    loop = palm.Huffman(*[x if k == 0 else [x] for k, x in enumerate(huffed([code(0)], [False]))])
    with pytest.raises(ValueError):
        loop.expand(code(0))
    with pytest.raises(ValueError):
        palm.Huffman(huff[:800], [cdic])

def test_epub():
    nav = '<html><body><nav epub:type="toc"><ol><li><a href="a.xhtml#t">x</a></li></ol></nav></body></html>'
    b = reader.decode(epub('<item id="n" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="i" href="i.png" media-type="image/png" properties="cover-image"/>', files=[("O/nav.xhtml", nav), ("O/i.png", PNG)]))
    assert (b["title"], b["authors"], b["isbn"], b["description"], b["format"], b["cover"]) == ("My", ["Me"], "123", "a b", "EPUB 3", 1)
    assert '<p data-ebook-heading="1">Chap</p>' in b["html"]
    with pytest.raises(Locked):
        reader.decode(epub(files=[("META-INF/rights.xml", "x")]))
    ok = '<encryption><EncryptedData><EncryptionMethod Algorithm="http://www.idpf.org/2008/embedding"/></EncryptedData></encryption>'
    assert reader.decode(epub(files=[("META-INF/encryption.xml", ok)]))["title"] == "My"
    with pytest.raises(Locked):
        reader.decode(epub(files=[("META-INF/encryption.xml", ok.replace("idpf", "other"))]))
    with pytest.raises(ValueError):
        reader.decode(epub(spine=""))
    fixed = reader.decode(epub(metas='<meta property="rendition:layout">pre-paginated</meta><meta property="rendition:viewport">width=400,height=600</meta>'))
    assert fixed["paged"] and '<ebook:page width="300" height="450">' in fixed["html"] and viewport("width=1200px; height = 900") == (1200.0, 900.0)


def test_comic_fictionbook_text_page(tmp_path):
    c = reader.decode(zipped(("10.png", PNG), ("2.png", PNG), ("1.png", PNG), ("ComicInfo.xml", "<ComicInfo><Series>S</Series><Number>3</Number><Year>2001</Year><Month>5</Month></ComicInfo>")), "x.cbz")
    assert (c["title"], c["published"], len(c["resources"]), c["paged"]) == ("S #3", "2001-05", 3, True)
    assert sorted(["p10", "p2", "P02", "p1"], key=comic.natural) == ["p1", "P02", "p2", "p10"]
    f = reader.decode('<?xml version="1.0"?><FictionBook><description><title-info><book-title>T</book-title><author><nickname>N</nickname></author></title-info></description><body><section><title><p>One</p></title><p>a &nbsp;<emphasis>b</emphasis></p></section></body><body name="notes"><title><p>x</p></title><section><p>n</p></section></body></FictionBook>'.encode())
    assert f["authors"] == ["N"] and "<h1>One</h1>" in f["html"] and "<h1>Notes</h1>" in f["html"] and "<p>x</p>" not in f["html"]
    assert reader.decode("<FictionBook><body><p>Привет</p></body></FictionBook>".encode("cp1251"))["encoding"] == "windows-1251"
    t = reader.decode(b"Title: A\r\nAuthor: B\r\n*** START OF THE PROJECT GUTENBERG EBOOK A ***\r\nChapter I\r\n\r\nx\r\ny\r\n*** END OF", "z.txt")
    assert (t["title"], t["authors"]) == ("A", ["B"]) and t["html"] == "<mbp:pagebreak/><h2>Chapter I</h2>\n<p>x y</p>\n"
    with pytest.raises(ValueError):
        reader.decode(b" \n", "e.txt")
    (tmp_path / "i.png").write_bytes(PNG)
    p = reader.decode(b"<html lang='en'><title> A  b </title><img src='i.png'><img src='i.png'><img src='../x.png'><img src='http://r/x.png'><script>1</script>", str(tmp_path / "p.html"))
    assert (p["title"], p["language"], len(p["resources"]), p["html"].count("recindex"), p["html"].count("<img")) == ("A b", "en", 1, 2, 2)


@pytest.mark.parametrize("line, want", [("Chapter Nine: Salt", True), ("Chapter the Ninth", False), ("PART 3", True), ("PART 3.", False), ("LXII", True), ("vii.", True), ("Epilogue", True), ("Preface to the second edition and more", False), ("V", True), ("LID", False), ("Volume two was lost", False), ("Part:", False), ("Foreword; or, why", False)])
def test_heading_lines(line, want):
    assert is_heading(line) is want


def test_archive_and_names(tmp_path):
    a = Archive(zipped(("../up.txt", "x"), ("/abs.txt", "x"), ("C:/d.txt", "x"), ("a\\b.txt", "1"), ("a/b.txt", "2"), ("d/", "")))
    assert a.names() == ["a/b.txt"] and a.read("A/B.TXT") == b"1" and a.find("../a/b.txt") is None
    with pytest.raises(ValueError):
        Archive(zipped(("z.bin", b"\0" * (3 << 20)))).read("z.bin")
    assert resolve("O/a/x.html", "../i%20m.png#f") == "O/i m.png" and resolve("O/x", "/r.png") == "r.png"
    assert naming.safe_name('a: b*?"<c>|\\/.') == "a - b'(c)---" and naming.safe_name("...") == "book" and len(naming.safe_name("é" * 200).encode()) <= 150
    first = naming.output_path("/x/b.epub", folder=str(tmp_path))
    open(first, "w").close()
    assert first.endswith("/b.pdf") and naming.output_path("/x/b.fb2.zip", folder=str(tmp_path)).endswith("b.fb2.pdf")
    assert naming.output_path("/x/b.epub", folder=str(tmp_path), mode="rename").endswith("b (2).pdf")
    with pytest.raises(FileExistsError):
        naming.output_path("/x/b.epub", folder=str(tmp_path))
    o = naming.options_for("paperback", "a4", {"font_size": 99}, {"margin_mm": 0.0, "justify": False})
    assert (o.page_w, o.font_size, o.margins[0], o.justify, o.running_header) == (432.0, 40.0, 0.0, False, True)


def test_reading_in_spark(spark, tmp_path):
    from quire.plans.convert import convert, write_pdfs
    from quire.sources.datasource import archive_entries, register

    files = spark.createDataFrame([("/a/x.txt", b"Chapter I\n\nword\n"), ("/a/y.epub", b"PK\x03\x04no"), ("/a/z.mobi", kindle(b"<p>k</p>")), ("/a/n.txt", None)], "path string, content binary")
    got = {r["path"]: r for r in reader.read_books(files).collect()}
    assert got["/a/z.mobi"]["title"] == "My Book" and got["/a/y.epub"]["error"] and got["/a/n.txt"]["error"] and got["/a/x.txt"]["title"] == "x"
    assert {r["error"] is None for r in archive_entries(files.where("path = '/a/y.epub'")).collect()} == {False}
    books = reader.read_books(files, False).where("error is null").selectExpr("hash(path) * 1L as book_id", "title", "authors", "publisher", "html", "flows", "paged", "cover_index")
    out = write_pdfs(convert(books), str(tmp_path / "out")).collect()
    assert len(out) == 2 and all(open(r["path"], "rb").read(5) == b"%PDF-" for r in out)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.mobi").write_bytes(kindle(b"x"))
    register(spark)
    assert [r["format"] for r in spark.read.format("book_heads").load(str(tmp_path / "in")).collect()] == ["mobi"]


def test_streams(spark, tmp_path):
    from quire.streaming.ingest import stream_books, write_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"Hello there\n")
    write_stream(stream_books(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert [r["title"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a"]
