"""Reader queries: files of each format are built from the tables' rows and read back by the readers, so SQL over the same rows checks what was read.

Building and reading happen in one pass over each row; nothing but the record of a book leaves it. Rows whose file has no readable content are errors and are left out.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.plans.corpus import B, FIRST, ORACLES as TABLE_SQL, TEXTS, TRIM, _KEYWORD_SQL, _PARA_SQL, _ROMAN
from quire.runtime import arrow_map, spread, table, tune
from quire.sources import images, palm, reader
from quire.sources.archive import Archive

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


# ---- writing the formats -------------------------------------------------------------------------------------------------------


def zipped(entries: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries:
            z.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


def palmdoc_packed(data: bytes) -> bytes:
    """PalmDOC compression: the last place of each three bytes is tried as a back reference, blanks before letters are folded, the rest is literal."""
    out, seen, i, n = bytearray(), {}, 0, len(data)
    while i < n:
        key = data[i : i + 3]
        at = seen.get(key, -1) if len(key) == 3 else -1
        if 0 <= at and i - at < 2048:
            size = 3
            while size < 10 and i + size < n and data[at + size] == data[i + size]:
                size += 1
            out += struct.pack(">H", 0x8000 | (i - at) << 3 | size - 3)
            for k in range(i, i + size):
                seen[data[k : k + 3]] = k
            i += size
            continue
        seen[key] = i
        c = data[i]
        if c == 32 and i + 1 < n and 0x40 <= data[i + 1] <= 0x7F:
            out.append(data[i + 1] ^ 0x80)
            i += 2
        elif c == 0 or 9 <= c <= 0x7F:
            out.append(c)
            i += 1
        else:
            run = next((k for k in range(1, 8) if i + k >= n or data[i + k] == 0 or 9 <= data[i + k] <= 0x7F), 8)
            out += bytes([run]) + data[i : i + run]
            i += run
    return bytes(out)


def huffman_records() -> tuple[bytes, bytes]:
    """A code record with one code of eight bits for each byte, and the dictionary of all bytes."""
    first = struct.pack(">I", 255 << 8 | 0x80 | 8) * 256
    offsets = b"".join(struct.pack(">H", 512 + 3 * k) for k in range(256))
    phrases = b"".join(struct.pack(">HB", 0x8001, k) for k in range(256))
    return b"HUFF" + struct.pack(">III", 24, 24, 24 + 1024) + bytes(8) + first + bytes(256), b"CDIC" + struct.pack(">III", 16, 256, 8) + offsets + phrases


_TURNED = bytes(255 - k for k in range(256))


def kindle(r: dict) -> bytes:
    """A Kindle file: typed metadata, text records of 4096 bytes with two kinds of trailers, resources, and phrase tables where the row names that compression."""
    items = [(palm.TYPES[k], v) for k in ("title", "publisher", "isbn", "published", "rights", "language", "asin") if (v := r[k]) is not None]
    items += [(palm.TYPES[k], v) for k, many in (("author", r["authors"]), ("subject", r["subjects"])) for v in many or [] if v is not None]
    if r["cover_index"]:
        items.append((palm.TYPES["cover"], struct.pack(">I", r["cover_index"] - 1)))
    rows = b"".join(struct.pack(">II", k, len(d) + 8) + d for k, v in items for d in [v if isinstance(v, bytes) else v.encode("utf-8")])
    text = r["html"].encode("utf-8")
    kind = {"PalmDOC": palm.PALMDOC, "HUFF/CDIC": palm.HUFF}.get(r["compression"], palm.NONE)
    pack = {palm.PALMDOC: palmdoc_packed, palm.HUFF: lambda b: b.translate(_TURNED), palm.NONE: bytes}[kind]
    texts = [pack(text[i : i + 4096]) + b"\0" + b"\5\6\x83" for i in range(0, len(text), 4096)]  # no bytes of a split letter, then a trailer of three bytes
    extra = list(huffman_records()) if kind == palm.HUFF else []
    pictures = [d or b"" for d in r["pictures"]]
    head = bytearray(16 + 0xE8)
    version = 8 if "v8" in (r["format_name"] or "") else 6
    values = {"compression": kind, "text_length": len(text), "text_records": len(texts), "header_length": 0xE8, "codepage": 65001, "version": version, "locale": 9, "exth_flags": 0x40}
    values |= {"first_resource": 1 + len(texts) + len(extra) if pictures else 0xFFFFFFFF, "huff_at": 1 + len(texts) if extra else 0, "huff_count": len(extra)}
    for k, v in values.items():
        at, size = palm.FIELDS[k]
        struct.pack_into(">" + size, head, at, v)
    head[16:20] = b"MOBI"
    struct.pack_into(">H", head, 0xF2, 3)
    records = [bytes(head) + b"EXTH" + struct.pack(">II", 12 + len(rows), len(items)) + rows, *texts, *extra, *pictures]
    out, at = bytearray(78), 78 + 8 * len(records)
    out[60:68] = b"BOOKMOBI"
    struct.pack_into(">H", out, 76, len(records))
    for d in records:
        out += struct.pack(">II", at, 0)
        at += len(d)
    return bytes(out) + b"".join(records)


def xml(text: str) -> str:
    return escape(text, {"\r": "&#13;", '"': "&quot;"})


def element(name: str, values, more: str = "") -> str:
    return "".join(f"<{name}{more}>{xml(v)}</{name}>" for v in values or [] if v is not None)


def epub(r: dict) -> bytes:
    """An EPUB package with the row's metadata as it stands, its page, and its pictures; the cover is the item that says so."""
    ids = "".join(f'<dc:identifier{"" if i["scheme"] is None else chr(32) + "opf:scheme=" + chr(34) + xml(i["scheme"]) + chr(34)}>{xml(i["id_text"])}</dc:identifier>' for i in r["identifiers"] or [] if i is not None and i["id_text"] is not None)
    meta = "".join(element(f"dc:{k}", r[c]) for k, c in (("title", "titles"), ("creator", "creators"), ("publisher", "publishers"), ("date", "dates"), ("rights", "rights"), ("language", "languages"), ("subject", "subjects")))
    shown = [(n, d, images.sniff(d or b"")) for n, d in enumerate(r["pictures"], 1)]
    items = "".join(f'<item id="i{n}" href="pic/{n}.{k or "bin"}" media-type="image/{k or "unknown"}"{" properties=" + chr(34) + "svg cover-image" + chr(34) if n == r["cover_index"] else ""}/>' for n, _, k in shown)
    package = f'<?xml version="1.0"?><package version="{xml(r["opf_version"] or "")}" xmlns:dc="d" xmlns:opf="o"><metadata>{meta}{ids}</metadata><manifest><item id="p" href="text/page.xhtml" media-type="application/xhtml+xml"/>{items}</manifest><spine><itemref idref="p"/></spine></package>'
    box = '<container><rootfiles><rootfile full-path="book/package.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
    page = f"<html><body>{r['html'] or ''}<p>end</p></body></html>"
    return zipped([("mimetype", b"application/epub+zip"), ("META-INF/container.xml", box.encode()), ("book/package.opf", package.encode()), ("book/text/page.xhtml", page.encode()), *((f"book/pic/{n}.{k or 'bin'}", d or b"") for n, d, k in shown)])


def comic(r: dict) -> bytes:
    """A comic archive with its record and its pages, stored in another order than they are numbered."""
    tags = (("Title", "title"), ("Series", "series"), ("Number", "issue_number"), ("Writer", "writer"), ("Publisher", "publisher"), ("Year", "issue_year"), ("Month", "issue_month"), ("LanguageISO", "language_iso"), ("Genre", "genre"))
    info = "<ComicInfo>" + "".join(element(t, [r[c]]) for t, c in tags) + "</ComicInfo>"
    pages = [(f"Page {n}.{images.sniff(d or b'') or 'png'}", d or b"") for n, d in enumerate(r["pictures"], 1)]
    return zipped([*reversed(pages), ("ComicInfo.xml", info.encode()), ("__MACOSX/._Page 1.png", b"x"), ("notes.txt", b"x")][: len(pages) + 2 if len(pages) < 3 else None])


def fictionbook(r: dict) -> bytes:
    """A FictionBook whose body is the row's text by paragraphs under one heading, with its pictures as binaries."""
    info = element("genre", r["subjects"]) + "".join(f"<author>{element('first-name', [a])}</author>" for a in r["authors"] or [] if a is not None) + element("book-title", [r["title"]]) + element("lang", [r["language"]]) + element("date", [r["published"]])
    pub = element("publisher", [r["publisher"]]) + element("isbn", [r["isbn"]])
    cover = f'<coverpage><image href="#p{r["cover_index"]}"/></coverpage>' if r["cover_index"] else ""
    body = "<section><title><p>Head</p></title>" + element("p", (r["description"] or "").split("\n")) + "</section>"
    data = "".join(f'<binary id="p{n}" content-type="image/{images.sniff(d or b"") or "png"}">{base64.b64encode(d or b"").decode()}</binary>' for n, d in enumerate(r["pictures"], 1))
    return f'<?xml version="1.0" encoding="utf-8"?><FictionBook><description><title-info>{info}{cover}</title-info><publish-info>{pub}</publish-info></description><body>{body}</body>{data}</FictionBook>'.encode()


# ---- queries -------------------------------------------------------------------------------------------------------------------

#: Pictures of each book as the readers' files hold them: one for each distinct place and bytes, by place.
_PICTURES_SQL = """p as (select distinct book_id, idx, coalesce(payload, ''::blob) as payload from resources where book_id is not null),
    s as (select book_id, row_number() over (partition by book_id order by idx, hex(payload)) as no, payload,
  case when octet_length(payload) < 8 then '' when substr(hex(payload), 1, 6) = 'FFD8FF' then 'jpeg' when substr(hex(payload), 3, 6) = '504E47'
    then 'png' when substr(hex(payload), 1, 6) = '474946' then 'gif' when substr(hex(payload), 1, 4) = '424D' then 'bmp'
  when octet_length(payload) >= 12 and substr(hex(payload), 1, 8) = '52494646' and substr(hex(payload), 17, 8) = '57454250' then 'webp' else '' end as kind from p),
  i as (select book_id, no, cast(row_number() over (partition by book_id order by no) as int) as shown from s where kind <> ''), c as (select book_id, cast(count(*) as int) as n from i group by 1)"""


def with_pictures(spark, d, rows: DataFrame) -> DataFrame:
    """Rows with ``pictures``: the payloads of their book's resources, few for any book."""
    p = table(spark, d, "resources").where("book_id is not null").select(F.col("book_id").alias("r_id"), "idx", F.coalesce("payload", F.lit(b"")).alias("payload")).distinct()
    g = p.groupBy("r_id").agg(F.array_sort(F.collect_list(F.struct("idx", F.hex("payload").alias("h"), "payload"))).alias("x"))
    j = rows.join(g.select("r_id", F.transform("x", lambda x: x["payload"]).alias("pictures")), F.col("book_id") == F.col("r_id"), "left").drop("r_id")
    return j.withColumn("pictures", F.coalesce("pictures", F.array().cast("array<binary>")))


def read_back(rows: DataFrame, key: str, suffix: str, pack) -> DataFrame:
    """(key, path, content): each row packed into a file and read by the reader that its content is detected for; rows with errors are left out."""

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        got = [(r[key], f"{key}-{r[key]}{suffix}", pack(r)) for r in b.to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], t) for k, t in enumerate((pa.int64(), pa.string(), pa.binary()))], names=[key, "path", "content"])

    files = arrow_map(rows, kernel, f"{key} bigint, path string, content binary")
    return reader.read_books(files, with_data=False).where("error is null").withColumn(key, F.regexp_extract("path", r"-(-?\d+)\.[a-z0-9]+$", 1).cast("bigint"))


@query("""select doc_id, octet_length(encode(text)) as n_bytes, md5(text) as digest from documents where text is not null""")
def palmdoc_roundtrip(spark, d) -> DataFrame:
    """Every text compressed and read again in records: its bytes and their digest."""
    tune(spark, 500)

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for t in b.column(1).to_pylist():
            data = t.encode("utf-8")
            whole = b"".join(palm.palmdoc(palmdoc_packed(data[i : i + 4096])) for i in range(0, len(data), 4096))
            out.append((len(whole), hashlib.md5(whole).hexdigest()))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string())], names=["doc_id", "n_bytes", "digest"])

    return arrow_map(spread(table(spark, d, "documents").select("doc_id", "text").where("text is not null")), kernel, "doc_id bigint, n_bytes bigint, digest string")


_T = lambda c: TRIM(f"coalesce({c}, '')")


@query(f"""with {_PICTURES_SQL} select b.book_id, coalesce(nullif({_T('title')}, ''), 'Untitled') as title, {TEXTS('authors')} as authors, {_T('publisher')} as publisher, {_T('isbn')} as isbn, {_T('published')} as published,
    coalesce(nullif({_T('language_tag')}, ''), 'en') as language, {TEXTS('subjects')} as subjects,
  case when format_name like '%v8%' then 'KF8 / AZW3 (MOBI v8)' else 'MOBI v6' end as format, case compression when 'PalmDOC' then 'PalmDOC'
    when 'HUFF/CDIC' then 'HUFF/CDIC' else 'none' end as compression, cast(octet_length(encode(html)) as int) as text_bytes, md5(html) as digest,
  coalesce(c.n, 0) as n_resources, cast(i.no as int) as cover_index from books b left join c on c.book_id = b.book_id left join i on i.book_id = b.book_id and i.no = b.cover_index where html <> ''""")
def mobi_read(spark, d) -> DataFrame:
    """Every book as a Kindle file under its row's compression: container, header, typed metadata, trailers, both compressions, resources and cover."""
    tune(spark, 200)
    cols = ("book_id", "title", "authors", "publisher", "isbn", "published", "rights", "asin", F.col("language_tag").alias("language"), "subjects", "format_name", "compression", "cover_index", "html")
    got = read_back(with_pictures(spark, d, table(spark, d, "books").where("html <> ''").select(*cols)), "book_id", ".mobi", kindle)
    return got.select("book_id", "title", "authors", "publisher", "isbn", "published", "language", "subjects", "format", "compression", "text_bytes", F.md5(F.col("html").cast("binary")).alias("digest"), "n_resources", "cover_index")


@query(f"""with {_PICTURES_SQL}, m as ({TABLE_SQL['package_metadata']}) select o.opf_id, coalesce(nullif(m.title, ''), 'opf_id-' || o.opf_id) as title, m.authors, m.publisher, m.published, m.rights, m.language_tag as language, m.subjects, m.isbn, m.format_name as format,
  coalesce(c.n, 0) as n_resources, i.shown as cover_index from opf_metadata o join m on m.opf_id = o.opf_id left join books b on b.book_id = o.book_id
    left join c on c.book_id = o.book_id left join i on i.book_id = o.book_id and i.no = b.cover_index""")
def epub_read(spark, d) -> DataFrame:
    """Every package record as an EPUB file: archive, container, package document, manifest, numbered images, cover and spine."""
    tune(spark, 200)
    b = table(spark, d, "books").select(F.col("book_id").alias("b_id"), "html", "cover_index")
    rows = table(spark, d, "opf_metadata").join(b, F.col("book_id") == F.col("b_id"), "left").drop("b_id")
    return read_back(with_pictures(spark, d, rows), "opf_id", ".epub", epub).select("opf_id", "title", "authors", "publisher", "published", "rights", "language", "subjects", "isbn", "format", "n_resources", "cover_index")


@query(f"""with {_PICTURES_SQL}, m as ({TABLE_SQL['comic_metadata']}) select o.comic_id, coalesce(nullif(m.title, ''), 'comic_id-' || o.comic_id) as title, m.authors, m.subjects, m.published, m.publisher, m.language_tag as language, c.n as n_resources, 1 as cover_index
  from comic_info o join m on m.comic_id = o.comic_id join c on c.book_id = o.book_id""")
def cbz_read(spark, d) -> DataFrame:
    """Every comic record with its pictures as an archive: record, pages in natural order, cover; archives without a picture are errors."""
    tune(spark, 500)
    return read_back(with_pictures(spark, d, table(spark, d, "comic_info")), "comic_id", ".cbz", comic).select("comic_id", "title", "authors", "subjects", "published", "publisher", "language", "n_resources", "cover_index")


_SAID = lambda c: f"trim(regexp_replace(coalesce({c}, ''), '{B}', ' ', 'g'))"
_SAIDS = lambda a: f"list_filter(list_transform(list_filter(coalesce({a}, []), lambda v: v is not null), lambda v: {_SAID('v')}), lambda v: v <> '')"


@query(f"""with {_PICTURES_SQL} select b.book_id, coalesce(nullif({_SAID('title')}, ''), 'book_id-' || b.book_id) as title, {_SAIDS('authors')} as authors, {_SAIDS('subjects')} as subjects, {_SAID('language_tag')} as language, {_SAID('published')} as published, {_SAID('publisher')} as publisher, {_SAID('isbn')} as isbn,
  coalesce(c.n, 0) as n_resources, i.shown as cover_index from books b left join c on c.book_id = b.book_id left join i on i.book_id = b.book_id and i.no = b.cover_index""")
def fb2_read(spark, d) -> DataFrame:
    """Every book as a FictionBook: tree, description, binaries, body and cover."""
    tune(spark, 500)
    cols = ("book_id", "title", "authors", "subjects", F.col("language_tag").alias("language"), "published", "publisher", "isbn", "description", "cover_index")
    return read_back(with_pictures(spark, d, table(spark, d, "books").select(*cols)), "book_id", ".fb2", fictionbook).select("book_id", "title", "authors", "subjects", "language", "published", "publisher", "isbn", "n_resources", "cover_index")


_ESCAPED = "replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query(f"""{_PARA_SQL}, o as (select doc_id, para_no, len(string_split(k, chr(10))) as n, replace(k, chr(10), ' ') as line, regexp_replace(replace(k, chr(10), ' '), '\\.$', '') as bare
    from c), h as (select *, n = 1 and length(line) <= 60 and ((bare <> '' and octet_length(encode(bare)) <= 7 and lower(bare) <> 'i'
    and regexp_matches(bare, '{_ROMAN}'))
  or (not regexp_matches(line, '[.,;:]$') and regexp_matches(line, '{_KEYWORD_SQL}'))) as head from o) select doc_id, count(*) as n_paragraphs,
    cast(count_if(head) as bigint) as n_headings, md5(string_agg(case when head then '<mbp:pagebreak/><h2>' || {_ESCAPED.format(x='line')} || '</h2>'
    else '<p>' || {_ESCAPED.format(x='line')} || '</p>' end || chr(10), '' order by para_no)) as digest from h group by 1""")
def text_read(spark, d) -> DataFrame:
    """Every text as a file: decoded, framed lines cut off, paragraphs and headings marked up; the digest covers the whole markup."""
    tune(spark, 500)
    files = table(spark, d, "documents").where("text is not null").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("content"))
    got = reader.read_books(spread(files), with_data=False).where("error is null")
    count = lambda p: F.size(F.regexp_extract_all("html", F.lit(p), F.lit(0))).cast("bigint")
    return got.select(F.regexp_extract("path", r"doc-(-?\d+)\.txt", 1).cast("bigint").alias("doc_id"), count(r"(?m)^<").alias("n_paragraphs"), count("<mbp:pagebreak/><h2>").alias("n_headings"), F.md5(F.col("html").cast("binary")).alias("digest"))


@query(r"""with v as (select book_id, html from books where html <> ''), t as (select book_id, regexp_replace(html, '(?is)<!--.*?-->', '', 'g') as html from v)
  select book_id, coalesce(nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')), ''), 'page-' || book_id) as title, trim(regexp_extract(html, '(?is)<html[^>]*\slang="([^"]*)"', 1)) as language, 0 as n_resources, 'HTML' as format
    from t""")
def page_read(spark, d) -> DataFrame:
    """Every book's markup as a page on its own: charset, tree, title, language; without files beside it no picture is found."""
    tune(spark, 200)
    files = table(spark, d, "books").where("html <> ''").select(F.concat(F.lit("page-"), F.col("book_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").cast("binary").alias("content"))
    return reader.read_books(spread(files), with_data=False).where("error is null").select(F.regexp_extract("path", r"page-(-?\d+)\.html", 1).cast("bigint").alias("book_id"), "title", "language", "n_resources", "format")


@query("""select book_id, case when format_name like 'Kindle%' or format_name like 'MOBI%' or format_name like 'KF8%' then 'mobi' when format_name like 'EPUB%'
    then 'epub' when format_name like 'Comic%' then 'cbz' when format_name like 'FictionBook%' then case when lower(file_path) like '%.fb2.zip'
    then 'fb2zip' else 'fb2' end
  when format_name = 'HTML' then 'html' when format_name = 'Plain text' then 'text' else 'unknown' end as detected from books""")
def detect_files(spark, d) -> DataFrame:
    """The format that is detected from the first bytes and the name of each book's file, written in the format that its row names."""
    tune(spark, 500)
    empty = {k: None for k in ("title", "publisher", "isbn", "published", "rights", "language", "asin", "authors", "subjects", "cover_index", "description", "identifiers", "titles", "creators", "publishers", "dates", "languages", "opf_version", "series", "issue_number", "writer", "issue_year", "issue_month", "language_iso", "genre")}
    png = b"\x89PNG\r\n\x1a\n" + bytes(8)

    def written(name: str, path: str, compression: str | None) -> tuple[str, bytes]:
        row = empty | {"html": "<p>x</p>", "pictures": [png], "compression": compression, "format_name": name}
        for start, pack in (("MOBI", kindle), ("KF8", kindle), ("Kindle", kindle), ("EPUB", epub), ("Comic", comic), ("FictionBook", fictionbook)):
            if (name or "").startswith(start):
                data = pack(row)
                return "f", zipped([("a.fb2", data)]) if pack is fictionbook and path.lower().endswith(".fb2.zip") else data
        return {"HTML": ("f.html", b"<p>x</p>"), "Plain text": ("f.txt", b"x")}.get(name, ("f", b"x"))

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        got = [reader.detect(*reversed(written(n, p or "", c))) for n, p, c in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)))]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.string())], names=["book_id", "detected"])

    return arrow_map(spread(table(spark, d, "books").select("book_id", "format_name", "file_path", "compression")), kernel, "book_id bigint, detected string")


@query("""with p as (select distinct book_id, idx, coalesce(n_bytes, 0) as n from resources where book_id is not null and idx is not null), g as (select book_id, idx, min(n) as n from p group by 1, 2)
  select book_id, 'part/' || idx || '.BIN' as name, n as size, true as found from g""")
def archive_index(spark, d) -> DataFrame:
    """The index of an archive for each book: safe entries by cleaned name, the first of equal ones; every other name is looked up without regard to case."""
    tune(spark, 200)
    p = table(spark, d, "resources").where("book_id is not null and idx is not null").select("book_id", "idx", F.coalesce("n_bytes", F.lit(0)).alias("n")).distinct()
    g = p.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("idx", "n"))).alias("x"))

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = ([], [], [], [])
        for book, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            inside = [(f"{'./' if k % 2 else ''}part{chr(92) if k % 3 == 0 else '/'}{e['idx']}.BIN", bytes(e["n"])) for k, e in enumerate(x)]
            a = Archive(zipped([("../out.bin", b"x"), ("/abs.bin", b"x"), ("C:/d.bin", b"x"), ("part/", b""), *inside]))
            for name in a.names():
                for r, v in zip(rows, (book, name, a.entries[name].file_size, a.find(name.lower()) == name)):
                    r.append(v)
        return pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, (pa.int64(), pa.string(), pa.int32(), pa.bool_()))], names=["book_id", "name", "size", "found"])

    return arrow_map(spread(g), kernel, "book_id bigint, name string, size int, found boolean")
