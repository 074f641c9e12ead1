"""Detection by content and reading of book files: files become rows, a failure becomes the row's ``error``."""

from __future__ import annotations

import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.scalars import is_book_file, is_text_file
from quire.runtime import arrow_map
from quire.sources import comic, epub, fictionbook, pages, palm
from quire.sources.archive import Archive

HEAD = 4096


def classify_archive(data) -> str:
    """The format of an archive, given as bytes or as an open file."""
    a = Archive(data)
    names = a.names()
    if a.find("mimetype") and b"application/epub+zip" in a.read("mimetype")[:HEAD]:
        return "epub"
    if a.find("META-INF/container.xml"):
        return "epub"
    if any(n.lower().endswith(".fb2") for n in names):
        return "fb2zip"
    files = [n for n in names if not n.startswith("__MACOSX/") and not n.rsplit("/", 1)[-1].startswith(".") and n.lower() != "comicinfo.xml"]
    shown = sum(bool(re.search(r"\.(jpe?g|png|gif|bmp|webp)\Z", n, re.I)) for n in files)
    return "cbz" if shown and shown * 2 >= len(files) else "unknown"


def detect(data: bytes, name: str = "") -> str:
    """The format by content, then by name; a damaged archive is an error."""
    if len(data) >= 68 and data[60:68] in (b"BOOKMOBI", b"TEXtREAd"):
        return "mobi"
    if data[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
        return classify_archive(data)
    if b"<FictionBook" in data.removeprefix(b"\xef\xbb\xbf").lstrip(b" \t\r\n\f")[:HEAD]:
        return "fb2"
    low = name.lower()
    if low.endswith((".html", ".htm", ".xhtml")):
        return "html"
    return "text" if low.endswith(".txt") else "unknown"


def decode(data: bytes, path: str = "") -> dict:
    """The record of one book; ``path`` may be empty, then text is told by its lack of zero bytes."""
    kind = detect(data, path)
    if kind == "unknown" and not path and b"\0" not in data[:HEAD]:
        kind = "text"
    if kind == "unknown":
        raise ValueError("unsupported format")
    folder = os.path.dirname(path) if path.startswith("/") else None
    book = {"mobi": palm.decode, "epub": epub.decode, "cbz": comic.decode, "fb2": fictionbook.decode, "fb2zip": fictionbook.decode_zipped, "text": pages.decode_text, "html": lambda d: pages.decode_page(d, folder)}[kind](data)
    if not book["title"]:
        stem = os.path.basename(path)
        stem = stem[: -len(".fb2.zip")] if stem.lower().endswith(".fb2.zip") else os.path.splitext(stem)[0]
        book["title"] = stem or "Untitled"
    return book


BOOK = "path string, title string, authors array<string>, publisher string, description string, isbn string, published string, rights string, language string, subjects array<string>, asin string, format string, compression string, encoding string, file_size bigint, text_bytes int, html string, flows array<string>, cover_index int, n_resources int, paged boolean, error string, resources array<struct<idx:int,kind:string,data:binary>>"
_TEXTS = ("title", "publisher", "description", "isbn", "published", "rights", "language", "asin", "format", "compression", "encoding", "html")


def _kernel(with_data: bool):
    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            local = re.sub(r"\Afile:(?://)?", "", path or "")
            row = {"path": path, "file_size": len(content or b""), "error": None}
            try:
                got = decode(content or b"", local)
                row |= {k: got[k] for k in _TEXTS} | {"authors": got["authors"], "subjects": got["subjects"], "flows": got["flows"], "text_bytes": got["text_bytes"], "cover_index": got["cover"], "n_resources": len(got["resources"]), "paged": got["paged"]}
                row["resources"] = [{"idx": i, "kind": k, "data": d} for i, k, d in got["resources"]] if with_data else []
            except Exception as e:  # one bad file never stops the others
                row["error"] = f"{path}: {e}"
            rows.append(row)
        st = pa.list_(pa.struct([("idx", pa.int32()), ("kind", pa.string()), ("data", pa.binary())]))
        types = {"authors": pa.list_(pa.string()), "subjects": pa.list_(pa.string()), "flows": pa.list_(pa.string()), "file_size": pa.int64(), "text_bytes": pa.int32(), "cover_index": pa.int32(), "n_resources": pa.int32(), "paged": pa.bool_(), "resources": st}
        names = [x.split()[0] for x in re.sub(r"<[^ ]*>", "", BOOK).split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], types.get(n, pa.string())) for n in names], names=names)

    return kernel


def read_books(files: DataFrame, with_data: bool = True) -> DataFrame:
    """Books of ``files`` (path, content). Without resource bytes the rows stay small enough for any shuffle that follows."""
    files.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    out = arrow_map(files.select("path", "content"), _kernel(with_data), BOOK)
    return out if with_data else out.drop("resources")


def discover(spark: SparkSession, folder: str, recursive: bool = False, texts: bool = False) -> DataFrame:
    """The book files below a folder (path, content); texts only if asked for. Without ``recursive``, files of folders inside it are left out. Contents are read only where a plan uses them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/")
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    here = F.regexp_replace("path", r"/[^/]*\z", "")
    slashes = lambda c: F.regexp_replace(c, r"\A([a-z0-9]+:)/+", "$1/")
    keep = is_book_file(F.col("path")) if texts else is_book_file(F.col("path")) & ~is_text_file(F.col("path"))
    return df.where(keep if recursive else keep & (slashes(here) == slashes(F.lit(root)))).select("path", "content")
