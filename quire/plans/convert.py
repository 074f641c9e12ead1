"""From books to pages and files: flattening, layout and writing fused in one pass over each Arrow batch; failures are rows."""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import pdf
from quire.operators.flatten import flatten
from quire.operators.paginate import Options, paginate
from quire.plans.inspect import _FLAT_SQL
from quire.runtime import arrow_map, spread, table, tune
from quire.sources import images

RESULT = "book_id bigint, pages int, headings int, images int, dropped int, out_bytes bigint, error string"
PDFS = RESULT + ", title string, pdf binary"


def _kernel(options: Options, files: bool):
    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for r in b.to_pylist():
            row = {"book_id": r["book_id"], "title": r.get("title"), "error": None}
            try:
                blocks = flatten(r["html"], tuple(r["flows"] or ()))
                if not blocks:
                    raise ValueError("the book contains no readable text")
                pictures = {x["idx"]: x["data"] for x in r.get("resources") or [] if x["data"]}
                laid = paginate(blocks, options, r, pictures)
                row |= {"pages": len(laid.pages), "headings": laid.headings, "images": laid.images, "dropped": laid.dropped}
                if files:
                    row["pdf"] = pdf.write(laid, r.get("title") or "", pictures)
                    row["out_bytes"] = len(row["pdf"])
            except Exception as e:  # one bad book never stops the others
                row["error"] = str(e)
            out.append(row)
        names = ["book_id", "pages", "headings", "images", "dropped", "out_bytes", "error"] + (["title", "pdf"] if files else [])
        types = {"book_id": pa.int64(), "out_bytes": pa.int64(), "error": pa.string(), "title": pa.string(), "pdf": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([x.get(n) for x in out], types.get(n, pa.int32())) for n in names], names=names)

    return kernel


def convert(books: DataFrame, options: Options | None = None, files: bool = True) -> DataFrame:
    """Pages of every book of ``books`` (book_id, title, authors, publisher, published, html, flows, paged, cover_index and, if at hand, resources)."""
    cols = [c for c in ("book_id", "title", "authors", "publisher", "published", "html", "flows", "paged", "cover_index", "resources") if c in books.columns]
    return arrow_map(books.select(*cols), _kernel(options or Options(), files), PDFS if files else RESULT)


def write_pdfs(converted: DataFrame, folder: str) -> DataFrame:
    """Each file is written beside its place and moved there, so no reader meets half of one; repeated tasks write the same name again.

    ``folder`` must be shared by all executors. Returns (book_id, path, pages, out_bytes, error).
    """
    from quire.plans.naming import safe_name

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        os.makedirs(folder, exist_ok=True)
        rows = []
        for r in b.to_pylist():
            path = None
            if r["pdf"] is not None:
                path = os.path.join(folder, f"{safe_name(r['title'] or '')} [{r['book_id']}].pdf")
                part = f"{path}.{uuid.uuid4().hex}.part"
                with open(part, "wb") as f:
                    f.write(r["pdf"])
                os.replace(part, path)
            rows.append((r["book_id"], path, r["pages"], r["out_bytes"], r["error"]))
        cols = list(zip(*rows)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string()))], names=["book_id", "path", "pages", "out_bytes", "error"])

    return arrow_map(converted, kernel, "book_id bigint, path string, pages int, out_bytes bigint, error string")


def books(spark, d) -> DataFrame:
    return spread(table(spark, d, "books").select("book_id", "title", "authors", "publisher", "published", "html", "flows", "paged", "cover_index"))


def paginate_books(spark, d) -> DataFrame:
    """Page, heading and image counts of every book in the default layout."""
    tune(spark, 200)
    return convert(books(spark, d), files=False).drop("out_bytes")


def render_counts(spark, d) -> DataFrame:
    """What a run reports of every book beside its pages: headings in the outline, pictures placed and dropped, and the error of a book without text."""
    tune(spark, 200)
    return convert(books(spark, d), files=False).select("book_id", "headings", "images", "dropped", "error")


def compact_pages(spark, d) -> DataFrame:
    """Pages of every book in the default and in the compact layout, and their share; a book is flattened once and laid out twice in the same row."""
    from quire.plans.naming import options_for

    tune(spark, 200)
    kinds = [options_for("ereader"), options_for("compact")]

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, pages = [], ([], [])
        for r in b.to_pylist():
            ids.append(r["book_id"])
            blocks = flatten(r["html"], tuple(r["flows"] or ()))
            for out, o in zip(pages, kinds):
                out.append(len(paginate(blocks, o, r).pages) if blocks else None)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(p, pa.int32()) for p in pages)], names=["book_id", "pages_default", "pages_compact"])

    got = arrow_map(books(spark, d), kernel, "book_id bigint, pages_default int, pages_compact int")
    return got.select("*", F.round(F.try_divide("pages_compact", "pages_default"), 6).alias("share"))


def book_files(spark, d) -> DataFrame:
    """The size of every book's file; bytes are made in one pass and dropped after they are counted."""
    tune(spark, 100)
    return convert(books(spark, d)).select("book_id", "pages", (F.octet_length("pdf") > 0).alias("written"), "error")


def resource_pixels(spark, d) -> DataFrame:
    """Pixel sizes of resources as far as their first bytes tell them."""
    tune(spark)

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        got = [images.pixels(x) if x else None for x in b.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0] if g else None for g in got], pa.int64()), pa.array([g[1] if g else None for g in got], pa.int64())], names=["book_id", "idx", "width", "height"])

    return arrow_map(table(spark, d, "resources").select("book_id", "idx", "payload"), kernel, "book_id bigint, idx int, width bigint, height bigint")


QUERIES = {f.__name__: f for f in (paginate_books, render_counts, compact_pages, book_files, resource_pixels)}

# the tables hold the first 16 to 20 bytes of a resource: enough for the size of a GIF, and of a PNG where there are 24
ORACLES = {
    "render_counts": f"""with {_FLAT_SQL}, m as (select book_id, count(*) as total, count_if(kind = 'heading' and trim(text) <> '') as headings, count_if(kind = 'image') as dropped from k group by 1)
  select b.book_id, case when m.total > 0 then cast(m.headings as int) end as headings, case when m.total > 0 then cast(0 as int) end as images, case when m.total > 0 then cast(m.dropped as int) end as dropped,
    case when coalesce(m.total, 0) = 0 then 'the book contains no readable text' end as error from books b left join m on m.book_id = b.book_id""",
    "resource_pixels": """with r as (select book_id, idx, hex(payload) as h, octet_length(payload) as n from resources), w as (select *, case when n >= 10 and substr(h, 1, 6) = '474946' then 'gif' when n >= 24 and substr(h, 3, 6) = '504E47' then 'png' end as k from r)
  select book_id, idx, case k when 'gif' then cast('0x' || substr(h, 15, 2) || substr(h, 13, 2) as bigint) when 'png' then cast('0x' || substr(h, 33, 8) as bigint) end as width, case k when 'gif' then cast('0x' || substr(h, 19, 2) || substr(h, 17, 2) as bigint) when 'png' then cast('0x' || substr(h, 41, 8) as bigint) end as height from w""",
}
