"""Inspection of flattened books: counts by kind, outlines, first headings."""

from __future__ import annotations

from html.entities import name2codepoint

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.flatten import block_text, blocks, flatten
from quire.plans.corpus import _BOUNDS, _HCLASS, _HIDDEN, _IN, _PARAS
from quire.runtime import arrow_map, spread, table, tune


def book_blocks(spark, d) -> DataFrame:
    tune(spark, 500)
    return blocks(spread(table(spark, d, "books").select("book_id", "html", "flows")))


def blocks_flatten(spark, d) -> DataFrame:
    """The blocks of every book with kind, level, text and layout."""
    return book_blocks(spark, d).drop("spans")


def block_spans(spark, d) -> DataFrame:
    """The styled spans of every block, in order."""
    b = book_blocks(spark, d).select("book_id", "pos", F.posexplode("spans").alias("k", "s"))
    return b.select("book_id", "pos", (F.col("k") + 1).alias("span_no"), "s.text", "s.style", "s.link")


def probe_block_counts(spark, d) -> DataFrame:
    """What an inspection of each book shows: its record and its blocks by kind; lists, quotes and rules count in the total only.

    A row is one book, so the kernel counts inside the row and the record passes through it: nothing is shuffled, and no block leaves the worker.
    """
    tune(spark, 500)
    kinds = {"paragraph": "paragraphs", "heading": "headings", "image": "images", "page_break": "breaks"}

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        counts: dict[str, list[int]] = {k: [] for k in ("total", *kinds.values())}
        for markup, flows in zip(b.column("html").to_pylist(), b.column("flows").to_pylist()):
            got = [x["kind"] for x in flatten(markup, tuple(flows or ()))] if markup is not None else []
            counts["total"].append(len(got))
            for k, name in kinds.items():
                counts[name].append(got.count(k))
        kept = [n for n in b.schema.names if n not in ("html", "flows")]
        return pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), *(pa.array(v, pa.int64()) for v in counts.values())], names=[*kept, *counts])

    b = table(spark, d, "books").select("book_id", "title", "authors", "format_name", "encoding", "file_size", "text_bytes", "html", "flows")
    record = "book_id bigint, title string, authors array<string>, format_name string, encoding string, file_size bigint, text_bytes int"
    return arrow_map(spread(b), kernel, record + "".join(f", {c} bigint" for c in ("total", *kinds.values())))


def _headings(spark, d, most: int | None = None) -> DataFrame:
    """(book_id, pos, k, level, text) of the headings with text, at most ``most`` of each book; other blocks never leave the worker."""
    tune(spark, 500)

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        rows: tuple[list, ...] = ([], [], [], [], [])
        for book, markup, flows in zip(*(c.to_pylist() for c in b.columns)):
            k = 0
            for pos, x in enumerate(flatten(markup, tuple(flows or ())), 1):
                if x["kind"] == "heading" and (text := block_text(x)).strip(" ") and (most is None or k < most):
                    k += 1
                    for r, v in zip(rows, (book, pos, k, x["level"], text)):
                        r.append(v)
        return pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()))], names=["book_id", "pos", "k", "level", "text"])

    b = table(spark, d, "books").select("book_id", "html", "flows").where("html is not null")
    return arrow_map(spread(b), kernel, "book_id bigint, pos int, k int, level int, text string")


def outline_headings(spark, d) -> DataFrame:
    """Headings of every book in order, indented by level."""
    return _headings(spark, d).select("book_id", "pos", "level", F.concat(F.repeat(F.lit("  "), F.greatest(F.col("level") - 1, F.lit(0))), "text").alias("line"))


def outline_top12(spark, d) -> DataFrame:
    """The first twelve headings of each book."""
    return _headings(spark, d, 12).select("book_id", "k", "level", "text")


QUERIES = {f.__name__: f for f in (blocks_flatten, block_spans, probe_block_counts, outline_headings, outline_top12)}

# ---- the same by SQL: tokens between block boundaries are islands; stylesheets count as far as these tables' sheets go ------------------------------


def _unescaped(x: str) -> str:
    """SQL that replaces the named references of HTML 4, the one for the ampersand last."""
    for name, code in sorted(name2codepoint.items()):
        if name != "amp":
            x = f"replace({x}, '&{name};', chr({code}))"
    return f"replace({x}, '&amp;', '&')"


_FLAT_SQL = rf"""t as (select book_id, flows, regexp_extract_all(regexp_replace(html, '{_HIDDEN}', '', 'g'), '<[^>]*>|[^<]+') as toks
    from books where html is not null), e as (select book_id, flows, generate_subscripts(toks, 1) as nth, unnest(toks) as tok from t),
  n as (select *, lower(regexp_extract(tok, '^</?([A-Za-z][A-Za-z0-9:]*)', 1)) as name, starts_with(tok, '</') as closing from e), b as (select *, starts_with(tok, '<')
    and name in {_IN(_BOUNDS)} as bound from n),
  s as (select *, sum(case when bound then 1 else 0 end) over w as island, sum(case when name in ('ul', 'ol') then case when closing
    then -1 else 1 end else 0 end) over w as depth from b window w as (partition by book_id order by nth rows unbounded preceding)),
  h as (select book_id, island, any_value(flows) as flows, max(name) filter (where bound) as name, max(tok) filter (where bound) as tag,
    coalesce(bool_or(closing) filter (where bound), true) as closing, max(depth) filter (where bound) as depth,
    string_agg(case when starts_with(tok, '<') then case when name = 'br' then chr(10) else '' end else regexp_replace({_unescaped('tok')}, '[ \t\n\r\f\v]+', ' ', 'g') end, ''
    order by nth) as raw from s group by 1, 2),
  c as (select *, trim(regexp_replace(replace(regexp_replace(raw, ' {{2,}}', ' ', 'g'), chr(160), ' '), '^ +|[\s\x{{0085}}\p{{Z}}]+$', '', 'g'), ' ') as text,
    regexp_extract(coalesce(tag, ''), 'class="([^"]*)"', 1) as cls from h),
  f as (select *, case when closing then 'paragraph' when regexp_matches(name, '^h[1-6]$') then 'heading' when name in ('li', 'dt', 'dd')
    then 'list' when name = 'blockquote' then 'quote' when name in {_IN(_PARAS)} and regexp_matches(cls, '{_HCLASS}') then 'heading'
    else 'paragraph' end as kind from c),
  v as (select book_id, island, 0 as o, case name when 'hr' then 'rule' when 'mbp:pagebreak' then 'page_break' else 'image' end as kind, 0 as level,
    case when name in ('img', 'image') then 'center' else '' end as align, '' as text, cast(coalesce(nullif(regexp_extract(tag, 'recindex="(\d+)"', 1), ''), '0') as int) as resource,
    regexp_extract(tag, 'alt="([^"]*)"', 1) as alt, 0.0 as scale, 0.0 as margin_left, 0.0 as indent
    from f where not closing and name in ('hr', 'mbp:pagebreak', 'img', 'image') union all
    select book_id, island, 1, kind, case when kind = 'heading' then cast(coalesce(nullif(regexp_extract(name, '^h([1-6])$', 1), ''),
    regexp_extract(lower(cls), '(?:^|\s)h([1-6])', 1)) as int) when kind = 'list' then greatest(depth, 1) else 0 end,
    case when closing then '' when contains(lower(coalesce(regexp_extract(tag, 'align="([^"]*)"', 1), '') || cls), 'center') or (name in ('h1', 'h2')
    and list_contains(flows, 'h1,h2{{text-align:center}}')) then 'center' else '' end, replace(text, chr(10), ' '), 0, '',
    case when not closing and regexp_matches(cls, '(^|\s)note(\s|$)') and list_contains(flows, '.note{{font-size:small}}') then 0.85
    else 0.0 end, case when not closing and regexp_matches(cls, '(^|\s)verse(\s|$)') and list_contains(flows, '.verse{{margin-left:2em}}')
    then 2.0 else 0.0 end,
    case when not closing and name = 'p' and list_contains(flows, 'p{{margin:0;text-indent:1.2em}}') then 1.2 else 0.0 end from f where
    regexp_replace(raw, '[\s\x{{0085}}\p{{Z}}]+', '', 'g') <> '' and (name is null or closing or name not in ('hr', 'mbp:pagebreak', 'img', 'image'))
    union all
    select book_id, island, 1, 'paragraph', 0, '', replace(text, chr(10), ' '), 0, '', 0.0, 0.0, 0.0 from f where not closing and name in ('hr', 'mbp:pagebreak', 'img', 'image')
    and regexp_replace(raw, '[\s\x{{0085}}\p{{Z}}]+', '', 'g') <> ''),
  g as (select *, lag(kind) over (partition by book_id order by island, o) as before from v where kind <> 'image' or resource > 0),
    k as (select *, cast(row_number() over (partition by book_id order by island, o) as int) as pos from g where not (kind = 'page_break'
    and coalesce(before, '') = 'page_break'))"""

_COUNTS = ("total", "paragraphs", "headings", "images", "breaks")
ORACLES = {
    "blocks_flatten": f"with {_FLAT_SQL} select book_id, pos, kind, cast(level as int) as level, align, text, resource, alt, cast(scale as double) as scale, cast(margin_left as double) as margin_left, cast(indent as double) as indent, false as full_page, cast(0 as double) as page_width, cast(0 as double) as page_height from k",
    "probe_block_counts": f"with {_FLAT_SQL}, m as (select book_id, count(*) as total, count_if(kind = 'paragraph') as paragraphs, count_if(kind = 'heading') as headings, count_if(kind = 'image') as images, count_if(kind = 'page_break') as breaks from k group by 1) "
    f"select b.book_id, title, authors, format_name, encoding, file_size, text_bytes, {', '.join(f'cast(coalesce(m.{c}, 0) as bigint) as {c}' for c in _COUNTS)} from books b left join m on m.book_id = b.book_id",
    "outline_headings": f"with {_FLAT_SQL} select book_id, pos, cast(level as int) as level, repeat('  ', greatest(level - 1, 0)::bigint) || text as line from k where kind = 'heading' and trim(text) <> ''",
    "outline_top12": f"with {_FLAT_SQL}, q as (select *, cast(row_number() over (partition by book_id order by pos) as int) as n from k where kind = 'heading' and trim(text) <> '') select book_id, n as k, cast(level as int) as level, text from q where n <= 12",
}
