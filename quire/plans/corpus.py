"""Relational queries over the domain tables: discovery, detection, metadata, resources, naming, batch results and inspection.

Each query has its SQL beside it where SQL can express it on whole tables. Every choice among equal rows is made by a stated order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import layout as L
from quire.functions import scalars as S
from quire.runtime import ranked, table
from quire.sources.pages import END as _END, KEYWORD as _KEYWORD, ROMAN as _ROMAN, START as _START

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


# The blanks that are trimmed in SQL, as a character class of both engines.
B = r"[\s\x{0085}\p{Z}]+"
TRIM = lambda x: f"regexp_replace(regexp_replace({x}, '^{B}', ''), '{B}$', '')"
FIRST = lambda a: f"coalesce(list_filter(list_transform({a}, lambda v: {TRIM('v')}), lambda v: v <> '')[1], '')"
TEXTS = lambda a: f"list_filter(list_transform(coalesce({a}, []), lambda v: {TRIM('v')}), lambda v: v <> '')"


# ---- discovery and detection -------------------------------------------------------------------------------------------------


@query(r"""select book_id, regexp_matches(lower(file_path), '\.(azw3|azw|mobi|prc|epub|cbz|fb2|fb2\.zip|txt|html|htm|xhtml)$') as is_book,
  regexp_matches(lower(file_path), '\.(txt|html|htm|xhtml)$') as is_text, regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '(?i)(\.fb2\.zip|\.[^.]*)$', '') as stem from books""")
def file_names(spark, d) -> DataFrame:
    """Book and text suffixes, and the title that a file name stands in for."""
    p = F.col("file_path")
    return table(spark, d, "books").select("book_id", S.is_book_file(p).alias("is_book"), S.is_text_file(p).alias("is_text"), S.title_from_name(p).alias("stem"))


@query(r"""with b as (select folder_id, count(*) as n_books, sum(case when regexp_matches(lower(file_path), '\.(txt|html|htm|xhtml)$') then 1 else 0 end) as n_texts from books
  where regexp_matches(lower(file_path), '\.(azw3|azw|mobi|prc|epub|cbz|fb2|fb2\.zip|txt|html|htm|xhtml)$') group by 1)
  select f.folder_id, cast(coalesce(b.n_books, 0) as bigint) as n_books, cast(coalesce(b.n_texts, 0) as bigint) as n_texts from folders f left join b on b.folder_id = f.folder_id""")
def discover_books(spark, d) -> DataFrame:
    """The books that a scan of each folder finds, and how many of them only a scan that asks for texts would."""
    p = F.col("file_path")
    b = table(spark, d, "books").where(S.is_book_file(p)).groupBy("folder_id").agg(F.count(F.lit(1)).alias("n_books"), F.count_if(S.is_text_file(p)).alias("n_texts"))
    f = table(spark, d, "folders").select(F.col("folder_id").alias("f_id"))
    return f.join(b, F.col("f_id") == F.col("folder_id"), "left").select(F.col("f_id").alias("folder_id"), F.coalesce("n_books", F.lit(0)).alias("n_books"), F.coalesce("n_texts", F.lit(0)).alias("n_texts"))


@query("""select batch_id, book_id, cast(ord as int) as ord from (select batch_id, book_id, ord, row_number() over (partition by batch_id, book_id
    order by ord, conv_id, recorded_at) as k from conversions where book_id is not null) where k = 1""")
def collect_inputs(spark, d) -> DataFrame:
    """Each batch's inputs without repeats: of one book the first place in the batch wins."""
    w = Window.partitionBy("batch_id", "book_id").orderBy("ord", "conv_id", "recorded_at")
    c = table(spark, d, "conversions").where("book_id is not null").select("batch_id", "book_id", "ord", "conv_id", "recorded_at")
    return c.withColumn("k", F.row_number().over(w)).where("k = 1").select("batch_id", "book_id", "ord")


@query("""select book_id, idx, case when payload is null or octet_length(payload) < 8 then '' when substr(hex(payload), 1, 6) = 'FFD8FF'
    then 'jpeg' when substr(hex(payload), 3, 6) = '504E47' then 'png'
  when substr(hex(payload), 1, 6) = '474946' then 'gif' when substr(hex(payload), 1, 4) = '424D' then 'bmp' when octet_length(payload) >= 12
    and substr(hex(payload), 1, 8) = '52494646' and substr(hex(payload), 17, 8) = '57454250' then 'webp' else '' end as sniffed, coalesce(kind, '') <> '' as is_image
    from resources""")
def sniff_image(spark, d) -> DataFrame:
    """The image format of every resource by its first bytes."""
    return table(spark, d, "resources").select("book_id", "idx", S.sniff_image(F.col("payload")).alias("sniffed"), (F.coalesce("kind", F.lit("")) != "").alias("is_image"))


@query(r"""with t as (select doc_id, regexp_replace(replace(text, chr(65279), ''), '^[ \t\r\n\f]+', '') as s from documents where text is not null)
  select doc_id, case when contains(substr(s, 1, 4096), '<FictionBook') then 'fb2' when contains(s, chr(0)) then 'unknown' else 'text' end as detected from t""")
def detect_text(spark, d) -> DataFrame:
    """The format of texts without a name: a FictionBook root in the head, plain text, or unknown."""
    s = F.regexp_replace(F.replace("text", F.lit("﻿"), F.lit("")), r"\A[ \t\r\n\f]+", "")
    t = table(spark, d, "documents").where("text is not null").select("doc_id", s.alias("s"))
    return t.select("doc_id", F.when(F.contains(F.substring("s", 1, 4096), F.lit("<FictionBook")), "fb2").when(F.contains("s", F.lit("\0")), "unknown").otherwise("text").alias("detected"))


# ---- resources ---------------------------------------------------------------------------------------------------------------


@query("""with r as (select book_id, idx, kind, n_bytes, row_number() over (partition by book_id, idx order by kind nulls last, n_bytes) as k from resources),
  f as (select book_id, idx from r where k = 1 and coalesce(kind, '') <> '') select book_id, idx, cast(row_number() over (partition by book_id order by idx) as int) as image_no from f""")
def number_images(spark, d) -> DataFrame:
    """Images numbered densely in their order; of repeated resources the first counts, resources that are no images take no number."""
    w = Window.partitionBy("book_id", "idx").orderBy(F.asc_nulls_last("kind"), "n_bytes")
    f = table(spark, d, "resources").select("book_id", "idx", "kind", "n_bytes").withColumn("k", F.row_number().over(w)).where("k = 1 and coalesce(kind, '') <> ''")
    return f.select("book_id", "idx", F.row_number().over(Window.partitionBy("book_id").orderBy("idx")).alias("image_no"))


@query("""with r as (select distinct book_id, idx, n_bytes from resources) select book_id, idx, cast(sum(n_bytes) over (partition by book_id
    order by idx, n_bytes rows between unbounded preceding and current row) as bigint) as running,
  n_bytes > 268435456 as entry_over, sum(n_bytes) over (partition by book_id order by idx, n_bytes rows between unbounded preceding and current row) > 1073741824 as book_over from r""")
def archive_running_total(spark, d) -> DataFrame:
    """The running size of each archive and where a limit of one entry or of the book is passed."""
    w = Window.partitionBy("book_id").orderBy("idx", "n_bytes").rowsBetween(Window.unboundedPreceding, 0)
    r = table(spark, d, "resources").select("book_id", "idx", "n_bytes").distinct()
    t = F.sum("n_bytes").over(w)
    return r.select("book_id", "idx", t.alias("running"), (F.col("n_bytes") > 256 << 20).alias("entry_over"), (t > 1 << 30).alias("book_over"))


@query("""with i as (select book_id, min(idx) as first_image from resources where coalesce(kind, '') <> '' group by 1), c as (select distinct book_id, idx
    from resources where coalesce(kind, '') <> '')
  select b.book_id, cast(coalesce(c.idx, i.first_image) as int) as cover, case when c.idx is not null then 'declared' when i.first_image is not null then 'first image' else 'none' end as rule
  from books b left join c on c.book_id = b.book_id and c.idx = b.cover_index left join i on i.book_id = b.book_id""")
def cover_precedence(spark, d) -> DataFrame:
    """The cover: the declared resource if it is an image, else the first image."""
    img = table(spark, d, "resources").where("coalesce(kind, '') <> ''").select(F.col("book_id").alias("r_id"), "idx")
    first = img.groupBy("r_id").agg(F.min("idx").alias("first_image")).withColumnRenamed("r_id", "i_id")
    b = table(spark, d, "books").select("book_id", "cover_index")
    j = b.join(img.distinct(), (F.col("book_id") == F.col("r_id")) & (F.col("cover_index") == F.col("idx")), "left").join(first, F.col("book_id") == F.col("i_id"), "left")
    rule = F.when(F.col("idx").isNotNull(), "declared").when(F.col("first_image").isNotNull(), "first image").otherwise("none")
    return j.select("book_id", F.coalesce("idx", "first_image").alias("cover"), rule.alias("rule"))


# ---- metadata ----------------------------------------------------------------------------------------------------------------


@query(f"""select opf_id, {FIRST('titles')} as title, {TEXTS('creators')} as authors, {FIRST('publishers')} as publisher, {FIRST('dates')} as published, {FIRST('rights')} as rights, {FIRST('languages')} as language_tag, {TEXTS('subjects')} as subjects,
  coalesce(list_filter(list_transform(identifiers, lambda i: case when lower(substr({TRIM('coalesce(i.id_text, chr(32))')}, 1, 9)) = 'urn:isbn:'
    then {TRIM(f"substr({TRIM('i.id_text')}, 10)")} when lower({TRIM("coalesce(i.scheme, '')")}) = 'isbn' and {TRIM("coalesce(i.id_text, '')")} <> ''
    then {TRIM('i.id_text')} end), lambda v: v is not null)[1], '') as isbn,
  case when starts_with({TRIM("coalesce(opf_version, '')")}, '3') then 'EPUB 3' else 'EPUB 2' end as format_name from opf_metadata""")
def package_metadata(spark, d) -> DataFrame:
    """The record of a package: first texts of scalar fields, all texts of lists, the first identifier that is an ISBN."""
    c = F.col

    def isbn(i):
        v = S.trimmed(F.coalesce(i["id_text"], F.lit("")))
        return F.when(F.lower(F.substring(v, 1, 9)) == "urn:isbn:", S.trimmed(F.substring(v, 10, 1 << 30))).when((F.lower(S.trimmed(F.coalesce(i["scheme"], F.lit("")))) == "isbn") & (v != ""), v)

    ids = F.filter(F.transform("identifiers", isbn), lambda v: v.isNotNull())
    return table(spark, d, "opf_metadata").select(
        "opf_id", S.first_text(c("titles")).alias("title"), S.texts(c("creators")).alias("authors"), S.first_text(c("publishers")).alias("publisher"), S.first_text(c("dates")).alias("published"), S.first_text(c("rights")).alias("rights"), S.first_text(c("languages")).alias("language_tag"), S.texts(c("subjects")).alias("subjects"),
        F.coalesce(F.get(ids, F.lit(0)), F.lit("")).alias("isbn"), F.when(S.trimmed(F.coalesce("opf_version", F.lit(""))).startswith("3"), "EPUB 3").otherwise("EPUB 2").alias("format_name"),
    )


@query(f"""with t as (select comic_id, {TRIM("coalesce(title, '')")} as t, {TRIM("coalesce(series, '')")} as s, {TRIM("coalesce(issue_number, '')")} as n, {TRIM("coalesce(issue_year, '')")} as y, {TRIM("coalesce(issue_month, '')")} as m, writer, genre, {TRIM("coalesce(publisher, '')")} as publisher, {TRIM("coalesce(language_iso, '')")} as language_tag
    from comic_info)
  select comic_id, case when t <> '' then t when s <> '' then s || case when n <> '' then ' #' || n else '' end else '' end as title, {TEXTS("string_split(coalesce(writer, ''), ',')")} as authors, {TEXTS("string_split(coalesce(genre, ''), ',')")} as subjects,
  case when y = '' then '' when m = '' then y else y || '-' || case when octet_length(encode(m)) = 1 then '0' || m else m end end as published, publisher, language_tag from t""")
def comic_metadata(spark, d) -> DataFrame:
    """The record of a comic: title or series with number, comma lists, year with month padded to two digits."""
    x = {n: S.trimmed(F.coalesce(n, F.lit(""))) for n in ("title", "series", "issue_number", "issue_year", "issue_month", "publisher", "language_iso")}
    no = F.when(x["issue_number"] != "", F.concat(F.lit(" #"), x["issue_number"])).otherwise("")
    month = F.when(F.octet_length(x["issue_month"]) == 1, F.concat(F.lit("0"), x["issue_month"])).otherwise(x["issue_month"])
    date = F.when(x["issue_year"] == "", "").when(x["issue_month"] == "", x["issue_year"]).otherwise(F.concat_ws("-", x["issue_year"], month))
    return table(spark, d, "comic_info").select(
        "comic_id", F.when(x["title"] != "", x["title"]).when(x["series"] != "", F.concat(x["series"], no)).otherwise("").alias("title"), S.split_list(F.col("writer")).alias("authors"), S.split_list(F.col("genre")).alias("subjects"), date.alias("published"), x["publisher"].alias("publisher"), x["language_iso"].alias("language_tag"),
    )


@query(r"""select book_id, regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g'), '^ | $', '', 'g') as page_title, lower(regexp_extract(html, '(?is)<html[^>]*\slang="([^"]*)"', 1)) as page_lang,
    cast(len(regexp_extract_all(html, '(?i)<img\b')) as int) as n_images from books where html is not null""")
def html_metadata(spark, d) -> DataFrame:
    """Title, language and number of image references of a page."""
    h = F.col("html")
    title = F.regexp_replace(F.regexp_replace(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "), "^ | $", "")
    return table(spark, d, "books").where("html is not null").select("book_id", title.alias("page_title"), F.lower(F.regexp_extract(h, r'(?is)<html[^>]*\slang="([^"]*)"', 1)).alias("page_lang"), F.size(F.regexp_extract_all(h, F.lit(r"(?i)<img\b"), F.lit(0))).alias("n_images"))


@query("""with s as (select book_id, lower(trim(s)) as subject from (select book_id, unnest(subjects) as s from books) where trim(s) <> '')
    select book_id, bool_or(subject = 'history') as has_history, cast(count(distinct subject) as bigint) as n_subjects from s group by 1""")
def property_membership(spark, d) -> DataFrame:
    """Membership of a value in a list field, and the number of distinct values, blanks ignored."""
    s = table(spark, d, "books").select("book_id", F.explode("subjects").alias("s")).where("trim(s) <> ''").select("book_id", F.lower(F.trim("s")).alias("subject"))
    return s.groupBy("book_id").agg(F.bool_or(F.col("subject") == "history").alias("has_history"), F.count_distinct("subject").alias("n_subjects"))


@query("""select opf_id, len(list_filter(coalesce(identifiers, []), lambda i: coalesce(i.scheme, '') not in ('ISBN', 'isbn', 'uuid', ''))) > 0 as refused from opf_metadata""")
def allow_list(spark, d) -> DataFrame:
    """Refusal by an allow-list: any identifier whose scheme is not on it."""
    ok = F.array(*[F.lit(x) for x in ("ISBN", "isbn", "uuid", "")])
    return table(spark, d, "opf_metadata").select("opf_id", F.exists(F.coalesce("identifiers", F.array().cast("array<struct<scheme:string,id_text:string>>")), lambda i: ~F.array_contains(ok, F.coalesce(i["scheme"], F.lit("")))).alias("refused"))


@query("""with k as (select book_id, folder_id, file_path, array_to_string(list_transform(regexp_extract_all(lower(regexp_extract(file_path, '([^/]*)$', 1)), '\\d+|\\D'), lambda t:
    case when regexp_matches(t, '^\\d') then '0' || lpad(cast(length(regexp_replace(t, '^0+(\\d)', '\\1')) as varchar), 9, '0') || regexp_replace(t, '^0+(\\d)', '\\1')
    else t end), '') as key from books)
  select book_id, cast(row_number() over (partition by folder_id order by key, file_path, book_id) as int) as place from k""")
def natural_order(spark, d) -> DataFrame:
    """The files of each folder in natural order: digit runs by value, then by the raw name."""
    k = table(spark, d, "books").select("book_id", "folder_id", "file_path", S.natural_key(S.base_name(F.col("file_path"))).alias("key"))
    return ranked(k, "folder_id", ["key", "file_path", "book_id"], "place").select("book_id", "place")


# ---- options -----------------------------------------------------------------------------------------------------------------

# Presets in display order with page, margin in mm, font, size, spacing, flags (justify, title page, numbers, header, own page).
PRESETS = [
    ("ereader", "a5", 14.0, "serif", 11.0, 1.38, True, True, True, False, False), ("paperback", "trade", 18.0, "serif", 11.5, 1.42, True, True, True, True, True), ("print", "letter", 22.0, "serif", 11.5, 1.45, True, True, True, True, False), ("a4", "a4", 20.0, "serif", 11.5, 1.45, True, True, True, True, True),
    ("compact", "a5", 9.0, "serif", 9.5, 1.22, True, False, True, False, False), ("large-print", "a4", 18.0, "sans", 16.0, 1.6, False, True, True, False, False), ("phone", "kindle", 7.0, "sans", 10.0, 1.35, False, False, False, False, True), ("manuscript", "letter", 25.0, "sans", 12.0, 2.0, False, True, True, False, False),
]
PRESET_SCHEMA = "preset_key string, page string, margin_mm double, font string, size double, spacing double, justify_on boolean, title_page boolean, page_numbers boolean, running_header boolean, own_page boolean"


def presets(spark) -> DataFrame:
    """The built-in presets with their display order; a dimension of eight rows."""
    return spark.createDataFrame([(*p, i + 1) for i, p in enumerate(PRESETS)], PRESET_SCHEMA + ", display_ord int")


def page_sizes(spark) -> DataFrame:
    """The named page sizes, sorted by name."""
    return spark.createDataFrame([(k, *L.PAGE_SIZES[k]) for k in sorted(L.PAGE_SIZES)], "page string, label string, width double, height double")


_PAGE_SQL = "(values " + ", ".join(f"('{k}', '{v[0]}', cast({v[1]} as double), cast({v[2]} as double))" for k, v in sorted(L.PAGE_SIZES.items())) + ") as s(page, label, width, height)"
_PRESET_SQL = "(values " + ", ".join(f"('{p[0]}', '{p[1]}', cast({p[2]} as double), '{p[3]}', cast({p[4]} as double), cast({p[5]} as double), {p[6]}, {p[7]}, {p[8]}, {p[9]}, {p[10]}, {i + 1})" for i, p in enumerate(PRESETS)) + ") as p(preset_key, page, margin_mm, font, size, spacing, justify_on, title_page, page_numbers, running_header, own_page, display_ord)"


@query(f"select page, label, width, height from {_PAGE_SQL}")
def page_size_table(spark, d) -> DataFrame:
    return page_sizes(spark)


@query(f"""select p.preset_key, p.display_ord, s.label || ' · ' || p.font || ' ' || printf('%.1f', p.size) || 'pt · ' || cast(cast(p.margin_mm as int) as varchar) || 'mm margins · ' ||
    case when p.justify_on then 'justified' else 'ragged right' end as summary
  from {_PRESET_SQL} join {_PAGE_SQL} on s.page = case when p.own_page then p.page else 'letter' end""")
def preset_summary(spark, d) -> DataFrame:
    """One line about each preset, with the page it uses where none is saved."""
    p, s = presets(spark), page_sizes(spark).withColumnRenamed("page", "s_page")
    text = F.concat(F.col("label"), F.lit(" · "), F.col("font"), F.lit(" "), F.format_string("%.1f", F.col("size")), F.lit("pt · "), F.col("margin_mm").cast("int").cast("string"), F.lit("mm margins · "), F.when(F.col("justify_on"), "justified").otherwise("ragged right"))
    return p.join(F.broadcast(s), F.col("s_page") == F.when(F.col("own_page"), F.col("page")).otherwise("letter")).select("preset_key", "display_ord", text.alias("summary"))


@query("""with i as (select book_id, count(*) as n from (select distinct book_id, idx from resources where coalesce(kind, '') <> '') group by 1)
  select b.book_id, case when coalesce(i.n, 0) >= 40 then 'print' when coalesce(b.text_bytes, 0) > 1500000 then 'compact' when coalesce(i.n, 0) >= 8
    then 'paperback' else 'ereader' end as recommended from books b left join i on i.book_id = b.book_id""")
def preset_recommend(spark, d) -> DataFrame:
    """The preset that suits a book by its images and its amount of text."""
    i = table(spark, d, "resources").where("coalesce(kind, '') <> ''").select("book_id", "idx").distinct().groupBy("book_id").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("book_id", "i_id")
    b = table(spark, d, "books").select("book_id", "text_bytes").join(i, F.col("book_id") == F.col("i_id"), "left")
    n, t = F.coalesce("n", F.lit(0)), F.coalesce("text_bytes", F.lit(0))
    return b.select("book_id", F.when(n >= 40, "print").when(t > 1_500_000, "compact").when(n >= 8, "paperback").otherwise("ereader").alias("recommended"))


@query(f"""with o as (select c.conv_id, c.recorded_at, c.ord, coalesce(p.preset_key, 'ereader') as preset, coalesce(p.own_page, false) as own_page,
    coalesce(p.page, 'a5') as own, q.page_w as cfg_w, q.page_h as cfg_h, case when c.ord % 5 = 0 then cast(c.ord as double) * 3 end as flag_size,
    coalesce(q.font_size, cast(null as double)) as cfg_size, coalesce(p.size, cast(11 as double)) as size, coalesce(p.margin_mm, cast(14 as double)) as mm,
    coalesce(p.spacing, cast(1.38 as double)) as spacing, q.justify as cfg_justify, coalesce(p.justify_on, true) as justify_on
    from conversions c left join {_PRESET_SQL} on p.preset_key = c.preset_key left join presets q on q.preset_key = c.preset_key),
  e as (select *, coalesce(cfg_w, case when own_page then (select width from {_PAGE_SQL} where s.page = own) else cast(612 as double) end) as w,
    coalesce(cfg_h, case when own_page then (select height from {_PAGE_SQL} where s.page = own) else cast(792 as double) end) as h from o)
  select conv_id, recorded_at, ord, preset, w as page_w, h as page_h, least(greatest(coalesce(flag_size, cfg_size, size), cast(5 as double)),
    cast(40 as double)) as font_size, least(greatest(spacing, cast(1 as double)), cast(3 as double)) as line_spacing,
    coalesce(cfg_justify, justify_on) as justify, round(least(greatest(mm * cast(72 as double) / cast(25.4 as double), cast(0 as double)), w / 2 - 20), 6) as margin_side from e""")
def options_layering(spark, d) -> DataFrame:
    """The options of every conversion: preset, then the saved configuration, then flags (here: a size on each fifth place), then clamped once."""
    c = table(spark, d, "conversions").select("conv_id", "recorded_at", "ord", "preset_key")
    p = presets(spark).drop("display_ord").withColumnRenamed("preset_key", "p_key")
    q = table(spark, d, "presets").select(F.col("preset_key").alias("q_key"), F.col("page_w").alias("cfg_w"), F.col("page_h").alias("cfg_h"), F.col("font_size").alias("cfg_size"), F.col("justify").alias("cfg_justify"))
    j = c.join(F.broadcast(p), F.col("preset_key") == F.col("p_key"), "left").join(F.broadcast(q), F.col("preset_key") == F.col("q_key"), "left")
    own = F.when(F.col("own_page"), F.col("page")).otherwise("letter")
    w, h = (F.coalesce(cfg, L.page_size(own, k)) for cfg, k in (("cfg_w", 0), ("cfg_h", 1)))
    w = F.coalesce(F.col("cfg_w"), L.page_size(own, 0))
    h = F.coalesce(F.col("cfg_h"), L.page_size(own, 1))
    flag = F.when(F.col("ord") % 5 == 0, F.col("ord").cast("double") * 3)
    mm = F.coalesce("margin_mm", F.lit(14.0))
    return j.select(
        "conv_id", "recorded_at", "ord", F.coalesce("p_key", F.lit("ereader")).alias("preset"), w.alias("page_w"), h.alias("page_h"), L.clamp(F.coalesce(flag, F.col("cfg_size"), F.col("size"), F.lit(11.0)), F.lit(5.0), F.lit(40.0)).alias("font_size"), L.clamp(F.coalesce("spacing", F.lit(1.38)), F.lit(1.0), F.lit(3.0)).alias("line_spacing"),
        F.coalesce("cfg_justify", "justify_on", F.lit(True)).alias("justify"), F.round(L.clamp(L.margin_points(mm), F.lit(0.0), w / 2 - 20), 6).alias("margin_side"),
    )


@query("""select preset_key, cast(trunc((page_w - 2 * cast(15 as double) * 72 / cast(25.4 as double)) / (font_size * cast(0.5 as double))) as int) as chars_per_line from presets""")
def chars_per_line(spark, d) -> DataFrame:
    """Characters that fit on a line of each saved preset with the standard margins."""
    return table(spark, d, "presets").select("preset_key", ((F.col("page_w") - 2 * F.lit(15.0) * 72 / F.lit(25.4)) / (F.col("font_size") * 0.5)).cast("int").alias("chars_per_line"))


_SCALE_SQL = "case when css > 0 then least(case when least(greatest(css, cast(0.5 as double)), cast(3.5 as double)) > 1 then 1 + (least(greatest(css, cast(0.5 as double)), cast(3.5 as double)) - 1) * cast(0.62 as double) else least(greatest(css, cast(0.5 as double)), cast(3.5 as double)) end, cast(2.4 as double)) else cast(1 as double) end"


@query(f"""with g as (select l_orderkey, l_linenumber, l_quantity / 10 as css, l_quantity, l_extendedprice, case when l_linenumber % 2 = 0
    then 'heading' else 'paragraph' end as kind, cast(l_linenumber as int) as level from lineitem),
  s as (select *, {_SCALE_SQL} as shown, [cast(1.75 as double), 1.45, 1.28, 1.15, 1.06, 1.0][case when level between 1 and 6 then level else 3 end] as floor_scale from g)
  select l_orderkey, l_linenumber, l_quantity, l_extendedprice, round(case when kind = 'heading' then case when css > 0 then greatest(shown, floor_scale)
    else floor_scale end else shown end, 9) as scale from s""")
def effective_scale(spark, d) -> DataFrame:
    """Effective scales over a grid of sizes, kinds and levels taken from numeric rows."""
    g = table(spark, d, "lineitem")
    kind = F.when(F.col("l_linenumber") % 2 == 0, "heading").otherwise("paragraph")
    return g.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", F.round(L.effective_scale(F.col("l_quantity") / 10, kind, F.col("l_linenumber").cast("int")), 9).alias("scale"))


# ---- batches and reports -----------------------------------------------------------------------------------------------------


@query("""select batch_id, cast(count_if(outcome = 'converted') as bigint) as converted, cast(count_if(outcome = 'skipped') as bigint) as skipped,
    cast(count_if(outcome = 'failed') as bigint) as failed, cast(sum(case when outcome = 'converted' then pages end) as bigint) as pages,
    cast(sum(case when outcome = 'converted' then out_bytes end) as bigint) as out_bytes, bool_or(outcome = 'failed') as any_failed
  from (select distinct * from conversions) group by 1""")
def batch_tally(spark, d) -> DataFrame:
    """Outcomes of each batch, with pages and bytes of the converted books; exact repeats of a result count once."""
    c = table(spark, d, "conversions").distinct()
    one = lambda o: F.count_if(F.col("outcome") == o)
    done = lambda x: F.sum(F.when(F.col("outcome") == "converted", F.col(x)))
    return c.groupBy("batch_id").agg(one("converted").alias("converted"), one("skipped").alias("skipped"), one("failed").alias("failed"), done("pages").alias("pages"), done("out_bytes").alias("out_bytes"), F.bool_or(F.col("outcome") == "failed").alias("any_failed"))


@query("""select conv_id, ord, recorded_at, round(case when coalesce(in_bytes, 0) = 0 then cast(0 as double) else cast(out_bytes as double) / in_bytes end, 9) as ratio,
    case when elapsed_ms is null then null when elapsed_ms <= 0 then '--' when elapsed_ms < 1000 then cast(elapsed_ms as varchar) || 'ms'
  when elapsed_ms < 60000 then printf('%.1f', round_even(elapsed_ms / cast(1000 as double), 1)) || 's' else cast(elapsed_ms // 60000 as varchar) || 'm ' || lpad(cast((elapsed_ms // 1000) % 60 as varchar), 2, '0') || 's' end as took
    from conversions where outcome = 'converted'""")
def conversion_report(spark, d) -> DataFrame:
    """Size ratio and time of each converted book, as they are shown."""
    c = table(spark, d, "conversions").where("outcome = 'converted'")
    ratio = F.when(F.coalesce("in_bytes", F.lit(0)) == 0, F.lit(0.0)).otherwise(F.col("out_bytes").cast("double") / F.col("in_bytes"))
    return c.select("conv_id", "ord", "recorded_at", F.round(ratio, 9).alias("ratio"), F.when(F.col("elapsed_ms").isNotNull(), S.format_duration(F.col("elapsed_ms"))).alias("took"))


@query("""select book_id, case when file_size >= 1073741824 then printf('%.2f', round_even(file_size / cast(1073741824 as double), 2)) || ' GB'
    when file_size >= 1048576 then printf('%.1f', round_even(file_size / cast(1048576 as double), 1)) || ' MB'
  when file_size >= 1024 then cast(cast(round_even(file_size / cast(1024 as double), 0) as bigint) as varchar) || ' KB' else cast(file_size as varchar) || ' B' end as shown
    from books where file_size is not null""")
def format_bytes(spark, d) -> DataFrame:
    """File sizes as they are shown."""
    return table(spark, d, "books").where("file_size is not null").select("book_id", S.format_bytes(F.col("file_size")).alias("shown"))


_CLEAN_SQL = r"""regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(x, ':', ' -'), '*', ''), '?', ''), '"', ''''), '<', '('), '>', ')'), '|', '-'), '\', '-'), '/', '-'), '^[\s\x{0085}\p{Z}.]+|[\s\x{0085}\p{Z}.]+$', '', 'g')"""


@query(f"""with t as (select book_id, folder_id, regexp_replace(coalesce(title, ''), '[\\r\\n\\t]+', ' ', 'g') as x from books), c as (select book_id, folder_id, {_CLEAN_SQL} as n
    from t), n as (select book_id, folder_id, case when n = '' then 'book' else n end as base from c),
  k as (select *, row_number() over (partition by folder_id, base order by book_id) as i from n) select book_id, base, case when i = 1
    then base || '.pdf' when i < 1000 then base || ' (' || cast(i as varchar) || ').pdf' else base || '.pdf' end as output_name from k""")
def output_names(spark, d) -> DataFrame:
    """Output names from titles: signs that file systems refuse are replaced, and equal names in one folder are numbered in the order of ids. Names are not cut here;
    the cut at 150 bytes is ``quire.plans.naming.safe_name``."""
    x = F.regexp_replace(F.coalesce("title", F.lit("")), r"[\r\n\t]+", " ")
    for a, b in ((":", " -"), ("*", ""), ("?", ""), ('"', "'"), ("<", "("), (">", ")"), ("|", "-"), ("\\", "-"), ("/", "-")):
        x = F.replace(x, F.lit(a), F.lit(b))
    n = F.regexp_replace(x, r"\A[\s\u0085\p{Z}.]+|[\s\u0085\p{Z}.]+\z", "")
    t = table(spark, d, "books").select("book_id", "folder_id", F.when(n == "", "book").otherwise(n).alias("base"))
    k = t.withColumn("i", F.row_number().over(Window.partitionBy("folder_id", "base").orderBy("book_id")))
    no = F.when((F.col("i") > 1) & (F.col("i") < 1000), F.concat(F.lit(" ("), F.col("i").cast("string"), F.lit(")"))).otherwise("")
    return k.select("book_id", "base", F.concat("base", no, F.lit(".pdf")).alias("output_name"))


@query("""select book_id, case when coalesce(len(authors), 0) = 0 then 'Unknown author' else array_to_string(authors, ', ') end as author_line,
    case when length(title) <= 40 then title else substr(title, 1, 39) || '…' end as short_title, regexp_replace(title, '[^\\x20-\\x7e]', '.', 'g') as printable
    from books""")
def display_lines(spark, d) -> DataFrame:
    """Author lines, titles of at most forty characters, and titles in printable characters."""
    return table(spark, d, "books").select("book_id", S.author_line(F.col("authors")).alias("author_line"), S.ellipsis(F.col("title"), 40).alias("short_title"), S.printable(F.col("title")).alias("printable"))


@query("""select folder_id, count(*) as n_books, cast(count_if(coalesce(error_text, '') <> '') as bigint) as n_errors, cast(sum(case
    when coalesce(error_text, '') = '' then file_size end) as bigint) as readable_bytes from books group by 1""")
def batch_queue(spark, d) -> DataFrame:
    """What a batch over each folder would meet: books, unreadable ones, bytes of the readable ones."""
    bad = F.coalesce("error_text", F.lit("")) != ""
    return table(spark, d, "books").groupBy("folder_id").agg(F.count(F.lit(1)).alias("n_books"), F.count_if(bad).alias("n_errors"), F.sum(F.when(~bad, F.col("file_size"))).alias("readable_bytes"))


@query("""with c as (select batch_id, ord, conv_id, recorded_at, outcome, lag(outcome) over (partition by batch_id order by ord, conv_id, recorded_at) as before
    from (select distinct * from conversions)) select batch_id, ord, conv_id, recorded_at, outcome from c where before is null or before <> outcome""")
def collapse_runs(spark, d) -> DataFrame:
    """Consecutive results of one outcome collapse into their first, as consecutive page breaks do."""
    w = Window.partitionBy("batch_id").orderBy("ord", "conv_id", "recorded_at")
    c = table(spark, d, "conversions").distinct().withColumn("before", F.lag("outcome").over(w))
    return c.where("before is null or before <> outcome").select("batch_id", "ord", "conv_id", "recorded_at", "outcome")


@query("""with c as (select distinct batch_id, ord, conv_id, recorded_at, pages from conversions) select batch_id, ord, conv_id, recorded_at,
    coalesce(last_value(pages ignore nulls) over (partition by batch_id order by ord, conv_id, recorded_at rows between unbounded preceding
    and current row),
  first_value(pages ignore nulls) over (partition by batch_id order by ord, conv_id, recorded_at rows between current row and unbounded following), 600) as filled from c""")
def fill_forward(spark, d) -> DataFrame:
    """Missing measures take the last known one, else the first later one, else a default, as page sizes do."""
    w = Window.partitionBy("batch_id").orderBy("ord", "conv_id", "recorded_at")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    c = table(spark, d, "conversions").select("batch_id", "ord", "conv_id", "recorded_at", "pages").distinct()
    return c.select("batch_id", "ord", "conv_id", "recorded_at", F.coalesce(F.last("pages", ignorenulls=True).over(back), F.first("pages", ignorenulls=True).over(ahead), F.lit(600)).alias("filled"))


# ---- plain text --------------------------------------------------------------------------------------------------------------

#: For an engine without look-ahead.
_KEYWORD_SQL = _KEYWORD.replace("(?![0-9A-Za-z_])", r"\b")


def unified_lines(text):
    """One kind of line break, and no byte order mark."""
    return F.replace(F.replace(F.regexp_replace(text, r"\A﻿", ""), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def gutenberg_body(text):
    """The text between the frame lines, or all of it where there is no start line."""
    after = F.regexp_replace(text, r"(?s)\A.*?" + _START.replace("(?im)", r"(?-s:(?im)") + ")", "")
    body = F.when(text.rlike(_START), after).otherwise(text)
    return F.when(text.rlike(_START), F.get(F.split(body, _END, 2), F.lit(0))).otherwise(text)


_LINES_SQL = "replace(replace(regexp_replace(text, '^\\x{FEFF}', ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
_BODY_SQL = f"""case when regexp_matches(t, '{_START}') then regexp_split_to_array(regexp_replace(t, '(?s)^.*?' || '(?im:^)\\*\\*\\* *(?i:START OF TH(?:E|IS) PROJECT GUTENBERG EBOOK)[^\\n]*', ''), '{_END}')[1] else t end"""


@query(f"""with l as (select doc_id, {_LINES_SQL} as t from documents where text is not null), b as (select doc_id, t, {_BODY_SQL} as body from l)
  select doc_id, coalesce(trim(regexp_extract(case when regexp_matches(t, '{_START}') then t else '' end, '(?im)^Title: *([^\\n]+)$', 1)), '') as title,
    coalesce(trim(regexp_extract(case when regexp_matches(t, '{_START}') then t else '' end, '(?im)^Author: *([^\\n]+)$', 1)), '') as author,
    cast(octet_length(encode(body)) as int) as text_bytes from b""")
def gutenberg_trim(spark, d) -> DataFrame:
    """Title, author and body size of framed texts; unframed texts are their own body."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", unified_lines(F.col("text")).alias("t")).withColumn("body", gutenberg_body(F.col("t")))
    head = F.when(F.col("t").rlike(_START), F.col("t")).otherwise("")
    field = lambda n: F.trim(F.regexp_extract(head, rf"(?im)^{n}: *([^\n]+)$", 1))
    return t.select("doc_id", field("Title").alias("title"), field("Author").alias("author"), F.octet_length("body").alias("text_bytes"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, para_no, n_lines, text): paragraphs of each text, built inside its row; blank lines separate, lines are trimmed and joined."""
    body = gutenberg_body(unified_lines(F.col("text")))
    lines = F.transform(F.split(body, "\n"), S.trimmed)
    blocks = F.filter(F.split(F.array_join(lines, "\n"), r"\n{2,}"), lambda p: F.regexp_replace(p, "\n", "") != "")
    one = docs.where("text is not null").select("doc_id", F.posexplode(blocks).alias("p", "block"))
    clean = F.regexp_replace("block", r"\A\n+|\n+\z", "")
    return one.select("doc_id", (F.col("p") + 1).alias("para_no"), F.size(F.split(clean, "\n")).alias("n_lines"), F.replace(clean, F.lit("\n"), F.lit(" ")).alias("text"))


_PARA_SQL = f"""with l as (select doc_id, {_LINES_SQL} as t from documents where text is not null), b as (select doc_id, {_BODY_SQL} as body from l),
  j as (select doc_id, array_to_string(list_transform(string_split(body, chr(10)), lambda v: {TRIM('v')}), chr(10)) as s from b), p as (select doc_id, list_filter(regexp_split_to_array(s, '\\n{{2,}}'), lambda x:
    replace(x, chr(10), '') <> '') as ps from j),
  e as (select doc_id, generate_subscripts(ps, 1) as para_no, unnest(ps) as block from p), c as (select doc_id, cast(para_no as int) as para_no,
    regexp_replace(block, '^\\n+|\\n+$', '', 'g') as k from e)"""


@query(f"{_PARA_SQL} select doc_id, para_no, cast(len(string_split(k, chr(10))) as int) as n_lines, replace(k, chr(10), ' ') as text from c")
def text_paragraphs(spark, d) -> DataFrame:
    """Every paragraph of every text."""
    return paragraphs(table(spark, d, "documents").select("doc_id", "text"))


@query(f"""{_PARA_SQL}, o as (select doc_id, para_no, replace(k, chr(10), ' ') as line from c where len(string_split(k, chr(10))) = 1), r as (select *, regexp_replace(line, '\\.$', '') as bare from o)
  select doc_id, para_no, line from r where length(line) <= 60 and ((bare <> '' and octet_length(encode(bare)) <= 7 and lower(bare) <> 'i'
    and regexp_matches(bare, '{_ROMAN}')) or (not regexp_matches(line, '[.,;:]$') and regexp_matches(line, '{_KEYWORD_SQL}')))""")
def text_headings(spark, d) -> DataFrame:
    """Paragraphs of one line that are chapter headings: a lone numeral or a chapter word with at most a number and a short title."""
    p = paragraphs(table(spark, d, "documents").select("doc_id", "text")).where("n_lines = 1")
    line, bare = F.col("text"), F.regexp_replace("text", r"\.\z", "")
    z = lambda r: r.replace("$", r"\z")
    numeral = (bare != "") & (F.octet_length(bare) <= 7) & (F.lower(bare) != "i") & bare.rlike(z(_ROMAN))
    return p.where((F.char_length(line) <= 60) & (numeral | (~line.rlike(r"[.,;:]\z") & line.rlike(z(_KEYWORD))))).select("doc_id", "para_no", line.alias("line"))


# ---- markup ------------------------------------------------------------------------------------------------------------------


@query(r"""with t as (select book_id, unnest(regexp_extract_all(html, '<[A-Za-z][^>]*>')) as tag from books where html is not null),
    n as (select book_id, lower(regexp_extract(tag, '^<([A-Za-z][A-Za-z0-9:]*)', 1)) as name, tag from t)
  select name, case when regexp_matches(name, '^h[1-6]$') then 'heading' when name in ('li', 'dt', 'dd') then 'list' when name = 'blockquote'
    then 'quote' when name in ('p', 'div', 'section', 'article', 'center', 'tr', 'td', 'th', 'table', 'ul', 'ol', 'dl', 'pre', 'figure', 'figcaption', 'aside', 'header', 'footer')
  then case when regexp_matches(regexp_extract(tag, 'class="([^"]*)"', 1), '(?i)(^|\s)h[1-6](?:[^0-9A-Za-z_]|[_]|$)') then 'heading'
    else 'paragraph' end else 'inline' end as kind, count(*) as n, count(distinct book_id) as n_books from n group by 1, 2""")
def block_kinds(spark, d) -> DataFrame:
    """What kind of block each opening tag starts, by tag and class."""
    t = table(spark, d, "books").where("html is not null").select("book_id", F.explode(F.regexp_extract_all("html", F.lit("<[A-Za-z][^>]*>"), F.lit(0))).alias("tag"))
    name = F.lower(F.regexp_extract("tag", "^<([A-Za-z][A-Za-z0-9:]*)", 1))
    cls = F.regexp_extract("tag", 'class="([^"]*)"', 1)
    blocks = "p div section article center tr td th table ul ol dl pre figure figcaption aside header footer".split()
    kind = F.when(name.rlike(r"\Ah[1-6]\z"), "heading").when(name.isin("li", "dt", "dd"), "list").when(name == "blockquote", "quote").when(name.isin(blocks), F.when(cls.rlike(r"(?i)(^|\s)h[1-6](?:[^0-9A-Za-z_]|[_]|\z)"), "heading").otherwise("paragraph")).otherwise("inline")
    return t.select("book_id", name.alias("name"), kind.alias("kind")).groupBy("name", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("book_id").alias("n_books"))


@query(r"""with t as (select book_id, regexp_extract_all(html, '</?(?:ul|ol|li)\b[^>]*>') as tags from books where html is not null),
    e as (select book_id, generate_subscripts(tags, 1) as pos, unnest(tags) as tag from t), s as (select *, sum(case when regexp_matches(tag, '^<(ul|ol)')
    then 1 when regexp_matches(tag, '^</(ul|ol)') then -1 else 0 end) over (partition by book_id order by pos rows unbounded preceding) as depth
    from e)
  select book_id, cast(pos as int) as pos, cast(greatest(depth, 1) as int) as depth from s where regexp_matches(tag, '^<li')""")
def list_depth(spark, d) -> DataFrame:
    """The nesting of every list item: a running sum over list tags, one at least."""
    tags = F.regexp_extract_all("html", F.lit(r"</?(?:ul|ol|li)\b[^>]*>"), F.lit(0))
    step = lambda x: F.when(x.rlike("^<(ul|ol)"), 1).when(x.rlike("^</(ul|ol)"), -1).otherwise(0)
    state = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.array().cast("array<struct<pos:int,depth:int>>").alias("items"))

    def fold(s, x):
        depth, at = s["depth"] + step(x), s["at"] + 1
        item = F.array(F.struct(at.alias("pos"), F.greatest(depth, F.lit(1)).alias("depth")))
        return F.struct(at.alias("at"), depth.alias("depth"), F.when(x.rlike("^<li"), F.concat(s["items"], item)).otherwise(s["items"]).alias("items"))

    items = F.aggregate(tags, state, fold, lambda s: s["items"])
    return table(spark, d, "books").where("html is not null").select("book_id", F.explode(items).alias("x")).select("book_id", "x.pos", "x.depth")


@query(r"""with t as (select book_id, regexp_extract_all(html, '(?i)<a\b[^>]*href="([^"]*)"', 1) as h from books where html is not null),
    e as (select book_id, generate_subscripts(h, 1) as pos, unnest(h) as href from t)
  select book_id, cast(pos as int) as pos, href, not (starts_with(href, '#') or starts_with(href, 'kindle:')) and href <> '' as kept from e""")
def link_targets(spark, d) -> DataFrame:
    """Links of every page; internal ones are dropped from the text."""
    t = table(spark, d, "books").where("html is not null").select("book_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'(?i)<a\b[^>]*href="([^"]*)"'), F.lit(1))).alias("p", "href"))
    return t.select("book_id", (F.col("p") + 1).alias("pos"), "href", (~(F.col("href").startswith("#") | F.col("href").startswith("kindle:")) & (F.col("href") != "")).alias("kept"))


@query(r"""with r as (select book_id, generate_subscripts(flows, 1) as sheet, unnest(flows) as css from books), c as (select book_id, sheet,
    regexp_replace(css, '/\*.*?\*/', '', 'gs') as css from r), e as (select book_id, sheet, regexp_extract_all(css, '[^{}]*\{[^{}]*\}') as rules
    from c), u as (select book_id, sheet, generate_subscripts(rules, 1) as no, unnest(rules) as rule from e),
  s as (select book_id, sheet, no, lower(trim(x)) as selector, rule from (select book_id, sheet, no, rule, unnest(string_split(regexp_extract(rule, '^([^{}]*)\{', 1), ',')) as x
    from u)), p as (select book_id, cast(sheet as int) as sheet, cast(no as int) as no, selector, unnest(string_split(regexp_extract(rule, '\{([^{}]*)\}', 1), ';')) as decl
    from s where selector <> '' and not starts_with(selector, '@') and not regexp_matches(selector, '[ >+~:\[*#]'))
  select book_id, sheet, no, selector, lower(trim(string_split(decl, ':')[1])) as name, lower(trim(substr(decl, strpos(decl, ':') + 1))) as value
    from p where contains(decl, ':') and trim(substr(decl, strpos(decl, ':') + 1)) <> ''""")
def css_rules(spark, d) -> DataFrame:
    """Declarations of every plain rule of every stylesheet; rules with selectors out of scope are dropped."""
    r = table(spark, d, "books").select("book_id", F.posexplode("flows").alias("s", "css")).withColumn("css", F.regexp_replace("css", r"(?s)/\*.*?\*/", ""))
    u = r.select("book_id", (F.col("s") + 1).alias("sheet"), F.posexplode(F.regexp_extract_all("css", F.lit(r"[^{}]*\{[^{}]*\}"), F.lit(0))).alias("n", "rule"))
    x = u.select("book_id", "sheet", (F.col("n") + 1).alias("no"), "rule", F.explode(F.split(F.regexp_extract("rule", r"^([^{}]*)\{", 1), ",")).alias("x")).withColumn("selector", F.lower(F.trim("x")))
    x = x.where((F.col("selector") != "") & ~F.col("selector").startswith("@") & ~F.col("selector").rlike(r"[ >+~:\[*#]"))
    p = x.select("book_id", "sheet", "no", "selector", F.explode(F.split(F.regexp_extract("rule", r"\{([^{}]*)\}", 1), ";")).alias("decl"))
    value = F.trim(F.expr("substring(decl, instr(decl, ':') + 1)"))
    return p.where(F.contains("decl", F.lit(":")) & (value != "")).select("book_id", "sheet", "no", "selector", F.lower(F.trim(F.get(F.split("decl", ":"), F.lit(0)))).alias("name"), F.lower(value).alias("value"))


_NUM = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?"
_CUT = lambda unit: f"try_cast(case when regexp_matches(regexp_replace(value, '{unit}$', ''), '^{_NUM}$') then regexp_replace(value, '{unit}$', '') end as double)"
_WORD_SIZES = " ".join(f"when '{k}' then {v}" for k, v in L.KEYWORDS.items())


@query(f"""with r as ({ORACLES['css_rules']}), v as (select distinct name, value from r)
  select name, value,
    case when name = 'font-size' then cast(coalesce(case value {_WORD_SIZES} end,
      case when value like '%\\%' escape '\\' then case when {_CUT('%')} / 100 > 0 then {_CUT('%')} / 100 when {_CUT('%')} is not null then {L.SCALE_LOW} end
        when value like '%em' then case when {_CUT('r?em')} > 0 then {_CUT('r?em')} when {_CUT('r?em')} is not null then {L.SCALE_LOW} end
        when value like '%px' then case when {_CUT('px')} > 0 then {_CUT('px')} / 16 end when value like '%pt' then case when {_CUT('pt')} > 0 then {_CUT('pt')} / 12 end end) as double) end as size,
    case when name in ('text-indent', 'margin-left', 'margin', 'padding-left') then cast(case when value like '%em' then {_CUT('r?em')} when value like '%px' then {_CUT('px')} / 16 when value like '%pt' then {_CUT('pt')} / 12
      when value like '%\\%' escape '\\' then {_CUT('%')} / 25 when value = '0' then 0.0 end as double) end as length from v""")
def style_values(spark, d) -> DataFrame:
    """What each font size of the stylesheets multiplies the surrounding one by, and each margin and indent in widths of the letter m."""
    v = css_rules(spark, d).select("name", "value").distinct()
    margins = F.col("name").isin("text-indent", "margin-left", "margin", "padding-left")
    return v.select("name", "value", F.when(F.col("name") == "font-size", L.css_size(F.col("value"))).alias("size"), F.when(margins, L.css_length(F.col("value"))).alias("length"))


@query("""with w as (select doc_id, unnest(regexp_extract_all(text, '[^ \\n\\r\\t]+')) as word from documents where text is not null)
    select doc_id, count(*) as n_words, cast(sum(length(word)) as bigint) as n_letters, cast(max(length(word)) as int) as longest from w
    group by 1""")
def word_measure(spark, d) -> DataFrame:
    """Words of every text and their widths in characters."""
    w = F.transform(F.regexp_extract_all("text", F.lit(r"[^ \n\r\t]+"), F.lit(0)), F.char_length)
    t = table(spark, d, "documents").where("text is not null").select("doc_id", w.alias("w")).where(F.size("w") > 0)
    return t.select("doc_id", F.size("w").cast("bigint").alias("n_words"), F.aggregate("w", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("n_letters"), F.array_max("w").alias("longest"))


# ---- references, order and assembly --------------------------------------------------------------------------------------------


@query(r"""with t as (select book_id, regexp_extract_all(html, '(?i)<img\b[^>]*?\b(?:recindex|src)="([^"]*)"', 1) as refs from books
    where html is not null), e as (select book_id, generate_subscripts(refs, 1) as pos, unnest(refs) as ref from t),
  f as (select book_id, ref, min(pos) as first_pos, count(*) as n_refs from e group by 1, 2) select book_id, ref, cast(row_number()
    over (partition by book_id order by first_pos) as int) as number, n_refs from f""")
def image_references(spark, d) -> DataFrame:
    """Images of every page numbered by their first reference; repeated references share the number."""
    t = table(spark, d, "books").where("html is not null").select("book_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'(?i)<img\b[^>]*?\b(?:recindex|src)="([^"]*)"'), F.lit(1))).alias("p", "ref"))
    f = t.groupBy("book_id", "ref").agg(F.min("p").alias("first_pos"), F.count(F.lit(1)).alias("n_refs"))
    return f.select("book_id", "ref", F.row_number().over(Window.partitionBy("book_id").orderBy("first_pos")).alias("number"), "n_refs")


@query(r"""with t as (select book_id, unnest(regexp_extract_all(html, '(?i)<h[1-6][^>]*>[^<]*</h[1-6]>')) as h from books where html is not null),
    n as (select book_id, lower(regexp_replace(regexp_extract(h, '>([^<]*)<', 1), '\s+', ' ', 'g')) as target, cast(regexp_extract(h, '(?i)^<h([1-6])', 1) as int) as level
    from t)
  select book_id, target, cast(least(greatest(min(level), 1), 6) as int) as depth, count(*) as n from n where trim(target) <> '' group by 1, 2""")
def toc_min_depth(spark, d) -> DataFrame:
    """The depth of each contents target: the least of its levels, from one to six."""
    t = table(spark, d, "books").where("html is not null").select("book_id", F.explode(F.regexp_extract_all("html", F.lit(r"(?i)<h[1-6][^>]*>[^<]*</h[1-6]>"), F.lit(0))).alias("h"))
    target = F.lower(F.regexp_replace(F.regexp_extract("h", ">([^<]*)<", 1), r"\s+", " "))
    n = t.select("book_id", target.alias("target"), F.regexp_extract("h", "(?i)^<h([1-6])", 1).cast("int").alias("level")).where("trim(target) <> ''")
    return n.groupBy("book_id", "target").agg(F.least(F.greatest(F.min("level"), F.lit(1)), F.lit(6)).alias("depth"), F.count(F.lit(1)).alias("n"))


@query("""select book_id, string_agg(text, chr(10) order by case when doc_kind = 'notes' then 1 else 0 end, chapter_no nulls last, doc_id) as assembled, count(*) as n_parts
    from documents where book_id is not null and text is not null group by 1""")
def assemble_documents(spark, d) -> DataFrame:
    """The texts of each book in reading order, notes last, as one."""
    t = table(spark, d, "documents").where("book_id is not null and text is not null")
    part = F.struct(F.when(F.col("doc_kind") == "notes", 1).otherwise(0).alias("late"), F.coalesce("chapter_no", F.lit(2**31 - 1)).alias("no"), "doc_id", "text")
    g = t.groupBy("book_id").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.count(F.lit(1)).alias("n_parts"))
    return g.select("book_id", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("assembled"), "n_parts")


@query(r"""with w as (select book_id, list_filter(regexp_split_to_array(description, '[ \t\n\r\f\v]+'), lambda x: x <> '') as words from books where trim(description) <> '')
  select book_id, coalesce(list_reduce(words, lambda a, x: case when octet_length(encode(string_split(a, chr(10))[-1])) + 1 + octet_length(encode(x)) > 72
    then a || chr(10) || x else a || ' ' || x end), '') as wrapped from w""")
def wrapped_titles(spark, d) -> DataFrame:
    """Descriptions wrapped greedily at 72 bytes: an ordered fold over words."""
    t = table(spark, d, "books").where("trim(description) <> ''")
    return t.select("book_id", S.wrapped(F.col("description"), 72).alias("wrapped"))


@query(ORACLES["wrapped_titles"].join(["with all_lines as (", ") select book_id, case when len(string_split(wrapped, chr(10))) > 3 then array_to_string(string_split(wrapped, chr(10))[1:3], chr(10)) || ' …' else wrapped end as wrapped from all_lines"]))
def wrapped_blurbs(spark, d) -> DataFrame:
    """Descriptions wrapped at 72 bytes, three lines at most."""
    return table(spark, d, "books").where("trim(description) <> ''").select("book_id", S.wrapped_most(F.col("description"), 72, 3).alias("wrapped"))


@query("""with r as (select distinct book_id, idx, coalesce(kind, '') as kind from resources), w as (select lower(kind) as k, kind, book_id, idx
    from r) select kind, count(*) as n, count(distinct book_id) as n_books, kind <> '' as is_image from w group by 1""")
def resource_kinds(spark, d) -> DataFrame:
    """Resources by kind, repeats counted once."""
    r = table(spark, d, "resources").select("book_id", "idx", F.coalesce("kind", F.lit("")).alias("kind")).distinct()
    return r.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("book_id").alias("n_books")).withColumn("is_image", F.col("kind") != "")


# ---- flattening as islands -----------------------------------------------------------------------------------------------------

_HIDDEN = r"(?is)<head\b.*?</head>|<script\b.*?</script>|<style\b.*?</style>|<title\b.*?</title>|<svg\b.*?</svg>|<!--.*?-->"
_PARAS = "p div section article center tr td th table ul ol dl pre figure figcaption aside header footer".split()
_BOUNDS = [*_PARAS, "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "blockquote", "hr", "img", "image", "mbp:pagebreak", "html"]
_IN = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
_HCLASS = r"(?i)(^|\s)h[1-6](?:[^0-9A-Za-z_]|[_]|$)"
_BLANK = r"(?:&nbsp;|[\s\x{0085}\p{Z}])+"


@query(f"""with t as (select book_id, regexp_extract_all(regexp_replace(html, '{_HIDDEN}', '', 'g'), '<[^>]*>|[^<]+') as toks from books
    where html is not null), e as (select book_id, generate_subscripts(toks, 1) as pos, unnest(toks) as tok from t),
  n as (select *, lower(regexp_extract(tok, '^</?([A-Za-z][A-Za-z0-9:]*)', 1)) as name, starts_with(tok, '</') as closing from e), b as (select *, starts_with(tok, '<')
    and name in {_IN(_BOUNDS)} as bound from n), s as (select *, sum(case when bound then 1 else 0 end) over (partition by book_id order by pos rows unbounded preceding) as island
    from b),
  k as (select book_id, island, max(case when not bound or closing then 'paragraph' when regexp_matches(name, '^h[1-6]$') then 'heading'
    when name in ('li', 'dt', 'dd') then 'list' when name = 'blockquote' then 'quote' when name in {_IN(_PARAS)} and regexp_matches(regexp_extract(tok, 'class="([^"]*)"', 1), '{_HCLASS}')
    then 'heading' else 'paragraph' end) filter (where bound) as kind,
    bool_or(not starts_with(tok, '<') and regexp_replace(tok, '{_BLANK}', '', 'g') <> '') as filled from s group by 1, 2)
  select book_id, cast(count_if(coalesce(kind, 'paragraph') = 'paragraph') as bigint) as paragraphs, cast(count_if(kind = 'heading') as bigint) as headings,
    cast(count_if(kind = 'list') as bigint) as lists, cast(count_if(kind = 'quote') as bigint) as quotes from k where filled group by 1""")
def block_islands(spark, d) -> DataFrame:
    """Text blocks of every page by kind, without a kernel: tokens between block boundaries form islands. Equal to the kernel's counts for text blocks;
    spans, styles and stylesheets need the kernel."""
    toks = F.regexp_extract_all(F.regexp_replace("html", _HIDDEN, ""), F.lit("<[^>]*>|[^<]+"), F.lit(0))
    kinds = ("paragraph", "heading", "list", "quote")

    def kind_of(tok):
        name, closing = F.lower(F.regexp_extract(tok, "^</?([A-Za-z][A-Za-z0-9:]*)", 1)), tok.startswith("</")
        cls = F.regexp_extract(tok, 'class="([^"]*)"', 1).rlike(_HCLASS.replace("$", r"\z"))
        kind = F.when(closing, "paragraph").when(name.rlike(r"\Ah[1-6]\z"), "heading").when(name.isin("li", "dt", "dd"), "list").when(name == "blockquote", "quote").when(name.isin(_PARAS) & cls, "heading").otherwise("paragraph")
        return F.when(tok.startswith("<") & name.isin(_BOUNDS), kind)

    def counted(s):
        return [(s[k] + F.when(s["filled"] & (s["kind"] == k), 1).otherwise(0)).cast("bigint").alias(k) for k in kinds]

    def fold(s, x):
        # a boundary closes the island before it and opens the next one
        return F.when(
            x["kind"].isNotNull(), F.struct(x["kind"].alias("kind"), F.lit(False).alias("filled"), *counted(s))
        ).otherwise(F.struct(s["kind"].alias("kind"), (s["filled"] | x["text"]).alias("filled"), *[s[k].alias(k) for k in kinds]))

    tokens = F.transform(toks, lambda t: F.struct(kind_of(t).alias("kind"), (~t.startswith("<") & (F.regexp_replace(t, _BLANK, "") != "")).alias("text")))
    start = F.struct(F.lit("paragraph").alias("kind"), F.lit(False).alias("filled"), *[F.lit(0).cast("bigint").alias(k) for k in kinds])
    total = F.aggregate(tokens, start, fold, lambda s: F.struct(*counted(s)))
    c = table(spark, d, "books").where("html is not null").select("book_id", total.alias("c"))
    return c.select("book_id", *[F.col(f"c.{k}").alias(k + "s") for k in kinds]).where("paragraphs + headings + lists + quotes > 0")
