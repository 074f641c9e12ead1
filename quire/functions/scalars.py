"""Scalar functions of the engine as Catalyst expressions; none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File name suffixes of books and of plain documents, and of images.
BOOK_SUFFIXES = (".azw3", ".azw", ".mobi", ".prc", ".epub", ".cbz", ".fb2", ".fb2.zip", ".txt", ".html", ".htm", ".xhtml")
TEXT_SUFFIXES = (".txt", ".html", ".htm", ".xhtml")
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp")


def suffixed(path: Column, suffixes: tuple[str, ...]) -> Column:
    return F.lower(path).rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + r")\z")


def is_book_file(path: Column) -> Column:
    return suffixed(path, BOOK_SUFFIXES)


def is_text_file(path: Column) -> Column:
    return suffixed(path, TEXT_SUFFIXES)


def is_image_name(path: Column) -> Column:
    return suffixed(path, IMAGE_SUFFIXES)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def title_from_name(path: Column) -> Column:
    """The stem of a file name; ``.fb2.zip`` counts as one extension."""
    return F.regexp_replace(base_name(path), r"(?i)(\.fb2\.zip|\.[^.]*)\z", "")


def format_bytes(b: Column) -> Column:
    kb, mb, gb = 1024.0, 1024.0**2, 1024.0**3
    d = b.cast("double")
    return (
        F.when(b >= int(gb), F.concat(F.format_string("%.2f", F.bround(d / gb, 2)), F.lit(" GB")))
        .when(b >= int(mb), F.concat(F.format_string("%.1f", F.bround(d / mb, 1)), F.lit(" MB")))
        .when(b >= int(kb), F.concat(F.bround(d / kb, 0).cast("bigint").cast("string"), F.lit(" KB")))
        .otherwise(F.concat(b.cast("string"), F.lit(" B")))
    )


def format_duration(ms: Column) -> Column:
    return (
        F.when(ms <= 0, F.lit("--"))
        .when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
        .when(ms < 60_000, F.concat(F.format_string("%.1f", F.bround(ms / 1000.0, 1)), F.lit("s")))
        .otherwise(F.format_string("%dm %02ds", F.floor(ms / 60_000), F.floor(ms / 1000) % 60))
    )


def ellipsis(text: Column, n: int, trim: bool = False) -> Column:
    """At most ``n`` code points, the last an ellipsis where text was cut."""
    head = F.substring(text, 1, n - 1)
    return F.when(F.char_length(text) <= n, text).otherwise(F.concat(F.rtrim(head) if trim else head, F.lit("…")))


def author_line(authors: Column) -> Column:
    return F.when(F.coalesce(F.size(authors), F.lit(0)) <= 0, F.lit("Unknown author")).otherwise(F.array_join(authors, ", "))


def printable(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x20-\x7e]", ".")


def points(value: Column) -> Column:
    """The shortest form of a number of points."""
    return F.regexp_replace(value.cast("string"), r"\.0\z", "")


def wrap_index(i: Column, n: Column) -> Column:
    return F.when(n == 0, F.lit(0)).otherwise(F.pmod(i, n))


def yes_no(flag: Column) -> Column:
    return F.when(flag, F.lit("yes")).otherwise(F.lit("no"))


def has_style(style: Column, mask: int) -> Column:
    return style.bitwiseAND(F.lit(mask)) == mask


def trimmed(c: Column) -> Column:
    """Without blanks of any kind at the ends."""
    return F.regexp_replace(c, r"\A[\s\u0085\p{Z}]+|[\s\u0085\p{Z}]+\z", "")


def first_text(values: Column) -> Column:
    """The first element that is not blank, trimmed; an empty text where there is none."""
    return F.coalesce(F.get(F.filter(F.transform(values, trimmed), lambda v: v != ""), F.lit(0)), F.lit(""))


def texts(values: Column) -> Column:
    """All elements that are not blank, trimmed, in order."""
    return F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), trimmed), lambda v: v != "")


def split_list(text: Column) -> Column:
    """The items of a comma list, trimmed, without empty ones."""
    return texts(F.split(F.coalesce(text, F.lit("")), ","))


def natural_key(name: Column) -> Column:
    """A sort key in which digit runs compare by value: length of the run without leading zeros, then its digits."""
    tokens = F.regexp_extract_all(F.lower(name), F.lit(r"\d+|\D"), F.lit(0))

    def part(t: Column) -> Column:
        bare = F.regexp_replace(t, r"\A0+(?=\d)", "")
        return F.when(t.rlike(r"\A\d"), F.concat(F.lit("0"), F.lpad(F.length(bare).cast("string"), 9, "0"), bare)).otherwise(t)

    return F.array_join(F.transform(tokens, part), "")


def wrapped(text: Column, width: int) -> Column:
    """Greedy wrap by bytes: an ordered fold over the words of the text."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("line"))

    def step(s: Column, w: Column) -> Column:
        n = F.octet_length(w)
        fresh = (s["line"] > 0) & (s["line"] + 1 + n > width)
        return F.struct(
            F.concat(s["out"], F.when(fresh, F.lit("\n")).when(s["line"] > 0, F.lit(" ")).otherwise(F.lit("")), w).alias("out"),
            F.when(fresh, n).when(s["line"] > 0, s["line"] + 1 + n).otherwise(n).alias("line"),
        )

    return F.aggregate(words, state, step, lambda s: s["out"])


def sniff_image(data: Column) -> Column:
    """The image format that the first bytes show, an empty text for none."""
    at = lambda i, n: F.substring(data, i, n)
    hexed = lambda h: F.unhex(F.lit(h))
    return (
        F.when(data.isNull() | (F.octet_length(data) < 8), F.lit(""))
        .when(at(1, 3) == hexed("FFD8FF"), F.lit("jpeg"))
        .when(at(2, 3) == hexed("504E47"), F.lit("png"))
        .when(at(1, 3) == hexed("474946"), F.lit("gif"))
        .when(at(1, 2) == hexed("424D"), F.lit("bmp"))
        .when((F.octet_length(data) >= 12) & (at(1, 4) == hexed("52494646")) & (at(9, 4) == hexed("57454250")), F.lit("webp"))
        .otherwise(F.lit(""))
    )


def wrapped_most(text: Column, width: int, most: int) -> Column:
    """``wrapped``, but at most ``most`` lines: where more would follow, the last ends with a blank and an ellipsis."""
    lines = F.split(wrapped(text, width), "\n")
    return F.when(F.size(lines) > most, F.concat(F.array_join(F.slice(lines, 1, most), "\n"), F.lit(" …"))).otherwise(F.array_join(lines, "\n"))
