"""Layout arithmetic as Catalyst expressions: style sizes, effective scales, page sizes, option clamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Named page sizes in points, limits of style sizes, heading scales, size keywords.
PAGE_SIZES = {
    "a4": ("A4 (210 x 297 mm)", 595.28, 841.89), "a5": ("A5 (148 x 210 mm)", 419.53, 595.28), "a6": ("A6 (105 x 148 mm)", 297.64, 419.53), "letter": ("US Letter (8.5 x 11 in)", 612.0, 792.0), "legal": ("US Legal (8.5 x 14 in)", 612.0, 1008.0), "digest": ("Digest (5.5 x 8.5 in)", 396.0, 612.0),
    "trade": ("Trade paperback (6 x 9 in)", 432.0, 648.0), "kindle": ("Kindle Paperwhite (screen)", 353.0, 471.0), "tablet": ("Tablet (4:3 screen)", 540.0, 720.0), "pocket": ("Pocket (4.25 x 6.87 in)", 306.0, 495.0), "square": ("Square (8 x 8 in)", 576.0, 576.0), "tabloid": ("Tabloid (11 x 17 in)", 792.0, 1224.0),
}
SCALE_LOW, SCALE_HIGH, DAMPEN, SCALE_MOST = 0.5, 3.5, 0.62, 2.4
HEADINGS = (1.75, 1.45, 1.28, 1.15, 1.06, 1.0)
KEYWORDS = {"xx-small": 0.6, "x-small": 0.75, "small": 0.85, "smaller": 0.85, "medium": 1.0, "large": 1.2, "larger": 1.2, "x-large": 1.5, "xx-large": 2.0}
NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?"


def effective_scale(css: Column, kind: Column, level: Column) -> Column:
    """The multiple of the body size that a block is drawn at."""
    held = F.least(F.greatest(css, F.lit(SCALE_LOW)), F.lit(SCALE_HIGH))
    shown = F.when(css > 0, F.least(F.when(held > 1, 1 + (held - 1) * F.lit(DAMPEN)).otherwise(held), F.lit(SCALE_MOST))).otherwise(F.lit(1.0))
    step = F.when((level >= 1) & (level <= 6), level).otherwise(F.lit(3))
    floor = F.element_at(F.array(*[F.lit(float(h)) for h in HEADINGS]), step.cast("int"))
    return F.when(kind == "heading", F.when(css > 0, F.greatest(shown, floor)).otherwise(floor)).otherwise(shown)


def number(text: Column) -> Column:
    """A plain decimal number, null for anything else."""
    return F.when(F.lower(text).rlike(rf"\A{NUMBER}\z"), text.try_cast("double"))


def css_size(value: Column) -> Column:
    """A font size as a multiple of the surrounding one, null where it is none."""
    v = F.lower(F.trim(value))
    words = F.create_map(*[x for k, s in KEYWORDS.items() for x in (F.lit(k), F.lit(s))])
    some = lambda x: F.when(x > 0, x).otherwise(F.when(x.isNotNull(), F.lit(SCALE_LOW)))
    return (
        F.when(words[v].isNotNull(), words[v])
        .when(v.endswith("%"), some(number(F.regexp_replace(v, r"%\z", "")) / 100))
        .when(v.endswith("em"), some(number(F.regexp_replace(v, r"r?em\z", ""))))
        .when(v.endswith("px"), F.when(number(F.regexp_replace(v, r"px\z", "")) > 0, number(F.regexp_replace(v, r"px\z", "")) / 16))
        .when(v.endswith("pt"), F.when(number(F.regexp_replace(v, r"pt\z", "")) > 0, number(F.regexp_replace(v, r"pt\z", "")) / 12))
    )


def css_length(value: Column) -> Column:
    """A length in em, null where it is none."""
    v = F.lower(F.trim(value))
    cut = lambda p: number(F.regexp_replace(v, p, ""))
    return (
        F.when(v.endswith("em"), cut(r"r?em\z"))
        .when(v.endswith("px"), cut(r"px\z") / 16)
        .when(v.endswith("pt"), cut(r"pt\z") / 12)
        .when(v.endswith("%"), cut(r"%\z") / 25)
        .when(v == "0", F.lit(0.0))
    )


def page_size(name: Column, side: int) -> Column:
    """Width (``side`` 0) or height (1) in points of a named or measured page size, null where it is unknown."""
    key = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    known = F.create_map(*[x for k, s in PAGE_SIZES.items() for x in (F.lit(k), F.lit(float(s[side + 1])))])
    unit = F.when(key.endswith("in"), F.lit(72.0)).when(key.endswith("pt"), F.lit(1.0)).otherwise(F.lit(72.0 / 25.4))
    bare = F.regexp_replace(key, r"(mm|in|pt)\z", "")
    parts = F.split(bare, "x", 2)
    w, h = (number(F.trim(F.get(parts, F.lit(i)))) for i in (0, 1))
    free = F.when((w > 0) & (h > 0), (w if side == 0 else h) * unit)
    return F.when(key == "", F.lit(float(PAGE_SIZES["letter"][side + 1]))).otherwise(F.coalesce(known[key], free))


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def margin_points(mm: Column) -> Column:
    return mm * F.lit(72.0) / F.lit(25.4)
