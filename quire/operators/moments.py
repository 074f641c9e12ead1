"""Problem 2: mixed timestamp formats and time zones become one UTC value with its precision.

Every value is parsed once into wall-clock parts, an optional offset and an optional zone name. Values with a time of day but without zone are
converted with the zone of their source (folder): the declared one, or, where a source declares none, the candidate whose offset history
violates the evidence least (local times aligned with zoned moments of the same record, and with ingestion times, which no publication follows).

The estimate serves sources without a declared zone only: where one is declared it holds, so on tables that declare all zones it changes no moment. ``p2_zones`` estimates every source
with its declaration withheld.

Defined results: null, blank and unreadable texts have precision ``none`` and no value; slashed dates whose day and month could each be the other have precision ``ambiguous`` and no value; local times that occur twice or never in their zone have
precision ``second`` but no value; years outside 1..9999 are unreadable; rows without a book id are left out; extra columns of the input are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.runtime import arrow_map, collect_bounded, table, tune

# The beginnings of month names, without accents, in English, German, French, Spanish, Portuguese, Italian, Dutch, Swedish, Polish and Russian; zone abbreviations with
# their offsets in hours.
_MONTHS = (
    "jan feb mar apr may jun jul aug sep oct nov dec", "jan feb mar apr mai jun jul aug sep okt nov dez", "jan fev mar avr mai juin juil aou sep oct nov dec", "ene feb mar abr may jun jul ago sep oct nov dic",
    "jan fev mar abr mai jun jul ago set out nov dez", "gen feb mar apr mag giu lug ago set ott nov dic", "jan feb maa apr mei jun jul aug sep okt nov dec", "jan feb mar apr maj jun jul aug sep okt nov dec",
    "sty lut mar kwi maj cze lip sie wrz paz lis gru", "янв фев мар апр маи июн июл авг сен окт ноя дек",
)
MONTHS = {m: i + 1 for names in _MONTHS for i, m in enumerate(names.split())} | {"mrt": 3, "мая": 5}
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "UT": 0, "WET": 0, "WEST": 1, "BST": 1, "CET": 1, "CEST": 2, "EET": 2, "EEST": 3, "MSK": 3, "IST": 5.5, "JST": 9, "KST": 9,
    "AEST": 10, "AEDT": 11, "ACST": 9.5, "ACDT": 10.5, "AWST": 8, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7,
    "AKST": -9, "AKDT": -8, "HST": -10,
}
SEASONS = ("spring", "summer", "autumn", "fall", "winter")

_OFF = r"(?:(?P<z>Z)|(?P<osign>[+\-−])(?P<oh>\d\d):?(?:'?(?P<om>\d\d)'?)?)"
_TIME = r"(?P<h>\d{1,2}):(?P<mi>\d\d)(?::(?P<s>\d\d)(?:[.,](?P<f>\d{1,9}))?)?"
_ZONE = r"(?:\s*\[?(?P<zone>[A-Za-z]+/[A-Za-z_/+\-0-9]+|UTC|GMT)\]?|\s+(?P<abbr>[A-Z]{1,5}))?"
_TAIL = rf"\s*{_OFF}?{_ZONE}$"
_NAME = r"(?P<mon>[^\W\d_]{3,12})"
PATTERNS = [
    re.compile(p, re.I)
    for p in (
        rf"(?P<y>\d{{4}})-(?P<mo>\d\d)-(?P<d>\d\d)[T ]+{_TIME}\s*(?P<ap>[AP]M(?![A-Za-z]))?{_TAIL}",
        rf"(?P<y>\d{{4}})(?P<mo>\d\d)(?P<d>\d\d)[T ](?P<h>\d\d)(?P<mi>\d\d)(?P<s>\d\d)?(?:[.,](?P<f>\d{{1,9}}))?{_TAIL}",
        rf"D:(?P<y>\d{{4}})(?P<mo>\d\d)(?P<d>\d\d)(?P<h>\d\d)(?P<mi>\d\d)(?P<s>\d\d)?{_TAIL}",
        rf"(?P<y>\d{{4}})-(?P<doy>\d{{3}})[T ]{_TIME}{_TAIL}",
        rf"(?P<y>\d{{4}})-?W(?P<w>\d\d)-?(?P<wd>[1-7])[T ]{_TIME}{_TAIL}",
        rf"(?:[^\W\d_]{{3,12}}\.?,?\s+)?(?P<d>\d{{1,2}})\.?[ \-]\s*(?:de\s+)?{_NAME}\.?[ \-]\s*(?:de\s+)?(?P<y>\d{{4}}),?\s+{_TIME}\s*(?P<ap>[AP]M(?![A-Za-z]))?{_TAIL}",
        rf"[A-Za-z]{{3,9}}\s+{_NAME}\s+(?P<d>\d{{1,2}})\s+{_TIME}\s+(?P<abbr0>[A-Z]{{1,5}}|[+\-]\d{{4}})\s+(?P<y>\d{{4}})$",
        rf"{_NAME}\.?\s+(?P<d>\d{{1,2}}),?\s+(?P<y>\d{{4}}),?(?:\s+at)?\s+{_TIME}\s*(?P<ap>[AP]\.?M\b\.?)?{_TAIL}",
        rf"(?P<d>\d{{1,2}})\.(?P<mo>\d{{1,2}})\.(?P<y>\d{{4}}),?\s+{_TIME}{_TAIL}",
        rf"(?P<s1>\d{{1,2}})/(?P<s2>\d{{1,2}})/(?P<y>\d{{4}}),?\s+{_TIME}\s*(?P<ap>[AP]M(?![A-Za-z]))?{_TAIL}",
        rf"(?P<y>\d{{4}})/(?P<mo>\d{{1,2}})/(?P<d>\d{{1,2}})\s+{_TIME}\s*(?P<ap>[AP]M(?![A-Za-z]))?{_TAIL}",
    )
]
EPOCH = re.compile(r"(?:/Date\((-?\d{9,13})(?:[+\-]\d{4})?\)/|(-?\d{9,10})(?:\.(\d+))?|(-?\d{12,13}))$")
VAGUE = [
    (re.compile(r"(?P<y>\d{4})[-/.](?P<mo>\d{1,2})[-/.](?P<d>\d{1,2})$"), "day"),
    (re.compile(r"(?P<d>\d{1,2})\.(?P<mo>\d{1,2})\.(?P<y>\d{4})$"), "day"),
    (re.compile(r"(?P<s1>\d{1,2})/(?P<s2>\d{1,2})/(?P<y>\d{4})$"), "day"),
    (re.compile(r"(?P<d>\d{1,2})\.?\s+(?:de\s+)?" + _NAME + r"\.?\s+(?:de\s+)?(?P<y>\d{4})$"), "day"),
    (re.compile(_NAME + r"\.?\s+(?P<d>\d{1,2}),\s*(?P<y>\d{4})$"), "day"),
    (re.compile(r"(?P<y>\d{4})(?P<mo>[01]\d)(?P<d>[0-3]\d)$"), "day"),
    (re.compile(r"(?P<y>\d{4})[-/](?P<mo>0?[1-9]|1[0-2])$"), "month"),
    (re.compile(_NAME + r"\.?,?\s+(?P<y>\d{4})$"), "month"),
    (re.compile(r"(?P<y>\d{4})-(?P<y2>\d{4})$"), "range"),
    (re.compile(r"(?:©|\(c\)|c\.|ca\.|circa|\[)?\s*(?P<y>\d{4})(?:\.0+)?\??\]?$", re.I), "year"),
    (re.compile(r"['’](?P<yy>\d\d)$"), "year"),
]

#: (precision, wall-clock time, microseconds included, offset in seconds or None, zone name or None, vague text or None)
Parsed = tuple


def _month(name: str) -> int | None:
    bare = "".join(c for c in unicodedata.normalize("NFD", name.lower()) if not unicodedata.combining(c))
    return MONTHS.get(bare[:4]) or MONTHS.get(bare[:3])


class Ambiguous(ValueError):
    """A slashed date whose day and month could each be the other."""


def _offset(g: dict) -> int | None:
    if g.get("z"):
        return 0
    if g.get("osign"):
        secs = int(g["oh"]) * 3600 + int(g.get("om") or 0) * 60
        return secs if g["osign"] == "+" else -secs
    a = g.get("abbr") or g.get("abbr0")
    if a and a[0] in "+-":
        return (1 if a[0] == "+" else -1) * (int(a[1:3]) * 3600 + int(a[3:5]) * 60)
    if a and a.upper() in ABBREVIATIONS:
        return int(ABBREVIATIONS[a.upper()] * 3600)
    return None


def _day(g: dict) -> tuple[int, int, int]:
    y = int(g["y"])
    if g.get("doy"):
        d = datetime(y, 1, 1) + timedelta(days=int(g["doy"]) - 1)
        if d.year != y:
            raise ValueError
        return d.year, d.month, d.day
    if g.get("w"):
        d = datetime.fromisocalendar(y, int(g["w"]), int(g["wd"]))
        return d.year, d.month, d.day
    if g.get("s1"):
        a, b = int(g["s1"]), int(g["s2"])
        if a <= 12 and b <= 12 and a != b:
            raise Ambiguous
        return (y, b, a) if a > 12 else (y, a, b)
    mo = _month(g["mon"]) if g.get("mon") else int(g["mo"])
    if mo is None:
        raise ValueError
    return y, mo, int(g["d"])


def parse(text: str | None) -> Parsed:
    """One value into its parts; see ``Parsed``. Pure, so equal texts are parsed once a batch."""
    none = ("none", None, None, None, None)
    if not text:
        return none
    t = unicodedata.normalize("NFKC", text).strip()
    t = re.sub(r"[​-‍⁠﻿­]", "", t)
    if not t:
        return none
    if m := EPOCH.match(t):
        if m[1]:
            us = int(m[1]) * 1000 if len(m[1].lstrip("-")) > 10 else int(m[1]) * 10**6
        elif m[2]:
            us = int(m[2]) * 10**6 + (-1 if m[2][0] == "-" else 1) * int((m[3] or "")[:6].ljust(6, "0"))
        else:
            us = int(m[4]) * 1000
        try:
            return ("fraction" if m[3] else "second", datetime(1970, 1, 1) + timedelta(microseconds=us), 0, None, None)
        except OverflowError:
            return none
    if ":" in t or "T" in t:
        for p in PATTERNS:
            if not (m := p.match(t)):
                continue
            g = m.groupdict()
            try:
                y, mo, d = _day(g)
                h = int(g["h"])
                if ap := (g.get("ap") or "").replace(".", "").upper():
                    if not 1 <= h <= 12:
                        return none
                    h = h % 12 + (12 if ap == "PM" else 0)
                f = (g.get("f") or "")[:6].ljust(6, "0")
                extra = timedelta(days=1) if h == 24 else timedelta()
                s = int(g.get("s") or 0)
                at = datetime(y, mo, d, h % 24, int(g["mi"]), min(s, 59), int(f)) + extra
            except Ambiguous:
                return ("ambiguous", None, None, None, None)
            except (ValueError, OverflowError):
                return none
            prec = "minute" if g.get("s") is None else "fraction" if g.get("f") else "second"
            off, zone = _offset(g), g.get("zone")
            if zone and off is None and zone.upper() in ("UTC", "GMT"):
                off = 0
            if g.get("abbr") and off is None:
                return none
            return (prec, at, off, zone if off is None else None, None)
        return none
    for p, prec in VAGUE:
        if not (m := p.match(t)):
            continue
        g = m.groupdict()
        try:
            if g.get("yy"):
                return (prec, None, None, None, f"19{g['yy']}" if int(g["yy"]) > 30 else f"20{g['yy']}")
            if prec == "range":
                return (prec, None, None, None, f"{g['y']}/{g['y2']}")
            if prec == "year":
                return (prec, None, None, None, g["y"])
            if prec == "month":
                if g.get("mon") and g["mon"].lower() in SEASONS:
                    return ("season", None, None, None, f"{g['y']}-{g['mon'].lower().replace('fall', 'autumn')}")
                mo = _month(g["mon"]) if g.get("mon") else int(g["mo"])
                if not mo:
                    return none
                return (prec, None, None, None, f"{g['y']}-{mo:02d}")
            y, mo, d = _day(g)
            datetime(y, mo, d)
            return (prec, None, None, None, f"{y:04d}-{mo:02d}-{d:02d}")
        except Ambiguous:
            return ("ambiguous", None, None, None, None)
        except ValueError:
            return none
    return none


@lru_cache(maxsize=1024)
def _zone(name: str | None) -> ZoneInfo | None:
    try:
        return ZoneInfo(name) if name else None
    except Exception:
        return None


def to_utc(p: Parsed, tz_name: str | None) -> datetime | None:
    """The UTC moment of a parsed value; None for vague values, unknown zones, and times that occur twice or never."""
    _, at, off, zone, _ = p
    if at is None:
        return None
    try:
        if off is not None:
            return at - timedelta(seconds=off)
        z = _zone(zone or tz_name)
        if z is None:
            return None
        first, second = at.replace(tzinfo=z).utcoffset(), at.replace(tzinfo=z, fold=1).utcoffset()
        return at - first if first == second else None
    except OverflowError:
        return None


def show(p: Parsed, utc: datetime | None) -> str | None:
    if p[4] is not None:
        return p[4]
    if utc is None:
        return None
    body = f"{utc.year:04d}-{utc.month:02d}-{utc.day:02d}T{utc.hour:02d}:{utc.minute:02d}"
    if p[0] != "minute":
        body += f":{utc.second:02d}" + (f".{utc.microsecond:06d}" if p[0] == "fraction" else "")
    return body + "Z"


#: The slots of ``p2_found``; ``p2_normalise`` has ``date4`` and so on where a record holds more dates.
SLOTS = ("published", "year", "date1", "date2", "date3")
#: Distinct declared zones that are candidates; the zone database names about 600.
ZONES = 2000


def slots_wide(spark, sf_dir: str) -> DataFrame:
    """A row for each book with its values; the joins are on ``book_id``, and only date columns are read."""
    b = table(spark, sf_dir, "books").where("book_id is not null").select("book_id", "folder_id", "published", "ingested_at")
    o = table(spark, sf_dir, "opf_metadata").select(F.col("book_id").alias("o_id"), "dates")
    c = table(spark, sf_dir, "comic_info").select(F.col("book_id").alias("c_id"), F.col("issue_year").alias("year"))
    return b.join(o, b.book_id == o.o_id, "left").join(c, b.book_id == c.c_id, "left").select("book_id", "folder_id", "ingested_at", "published", "year", "dates")


def estimate_zones(wide: DataFrame, candidates: list[str]) -> DataFrame:
    """(folder_id, zone, agreements, violations, ranking): how well each candidate's offset history fits each source's local times.

    Evidence of a record: a local time and a zoned moment that differ by a whole quarter of an hour and agree in minutes modulo 15 and in seconds
    support the zones with that offset then and violate the others; a local time that would lie after the record's ingestion, or in a gap of the
    zone, violates it. Counts are added map-side, so a source of any size costs one row a candidate and task.
    """
    cols = ["folder_id", "ingested_at", "published", "year", "dates"]

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        memo, out = {}, {}
        data = [b.column(b.schema.get_field_index(c)).to_pylist() for c in cols]
        for folder, ingested, published, year, dates in zip(*data):
            parsed = [memo[t] if t in memo else memo.setdefault(t, parse(t)) for t in (published, year, *(dates or ())) if t]
            local = [p[1] for p in parsed if p[1] is not None and p[2] is None and p[3] is None]
            if not local or folder is None:
                continue
            fixed = [p[1] - timedelta(seconds=p[2]) for p in parsed if p[1] is not None and p[2] is not None]
            for z in candidates:
                good = bad = 0
                for at in local:
                    try:
                        off = at.replace(tzinfo=_zone(z)).utcoffset()
                        utc = at - off
                        if utc.replace(tzinfo=timezone.utc).astimezone(_zone(z)).replace(tzinfo=None) != at:
                            bad += 1
                    except (OverflowError, AttributeError):
                        continue
                    if ingested is not None and utc > ingested.astimezone(timezone.utc).replace(tzinfo=None):
                        bad += 1
                    for u in fixed:
                        gap = (at - u).total_seconds()
                        if abs(gap) <= 14 * 3600 and int(gap) % 900 == 0:
                            good, bad = (good + 1, bad) if gap == off.total_seconds() else (good, bad + 1)
                x = out.setdefault((folder, z), [0, 0])
                x[0] += good
                x[1] += bad
        keys = list(out)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), pa.array([out[k][0] for k in keys], pa.int64()), pa.array([out[k][1] for k in keys], pa.int64())],
            names=["folder_id", "zone", "agreements", "violations"],
        )

    from pyspark.sql import Window

    votes = arrow_map(wide.select(*cols), kernel, "folder_id int, zone string, agreements bigint, violations bigint").groupBy("folder_id", "zone").agg(F.sum("agreements").alias("agreements"), F.sum("violations").alias("violations"))
    w = Window.partitionBy("folder_id").orderBy("violations", F.desc("agreements"), "zone")  # at most one row a candidate zone
    return votes.withColumn("ranking", F.row_number().over(w).cast("int"))


def candidate_zones(spark, sf_dir: str) -> list[str]:
    """The zones in use, at most a few hundred names exist; UTC is always one."""
    got = collect_bounded(table(spark, sf_dir, "folders").select("tz_name").distinct(), ZONES, "zone names")
    return sorted({"UTC", *(r[0] for r in got if _zone(r[0]) is not None)})


def with_zone(spark, sf_dir: str) -> DataFrame:
    """Values by slot with the zone of their source: declared, else estimated."""
    wide = slots_wide(spark, sf_dir)
    f = table(spark, sf_dir, "folders").select(F.col("folder_id").alias("f_id"), "tz_name")
    known = candidate_zones(spark, sf_dir)
    undeclared = f.where(F.col("tz_name").isNull() | ~F.col("tz_name").isin(known))
    guessed = estimate_zones(wide.join(undeclared, wide.folder_id == undeclared.f_id, "left_semi"), known).where("ranking = 1").select(F.col("folder_id").alias("g_id"), F.col("zone").alias("guess"))
    declared = f.withColumn("tz_name", F.when(F.col("tz_name").isin(known), F.col("tz_name")))
    zones = declared.join(guessed, declared.f_id == guessed.g_id, "left").select("f_id", F.coalesce("tz_name", "guess").alias("tz"))
    return wide.join(zones, wide.folder_id == zones.f_id, "left").drop("f_id")


def normalised(wide: DataFrame) -> DataFrame:
    """(book_id, slot, raw, value, precision, utc_second): one row for each slot that holds a text."""

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        cols = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("book_id", "tz", "published", "year", "dates")]
        memo, out = {}, ([], [], [], [], [], [])
        epoch = datetime(1970, 1, 1)
        for book, tz, published, year, dates in zip(*cols):
            for slot, t in (("published", published), ("year", year), *((f"date{k}", t) for k, t in enumerate(dates or (), 1))):
                if t is None:
                    continue
                p = memo[t] if t in memo else memo.setdefault(t, parse(t))
                utc = to_utc(p, tz)
                for o, v in zip(out, (book, slot, t, show(p, utc), p[0], None if utc is None else (utc - epoch) // timedelta(seconds=1))):
                    o.append(v)
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)], names=["book_id", "slot", "raw", "value", "precision", "utc_second"])

    return arrow_map(wide.select("book_id", "tz", "published", "year", "dates"), kernel, "book_id bigint, slot string, raw string, value string, precision string, utc_second bigint")


def p2_normalise(spark, sf_dir: str) -> DataFrame:
    """Every value of every slot in its unambiguous form."""
    tune(spark, 10_000)
    return normalised(with_zone(spark, sf_dir)).drop("utc_second")


def p2_zones(spark, sf_dir: str) -> DataFrame:
    """The fit of every candidate zone to every source, best first by ``ranking``."""
    tune(spark, 10_000)
    return estimate_zones(slots_wide(spark, sf_dir), candidate_zones(spark, sf_dir))


def p2_found(spark, sf_dir: str) -> DataFrame:
    """Two values of one book that fix the same second in different strings. A book has at most five slots, so pairs are built inside its row."""
    tune(spark, 10_000)
    m = normalised(with_zone(spark, sf_dir)).where(F.col("utc_second").isNotNull() & F.col("slot").isin(*SLOTS)).select("book_id", "slot", "raw", "utc_second")
    g = m.groupBy("book_id", "utc_second").agg(F.array_sort(F.collect_set(F.struct("slot", "raw"))).alias("v")).where(F.size("v") > 1)
    a = g.select("book_id", "v", F.explode("v").alias("a"))
    b = a.select("book_id", "a", F.explode("v").alias("b")).where("a.slot < b.slot and a.raw <> b.raw")
    return b.select("book_id", F.col("a.slot").alias("slot_a"), F.col("b.slot").alias("slot_b")).distinct()
