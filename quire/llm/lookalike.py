"""Problem 4: text that looks the same but differs in its characters is brought to one form.

A batch's text becomes one numpy array of code points. Lookup tables give each code point its target (width and blank folding, full decomposition, Hangul syllables included), its
count of target characters (0 for invisible ones, more for ligatures), and expansion offsets place them. Combining marks are put in canonical order by one stable sort, look-alike letters are
gathered from a table, and marks are composed with their bases by searching a sorted pair table: all unblocked pairs of a batch at once, repeatedly until nothing composes. No call is made per row.

Two forms come out. ``unify`` gives the form that comparisons use: all texts of one look share it, so look-alike letters of all scripts become Latin there. ``shown`` gives a text for readers:
look-alike letters take the main script of their word (of their text, where a word has no letter of one script only).

Case, accents, raised signs and punctuation are kept, as they change the look. Runs of blanks become one space and are trimmed.

Defined results: null stays null; texts of invisible characters become empty and equal nothing; empty texts are left out of ``p4_found``; equal strings and strings
that differ only in ordinary blanks are no cases; repeated elements of one book count once; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.runtime import arrow_map, small_or_shuffled, table, tune

# Letters of other scripts that look like Latin ones, in pairs.
CONFUSABLE = dict(
    x.split("=")
    for x in (
        "А=A В=B Е=E К=K М=M Н=H О=O Р=P С=C Т=T У=Y Х=X Ѕ=S І=I Ј=J Ё=Ë Ї=Ï Ү=Y Ӏ=I Ԛ=Q Ԝ=W Ԍ=G Ѵ=V а=a е=e о=o р=p с=c у=y х=x ѕ=s і=i ј=j ё=ë ї=ï һ=h ԁ=d ԛ=q ԝ=w ѵ=v ү=y ӏ=l к=k "
        "Α=A Β=B Ε=E Ζ=Z Η=H Ι=I Κ=K Μ=M Ν=N Ο=O Ρ=P Τ=T Υ=Y Χ=X ο=o ν=v ρ=p α=a ι=i υ=u κ=k Ϲ=C ϲ=c Ϳ=J ϳ=j "
        "օ=o ս=u հ=h ո=n ց=g Օ=O Ս=U Լ=L ɡ=g ɑ=a ⅼ=l ‐=- ‑=- "
    ).split()
)
# Code points of characters that do not show.
INVISIBLE = (0x00AD, 0x034F, 0x061C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x2070), 0xFEFF, *range(0xFE00, 0xFE10))
#: Code points from here on have no decomposition and no look-alikes; those of ``TAGS`` do not show.
LIMIT = 0x30000
TAGS = (0xE0000, 0xE1000)
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN")


class Tables:
    """Lookup tables over all code points below ``LIMIT``."""

    def __init__(self) -> None:
        count, start = np.ones(LIMIT, np.int64), np.arange(LIMIT)
        pool: list[int] = list(range(LIMIT))
        self.order = np.zeros(LIMIT, np.uint8)
        pairs: dict[int, int] = {}
        for c in range(LIMIT):
            ch = chr(c)
            if 0xD800 <= c < 0xE000:
                continue
            self.order[c] = unicodedata.combining(ch)
            if c in INVISIBLE:
                count[c] = 0
                continue
            d = unicodedata.decomposition(ch)
            to = ch
            if unicodedata.category(ch) == "Zs" or ch in "\t\n\r\x0b\x0c\x85\u2028\u2029":
                to = " "
            elif d.startswith(("<wide>", "<narrow>")) or (d.startswith("<compat>") and unicodedata.category(ch)[0] in "LN"):
                to = unicodedata.normalize("NFKC", ch)
            if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", ch) == ch:
                x, y = (int(v, 16) for v in d.split())
                pairs[(x << 21) | y] = c
            if to != ch or (d and d[0] != "<") or 0xAC00 <= c < 0xD7A4:
                to = unicodedata.normalize("NFD", to)
            if to != ch:
                if len(to) == 1:
                    start[c] = ord(to)
                else:
                    start[c], count[c] = len(pool), len(to)
                    pool.extend(map(ord, to))
        for k in range(19 * 21):  # syllables of two and of three letters
            two = 0xAC00 + 28 * k
            pairs[(0x1100 + k // 21 << 21) | 0x1161 + k % 21] = two
            for t in range(1, 28):
                pairs[(two << 21) | 0x11A7 + t] = two + t
        self.count, self.start, self.pool = count, start, np.array(pool, np.uint32)
        self.keys = np.array(sorted(pairs), np.int64)
        self.composed = np.array([pairs[k] for k in self.keys.tolist()], np.uint32)
        self._letters()

    def _letters(self) -> None:
        """Look-alike letters: their Latin form, and for each script the letter of that look, or the letter itself where the script has none."""
        self.latin = np.arange(LIMIT, dtype=np.uint32)
        self.script, self.alike = np.zeros(LIMIT, np.uint8), np.zeros(LIMIT, bool)
        looks: dict[str, dict[int, int]] = {}
        for c in range(0x600):
            name = unicodedata.name(chr(c), "")
            self.script[c] = next((k for k, x in enumerate(SCRIPTS, 1) if name.startswith(x + " ")), 0)
        for ch, to in CONFUSABLE.items():
            a, b = unicodedata.normalize("NFD", ch), unicodedata.normalize("NFD", to)
            self.latin[ord(a[0])] = ord(b[0])
            if self.script[ord(b[0])]:
                looks.setdefault(b[0], {1: ord(b[0])}).setdefault(int(self.script[ord(a[0])]) or 1, ord(a[0]))
        self.member = np.tile(np.arange(LIMIT, dtype=np.uint32), (len(SCRIPTS) + 1, 1))
        for base, of in looks.items():
            everyone = {ord(base), *(ord(unicodedata.normalize("NFD", ch)[0]) for ch, to in CONFUSABLE.items() if unicodedata.normalize("NFD", to)[0] == base)}
            for c in everyone:
                self.alike[c] = True
                self.script[c] = self.script[c] or 1
                for k in range(1, len(SCRIPTS) + 1):
                    self.member[k, c] = of.get(k, c)
        for ch in "\u2010\u2011":
            self.member[:, ord(ch)] = ord("-")


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def _points(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all rows, row of each point)."""
    arr = pa.concat_arrays([arr.cast(pa.string())])
    n = len(arr)
    off = np.frombuffer(arr.buffers()[1], np.int32, n + 1 + arr.offset)[arr.offset :].astype(np.int64)
    data = np.frombuffer(arr.buffers()[2] or b"", np.uint8)[off[0] : off[-1]] if n else np.zeros(0, np.uint8)
    cp = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return cp, np.repeat(np.arange(n), np.diff(heads[off - off[0]]))


def _strings(cp: np.ndarray, row: np.ndarray, like: pa.Array) -> pa.Array:
    n = len(like)
    raw = cp.astype("<u4").tobytes().decode("utf-32-le", "replace").encode("utf-8")
    width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
    size = np.bincount(row, weights=width, minlength=n).astype(np.int64) if n else np.zeros(0, np.int64)
    off = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    out = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(off.tobytes()), pa.py_buffer(raw)])
    return pa.compute.if_else(like.is_null(), pa.scalar(None, pa.string()), out)


def _blanks(cp: np.ndarray, row: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of blanks as one space, none at a row's ends."""
    if not len(cp):
        return cp, row
    cp = np.where(blank, np.uint32(32), cp)
    keep = ~blank | np.concatenate([[False], ~blank[:-1] & (row[1:] == row[:-1])])
    cp, row, blank = cp[keep], row[keep], blank[keep]
    last = np.concatenate([row[1:] != row[:-1], [True]]) if len(row) else np.zeros(0, bool)
    keep = ~(blank & last)
    return cp[keep], row[keep]


def _safe(cp: np.ndarray) -> np.ndarray:
    """Indices into the tables; code points beyond them take a place that maps to nothing else."""
    return np.minimum(cp, LIMIT - 1).astype(np.int64)


def _expanded(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(decomposed code points of all rows, row of each)."""
    t = tables()
    cp, row = _points(arr)
    inside = cp < LIMIT
    n = np.where(inside, t.count[_safe(cp)], ((cp < TAGS[0]) | (cp >= TAGS[1])).astype(np.int64))
    first = np.where(inside, t.start[_safe(cp)], 0)
    at = np.repeat(first, n) + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
    out = np.where(np.repeat(inside, n), t.pool[np.minimum(at, len(t.pool) - 1)], np.repeat(cp, n)).astype(np.uint32)
    return out, np.repeat(row, n)


def _combining(cp: np.ndarray) -> np.ndarray:
    return np.where(cp < LIMIT, tables().order[_safe(cp)], 0).astype(np.int64)


def _composed(cp: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical order and composition. In order, a mark is blocked from its base only by a mark of its own class right before it, so each pass composes the first pair of every base."""
    t = tables()
    if len(cp) < 2:
        return cp, row
    mark = _combining(cp)
    fresh = np.concatenate([[True], row[1:] != row[:-1]])
    base = np.cumsum((mark == 0) | fresh)
    if ((mark[1:] > 0) & (mark[:-1] > mark[1:]) & (base[1:] == base[:-1])).any():
        cp = cp[np.lexsort((mark, base))]  # stable: marks of one class keep their order
        mark = _combining(cp)
    while len(cp) > 1:
        starts = np.flatnonzero(np.concatenate([[True], base[1:] != base[:-1]]))
        head = np.repeat(starts, np.diff(np.concatenate([starts, [len(cp)]])))
        inner = np.arange(len(cp)) != head
        before = np.concatenate([[-1], mark[:-1]])
        free = inner & (mark > 0) & (mark[head] == 0) & ((np.arange(len(cp)) - 1 == head) | (before < mark))
        # a base composes with the base before it only where nothing stands between
        joins = ~inner & (mark == 0) & (before == 0) & np.concatenate([[False], row[1:] == row[:-1]])
        left = np.where(inner, head, np.maximum(head - 1, 0))
        pair = (cp[left].astype(np.int64) << 21) | cp
        k = np.minimum(np.searchsorted(t.keys, pair), len(t.keys) - 1)
        hit = (free | joins) & (t.keys[k] == pair)
        at = np.flatnonzero(hit)
        if not len(at):
            break
        at = at[np.unique(left[at], return_index=True)[1]]
        at = at[~np.isin(left[at], at)]  # a base that is just being joined to another waits for the next pass
        cp = cp.copy()
        cp[left[at]] = t.composed[k[at]]
        keep = np.ones(len(cp), bool)
        keep[at] = False
        joined = np.zeros(len(cp), bool)
        joined[at] = ~inner[at]
        base = base - np.cumsum(joined)
        cp, row, mark, base = cp[keep], row[keep], mark[keep], base[keep]
    return cp, row


def unify(arr: pa.Array) -> pa.Array:
    """Each text in the form that all texts of the same look share."""
    t = tables()
    cp, row = _expanded(arr)
    cp = np.where(cp < LIMIT, t.latin[_safe(cp)], cp).astype(np.uint32)
    cp, row = _composed(cp, row)
    return _strings(*_blanks(cp, row, cp == 32), arr)


def _main_scripts(who: np.ndarray, script: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """The script of most weight for each of ``n`` groups, the first of equal ones; 0 where there is none."""
    size = len(SCRIPTS) + 1
    votes = np.bincount(who * size + script, weights=weight, minlength=n * size).reshape(n, size)
    votes[:, 0] = 0
    return np.where(votes.max(1) > 0, votes.argmax(1), 0)


def shown(arr: pa.Array) -> pa.Array:
    """Each text for readers: one form of blanks, widths and marks, and the look-alike letters of a word in its main script."""
    t = tables()
    cp, row = _expanded(arr)
    if len(cp):
        safe = _safe(cp)
        script = np.where(cp < LIMIT, t.script[safe], 0).astype(np.int64)
        alike = (cp < LIMIT) & t.alike[safe]
        inside = (script > 0) | (_combining(cp) > 0)
        word = np.cumsum(~inside | np.concatenate([[True], (row[1:] != row[:-1]) | ~inside[:-1]])) - 1
        n = int(word[-1]) + 1
        own = _main_scripts(word, script, (~alike).astype(float), n)
        text = _main_scripts(row, script, np.where(alike, 0.01, 1.0), len(arr))
        some = _main_scripts(word, script, np.ones(len(cp)), n)
        of_word = np.zeros(n, np.int64)
        of_word[word] = text[row]
        # letters of one script decide; without any, a word of one script stays in it, and a mixed one follows its text
        mixed = np.zeros(n, bool)
        mixed[word[(script > 0) & (script != some[word])]] = True
        main = np.where(own > 0, own, np.where(mixed, of_word, some))
        cp = np.where(cp < LIMIT, t.member[main[word], safe], cp).astype(np.uint32)
    cp, row = _composed(cp, row)
    return _strings(*_blanks(cp, row, cp == 32), arr)


def plain(arr: pa.Array) -> pa.Array:
    """Each text with runs of ordinary blanks (space, tab, line breaks) as one space and none at its ends; all else unchanged."""
    cp, row = _points(arr)
    return _strings(*_blanks(cp, row, np.isin(cp, np.array([9, 10, 11, 12, 13, 32], np.uint32))), arr)


def _kernel(b: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), plain(b.column(2)), unify(b.column(2))], names=["field", "book_id", "raw", "plain", "look"])


def looks(values: DataFrame) -> DataFrame:
    """(field, book_id, raw, plain, look) of ``values`` (field, book_id, raw)."""
    return arrow_map(values.where("raw is not null"), _kernel, "field string, book_id bigint, raw string, plain string, look string")


def book_values(spark, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "books")
    titles = b.select(F.lit("title").alias("field"), "book_id", F.col("title").alias("raw"))
    return titles.unionByName(b.select(F.lit("authors").alias("field"), "book_id", F.explode("authors").alias("raw")))


def p4_unify(spark, sf_dir: str) -> DataFrame:
    """Every title and author in the form that comparisons use, and whether that differs from the text as it stands."""
    tune(spark, 10_000)
    return looks(book_values(spark, sf_dir)).select("field", "book_id", "raw", F.col("look").alias("uniform"), (F.col("raw") != F.col("look")).alias("changed"))


def p4_shown(spark, sf_dir: str) -> DataFrame:
    """Every title and author in the form for readers."""
    tune(spark, 10_000)

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*b.columns, shown(b.column(2))], names=["field", "book_id", "raw", "shown"])

    return arrow_map(book_values(spark, sf_dir).where("raw is not null"), kernel, "field string, book_id bigint, raw string, shown string")


def p4_found(spark, sf_dir: str) -> DataFrame:
    """Two books with values of one look but different strings.

    Looks and strings are compared by 128-bit and 64-bit hashes. Looks with one string only are dropped after a map-side distinct, so a hot title costs one row a task
    there; the others are paired by string first, and only then with their books, so no pair of equal strings is ever formed.
    """
    tune(spark, 10_000)
    v = looks(book_values(spark, sf_dir)).where("look <> ''")
    v = v.select("field", "book_id", F.xxhash64("field", "look").alias("k1"), F.xxhash64(F.reverse("look")).alias("k2"), F.xxhash64("plain").alias("s")).distinct()
    strings = v.select("field", "k1", "k2", "s").distinct()
    groups = strings.groupBy("field", "k1", "k2").agg(F.sort_array(F.collect_set("s")).alias("all")).where(F.size("all") > 1)
    one = groups.select("field", "k1", "k2", "all", F.posexplode("all").alias("i", "s_a"))
    two = one.select("field", "k1", "k2", "s_a", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("s_b"))
    pairs = small_or_shuffled(two)
    rows = v.select(F.col("field").alias("f"), "book_id", F.col("k1").alias("x1"), F.col("k2").alias("x2"), "s")
    left = rows.withColumnRenamed("book_id", "a").join(pairs, (F.col("f") == F.col("field")) & (F.col("x1") == F.col("k1")) & (F.col("x2") == F.col("k2")) & (F.col("s") == F.col("s_a"))).select("field", "k1", "k2", "s_b", "a")
    both = left.join(rows.withColumnRenamed("book_id", "b"), (F.col("f") == F.col("field")) & (F.col("x1") == F.col("k1")) & (F.col("x2") == F.col("k2")) & (F.col("s") == F.col("s_b"))).where("a <> b")
    return both.select("field", F.least("a", "b").alias("book_id_a"), F.greatest("a", "b").alias("book_id_b")).distinct()
