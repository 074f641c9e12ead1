"""Problem 3: several values packed in one field become one row per value with its position.

The scan works on Arrow string buffers: quote parity comes from a running count of quote bytes inside each element, delimiter masks from byte
comparisons (a shifted comparison for delimiters of several bytes or words), and both give child offsets from which list arrays are built without
a per-row string call. What a separator sign means is then decided from the corpus: pieces and joined runs of pieces are hash-joined with the
counts of all elements, and a heading, firm or inverted name that contains a separator stays one value.

Defined results: null and blank elements and empty pieces give no value; quoted pieces lose their quotes, doubled quotes become one; an unclosed quote
is an ordinary character; elements of one value give one row in ``unpacked`` and none in ``p3_found``; repeated values keep their own rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.runtime import arrow_map, checkpointed, table, tune

# Delimiters. Hard ones always end a value; soft ones also occur inside headings and names.
HARD = (";", "|", "\n", "\t", "•", "·", "、", "；", "｜")
SOFT = (",", "/", "&", "，", "／")
WORDS = ("and", "und", "et", "with", "mit", "y", "e", "og", "och", "en", "avec", "con")
BLANKS = b" \t\r\n\x0b\x0c"
#: How often the corpus must hold joined pieces as a whole element for them to be one value.
OFTEN = 3
PATTERN = "[;|\\n\\t•·、；｜,/&，／]|\\s(" + "|".join(WORDS) + ")\\s"


def scan(elements: pa.Array, words: bool) -> tuple[pa.ListArray, pa.ListArray, pa.ListArray]:
    """For each element its pieces (trimmed, unquoted), the delimiter class before each piece (0 none, 1 soft, 2 hard), and whether it was quoted."""
    arr = pa.concat_arrays([elements.cast(pa.string())])
    n = len(arr)
    off = np.frombuffer(arr.buffers()[1], np.int32, n + 1 + arr.offset)[arr.offset :].astype(np.int64)
    data = np.frombuffer(arr.buffers()[2] or b"", np.uint8)[off[0] : off[-1]] if n else np.zeros(0, np.uint8)
    off = off - off[0]
    size = len(data)
    pad = np.concatenate([data, np.zeros(8, np.uint8)])
    at = lambda k: pad[k : k + size]
    owner = np.repeat(np.arange(n), np.diff(off))
    # quote parity inside each element; an element with an odd number of quotes has none that count
    quote = data == 34
    run = np.concatenate([[0], np.cumsum(quote)])
    total = run[off[1:]] - run[off[:-1]]
    odd = (total & 1).astype(bool)
    inside = ((run[:-1] - run[off[:-1]][owner]) & 1).astype(bool) & ~odd[owner] if size else np.zeros(0, bool)
    kind, width = np.zeros(size, np.int8), np.zeros(size, np.int64)
    for signs, cls in ((HARD, 2), (SOFT, 1)):
        for s in signs:
            b = s.encode()
            hit = np.ones(size, bool)
            for k, x in enumerate(b):
                hit &= at(k) == x
            hit &= ~inside
            kind[hit], width[hit] = cls, len(b)
    if words and size:
        blank = np.isin(data, np.frombuffer(BLANKS, np.uint8))
        before = np.concatenate([[False], blank[:-1]])
        blanks = np.concatenate([blank, np.zeros(8, bool)])
        low = np.where((data >= 65) & (data <= 90), data + 32, data)
        lows = np.concatenate([low, np.zeros(8, np.uint8)])
        for w in WORDS:
            b = w.encode()
            hit = before & blanks[len(b) : len(b) + size] & ~inside & (kind == 0)
            for k, x in enumerate(b):
                hit &= lows[k : k + size] == x
            kind[hit], width[hit] = 1, len(b)
    # child offsets: a piece begins at each element's start and behind each delimiter, and ends at the next delimiter or the element's end
    cut = np.flatnonzero(kind)
    start = np.concatenate([off[:-1], cut + width[cut]])
    cls = np.concatenate([np.zeros(n, np.int8), kind[cut]])
    who = np.concatenate([np.arange(n), owner[cut]])
    order = np.lexsort((start, who))
    start, cls, who = start[order], cls[order], who[order]
    last = np.concatenate([who[1:] != who[:-1], [True]]) if len(who) else np.zeros(0, bool)
    ends = np.empty(len(start), np.int64)
    seq = np.flatnonzero(~last)
    ends[last] = off[1:][who[last]]
    ends[seq] = cut[np.argsort(np.lexsort((cut, owner[cut])), kind="stable")] if len(cut) else ends[seq]
    start = np.minimum(start, ends)
    # pieces lie in rising order without overlap: offsets over starts and ends in turn give pieces at even places and separators at odd ones
    bounds = np.stack([start, ends], 1).reshape(-1).astype(np.int32)
    both = pa.Array.from_buffers(pa.binary(), max(0, len(bounds) - 1), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(data.tobytes())])
    piece = both.take(pa.array(np.arange(0, len(bounds), 2))).cast(pa.string())
    trimmed = pc.utf8_trim_whitespace(piece)
    quoted = pc.and_(pc.and_(pc.starts_with(trimmed, '"'), pc.ends_with(trimmed, '"')), pc.greater(pc.utf8_length(trimmed), 1))
    bare = pc.utf8_trim_whitespace(pc.replace_substring(pc.utf8_slice_codeunits(trimmed, 1, -1), '""', '"'))
    value = pc.if_else(quoted, bare, trimmed)
    lists = np.concatenate([np.searchsorted(who, np.arange(n)), [len(who)]]).astype(np.int32)
    of = lambda v: pa.ListArray.from_arrays(pa.array(lists, pa.int32()), v)
    return of(value), of(pa.array(cls, pa.int8())), of(quoted)


def normal(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, "\\s+", " ")))


def _spans_kernel(words: bool, sizes: frozenset[int]):
    """Every piece, and every run of neighbouring pieces of a size that some recurring whole element has."""
    most = max(sizes, default=1)

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        elem = b.column(0)
        value, cls, quoted = scan(elem, words)
        out = ([], [], [], [])
        for e, vs, cs, qs in zip(elem.to_pylist(), value.to_pylist(), cls.to_pylist(), quoted.to_pylist()):
            keep = [(v, c, q) for v, c, q in zip(vs, cs, qs) if v]
            for i in range(len(keep)):
                text = ""
                for j in range(i, min(len(keep), i + most)):
                    if j > i and (keep[j][1] == 2 or keep[j][2] or keep[j - 1][2]):
                        break
                    p = keep[j][0]
                    text = p if j == i else text + "\x00" + p
                    if j > i and j - i + 1 not in sizes:
                        continue
                    for o, x in zip(out, (e, i, j, text.lower())):
                        o.append(x)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.string())], names=["element", "i", "j", "span"])

    return kernel


def span_key(c: Column, words: bool) -> Column:
    """An element with its separators turned into one sign, to compare it with joined pieces."""
    soft = "\\s*[,/&，／]\\s*" + ("|\\s+(?:" + "|".join(WORDS) + ")\\s+" if words else "")
    return F.regexp_replace(F.lower(F.trim(c)), soft, "\u0000")


def _easy(flat: pa.Array, cls: np.ndarray, parent: np.ndarray, n: int, names: bool, decided: np.ndarray) -> np.ndarray:
    """Elements that need no search: no separator in them is soft, or the corpus knows every piece alone and no run of them as a whole (``decided``) and, in fields of
    names, no piece could be part of an inverted name or an addition to one.
    """
    soft = np.zeros(n, bool)
    soft[parent[cls == 1]] = True
    if names:
        whole = pc.and_(pc.match_substring_regex(flat, r"\s"), pc.invert(pc.match_substring_regex(flat, r"^\d")))
        part = np.zeros(n, bool)
        part[parent[~np.asarray(whole)]] = True
        decided = decided & ~part
    return ~soft | decided


def _choose(names: bool):
    """Decides each element. Those that need no search are flattened with their parents' ordinals; for the others the cheapest cover of the pieces by values is searched."""

    def name_like(v: str) -> bool:
        return len(v.split()) >= 2 or "." in v

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        elems = b.column(b.schema.get_field_index("element"))
        value, cls, quoted = scan(elems, names)
        # pieces that are not empty, as one array with the ordinal of their element and their number inside it
        flat, parent = value.flatten(), np.asarray(pc.list_parent_indices(value))
        full = np.asarray(pc.not_equal(flat, "")) if len(flat) else np.zeros(0, bool)
        flat, parent, kinds = flat.filter(pa.array(full)), parent[full], np.asarray(cls.flatten())[full]
        head = np.concatenate([[True], parent[1:] != parent[:-1]]) if len(parent) else np.zeros(0, bool)
        kinds = np.where(head, 0, kinds)  # what stands before the first piece separates nothing
        number = np.arange(len(parent)) - np.repeat(np.flatnonzero(head), np.diff(np.concatenate([np.flatnonzero(head), [len(parent)]]))) + 1
        sizes = np.bincount(parent, minlength=len(elems))
        alone = b.column(b.schema.get_field_index("alone")).fill_null(0).to_numpy(zero_copy_only=False)
        joined = b.column(b.schema.get_field_index("joined")).fill_null(False).to_numpy(zero_copy_only=False)
        easy = _easy(flat, kinds, parent, len(elems), names, (alone == sizes) & ~joined if not names else ~joined)
        pick = easy[parent]
        done = pa.RecordBatch.from_arrays([elems.take(pa.array(parent[pick])), pa.array(number[pick].astype(np.int32)), flat.filter(pa.array(pick))], names=["element", "item_no", "value"])
        hard = pa.array(~easy)
        elems, value, cls, quoted = (x.filter(hard) for x in (elems, value, cls, quoted))
        known = b.column(b.schema.get_field_index("known")).filter(hard).to_pylist()
        out = ([], [], [])
        for e, vs, cs, qs, ks in zip(elems.to_pylist(), value.to_pylist(), cls.to_pylist(), quoted.to_pylist(), known):
            keep = [(v, c, q) for v, c, q in zip(vs, cs, qs) if v]
            n = len(keep)
            if not n:
                continue
            have = {(k["i"], k["j"]): (k["alone"], k["whole"]) for k in ks or []}
            seen = lambda i: sum(have.get((i, i), (0, 0)))
            best, back = [0.0] + [1e9] * n, [0] * (n + 1)
            long: dict[int, list[int]] = {}
            for (i, j), (_, whole) in have.items():
                if j - i >= 4 and whole >= OFTEN:
                    long.setdefault(i, []).append(j)
            for i in range(n):
                # joins that the corpus does not hold are dearer the longer they are: beyond four pieces they never win
                for j in [*range(i, min(n, i + 4)), *sorted(long.get(i, ()))]:
                    if j > i and (keep[j][1] == 2 or keep[j][2] or keep[j - 1][2]):
                        break
                    if j == i:
                        cost = 0.0 if keep[i][2] or seen(i) > 0 else (0.2 if names and name_like(keep[i][0]) else 1.0)
                    else:
                        parts = range(i, j + 1)
                        whole = have.get((i, j), (0, 0))[1]
                        strange = sum(1 for k in parts if seen(k) * 20 < whole or seen(k) == 0)
                        if names and j == i + 1 and len(keep[i][0].split()) == 1 and not keep[i][0].endswith(".") and _comma(e, keep[i][0], keep[j][0]):
                            cost = 0.05  # an inverted name
                        elif names and j == i + 2 and len(keep[i][0].split()) == 1 and keep[j][0][:1].isdigit():
                            cost = 0.0  # an inverted name with its dates
                        elif names and j == i + 1 and (keep[j][0][:1].isdigit() or keep[j][0].rstrip(".").lower() in ("jr", "sr", "phd", "md", "ltd", "inc", "gmbh", "ed", "eds")):
                            cost = 0.0
                        elif whole >= OFTEN and strange:
                            cost = 0.0
                        elif names and strange and not all(name_like(keep[k][0]) for k in parts):
                            cost = 0.9 + (j - i - 1)
                        elif not names and strange:
                            cost = 0.9 + (j - i - 1)
                        else:
                            cost = 5.0
                    if best[i] + cost + 1e-6 * (n - (j - i)) < best[j + 1]:
                        best[j + 1], back[j + 1] = best[i] + cost + 1e-6 * (n - (j - i)), i
            cuts, k = [], n
            while k:
                cuts.append((back[k], k - 1))
                k = back[k]
            cuts.reverse()
            vals = _texts(e, keep, cuts)
            for no, v in enumerate(vals, 1):
                for o, x in zip(out, (e, no, v)):
                    o.append(x)
        rest = pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string())], names=["element", "item_no", "value"])
        return pa.Table.from_batches([done, rest]).combine_chunks().to_batches()[0] if len(done) + len(rest) else rest

    return kernel


def _comma(element: str, a: str, b: str) -> bool:
    k = element.find(a)
    rest = element[k + len(a) :].lstrip() if k >= 0 else ""
    return rest[:1] in (",", "，")


def _texts(element: str, keep: list, cuts: list) -> list[str]:
    """Values of the chosen cover; joined pieces keep the element's own text between them."""
    out, pos = [], 0
    where = []
    for v, _, q in keep:
        raw = v.replace('"', '""') if q else v
        k = element.find(raw, pos)
        k = pos if k < 0 else k
        where.append((k, k + len(raw)))
        pos = k + len(raw)
    for i, j in cuts:
        out.append(keep[i][0] if i == j else element[where[i][0] : where[j][1]].strip())
    return out


def unpacked(elements: DataFrame, names: bool, alone: DataFrame | None = None) -> DataFrame:
    """(element, item_no, value) for each distinct element of ``elements`` (column ``element``) that holds a separator sign.

    Distinct elements are counted first (map-side combine), so a hot element is decided once; all joins are on its text or its pieces' texts.
    """
    counts = checkpointed(elements.where("element is not null and trim(element) <> ''").groupBy("element").agg(F.count(F.lit(1)).alias("n")))
    sep = F.col("element").rlike(PATTERN) | F.col("element").contains('"')
    single = counts.where(~sep).select(normal(F.col("element")).alias("key"), "n")
    if alone is not None:
        single = single.unionByName(alone)
    single = single.groupBy("key").agg(F.sum("n").alias("alone"))
    packed = counts.where(sep)
    wholes = packed.select(span_key(F.col("element"), names).alias("key"), "n").groupBy("key").agg(F.sum("n").alias("whole"))
    known = single.select("key", "alone", F.lit(0).cast("bigint").alias("whole")).unionByName(wholes.select("key", F.lit(0).cast("bigint").alias("alone"), "whole"))
    known = known.groupBy("key").agg(F.sum("alone").alias("alone"), F.sum("whole").alias("whole"))
    pieces = F.length("key") - F.length(F.replace("key", F.lit("\u0000"))) + 1
    sizes = frozenset(r[0] for r in wholes.where(f"whole >= {OFTEN}").select(pieces).distinct().collect())  # numbers of pieces, at most as many as the longest element has
    spans = arrow_map(packed.select("element"), _spans_kernel(names, sizes), "element string, i int, j int, span string")
    hits = spans.join(known, spans.span == known.key).groupBy("element").agg(
        F.collect_list(F.struct("i", "j", "alone", "whole")).alias("known"), F.count_if(F.expr("i = j and alone + whole > 0")).alias("alone"), F.bool_or(F.expr(f"i < j and whole >= {OFTEN}")).alias("joined")
    )
    decided = packed.select("element").join(hits.withColumnRenamed("element", "e"), F.col("element") == F.col("e"), "left").select("element", "known", "alone", "joined")
    return arrow_map(decided, _choose(names), "element string, item_no int, value string")


def exploded(spark, sf_dir: str, field: str) -> DataFrame:
    """(book_id, pos, element) of one packed field, positions from 1."""
    if field == "subjects":
        t = table(spark, sf_dir, "books").select("book_id", F.posexplode("subjects").alias("p", "element"))
    else:
        t = table(spark, sf_dir, "opf_metadata").select("book_id", F.posexplode("creators").alias("p", "element"))
    return t.select("book_id", (F.col("p") + 1).cast("int").alias("pos"), "element")


def _values(spark, sf_dir: str, field: str) -> DataFrame:
    rows = exploded(spark, sf_dir, field)
    extra = None
    if field == "creators":
        a = table(spark, sf_dir, "books").select(F.explode("authors").alias("element")).where("trim(element) <> ''").where(~F.col("element").rlike(PATTERN))
        extra = a.select(normal(F.col("element")).alias("key"), F.lit(1).cast("bigint").alias("n"))
    got = unpacked(rows.select("element"), field == "creators", extra)
    return rows.join(got.withColumnRenamed("element", "e"), F.col("element") == F.col("e"))


def p3_unpack(spark, sf_dir: str) -> DataFrame:
    """Every value of every element with book, element position and position inside the element."""
    tune(spark)
    out = []
    for field in ("subjects", "creators"):
        rows = exploded(spark, sf_dir, field).where("element is not null and trim(element) <> ''")
        many = _values(spark, sf_dir, field).select("book_id", F.lit(field).alias("field"), "pos", "item_no", "value")
        sep = F.col("element").rlike(PATTERN) | F.col("element").contains('"')
        one = rows.where(~sep).select("book_id", F.lit(field).alias("field"), "pos", F.lit(1).alias("item_no"), F.trim("element").alias("value"))
        out += [many, one]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def p3_found(spark, sf_dir: str) -> DataFrame:
    """One row per value inside an element of two or more values."""
    tune(spark)
    out = None
    for field in ("subjects", "creators"):
        v = _values(spark, sf_dir, field).where("item_no > 1").groupBy("book_id", "pos").agg(F.max("item_no").alias("m"))
        v = v.select("book_id", F.lit(field).alias("field"), "pos", F.explode(F.sequence(F.lit(1), F.col("m"))).alias("item_no"))
        out = v if out is None else out.unionByName(v)
    return out.select("book_id", "field", "pos", "item_no")
