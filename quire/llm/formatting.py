"""Problem 7: records that differ only in formatting are collapsed into one, with the number of copies.

A record's canonical bytes hold its title, its authors' name parts in sorted order, and its ISBN without case, blanks and punctuation. Equal keys are
first added up inside each task (``HELD`` distinct keys at a time), so a hot group costs a row or few a task. The keys are then split recursively by their leading bytes: a prefix with more
keys than a bucket may hold is split by the bytes that follow what all its keys have in common, until each part fits; neighbouring small parts share a bucket. Each bucket is a partition of its own
and is counted in a burst trie whose terminals hold the smallest id and the number of copies.

Defined results: records without id or without title (null or blank) are left out; null and blank ISBNs agree only with each other; a null author list, an empty one
and one of blank names agree; repeated ids count as one copy each; nothing but case, blanks, punctuation and order is ignored; extra columns are ignored.
"""

from __future__ import annotations

import os
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.runtime import arrow_map, checkpointed, ship, table, tune

#: Keys that one bucket may hold: bounds the memory of the task that counts it.
CAPACITY = 200_000
#: Bytes by which an oversized prefix is extended beyond what its keys have in common.
STEP = 2
#: Distinct keys that a task holds while it adds up repeats.
HELD = 100_000


def folded(c: Column) -> Column:
    """Lower case in which letters with a longer capital form agree with it (the optimizer would drop a detour by upper case)."""
    out = F.lower(c)
    for a, b in (("ß", "ss"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ς", "σ")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def squeezed(c: Column) -> Column:
    return F.regexp_replace(folded(c), r"[\p{P}\p{Z}\s\x00-\x1F\x7F-\x9F]+", "")


def canonical(title: Column, authors: Column, isbn: Column) -> Column:
    """The canonical bytes of a record, as a binary column."""

    def name(a: Column) -> Column:
        parts = F.split(F.regexp_replace(F.regexp_replace(folded(a), r"['’‘`]", ""), r"[\p{P}\p{Z}\s\x00-\x1F\x7F-\x9F]+", " "), " ")
        return F.array_join(F.array_sort(F.filter(parts, lambda p: p != "")), " ")

    names = F.array_sort(F.filter(F.transform(F.filter(F.coalesce(authors, F.array().cast("array<string>")), lambda a: a.isNotNull()), name), lambda n: n != ""))
    return F.encode(F.concat_ws("\u001f", squeezed(title), F.array_join(names, "\u001e"), F.coalesce(squeezed(isbn), F.lit(""))), "UTF-8")


def keyed(t: DataFrame) -> DataFrame:
    titled = t.where("book_id is not null").where(F.regexp_replace("title", r"[\p{Z}\s]+", "") != "")
    return titled.select("book_id", canonical(F.col("title"), F.col("authors"), F.col("isbn")).alias("key"))


class Trie:
    """A burst trie over bytes: inner nodes branch on chunks of ``WIDTH`` bytes, a leaf holds one rest with its counters until another rest bursts it."""

    WIDTH = 6
    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, key: bytes, low: int, n: int) -> None:
        node, at, w = self.root, 0, self.WIDTH
        while True:
            chunk = key[at : at + w]
            at += w
            got = node.get(chunk)
            rest = key[at:]
            if got is None:
                node[chunk] = [rest, low, n]
                return
            if isinstance(got, list):
                if got[0] == rest:
                    got[1] = min(got[1], low)
                    got[2] += n
                    return
                inner: dict = {}
                inner[got[0][:w]] = [got[0][w:], got[1], got[2]]
                node[chunk] = got = inner
            node = got

    def terminals(self, prefix: bytes = b"", node: dict | None = None) -> Iterator[tuple[bytes, int, int]]:
        stack = [(prefix, node if node is not None else self.root)]
        while stack:
            p, d = stack.pop()
            for chunk, got in d.items():
                if isinstance(got, dict):
                    stack.append((p + chunk, got))
                else:
                    yield p + chunk + got[0], got[1], got[2]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal keys of a task added up; when ``HELD`` keys are held, they are passed on."""
    t: dict[bytes, list] = {}

    def held() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(t), pa.binary()), pa.array([v[0] for v in t.values()], pa.int64()), pa.array([v[1] for v in t.values()], pa.int64())], names=["key", "low", "n"])

    for b in batches:
        for i, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            got = t.get(k)
            if got is None:
                t[k] = [i, 1]
            else:
                got[0] = min(got[0], i)
                got[1] += 1
        if len(t) >= HELD:
            yield held()
            t = {}
    if t:
        yield held()


def _extensions(open_: list[tuple[bytes, int]]):
    """Counts, inside a task, the extensions of the open prefixes: (prefix number, extension, rows, smallest key, largest key)."""
    prefixes, depths = [p for p, _ in open_], [d for _, d in open_]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t: dict[tuple[int, bytes], list] = {}

        def held() -> pa.RecordBatch:
            cols = ([k[0] for k in t], [k[1] for k in t], [v[0] for v in t.values()], [v[1] for v in t.values()], [v[2] for v in t.values()])
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.binary()))], names=["open", "p", "n", "lo", "hi"])

        for b in batches:
            for k in b.column(0).to_pylist():
                i = bisect_right(prefixes, k) - 1
                if i < 0 or not k.startswith(prefixes[i]):
                    continue
                at = (i, k[: depths[i]])
                got = t.get(at)
                if got is None:
                    t[at] = [1, k, k]
                else:
                    got[0] += 1
                    if k < got[1]:
                        got[1] = k
                    elif k > got[2]:
                        got[2] = k
            if len(t) >= HELD:
                yield held()
                t = {}
        if t:
            yield held()

    return kernel


def splits(keys: DataFrame, capacity: int) -> list[bytes]:
    """Lower bounds of the buckets, found by splitting oversized prefixes by further bytes.

    Each round counts the extensions of the prefixes that are still oversized and adds neighbouring small ones up to buckets, both distributed; an open prefix has at most
    65536 extensions. The driver gets a bound for each bucket and the oversized prefixes, both at most twice total / capacity in number, never keys. The smallest and the largest key of a
    prefix show how many bytes all its keys share, so a long common beginning costs no rounds. A single key that is oversized by its repeats in many tasks is not split further.
    """
    bounds: list[bytes] = []
    open_: list[tuple[bytes, int]] = [(b"", STEP)]
    while open_:
        got = keys.select("key").mapInArrow(_extensions(open_), "open int, p binary, n bigint, lo binary, hi binary")
        got = got.groupBy("open", "p").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        got = got.withColumn("big", (F.col("n") > capacity) & (F.col("lo") != F.col("hi")))
        w = Window.partitionBy("open").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
        got = got.withColumns({"runs": F.sum(F.col("big").cast("int")).over(w), "sum": F.sum(F.when(~F.col("big"), F.col("n")).otherwise(0)).over(w)})
        shared = got.groupBy("open", "big", "runs", F.when(F.col("big"), F.lit(0)).otherwise(F.floor((F.col("sum") - F.col("n")) / F.lit(capacity))).alias("part"))
        rows = shared.agg(F.min("p").alias("p"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
        nxt = []
        for r in rows:
            bounds.append(bytes(r["p"]))
            if r["big"]:
                common = os.path.commonprefix([bytes(r["lo"]), bytes(r["hi"])])
                nxt.append((common, len(common) + STEP))
        open_ = sorted(nxt)
    return sorted(set(bounds)) or [b""]


def groups(records: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(key, low, n): each distinct canonical record with its smallest id and its number of copies. ``records`` has ``book_id`` and ``key``."""
    ship(records.sparkSession)
    keys = checkpointed(records.select("book_id", "key").mapInArrow(_local, "key binary, low bigint, n bigint"))
    total = keys.count()
    cores = max(1, keys.sparkSession.sparkContext.defaultParallelism)
    bounds = splits(keys, min(capacity, max(10_000, total // (2 * cores))))

    def bucket(b: pa.RecordBatch) -> pa.RecordBatch:
        k = b.column(0).to_pylist()
        return pa.RecordBatch.from_arrays([pa.array([max(0, bisect_right(bounds, x) - 1) for x in k], pa.int32()), b.column(0), b.column(1), b.column(2)], names=["bucket", "key", "low", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Trie()
        for b in batches:
            for k, low, n in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                t.add(k, low, n)
        rows: tuple[list, list, list] = ([], [], [])
        for terminal in t.terminals():
            for r, x in zip(rows, terminal):
                r.append(x)
            if len(rows[0]) == 10_000:
                yield _rows(rows)
                rows = ([], [], [])
        yield _rows(rows)

    placed = arrow_map(keys, bucket, "bucket int, key binary, low bigint, n bigint")
    return placed.repartitionById(len(bounds), "bucket").mapInArrow(count, "key binary, low bigint, n bigint")


def _rows(rows: tuple[list, list, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, (pa.binary(), pa.int64(), pa.int64()))], names=["key", "low", "n"])


def p7_groups(spark, sf_dir: str) -> DataFrame:
    """(book_id, n_copies): one record per group of copies, records without copies included."""
    tune(spark, 20_000)
    t = table(spark, sf_dir, "books").select("book_id", "title", "authors", "isbn")
    return groups(keyed(t)).select(F.col("low").alias("book_id"), F.col("n").alias("n_copies"))


def p7_found(spark, sf_dir: str) -> DataFrame:
    """The smallest id of each group of copies with each other member. The join's one side has each key once, so a hot key can be split on the other."""
    tune(spark, 20_000)
    records = keyed(table(spark, sf_dir, "books").select("book_id", "title", "authors", "isbn"))
    repeated = groups(records).where("n > 1").select(F.col("key").alias("g_key"), F.col("low").alias("book_id_a"))
    return records.join(repeated, F.col("key") == F.col("g_key")).where("book_id <> book_id_a").select("book_id_a", F.col("book_id").alias("book_id_b"))
