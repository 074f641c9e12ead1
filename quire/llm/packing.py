"""Problem 8: texts are packed into containers of fixed capacity with little unused space.

Lengths are counted in tokens of the container's tokenizer. Only the histogram of lengths, which has at most ``capacity`` entries however many texts there are,
reaches the driver. There, exact-complement hashing plans the containers: for each open length the sums of single, pair and triple lengths are looked up by the gap they fill
exactly, and such a combination is used as often as the counts allow; what remains is packed by best fit over lengths. The plan says, for each length, which ranks go to which
containers. Ranks are given by a distributed count (rows within a partition, then offsets of partitions), so no length is collected into one task, and rank
ranges are joined back with the texts.

A text above the capacity is cut into full containers and one rest, which is packed like a text; all other texts stay whole.

Defined results: null texts are left out; empty texts have length 0 and go, in pieces of length 0, to the first container; repeated ids are packed row by row; a container
row without capacity (null or below 1) or with an unknown tokenizer is left out; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.runtime import BROADCAST_BYTES, checkpointed, collect_bounded, spread, table, tune

#: Where the vocabulary files lie, and which file stands for which named tokenizer. The vocabulary of ``cl100k_base`` is not among
#: the public files here; the multilingual byte-level vocabulary stands for it.
TOKENIZERS = "/opt/tokenizers"
FILES = {"gpt2": "byte_bpe_50k.tiktoken", "cl100k_base": "byte_bpe_multi_50k.tiktoken"}
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Ranges of one size that are searched together.
CHUNK = 64
#: Distinct pre-tokens whose counts a Python worker remembers.
MEMO = 300_000


class Counter:
    """Token counts under one or more byte-level vocabularies that share the splitting pattern; a piece's count is remembered."""

    def __init__(self, names: tuple[str, ...], folder: str) -> None:
        import base64

        import regex
        import tiktoken

        self.split = regex.compile(PATTERN)
        self.encode = []
        for n in names:
            with open(os.path.join(folder, FILES[n]), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.encode.append(tiktoken.Encoding(n, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary)
        self.memo: dict[str, int] = {}
        self.n = len(names)

    def counts(self, text: str) -> list[int]:
        """Tokens of a whole text under each vocabulary; counts of several vocabularies are added up in one packed number."""
        memo, total = self.memo, 0
        pieces = self.split.findall(text)
        try:
            total = sum(map(memo.__getitem__, pieces))
        except KeyError:
            total = 0
            for p in pieces:
                c = memo.get(p)
                if c is None:
                    c = 0
                    for k, e in enumerate(self.encode):
                        c |= len(e(p)) << (40 * k)
                    if len(memo) < MEMO and len(p) < 64:
                        memo[p] = c
                total += c
        return [(total >> (40 * k)) & ((1 << 40) - 1) for k in range(self.n)]


@lru_cache(maxsize=2)
def counter(names: tuple[str, ...], folder: str) -> Counter:
    return Counter(names, folder)


def lengths(documents: DataFrame, names: tuple[str, ...], folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, tokenizer, n_tokens): each text measured once for all tokenizers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(names, folder)
        for b in batches:
            ids, toks, ns = [], [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for name, n in zip(names, c.counts(t)):
                    ids.append(d)
                    toks.append(name)
                    ns.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(toks, pa.string()), pa.array(ns, pa.int64())], names=["doc_id", "tokenizer", "n_tokens"])

    return spread(documents.select("doc_id", "text").where("text is not null")).mapInArrow(run, "doc_id bigint, tokenizer string, n_tokens bigint")


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of one container, how many such containers)] that uses every length as often as the histogram holds it."""
    left = {n: c for n, c in histogram.items() if c > 0 and 0 < n <= capacity}
    out: list[tuple[tuple[int, ...], int]] = []
    # the open lengths as bits of one number, and the same from the capacity downwards: shifted over each other they show all pairs of a sum
    up, down = 0, 0
    for n in left:
        up |= 1 << n
        down |= 1 << (capacity - n)

    def use(combo: tuple[int, ...]) -> None:
        nonlocal up, down
        need: dict[int, int] = {}
        for x in combo:
            need[x] = need.get(x, 0) + 1
        times = min(left[x] // k for x, k in need.items())
        if times:
            for x, k in need.items():
                left[x] -= k * times
                if not left[x]:
                    del left[x]
                    up ^= 1 << x
                    down ^= 1 << (capacity - x)
            out.append((combo, times))

    order = sorted(left)

    def below(gap: int) -> Iterator[int]:
        """The open lengths up to the gap, the longest first; used-up ones are swept out of the list once they are half of it."""
        nonlocal order
        if len(order) > 2 * len(left) + 16:
            order = [x for x in order if x in left]
        held = order
        for k in range(bisect.bisect_right(held, gap) - 1, -1, -1):
            if held[k] in left:
                yield held[k]

    if capacity in left:
        use((capacity,))
    for big in sorted(left, reverse=True):
        if big not in left:
            continue
        gap = capacity - big
        if gap in left and (gap != big or left[big] >= 2):  # a single length fills the gap
            use((big, gap))
        if big not in left:
            continue
        # pairs and triples by their sums: the partner of each length is looked up under the sum that is still missing
        for x in below(gap):
            if big not in left or 2 * x < gap:
                break
            y = gap - x
            if 0 < y <= x and x in left and y in left:
                use((big, x, y))
        if big not in left:
            continue
        for x in below(gap):
            if big not in left or 3 * x < gap:
                break
            if x not in left:
                continue
            rest = gap - x
            pairs = up & (down >> (capacity - rest)) & ((2 << min(x, rest // 2)) - 1) if rest > 0 else 0
            while pairs and x in left and big in left:  # y <= z and y <= x, the longest y first
                y = pairs.bit_length() - 1
                pairs ^= 1 << y
                if y in left and rest - y in left and rest - y <= x:
                    use((big, x, rest - y, y))
                elif rest - y > x:
                    break
    # best fit of the rest: the largest length opens a container, the largest length that still fits follows; equal fillings are repeated at once
    keys = sorted(left)
    while left:
        big = keys[-1]
        if big not in left:
            keys.pop()
            continue
        combo, gap = [big], capacity - big
        taken = {big: 1}
        while gap > 0:
            k = bisect.bisect_right(keys, gap) - 1
            while k >= 0 and left.get(keys[k], 0) - taken.get(keys[k], 0) <= 0:
                k -= 1
            if k < 0:
                break
            x = keys[k]
            fits = min(gap // x, left[x] - taken.get(x, 0))
            combo += [x] * fits
            taken[x] = taken.get(x, 0) + fits
            gap -= x * fits
        before = set(left)
        use(tuple(combo))
        if len(before) != len(left):
            keys = [k for k in keys if k in left]
    return out


def ranges(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """((length, first rank, last rank, first container, items of that length in each container), ...) and the number of containers."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for combo, times in patterns:
        need: dict[int, int] = {}
        for x in combo:
            need[x] = need.get(x, 0) + 1
        for x, k in need.items():
            lo = used.get(x, 0)
            rows.append((x, lo, lo + k * times - 1, base, k))
            used[x] = lo + k * times
        base += times
    return rows, base


def ranked(pieces: DataFrame) -> DataFrame:
    """Adds ``rank``, a dense number from 0 within each (container_id, size), without collecting a size into one task.

    Rows are numbered inside partitions by size, partitions get offsets from a small table of counts by partition.
    """
    kept = checkpointed(pieces.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(256))))
    salt = kept.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(64)).cast("int"))
    w = Window.partitionBy("container_id", "size", "part", "salt").orderBy("doc_id", "piece_no")
    inner = salt.withColumn("r", F.row_number().over(w) - 1)
    counts = salt.groupBy("container_id", "size", "part", "salt").agg(F.count(F.lit(1)).alias("n"))
    w2 = Window.partitionBy("container_id", "size").orderBy("part", "salt").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn("off", F.coalesce(F.sum("n").over(w2), F.lit(0))).drop("n")
    return inner.join(offs, ["container_id", "size", "part", "salt"]).select("container_id", "doc_id", "piece_no", "size", (F.col("r") + F.col("off")).alias("rank"))


def containers(spark, sf_dir: str) -> list:
    rows = collect_bounded(table(spark, sf_dir, "containers").select("container_id", "tokenizer", "capacity_tokens"), 1000, "containers")
    return [r for r in rows if r["capacity_tokens"] and r["capacity_tokens"] > 0 and r["tokenizer"] in FILES]


def packed(spark, sf_dir: str, folder: str = TOKENIZERS) -> DataFrame:
    """(container_id, doc_id, piece_no, size, bin): every piece of every text with the number of its container."""
    tune(spark, 1000)
    schema = "container_id int, doc_id bigint, piece_no int, size bigint, bin bigint"
    kinds = containers(spark, sf_dir)
    if not kinds:
        return spark.createDataFrame([], schema)
    names = tuple(sorted({k["tokenizer"] for k in kinds}))
    measured = checkpointed(lengths(table(spark, sf_dir, "documents"), names, folder))
    shape = spark.createDataFrame([(k["container_id"], k["tokenizer"], k["capacity_tokens"]) for k in kinds], "container_id int, tok string, cap bigint")
    each = measured.join(F.broadcast(shape), F.col("tokenizer") == F.col("tok"))
    # full containers of texts above the capacity are fixed at once; only the rest takes part in the packing
    cut = each.withColumn("full", F.expr("n_tokens div cap")).withColumn("rest", F.col("n_tokens") % F.col("cap"))
    whole = cut.where("n_tokens > cap").select("container_id", "doc_id", F.explode(F.sequence(F.lit(1), F.col("full").cast("int"))).alias("piece_no"), F.col("cap").alias("size"))
    items = cut.where("n_tokens <= cap or rest > 0").select("container_id", "doc_id", F.when(F.col("n_tokens") > F.col("cap"), F.col("full") + 1).otherwise(1).cast("int").alias("piece_no"), F.when(F.col("n_tokens") > F.col("cap"), F.col("rest")).otherwise(F.col("n_tokens")).alias("size"))
    pieces = whole.unionByName(items)
    r = ranked(pieces)
    hist: dict[int, dict[int, int]] = {}
    for h in pieces.groupBy("container_id", "size").agg(F.count(F.lit(1)).alias("n")).collect():  # at most the sum of all capacities
        hist.setdefault(h["container_id"], {})[h["size"]] = h["n"]
    rows = []
    for k in kinds:
        got, _ = ranges(plan(hist.get(k["container_id"], {}), k["capacity_tokens"]))
        rows += [(k["container_id"], *x) for x in got]
        if hist.get(k["container_id"], {}).get(0):
            rows.append((k["container_id"], 0, 0, hist[k["container_id"]][0] - 1, 0, hist[k["container_id"]][0]))
    return placed(r, rows)


def placed(r: DataFrame, rows: list[tuple[int, int, int, int, int, int]]) -> DataFrame:
    """The container of each ranked piece, by joins and searches in arrays of numbers.

    ``rows`` are ranges (container_id, size, first rank, last rank, first container, pieces of that size in each container). The ranges of a size lie in chunks of ``CHUNK``: a piece
    finds its chunk among the first ranks of the chunks, and its range in the chunk. Both lists hold a few numbers for each planned range, and ranges follow from the capacities, not from
    the number of texts; they are broadcast where their bytes allow.
    """
    spark = r.sparkSession
    of: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for cid, size, lo, _, base, per in sorted(rows):
        of.setdefault((cid, size), []).append((lo, base, per))
    chunks = [(cid, size, k, v[k * CHUNK : (k + 1) * CHUNK]) for (cid, size), v in of.items() for k in range(-(-len(v) // CHUNK))]
    heads = [(cid, size, [x[0] for x in v[::CHUNK]]) for (cid, size), v in of.items()]

    def side(data: list, schema: str, numbers: int) -> DataFrame:
        t = spark.createDataFrame(data, schema)
        return F.broadcast(t) if 8 * numbers + 100 * len(data) <= BROADCAST_BYTES else t.hint("merge")

    found = lambda a, x: f"size(filter({a}, x -> x <= {x}))"
    h = side(heads, "c int, s bigint, heads array<bigint>", len(chunks))
    wide = r.join(h, (r["container_id"] == h["c"]) & (r["size"] == h["s"])).select("container_id", "doc_id", "piece_no", "size", "rank", F.expr(found("heads", "rank") + " - 1").alias("chunk"))
    t = side([(c, s, k, [x[0] for x in v], [x[1] for x in v], [x[2] for x in v]) for c, s, k, v in chunks], "c int, s bigint, k int, lo array<bigint>, base array<bigint>, per array<bigint>", 3 * len(rows))
    met = wide.join(t, (wide["container_id"] == t["c"]) & (wide["size"] == t["s"]) & (wide["chunk"] == t["k"])).withColumn("i", F.expr(found("lo", "rank")))
    return met.select("container_id", "doc_id", "piece_no", "size", F.expr("base[i - 1] + (rank - lo[i - 1]) div per[i - 1]").alias("bin"))


def p8_pack(spark, sf_dir: str) -> DataFrame:
    """Every text, whole or in pieces, with its container for each kind of container."""
    return packed(spark, sf_dir)


def p8_fill(spark, sf_dir: str) -> DataFrame:
    """(container_id, n_bins, n_tokens, fill): how full the containers of each kind are."""
    p = packed(spark, sf_dir)
    caps = table(spark, sf_dir, "containers").select(F.col("container_id").alias("c"), "capacity_tokens")
    t = p.groupBy("container_id").agg(F.max("bin").alias("last"), F.sum("size").alias("n_tokens"))
    return t.join(F.broadcast(caps), F.col("container_id") == F.col("c")).select("container_id", (F.col("last") + 1).alias("n_bins"), "n_tokens", F.round(F.col("n_tokens") / ((F.col("last") + 1) * F.col("capacity_tokens")), 6).alias("fill"))
