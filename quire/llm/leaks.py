"""Problem 9: evaluation texts leaking into training text.

A generalised suffix automaton is built over the normalised words of all test passages and questions. Each document's words stream through it; the
length of the current match is tracked, and at every word the state and its suffix links give each place of the test items where a run of at least the item's
seed ends, and so an alignment. Along each alignment words are compared, so single exchanged words are bridged: a leak is a stretch of at least ``WORDS`` words that begins and
ends with equal words and holds at most one other word in ten, or a whole passage or question under the same rule; every stretch that no longer one contains is reported. Seeds follow
from these limits: twenty words with two exchanged ones hold an equal run of six (``SEED``), a whole item of ten words with one exchanged a run of five.

Normalised are case, punctuation, blanks, line breaks, hyphens (also at line ends), quote marks at line starts, HTML escapes and composition.
Only words of the test items take part in a run, so stretches of other words are skipped by a vectorised scan. The items are a stated query set of at most ``ITEMS`` rows;
documents are never collected. One automaton holds ``BLOCK`` items. Where there are more, one pass over the corpus keeps the documents that hold a run which the Bloom filter of all
items' seeds knows (no leak is without one, so none is lost), and only those few pass the automata of the blocks.

``p9_clean`` cuts the leaked stretches out of the original text and drops a document (``clean_text`` null) if more than ``COVERAGE`` of its words are leaked.

Defined results: null and blank documents and items have no leaks; repeated items are reported under each of their ids; a document that holds an item
several times is reported once for it, with all spans in ``p9_spans``; repeated document ids are judged row by row; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.runtime import arrow_map, checkpointed, collect_bounded, spread, table, tune

WORDS, OTHER = 20, 10
SEED = 6
#: Test items in one automaton; about 25 MB in each Python worker.
BLOCK = 2000
#: Test items in all; they pass through the driver.
ITEMS = 1_000_000
#: Bits of the filter over the seeds of all items: 32 MB. More seeds than it was made for pass more documents on, and lose none.
FILTER_BITS = 1 << 28
#: Share of leaked words beyond which ``p9_clean`` drops a document.
COVERAGE = 0.5
_WORD = re.compile(r"[^\W_]+")
_HYPHEN = re.compile(r"(?<=\w)[-‐‑­](?:[ \t]*\r?\n[ \t>|»*#]*)?(?=\w)")


def words(text: str | None) -> list[str]:
    """Normalised words of a text."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = _HYPHEN.sub("", text)
    return _WORD.findall(text.lower())


#: A character with the marks and letters that composition may join to it.
_CLUSTER = regex.compile(r"(?s).[\p{M}\u1160-\u11FF\uFF9E-\uFFDC]*")


def located(text: str) -> list[tuple[str, int, int]]:
    """The words of ``words`` with the places (start, end) in the original text that they come from."""
    out: list[str] = []
    at: list[tuple[int, int]] = []
    # every step maps characters to the stretch of the text that they came from
    for m in regex.finditer(r"&(?:#\d+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);?|(?s).", text):
        for c in html.unescape(m[0]) if m[0][0] == "&" else m[0]:
            out.append(c)
            at.append(m.span())
    folded: list[str] = []
    places: list[tuple[int, int]] = []
    for m in _CLUSTER.finditer("".join(out)):
        for c in unicodedata.normalize("NFKC", m[0]):
            folded.append(c)
            places.append((at[m.start()][0], at[m.end() - 1][1]))
    whole = "".join(folded)
    dropped = np.zeros(len(whole) + 1, bool)
    for m in _HYPHEN.finditer(whole):
        dropped[m.start() : m.end()] = True
    low: list[str] = []
    where: list[tuple[int, int]] = []
    for c, p, d in zip(whole, places, dropped):
        if not d:
            for x in c.lower():
                low.append(x)
                where.append(p)
    return [(m[0], where[m.start()][0], where[m.end() - 1][1]) for m in _WORD.finditer("".join(low))]


class Automaton:
    """Suffix automaton over several sequences of word numbers; each state knows where one of its strings ends, and its suffix-link children the rest."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len, self.end = [-1], [0], [(-1, -1)]
        for k, seq in enumerate(sequences):
            last = 0
            for i, c in enumerate(seq):
                last = self._extend(last, c, (k, i))
        self.kids: list[list[int]] = [[] for _ in self.next]
        for s, p in enumerate(self.link):
            if p >= 0:
                self.kids[p].append(s)

    def _state(self, length: int, link: int, end: tuple[int, int], nxt: dict[int, int]) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.len.append(length)
        self.end.append(end)
        return len(self.next) - 1

    def _extend(self, last: int, c: int, end: tuple[int, int]) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            if self.len[q] == self.len[last] + 1:
                # the state exists from an earlier sequence: a leaf state marks this further end
                self._state(self.len[q], q, end, {})
                return q
            clone = self._split(last, q, c)
            self._state(self.len[clone], clone, end, {})
            return clone
        new = self._state(self.len[last] + 1, 0, end, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, q, c)
        return new

    def _split(self, p: int, q: int, c: int) -> int:
        clone = self._state(self.len[p] + 1, self.link[q], (-1, -1), dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def ends(self, state: int, length: int, need: list[int]) -> list[tuple[int, int]]:
        """(sequence, position) of the places where the state's strings end, without branches in which every sequence ``need``s more words than ``length``."""
        out, stack = [], [state]
        while stack:
            s = stack.pop()
            if need[s] <= length:
                if self.end[s][0] >= 0:
                    out.append(self.end[s])
                stack.extend(self.kids[s])
        return out

    def least(self, seeds: list[int]) -> list[int]:
        """For each state the smallest seed of the sequences that its strings end in."""
        need = [seeds[k] if k >= 0 else 1 << 30 for k, _ in self.end]
        for s in sorted(range(1, len(self.link)), key=lambda s: (self.len[s], s), reverse=True):  # children before their parents
            p = self.link[s]
            need[p] = min(need[p], need[s])
        return need


def seed(n: int) -> int:
    """Words of the equal run that every leak of an item of ``n`` words holds."""
    return SEED if n >= WORDS else -(-(n - n // OTHER) // (n // OTHER + 1))


class Index:
    def __init__(self, items: tuple[tuple[int, str, str], ...]) -> None:
        self.number: dict[str, int] = {}
        self.owner, self.seqs = [], []
        for item, *texts in items:
            for t in texts:
                w = words(t)
                if w:
                    self.owner.append(item)
                    self.seqs.append([self.number.setdefault(x, len(self.number) + 1) for x in w])
        self.arrays = [np.array(s, np.int32) for s in self.seqs]
        self.automaton = Automaton(self.seqs)
        self.seeds = [seed(len(x)) for x in self.seqs]
        self.need = self.automaton.least(self.seeds)
        self.shortest = min([SEED, *self.seeds])

    def spans(self, doc: list[str]) -> list[tuple[int, int, int]]:
        """(item, first word, words) of the document's leaks, all stretches of each item and alignment."""
        get = self.number.get
        ids = np.fromiter((get(w, 0) for w in doc), np.int32, len(doc))
        known = np.concatenate([[0], (ids > 0).view(np.int8), [0]])
        edge = np.flatnonzero(np.diff(known))
        found: list[tuple[int, int, int]] = []
        seen: set[tuple[int, int]] = set()
        a = self.automaton
        for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if hi - lo < self.shortest:
                continue
            state = length = 0
            run = ids[lo:hi].tolist()
            for i, c in enumerate(run):
                while state and c not in a.next[state]:
                    state = a.link[state]
                    length = a.len[state]
                if c in a.next[state]:
                    state = a.next[state][c]
                    length += 1
                else:
                    state = length = 0
                # an item may end here, or go on otherwise, while a longer match with another one lasts
                s, n = state, length
                while n >= self.shortest:
                    if n >= self.need[s]:
                        self._align(ids, lo + i, s, n, seen, found)
                    s = a.link[s]
                    n = a.len[s]
        return found

    def _align(self, ids: np.ndarray, last: int, state: int, length: int, seen: set, found: list) -> None:
        for k, at in self.automaton.ends(state, length, self.need):
            seq = self.arrays[k]
            shift = last - at
            if length < self.seeds[k] or (k, shift) in seen:
                continue
            seen.add((k, shift))
            lo, hi = max(0, -shift), min(len(seq), len(ids) - shift)
            same = seq[lo:hi] == ids[lo + shift : hi + shift]
            found += [(self.owner[k], lo + shift + first, n) for first, n in self._stretches(same, len(seq))]

    @staticmethod
    def _stretches(same: np.ndarray, whole: int) -> list[tuple[int, int]]:
        """(first, words) of the stretches that begin and end with equal words and hold at most one other word in ``OTHER``, without those inside longer ones."""
        at = np.flatnonzero(same)
        other = np.concatenate([[0], np.cumsum(~same)])
        out, reached = [], -1
        # a stretch of n words may hold n // OTHER others: with score OTHER * others - n falling over a stretch, compare each start with later ends
        for k, i in enumerate(at.tolist()):
            ends = at[k:]
            n = ends - i + 1
            ok = np.flatnonzero((other[ends + 1] - other[i]) * OTHER <= n)
            end = int(ends[ok[-1]])
            if end > reached and end - i + 1 >= WORDS:
                out.append((i, end - i + 1))
                reached = end
            if reached == at[-1]:
                break
        if not out and len(same) == whole and len(at) and int(other[-1]) * OTHER <= whole:
            return [(0, whole)]
        return out


@lru_cache(maxsize=2)
def index(items: tuple[tuple[int, str, str], ...]) -> Index:
    """Built once in each Python worker."""
    return Index(items)


def item_blocks(items: DataFrame) -> list[tuple]:
    """The test items in blocks for the automata; a query set of texts, read through the driver."""
    rows = [(r[0], r[1] or "", r[2] or "") for r in collect_bounded(items.select("item_id", "passage", "question"), ITEMS, "test items")]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))
    return [tuple(rows[i : i + BLOCK]) for i in range(0, len(rows), BLOCK)]


def _hashes(ws: list[str]) -> np.ndarray:
    return np.fromiter((_hash(w) for w in ws), np.uint64, len(ws))


@lru_cache(maxsize=500_000)
def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def _runs(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of ``n`` words."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out ^ h[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class Filter:
    """A Bloom filter over the seeds of all items, with two bits a seed."""

    def __init__(self, blocks: list[tuple]) -> None:
        found: dict[int, list[np.ndarray]] = {}
        for block in blocks:
            for _, *texts in block:
                for t in texts:
                    if w := words(t):
                        found.setdefault(seed(len(w)), []).append(_runs(_hashes(w), seed(len(w))))
        self.lengths = sorted(found)
        every = [x for xs in found.values() for x in xs]
        total = sum(map(len, every))
        self.mask = min(FILTER_BITS, 1 << max(10, (16 * total).bit_length())) - 1
        bits = np.zeros(self.mask + 1, bool)
        for x in every:
            bits[x & np.uint64(self.mask)] = True
            bits[(x >> np.uint64(32)) & np.uint64(self.mask)] = True
        self.bits = np.packbits(bits)

    def _has(self, x: np.ndarray) -> np.ndarray:
        x = x & np.uint64(self.mask)
        return (self.bits[x >> np.uint64(3)] >> (np.uint64(7) - (x & np.uint64(7))).astype(np.uint8)) & 1 > 0

    def may_leak(self, text: str) -> bool:
        h = _hashes(words(text))
        for n in self.lengths:
            x = _runs(h, n)
            if (self._has(x) & self._has(x >> np.uint64(32))).any():
                return True
        return False


def candidates(documents: DataFrame, blocks: list[tuple]) -> DataFrame:
    """(doc_id, text) of the documents that may leak: all of them for one block, else those that hold a seed which the filter knows."""
    docs = spread(documents.select("doc_id", "text").where("text is not null"))
    if len(blocks) <= 1:
        return docs
    held = documents.sparkSession.sparkContext.broadcast(Filter(blocks))

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array([held.value.may_leak(t) for t in b.column(1).to_pylist()], pa.bool_()))

    return checkpointed(arrow_map(docs, kernel, "doc_id bigint, text string"))


def spans(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, doc_words): every leak."""
    schema = "doc_id bigint, item_id int, first_word int, n_words int, doc_words int"
    blocks = item_blocks(items)
    docs, out = candidates(documents, blocks), None
    for block in blocks:

        def kernel(b: pa.RecordBatch, block=block) -> pa.RecordBatch:
            ix = index(block)
            rows = ([], [], [], [], [])
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = words(t)
                for item, first, n in ix.spans(w):
                    for o, x in zip(rows, (d, item, first, n, len(w))):
                        o.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], names=["doc_id", "item_id", "first_word", "n_words", "doc_words"])

        got = arrow_map(docs, kernel, schema)
        out = got if out is None else out.unionByName(got)
    return out if out is not None else documents.sparkSession.createDataFrame([], schema)


def without(text: str, cuts: list[tuple[int, int]]) -> tuple[str | None, int, float]:
    """(the text without the stretches of words, words removed, share of all words); no text beyond ``COVERAGE``."""
    w = located(text)
    gone = np.zeros(len(w) + 1, np.int8)
    for first, n in cuts:
        gone[first : first + n] = 1
    removed = int(gone.sum())
    if removed > COVERAGE * len(w):
        return None, removed, removed / len(w)
    out, pos = [], 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone])))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        out.append(text[pos : w[a][1]])
        pos = w[b - 1][2]
    return "".join([*out, text[pos:]]), removed, removed / max(1, len(w))


def p9_spans(spark, sf_dir: str) -> DataFrame:
    """Every leak with its place in the document's normalised words and the share of the document that it covers."""
    tune(spark, 500)
    s = spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return s.select("doc_id", "item_id", "first_word", "n_words", F.round(F.col("n_words") / F.col("doc_words"), 6).alias("coverage"))


def p9_found(spark, sf_dir: str) -> DataFrame:
    """The documents with the items they leak."""
    tune(spark, 500)
    return spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id").distinct()


def clean(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, clean_text, removed_words, coverage) of the documents that leak. A text is read and cut in the same row, so none is shuffled."""
    blocks = item_blocks(items)
    docs = candidates(documents, blocks)
    schema = "doc_id bigint, clean_text string, removed_words int, coverage double"
    if not blocks:
        return documents.sparkSession.createDataFrame([], schema)
    if len(blocks) > 1:
        return _clean_in_blocks(docs, blocks, schema)
    only = blocks[0]

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = ([], [], [], [])
        for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if cuts := sorted({(first, n) for _, first, n in index(only).spans(words(t))}):
                for o, x in zip(rows, (d, *without(t, cuts))):
                    o.append(x)
        return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, (pa.int64(), pa.string(), pa.int32(), pa.float64()))], names=["doc_id", "clean_text", "removed_words", "coverage"])

    return arrow_map(docs, kernel, schema)


def _clean_in_blocks(docs: DataFrame, blocks: list[tuple], schema: str) -> DataFrame:
    """As ``clean`` for more than one block: each block reads the candidates in tasks of its own, and their cuts are joined to them by row; only candidates are shuffled."""
    rows = checkpointed(docs.withColumn("row", F.monotonically_increasing_id()))
    cuts = None
    for block in blocks:

        def find(b: pa.RecordBatch, block=block) -> pa.RecordBatch:
            ix = index(block)
            got = [(row, f, n) for t, row in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for _, f, n in ix.spans(words(t))]
            return pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32()))], names=["row", "first", "n"])

        got = arrow_map(rows.select("text", "row"), find, "row bigint, first int, n int")
        cuts = got if cuts is None else cuts.unionByName(got)
    each = cuts.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("first", "n"))).alias("cuts"))

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        got = [(d, *without(t, [(c["first"], c["n"]) for c in cs])) for d, t, cs in zip(*(c.to_pylist() for c in b.columns))]
        return pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int32(), pa.float64()))], names=["doc_id", "clean_text", "removed_words", "coverage"])

    return arrow_map(rows.join(each, "row").select("doc_id", "text", "cuts"), cut, schema)


def p9_clean(spark, sf_dir: str) -> DataFrame:
    """(doc_id, clean_text, removed_words, coverage): documents that leak, in their own spelling without the leaked stretches; null where too much of them leaks."""
    tune(spark, 500)
    return clean(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "clean_text", "removed_words", F.round("coverage", 6).alias("coverage"))
