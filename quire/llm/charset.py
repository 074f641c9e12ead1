"""Problem 1: text garbled by a wrong character encoding is found and restored.

Every distinct corpus word with a character beyond ASCII is written under each charset and read under each other one (singly, twice and, for the commonest charsets, three times over, and with
undecodable bytes dropped or replaced); the garbled forms are hash-joined with the words of the corpus. A form that the corpus holds is evidence that a value
holding it was decoded wrongly, and the word it came from is the verified original that replaces it. A chain of charsets of one byte a character maps each byte of a word to a
fixed string, so a form is one table translation. Words have hundreds of forms, nearly all of which no text holds: a Bloom filter over the vocabulary drops them where they are made.

Words are maximal runs of letters and characters beyond ASCII; the runs beyond ASCII inside a word are words too, so a rare name with a garbled
letter is still found. Forms of charsets with one byte a character are evidence only if the original is the more frequent word, and short ones only
together (``WEIGHT`` letters in one value under one chain). A replacement character shows lost bytes whatever word it stands in.

Defined results: null, empty and ASCII-only values are never garbled; a garbled value is reported once however many pieces it has; the declared
``encoding`` is not trusted and not read; extra columns are ignored; on empty tables the results are empty.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.runtime import BROADCAST_BYTES, arrow_map, byte_size, checkpointed, small_or_shuffled, spread, table, tune

# Charsets that text is misread under, and groups of charsets of one byte a character.
MISREAD_UTF8 = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1254", "cp437", "cp850", "cp852", "cp866", "mac_roman", "koi8_r", "iso8859_2", "iso8859_15", "iso8859_5", "mac_cyrillic", "cp1253", "cp1257", "iso8859_7")
#: Charsets of several bytes a character, tried once.
WIDE = ("gbk", "big5", "cp932", "euc_kr")
TWICE = tuple((a, b) for a in MISREAD_UTF8 for b in MISREAD_UTF8)
#: Double misreads that are common; an original under any other pair gives way to one under a likelier chain.
COMMON = (("cp1252", "cp1252"), ("latin-1", "latin-1"), ("latin-1", "cp1252"), ("cp1252", "latin-1"), ("cp1251", "cp1251"), ("cp1250", "cp1250"), ("cp1251", "cp1252"), ("cp1252", "cp1251"))
#: Threefold misreads that are tried.
THRICE = tuple((a, b, c) for a in ("cp1252", "latin-1") for b in ("cp1252", "latin-1") for c in ("cp1252", "latin-1")) + tuple((c,) * 3 for c in ("cp1250", "cp1251", "mac_roman"))
RARE = [x + end for end in ("", "?") for x in (*(f"utf-8>{a}>utf-8>{b}" for a, b in TWICE if (a, b) not in COMMON), *("utf-8>" + ">utf-8>".join(t) for t in THRICE), *(f"utf-8>{c}" for c in WIDE))]
LATIN = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "iso8859_2")
CYRILLIC = ("cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic")
#: Letters that matched words of single-byte chains must have together in one value.
WEIGHT = 3
#: What one symbol in such a word counts: letters are exchanged for letters by chance, but seldom for symbols.
SYMBOL = 4
# Punctuation beyond ASCII of ordinary text.
USUAL = "‘’‚“”„«»‹›–—…·•°©®™§€£№¿¡\u00a0\u202f\u2009ªº½¼¾²³"
WORD = r"[A-Za-z[^\x00-\x7F]]*[^\x00-\x7F][A-Za-z[^\x00-\x7F]]*"
#: A character reference that may stand for a character beyond ASCII.
REFERENCE = r"&(?!(?:amp|lt|gt|quot|apos|nbsp);)(?:[A-Za-z]{2,8}\d*|#\d+|#[xX][0-9A-Fa-f]+);"
RUN = r"[^\x00-\x7F]+"
FIELDS = ("title", "html")


@lru_cache(maxsize=64)
def reader(charset: str) -> tuple[str, str]:
    """What each of the 256 bytes reads as: undefined bytes as control characters, and as nothing (marked by U+FFFF)."""
    full, lossy = [], []
    for b in range(256):
        try:
            c = bytes([b]).decode(charset)
        except UnicodeDecodeError:
            full.append(chr(b))
            lossy.append("￿")
        else:
            full.append(c)
            lossy.append(c)
    return "".join(full), "".join(lossy)


def _read(raw: bytes, charset: str, lossy: bool = False) -> str:
    s = raw.decode("latin-1").translate(_table(charset, lossy))
    return s.replace("￿", "") if lossy else s


@lru_cache(maxsize=128)
def _table(charset: str, lossy: bool) -> dict[int, str]:
    return dict(enumerate(reader(charset)[lossy]))


def _write(text: str, charset: str) -> bytes | None:
    try:
        return text.encode(charset)
    except UnicodeEncodeError:
        if charset == "cp1252":  # control characters stand for the bytes that the charset leaves undefined
            try:
                return b"".join(bytes([ord(c)]) if 0x80 <= ord(c) < 0xA0 else c.encode(charset) for c in text)
            except UnicodeEncodeError:
                return None
        return None


@lru_cache(maxsize=1)
def chains() -> list[tuple[str, dict[int, str], dict[int, str] | None, frozenset[int]]]:
    """(name, byte to string, the same with what the last charset cannot read left out, bytes where the two differ) of every chain of misreads of UTF-8."""
    out = []
    for chain in (*((c,) for c in MISREAD_UTF8), *TWICE, *THRICE):
        full = [bytes([b]) for b in range(256)]
        for c in chain[:-1]:
            full = [_read(x, c).encode("utf-8") for x in full]
        whole = {b: _read(x, chain[-1]) for b, x in enumerate(full)}
        lossy = {b: _read(x, chain[-1], True) for b, x in enumerate(full)}
        differ = frozenset(chr(b) for b in range(256) if whole[b] != lossy[b])
        out.append(("".join(f">utf-8>{c}" for c in chain)[1:], whole, lossy if differ else None, differ))
    return out


def forms(word: str) -> list[tuple[str, str, bool]]:
    """(garbled form, chain, strong) of one word, without repeats; strong chains misread several bytes as several characters."""
    out: dict[str, tuple[str, bool]] = {}

    def add(form: str | None, chain: str, strong: bool) -> None:
        # a misread whose bytes were partly dropped is evidence only while it is longer than the word
        if form and form != word and form not in out and not form.isascii() and not (chain.endswith("?") and len(form) <= len(word)):
            out[form] = (chain, strong)

    raw = word.encode("utf-8", "ignore")
    u8 = raw.decode("latin-1")
    held = set(u8)
    for name, whole, lossy, differ in chains():
        add(u8.translate(whole), name, True)
        if lossy is not None and not held.isdisjoint(differ):
            add(u8.translate(lossy), name + "?", True)
    for c in WIDE:
        read = raw.decode(c, "replace")
        add(read, f"utf-8>{c}", True)
        if "\ufffd" in read:
            add(raw.decode(c, "ignore"), f"utf-8>{c}?", True)
    for group, other in ((LATIN, CYRILLIC), (CYRILLIC, LATIN)):
        for a in group:
            raw = _write(word, a)
            if raw is None:
                continue
            lost = raw.decode("utf-8", "replace")
            add(lost, f"{a}>utf-8", True)
            for b in (*group, *other):
                if a != b:
                    add(_read(raw, b), f"{a}>{b}", False)
    return [(f, c, s) for f, (c, s) in out.items()]


def unescaped(text: str) -> str:
    """Character references beyond ASCII as characters; those of markup signs stay."""

    def one(m: re.Match) -> str:
        c = html.unescape(m[0])
        return m[0] if c.isascii() else c

    return re.sub(r"&(?:[A-Za-z]+\d*|#\d+|#[xX][0-9A-Fa-f]+);", one, text)


def _unescape_kernel(b: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([b.column(0), pa.array([unescaped(x) for x in b.column(1).to_pylist()], pa.string())], names=b.schema.names)


def values(t: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(key, field, words): the distinct words beyond ASCII of each value that has any."""

    def words(d: DataFrame, f: str) -> DataFrame:
        return d.where(F.col(f).rlike(r"[^\x00-\x7F]")).select(key, F.lit(f).alias("field"), F.array_distinct(F.regexp_extract_all(f, F.lit(WORD), 0)).alias("words"))

    per = []
    for f in fields:
        escaped = F.coalesce(F.col(f).rlike(REFERENCE), F.lit(False))
        per.append(words(t.where(~escaped), f))
        per.append(words(arrow_map(t.where(escaped).select(key, f), _unescape_kernel, f"{key} bigint, {f} string"), f))
    out = per[0]
    for p in per[1:]:
        out = out.unionByName(p)
    return out


def with_runs(words: str = "words"):
    """A value's words together with the runs beyond ASCII inside them, in one array."""
    runs = F.flatten(F.transform(words, lambda w: F.regexp_extract_all(w, F.lit(RUN), 0)))
    return F.array_distinct(F.concat(F.col(words), runs))


def vocabulary(v: DataFrame) -> DataFrame:
    """(word, n): in how many values each word occurs; counted map-side before the shuffle."""
    return v.select(F.explode(with_runs()).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def weight_of(form: str, word: str) -> int:
    """How much a form of a single-byte chain counts: its letters, and more for characters that no usual text holds (box drawing, mathematics,
    controls). One letter for another proves nothing, nor does one symbol for a letter.
    """
    odd = sum(1 for c in form if not c.isalnum() and c not in USUAL and ord(c) > 127)
    if len(form) == 1 and (word.isalnum() or not odd):
        return 0
    return len(form) + SYMBOL * odd


#: Bits of the filter over the vocabulary at most (16 MB), and distinct words from which a task makes forms.
FILTER_BITS, WORDS_A_TASK = 1 << 27, 20_000


def word_filter(vocab: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """(mask, packed bits): a Bloom filter of two bits a word, set in blocks that are built apart; the driver gets ``FILTER_BITS`` bits at most. More words only let more forms through."""
    size = min(FILTER_BITS, 1 << max(16, (16 * n).bit_length()))
    block = 1 << 16
    h = F.xxhash64("word")
    bit = F.explode(F.array(h.bitwiseAND(F.lit(size - 1)), F.shiftright(h, 32).bitwiseAND(F.lit(size - 1))))
    bits = vocab.select(bit.alias("bit")).groupBy((F.col("bit") / block).cast("int").alias("block")).agg(F.collect_set((F.col("bit") % block).cast("int")).alias("set"))

    def pack(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for at in b.column(1).to_pylist():
            x = np.zeros(block, bool)
            x[at] = True
            out.append(np.packbits(x).tobytes())
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["block", "bits"])

    whole = np.zeros(size // 8, np.uint8)
    for r in arrow_map(bits, pack, "block int, bits binary").collect():
        whole[r["block"] * (block // 8) : (r["block"] + 1) * (block // 8)] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return size - 1, whole


def _forms_kernel(mask: int, held):
    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        bits = held.value
        out = ([], [], [], [], [], [])
        for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if "\ufffd" in w or any("\x80" <= c < "\xa0" for c in w):
                continue  # no clean word
            for f, c, s in forms(w):
                h = xxhash.xxh64_intdigest(f.encode("utf-8", "replace"), 42)
                x, y = h & mask, h >> 32 & mask
                if bits[x >> 3] >> 7 - (x & 7) & 1 and bits[y >> 3] >> 7 - (y & 7) & 1:
                    for o, v in zip(out, (f, w, n, c, s, weight_of(f, w))):
                        o.append(v)
        kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)], names=["form", "original", "n_original", "chain", "strong", "weight"])

    return kernel


def mapping(v: DataFrame) -> DataFrame:
    """(form, original, chain, strong): garbled words of the corpus with their originals, the most frequent original first and those of rare chains last."""
    vocab = checkpointed(vocabulary(v))
    n = vocab.count()
    mask, bits = word_filter(vocab, n)
    held = vocab.sparkSession.sparkContext.broadcast(bits)
    tasks = max(vocab.sparkSession.sparkContext.defaultParallelism, -(-n // WORDS_A_TASK))
    all_forms = arrow_map(vocab.select("word", "n").repartition(tasks, "word"), _forms_kernel(mask, held), "form string, original string, n_original bigint, chain string, strong boolean, weight int")
    hit = all_forms.join(vocab.withColumnRenamed("n", "n_form"), F.col("form") == F.col("word")).where("n_original > n_form or (strong and 3 * n_original >= n_form and length(form) > length(original))")
    best = hit.groupBy("form").agg(F.max(F.struct(F.col("strong").cast("int").alias("s"), (~F.col("chain").isin(*RARE)).cast("int").alias("likely"), "n_original", F.length("original").alias("len"), "original", "chain", "weight")).alias("b"))
    return best.select("form", F.col("b.original").alias("original"), F.col("b.chain").alias("chain"), (F.col("b.s") == 1).alias("strong"), F.col("b.weight").alias("weight"))


def evidence(t: DataFrame, key: str = "book_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(key, field, pairs, lost): the garbled values with their garbled words and originals."""
    v = checkpointed(values(t, key, fields))  # the texts are read and split once; vocabulary, matches and lost bytes all come from the words
    m = small_or_shuffled(mapping(v))
    words = v.select(key, "field", F.explode(with_runs()).alias("form"))
    hit = words.join(m, "form").groupBy(key, "field", "chain", "strong").agg(F.collect_set(F.struct("form", "original")).alias("pairs"), F.sum("weight").alias("weight"))
    good = hit.where(f"strong or weight >= {WEIGHT}").select(key, "field", "pairs", F.lit(False).alias("lost"))
    lost = v.where(F.exists("words", lambda w: F.contains(w, F.lit("�")))).select(key, "field", F.array().cast("array<struct<form:string,original:string>>").alias("pairs"), F.lit(True).alias("lost"))
    return good.unionByName(lost).groupBy(key, "field").agg(F.flatten(F.collect_list("pairs")).alias("pairs"), F.max("lost").alias("lost"))


def p1_found(spark, sf_dir: str) -> DataFrame:
    """The garbled values of books, restorable or not."""
    tune(spark)
    return evidence(spread(table(spark, sf_dir, "books").select("book_id", *FIELDS))).select("book_id", "field")


_WORD = re.compile(r"[A-Za-z\u0080-\U0010ffff]*[\u0080-\U0010ffff][A-Za-z\u0080-\U0010ffff]*")
_RUN = re.compile(r"[\u0080-\U0010ffff]+")


def restored(text: str, known: dict[str, str]) -> tuple[str, bool]:
    """(the text with every known word replaced, whether no lost byte is left)."""
    runs = re.compile("|".join(map(re.escape, sorted((k for k in known if not re.search("[A-Za-z]", k)), key=len, reverse=True))) or r"(?!)")

    def fix(m: re.Match) -> str:
        w = m[0]
        return known[w] if w in known else runs.sub(lambda r: known[r[0]], w)

    new = _WORD.sub(fix, text)
    return new, "\ufffd" not in new


def judged(text: str, m: dict[str, tuple[str, str, bool, int]]) -> dict[str, str] | None:
    """The garbled words of one text with their originals, by the rule of ``evidence``; None for a text that is not garbled."""
    words = set(_WORD.findall(text))
    by: dict[tuple[str, bool], list] = {}
    for w in words | {r for w in words for r in _RUN.findall(w)}:
        if w in m:
            original, chain, strong, weight = m[w]
            by.setdefault((chain, strong), []).append((w, original, weight))
    good = {w: o for (_, strong), got in by.items() if strong or sum(x[2] for x in got) >= WEIGHT for w, o, _ in got}
    return good if good or any("\ufffd" in w for w in words) else None


RESTORED = "book_id bigint, field string, restored string, n_words int, whole boolean"


def _restored_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["book_id", "field", "restored", "n_words", "whole"])


def _restore_kernel(b: pa.RecordBatch) -> pa.RecordBatch:
    get = lambda c: b.column(b.schema.get_field_index(c)).to_pylist()
    rows = []
    for book, field, text, pairs in zip(get("book_id"), get("field"), get("text"), get("pairs")):
        known = {p["form"]: p["original"] for p in pairs}
        new, whole = restored(unescaped(text), known)
        rows.append((book, field, new, len(known), whole))
    return _restored_rows(rows)


def p1_restore(spark, sf_dir: str) -> DataFrame:
    """(book_id, field, restored, n_words, whole): garbled values with every word replaced whose original is verified; ``whole`` where no lost byte is left.

    The mapping holds garbled words of the vocabulary, not of the texts: while its measured bytes allow, every worker gets it and judges and restores a value inside its row, so no text
    is shuffled. Beyond that the evidence is joined with the texts.
    """
    tune(spark)
    t = spread(table(spark, sf_dir, "books").select("book_id", *FIELDS))
    v = checkpointed(values(t, "book_id", FIELDS))
    m = checkpointed(mapping(v))
    if m.agg(F.coalesce(F.sum(byte_size(m)), F.lit(0))).first()[0] <= BROADCAST_BYTES:
        held = spark.sparkContext.broadcast({r["form"]: (r["original"], r["chain"], r["strong"], r["weight"]) for r in m.collect()})

        def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for book, *texts in zip(*(c.to_pylist() for c in b.columns)):
                for field, text in zip(FIELDS, texts):
                    if not text or (text.isascii() and "&" not in text):
                        continue
                    text = unescaped(text)
                    known = judged(text, held.value)
                    if known is not None:
                        rows.append((book, field, *restored(text, known), len(known)))
            return _restored_rows([(b, f, new, n, whole) for b, f, new, whole, n in rows])

        return arrow_map(t, kernel, RESTORED)
    e = evidence(t).select(F.col("book_id").alias("e_id"), "field", "pairs")
    texts = t.select("book_id", F.explode(F.create_map(*[x for f in FIELDS for x in (F.lit(f), F.col(f))])).alias("f", "text"))
    return arrow_map(texts.join(e, (F.col("book_id") == F.col("e_id")) & (F.col("f") == F.col("field"))).select("book_id", "field", "text", "pairs"), _restore_kernel, RESTORED)
