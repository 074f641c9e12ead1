"""Problem 10: documents and their mixed-language segments get a language with a confidence value.

A byte convolutional network (filters over 2, 4 and 6 bytes with a stride of 2, maximum pooling, softmax) is trained in numpy on sentences of labelled
documents, and applied to batches of fixed-length windows of every sentence. Labels are only taken for training after their forms are unified, and sentences
that a first network finds mislabelled are left out of the second training. At inference two neighbouring bytes index one table, so a filter over
six bytes costs three gathers a position.

The sample for training is bounded: ``SAMPLE_DOCS`` documents, chosen by a hash of their id over all labelled rows, but ``LABEL_DOCS`` of each language where there are so
many, and ``SAMPLE_SENTENCES`` sentences from the whole text of each. A language with fewer than ``LABEL_SENTENCES`` sentences in a large sample cannot be learned. All
other work covers every document and its whole text.

A language counts for a document if a full sentence is in it: at least ``MIN_WORDS`` words and ``MIN_LETTERS`` letters, above ``SURE`` (a language with a single sentence) or
``FAIR`` confidence. Chapter words, frame lines, speaker names, file names and quoted phrases are left out before; entries of contents lists and logs are sentences.

Defined results: null and blank texts have no language and no row; texts without a full sentence are judged as a whole; labels that name no language count as
missing; if no row is labelled, nothing can be trained and the result is empty; repeated ids are judged row by row; extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.runtime import arrow_map, spread, table, tune

SAMPLE_DOCS, SAMPLE_SENTENCES = 4000, 12
#: Documents and sentences of a rare language that are enough to learn it, and the share of the training windows it then gets by repetition.
LABEL_DOCS, LABEL_SENTENCES, LABEL_SHARE = 100, 24, 0.01
WINDOW, FILTERS, WIDTHS = 96, 24, (2, 4, 6)
MIN_WORDS, MIN_LETTERS = 4, 18
SURE, FAIR = 0.87, 0.6
#: Words up to which a quotation is a phrase and no sentence.
PHRASE = 9
# Languages by two-letter code with their three-letter codes and English names.
LANGUAGES = {
    "en": "eng english", "de": "deu ger german", "fr": "fra fre french", "es": "spa spanish castilian", "pt": "por portuguese", "it": "ita italian", "nl": "nld dut dutch flemish", "sv": "swe swedish", "pl": "pol polish", "ru": "rus russian", "da": "dan danish", "no": "nor norwegian", "nb": "nob", "nn": "nno", "fi": "fin finnish",
    "cs": "ces cze czech", "sk": "slk slo slovak", "sl": "slv slovenian", "hr": "hrv croatian", "sr": "srp serbian", "bg": "bul bulgarian", "uk": "ukr ukrainian", "be": "bel belarusian", "ro": "ron rum romanian", "hu": "hun hungarian", "el": "ell gre greek", "tr": "tur turkish", "lt": "lit lithuanian", "lv": "lav latvian", "et": "est estonian",
    "ca": "cat catalan", "gl": "glg galician", "eu": "eus baq basque", "ga": "gle irish", "cy": "cym wel welsh", "is": "isl ice icelandic", "la": "lat latin", "ar": "ara arabic", "he": "heb hebrew", "fa": "fas per persian", "hi": "hin hindi", "zh": "zho chi chinese", "ja": "jpn japanese", "ko": "kor korean", "vi": "vie vietnamese", "id": "ind indonesian",
}
ALIASES = {a: code for code, names in LANGUAGES.items() for a in (code, *names.split())}


def code_of(label: Column) -> Column:
    """The two-letter code that a label names in any form, or null."""
    head = F.lower(F.regexp_extract(F.trim(label), r"^([A-Za-z]+)", 1))
    names = F.create_map(*[x for a, c in ALIASES.items() for x in (F.lit(a), F.lit(c))])
    return names[head]


# Words of chapter headings and frame lines.
_CHAPTER = re.compile(r"^\W*(?:chapter|chapitre|kapitel|cap[ií]tulo|capitolo|hoofdstuk|rozdzia[łl]|глава|kapitlet|part|book|teil|partie|parte|deel|del|cz[ęe][śs][ćc]|часть)\b.{0,12}$", re.I)
_HEAD = re.compile(r"^\W*(?:chapter|chapitre|kapitel|cap[ií]tulo|capitolo|hoofdstuk|rozdzia[łl]|глава)\s+(?:\d+|[IVXLCDM]+)[.:]?\s+", re.I)
_FRAME = re.compile(r"^\s*(?:\*{2,}.*|(?:title|author|language|release date|produced by|translator|editor|character set encoding)\s*:.*|(?:end|start) of (?:the|this) project.*)$", re.I)
_ENTRY = re.compile(r"^\s*(?:\[\d+\]|[IVXLCDM]+\.|\d+[.)]|[-*•])\s+")
_LEADER = re.compile(r"[\s.…—–\-]*\d+\s*$")
_QUOTE = re.compile(r"[“„][^“”„\"\n]*[”“\"]|«[^«»\n]*»|\"[^\"\n]*\"|‘[^‘’\n]{12,}’")
_SPEAKER = re.compile(r"^[^\W\d_a-zа-я]{3,24}:\s+")
_END = re.compile(r"\n|(?<=[.!?…])[\"”»’)]*\s+(?:[—–/|\-]+\s+)?(?=[\"“«„(\[]?[^\W\d_])")
_ASIDE = re.compile(r"\([^()\n]*\)|\[[^\[\]\n]*\]")
#: Two capitalised words in a row: a personal name far more often than anything else, and of no language.
_NAMES = re.compile(r"\b[A-ZÀ-ÖØ-ÞĄĆĘŁŃÓŚŹŻ][a-zß-öø-ÿąćęłńśźż]+ [A-ZÀ-ÖØ-ÞĄĆĘŁŃÓŚŹŻ][a-zß-öø-ÿąćęłńśźż]+\b")
_LETTERS = re.compile(r"[^\W\d_]+")


def sentences(text: str) -> list[tuple[int, str]]:
    """(offset of its paragraph, text) of each sentence or entry."""
    out: list[tuple[int, str]] = []
    pos = 0
    for block in re.split(r"(\r?\n[ \t]*\r?\n\s*)", text):
        at, pos = pos, pos + len(block)
        if not block.strip():
            continue
        prose: list[str] = []
        for line in block.splitlines():
            line = line.strip("﻿ \t>")
            if not line or (len(line) < 80 and (_CHAPTER.match(line) or ((":" in line or "*" in line or " of " in line.lower()) and _FRAME.match(line)))):
                continue
            if line[0] in "[0123456789IVXLCDM-*•" and _ENTRY.match(line):
                entry = _ENTRY.sub("", line)
                entry = re.sub(r"\S+\.\w{2,5}:", " ", entry)
                entry = _ASIDE.sub(lambda m: m[0] if len(m[0].split()) > PHRASE else " ", entry)
                out.append((at, _LEADER.sub("", entry)))
                continue
            prose.append(line)
        if not prose:
            continue
        if len(prose) > 1 and all(p[-1] in ",.;:!?…" for p in prose):  # verse: a line is a unit
            out += [(at, p) for p in prose]
            continue
        joined = re.sub(r"(?<=\w)-\s(?=[a-zа-яà-ÿ])", "", " ".join(prose)) if any(p.endswith("-") for p in prose) else " ".join(prose)
        joined = _HEAD.sub("", _SPEAKER.sub("", joined))
        if any(q in joined for q in "“„«\"‘"):
            joined = _QUOTE.sub(lambda m: m[0] if len(m[0].split()) > PHRASE else "\n", joined)
        if "(" in joined or "[" in joined:
            joined = _ASIDE.sub(lambda m: m[0] if len(m[0].split()) > PHRASE else " ", joined)
        for s in _END.split(joined):
            if ":" in s:
                s = _SPEAKER.sub("", s)
            s = s.strip(" —–-\"“”«»„")
            if s:
                out.append((at, s))
    return out


_FULL = re.compile(r"(?:[^\W\d_]+[\W\d_]+){%d}[^\W\d_]" % (MIN_WORDS - 1))


def full(s: str) -> bool:
    """Whether a piece counts as a full sentence; blanks and signs between the words are allowed for."""
    return len(s) >= MIN_LETTERS + MIN_WORDS - 1 and _FULL.search(s) is not None


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(windows of ``WINDOW`` bytes, text of each): every text is covered, its last window ends where it ends."""
    every = _NAMES.sub("", "\0".join(t if "\0" not in t else t.replace("\0", " ") for t in texts))
    data = np.frombuffer(re.sub(r"\d+", "0", every).lower().encode("utf-8", "replace") + b"\0" * WINDOW, np.uint8)
    ends = np.flatnonzero(data == 0)[: len(texts)]
    start = np.concatenate([[0], ends[:-1] + 1]) if len(texts) else np.zeros(0, np.int64)
    size = ends - start
    n = np.maximum(1, -(-size // WINDOW))
    who = np.repeat(np.arange(len(texts)), n)
    k = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
    lo = np.minimum(k * WINDOW, np.maximum(0, size[who] - WINDOW))
    at = (start[who] + lo)[:, None] + np.arange(WINDOW)
    w = data[np.minimum(at, len(data) - 1)]
    w[np.arange(WINDOW) >= np.minimum(size[who] - lo, WINDOW)[:, None]] = 0
    return w, who


class Network:
    """The byte network: ``taps[w]`` are the filters of width ``w`` as (w, 256, FILTERS); ``out`` and ``bias`` the softmax layer."""

    def __init__(self, classes: list[str], seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        self.classes = classes
        self.taps = {w: (r.standard_normal((w, 256, FILTERS)) * (0.6 / w)).astype(np.float32) for w in WIDTHS}
        self.out = (r.standard_normal((FILTERS * len(WIDTHS), len(classes))) * 0.15).astype(np.float32)
        self.bias = np.zeros(len(classes), np.float32)
        self.pairs: dict[int, list[np.ndarray]] | None = None

    def prepare(self) -> None:
        """Tables of two bytes at a time for inference."""
        self.pairs = {w: [(t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, FILTERS) for j in range(0, w, 2)] for w, t in self.taps.items()}

    def logits(self, win: np.ndarray, block: int = 512) -> np.ndarray:
        if self.pairs is None:
            self.prepare()
        pad = 2 * (max(WIDTHS) // 2 - 1)
        res = np.empty((len(win), len(self.classes)), np.float32)
        for a in range(0, len(win), block):
            x = win[a : a + block]
            x = np.concatenate([x, np.zeros((len(x), pad), np.uint8)], 1).astype(np.int32)
            pair = np.ascontiguousarray((x[:, ::2] * 256 + x[:, 1::2]).T)  # positions first: pooling then runs over whole rows
            n = WINDOW // 2
            pooled = []
            for w in WIDTHS:
                conv = self.pairs[w][0].take(pair[:n], axis=0)
                for j in range(1, w // 2):
                    conv += self.pairs[w][j].take(pair[j : j + n], axis=0)
                pooled.append(conv.max(axis=0))
            res[a : a + block] = np.maximum(np.concatenate(pooled, 1), 0) @ self.out + self.bias
        return res

    def train(self, win: np.ndarray, y: np.ndarray, epochs: int, rate: float = 0.004, batch: int = 256, seed: int = 3) -> None:
        """Adam on the cross entropy; only the positions that won the pooling pass a gradient back."""
        r = np.random.default_rng(seed)
        n_pos, pad = WINDOW // 2, max(WIDTHS)
        par = [*(self.taps[w] for w in WIDTHS), self.out, self.bias]
        m1, m2, t = [np.zeros_like(p) for p in par], [np.zeros_like(p) for p in par], 0
        padded = np.concatenate([win, np.zeros((len(win), pad), np.uint8)], 1).astype(np.int32)
        for _ in range(epochs):
            order = r.permutation(len(win))
            for a in range(0, len(order), batch):
                idx = order[a : a + batch]
                x, yy, rows = padded[idx], y[idx], np.arange(len(idx))
                best, pooled = [], []
                for w in WIDTHS:
                    conv = self.taps[w][0].take(x[:, : 2 * n_pos : 2], axis=0)
                    for k in range(1, w):
                        conv += self.taps[w][k].take(x[:, k : k + 2 * n_pos : 2], axis=0)
                    arg = conv.argmax(axis=1)
                    best.append(arg)
                    pooled.append(np.take_along_axis(conv, arg[:, None, :], 1)[:, 0])
                h = np.maximum(np.concatenate(pooled, 1), 0)
                drop = (r.random(h.shape) < 0.8).astype(np.float32) / 0.8
                hd = h * drop
                z = hd @ self.out + self.bias
                z -= z.max(1, keepdims=True)
                p = np.exp(z)
                p /= p.sum(1, keepdims=True)
                p[rows, yy] -= 1
                p /= len(idx)
                grads = []
                gh = (p @ self.out.T) * drop * (h > 0)
                for i, w in enumerate(WIDTHS):
                    g, arg = gh[:, i * FILTERS : (i + 1) * FILTERS], best[i]
                    gt = np.empty_like(self.taps[w])
                    for k in range(w):
                        byte = x[rows[:, None], 2 * arg + k]
                        gt[k] = np.bincount((byte * FILTERS + np.arange(FILTERS)).reshape(-1), g.reshape(-1), 256 * FILTERS).reshape(256, FILTERS)
                    grads.append(gt)
                grads += [hd.T @ p, p.sum(0)]
                t += 1
                for q, g, a1, a2 in zip(par, grads, m1, m2):
                    a1 += 0.1 * (g - a1)
                    a2 += 0.01 * (g * g - a2)
                    q -= (rate * (a1 / (1 - 0.9**t)) / (np.sqrt(a2 / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
        self.pairs = None


def sampled(text: str) -> list[str]:
    """Sentences of a text for training, from its whole length."""
    s = [x for _, x in sentences(text) if full(x)]
    return s[:: max(1, len(s) // SAMPLE_SENTENCES)][:SAMPLE_SENTENCES]


def fit(texts: list[tuple[str, str]], epochs: int = 4) -> Network | None:
    """Trains on (text, code) rows; twice, the second time without sentences that the first network denies."""
    return fit_sentences([(sampled(t), c) for t, c in texts], epochs)


def fit_sentences(rows: list[tuple[list[str], str]], epochs: int = 4) -> Network | None:
    got = [x for s, _ in rows for x in s]
    codes = [c for s, c in rows for _ in s]
    share = {c: codes.count(c) for c in set(codes)}
    classes = sorted(c for c, n in share.items() if n >= max(2, min(LABEL_SENTENCES, 0.002 * len(codes))))
    if not classes:
        return None
    keep = [i for i, c in enumerate(codes) if c in classes]
    win, who = windows([got[i] for i in keep])
    y = np.array([classes.index(codes[keep[i]]) for i in who], np.int64)
    if len(classes) == 1:
        return Network(classes)
    often = np.bincount(y, minlength=len(classes))
    again = np.maximum(1, -(-int(LABEL_SHARE * len(y)) // np.maximum(often, 1)))[y]
    win, y = np.repeat(win, again, axis=0), np.repeat(y, again)
    passes = max(epochs, min(40, 30_000 // max(1, len(y))))
    net = Network(classes)
    net.train(win, y, passes)
    z = net.logits(win)
    z = z - z.max(1, keepdims=True)
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    fair = p[np.arange(len(y)), y] > 0.2
    if fair.sum() > 50 and fair.sum() < len(y):
        net.train(win[fair], y[fair], passes, rate=0.002)
    return net


def probabilities(net: Network, texts: list[str]) -> np.ndarray:
    """A row of class probabilities for each text: the mean log probability of its windows."""
    win, who = windows(texts)
    z = net.logits(win)
    z -= z.max(1, keepdims=True)
    logp = z - np.log(np.exp(z).sum(1, keepdims=True))
    total = np.add.reduceat(logp, np.searchsorted(who, np.arange(len(texts))), axis=0).astype(np.float64)
    total /= np.bincount(who, minlength=len(texts))[:, None]
    p = np.exp(total - total.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def trained(documents: DataFrame) -> Network | None:
    """The network fitted on the bounded sample of ``documents``.

    A first pass counts the rows of each label from the labels alone; the second takes the rows whose hash lies below their label's share, and only their
    sampled sentences come to the driver, however many partitions there are; repeated rows come once.
    """
    lab = documents.withColumn("code", code_of(F.col("lang"))).where("code is not null")
    counts = {r["code"]: r["count"] for r in lab.groupBy("code").count().collect()}
    if not counts:
        return None
    share = SAMPLE_DOCS / sum(counts.values())
    below = F.create_map(*[x for c, n in sorted(counts.items()) for x in (F.lit(c), F.lit(int(min(1.0, max(share, LABEL_DOCS / n)) * (1 << 30))))])
    hit = lab.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < below[F.col("code")]).where("trim(text) <> ''").select("doc_id", "text", "code")

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([sampled(t) for t in b.column(1).to_pylist()], pa.list_(pa.string()))], names=["doc_id", "code", "sentences"])

    rows = arrow_map(hit, kernel, "doc_id bigint, code string, sentences array<string>").distinct().collect()
    rows.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["code"], r["sentences"]))
    return _fitted(tuple((tuple(r["sentences"]), r["code"]) for r in rows))


@lru_cache(maxsize=4)
def _fitted(rows: tuple) -> Network | None:
    """The network of a sample; queries over the same sample share it."""
    return fit_sentences([(list(s), c) for s, c in rows])


def judge(net: Network, texts: list[str]) -> list[list[tuple[int, str, str, float, bool]]]:
    """For each text its sentences as (offset, sentence, code, confidence, full)."""
    flat: list[str] = []
    owner: list[tuple[int, int, str, bool]] = []
    for i, t in enumerate(texts):
        got = sentences(t)
        if not any(full(s) for _, s in got):
            whole = " ".join(s for _, s in got) or t
            got = [(0, whole)] if _LETTERS.search(whole) else []
            marks = [True] * len(got)
        else:
            marks = [full(s) for _, s in got]
        for (at, s), m in zip(got, marks):
            flat.append(s)
            owner.append((i, at, s, m))
    out: list[list] = [[] for _ in texts]
    if flat:
        p = probabilities(net, flat)
        top = p.argmax(1)
        for (i, at, s, m), k, c in zip(owner, top, p.max(1)):
            out[i].append((at, s, net.classes[k], float(c), m))
    return out


def languages(marks: list[tuple[int, str, str, float, bool]]) -> list[tuple[str, float, int]]:
    """(code, confidence, sentences) of the languages that count in a document, the main one first."""
    seen: dict[str, list[float]] = {}
    for _, _, code, conf, is_full in marks:
        if is_full:
            seen.setdefault(code, []).append(conf)
    if not seen:
        return []
    order = sorted(seen, key=lambda c: (-sum(seen[c]), c))
    out = []
    for k, c in enumerate(order):
        best = max(seen[c])
        if k == 0 or best >= SURE or (len(seen[c]) > 1 and sum(seen[c]) / len(seen[c]) >= FAIR and best >= 0.8):
            out.append((c, sum(seen[c]) / len(seen[c]), len(seen[c])))
    return out


@lru_cache(maxsize=2)
def _revive(blob: bytes) -> Network:
    import pickle

    return pickle.loads(blob)


def _blob(net: Network) -> bytes:
    import pickle

    net.pairs = None
    return pickle.dumps(net)


def _documents(spark, sf_dir: str) -> tuple[DataFrame, bytes | None]:
    tune(spark, 1000)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = trained(docs)
    return spread(docs), None if net is None else _blob(net)


def judged(docs: DataFrame, blob: bytes | None) -> DataFrame:
    """(doc_id, label, lang, confidence, n_sentences, main): one row for each language that counts in a document."""
    schema = "doc_id bigint, label string, lang string, confidence double, n_sentences int, main boolean"
    if blob is None:
        return docs.sparkSession.createDataFrame([], schema)

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, texts, labels = (c.to_pylist() for c in b.columns)
        rows: tuple[list, ...] = ([], [], [], [], [], [])
        for d, lab, marks in zip(ids, labels, judge(_revive(blob), texts)):
            for k, (code, conf, n) in enumerate(languages(marks)):
                for o, x in zip(rows, (d, lab, code, round(conf, 4), n, k == 0)):
                    o.append(x)
        kinds = (pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], names=["doc_id", "label", "lang", "confidence", "n_sentences", "main"])

    return arrow_map(docs.where("trim(text) <> ''").select("doc_id", "text", code_of(F.col("lang")).alias("label")), kernel, schema)


def p10_languages(spark, sf_dir: str) -> DataFrame:
    """Every document with each language of its text, its confidence and number of sentences."""
    docs, blob = _documents(spark, sf_dir)
    return judged(docs, blob).select("doc_id", "lang", "confidence", "n_sentences", "main")


def p10_segments(spark, sf_dir: str) -> DataFrame:
    """(doc_id, seg_no, offset, n_sentences, lang, confidence): runs of sentences of one language, in order; ``offset`` is that of the first paragraph."""
    docs, blob = _documents(spark, sf_dir)
    schema = "doc_id bigint, seg_no int, offset int, n_sentences int, lang string, confidence double"
    if blob is None:
        return spark.createDataFrame([], schema)

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, texts = (c.to_pylist() for c in b.columns)
        rows: tuple[list, ...] = ([], [], [], [], [], [])
        for d, marks in zip(ids, judge(_revive(blob), texts)):
            counted = {c for c, _, _ in languages(marks)}
            runs: list[list] = []
            for at, _, code, conf, is_full in marks:
                code = code if is_full and code in counted else (runs[-1][1] if runs else code)
                if runs and runs[-1][1] == code:
                    runs[-1][2] += 1
                    runs[-1][3] += conf
                else:
                    runs.append([at, code, 1, conf])
            for k, (at, code, n, conf) in enumerate(runs, 1):
                for o, x in zip(rows, (d, k, at, n, code, round(conf / n, 4))):
                    o.append(x)
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], names=["doc_id", "seg_no", "offset", "n_sentences", "lang", "confidence"])

    return arrow_map(docs.where("trim(text) <> ''").select("doc_id", "text"), kernel, schema)


def p10_found(spark, sf_dir: str) -> DataFrame:
    """The languages of every document whose label is missing, is none of them, or that mixes several; the decision needs only the document's own row."""
    docs, blob = _documents(spark, sf_dir)
    if blob is None:
        return spark.createDataFrame([], "doc_id bigint, lang string")
    schema = "doc_id bigint, lang string"

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, texts, labels = (c.to_pylist() for c in b.columns)
        rows: tuple[list, list] = ([], [])
        for d, lab, marks in zip(ids, labels, judge(_revive(blob), texts)):
            got = [c for c, _, _ in languages(marks)]
            if lab is None or lab not in got or len(got) > 1:
                for c in got:
                    rows[0].append(d)
                    rows[1].append(c)
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string())], names=["doc_id", "lang"])

    return arrow_map(docs.where("trim(text) <> ''").select("doc_id", "text", code_of(F.col("lang")).alias("label")), kernel, schema)
