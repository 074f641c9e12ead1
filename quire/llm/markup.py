"""Problem 5: markup residue in text becomes clean text that keeps headings, lists, code and formulas.

Pages are read into a lenient DOM. Composite text density (characters per tag, lowered by the share of link text) is computed for every node, child densities are summed,
the node of the largest sum is selected, and the smallest density on its path to the body is the threshold under which blocks that are mostly links are left out; text
outside links is kept wherever it stands. Text that a reader sees is then
searched for residue of four kinds (HTML, Markdown, wiki, LaTeX) and rewritten: headings as ``#`` lines, items as ``-`` lines, code between fences, formulas between ``$``.

Kinds are judged on the main text that the selection finds and on the rest that it leaves out, each for itself, as markup counts wherever a reader sees it; the clean text leaves
that rest out. If the selection would keep less than ``KEEP`` of the visible text the whole body is main text. Contents of ``pre`` and ``math`` are copied, never judged.

Defined results: null and blank values give no row; a page without tags is text; unclosed and stray tags are tolerated; a value may hold several kinds; signs used as
ordinary text (comparisons, prices, products, file paths, editorial brackets) are no markup; extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from html.entities import html5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.runtime import arrow_map, spread, table, tune

KEEP = 0.5
KINDS = ("html", "latex", "markdown", "wiki")
# Element sets.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr mbp:pagebreak".split())
HIDDEN = frozenset("head script style title template noscript svg iframe object".split())
BLOCK = frozenset("address article aside blockquote body center dd div dl dt figure figcaption footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td th thead tr ul math".split())
STRUCTURE = frozenset("h1 h2 h3 h4 h5 h6 pre math".split())
CLOSES_P = BLOCK - {"math", "td", "th", "body", "html", "li"} | {"li"}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:_-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_RAW = re.compile(r"</(script|style)\s*>", re.I)

_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9:]*(?:\s+[A-Za-z_:][\w:.-]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>]+))?)*\s*/?>|<!--")
_ESCAPED = re.compile(r"&lt;/?[A-Za-z!](?:[^<>&]|&(?!lt;|gt;))*&gt;")
_REF = re.compile(r"&(#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
_SPECIAL = re.compile(r"[<&*_\[\]{}\\$`#~|=]|''|(?:^|\n)[ \t]*[>\-+] ")
_MARKDOWN = [
    re.compile(p, re.M)
    for p in (
        r"(?<![\w*])\*\*(?=[^\s*])[^*\n]+?(?<=[^\s*])\*\*(?![\w*])",
        r"(?<![\w_])__(?!(?:NO)?[A-Z]{2,}__)(?=[^\s_])[^_\n]+?(?<=[^\s_])__(?![\w_])",
        r"(?<![\w*])\*(?=[^\s*])[^*\n]+?(?<=[^\s*])\*(?![\w*])",
        r"(?<![\w_])_(?=[^\s_])[^_\n]+?(?<=[^\s_])_(?![\w_])",
        r"(?<!~)~~(?=[^\s~])[^~\n]+?(?<=[^\s~])~~(?!~)",
        r"!?\[[^\[\]\n]*\]\([^()\s]+(?:\([^()\s]*\)[^()\s]*)*(?:\s+\"[^\"]*\")?\)",
        r"(?<!`)`(?=[^`\s])[^`\n]+?(?<=[^`\s])`(?![`'])",
        r"^[ \t]*(?:```|~~~)",
        r"^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*$|^[ \t]*\|[ \t]*:?-{3,}:?[ \t]*\|[ \t]*$",
        r"^[^\s=\-|][^\n]*\n(?:={3,}|-{3,})[ \t]*$",
        r"^#{1,6} +\S",
        r"^> ?\S",
        r"^\[[^\[\]\n]+\]:\s+\S+",
    )
]
_DASHED = re.compile(r"^[ \t]*[-+] +\S[^\n]*\n(?:[ \t]*\n)?[ \t]*[-+] +\S", re.M)
_STARRED = re.compile(r"^[ \t]*\* +\S", re.M)
#: A template without another one inside; nested ones are found, and taken away, from the inside out.
TEMPLATE = r"\{\{(?>[^{}]+|\{[^{}]*\}|\{(?!\{)|\}(?!\}))++\}\}"
_WIKI = [
    re.compile(p, re.M)
    for p in (
        r"(?:(?<=[\s(\"“«>])|^)'{2,5}(?=[^\s'])(?:[^'\n]|'(?!'))+?(?<=[^\s'])'{2,5}(?!\w|')",
        r"\[\[[^\[\]\n]+\]\]",
        TEMPLATE,
        r"^[ \t]*\{\|",
        r"^(={2,6}) *[^=\n][^\n]*?[^=\n]? *\1[ \t]*$",
        r"__(?:NO)?(?:TOC|FORCETOC|EDITSECTION|INDEX|GALLERY)[A-Z]*__",
        r"\[(?:https?|ftp)://[^\s\]]+ [^\]\n]+\](?!\()",
    )
]
_LATEX = [
    re.compile(p, re.M)
    for p in (
        r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{",
        r"\\(?:item|ldots|dots|par|noindent|maketitle|sum|int|frac|alpha|beta|gamma|cdot|times|infty|sqrt|textbf|emph|LaTeX|TeX|hline|newline|quad|clearpage|newpage|bigskip|medskip)\b",
        r"\\\[(?:[^\\\n]|\\(?![\[\]])|\n(?!\s*\n))+?\\\]|\\\((?:[^\\\n]|\\(?![()])|\n(?!\s*\n))+?\\\)",
        r"(?<![\w$\\])\$(?=[^\s$])(?=[^$\n]*[\\^_=+])[^$\n]+?(?<=[^\s$])\$(?![\w$])",
        r"\$\$[^$]+\$\$",
        r"(?<!`)``(?=[^\s`])(?:[^`'\n]|'(?!'))+?''",
        r"\\['`^\"~=.](?:\{[A-Za-z]\}|[A-Za-z])",
    )
]


def has_reference(text: str) -> bool:
    return any(m[1][0] == "#" or m[1] + ";" in html5 for m in _REF.finditer(text))


def kinds(text: str) -> list[str]:
    """The kinds of markup in a text, sorted."""
    if not _SPECIAL.search(text):
        return []
    out = []
    if ("<" in text and _TAG.search(text)) or ("&" in text and (_ESCAPED.search(text) or has_reference(text))):
        out.append("html")
    tex = ("\\" in text or "$" in text or "``" in text) and any(p.search(text) for p in _LATEX)
    wiki = any(p.search(text) for p in _WIKI)
    seen = text
    if tex:  # what LaTeX explains is no Markdown: formulas hold underscores, quotes hold backticks
        out.append("latex")
        for p in _LATEX[2:6]:
            seen = p.sub(" ", seen)
    if "<" in text:
        seen = _TAG.sub(" ", seen)
    md = any(p.search(seen) for p in (_MARKDOWN if not wiki else [p for p in _MARKDOWN if "#{1,6}" not in p.pattern]))
    if md or _DASHED.search(seen) or (not wiki and len(_STARRED.findall(seen)) >= 2):
        out.append("markdown")
    if wiki:
        out.append("wiki")
    return out


class Page:
    """A lenient DOM with the counts that text density needs: parallel lists over nodes, children after their parents."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.pieces = ["#root"], [-1], []
        self.chars, self.tags, self.link_chars, self.link_tags = [0], [0], [0], [0]
        stack, hidden, raw, links, pos = [0], 0, 0, 0, 0
        n = len(source)
        while pos < n:
            m = _TOKEN.search(source, pos)
            end = m.start() if m else n
            if end > pos and not hidden:
                self._text(stack[-1], source[pos:end], raw, links)
            if not m:
                break
            pos = m.end()
            name = m[2]
            if not name:
                continue
            name = name.lower()
            if m[1]:
                if any(self.tag[s] == name for s in reversed(stack[1:])):
                    while True:
                        s = stack.pop()
                        t = self.tag[s]
                        hidden -= t in HIDDEN
                        raw -= t in ("pre", "math")
                        links -= t == "a"
                        if t == name:
                            break
                continue
            if name in CLOSES_P and self.tag[stack[-1]] == "p":
                stack.pop()
            if name == "li" and "li" in (self.tag[s] for s in stack[-2:]):
                while self.tag[stack[-1]] != "li":
                    stack.pop()
                stack.pop()
            k = len(self.tag)
            self.tag.append(name)
            self.parent.append(stack[-1])
            for lst in (self.chars, self.tags, self.link_chars, self.link_tags):
                lst.append(0)
            self.tags[stack[-1]] += 1
            if links or name == "a":
                self.link_tags[stack[-1]] += 1
            if name in VOID or m[3].endswith("/"):
                self.pieces.append((k, "", raw, links))
                continue
            stack.append(k)
            hidden += name in HIDDEN
            raw += name in ("pre", "math")
            links += name == "a"
            if name in ("script", "style"):
                e = _RAW.search(source, pos)
                pos = e.start() if e else n

    def _text(self, node: int, text: str, raw: int, links: int) -> None:
        size = len(text.strip())
        self.chars[node] += size
        if links:
            self.link_chars[node] += size
        self.pieces.append((node, text, raw, links))

    def block(self, k: int) -> int:
        while k > 0 and self.tag[k] not in BLOCK:
            k = self.parent[k]
        return k

    def visible(self) -> str:
        """What a reader sees outside ``pre`` and ``math``, decoded once, with a line for each block."""
        out, last = [], None
        for node, text, raw, _ in self.pieces:
            if raw:
                continue
            b = self.block(node)
            if (b != last or self.tag[node] == "br") and out:
                out.append("\n")
            last = b
            out.append(html.unescape(text) if "&" in text else text)
        return "".join(out)

    def parts(self) -> list[tuple[bool, str]]:
        """The visible text in order, cut where main text and blocks that the density selection leaves out meet: (whether it is main text, text)."""
        keep = self.kept()
        if len(keep) == len(self.tag):
            return [(True, self.visible())]
        out: list[tuple[bool, list[str]]] = []
        last = None
        for node, text, raw, _ in self.pieces:
            if raw:
                continue
            main, b = node in keep, self.block(node)
            if not out or out[-1][0] != main:
                out.append((main, []))
            elif b != last or self.tag[node] == "br":
                out[-1][1].append("\n")
            last = b
            out[-1][1].append(html.unescape(text) if "&" in text else text)
        return [(m, "".join(t)) for m, t in out]

    def kept(self) -> set[int]:
        """Nodes of the main text: all but blocks of links thinner than the threshold, the smallest density on the path of the largest density sum."""
        n = len(self.tag)
        c, t, lc, lt = list(self.chars), list(self.tags), list(self.link_chars), list(self.link_tags)
        for k in range(n - 1, 0, -1):
            p = self.parent[k]
            c[p] += c[k]
            t[p] += t[k]
            lc[p] += lc[k]
            lt[p] += lt[k]
        share = lc[0] / c[0] if c[0] else 0.0
        density = [0.0] * n
        for k in range(n):
            if not c[k]:
                continue
            tags, links, ltags = max(t[k], 1), max(lc[k], 1), max(lt[k], 1)
            plain = max(c[k] - lc[k], 1)
            base = math.log(c[k] / plain * lc[k] + share * c[k] + math.e)
            density[k] = c[k] / tags * max(math.log(max(c[k] / links * tags / ltags, 1.0000001), base if base > 1.0000001 else math.e), 0.0)
        total = [0.0] * n
        for k in range(1, n):
            total[self.parent[k]] += density[k]
        best = max(range(n), key=lambda k: (total[k], -k))
        limit, k = density[best], best
        while k > 0:
            limit = min(limit, density[k])
            k = self.parent[k]
        # only blocks that are mostly links and thinner than the threshold go; blocks of text inside them, headings, code and formulas stay
        keep = {0}
        for k in range(1, n):
            tag = self.tag[k]
            stays = self.parent[k] in keep or density[k] >= limit > 0
            if tag in BLOCK and c[k]:
                stays = tag in STRUCTURE or lc[k] <= 0.5 * c[k] or density[k] >= limit
            if stays:
                keep.add(k)
        got, whole = sum(self.chars[k] for k in keep), c[0]
        return keep if got >= KEEP * whole else set(range(n))

    def clean(self) -> str:
        """The kept text with its structure."""
        keep, out, last, pending = self.kept(), [], None, ""
        for node, text, raw, _ in self.pieces:
            if node not in keep:
                continue
            if self.tag[node] == "br":
                pending += "\n"
                continue
            b = self.block(node)
            t = html.unescape(text) if "&" in text else text
            if b != last:
                if pending.strip():
                    out.append(self._line(last, pending))
                pending, last = "", b
            pending += t
        if pending.strip():
            out.append(self._line(last, pending))
        return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()

    def _line(self, b: int | None, text: str) -> str:
        tag, k = self.tag[b or 0], b or 0
        names = []
        while k > 0:
            names.append(self.tag[k])
            k = self.parent[k]
        if "pre" in names:
            return "```\n" + text.strip("\n") + "\n```"
        if "math" in names:
            return "$" + re.sub(r"\s+", " ", text).strip() + "$"
        text = rewrite(text) if _SPECIAL.search(text) else text
        text = "\n".join(re.sub(r"[ \t\xa0]+", " ", x).strip() for x in text.strip().splitlines())
        if re.fullmatch(r"h[1-6]", tag):
            return "#" * int(tag[1]) + " " + text.replace("\n", " ")
        if "li" in names:
            return "  " * max(0, names.count("li") - 1) + "- " + text
        if "blockquote" in names:
            return "> " + text.replace("\n", "\n> ")
        return text


_ACCENT = {"'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303", "=": "\u0304", ".": "\u0307"}


def _until_same(pattern: str, to: str, t: str) -> str:
    """Replaced again until nothing is left to replace: each round takes the innermost ones."""
    n = 1
    while n:
        t, n = re.subn(pattern, to, t)
    return t


def _from_latex(t: str) -> str:
    import unicodedata

    t = re.sub(r"\\\[\s*(.+?)\s*\\\]|\\\(\s*(.+?)\s*\\\)", lambda m: "$" + (m[1] or m[2]) + "$", t)
    held: list[str] = []

    def hold(m: re.Match) -> str:
        held.append(m[0])
        return f"\x02{len(held) - 1}\x02"

    t = re.sub(r"\$\$[^$]+\$\$|\$[^$\n]+\$", hold, t)
    t = re.sub(r"\\([\'`^\"~=.])\{?([A-Za-z])\}?", lambda m: unicodedata.normalize("NFC", m[2] + _ACCENT[m[1]]), t)
    for level, name in enumerate(("part|chapter", "section", "subsection", "subsubsection|paragraph"), 1):
        t = re.sub(rf"\\(?:{name})\*?\{{([^{{}}]*)\}}\s*", lambda m, k=level: "\n" + "#" * k + " " + m[1] + "\n", t)
    t = re.sub(r"\\begin\{(?:verbatim|lstlisting)\}\n?(.*?)\\end\{(?:verbatim|lstlisting)\}", lambda m: "```\n" + m[1].strip("\n") + "\n```", t, flags=re.S)
    t = re.sub(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?", "", t)
    t = re.sub(r"[ \t]*\\item\b[ \t]*", "- ", t)
    t = re.sub(r"\\l?dots\b(?:\{\})?", "…", t)
    t = re.sub(r"\s*\\(?:cite|ref|label|footnote|index)\w*\*?(?:\[[^\]]*\])?\{[^{}]*\}", "", t)
    t = _until_same(r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}", r"\1", t)
    t = re.sub(r"``(.+?)''", r"“\1”", t)
    t = t.replace("---", "—").replace("~", " ") if "\\" in t or held or "---" in t else t
    t = re.sub(r"\\([%&$#_{}])", r"\1", t)
    return re.sub(r"\x02(\d+)\x02", lambda m: held[int(m[1])], t)


def _from_wiki(t: str) -> str:
    t = re.sub(r"__(?:NO)?[A-Z]{2,}__\n?", "", t)
    t = _until_same(TEMPLATE + r"\n?", "", t)
    t = re.sub(r"\[\[(?:Category|File|Image):[^\[\]]*\]\]", "", t, flags=re.I)
    t = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", r"\1", t)
    t = re.sub(r"\[(?:https?|ftp)://\S+ ([^\]\n]+)\]", r"\1", t)
    t = re.sub(r"^(={1,6})\s*(.+?)\s*\1[ \t]*$", lambda m: "#" * len(m[1]) + " " + m[2], t, flags=re.M)
    t = re.sub(r"'{2,5}", "", t)
    t = re.sub(r"^[ \t]*\{\|.*\n?|^[ \t]*\|[}\-].*\n?", "", t, flags=re.M)
    t = re.sub(r"^[ \t]*[!|][ \t]*", "", t, flags=re.M)
    return re.sub(r"^\*+[ \t]*", "- ", t, flags=re.M)


def _from_markdown(t: str) -> str:
    parts = re.split(r"(^[ \t]*(?:```|~~~)[^\n]*\n.*?^[ \t]*(?:```|~~~)[ \t]*$)", t, flags=re.M | re.S)
    for i in range(0, len(parts), 2):
        x = parts[i]
        x = re.sub(r"!\[([^\]\n]*)\]\([^)\n]*\)", r"\1", x)
        x = re.sub(r"\[([^\]\n]*)\]\([^)\n]*\)", r"\1", x)
        x = re.sub(r"^([^\n]+)\n=+[ \t]*$", r"# \1", x, flags=re.M)
        x = re.sub(r"^([^\s|\-][^\n]*)\n-{3,}[ \t]*$", r"## \1", x, flags=re.M)
        x = re.sub(r"^[ \t]*\|?(?:[ \t]*:?-{3,}:?[ \t]*\|?)+[ \t]*$\n?", "", x, flags=re.M)
        x = re.sub(r"^\|(.*)\|[ \t]*$", lambda m: "\t".join(c.strip() for c in m[1].split("|")), x, flags=re.M)
        x = re.sub(r"(?<![\w*])(\*\*|\*)(?=\S)(.+?)(?<=\S)\1(?![\w*])", r"\2", x)
        x = re.sub(r"(?<![\w_])(__|_)(?=\S)(.+?)(?<=\S)\1(?![\w_])", r"\2", x)
        x = re.sub(r"~~(?=\S)(.+?)(?<=\S)~~", r"\1", x)
        x = re.sub(r"(?<!`)`([^`\n]+)`(?!`)", r"\1", x)
        parts[i] = re.sub(r"^[ \t]*[*+][ \t]+", "- ", x, flags=re.M)
    return "".join(parts)


def rewrite(text: str) -> str:
    """A text without its markup residue, structure kept."""
    found = kinds(text)
    if "html" in found:
        for _ in range(2):  # escaped markup first becomes markup
            if _ESCAPED.search(text):
                text = html.unescape(text)
        text = Page(text).clean() if _TAG.search(text) else html.unescape(text)
    for kind, f in (("wiki", _from_wiki), ("latex", _from_latex), ("markdown", _from_markdown)):
        if kind in found:
            text = f(text)
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def residue(field: str, value: str) -> list[tuple[str, bool]]:
    """(kind, whether the main text holds it) of the markup in a field's value, as its reader sees it: the main text is judged first, then what the selection leaves out."""
    found: dict[str, bool] = {}
    for main, text in Page(value).parts() if field == "html" else [(True, value)]:
        for k in kinds(text):
            found[k] = found.get(k, False) or main
    return sorted(found.items())


def cleaned(field: str, value: str) -> str:
    return Page(value).clean() if field == "html" and "<" in value else rewrite(value)


def _found_kernel(b: pa.RecordBatch) -> pa.RecordBatch:
    rows: tuple[list, ...] = ([], [], [], [])
    for book, desc, page in zip(*(c.to_pylist() for c in b.columns)):
        for field, v in (("description", desc), ("html", page)):
            if v and not v.isspace():
                for k, main in residue(field, v):
                    for o, x in zip(rows, (book, field, k, main)):
                        o.append(x)
    return pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, (pa.int64(), pa.string(), pa.string(), pa.bool_()))], names=["book_id", "field", "markup", "main"])


def _clean_kernel(b: pa.RecordBatch) -> pa.RecordBatch:
    rows: tuple[list, list, list] = ([], [], [])
    for book, desc, page in zip(*(c.to_pylist() for c in b.columns)):
        for field, v in (("description", desc), ("html", page)):
            if v and not v.isspace():
                for o, x in zip(rows, (book, field, cleaned(field, v))):
                    o.append(x)
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())], names=["book_id", "field", "clean_text"])


def p5_kinds(spark, sf_dir: str) -> DataFrame:
    """The values that hold markup, with its kinds and whether the main text holds it; one narrow pass without any shuffle."""
    tune(spark, 1000)
    return arrow_map(spread(table(spark, sf_dir, "books").select("book_id", "description", "html")), _found_kernel, "book_id bigint, field string, markup string, main boolean")


def p5_found(spark, sf_dir: str) -> DataFrame:
    """The values that hold markup, with its kinds."""
    return p5_kinds(spark, sf_dir).select("book_id", "field", "markup")


def p5_clean(spark, sf_dir: str) -> DataFrame:
    """Every description and page as clean text with its structure."""
    tune(spark, 1000)
    return arrow_map(spread(table(spark, sf_dir, "books").select("book_id", "description", "html")), _clean_kernel, "book_id bigint, field string, clean_text string")
