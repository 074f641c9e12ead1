"""Problem 6: variant spellings of names are linked to the person or organisation they name.

Merge-and-rematch: every agent starts as a profile of its own name. Distinct mention strings are blocked with profiles by keys that survive one typing
error (a name part with any one letter left out), compared part by part, and a mention with one best profile is merged into it: the profile takes over
the mention's spellings of the family name, of the given names and their initials, or of an organisation's words. After each round the mentions that fit a
profile but for one word are counted over the whole corpus: a given name that stands beside the families of one given name, or a word that stands for one
word beside several organisations' own words, is a form of it (a nickname, a trade abbreviation), and every profile with that word takes it over. The richer
profiles re-enter blocking with the mentions still unmatched, until a round merges and teaches nothing new. No nickname or trade word is listed here.

Persons: family name first or last, given names in full, as nickname, shortened to initials or left out after the first, titles, roles and life dates
ignored. Organisations: legal forms and articles ignored, words abbreviated or reordered, but the rarest word of a name must be there. A name part may hold one typing
error (a letter left out, doubled, exchanged, or swapped with its neighbour). Ties between agents stay unlinked. A blocking key holds the given name beside the family
name, and costs are compared by a map-side minimum, so a common family name never gathers its mentions or profiles in one task.

Defined results: null, blank and several-name mentions are not linked; a mention equal to ``agent_name`` is linked in ``p6_links`` but is no case of
``p6_found``; agents without id or name link nothing; equal agent names are a tie; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.lookalike import unify
from quire.runtime import arrow_map, checkpointed, each_small_or_shuffled, spread, table, tune

# Titles and roles, legal forms and articles.
TITLES = frozenset("dr prof professor mr mrs ms miss sir dame rev hon by ed eds editor edited von_ author illustrator illus trans translator written jr sr phd md".split())
LEGAL = frozenset("inc ltd limited gmbh llc plc corp corporation publisher the and sa ag bv kg srl spa ab".split())
#: A legal form that is also an abbreviation: left out only where a name has no word for it.
MAYBE_LEGAL = "co"
#: Places (families, or own words of organisations) that must agree before a word counts as a form of another one; one is enough for a shortened form.
PLACES = 2


def fold(text: str) -> str:
    """Lower case without accents; letters that do not decompose take their base letter."""
    t = unicodedata.normalize("NFKD", text).lower()
    t = "".join(c for c in t if not unicodedata.combining(c))
    return t.translate({0x142: "l", 0xF8: "o", 0xDF: "ss", 0xE6: "ae", 0x153: "oe", 0x111: "d"})


def near(a: str, b: str) -> int:
    """0 if equal, 1 if one letter was left out, added, exchanged or swapped with its neighbour, else 9."""
    if a == b:
        return 0
    la, lb = len(a), len(b)
    if abs(la - lb) > 1 or min(la, lb) < 3:
        return 9
    i = 0
    while i < min(la, lb) and a[i] == b[i]:
        i += 1
    if la == lb:
        if a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :]):
            return 1
        return 9
    return 1 if (a[i + 1 :] == b[i:] if la > lb else a[i:] == b[i + 1 :]) else 9


def _several(t: str) -> bool:
    """Whether a mention holds several names."""
    t = re.sub(r"&\s*(?:co|cie|sons)\b\.?", " ", t, flags=re.I)
    if re.search(r"[;|/&•·、；\n\t]| (?:and|und|et|with|y|avec|mit) ", t):
        return True
    parts = [p.strip() for p in t.split(",")]
    parts = [p for p in parts if p and not re.match(r"[\d(c]?\.?\s*\d{4}|(jr|sr|ltd|inc|gmbh|limited|llc|phd|md)\.?$", p, re.I)]
    return len(parts) > 2 or (len(parts) == 2 and len(parts[0].split()) > 1 and len(parts[1].split()) > 1 and len(parts[0]) > 3)


@lru_cache(maxsize=200_000)
def person(text: str) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """Readings of a personal name: (family name, given names); an initial is one letter."""
    t = re.sub(r"\([^)]*\)|\[[^\]]*\]|,?\s*\b(?:b\.|d\.)?\s*\d{4}\s*[-–]?\s*(?:\d{4})?", " ", text)
    if _several(t):
        return ()
    head, _, tail = t.partition(",")

    def parts(s: str) -> list[str]:
        out = []
        for w in re.split(r"[\s.\-_‐‑]+", s):
            w = w.strip("'’\"")
            if not w:
                continue
            if fold(w) in TITLES:
                continue
            if 2 <= len(w) <= 3 and w.isupper() and not s.isupper():
                out += list(fold(w))
            else:
                out.append(fold(w))
        return [w for w in out if re.search(r"\w", w)]

    a, b = parts(head), parts(tail)
    if b and a:
        return ((" ".join(a), tuple(b)),)
    w = a or b
    if len(w) < 2:
        return ()
    found = []
    if len(w[-1]) > 1:
        found.append((w[-1], tuple(w[:-1])))
    if len(w[0]) > 1:
        found.append((w[0], tuple(w[1:])))
    return tuple(found)


@lru_cache(maxsize=200_000)
def firm(text: str) -> tuple[str, ...]:
    """The words of an organisation's name; legal forms and articles are left out."""
    t = re.sub(r"&\s*co\b\.?", " ", fold(text))
    return tuple(w for w in re.split(r"[\s.,\-_()&/‐‑]+", t) if w and w not in LEGAL)


def leave_one_out(w: str) -> set[str]:
    return {w} | ({w[:i] + w[i + 1 :] for i in range(len(w))} if len(w) >= 4 else set())


def _person_keys(family: str, first: str) -> set[str]:
    """Keys that meet where one of the two names holds one error: the other one is then whole."""
    out = {f"p{k} {first}" for k in leave_one_out(family)}
    return out | ({f"q{family} {k}" for k in leave_one_out(first)} if len(first) >= 4 else set())


def mention_keys(text: str) -> set[str]:
    out: set[str] = set()
    for family, given in person(text):
        if given:
            out |= _person_keys(family, given[0])
    if not _several(text):
        for w in firm(text):
            if len(w) >= 4:
                out |= {"f" + k for k in leave_one_out(w)}
    return out


_SOUNDS = re.compile(r"ph|c[kh]?|kh?|qu?|(\w)\1+")


def _sound(w: str) -> str:
    return _SOUNDS.sub(lambda m: "f" if m[0] == "ph" else m[1] or "k", w)


def short_form(m: str, g: str) -> bool:
    """Whether a given name is another one cut short, perhaps with an ending of pet names."""
    stem = re.sub(r"(?:ie|ey|y|i|e|s|o)$", "", m)
    stem, whole = _sound(stem), _sound(g)
    return len(stem) >= 2 and len(m) < len(g) + 2 and (whole.startswith(stem) or (len(stem) >= 4 and stem in whole))


def abbreviates(m: str, w: str) -> bool:
    """Whether a word shortens another one: up to four of its letters, in order, from its first."""
    if not (2 <= len(m) <= 4 < len(w)) or m[0] != w[0]:
        return False
    at = iter(w)
    return all(c in at for c in m)


def _given(mention: tuple[str, ...], p: dict) -> tuple[int, list[str]] | None:
    """Cost of the given names of a mention against a profile's, and the spellings it would add; None for another person."""
    if not mention or len(mention) > 2:
        return None
    m, new = mention[0], []
    if len(m) == 1:
        if m not in p["initials"]:
            return None
        cost = 0
    else:
        cost = _nearest(m, p["firsts"])
        if cost > 1 or (cost == 1 and len(m) < 4):
            return None
        if cost:
            new.append("firsts\t" + m)
        if m[0] not in p["initials"]:
            new.append("initials\t" + m[0])
    for extra in mention[1:]:
        if any(extra[0] == x[0] for x in p["middles"] if len(extra) == 1 or len(x) == 1):
            d = 0
        else:
            d = _nearest(extra, [x for x in p["middles"] if len(x) > 1]) if len(extra) > 1 else 9
        if d > 1:
            return None
        cost += d
        if len(extra) > 1 and extra not in p["middles"]:
            new.append("middles\t" + extra)
    return cost, new


def _nearest(word: str, spellings: list[str]) -> int:
    return 0 if word in spellings else min((near(word, x) for x in spellings), default=9)


def person_cost(text: str, p: dict) -> tuple[float, list[str]] | None:
    """Cost of a mention against a person's profile, and the spellings that the profile takes over if they merge."""
    best = None
    for family, given in person(text):
        f = _nearest(family, p["families"])
        if f > 1:
            continue
        g = _given(given, p)
        if g is None or f + g[0] > 1:
            continue
        short = 0.3 if len(given[0]) == 1 else 0.0
        lacking = 0.1 if p["middles"] and len(given) == 1 else 0.0
        c = f + g[0] + short + lacking
        if best is None or c < best[0]:
            # a family name is taken over only where the first given name is beyond doubt
            best = c, g[1] if not f else ["families\t" + family] if len(given[0]) > 1 else []
    return best


def _run_on(text: str, words: list[list[str]]) -> int:
    """The errors of a name whose blanks are left out against words in any of their spellings: 0, 1 in one word, else 9."""
    ends = [{0}]
    for w in words:
        ends.append({i + len(x) for i in ends[-1] for x in w if text.startswith(x, i)})
    if len(text) in ends[-1]:
        return 0
    starts = {len(text)}
    for k in range(len(words) - 1, -1, -1):
        if any(near(text[i:j], x) <= 1 for i in ends[k] for j in starts if i < j for x in words[k]):
            return 1
        starts = {j - len(x) for j in starts for x in words[k] if text.endswith(x, 0, j)}
    return 9


def firm_cost(text: str, p: dict) -> tuple[float, list[str]] | None:
    """As ``person_cost``, for an organisation; a cost of ``HALF`` is no match but all words agree except one, which is named."""
    words, its = list(firm(text)), list(p["words"])
    if not words:
        return None
    known = {w: [w] for w in its}
    for pair in p["spellings"]:
        w, _, x = pair.partition(" ")
        known[w].append(x)
    run, cost = "".join(words), 0.0
    if words == its:
        return 0.0, []
    if len(words) == len(its) + 1 and MAYBE_LEGAL in words and MAYBE_LEGAL not in its:
        words.remove(MAYBE_LEGAL)
    # a blank may be left out or swapped with its neighbour
    if len(its) > 1 and (near(run, "".join(its)) <= 1 or (p["spellings"] and _run_on(run, [known[w] for w in its]) <= 1)):
        cost = 0.5
    if len(words) != len(its):
        return (cost, []) if cost else None
    off, new, left = 0.0, [], list(its)
    for price in (0.0, 0.05, 1.0):  # equal words first, then abbreviations, then words with one error
        for target in list(left):
            if price == 0.05:
                k = next((i for i, w in enumerate(words) if target not in p["families"][:1] and any(abbreviates(w, x) for x in known[target])), None)
            else:
                k = next((i for i, w in enumerate(words) if _nearest(w, known[target]) == price), None)
            if k is None:
                continue
            w = words.pop(k)
            left.remove(target)
            off += price
            if price == 1.0:
                new += [f"spellings\t{target} {w}"] + (["families\t" + w] if target == p["families"][0] else [])
    if left:
        if cost:
            return cost, []
        return (HALF, [f"{left[0]}\t{words[0]}"]) if len(left) == 1 and not off and left[0] != p["families"][0] and len(words[0]) > 1 else None
    if cost:
        return cost, new if off <= 1 else []
    return (off, new) if off < 2 else None


def profile(agent_id: int, kind: str, name: str, anchor: str | None = None) -> dict | None:
    empty = {n: [] for n in _NAMES[2:]}
    if kind == "publisher":
        words = firm(name)
        return {**empty, "agent_id": agent_id, "kind": kind, "families": [anchor or words[0]], "words": list(words)} if words else None
    read = person(name)
    if not read or not read[0][1]:
        return None
    family, given = read[0]
    return {**empty, "agent_id": agent_id, "kind": kind, "families": [family], "firsts": [given[0]], "initials": [given[0][0]], "middles": list(given[1:2])}


#: The cost that marks a mention which fits but for one word.
HALF = 5.0
# words: those of an organisation; families: its rarest word; spellings: pairs of a word and a form it was met in, with a blank between
_NAMES = ["agent_id", "kind", "families", "firsts", "initials", "middles", "words", "spellings"]
_KINDS = [pa.int32(), pa.string(), *[pa.list_(pa.string())] * 6]
PROFILE = "agent_id int, kind string, " + ", ".join(f"{n} array<string>" for n in _NAMES[2:])


def _profiles_of(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[n] for p in rows], k) for n, k in zip(_NAMES, _KINDS)], names=_NAMES)


def _words_kernel(b: pa.RecordBatch) -> pa.RecordBatch:
    rows = [(a, i, w) for a, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for i, w in enumerate(firm(n))]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string()))], names=["agent_id", "at", "word"])


def _profiles_kernel(b: pa.RecordBatch) -> pa.RecordBatch:
    got = [profile(*r) for r in zip(*(c.to_pylist() for c in b.columns)) if r[2]]
    return _profiles_of([p for p in got if p])


def _grow_kernel(b: pa.RecordBatch) -> pa.RecordBatch:
    rows = b.to_pylist()
    for r in rows:
        for entry in sorted(set(r["new"] or ())):
            part, _, spelling = entry.partition("\t")
            if spelling not in r[part]:
                r[part].append(spelling)
    return _profiles_of(rows)


def _hash(key: str) -> int:
    """A blocking key as a number; two keys that share one cost a comparison, no more."""
    x = xxhash.xxh64_intdigest(key)
    return x - (1 << 64) if x >> 63 else x


def _profile_keys(b: pa.RecordBatch) -> pa.RecordBatch:
    out: tuple[list, list] = ([], [])
    for r in b.to_pylist():
        if r["kind"] == "publisher":
            keys = {"f" + k for w in r["families"] for k in leave_one_out(w)}
        else:
            # one more error is looked for beside the agent's own names; two learned spellings meet a mention as they are
            keys = {f"p{f} {g}" for f in r["families"] for g in r["firsts"]}
            keys = keys.union(*(_person_keys(f, r["firsts"][0]) for f in r["families"]), *(_person_keys(r["families"][0], g) for g in r["firsts"]))
            keys |= {f"p{k} {i}" for k in {*r["families"], *leave_one_out(r["families"][0])} for i in r["initials"]}
        for k in {_hash(k) for k in keys}:
            out[0].append(k)
            out[1].append(r["agent_id"])
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32())], names=["key", "agent_id"])


def _mention_kernel(b: pa.RecordBatch) -> pa.RecordBatch:
    """The uniform text of each mention, its keys, and the (family name, given name) pairs that it may hold."""
    raw = b.column(0)
    uniform = unify(raw)
    keys = [sorted({_hash(k) for k in mention_keys(u)}) for u in uniform.to_pylist()]
    pairs = [[f"{f}\t{g[0]}" for f, g in person(u) if g and len(g[0]) > 1] for u in uniform.to_pylist()]
    keep = pa.array([bool(k) for k in keys])
    kind = pa.list_(pa.string())
    return pa.RecordBatch.from_arrays([raw, uniform, pa.array(keys, pa.list_(pa.int64())), pa.array(pairs, kind)], names=["mention", "uniform", "keys", "pairs"]).filter(keep)


def _once_kernel(b: pa.RecordBatch) -> pa.RecordBatch:
    first = {}
    for i, x in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist())):
        first.setdefault(x, i)
    return b.take(pa.array(list(first.values()), pa.int64()))


def _cost_kernel(b: pa.RecordBatch) -> pa.RecordBatch:
    """The cost of each mention against one profile; pairs that do not fit give no row."""
    out: tuple[list, list, list, list] = ([], [], [], [])
    for m, u, p in zip(*(c.to_pylist() for c in b.columns)):
        c = firm_cost(u, p) if p["kind"] == "publisher" else person_cost(u, p)
        if c is not None:
            for o, x in zip(out, (m, p["agent_id"], float(c[0]), c[1] if c[0] < HALF else [f"{c[1][0]}\t{p['families'][0]}"])):
                o.append(x)
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.list_(pa.string()))], names=["mention", "agent_id", "cost", "new"])


def _short_kernel(b: pa.RecordBatch) -> pa.RecordBatch:
    known, form = b.column(1).to_pylist(), b.column(2).to_pylist()
    return pa.RecordBatch.from_arrays([*b.columns, pa.array([k == "g" and short_form(f, w) for k, w, f in zip(b.column(0).to_pylist(), known, form)])], names=[*b.schema.names, "short"])


def _close_kernel(b: pa.RecordBatch) -> pa.RecordBatch:
    close = [_nearest(f, k) <= 1 for f, k in zip(b.column(1).to_pylist(), b.column(3).to_pylist())]
    return pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(close, pa.bool_())], names=["word", "form", "place", "close"])


def profiles_of(agents: DataFrame) -> DataFrame:
    """The starting profiles; an organisation's anchor is the word that fewest organisations share, by powers of four, the first of them on a tie."""
    a = agents.where("agent_id is not null and agent_name is not null").select("agent_id", "agent_kind", "agent_name")
    words = arrow_map(a.where("agent_kind = 'publisher'").select("agent_id", "agent_name"), _words_kernel, "agent_id int, at int, word string")
    often = words.groupBy("word").agg(F.countDistinct("agent_id").alias("n"))
    anchor = words.join(often, "word").where(F.length("word") >= 4).groupBy(F.col("agent_id").alias("w_id")).agg(F.min(F.struct(F.floor(F.log(4.0, "n")).alias("rare"), "at", "word"))["word"].alias("anchor"))
    return checkpointed(arrow_map(a.join(anchor, F.col("agent_id") == F.col("w_id"), "left").select("agent_id", "agent_kind", "agent_name", "anchor"), _profiles_kernel, PROFILE))


def forms_of(left: DataFrame, halves: DataFrame, profiles: DataFrame) -> DataFrame:
    """(kind, word, form): forms of given names and of organisations' words that the unmatched mentions teach.

    A form must stand in at least ``PLACES`` places where its word is expected, and in more than half of all places where any word is; a given name
    cut short needs one place only.
    """
    met = left.select(F.explode("pairs").alias("x")).select(F.split("x", "\t").alias("x")).select(F.col("x")[0].alias("place"), F.col("x")[1].alias("form")).distinct()
    given = profiles.where("kind <> 'publisher'").select(F.explode("families").alias("place"), F.get("firsts", F.lit(0)).alias("word"), F.col("firsts").alias("known")).where("length(word) > 1")
    # a name that some agent of the family bears, or bears but for an error, is that agent's and says nothing about the others
    pairs = arrow_map(met.join(given.hint("merge"), "place").select("word", "form", "place", "known"), _close_kernel, "word string, form string, place string, close boolean")
    borne = F.max("close").over(Window.partitionBy("form", "place"))
    new = pairs.withColumn("borne", borne).where("not borne").select(F.lit("g").alias("kind"), "word", "form", "place")
    half = halves.select(F.explode("new").alias("x")).select(F.split("x", "\t").alias("x"))
    seen = new.unionByName(half.select(F.lit("w").alias("kind"), F.col("x")[0].alias("word"), F.col("x")[1].alias("form"), F.col("x")[2].alias("place")))
    # one row of each place of a form is marked, so both counts come from one reading: a plan that reads its sources for each count has many times the joins
    first = (F.row_number().over(Window.partitionBy("kind", "form", "place").orderBy("word")) == 1).cast("int")
    n = seen.distinct().withColumn("first", first).groupBy("kind", "word", "form").agg(F.count(F.lit(1)).alias("n"), F.sum("first").alias("first"))
    n = n.withColumn("of", F.sum("first").over(Window.partitionBy("kind", "form")))
    judged = arrow_map(n.select("kind", "word", "form", "n", "of"), _short_kernel, "kind string, word string, form string, n bigint, of bigint, short boolean")
    return judged.where(f"short or (n >= {PLACES} and 2 * n > of)").select("kind", "word", "form")


def resolve(mentions: DataFrame, agents: DataFrame) -> DataFrame:
    """(mention, agent_id) for the distinct strings of ``mentions`` (column ``mention``) that name an agent; both sides stay distributed.

    A round joins the blocking keys of profiles with those of unmatched mentions and keeps, for each mention, the agents of the least cost by a partial minimum; two of
    them are a tie. Only measured sides are broadcast; the other joins are merged as they lie, since each broadcast and each stage takes memory of the driver that is not soon given back. The first round merges mentions without errors only, so that forms are learned before errors are forgiven. Spellings of merged mentions go to
    their profile, learned forms to every profile with their word. The loop ends when a round merges nothing and teaches no new form; each further round does one or the other, so it does end.
    """
    profiles = profiles_of(agents)
    distinct = mentions.where("mention is not null and trim(mention) <> ''").select("mention").distinct()
    known = checkpointed(arrow_map(spread(distinct), _mention_kernel, "mention string, uniform string, keys array<bigint>, pairs array<string>"))
    links, taught, strict = None, None, True
    while True:
        side = checkpointed(arrow_map(profiles, _profile_keys, "key bigint, agent_id int"))
        side, full = each_small_or_shuffled(side, profiles.select(F.col("agent_id").alias("p_id"), F.struct(*_NAMES).alias("profile")))
        # a mention's keys lie side by side, so its repeated agents are dropped inside the batch; one that a batch border leaves costs a comparison and changes no minimum
        pairs = known.select("mention", "uniform", F.explode("keys").alias("key")).join(side, "key").select("mention", "uniform", "agent_id")
        pairs = arrow_map(pairs, _once_kernel, "mention string, uniform string, agent_id int")
        if links is not None:  # the wide arrays of keys are never shuffled: pairs are few, and the merged ones are taken out of them
            pairs = pairs.join(links.select("mention").hint("merge"), "mention", "left_anti")
        costs = arrow_map(pairs.join(full, F.col("agent_id") == F.col("p_id")).select("mention", "uniform", "profile"), _cost_kernel, "mention string, agent_id int, cost double, new array<string>")
        fits, half = F.col("cost") < (1.0 if strict else HALF), F.col("cost") == HALF
        lo, hi = F.min(F.when(fits, F.struct("cost", "agent_id", "new"))), F.max(F.when(fits, F.struct((-F.col("cost")).alias("cost"), "agent_id")))
        best = checkpointed(costs.where(fits | half).groupBy("mention").agg(lo.alias("lo"), hi.alias("hi"), F.collect_set(F.when(half, F.get("new", F.lit(0)))).alias("halves")))
        got = best.where("lo.agent_id = hi.agent_id").select("mention", F.col("lo.agent_id").alias("agent_id"), F.col("lo.new").alias("new"))
        merged = bool(got.select("agent_id").head(1))
        if merged:
            linked = got.select("mention", "agent_id")
            links = linked if links is None else checkpointed(links.unionByName(linked))
        rest = known.where(F.size("pairs") > 0).select("mention", "pairs")
        rest = rest if links is None else rest.join(links.select("mention").hint("merge"), "mention", "left_anti")
        forms = forms_of(rest, best.where("lo is null or lo.agent_id <> hi.agent_id").select(F.col("halves").alias("new")), profiles)
        if taught is not None:
            forms = forms.join(taught.hint("merge"), ["kind", "word", "form"], "left_anti")
        forms = checkpointed(forms)
        learned = bool(forms.select("kind").head(1))
        if not merged and not learned and not strict:
            break
        if learned:
            taught = forms if taught is None else checkpointed(taught.unionByName(forms))
        strict = False
        own = got.select(F.col("agent_id").alias("l_id"), F.explode("new").alias("entry"))
        if learned:
            words = profiles.select("agent_id", F.lit("g").alias("kind"), F.get("firsts", F.lit(0)).alias("word")).unionByName(profiles.select("agent_id", F.lit("w").alias("kind"), F.explode("words").alias("word")))
            entry = F.when(F.col("kind") == "g", F.concat(F.lit("firsts\t"), "form")).otherwise(F.concat(F.lit("spellings\t"), "word", F.lit(" "), "form"))
            own = own.unionByName(words.join(forms.hint("merge"), ["kind", "word"]).select(F.col("agent_id").alias("l_id"), entry.alias("entry")))
        grown = own.groupBy("l_id").agg(F.collect_set("entry").alias("new"))
        profiles = checkpointed(arrow_map(profiles.join(grown.hint("merge"), F.col("agent_id") == F.col("l_id"), "left").select(*_NAMES, "new"), _grow_kernel, PROFILE))
    return (got if links is None else links).select("mention", "agent_id")


def mention_rows(spark, sf_dir: str) -> DataFrame:
    """(book_id, field, pos, mention) of the three fields."""
    b = table(spark, sf_dir, "books")
    a = b.select("book_id", F.lit("books.authors").alias("field"), F.posexplode("authors").alias("pos", "mention"))
    p = b.select("book_id", F.lit("books.publisher").alias("field"), F.lit(0).alias("pos"), F.col("publisher").alias("mention"))
    c = table(spark, sf_dir, "opf_metadata").select("book_id", F.lit("opf_metadata.creators").alias("field"), F.posexplode("creators").alias("pos", "mention"))
    return a.unionByName(p).unionByName(c).select("book_id", "field", (F.col("pos") + 1).cast("int").alias("pos"), "mention")


def p6_links(spark, sf_dir: str) -> DataFrame:
    """Every mention with its agent, and whether it is spelled exactly as the agent's name. Spellings are as many as the corpus has, so they are joined by a shuffle."""
    tune(spark, 5000)
    rows = mention_rows(spark, sf_dir)
    agents = table(spark, sf_dir, "agents")
    links = resolve(rows.select("mention"), agents).join(agents.select(F.col("agent_id").alias("a_id"), "agent_name"), F.col("agent_id") == F.col("a_id"))
    links = links.select(F.col("mention").alias("m"), "agent_id", "agent_name")
    return rows.join(links.hint("merge"), F.col("mention") == F.col("m")).select("book_id", "field", "pos", "mention", "agent_id", (F.col("mention") == F.col("agent_name")).alias("exact"))


def p6_found(spark, sf_dir: str) -> DataFrame:
    """The mentions that name an agent in another spelling."""
    return p6_links(spark, sf_dir).where("not exact").select("book_id", "field", "pos", "agent_id")
