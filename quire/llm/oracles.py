"""SQL that checks those operators for training text that SQL can express over whole tables."""

from __future__ import annotations

import unicodedata

from quire.llm.lookalike import CONFUSABLE, INVISIBLE
from quire.plans.inspect import _unescaped

_SIGNS = r"[\p{P}\p{Z}\s\x{0000}-\x{001F}\x{007F}-\x{009F}]+"
_FOLD = "replace(replace(replace(replace(lower({x}), 'ß', 'ss'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ς', 'σ')"
_SQUEEZE = "regexp_replace(" + _FOLD + ", 'SIGNS', '', 'g')"
_NAME = "array_to_string(list_sort(list_filter(string_split(regexp_replace(regexp_replace(" + _FOLD.format(x="a") + ", '[''’‘`]', '', 'g'), '" + _SIGNS + "', ' ', 'g'), ' '), lambda p: p <> '')), ' ')"
_KEYS = f"""with k as (select book_id, {_SQUEEZE.format(x="title").replace("SIGNS", _SIGNS)} || chr(31) || array_to_string(list_sort(list_filter(list_transform(list_filter(coalesce(authors, []), lambda a: a is not null), lambda a: {_NAME}), lambda n: n <> '')), chr(30)) || chr(31) ||
    coalesce({_SQUEEZE.format(x="isbn").replace("SIGNS", _SIGNS)}, '') as key
  from books where book_id is not null and regexp_replace(title, '[\\p{{Z}}\\s]+', '', 'g') <> ''), g as (select key, min(book_id) as low, count(*) as n from k group by 1)"""

def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _looks() -> tuple[dict[str, str], dict[str, str]]:
    """(characters by the one they look like, characters by the several they look like), each by its own decomposition."""
    one, many = {}, {}
    for c in range(0x2FA20):
        ch = chr(c)
        if 0xD800 <= c < 0xE000 or unicodedata.category(ch) == "Zs" or c in INVISIBLE:
            continue
        d = unicodedata.decomposition(ch)
        wide = d.startswith(("<wide>", "<narrow>")) or (d.startswith("<compat>") and unicodedata.category(ch)[0] in "LN")
        base = unicodedata.normalize("NFKC" if wide else "NFC", ch)
        to = unicodedata.normalize("NFC", "".join(unicodedata.normalize("NFD", CONFUSABLE.get(x, x)) for x in unicodedata.normalize("NFD", base)))
        if to != base or wide:
            (one if len(to) == 1 else many)[ch] = to
    return one, many


def _look_sql(x: str) -> str:
    """The form that all texts of one look share: invisible characters out, look-alikes replaced, composed, blanks squeezed."""
    one, many = _looks()
    gone = "".join(f"\\x{{{c:04X}}}" for c in INVISIBLE)
    x = f"nfc_normalize(regexp_replace({x}, '[{gone}\\x{{E0000}}-\\x{{E0FFF}}]+', '', 'g'))"
    for ch, to in many.items():
        x = f"replace({x}, {_quoted(ch)}, {_quoted(to)})"
    x = f"nfc_normalize(translate({x}, {_quoted(''.join(one))}, {_quoted(''.join(one.values()))}))"
    return f"trim(regexp_replace({x}, '[\\p{{Zs}}\\t\\n\\r\\x0B\\x0C\\x{{85}}\\x{{2028}}\\x{{2029}}]+', ' ', 'g'))"


_P4 = f"""with v as (select 'title' as field, book_id, title as raw from books union all select 'authors', book_id, unnest(authors)
    from books), d as (select distinct field, raw from v where raw is not null),
  l as (select field, raw, {_look_sql('raw')} as look, trim(regexp_replace(raw, '[ \t\n\r\x0B\x0C]+', ' ', 'g')) as plain from d), k as (select distinct v.field, v.book_id, l.look, l.plain
    from v join l on l.field = v.field and l.raw = v.raw where l.look <> '')
  select distinct a.field, a.book_id as book_id_a, b.book_id as book_id_b from k a join k b on a.field = b.field and a.look = b.look and a.plain <> b.plain and a.book_id < b.book_id"""

_LETTER = r"[\p{L}\p{N}_]"
_HYPHEN = rf"({_LETTER})[-‐‑\x{{AD}}](?:[ \t]*\r?\n[ \t>|»*#]*)?({_LETTER})"


def _words_sql(x: str) -> str:
    for c in (*range(32, 127), 160, 173, *range(8211, 8231)):  # numeric references, as far as such texts hold them
        x = f"replace(replace({x}, '&#{c};', chr({c})), '&#x{c:x};', chr({c}))"
    x = f"nfc_normalize({_unescaped(x)})"
    for _ in range(2):  # matches that share a letter need a second pass
        x = f"regexp_replace({x}, '{_HYPHEN}', '\\1\\2', 'g')"
    return f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+')"


#: Every place where a document and an item are aligned, word by word.
_ALIGNED = f"""with d as (select row_number() over () as row, doc_id, {_words_sql('text')} as w from documents where text is not null), t as (select item_id, {_words_sql('x')} as w
    from (select item_id, passage as x from eval_items union all select item_id, question from eval_items) where x is not null),
  i as (select row_number() over () as seq, item_id, w, cast(len(w) as int) as n, case when len(w) >= 20 then 6 else cast(ceil((len(w) - len(w) // 10) / (len(w) // 10 + 1)) as int) end as s
    from t where len(w) > 0),
  ip as (select seq, s, w, unnest(range(1, n - s + 2)) as p from i), ig as (select seq, s, p, array_to_string(w[p : p + s - 1], ' ') as g from ip),
  dp as (select row, s, w, unnest(range(1, len(w) - s + 2)) as p from d, (select distinct s from i)), dg as (select row, s, p, array_to_string(w[p : p + s - 1], ' ') as g from dp),
  al as (select distinct dg.row, ig.seq, dg.p - ig.p as shift from ig join dg on ig.s = dg.s and ig.g = dg.g), e as (select al.row, al.seq, al.shift, i.item_id, i.n, i.w as iw, d.w as dw, unnest(range(greatest(1, 1 - shift), least(i.n, len(d.w) - shift) + 1)) as p
    from al join i on i.seq = al.seq join d on d.row = al.row),
  m as (select row, seq, shift, item_id, n, p, iw[p] = dw[p + shift] as same from e), o as (select *, sum(case when same then 0 else 1 end)
    over (partition by row, seq, shift order by p rows unbounded preceding) as other from m)"""
_P9 = f"""{_ALIGNED},
  long as (select distinct a.row, a.item_id from o a join o b on a.row = b.row and a.seq = b.seq and a.shift = b.shift and a.same and b.same
    and b.p - a.p + 1 >= 20 and 10 * (b.other - a.other) <= b.p - a.p + 1),
  whole as (select row, any_value(item_id) as item_id from o group by row, seq, shift having count(*) = any_value(n) and 10 * max(other) <= any_value(n)),
    f as (select row, item_id from long union select row, item_id from whole) select distinct d.doc_id, f.item_id from f join d on d.row = f.row"""

_P9_SPANS = f"""{_ALIGNED},
  c as (select a.row, a.seq, a.shift, a.item_id, a.p, max(b.p) as q from o a join o b on a.row = b.row and a.seq = b.seq and a.shift = b.shift and a.same and b.same and b.p >= a.p
    and 10 * (b.other - a.other) <= b.p - a.p + 1 group by 1, 2, 3, 4, 5), l as (select * from c where q - p + 1 >= 20),
  r as (select *, coalesce(max(q) over (partition by row, seq, shift order by p rows between unbounded preceding and 1 preceding), 0) as reached from l), k as (select row, seq, shift, item_id, p, q from r where q > reached),
  u as (select row, seq, shift, any_value(item_id) as item_id, 1 as p, any_value(n) as q from o group by row, seq, shift having count(*) = any_value(n) and 10 * max(other) <= any_value(n)),
  z as (select * from k union all select u.* from u where not exists (select 1 from k where k.row = u.row and k.seq = u.seq and k.shift = u.shift))
  select d.doc_id, z.item_id, cast(z.p + z.shift - 1 as int) as first_word, cast(z.q - z.p + 1 as int) as n_words, round((z.q - z.p + 1) / len(d.w), 6) as coverage from z join d on d.row = z.row"""

_P4_UNIFY = f"""with v as (select 'title' as field, book_id, title as raw from books union all select 'authors', book_id, unnest(authors) from books), l as (select field, book_id, raw, {_look_sql('raw')} as uniform from v where raw is not null)
  select field, book_id, raw, uniform, raw <> uniform as changed from l"""

ORACLES = {
    "p4_found": _P4,
    "p4_unify": _P4_UNIFY,
    "p9_found": _P9,
    "p9_spans": _P9_SPANS,
    "p7_groups": f"{_KEYS} select low as book_id, n as n_copies from g",
    "p7_found": f"{_KEYS} select g.low as book_id_a, k.book_id as book_id_b from k join g on g.key = k.key where g.n > 1 and k.book_id <> g.low",
}
