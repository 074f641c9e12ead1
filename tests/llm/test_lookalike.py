import unicodedata

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import rows
from quire.llm import lookalike as L


def slow(s):
    """The same form, character by character."""
    out = ""
    for c in s:
        d = unicodedata.decomposition(c)
        if ord(c) in L.INVISIBLE:
            c = ""
        elif unicodedata.category(c) == "Zs" or c in "\t\n\r\x0b\x0c\x85\u2028\u2029":
            c = " "
        elif d.startswith(("<wide>", "<narrow>")) or (d.startswith("<compat>") and unicodedata.category(c)[0] in "LN"):
            c = unicodedata.normalize("NFKC", c)
        out += c
    out = "".join(unicodedata.normalize("NFD", L.CONFUSABLE.get(x, x)) for x in unicodedata.normalize("NFD", out))
    return " ".join(x for x in unicodedata.normalize("NFC", out).split(" ") if x)


MARKS = "\u0301\u0308\u0323\u0307\u0327\u0328\u0331\u0345\u0306"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("aeixqsоеиЕΑωdD" + MARKS + "ᄀ가각ᅡᆨ한ㄱㅏ🄀𝐀丽ऩ़न", max_size=9), max_size=5))
def test_marks_and_syllables_compose_canonically(texts):
    assert L.unify(pa.array(texts, pa.string())).to_pylist() == [slow(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("aexqsudDSé" + MARKS + "ᄀ가ᅡᆨ한", max_size=9), max_size=5))
def test_agrees_with_canonical_composition(texts):
    assert L.unify(pa.array(texts, pa.string())).to_pylist() == [unicodedata.normalize("NFC", t) for t in texts]


def test_order_of_marks_and_readers_form():
    a = pa.array(["q\u0323\u0307", "q\u0307\u0323", "x\u0327\u0301", "\u1112\u1161\u11ab", "\ufe0fa\U000e0041", None, ""])
    got = L.unify(a).to_pylist()
    assert got[0] == got[1] and got[3] == "\ud55c" and got[4] == "a" and got[5:] == [None, ""]
    texts = ["Bойна и мир", "Вoйнa", "Th\u0435 Tide", "СССР", "сор The \u0430", "Ελλάς O", "\uff34ide", "ё\u0435\u0308"]
    assert L.shown(pa.array(texts)).to_pylist() == ["Война и мир", "Война", "The Tide", "СССР", "сор The \u0430", "Ελλάς O", "Tide", "ёё"]
    assert L.unify(pa.array(["Война", "Вoйнa"])).to_pylist()[0] == L.unify(pa.array(["Вoйнa"])).to_pylist()[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("aeiAÉé́̈ ​аеоёｆﬁ　-², \t", max_size=12), max_size=6))
def test_arrays_match_characters(texts):
    assert L.unify(pa.array(texts, pa.string())).to_pylist() == [slow(t) for t in texts]


def test_pairs(spark, make):
    d = make(
        books=[
            {"book_id": 1, "title": "The Tide", "authors": ["José Roe", None]},
            {"book_id": 2, "title": "Th\u0435 Tide", "authors": ["Jose\u0301 Roe", "Jose\u0301 Roe"]},
            {"book_id": 3, "title": "The  Tide ", "authors": []},
            {"book_id": 4, "title": "The tide", "authors": None},
            {"book_id": 5, "title": None, "authors": ["Jose Roe"]},
            {"book_id": 6, "title": "\u200b", "authors": ["Jose\u0301 Roe"]},
            {"book_id": 7, "title": "", "authors": [""]},
            {"book_id": 8, "title": "Ｔhe\u00a0Tide", "authors": [" "]},
        ]
    )
    assert rows(L.p4_found(spark, d), "field", "book_id_a", "book_id_b") == [("authors", 1, 2), ("authors", 1, 6)] + [("title", 1, 2), ("title", 1, 8), ("title", 2, 3), ("title", 2, 8), ("title", 3, 8)]
    assert L.p4_found(spark, make(books=[])).count() == 0


def test_long_text():
    s = "é" * 300_000
    assert L.unify(pa.array([s, None, unicodedata.normalize("NFD", s)])).to_pylist() == [s, None, s]
