import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import rows
from quire.operators import packed as P


def test_scan_quotes_and_delimiters():
    value, cls, quoted = P.scan(pa.array(['a; "b; c",d', "x", "", None, "A, B and C & D", "p；q、r", '"The ""New"" Drama",F', 'odd " quote; y']), True)
    assert value.to_pylist() == [["a", "b; c", "d"], ["x"], [""], [""], ["A", "B", "C", "D"], ["p", "q", "r"], ['The "New" Drama', "F"], ['odd " quote', "y"]]
    assert cls.to_pylist()[0] == [0, 2, 1] and quoted.to_pylist()[0] == [False, True, False]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text("abc é", min_size=1, max_size=6).filter(lambda s: s.strip()), min_size=1, max_size=5), min_size=1, max_size=6))
def test_scan_matches_split(parts):
    value, _, _ = P.scan(pa.array(["; ".join(p) for p in parts]), False)
    assert value.to_pylist() == [[x.strip() for x in p] for p in parts]


def test_values_from_the_corpus(spark, make):
    single = [{"book_id": 100 + i, "subjects": [s]} for i in range(4) for s in ("Maps", "Drama", "History", "History, Local")]
    d = make(
        books=[
            {"book_id": 1, "subjects": ["Maps; Drama", None, " ", "History, Local"], "authors": ["Ann Lee"]},
            {"book_id": 2, "subjects": ["Maps,,Drama;History, Local", "Maps; Drama"], "authors": None},
            {"book_id": 3, "subjects": None, "authors": []},
            *single,
        ],
        opf_metadata=[{"book_id": 1, "creators": ["Lee, Ann; Roe, Bo", "Lee, Ann", "Ann Lee, Bo Roe and Cy Poe", "Lee, Ann, 1950-", None, ""]}, *({"book_id": 50 + i, "creators": ["Harbour & Sons"]} for i in range(4))],
    )
    got = rows(P.p3_found(spark, d), "book_id", "field", "pos", "item_no")
    assert got == [(1, "creators", 1, 1), (1, "creators", 1, 2), (1, "creators", 3, 1), (1, "creators", 3, 2), (1, "creators", 3, 3), (1, "subjects", 1, 1), (1, "subjects", 1, 2)] + [(2, "subjects", 1, i) for i in (1, 2, 3)] + [(2, "subjects", 2, 1), (2, "subjects", 2, 2)]
    all_values = {(r["book_id"], r["pos"], r["item_no"]): r["value"] for r in P.p3_unpack(spark, d).collect() if r["field"] == "subjects"}
    assert all_values[2, 1, 3] == "History, Local" and all_values[1, 4, 1] == "History, Local"


def test_empty_tables(spark, make):
    d = make(books=[], opf_metadata=[])
    assert P.p3_found(spark, d).count() == 0


def test_long_headings_and_firms_stay_whole(spark, make):
    heading, firm = "Salt, Bread, Iron, Wool, Fish / Rye", "Aab, Bcc, Cdd, Dee, Eff & Gee"
    books = [{"book_id": 10 + i, "subjects": [heading]} for i in range(4)] + [{"book_id": 1, "subjects": [f"Maps; {heading}", f"{heading}, Maps"]}, *({"book_id": 20 + i, "subjects": ["Maps"]} for i in range(4))]
    d = make(books=books, opf_metadata=[{"book_id": 10 + i, "creators": [firm]} for i in range(4)] + [{"book_id": 1, "creators": [f"{firm}; Ann Lee"]}])
    got = {(r["field"], r["pos"], r["item_no"]): r["value"] for r in P.p3_unpack(spark, d).collect() if r["book_id"] == 1}
    assert got == {("subjects", 1, 1): "Maps", ("subjects", 1, 2): heading, ("subjects", 2, 1): heading, ("subjects", 2, 2): "Maps", ("creators", 1, 1): firm, ("creators", 1, 2): "Ann Lee"}
    assert {r["book_id"] for r in P.p3_found(spark, d).collect()} == {1}
