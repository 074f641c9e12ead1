import random

from conftest import rows
from quire.llm import leaks as K

PASSAGE = "After the fire of 1638 Quentin walked from Trodro to Kraret with 8746 rescued plates and one olive case of broad sheets bound for the old harbour shop near the chapel"
QUESTION = "According to the passage how many of the 7425 ledgers that Ignatius carried from Drile to Vost had reached Tobo before 1810 and which were folded"


def brute(doc, item):
    """The longest stretch of equal positions under the rule, over all alignments."""
    d, s, best = K.words(doc), K.words(item), 0
    for shift in range(-len(s) + 1, len(d)):
        same = [0 <= i + shift < len(d) and s[i] == d[i + shift] for i in range(len(s))]
        for i in range(len(s)):
            for j in range(i, len(s)):
                n = j - i + 1
                if same[i] and same[j] and (n - sum(same[i : j + 1])) * K.OTHER <= n:
                    best = max(best, n)
    return best >= K.WORDS


def test_against_brute_force():
    r = random.Random(5)
    w = PASSAGE.split()
    ix = K.index(((1, PASSAGE, QUESTION),))
    for _ in range(120):
        a, n = r.randrange(0, 8), r.randrange(12, 31)
        part = w[a : a + n]
        for _ in range(r.randrange(0, 5)):
            part[r.randrange(len(part))] = r.choice(["zebra", "the", "of"])
        doc = " ".join(r.choices(["some", "other", "the", "words", "of", "1638"], k=r.randrange(0, 12)) + part + r.choices(["more", "text", "and"], k=5))
        assert bool(ix.spans(K.words(doc))) == brute(doc, PASSAGE), doc


def test_normalised(spark, make):
    broken = PASSAGE.upper().replace("PLATES", "PLA-\n> TES").replace(" AND ", " &amp; and\r\n> ", 1)
    d = make(
        documents=[
            {"doc_id": 1, "text": "Intro. " + broken + " End.", "lang": "en"}, {"doc_id": 2, "text": " ".join(PASSAGE.split()[:15])}, {"doc_id": 3, "text": None}, {"doc_id": 4, "text": ""}, {"doc_id": 5, "text": "x " * 100_000 + QUESTION}, {"doc_id": 6, "text": QUESTION + ". " + PASSAGE},
        ],
        eval_items=[{"item_id": 1, "passage": PASSAGE, "question": QUESTION}, {"item_id": 2, "passage": None, "question": " "}, {"item_id": 3, "passage": PASSAGE, "question": None}],
    )
    assert rows(K.p9_found(spark, d), "doc_id", "item_id") == [(1, 1), (1, 3), (5, 1), (6, 1), (6, 3)]
    clean = {r["doc_id"]: r for r in K.p9_clean(spark, d).collect()}
    assert clean[1]["clean_text"] is None and clean[1]["coverage"] > 0.9 and clean[5]["clean_text"].rstrip() == ("x " * 100_000).rstrip()
    assert K.p9_found(spark, make(documents=[], eval_items=[])).count() == 0


def test_short_items_inner_items_and_second_stretches():
    short = "one two three four five six seven eight nine ten"
    ix = K.index(((1, short, ""),))
    assert ix.spans(K.words("x " + short.replace("five", "zebra") + " y")) == [(1, 1, 10)] and not ix.spans(K.words(short.replace("five", "zebra").replace("six", "zebra")))
    w = [f"word{i}" for i in range(60)]
    ix = K.index(((1, " ".join(w), ""), (2, " ".join(w[10:35]), ""), (3, " ".join(w[20:42] + ["else"] * 5), "")))
    assert {(i, n) for i, _, n in ix.spans(["a", *w, "b"])} == {(1, 60), (2, 25), (3, 22)}
    doc = ["a", *w[:25], *["zebra"] * 10, *w[35:], "b"]
    assert sorted(s for s in ix.spans(doc) if s[0] == 1) == [(1, 1, 25), (1, 36, 25)]
    edges = ["zebra", *w[1:19], "zebra"]
    assert K.index(((1, " ".join(w[:20]), ""),)).spans(edges) == [(1, 0, 20)]


def test_every_length_and_place_of_exchanged_words():
    for n in range(1, 41):
        w = [f"w{n}x{i}" for i in range(n)]
        ix = K.Index(((1, " ".join(w), ""),))
        places = [()] if n < 10 else [(i,) for i in range(n)] if n < 20 else [(i, j) for i in range(n) for j in range(i + 1, n, 1 + n // 12)]
        for at in places:
            doc = ["before", *("other" if i in at else x for i, x in enumerate(w)), "after"]
            assert ix.spans(doc), (n, at)
        if n >= 2:
            assert n >= 20 or not ix.spans(["a", *w[:-1], "b"]) or n >= 10


def test_places_of_words_in_the_text():
    r = random.Random(2)
    for _ in range(300):
        t = "".join(r.choice(["Ab", "é", "e\u0301", "-", "-\n> ", " ", "&amp;", "&eacute;", "&#65;", "ﬁ", "Ⅳ", "İ", "ㄱ", "가", "각", "'", "\u00ad", "x9", "&b", "ｶﾞ"]) for _ in range(r.randrange(0, 14)))
        got = K.located(t)
        assert [w for w, _, _ in got] == K.words(t), t
        assert all(0 <= a < b <= len(t) for _, a, b in got) and all(x[2] <= y[1] or x[1:] == y[1:] for x, y in zip(got, got[1:]))
    assert K.without("Ein Wort, zwei W&ouml;rter – drei.", [(1, 2)]) == ("Ein  W&ouml;rter – drei.", 2, 0.4)


def test_blocks_beyond_one(spark, make, monkeypatch):
    r = random.Random(9)
    items = [{"item_id": i, "passage": " ".join(f"{r.choice('abcdef')}{r.randrange(900)}" for _ in range(30)), "question": f"short question {i} of five"} for i in range(9)]
    docs = [{"doc_id": i, "text": "Some Text. " * (30 * (i % 2)) + items[i % 9]["passage" if i % 3 else "question"].upper() + "; the end."} for i in range(20)] + [{"doc_id": 90, "text": "nothing of it " * 50}, {"doc_id": 91, "text": None}]
    d = make(documents=docs, eval_items=items)
    one = rows(K.p9_found(spark, d), "doc_id", "item_id"), rows(K.p9_clean(spark, d), "doc_id", "removed_words")
    monkeypatch.setattr(K, "BLOCK", 2)
    many = rows(K.p9_found(spark, d), "doc_id", "item_id"), rows(K.p9_clean(spark, d), "doc_id", "removed_words")
    assert one == many and one[0] == [(i, i % 9) for i in range(20)]
    kept = {x["doc_id"]: x["clean_text"] for x in K.p9_clean(spark, d).collect()}
    assert kept[1] == "Some Text. " * 30 + "; the end." and kept[0] is None
