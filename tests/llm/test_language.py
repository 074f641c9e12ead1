import os

import pytest
from pyspark.sql import functions as F

from conftest import rows
from quire.llm import language as L

EN = ["The old miller carried two baskets of apples across the square.", "Nobody knew why the letter stayed where it was that evening.", "She opened the iron chest because the road was already closed.", "When the bells ended the keeper told the story of the river."]
DE = ["Der alte Müller trug zwei Körbe voller Äpfel über den Platz.", "Niemand wusste warum der Brief an diesem Abend liegen blieb.", "Sie öffnete die schwere Truhe weil die Straße schon gesperrt war.", "Als die Glocken endeten erzählte der Wächter die Geschichte vom Fluss."]
RU = ["Старый мельник принёс две корзины яблок через площадь.", "Никто не знал почему письмо осталось там в тот вечер.", "Она открыла тяжёлый сундук потому что дорога была закрыта."]


def test_sentences():
    got = [s for _, s in L.sentences("Chapter IV\n\nTitle: X\n*** START OF THE PROJECT ***\n\nONE: He went out. She\nstayed in the house. “Short quote…” — Then it rained all day.\n\nI. The old mill  3\n")]
    assert got == ["He went out.", "She stayed in the house.", "Then it rained all day.", "The old mill"]
    assert L.sentences("") == [] and not L.full("One two.") and L.full(EN[0])


def test_windows_cover_everything():
    w, who = L.windows(["a" * 250, "", "Äö 12345"])
    assert list(who) == [0, 0, 0, 1, 2] and bytes(w[4]).rstrip(b"\0").decode() == "äö 0" and not w[3].any()


def test_documents(spark, make):
    train = [{"doc_id": 1000 + i, "text": " ".join(x[(i + k) % len(x)] for k in range(3)), "lang": c} for i in range(60) for c, x in (("en", EN), ("German", DE), ("ru-RU", RU))]
    d = make(
        documents=[
            {"doc_id": 1, "text": " ".join(EN), "lang": None}, {"doc_id": 2, "text": " ".join(DE), "lang": "en"}, {"doc_id": 3, "text": " ".join(EN) + " " + DE[1] + " " + DE[2], "lang": "en_GB"}, {"doc_id": 4, "text": " ".join(RU), "lang": "rus"}, {"doc_id": 5, "text": " ", "lang": "und"},
            {"doc_id": 6, "text": None, "lang": None}, {"doc_id": 7, "text": " ".join(EN) + " “Aber die Antwort…” — " + EN[0], "lang": "English"}, {"doc_id": 8, "text": " ".join(RU * 2000), "lang": "xx"}, *train,
        ]
    )
    assert rows(L.p10_found(spark, d), "doc_id", "lang") == [(1, "en"), (2, "de"), (3, "de"), (3, "en"), (8, "ru")]
    segs = [r for r in L.p10_segments(spark, d).orderBy("seg_no").collect() if r["doc_id"] == 3]
    assert [r["lang"] for r in segs] == ["en", "de"] and all(0.5 < r["confidence"] <= 1 for r in segs)
    assert L.p10_found(spark, make(documents=[{"doc_id": 1, "text": "x", "lang": None}])).count() == 0
    assert L.p10_found(spark, make(documents=[])).count() == 0


def test_rare_languages_are_learned_from_whole_texts(spark, make, monkeypatch):
    monkeypatch.setattr(L, "SAMPLE_DOCS", 200)
    train = [{"doc_id": 1000 + i, "text": " ".join(EN[(i + k) % 4] for k in range(3)), "lang": "en"} for i in range(4000)]
    rare = [{"doc_id": 100 + i, "text": "Chapter IV\n" * 700 + " ".join(RU), "lang": "ru"} for i in range(12)]
    d = make(documents=[{"doc_id": 1, "text": " ".join(RU), "lang": "ru"}, {"doc_id": 2, "text": " ".join(RU), "lang": None}, {"doc_id": 3, "text": " ".join(EN), "lang": "en"}, *train, *rare])
    assert rows(L.p10_found(spark, d), "doc_id", "lang") == [(2, "ru")]
    net = L.fit([(" ".join(EN * 3), "en")] * 1700 + [(" ".join(RU * 4), "ru")] * 3)
    assert net.classes == ["en", "ru"] and L.judge(net, [RU[0], EN[0]])[0][0][2] == "ru"


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_held_out_documents(spark):
    """A network fitted on half of the labelled documents names the label of the other half, wrong labels (about one in twelve) aside."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("trim(text) <> ''").select("doc_id", "text", L.code_of(F.col("lang")).alias("code")).where("code is not null").collect()
    net = L.fit([(r["text"], r["code"]) for r in docs if r["doc_id"] % 2])
    rest = [r for r in docs if not r["doc_id"] % 2]
    named = [[c for c, _, _ in L.languages(m)] for m in L.judge(net, [r["text"] for r in rest])]
    assert len(rest) > 300 and sum(r["code"] in n for r, n in zip(rest, named)) >= 0.88 * len(rest)
