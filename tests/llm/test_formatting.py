from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import rows
from quire.llm import formatting as R


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=20), max_size=60))
def test_trie_counts(keys):
    t = R.Trie()
    for i, k in enumerate(keys):
        t.add(k, i, 1)
    assert sorted(t.terminals()) == sorted((k, keys.index(k), keys.count(k)) for k in set(keys))


def books():
    return [
        {"book_id": 5, "title": "The Tide – II", "authors": ["Ann Lee", "Bo Roe"], "isbn": "97-8 1"},
        {"book_id": 2, "title": "the tide ii", "authors": ["Roe, Bo", " ann lee."], "isbn": "9781"},
        {"book_id": 9, "title": "THE TIDE: II", "authors": ["BO ROE", "Lee, Ann", None, " "], "isbn": "(9781)"},
        {"book_id": 3, "title": "The Tidé II", "authors": ["Ann Lee", "Bo Roe"], "isbn": "9781"},
        {"book_id": 4, "title": "The Tide II", "authors": ["Ann Lee"], "isbn": "9781"},
        {"book_id": 6, "title": "The Tide II", "authors": None, "isbn": None},
        {"book_id": 7, "title": "The Tide II", "authors": [], "isbn": " "},
        {"book_id": 8, "title": " ", "authors": [], "isbn": " "},
        {"book_id": 10, "title": None, "authors": [], "isbn": " "},
        {"book_id": 11, "title": "STRASSE", "authors": [], "isbn": "x"},
        {"book_id": 12, "title": "Straße", "authors": [], "isbn": "X"},
        {"book_id": None, "title": "Straße", "authors": [], "isbn": "X"},
    ]


def test_groups(spark, make):
    d = make(books=books())
    assert rows(R.p7_found(spark, d), "book_id_a", "book_id_b") == [(2, 5), (2, 9), (6, 7), (11, 12)]
    assert sum(r["n_copies"] for r in R.p7_groups(spark, d).collect()) == 9
    assert R.p7_found(spark, make(books=[])).count() == 0


def test_small_buckets_and_hot_keys(spark):
    from pyspark.sql import functions as F

    df = spark.range(3000).select(F.col("id").alias("book_id"), F.encode(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("common prefix "), (F.col("id") % 700).cast("string"))), "UTF-8").alias("key"))
    got = {bytes(r["key"]): (r["low"], r["n"]) for r in R.groups(df, capacity=40).collect()}
    want = {bytes(r["key"]): (r["m"], r["n"]) for r in df.groupBy("key").agg(F.min("book_id").alias("m"), F.count("*").alias("n")).collect()}
    assert got == want and len(R.splits(df.select("key", F.col("book_id").alias("low"), F.lit(1).alias("n")).distinct(), 40)) > 10


def test_long_common_beginnings_cost_no_rounds(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(R, "HELD", 50)
    lead = "x" * 400
    df = spark.range(4000).select(F.col("id").alias("book_id"), F.encode(F.concat(F.lit(lead), (F.col("id") % 1300).cast("string")), "UTF-8").alias("key")).repartition(3)
    keys = df.select("key", F.col("book_id").alias("low"), F.lit(1).alias("n"))
    rounds = []
    old = R._extensions
    monkeypatch.setattr(R, "_extensions", lambda o: rounds.append(len(o)) or old(o))
    bounds = R.splits(keys, 100)
    assert len(rounds) <= 4 and bounds == sorted(set(bounds)) and len(bounds) > 30
    got = {bytes(r["key"]): (r["low"], r["n"]) for r in R.groups(df, capacity=100).collect()}
    assert len(got) == 1300 and got[(lead + "7").encode()] == (7, 4) and sum(n for _, n in got.values()) == 4000
