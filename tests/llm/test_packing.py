import os
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import packing as K


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120))
def test_plan_uses_every_item(sizes):
    p = K.plan(dict(Counter(sizes)), 50)
    used = Counter()
    for combo, times in p:
        assert sum(combo) <= 50
        used.update({x: k * times for x, k in Counter(combo).items()})
    assert used == Counter(sizes)
    rows, bins = K.ranges(p)
    assert bins == sum(t for _, t in p) and sum(hi - lo + 1 for _, lo, hi, _, _ in rows) == len(sizes)
    if sizes:
        assert bins <= 1.3 * sum(sizes) / 50 + sum(x > 25 for x in sizes) + 1


def test_exact_complements():
    assert sum(t for _, t in K.plan({30: 4, 20: 4, 25: 2, 10: 3, 40: 3}, 50)) == 8


def test_triples_below_many_longer_lengths():
    p = K.plan({1600: 1, **dict.fromkeys(range(1001, 1400), 1), 519: 1, 480: 1, 401: 1}, 3000)
    assert ((1600, 519, 480, 401), 1) in [(tuple(sorted(c, reverse=True)), t) for c, t in p]


@pytest.mark.skipif(not os.path.isdir(K.TOKENIZERS), reason="no vocabulary files")
def test_texts(spark, make):
    long = "word " * 3000
    d = make(documents=[{"doc_id": 1, "text": "one two three"}, {"doc_id": 2, "text": long}, {"doc_id": 3, "text": ""}, {"doc_id": 4, "text": None}, {"doc_id": 5, "text": "a b"}, {"doc_id": 5, "text": "a b"}], containers=[{"container_id": 1, "tokenizer": "gpt2", "capacity_tokens": 64}, {"container_id": 2, "tokenizer": "other", "capacity_tokens": 9}, {"container_id": 3, "tokenizer": "gpt2", "capacity_tokens": None}])
    got = K.p8_pack(spark, d).collect()
    n = len(K.counter(("gpt2",), K.TOKENIZERS).encode[0](long))
    assert {r["container_id"] for r in got} == {1} and sum(r["size"] for r in got if r["doc_id"] == 2) == n
    bins = Counter()
    for r in got:
        bins[r["bin"]] += r["size"]
    assert max(bins.values()) <= 64 and len([r for r in got if r["doc_id"] == 5]) == 2 and not [r for r in got if r["doc_id"] == 4]
    assert K.p8_pack(spark, make(documents=[], containers=[])).count() == 0


@pytest.mark.skipif(not os.path.isdir(K.TOKENIZERS), reason="no vocabulary files")
def test_counts_match_the_tokenizer():
    c = K.counter(("cl100k_base", "gpt2"), K.TOKENIZERS)
    for t in ("", "Hello world's  end\n\n x", "Привет ёж 123", "a" * 500, "<|endoftext|>"):
        assert c.counts(t) == [len(e(t)) for e in c.encode]


def test_ranges_are_met_by_chunks(spark, monkeypatch):
    import random

    monkeypatch.setattr(K, "CHUNK", 3)
    r = random.Random(1)
    patterns, sizes = [], Counter()
    for _ in range(60):
        combo, times = tuple(r.choice((3, 5, 9)) for _ in range(r.randrange(1, 5))), r.choice((1, 2, 40))
        patterns.append((combo, times))
        sizes.update({x: k * times for x, k in Counter(combo).items()})
    rows, bins = K.ranges(patterns)
    pieces = spark.createDataFrame([(1, 100 * x + i, 1, x, i) for x, n in sizes.items() for i in range(n)], "container_id int, doc_id bigint, piece_no int, size bigint, rank bigint")
    got = K.placed(pieces, [(1, *x) for x in rows]).collect()
    assert len(got) == sum(sizes.values())
    held: dict = {}
    for x in got:
        held.setdefault(x["bin"], []).append(x["size"])
    assert sorted(tuple(sorted(v)) for v in held.values()) == sorted(tuple(sorted(c)) for c, t in patterns for _ in range(t)) and len(held) == bins
