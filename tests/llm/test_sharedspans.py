import random

import pytest

from gleaner.llm import sharedspans


def brute(docs, n):
    grams = {}
    for i, t in docs:
        for j in range(len(t or "") - n + 1):
            grams.setdefault(t[j : j + n], set()).add(i)
    pairs = {(a, b) for s in grams.values() if len(s) > 1 for a in s for b in s if a < b}
    shared = {}
    for i, t in docs:
        covered = set()
        for j in range(len(t or "") - n + 1):
            if len(grams[t[j : j + n]]) > 1:
                covered |= set(range(j, j + n))
        if covered:
            shared[i] = len(covered)
    return pairs, shared


def data(seed, hot=0):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdefg hij\n") for _ in range(n))
    docs = [(i, text(rng.randint(0, 300))) for i in range(40)]
    for i in range(60):
        source = rng.choice(docs)[1]
        n = rng.randint(30, 60)
        at = rng.randrange(max(1, len(source) - n))
        docs.append((100 + i, text(rng.randint(0, 50)) + source[at : at + n] + text(rng.randint(0, 50))))
    docs += [(500, docs[3][1]), (501, docs[3][1]), (502, ""), (503, "x" * 400), (504, "y" + "x" * 300 + "z"), (505, "ab" * 200), (506, "ba" * 100)]
    head = text(60)
    docs += [(1000 + i, head + text(20)) for i in range(hot)]
    return docs


@pytest.mark.parametrize("hot", [0, 30])
def test_pairs_and_shares(spark, cluttered, monkeypatch, hot):
    if hot:  # many blocks for one phrase and for one shard
        monkeypatch.setattr(sharedspans, "BLOCK_OCCURRENCES", 8)
        monkeypatch.setattr(sharedspans, "BLOCK_CHARS", 3000)
        monkeypatch.setattr(sharedspans, "SHARD_PHRASES", 20)
    docs = data(1, hot)
    df = cluttered(spark.createDataFrame(docs + [(600, None), (3, docs[3][1])], "doc_id long, text string"))
    s = sharedspans.SharedSpans(df, 40, 20)
    pairs, shared = brute(docs, 40)
    assert {tuple(r) for r in s.pairs().collect()} == pairs
    rows = {r.doc_id: r for r in s.shares().collect()}
    assert {i: r.shared_chars for i, r in rows.items()} == shared
    assert rows[500].n_copies == 3 and rows[500].share == 1.0


def test_many_copies_keep_every_pair(spark):
    text = "".join(random.Random(5).choice("abcdefg hij") for _ in range(60))
    docs = [(i, text) for i in range(1, 1003)] + [(5000, "other words " + text[5:55])]
    s = sharedspans.SharedSpans(spark.createDataFrame(docs, "doc_id long, text string"), 40, 20)
    got = [tuple(r) for r in s.pairs().collect()]
    ids = {i for i, _ in docs}
    assert len(got) == len(set(got)) == len(docs) * (len(docs) - 1) // 2
    assert all(a < b and a in ids and b in ids for a, b in got)
    rows = {r.doc_id: r for r in s.shares().collect()}
    assert rows.keys() == ids and {r.class_id for i, r in rows.items() if i != 5000} == {1} and rows[5000].class_id == 5000


def test_empty(spark):
    s = sharedspans.SharedSpans(spark.createDataFrame([], "doc_id long, text string"))
    assert s.pairs().count() == 0 and s.shares().count() == 0
