import random
from collections import Counter, defaultdict

import pytest

from gleaner.llm import packing


def loads(sizes, capacity):
    places, bins = packing.plan(dict(Counter(sizes)), capacity)
    load, seen = Counter(), defaultdict(set)
    for s, a, b, first in places:
        for i in range(a, b):
            assert i not in seen[s]
            seen[s].add(i)
            load[first + i - a] += s
    assert {s: len(v) for s, v in seen.items()} == dict(Counter(sizes)) and set(load) == set(range(bins))
    assert all(x <= capacity for x in load.values())
    return load


def test_plan_places_every_piece():
    rng = random.Random(1)
    for _ in range(150):
        capacity = rng.choice([3, 10, 50, 256, 1000])
        sizes = [min(capacity, max(1, int(rng.paretovariate(0.8) * rng.randint(1, 40)))) for _ in range(rng.randint(1, 2000))]
        n = len(loads(sizes, capacity))
        least = max(-(-sum(sizes) // capacity), sum(2 * s > capacity for s in sizes))
        assert n <= 1.23 * least + 1


def test_large_pieces_are_matched():
    assert len(loads([60, 40, 55, 45, 50, 50, 34, 66], 100)) == 4
    assert packing.plan({}, 10) == ([], 0)


def test_table(spark, cluttered):
    pytest.importorskip("tiktoken")
    texts = ["hello world " * n for n in (1, 5, 20, 50, 120, 400)] * 5 + ["", None, "   "]
    docs = cluttered(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    windows = cluttered(spark.createDataFrame([(1, "m", 64, 0), (2, "m", 300, 44), (3, "m", 10, 10), (4, "m", None, 0), (5, "m", 100, None)], "window_id int, model string, capacity_tokens int, reserved_tokens int"))
    rows = packing.pack(docs, windows).collect()
    counts = {r.doc_id: r.n_tokens for r in packing.count_tokens(docs).collect()}
    for window, capacity in ((1, 64), (2, 256), (5, 100)):
        mine = [r for r in rows if r.window_id == window]
        load, whole = Counter(), defaultdict(list)
        for r in mine:
            load[r.container_id] += r.n_tokens
            whole[r.doc_id].append(r)
        assert all(v <= capacity for c, v in load.items() if c is not None)
        assert set(whole) == set(range(len(texts)))
        for doc, pieces in whole.items():
            pieces.sort(key=lambda r: r.piece)
            assert sum(p.n_tokens for p in pieces) == counts[doc]
            assert [p.token_start for p in pieces] == [i * capacity for i in range(len(pieces))]
            assert len(pieces) == max(1, -(-counts[doc] // capacity))  # only what exceeds the capacity is cut
            assert (pieces[0].container_id is None) == (counts[doc] == 0)
    assert {r.window_id for r in rows} == {1, 2, 5}
    assert packing.fill(packing.pack(docs.limit(0), windows)).count() == 0


def test_no_windows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "window_id int, model string, capacity_tokens int, reserved_tokens int")
    assert packing.pack(docs, none).count() == 0
