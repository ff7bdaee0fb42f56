import random
import re
from itertools import combinations, product

from gleaner.llm import bits, components, nearcopies

WORDS = [f"word{i}" for i in range(400)]


def shingles(t):
    w = re.findall(r"[^\W_]+", t.lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def brute(rows):
    out = set()
    for (a, s), (b, t) in combinations(sorted(set(rows)), 2):
        if a == b:
            continue
        x, y = shingles(s), shingles(t)
        if s == t or (x or y) and len(x & y) / len(x | y) >= 0.6:
            out.add((a, b))
    return out


def corpus(seed=1):
    rng = random.Random(seed)
    rows = []
    for g in range(25):
        base = [rng.choice(WORDS) for _ in range(rng.randint(20, 120))]
        for v in range(rng.randint(1, 5)):
            w = list(base)
            for _ in range(rng.choice([0, 1, 3, 8])):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            rows.append((f"{g:02}-{v}", " ".join(w)))
    rows += [("short1", "two words"), ("short2", "two words"), ("short3", "Two, words"), ("empty1", ""), ("empty2", ""), ("blank", "  \n"), ("long", " ".join(rng.choice(WORDS) for _ in range(30000)))]
    rows += [("00-0", rows[0][1])]  # written twice
    return rows


def test_all_pairs(spark, cluttered):
    rows = corpus()
    df = cluttered(spark.createDataFrame(rows + [("null", None), (None, "a b c d")], "chunk_id string, text string"))
    got = {tuple(r) for r in nearcopies.NearCopies(df, "chunk_id", "text").pairs("a", "b").collect()}
    want = brute(rows)
    assert len(got - want) == 0
    assert len(want - got) <= 0.01 * len(want)


def test_exact(spark):
    rows = corpus(7)
    n = nearcopies.NearCopies(spark.createDataFrame(rows, "chunk_id string, text string"), "chunk_id", "text", exact=True)
    assert {tuple(r) for r in n.pairs("a", "b").collect()} == brute(rows)


def test_hot_keys_lose_nothing(spark, monkeypatch):
    rows = [(f"{i:03}", " ".join(WORDS[:60] + [f"tail{i}"])) for i in range(40)] + corpus(2)
    monkeypatch.setattr(nearcopies, "BLOCK", 3)
    monkeypatch.setattr(nearcopies, "ONE_IN", 1)  # every class is looked at, so keys with six classes are cut into blocks beforehand
    got = {tuple(r) for r in nearcopies.NearCopies(spark.createDataFrame(rows, "chunk_id string, text string"), "chunk_id", "text").pairs("a", "b").collect()}
    want = brute(rows)
    assert got <= want and len(want - got) <= 0.01 * len(want)


def test_keys_that_turn_out_hot():
    import numpy as np
    import pyarrow as pa

    n = nearcopies.BLOCK + 30
    key, cid = np.repeat([3, 5, 9], [4, n, 2]), np.arange(n + 6)
    cuts = [0, 2, 60, 61, len(key)]
    batches = [pa.RecordBatch.from_arrays([pa.array(key[i:j]), pa.array(cid[i:j])], names=["key", "cid"]) for i, j in zip(cuts, cuts[1:])]
    rows = [r for b in nearcopies._meet(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns))]
    assert {(a, b) for a, b, hot in rows if hot} == {(5, c) for c in range(4, n + 4)}
    assert {(a, b) for a, b, hot in rows if not hot} == {(a, b) for a in range(4) for b in range(a + 1, 4)} | {(n + 4, n + 5)}


def test_groups_and_stars(spark):
    rows = [("a", "one two three four five"), ("b", "one two three four five"), ("c", "other words are written here"), ("d", None)]
    n = nearcopies.NearCopies(spark.createDataFrame(rows, "chunk_id string, text string"), "chunk_id", "text")
    assert {tuple(r) for r in n.groups("chunk_id").collect()} == {("a", "a", "a", 2, 0), ("b", "a", "a", 2, 0), ("c", "c", "c", 1, 0)}
    from gleaner.llm import copies

    many = spark.createDataFrame([(f"m{i:02}", "m00", 30) for i in range(30)], "member string, rep string, copies long")
    pairs = copies.all_pairs(spark.createDataFrame([("k", "m00")], "a string, b string"), many, "a", "b", expand=10)
    assert {tuple(r) for r in pairs.collect()} == {("k", "m00")} | {("m00", f"m{i:02}") for i in range(1, 30)}


def test_large_class_keeps_every_pair(spark):
    words = WORDS[:30]
    texts = [" ".join(words), ", ".join(words).upper()]  # different texts, one set of shingles
    rows = [(f"m{i:04}", texts[i % 2]) for i in range(1100)] + [("k", " ".join([*words[:-1], "changed"]))]
    pairs = nearcopies.NearCopies(spark.createDataFrame(rows, "chunk_id string, text string"), "chunk_id", "text").pairs("a", "b")
    ids = {i for i, _ in rows}
    got = [tuple(r) for r in pairs.collect()]
    assert len(got) == len(set(got)) == len(rows) * (len(rows) - 1) // 2
    assert all(a < b and a in ids and b in ids for a, b in got)


def test_pairs_of_classes_in_blocks(spark, monkeypatch):
    from gleaner.llm import copies

    monkeypatch.setattr(copies, "BLOCK", 4)
    sizes = {"m": 30, "p": 11, "q": 3}
    members = spark.createDataFrame([(f"{c}{i:02}", f"{c}00", n) for c, n in sizes.items() for i in range(n)], "member string, rep string, copies long")
    links = [("m00", "p00"), ("k", "m00"), ("k", "l")]
    got = [tuple(r) for r in copies.all_pairs(spark.createDataFrame(links, "a string, b string"), members, "a", "b").collect()]
    of = {f"{c}00": [f"{c}{i:02}" for i in range(n)] for c, n in sizes.items()} | {"k": ["k"], "l": ["l"]}
    want = {tuple(sorted(p)) for x, y in links for p in product(of[x], of[y])} | {p for c in of.values() for p in combinations(c, 2)}
    assert len(got) == len(want) and set(got) == want


def test_empty_table(spark):
    n = nearcopies.NearCopies(spark.createDataFrame([], "chunk_id string, text string"), "chunk_id", "text")
    assert n.pairs("a", "b").count() == 0 and n.groups("chunk_id").count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(60)] + [("x", "y")], "a string, b string")
    labels = {r["node"]: r["label"] for r in components.components(links, "a", "b").collect()}
    assert set(labels.values()) == {"000", "x"} and len(labels) == 63


def test_bit_table(spark):
    f = bits.Filter(spark.createDataFrame([(i * 7919 - 5000,) for i in range(500)], "n long"), "n", 500)
    import numpy as np

    assert f.holds(np.array([i * 7919 - 5000 for i in range(500)])).all()
    assert f.holds(np.arange(10**9, 10**9 + 1000)).mean() < 0.05
