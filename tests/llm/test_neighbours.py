import numpy as np

from gleaner.llm import neighbours

SCHEMA = "model string, key string, dim int, vec array<float>"


def brute(rows, k=5):
    groups = {}
    for m, key, dim, v in rows:
        if key is None or v is None or len(v) != dim or any(x is None for x in v):
            continue
        a = np.array(v, dtype=np.float32).astype(np.float64)
        if np.isfinite(a).all() and a.any():
            groups.setdefault((m, dim), {})[key] = a / np.linalg.norm(a)
    out = set()
    for (m, dim), g in groups.items():
        keys = sorted(g)
        x = np.array([g[i] for i in keys])
        s = np.round(x @ x.T, 6)
        np.fill_diagonal(s, -9)
        for i, key in enumerate(keys):
            out |= {(m, dim, key, keys[j]) for j in np.argsort(-s[i], kind="stable")[:k] if j != i}
    return out


def vectors(n, dim, seed, model="m"):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 8, dim))
    return [(model, f"{model}{i:05}", dim, (centres[i % len(centres)] + 0.2 * rng.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]


def test_recall_against_brute_force(spark, cluttered, monkeypatch):
    monkeypatch.setattr(neighbours, "REGION", 150)
    monkeypatch.setattr(neighbours, "SAMPLE", 600)
    monkeypatch.setattr(neighbours, "BLOCK_VECTORS", 40)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 64)
    rows = vectors(1200, 16, 1) + vectors(64, 32, 2, "w") + vectors(300, 16, 3, None)
    rows = [(m, k.replace("None", "z"), d, v) for m, k, d, v in rows]
    found = neighbours.neighbours(cluttered(spark.createDataFrame(rows, SCHEMA)))
    got = {(r.model, r.dim, r.key, r.neighbour) for r in found.collect()}
    want = brute(rows)
    assert len(got & want) / len(want) > 0.97
    assert len(got) == len(want)
    every = {(r.model, r.dim, r.key, r.neighbour) for r in neighbours.neighbours(spark.createDataFrame(rows, SCHEMA), exact=True).collect()}
    assert every == want


def test_a_class_that_holds_most_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "REGION", 40)
    monkeypatch.setattr(neighbours, "SAMPLE", 100)
    rows = vectors(200, 16, 4) + [("m", f"same{i:04}", 16, [1.0] * 16) for i in range(400)]
    got = {(r.model, r.dim, r.key, r.neighbour) for r in neighbours.neighbours(spark.createDataFrame(rows, SCHEMA), exact=True).collect()}
    assert got == brute(rows)


def test_dirt_and_ties(spark):
    v = [1.0, 0.0, 0.0, 0.0]
    rows = [("m", f"same{i}", 4, v) for i in range(9)] + [("m", "same0", 4, v), ("m", "near", 4, [0.9, 0.1, 0.0, 0.0]), ("m", "twice", 4, [2.0, 0.0, 0.0, 0.0])]
    rows += [("m", "null", 4, None), ("m", "short", 4, [1.0]), ("m", "nan", 4, [float("nan"), 1.0, 1.0, 1.0]), ("m", "inf", 4, [float("inf"), 1.0, 1.0, 1.0]), ("m", "zero", 4, [0.0] * 4), ("m", "hole", 4, [None, 1.0, 1.0, 1.0]), (None, "lone", 4, v), ("m", None, 4, v), ("m", "nodim", None, v)]
    found = neighbours.neighbours(spark.createDataFrame(rows, SCHEMA)).collect()
    keys = {r.key for r in found}
    assert keys == {f"same{i}" for i in range(9)} | {"near", "twice"}
    of = lambda k: [r.neighbour for r in sorted((r for r in found if r.key == k), key=lambda r: r.rank)]
    assert of("same0") == ["same1", "same2", "same3", "same4", "same5"]
    assert of("near") == ["same0", "same1", "same2", "same3", "same4"]
    assert all(len(of(k)) == 5 for k in keys)


def test_empty(spark):
    assert neighbours.neighbours(spark.createDataFrame([], SCHEMA)).count() == 0


def test_encoding_is_a_sum_of_codewords():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 12)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    books = neighbours.train(x, 8)
    codes, length = neighbours.encode(x, books)
    total = sum(b[codes[:, i]] for i, b in enumerate(books))
    assert np.allclose(np.linalg.norm(total, axis=1), length, atol=1e-5)
    greedy, _ = neighbours.encode(x, books, beam=1)
    total1 = sum(b[greedy[:, i]] for i, b in enumerate(books))
    assert ((x - total) ** 2).sum() <= ((x - total1) ** 2).sum() < (x**2).sum()
