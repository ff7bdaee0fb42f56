import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from gleaner.functions.text import STOP_WORDS
from gleaner.operators import dense, fusion, sparse

CORPUS = [("c1", "Rollback restores the previous release when a deploy fails."), ("c2", "Token refresh: tokens expire hourly; refresh tokens rotate."), ("c3", "Crash loops: the service crashes when memory runs out."), ("c4", ""), ("c5", None), ("c1", "Rollback restores the previous release when a deploy fails.")]


def toks(t):
    return [w for w in re.findall("[a-z0-9]+", (t or "").lower()) if len(w) > 1 and w not in STOP_WORDS]


def model_bm25(query, corpus, k1=1.5, b=0.75):
    docs = {i: toks(t) for i, t in corpus if toks(t)}
    avg = sum(map(len, docs.values())) / len(docs)
    out = {}
    for term in toks(query):
        df = sum(term in d for d in docs.values())
        for i, d in docs.items():
            tf = d.count(term)
            if tf:
                out[i] = out.get(i, 0) + math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(d) / avg))
    return out


@pytest.fixture(scope="module")
def index(spark):
    return sparse.tokenized(spark.createDataFrame(CORPUS, "chunk_id string, text string"))


def test_bm25(spark, index, tmp_path):
    queries = [(1, "refresh tokens tokens"), (2, "service crash when rollback"), (3, "the of"), (4, "unknown"), (5, None)]
    q = spark.createDataFrame(queries, "qid long, query string")
    stored = sparse.Postings.build(index, str(tmp_path / "p"))
    for rows in (sparse.BM25().search(q, index, 10).collect(), stored.search(q, 10).collect()):
        got = {(r.qid, r.id): r.score for r in rows}
        want = {(i, c): s for i, t in queries for c, s in model_bm25(t, CORPUS).items()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)
    assert [r.id for r in sparse.BM25().search(q, index, 1).where("qid = 2").collect()] == ["c3"]
    kept = sparse.BM25().search(q, index, 10, index.where("id = 'c1'").select("id"))
    assert {(r.qid, r.id) for r in kept.collect()} == {(2, "c1")}
    assert sparse.BM25().search(q, index, 0).count() == 0


def test_dense_both_ways(spark):
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(60, 8)), rng.normal(size=(7, 8))
    x[5] = x[6]
    v = spark.createDataFrame([(f"v{i:02}", r.tolist()) for i, r in enumerate(x)] + [("bad", [1.0]), ("null", None)], "id string, vec array<double>")
    qs = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(q)], "qid long, vec array<double>")
    want = {(i, f"v{j:02}", rank + 1) for i in range(7) for rank, j in enumerate(sorted(range(60), key=lambda j: (-round(float(q[i] @ x[j]), 9), j))[:5])}
    for sent in (10**6, 0):
        assert {(r.qid, r.id, r.rank) for r in dense.search(qs, v, 5, 8, sent).collect()} == want
    assert dense.search(qs.limit(0), v, 5, 8).count() == 0 and dense.search(qs, v.limit(0), 5, 8).count() == 0 and dense.search(qs, v, 0, 8).count() == 0


def ranked(spark, rows):
    return spark.createDataFrame([(1, i, s, r) for r, (i, s) in enumerate(rows, 1)], "qid long, id string, score double, rank long")


def test_fusion(spark):
    d, s = ranked(spark, [("a", 0.9), ("b", 0.5), ("c", 0.1)]), ranked(spark, [("b", 7.0), ("d", 3.0)])
    rrf = {r.id: r.score for r in fusion.reciprocal_rank_fusion([d, s]).collect()}
    assert rrf == {"a": round(1 / 61, 12), "b": round(1 / 62 + 1 / 61, 12), "c": round(1 / 63, 12), "d": round(1 / 62, 12)}
    m = {r.id: r for r in fusion.merge_legs(d, s).collect()}
    assert m["b"].retrieved_by == ["dense", "sparse"] and m["d"].retrieved_by == ["sparse"] and m["a"].retrieved_by == ["dense"]
    assert [i for i in sorted(m, key=lambda i: m[i].ord)] == ["a", "b", "c", "d"]
    assert m["b"].fused == round(0.6 / 62 + 0.4 / 61, 12)


def test_rerank_score(spark):
    rows = [(["roll", "back", "roll"], ["back", "roll", "x", "y"], 0.01), ([], ["a"], 0.3), (["a"], [], 0.3), (["a", "b"], ["c"], 0.2)]
    got = [r[0] for r in spark.createDataFrame(rows, "q array<string>, d array<string>, base double").select(fusion.rerank_score("q", "d", "base")).collect()]
    # the last occurrence of roll is at 2, of back at 1: a span of 2
    assert got == [round(0.55 + 0.15 * 1.0 + 0.20 * 1.0 + 0.001, 9), 0.3, 0.15, round(0.02, 9)]


def test_floor(spark):
    h = spark.createDataFrame([(1, "a", 1.0), (1, "b", 0.35), (1, "c", 0.34), (2, "d", -1.0), (2, "e", -2.0)], "qid long, id string, score double")
    assert {r.id for r in fusion.score_floor(h).collect()} == {"a", "b", "d", "e"}


def model_mmr(hits, lam):
    left, chosen = list(range(len(hits))), []
    sim = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    while left:
        best = max(left, key=lambda i: (round(lam * hits[i][1] - (1 - lam) * max([sim(hits[i][2], hits[j][2]) for j in chosen], default=0.0), 9), -i))
        chosen.append(best)
        left.remove(best)
    return [hits[i][0] for i in chosen]


def test_mmr(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for q in range(30):
        hits = [(f"h{i}", round(rng.random(), 2), {f"t{rng.randrange(8)}" for _ in range(rng.randrange(6))}) for i in range(rng.randint(1, 9))]
        hits.sort(key=lambda h: -h[1])
        rows += [(q, i, p, sorted(t), s) for p, (i, s, t) in enumerate(hits, 1)]
        want[q] = model_mmr(hits, 0.7)
    df = spark.createDataFrame(rows, "qid long, id string, position long, tokens array<string>, score double")
    got = fusion.mmr(df, keep=("score",)).collect()
    assert {q: [r.id for r in sorted((r for r in got if r.qid == q), key=lambda r: r.mmr_rank)] for q in want} == want
    assert {(r.qid, r.id, r.score) for r in got} == {(q, i, s) for q, i, _, _, s in rows}
    assert Counter(r.qid for r in fusion.mmr(df, k=2).collect()).most_common(1)[0][1] == 2
