import random
import re

import pytest

from gleaner.llm import leakage


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute(docs, cases, n=10):
    out = set()
    for case, query, passage in cases:
        grams = {tuple(w[i : i + n]) for w in (words(query), words(passage)) for i in range(len(w) - n + 1)}
        for doc, text in docs:
            w = words(text)
            if any(tuple(w[i : i + n]) in grams for i in range(len(w) - n + 1)):
                out.add((case, doc))
    return out


def data(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Straße", "ÉTÉ", "naïve_x", "日本"]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", ".", "\n"]) for _ in range(n))
    cases = [(i, text(rng.randint(3, 15)), text(rng.randint(8, 60))) for i in range(20)] + [(90, None, None), (91, "", "same same same same same same same same same same same same")]
    docs = [(i, text(rng.randint(0, 200))) for i in range(60)] + [(900, None), (901, ""), (902, "same " * 5000)]
    for i in range(40):
        case = cases[rng.randrange(20)]
        w = re.split(r"\s+", rng.choice(case[1:]))
        n = rng.randint(6, 14)
        at = rng.randrange(max(1, len(w) - n))
        docs.append((1000 + i, text(20) + " " + " ".join(w[at : at + n]).upper() + " " + text(20)))
    return docs, cases


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_every_leak_is_found(spark, cluttered, sent):
    docs, cases = data(4)
    d = cluttered(spark.createDataFrame(docs + docs[:3], "doc_id long, text string"))
    c = cluttered(spark.createDataFrame(cases, "case_id long, query string, passage string"))
    spans = leakage.leaked_spans(d, c, broadcast_chars=sent)
    assert {tuple(r) for r in leakage.leaked_pairs(spans).collect()} == brute(docs, cases)
    by = dict(docs)
    texts = {(c, f): t for c, q, p in cases for f, t in (("query", q), ("passage", p))}
    for r in spans.collect():
        assert words(by[r.doc_id])[r.doc_word : r.doc_word + r.n_words] == words(texts[r.case_id, r.field])[r.case_word : r.case_word + r.n_words]
        assert r.n_words >= 10


def test_documents_and_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "doc_id long, text string")
    c = spark.createDataFrame([(7, "x", "b c d e f g h i j k l m"), (8, "a b c d e f g h i j", None)], "case_id long, query string, passage string")
    rows = leakage.leaked_documents(leakage.leaked_spans(d, c)).collect()
    assert [tuple(r) for r in rows] == [(1, [7, 8], 11, 2)]
    assert leakage.leaked_spans(d, c.limit(0)).count() == 0 and leakage.leaked_spans(d.limit(0), c).count() == 0
