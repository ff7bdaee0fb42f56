"""Evaluation passages inside training documents (problem 7), by winnowing.

The words of both sides are hashed into k-grams; of every window of ``min_words - k + 1`` consecutive k-grams the least
hash is kept, so any run of ``min_words`` shared words leaves both sides with a common fingerprint. The fingerprints of
both sides are joined and each hit is extended, word for word, to the longest shared run.

The evaluation side is sent to the executors only after its size has been measured (``broadcast_chars``); beyond that
bound the fingerprints of both sides meet in a shuffled join, with the same result.

Null or wordless texts have no fingerprints and thus no rows. Repeated document rows give the same rows again, which
``leaked_pairs`` makes distinct. Extra columns of either table are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm import textnum as tn

K = 5
MIN_WORDS = 10
#: Characters of evaluation texts that every task indexes for itself (some tens of bytes each); more meet in a shuffled join.
BROADCAST_CHARS = 8 << 20

SPANS = "case_id long, field string, doc_id long, case_word int, doc_word int, n_words int"
_SPANS = pa.schema([("case_id", pa.int64()), ("field", pa.string()), ("doc_id", pa.int64()), ("case_word", pa.int32()), ("doc_word", pa.int32()), ("n_words", pa.int32())])


class Passages:
    """The evaluation texts with their words and sorted fingerprints."""

    def __init__(self, rows: list[tuple[int, str, str]], k: int, min_words: int):
        self.rows = [(c, f) for c, f, _ in rows]
        self.k, self.min_words = k, min_words
        self.words = tn.Words([t for _, _, t in rows])
        g = self.words.grams(k)
        at = tn.winnow(g, min_words - k + 1)
        order = np.argsort(g[at], kind="stable")
        self.at, self.grams = at[order], g[at][order]


def extend(doc: tn.Words, case: tn.Words, d: np.ndarray, c: np.ndarray, min_words: int) -> set[tuple[int, int, int]]:
    """Longest runs (document word, case word, length) of at least ``min_words`` equal words through the hits d, c."""
    def same(i: int) -> np.ndarray:
        x, y = d + i, c + i
        ok = (x >= 0) & (y >= 0) & (x < len(doc.hash)) & (y < len(case.hash))
        x, y = np.where(ok, x, 0), np.where(ok, y, 0)
        return ok & (doc.hash[x] == case.hash[y]) & (doc.text_of[x] == doc.text_of[d]) & (case.text_of[y] == case.text_of[c])

    n, left, right = np.zeros(len(d), dtype=np.int64), same(0), same(0)
    n += right
    for i in range(1, min_words):
        left &= same(-i)
        right &= same(i)
        n += left.astype(np.int64) + right
    runs: set[tuple[int, int, int]] = set()
    inside: dict[tuple[int, int], tuple[int, int]] = {}
    for x, y in sorted(zip(d[n >= min_words].tolist(), c[n >= min_words].tolist())):
        key = (x - y, int(case.text_of[y]))
        if key in inside and inside[key][0] <= x < inside[key][1] and doc.text_of[x] == doc.text_of[inside[key][0]]:
            continue
        lo, hi = 0, 1
        while x + lo > 0 and y + lo > 0 and doc.hash[x + lo - 1] == case.hash[y + lo - 1] and doc.text_of[x + lo - 1] == doc.text_of[x] and case.text_of[y + lo - 1] == case.text_of[y]:
            lo -= 1
        while x + hi < len(doc.hash) and y + hi < len(case.hash) and doc.hash[x + hi] == case.hash[y + hi] and doc.text_of[x + hi] == doc.text_of[x] and case.text_of[y + hi] == case.text_of[y]:
            hi += 1
        inside[key] = (x + lo, x + hi)
        if doc.words(x + lo, x + hi) == case.words(y + lo, y + hi):  # the words themselves, not only their hashes
            runs.add((x + lo, y + lo, hi - lo))
    return runs


def _found(ids: list[int], doc: tn.Words, p: Passages, d: np.ndarray, c: np.ndarray) -> list[tuple]:
    return [
        (*p.rows[p.words.text_of[y]], ids[doc.text_of[x]], int(y - p.words.first[p.words.text_of[y]]), int(x - doc.first[doc.text_of[x]]), n)
        for x, y, n in extend(doc, p.words, d, c, p.min_words)
    ]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), type=f.type) for x, f in zip(zip(*rows) if rows else [()] * len(_SPANS), _SPANS)], schema=_SPANS)


def _texts(cases: DataFrame) -> DataFrame:
    """(case_id, field, text) of every evaluation text that isn't null."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("query", "passage"))))
    return cases.select("case_id", each.alias("t")).select("case_id", "t.field", "t.text").where("text is not null")


def leaked_spans(documents: DataFrame, cases: DataFrame, min_words: int = MIN_WORDS, k: int = K, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """One row for each longest run of at least ``min_words`` words that a document shares with an evaluation text."""
    texts = _texts(cases)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    if (texts.agg(F.sum(F.length("text"))).first()[0] or 0) > broadcast_chars:
        return _by_shuffle(docs, texts, min_words, k)
    passages = sorted((r["case_id"], r["field"], r["text"]) for r in texts.collect())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Passages(passages, k, min_words)
        for batch in batches:
            ids, all_texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            rows: list[tuple] = []
            for lo, hi in tn.passes(all_texts):
                doc = tn.Words(all_texts[lo:hi])
                g = doc.grams(k)
                at = tn.winnow(g, min_words - k + 1)
                first, last = np.searchsorted(p.grams, g[at], "left"), np.searchsorted(p.grams, g[at], "right")
                n = last - first
                d = np.repeat(at, n)
                c = p.at[np.arange(len(d)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)] if len(d) else d
                rows += _found(ids[lo:hi], doc, p, d, c)
            yield _batch(rows)

    return docs.mapInArrow(scan, SPANS)


def _fingerprints(df: DataFrame, key: list[str], min_words: int, k: int) -> DataFrame:
    """(gram, *key): the distinct fingerprints of each text."""
    schema = T.StructType([*(df.schema[c] for c in key), T.StructField("gram", T.LongType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in tn.passes(texts):
                w = tn.Words(texts[lo:hi])
                g = w.grams(k)
                at = tn.winnow(g, min_words - k + 1)
                pairs = np.unique(np.rec.fromarrays([w.text_of[at], g[at]]))
                rows = pa.array(pairs["f0"] + lo)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in key), pa.array(pairs["f1"].view(np.int64))], names=[*key, "gram"])

    return df.select(*key, "text").mapInArrow(scan, schema)


def _by_shuffle(docs: DataFrame, texts: DataFrame, min_words: int, k: int) -> DataFrame:
    case_key = ["case_id", "field"]
    hits = _fingerprints(docs, ["doc_id"], min_words, k).join(_fingerprints(texts, case_key, min_words, k), "gram").select("doc_id", *case_key).distinct()
    both = hits.join(docs, "doc_id").join(texts.withColumnRenamed("text", "passage"), case_key)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, p = None, None
        for batch in batches:
            rows: list[tuple] = []
            for r in batch.to_pylist():
                if held != (r["case_id"], r["field"]):  # rows of one passage mostly follow one another
                    held, p = (r["case_id"], r["field"]), Passages([(r["case_id"], r["field"], r["passage"])], k, min_words)
                doc = tn.Words([r["text"]])
                g = doc.grams(k)
                at = tn.winnow(g, min_words - k + 1)
                first, n = np.searchsorted(p.grams, g[at], "left"), np.searchsorted(p.grams, g[at], "right") - np.searchsorted(p.grams, g[at], "left")
                d = np.repeat(at, n)
                c = p.at[np.arange(len(d)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)] if len(d) else d
                rows += _found([r["doc_id"]], doc, p, d, c)
            yield _batch(rows)

    return both.select("doc_id", *case_key, "text", "passage").mapInArrow(check, SPANS)


def leaked_pairs(spans: DataFrame) -> DataFrame:
    """(case_id, doc_id) of every document that holds a long run of a case's words."""
    return spans.select("case_id", "doc_id").distinct()


def leaked_documents(spans: DataFrame) -> DataFrame:
    """One row per affected document: the cases found in it and the longest run."""
    return spans.groupBy("doc_id").agg(F.sort_array(F.collect_set("case_id")).alias("case_ids"), F.max("n_words").alias("longest_words"), F.countDistinct("case_id", "field").alias("n_texts"))
