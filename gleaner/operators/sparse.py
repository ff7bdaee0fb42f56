"""The lexical leg: an inverted index as ordinary tables, and BM25 top-k for a table of queries."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_type

from gleaner.functions import ranking
from gleaner.functions import text as tx
from gleaner.runtime import table_in_shared_dir

K1, B = 1.5, 0.75
#: Scores are compared after rounding to this many digits, so that the order of summation can't decide a tie.
DIGITS = 9


def tokenized(chunks: DataFrame, id_col: str = "chunk_id", unique: bool = False) -> DataFrame:
    """(id, tokens, dl) of every chunk with at least one token; repeated rows of an id count once. ``unique``: the caller
    knows that there are none, so nothing is shuffled."""
    rows = chunks.select(F.col(id_col).alias("id"), "text")
    rows = (rows if unique else rows.dropDuplicates(["id"])).select("id", tx.tokens("text").alias("tokens"))
    return rows.withColumn("dl", F.size("tokens").cast("long")).where("dl > 0")


def postings(tokenized_: DataFrame) -> DataFrame:
    """(term, id, tf)."""
    return tokenized_.select("id", F.explode("tokens").alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"))


def term_stats(postings_: DataFrame) -> DataFrame:
    return postings_.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(tokenized_: DataFrame) -> DataFrame:
    return tokenized_.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


@dataclass(frozen=True)
class BM25:
    k1: float = K1
    b: float = B

    def search(self, queries: DataFrame, tokenized_: DataFrame, k: int, keep: DataFrame | None = None) -> DataFrame:
        """(qid, id, score, rank): the best k chunks of each query; ``keep`` (id) restricts the chunks, not the statistics.

        A term that a query repeats counts repeatedly. The chunks are read once: what they hold of the queries' terms is
        counted and written, statistics over every chunk are taken from it, and each part of the chunks is scored by itself,
        so that k rows for each query and part are all that is shuffled, however frequent a term is.
        """
        found = [self._search(q, tokenized_, k, keep) for q in _blocks(query_terms(queries))] if k > 0 else []
        return _union(found, queries, tokenized_, k)

    def _search(self, q: pa.Table, tokenized_: DataFrame, k: int, keep: DataFrame | None) -> DataFrame:
        terms = _terms(q)
        rows = table_in_shared_dir(_counted(tokenized_, terms), "term-counts")
        n, avgdl = rows.agg(F.count("*"), F.avg("dl")).first()
        df = np.zeros(len(terms), dtype=np.int64)
        counts = rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toArrow()  # QUERY_TERMS rows at most
        df[counts.column("t").to_numpy()] = counts.column("df").to_numpy()
        weights = _Weights.of(q, terms, df, n)
        chosen = rows.where("size(terms) > 0")
        if keep is not None:
            chosen = chosen.join(keep.select("id").distinct(), "id", "left_semi")
        sent = rows.sparkSession.sparkContext.broadcast(weights)  # QUERY_TERMS rows at most
        ids, qids = rows.schema["id"].dataType, q.schema.field("qid").type
        schema = pa.schema([("qid", qids), ("id", to_arrow_type(ids)), ("score", pa.float64())])

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for some in _joined(batches, PART):
                lists = some.column("terms").combine_chunks()
                doc = np.repeat(np.arange(len(some)), lists.value_lengths().to_numpy())
                t, tf = lists.flatten().to_numpy(), some.column("tfs").combine_chunks().flatten().to_numpy()
                yield from self.scored(sent.value, some.column("id").combine_chunks(), some.column("dl").to_numpy(), doc, t, tf, avgdl, k, schema)

        return top_k(chosen.mapInArrow(scan, f"qid {_ddl(qids)}, id {ids.simpleString()}, score double"), k)

    def scored(self, q: _Weights, ids: pa.Array, dl: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, avgdl: float, k: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """The k best of some chunks for each query: (doc, term, tf) are their postings, doc counts within ids."""
        part = tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * dl[doc] / avgdl))
        by = np.argsort(term, kind="stable")
        doc, part, bounds = doc[by], part[by], np.searchsorted(term[by], np.arange(len(q.idf) + 1))
        order, step = ranking.places(ids), max(1, CELLS // max(1, len(ids)))
        for i in range(0, len(q.qids), step):
            s = np.zeros((min(step, len(q.qids) - i), len(ids)))
            for j, row in enumerate(s, i):
                for at in range(q.bounds[j], q.bounds[j + 1]):
                    t = q.terms[at]
                    lo, hi = bounds[t], bounds[t + 1]
                    if hi > lo:
                        row[doc[lo:hi]] += q.qtf[at] * q.idf[t] * part[lo:hi]
            s = np.round(s, DIGITS)
            r, c = ranking.best(s, k, order)
            some = s[r, c] > 0
            r, c = r[some], c[some]
            yield pa.RecordBatch.from_arrays([q.qids.take(pa.array(r + i)), ids.take(pa.array(c)), pa.array(s[r, c])], schema=schema)


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, term, qtf)."""
    return queries.select("qid", F.explode(tx.tokens("query")).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


#: Terms of queries that are sent to the tasks at once; more queries than that are answered block by block.
QUERY_TERMS = 1_000_000
#: Chunks scored together, and scores that stand in memory at once.
PART, CELLS = 16_384, 4_000_000


def _blocks(q: DataFrame) -> list[pa.Table]:
    """The terms of the queries in blocks of about QUERY_TERMS rows, whole queries each."""
    few = q.limit(QUERY_TERMS + 1).toArrow().combine_chunks()
    if few.num_rows <= QUERY_TERMS:
        return [few] if few.num_rows else []
    n = -(-q.count() // QUERY_TERMS)
    part = F.pmod(F.xxhash64("qid"), F.lit(n))
    return [t for i in range(n) if (t := q.where(part == i).toArrow().combine_chunks()).num_rows]


def _terms(q: pa.Table) -> pa.Array:
    return pc.unique(q.column("term").combine_chunks())


def _ddl(kind: pa.DataType) -> str:
    return from_arrow_type(kind).simpleString()


def _union(found: list[DataFrame], queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """All of the blocks' rows; none, with the same columns, where there is no block."""
    if not found:
        none = queries.select("qid").where("false").crossJoin(chunks.select("id").where("false"))
        return none.select("qid", "id", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("rank"))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every


def _joined(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches put together until they have so many rows."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _counted(tokenized_: DataFrame, terms: pa.Array) -> DataFrame:
    """(id, dl, terms, tfs): which of the terms, by number, each chunk holds and how often."""
    sent = tokenized_.sparkSession.sparkContext.broadcast(terms)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            code = pc.fill_null(pc.index_in(lists.flatten(), value_set=sent.value), -1).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            some = code >= 0
            pairs, tf = np.unique(row[some] * len(sent.value) + code[some], return_counts=True)
            ends = pa.array(np.searchsorted(pairs // max(1, len(sent.value)), np.arange(batch.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("dl"), pa.ListArray.from_arrays(ends, pa.array((pairs % max(1, len(sent.value))).astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int32)))],
                names=["id", "dl", "terms", "tfs"],
            )

    return tokenized_.select("id", "dl", "tokens").mapInArrow(scan, f"id {tokenized_.schema['id'].dataType.simpleString()}, dl long, terms array<int>, tfs array<int>")


@dataclass
class _Weights:
    """Queries as rows of a sparse matrix over the terms' numbers."""

    qids: pa.Array
    bounds: np.ndarray
    terms: np.ndarray
    qtf: np.ndarray
    idf: np.ndarray

    @classmethod
    def of(cls, q: pa.Table, terms: pa.Array, df: np.ndarray, n: int) -> _Weights:
        coded = pc.dictionary_encode(q.column("qid").combine_chunks(), null_encoding="encode")
        of = coded.indices.to_numpy()
        by = np.argsort(of, kind="stable")
        code = pc.index_in(q.column("term").combine_chunks(), value_set=terms).to_numpy()
        return cls(coded.dictionary, np.searchsorted(of[by], np.arange(len(coded.dictionary) + 1)), code[by], q.column("qtf").to_numpy()[by], np.log(1 + (n - df + 0.5) / (df + 0.5)))


@dataclass(frozen=True)
class Postings:
    """A stored inverted index, cut by chunk into parts of about PART chunks: of each part a row for each term, with the ids,
    lengths and frequencies of its chunks; rows sorted by term, so row groups of other terms are skipped. Term and corpus
    statistics stand beside them."""

    spark: SparkSession
    path: str
    bm25: BM25

    @classmethod
    def build(cls, tokenized_: DataFrame, path: str, bm25: BM25 | None = None) -> Postings:
        spark = tokenized_.sparkSession
        stats = corpus_stats(tokenized_).withColumn("avgdl", F.coalesce("avgdl", F.lit(0.0)))
        stats.write.mode("overwrite").parquet(f"{path}/corpus")
        parts = -(-spark.read.parquet(f"{path}/corpus").first()["n"] // PART) or 1
        cut = tokenized_.select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), "id", "dl", "tokens").repartition("part")
        tf = cut.select("part", "id", "dl", F.explode("tokens").alias("term")).groupBy("part", "term", "id", "dl").agg(F.count("*").cast("int").alias("tf"))
        lists = tf.groupBy("part", "term").agg(F.collect_list(F.struct("id", F.col("dl").cast("int").alias("dl"), "tf")).alias("chunks"))  # about PART at most
        lists.sortWithinPartitions("term", "part").write.mode("overwrite").parquet(f"{path}/postings")
        spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.sum(F.size("chunks")).alias("df")).sort("term").write.mode("overwrite").parquet(f"{path}/terms")
        return cls(spark, path, bm25 or BM25())

    @cached_property
    def corpus(self) -> tuple[int, float]:
        """The number of chunks and their mean length; an index doesn't change once it is written."""
        return tuple(self.spark.read.parquet(f"{self.path}/corpus").first())

    def search(self, queries: DataFrame, k: int, keep: DataFrame | None = None) -> DataFrame:
        """As ``BM25.search``; of the postings only the queries' terms are read, and each part is scored in one task."""
        rows = self.spark.read.parquet(f"{self.path}/postings")
        found = [self._search(q, rows, k, keep) for q in _blocks(query_terms(queries))] if k > 0 else []
        return _union(found, queries, rows.select(F.explode("chunks").alias("c")).select("c.id"), k)

    def _search(self, q: pa.Table, rows: DataFrame, k: int, keep: DataFrame | None) -> DataFrame:
        terms = _terms(q)
        wanted = self.spark.createDataFrame(pa.table({"term": terms, "code": pa.array(np.arange(len(terms), dtype=np.int32))}))
        one_of = F.col("term").isin(terms.to_pylist()) if len(terms) <= 1000 else F.lit(True)  # pushed down to the row groups
        n, avgdl = self.corpus
        known = self.spark.read.parquet(f"{self.path}/terms").where(one_of).join(F.broadcast(wanted), "term").toArrow()
        df = np.zeros(len(terms), dtype=np.int64)
        df[known.column("code").to_numpy()] = known.column("df").to_numpy()
        sent = self.spark.sparkContext.broadcast(_Weights.of(q, terms, df, n))  # QUERY_TERMS rows at most
        ids, qids, bm25 = rows.schema["chunks"].dataType.elementType["id"].dataType, q.schema.field("qid").type, self.bm25
        schema = pa.schema([("qid", qids), ("id", to_arrow_type(ids)), ("score", pa.float64())])
        hit = rows.where(one_of).join(F.broadcast(wanted), "term").select("part", "code", "chunks")
        if keep is not None:
            kept = hit.select("part", "code", F.explode("chunks").alias("c")).select("part", "code", "c", F.col("c.id").alias("id")).join(keep.select("id").distinct(), "id", "left_semi")
            hit = kept.groupBy("part", "code").agg(F.collect_list("c").alias("chunks"))

        def part(t: pa.Table) -> pa.Table:
            lists = t.column("chunks").combine_chunks()
            flat = lists.flatten()
            coded = pc.dictionary_encode(flat.field("id"))
            doc, lengths = coded.indices.to_numpy(), flat.field("dl").to_numpy()
            dl = np.zeros(len(coded.dictionary), dtype=np.int64)
            dl[doc] = lengths
            code = np.repeat(t.column("code").to_numpy(), lists.value_lengths().to_numpy())
            return pa.Table.from_batches(bm25.scored(sent.value, coded.dictionary, dl, doc, code, flat.field("tf").to_numpy(), avgdl, k, schema), schema=schema)

        return top_k(hit.groupBy("part").applyInArrow(part, f"qid {_ddl(qids)}, id {ids.simpleString()}, score double"), k)


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The k best rows of each qid, ranked from 1; equal scores in the order of ids."""
    if k <= 0:
        return scored.where("false").withColumn("rank", F.lit(0).cast("long"))
    return scored.selectExpr("*", "cast(row_number() over (partition by qid order by score desc, id) as bigint) as rank").where(F.col("rank") <= k)
