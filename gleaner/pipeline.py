"""The engine: indexing, retrieval for a table of questions, answers, evaluation, persistence."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text as tx
from gleaner.operators import answer, dense, embed, evaluate, fusion, sparse, store
from gleaner.operators.chunking import ChunkSettings, chunk_documents
from gleaner.settings import RetrievalSettings
from gleaner.runtime import collect_bounded, table_in_shared_dir
from gleaner.sources import loaders


#: Ingests after which the index is written anew, so that its plan stays short.
COMPACT = 8


@dataclass
class Engine:
    spark: SparkSession
    chunking: ChunkSettings = field(default_factory=ChunkSettings)
    retrieval: RetrievalSettings = field(default_factory=RetrievalSettings)
    provider: Callable[[], embed.EmbeddingProvider] = embed.HashingEmbedder
    provider_name: str = "hashing"
    dimensions: int = 256
    templates: answer.Templates = field(default_factory=answer.Templates)
    #: Vectors by text, kept from one ingest to the next; None: every text is embedded.
    cache: embed.CacheTable | None = None
    #: Whether the chunks of an ingested source take the place of all older chunks of that source.
    replace_source: bool = False
    index: DataFrame | None = None
    postings: sparse.Postings | None = None
    ingests: int = 0

    def __post_init__(self) -> None:
        if self.dimensions <= 0 or not self.provider_name:
            raise ValueError("an embedder has a name and a positive width")

    # --- indexing ---

    def index_documents(self, documents: DataFrame) -> dict:
        """Chunks and embeds documents(doc_id, text, source, metadata), puts them into the index by chunk id, and counts:
        documents, chunks made, chunks embedded (each distinct text once, with a cache only new ones), chunks that were
        there twice. The new chunks are written once; later queries read them."""
        embed.preflight(self.provider())
        documents = table_in_shared_dir(documents, "documents")
        made = table_in_shared_dir(chunk_documents(documents, self.chunking), "chunks")
        chunks = made.dropDuplicates(["chunk_id"])
        if self.cache is None:
            rows = table_in_shared_dir(embed.embed(chunks, self.provider), "ingest")
            embedded = rows.count()
        else:
            rows, new = embed.embed_through(chunks, self.cache.read(), self.provider, self.provider_name, self.dimensions)
            rows, embedded = table_in_shared_dir(rows, "ingest"), new.count()
            self.cache.put(new)
        n = rows.count()
        self._put(rows)
        return {"documents": documents.count(), "chunks": n, "embedded": embedded, "skipped": made.count() - n}

    def _put(self, rows: DataFrame) -> None:
        self.ingests += 1
        self.postings = None
        if self.index is None:
            self.index = rows
            return
        old = store.replace_documents(self.index, rows, "source").select(self.index.columns) if self.replace_source else store.upsert(self.index, rows, "chunk_id")
        self.index = table_in_shared_dir(old, "index") if self.ingests % COMPACT == 0 else old

    def index_path(self, path: str, recursive: bool = True) -> dict:
        return self.index_documents(loaders.load(self.spark, path, recursive))

    def build_postings(self, path: str) -> None:
        """Stores the inverted index; until the chunks change again, searches read only the terms they need."""
        self.postings = self._postings(self._index(), path)

    def _postings(self, rows: DataFrame, path: str) -> sparse.Postings:
        return sparse.Postings.build(sparse.tokenized(rows, unique=True), path, sparse.BM25(self.retrieval.k1, self.retrieval.b))

    def delete_documents(self, doc_ids: DataFrame) -> DataFrame:
        self.index, self.postings = store.delete(self._index(), doc_ids, "doc_id"), None
        return self.index

    def save(self, path: str) -> dict:
        """Writes a snapshot with its postings, and goes on with what was written."""
        out = store.save(self._index(), path, "vec", self.dimensions, self.provider_name, beside=self._postings)
        self.load(path)
        return out

    def load(self, path: str) -> DataFrame:
        """The newest snapshot, checked, and its postings."""
        self.index = store.load(self.spark, path, self.dimensions, self.provider_name)
        beside = store.beside_of(self.spark, path)
        self.postings = sparse.Postings(self.spark, beside, sparse.BM25(self.retrieval.k1, self.retrieval.b)) if beside else None
        return self.index

    def _index(self) -> DataFrame:
        if self.index is None:
            raise ValueError("nothing is indexed yet")
        return self.index

    def stats(self) -> dict:
        rows = self._index()
        r = rows.agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("documents")).first()
        return {"chunks": r["chunks"], "documents": r["documents"], "dimensions": self.dimensions, "embedder": self.provider_name}

    def filter_keys(self) -> set[str]:
        """The metadata keys that the index knows."""
        rows = self._index()
        if "metadata" not in rows.columns:
            return set()
        return {r[0] for r in collect_bounded(rows.select(F.explode(F.map_keys("metadata"))).distinct(), 100_000, "metadata keys")}

    def check_filters(self, filters: dict | None) -> None:
        unknown = sorted(set(filters or ()) - self.filter_keys()) if filters else []
        if unknown:
            raise ValueError(f"unknown filter keys: {', '.join(unknown)}")

    def ready(self) -> dict:
        """What a health check tells: whether there is an index, whether it can be read, and whether the provider works."""
        out = {}
        for name, test in (("index", lambda: self._index().limit(1).count()), ("embedder", lambda: embed.preflight(self.provider()))):
            try:
                test()
                out[name] = "ok"
            except Exception as e:  # whatever it is, it is what is wrong
                out[name] = str(e).splitlines()[0] if str(e) else type(e).__name__
        return {"status": "ok" if set(out.values()) == {"ok"} else "failing", **out}

    # --- questions ---

    def questions(self, texts: list[str]) -> DataFrame:
        """A table of questions, each checked: not blank, not longer than the limit."""
        for t in texts:
            if not t.strip():
                raise ValueError("a question is empty")
            if len(t) > self.retrieval.max_query_chars:
                raise ValueError(f"a question is longer than {self.retrieval.max_query_chars} characters")
        return self.spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "qid long, query string")

    def retrieve(self, questions: DataFrame, chunks: DataFrame | None = None, filters: dict | None = None, top_k: int | None = None) -> DataFrame:
        """(qid, id, position, score, text, source, retrieved_by): the chosen chunks of every question, in order."""
        s = self.retrieval if top_k is None else replace(self.retrieval, top_k=top_k)
        unique = chunks is None
        chunks = self._index() if chunks is None else chunks
        if filters:
            allowed = chunks.where(loaders.matches("metadata", filters))
        else:
            allowed = chunks
        with_vec = allowed if "vec" in chunks.columns else embed.embed(allowed, self.provider)
        q = questions.select("qid", "query")
        k = max(s.candidates, s.top_k)
        vectors = with_vec.select(F.col("chunk_id").alias("id"), "vec")
        near = dense.search(embed.embed(q, self.provider, "query").select("qid", "vec"), vectors, k, self.dimensions)
        tokenized = sparse.tokenized(chunks, unique=unique) if self.postings is None else None
        keep = allowed.select(F.col("chunk_id").alias("id")) if filters else None
        lexical = sparse.BM25(s.k1, s.b).search(q, tokenized, k, keep) if self.postings is None else self.postings.search(q, k, keep)
        # narrow from here on: the tokens of each candidate once, as numbers, and texts again at the end
        merged = table_in_shared_dir(fusion.merge_legs(near, lexical, s.dense_weight, s.rrf_k), "legs")
        texts = chunks.select(F.col("chunk_id").alias("id"), "text", "source")
        coded = lambda c: F.transform(tx.tokens(c), lambda t: F.xxhash64(t))
        found = texts.join(merged.select("id").distinct(), "id", "left_semi").select("id", coded("text").alias("tokens"))
        rows = merged.join(q.select("qid", coded("query").alias("q")), "qid").join(found, "id")
        rows = rows.withColumn("score", fusion.rerank_score("q", "tokens", "fused") if s.rerank else F.col("fused"))
        best = fusion.ranked(rows, s.top_k)
        if s.mmr_lambda < 1:
            best = fusion.mmr(best, s.mmr_lambda, keep=("score", "retrieved_by")).withColumnRenamed("mmr_rank", "position")
        best = fusion.score_floor(best.select("qid", "id", "position", "score", "retrieved_by"), s.floor)
        best = best.selectExpr("qid", "id", "cast(row_number() over (partition by qid order by position) as bigint) as position", "score", "retrieved_by")
        return best.join(texts, "id").select("qid", "id", "position", "score", "text", "source", "retrieved_by")

    def answer(self, questions: DataFrame, filters: dict | None = None, top_k: int | None = None) -> DataFrame:
        """(qid, query, answer, confident, citations) with extractive answers."""
        hits = table_in_shared_dir(self.retrieve(questions, filters=filters, top_k=top_k), "hits")
        cited = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(F.col("position").alias("idx"), F.col("id").alias("chunk_id"), "source", F.round("score", 4).alias("score"), "retrieved_by", F.translate(F.substring("text", 1, 120), "\n", " ").alias("text")))).alias("citations"))
        return questions.select("qid", "query").join(answer.extractive_answers(questions, hits), "qid").join(cited, "qid", "left")

    def prompts(self, questions: DataFrame, history: DataFrame | None = None) -> DataFrame:
        return answer.prompts(questions, self.retrieve(questions), self.retrieval.budget_chars, history, self.templates)

    def evaluate(self, cases: DataFrame, k: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Per-query rows and their means for cases(qid, query, relevant)."""
        k = k or self.retrieval.top_k
        flags = evaluate.flagged(self.retrieve(cases).withColumnRenamed("position", "rank"), cases)
        rows = evaluate.per_query(flags, cases, k)
        return rows, evaluate.summary(rows)
