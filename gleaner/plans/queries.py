"""Queries of the core by name; each takes a session and the directory of the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text as tx
from gleaner.functions import vectors as vx
from gleaner.functions.ids import stable_id
from gleaner.operators import answer, chunking, dense, embed, evaluate, fusion, nested, sparse, store
from gleaner.runtime import shared_dir, spread_table, table, table_in_shared_dir
from gleaner.sources import loaders
from gleaner.streaming import ingest, ratelimit

TOP = 10
HITS = 5
EVAL_K = 8
FILTER_LANG = "de"
FILTER_LABEL = 3
BUCKET_RATE, BUCKET_BURST = 1 / 3600, 3.0
CACHE_ENTRIES = 200


# --- shared inputs ------------------------------------------------------------------------------------------------


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk once."""
    return table(spark, d, "chunks").select("chunk_id", "text", "source", "doc_id").dropDuplicates(["chunk_id"])


def _tokenized(spark: SparkSession, d: str) -> DataFrame:
    return sparse.tokenized(table(spark, d, "chunks"))


def _cases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_cases").select(F.col("case_id").alias("qid"), "query", "relevant")


def _bm25(spark: SparkSession, d: str, k: int = TOP) -> DataFrame:
    return sparse.BM25().search(_cases(spark, d), _tokenized(spark, d), k)


def _overlap(spark: SparkSession, d: str, k: int = TOP, tokenized: DataFrame | None = None) -> DataFrame:
    """A second ranked list: chunks by the Jaccard similarity of their terms with the query's."""
    q = _cases(spark, d).select("qid", F.array_distinct(tx.tokens("query")).alias("q"))
    terms = q.select("qid", F.size("q").alias("nq"), F.explode("q").alias("term"))
    t = (_tokenized(spark, d) if tokenized is None else tokenized).select("id", F.array_distinct("tokens").alias("t")).select("id", F.size("t").alias("nt"), F.explode("t").alias("term"))
    common = terms.join(t, "term").groupBy("qid", "id", "nq", "nt").agg(F.count("*").alias("m"))
    return sparse.top_k(common.select("qid", "id", F.round(F.col("m") / (F.col("nq") + F.col("nt") - F.col("m")), sparse.DIGITS).alias("score")), k)


def _hits(spark: SparkSession, d: str, k: int = HITS) -> DataFrame:
    """BM25's best chunks with their texts."""
    c = _chunks(spark, d).withColumnRenamed("chunk_id", "id")
    return _bm25(spark, d, k).join(c, "id").withColumnRenamed("rank", "position")


def _legs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both ranked lists and the tokens they come from, which are made once and written."""
    t = table_in_shared_dir(_tokenized(spark, d), "tokens")
    return _overlap(spark, d, tokenized=t), sparse.BM25().search(_cases(spark, d), t, TOP), t


def _reranked(spark: SparkSession, d: str) -> DataFrame:
    """Merged hits, scored again, the best TOP of each query."""
    overlap, bm25, t = _legs(spark, d)
    merged = fusion.merge_legs(overlap, bm25)
    q = _cases(spark, d).select("qid", tx.tokens("query").alias("q"))
    rows = merged.join(q, "qid").join(t.select("id", "tokens"), "id")
    return fusion.ranked(rows.withColumn("score", fusion.rerank_score("q", "tokens", "fused")), TOP)


# --- text and index -----------------------------------------------------------------------------------------------


def tokenize_docs(spark: SparkSession, d: str) -> DataFrame:
    t = spread_table(spark, d, "documents").select("doc_id", tx.tokens("text").alias("t"), "text")
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.array_join(F.slice("t", 1, 8), " ").alias("first"), tx.estimate_tokens("text").cast("long").alias("estimate"))


def term_freq(spark: SparkSession, d: str) -> DataFrame:
    return sparse.postings(_tokenized(spark, d)).select(F.col("id").alias("chunk_id"), "term", "tf")


def doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return sparse.term_stats(sparse.postings(_tokenized(spark, d)))


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return sparse.corpus_stats(_tokenized(spark, d)).select("n", F.round("avgdl", 9).alias("avgdl"))


def index_stats(spark: SparkSession, d: str) -> DataFrame:
    terms = sparse.postings(_tokenized(spark, d)).agg(F.countDistinct("term").alias("terms"))
    return _chunks(spark, d).agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("documents"), F.countDistinct("source").alias("sources")).crossJoin(F.broadcast(terms))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d)


def bm25_filtered(spark: SparkSession, d: str) -> DataFrame:
    kept = table(spark, d, "documents").where(F.col("lang") == FILTER_LANG).select(F.col("doc_key").alias("doc_id"))
    keep = _chunks(spark, d).join(kept, "doc_id", "left_semi").select(F.col("chunk_id").alias("id"))
    return sparse.BM25().search(_cases(spark, d), _tokenized(spark, d), TOP, keep)


def overlap_topk(spark: SparkSession, d: str) -> DataFrame:
    return _overlap(spark, d)


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    return dense.search(v.where("id % 20 = 0").select(F.col("id").alias("qid"), "vec"), v, TOP, 64)


def dense_filtered(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    return dense.search(v.where("id % 20 = 0").select(F.col("id").alias("qid"), "vec"), v.where(F.col("label") == FILTER_LABEL), TOP, 64)


def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", vx.norm("embedding").alias("n"), vx.l2_normalize("embedding").alias("u"))
    return v.select("vec_id", F.round("n", 9).alias("norm"), F.round(F.get("u", F.lit(0)), 9).alias("first"), F.round(vx.norm("u"), 9).alias("unit"))


def cosine_next(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    n = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(n, "vec_id").select("vec_id", F.round(vx.cosine("embedding", "other"), 9).alias("cosine"))


# --- fusion and reranking -----------------------------------------------------------------------------------------


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return fusion.reciprocal_rank_fusion([*_legs(spark, d)[:2]])


def hybrid_merge(spark: SparkSession, d: str) -> DataFrame:
    return fusion.merge_legs(*_legs(spark, d)[:2]).drop("dense_score", "sparse_score")


def hybrid_dense(spark: SparkSession, d: str) -> DataFrame:
    """Chunks like those whose id ends in 0: by their vectors, and by the words of their source path; both lists merged."""
    v = table(spark, d, "vectors").where("model = 'hashing' and dim = 64 and key is not null").where(vx.is_usable("vec", "dim"))
    v = v.groupBy(F.col("key").alias("id")).agg(F.first("vec").alias("vec"))
    asked = v.where("id like '%0'").select(F.col("id").alias("qid"), "vec")
    words = _chunks(spark, d).join(asked.select(F.col("qid").alias("chunk_id")), "chunk_id", "left_semi").select(F.col("chunk_id").alias("qid"), F.col("source").alias("query"))
    near, lexical = dense.search(asked, v, TOP, 64), sparse.BM25().search(words, _tokenized(spark, d), TOP)
    return fusion.merge_legs(near, lexical).select("qid", "id", "dense_rank", "sparse_rank", "fused", "retrieved_by", "ord")


def rerank(spark: SparkSession, d: str) -> DataFrame:
    return _reranked(spark, d).select("qid", "id", "score", "position")


def score_floor(spark: SparkSession, d: str) -> DataFrame:
    return fusion.score_floor(_reranked(spark, d)).select("qid", "id", "score", "position")


def mmr(spark: SparkSession, d: str) -> DataFrame:
    return fusion.mmr(_reranked(spark, d).select("qid", "id", "position", "tokens", "score"))


def jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of the hits of one query with each other, HITS * HITS pairs a query."""
    tokens = table_in_shared_dir(_tokenized(spark, d), "tokens")
    h = sparse.BM25().search(_cases(spark, d), tokens, HITS).join(tokens.select("id", F.array_distinct("tokens").alias("t")), "id")
    a, b = h.select("qid", F.col("id").alias("id_a"), F.col("t").alias("ta")), h.select("qid", F.col("id").alias("id_b"), F.col("t").alias("tb"))
    return a.join(b, "qid").where("id_a < id_b").select("qid", "id_a", "id_b", F.round(tx.jaccard("ta", "tb"), 9).alias("jaccard"))


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Both legs with hashed embeddings of chunks and queries, fused, reranked, diversified, cut at the floor."""
    from gleaner.pipeline import Engine

    return Engine(spark).retrieve(_cases(spark, d), _chunks(spark, d))


# --- chunking and parsing -----------------------------------------------------------------------------------------


def chunk_fixed(spark: SparkSession, d: str) -> DataFrame:
    return chunking.fixed_windows(spread_table(spark, d, "documents"), 320, 64)


def chunk_sentence(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_documents(spread_table(spark, d, "documents").select("doc_id", "text"), chunking.ChunkSettings(strategy="sentence")).drop("chunk_id")


def chunk_recursive(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_documents(spread_table(spark, d, "documents").select("doc_id", "text"))


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").where("text is not null").select("doc_id", tx.sentences("text").alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))


def headings(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "documents").where("text is not null").select("doc_id", tx.headings(tx.body("text")).alias("h"))
    return h.where("size(h) > 0").select("doc_id", F.size("h").cast("long").alias("n"), F.array_join("h", "|").alias("headings"))


def front_matter(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "documents").where("text is not null").select("doc_id", tx.front_matter("text").alias("m"), F.length(tx.body("text")).cast("long").alias("body_chars"))
    return m.where("size(m) > 0").select("doc_id", "body_chars", F.explode("m").alias("key", "value"))


def html_clean(spark: SparkSession, d: str) -> DataFrame:
    """Documents wrapped as HTML and read back as text."""
    t = table(spark, d, "documents").where("text is not null")
    page = F.concat(F.lit("<html><head><title> "), F.coalesce("source", F.lit("")), F.lit("</title><style>p{}</style></head><body><p>"), F.replace(F.replace("text", F.lit("<"), F.lit("(")), F.lit("&"), F.lit("&amp;")), F.lit("</p>&nbsp;<script>x=1</script></body></html>"))
    return t.select("doc_id", page.alias("html")).select("doc_id", tx.html_title("html").alias("title"), F.md5(tx.html_text("html")).alias("digest"))


def csv_fold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", loaders.fold_row(["c_name", "c_nationkey", "c_mktsegment"]).alias("body"))


def json_fields(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", F.from_json("props", "k long").alias("p"))
    return e.groupBy("event_type").agg(F.count("p.k").alias("n"), F.sum("p.k").alias("total"), F.max("p.k").alias("most"))


def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null and source is not null and doc_key is not null")
    return docs.select("doc_id", stable_id("source", "text").alias("doc_key"))


def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("text is not null and doc_id is not null and chunk_index is not null")
    return c.select(F.col("chunk_id").alias("stored"), stable_id("doc_id", "chunk_index", "text").alias("chunk_id")).distinct()


# --- embedding ----------------------------------------------------------------------------------------------------


def feature_weights(spark: SparkSession, d: str) -> DataFrame:
    f = _tokenized(spark, d).select(F.explode(embed.features("tokens")).alias("f"))
    return f.groupBy("f.feature").agg(F.count("*").alias("n"), F.round(F.sum("f.weight"), 3).alias("weight"))


def hash_embed(spark: SparkSession, d: str) -> DataFrame:
    return embed.embed(_chunks(spark, d).select("chunk_id", "text"), lambda: embed.HashingEmbedder(256)).select("chunk_id", "vec")


def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    return embed.cache_misses(table(spark, d, "chunks").select(F.col("chunk_id").alias("key")), table(spark, d, "vectors").where("key is not null"), ["key"])


def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "chunks").select(F.col("chunk_id").alias("key"))
    cache = table(spark, d, "vectors").where("key is not null").select("model", "dim", "key", "cached_at")
    return cache.groupBy("model", "dim", "key").agg(F.max("cached_at").alias("cached_at")).join(wanted.distinct(), "key", "left_semi").select("model", "dim", "key", "cached_at")


def cache_eviction(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "traces").where("query is not null").groupBy("query").agg(F.count("*").alias("hits"))
    return embed.evict(e, CACHE_ENTRIES, "hits", "query")


# --- answers ------------------------------------------------------------------------------------------------------


def extractive_answer(spark: SparkSession, d: str) -> DataFrame:
    return answer.extractive_answers(_cases(spark, d), _hits(spark, d))


def answer_sentences(spark: SparkSession, d: str) -> DataFrame:
    return answer.answer_sentences(_cases(spark, d), _hits(spark, d))


def answer_stream(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "responses").where("trace_id is not null and answer is not null").groupBy("trace_id").agg(F.max("answer").alias("answer"))
    return answer.answer_slices(r.withColumnRenamed("trace_id", "qid"))


def prompt_context(spark: SparkSession, d: str) -> DataFrame:
    p = answer.prompts(_cases(spark, d).select("qid", "query"), _hits(spark, d, TOP), 6000)
    return p.select("qid", F.get("messages", F.lit(1))["content"].alias("prompt"))


def history_window(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "traces").where("trace_id is not null").groupBy("trace_id").agg(F.max("client_key").alias("qid"), F.max("query").alias("query"), F.max("started_at").alias("at"))
    turns = t.select("qid", "trace_id", "query", F.struct("at", "trace_id").alias("turn"))
    return answer.history_window(turns, 4).select("qid", "trace_id", "query")


# --- evaluation ---------------------------------------------------------------------------------------------------


def _flags(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.flagged(_hits(spark, d, EVAL_K).withColumnRenamed("position", "rank"), _cases(spark, d))


def eval_per_query(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.per_query(_flags(spark, d), _cases(spark, d), EVAL_K)


def label_recall(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.label_recall(_hits(spark, d, EVAL_K), _cases(spark, d))


def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.summary(eval_per_query(spark, d))


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.nearest_rank(table(spark, d, "events"), "event_type", "value", [50, 95, 99])


def stage_durations(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "traces").select(F.explode("spans").alias("s")).where("s is not null")
    return s.groupBy("s.name").agg(F.count("*").alias("n"), F.round(F.sum("s.ms"), 3).alias("ms"))


# --- store --------------------------------------------------------------------------------------------------------


def dedup_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select("chunk_id", "doc_id", "chunk_index", "indexed_at")
    return store.dedupe(c, "chunk_id", ["indexed_at"])


def dedupe_text(spark: SparkSession, d: str) -> DataFrame:
    return store.dedupe_on_text(_chunks(spark, d), "chunk_id").select("chunk_id")


def replace_source(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of German documents, written again as one chunk for each source, in the place of all older ones."""
    c = _chunks(spark, d).where("source is not null").select("chunk_id", "source")
    new = table(spark, d, "documents").where("lang = 'de' and source is not null").groupBy("source").agg(F.concat(F.lit("new "), F.min("doc_id")).alias("chunk_id"))
    return store.replace_documents(c, new.select("chunk_id", "source"), "source")


def upsert_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Half of the chunks written again under a new source."""
    c = _chunks(spark, d).select("chunk_id", "source")
    new = c.where("chunk_id >= '8'").withColumn("source", F.lit("again"))
    return store.upsert(c, new, "chunk_id")


def delete_documents(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "documents").where("lang = 'fr'").select(F.col("doc_key").alias("doc_id"))
    return store.delete(_chunks(spark, d).select("chunk_id", "doc_id"), gone, "doc_id")


def get_many(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "responses").select("trace_id", F.posexplode("citations").alias("ord", "x")).where("x is not null").select("trace_id", F.col("ord").cast("long").alias("ord"), F.col("x.chunk_id").alias("chunk_id")).distinct()
    return store.get_many(_chunks(spark, d).select("chunk_id", "source"), c, "chunk_id")


def metadata_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.explode("metadata").alias("key", "value")).groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"))


def metadata_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(loaders.matches("metadata", {"ext": ".md", "row": None})).select("doc_id")


def unknown_filter_keys(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "documents").select(F.explode(F.map_keys("metadata")).alias("key")).distinct()
    asked = table(spark, d, "eval_cases").select(F.explode(F.map_keys("metadata")).alias("key")).distinct()
    return asked.join(known, "key", "left_anti")


def save_load_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    import uuid

    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    store.save(hash_embed(spark, d), path, "vec", 256, "hashing")
    return store.load(spark, path, 256, "hashing").select("chunk_id", F.size("vec").cast("long").alias("n"))


# --- streaming ----------------------------------------------------------------------------------------------------


def token_bucket(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"))
    return ratelimit.admit(r, BUCKET_RATE, BUCKET_BURST).select("key", "id", "admitted")


def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    import uuid

    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    table(spark, d, "documents").select("doc_id", "text").write.parquet(f"{base}/in")
    ingest.ingest_available(spark, f"{base}/in", "doc_id long, text string", f"{base}/index", f"{base}/checkpoint")
    return ingest.indexed(spark, f"{base}/index").select("chunk_id", "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"))


def stream_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every document that the stream brought into the index, with the number of its first chunk."""
    return stream_ingest(spark, d).groupBy("doc_id").agg(F.min("chunk_index").alias("first_index"))


# --- nested records (problem 3) -----------------------------------------------------------------------------------


def _flat(spark: SparkSession, d: str) -> nested.Flat:
    return nested.Flat(table(spark, d, "traces"), table(spark, d, "responses"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d).all_nodes()


def _p3_table(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: _flat(spark, d).table(kind)


def p3_traces(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d).root()


def p3_failed_calls(spark: SparkSession, d: str) -> DataFrame:
    """The table of one variant."""
    return _flat(spark, d).subtype("call", "call_failed")


def p3_variants(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d).variants()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        tokenize_docs, term_freq, doc_freq, corpus_stats, index_stats, bm25_topk, bm25_filtered, overlap_topk, dense_topk, dense_filtered, l2_normalize, cosine_next,
        rrf_fusion, hybrid_merge, hybrid_dense, rerank, score_floor, mmr, jaccard_pairs, hybrid_search, chunk_fixed, chunk_sentence, chunk_recursive, sentence_split, headings, front_matter,
        html_clean, csv_fold, json_fields, stable_ids, chunk_ids, feature_weights, hash_embed, cache_misses, cache_lookup, cache_eviction, extractive_answer, answer_sentences, answer_stream,
        prompt_context, history_window, eval_per_query, label_recall, eval_summary, latency_percentiles, stage_durations, dedup_chunks, dedupe_text, replace_source, upsert_chunks, delete_documents, get_many, metadata_keys,
        metadata_filter, unknown_filter_keys, save_load_roundtrip, token_bucket, stream_ingest, stream_documents, p3_found, p3_variants, p3_traces, p3_failed_calls,
    )
} | {f"p3_{name}": _p3_table(kind) for name, kind in (("spans", "span"), ("calls", "call"), ("batches", "batch"), ("legs", "leg"), ("leg_hits", "leg_hit"), ("citations", "citation"))}
