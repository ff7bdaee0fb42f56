"""Merging ranked lists and choosing among the merged hits: fusion, reranking, diversity, score floor."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as tx
from gleaner.operators.sparse import DIGITS

RRF_K, DENSE_WEIGHT, FLOOR, LAMBDA = 60, 0.6, 0.35, 0.7


def reciprocal_rank_fusion(lists: list[DataFrame], weights: list[float] | None = None, k: int = RRF_K) -> DataFrame:
    """(qid, id, score): the sum of weight / (k + rank) over the lists(qid, id, rank); repeated ids accumulate."""
    parts = [x.select("qid", "id", (F.lit(float(w)) / (k + F.col("rank"))).alias("part")) for x, w in zip(lists, weights or [1.0] * len(lists))]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("qid", "id").agg(F.round(F.sum("part"), 12).alias("score"))


def merge_legs(dense: DataFrame, sparse: DataFrame, dense_weight: float = DENSE_WEIGHT, k: int = RRF_K) -> DataFrame:
    """The full outer join of two ranked lists with the fused score, the labels of the legs that found the hit, and the
    position ``ord`` that breaks later ties: all dense hits by rank, then the sparse-only ones."""
    d, s = (x.select("qid", "id", F.col("rank").alias(f"{n}_rank"), F.col("score").alias(f"{n}_score")) for n, x in (("dense", dense), ("sparse", sparse)))
    part = [F.coalesce(F.lit(w) / (k + F.col(f"{n}_rank")), F.lit(0.0)) for n, w in (("dense", dense_weight), ("sparse", 1 - dense_weight))]
    labels = F.array_compact(F.array(F.when(F.col("dense_rank").isNotNull(), "dense"), F.when(F.col("sparse_rank").isNotNull(), "sparse")))
    order = F.when(F.col("dense_rank").isNotNull(), F.col("dense_rank")).otherwise(F.lit(1_000_000_000) + F.col("sparse_rank"))
    return d.join(s, ["qid", "id"], "full_outer").select("*", F.round(part[0] + part[1], 12).alias("fused"), labels.alias("retrieved_by"), order.cast("long").alias("ord"))


def rerank_score(query_tokens: Column | str, doc_tokens: Column | str, base: Column | str) -> Column:
    """Coverage, density and closeness (in the query) of the query's terms in a chunk, and a little of the score before."""
    q, d, base = (F.col(c) if isinstance(c, str) else c for c in (query_tokens, doc_tokens, base))
    common = F.array_intersect(F.array_distinct(q), d)
    n = F.size(common).cast("double")
    # the last occurrence of each common term in the query
    last = F.transform(common, lambda t: F.size(q) - F.array_position(F.reverse(q), t))
    span = F.when(n > 0, F.array_max(last) - F.array_min(last) + 1).otherwise(1)
    coverage, density, closeness = n / F.size(F.array_distinct(q)), F.least(F.lit(1.0), 12 * n / F.size(d)), F.least(F.lit(1.0), 2 * n / span)
    full = 0.55 * coverage + 0.15 * density + 0.20 * closeness + 0.10 * base
    return F.when(F.size(q) == 0, base).when(F.size(d) == 0, 0.5 * base).otherwise(F.round(full, DIGITS))


def ranked(hits: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best hits of each query by score, ties in the order ``ord``."""
    return hits.selectExpr("*", f"cast(row_number() over (partition by qid order by {score} desc, ord) as bigint) as position").where(F.col("position") <= k)


def score_floor(hits: DataFrame, ratio: float = FLOOR, score: str = "score") -> DataFrame:
    """Hits that reach ``ratio`` of their query's best score; all of them where that isn't positive."""
    return hits.selectExpr("*", f"max({score}) over (partition by qid) as best").where(f"best <= 0 or {score} >= {ratio} * best").drop("best")


def mmr_order(scores: list[float], tokens: list[set], lambda_: float, k: int) -> list[int]:
    """Indexes in the order of choice; the greatest similarity to those chosen is kept for each that is left."""
    left = list(range(len(scores)))
    near = [0.0] * len(scores)
    order: list[int] = []
    while left and len(order) < k:
        best = max(left, key=lambda i: (round(lambda_ * scores[i] - (1 - lambda_) * near[i], DIGITS), -i))
        left.remove(best)
        order.append(best)
        for i in left:
            common = len(tokens[i] & tokens[best])
            if common:
                near[i] = max(near[i], common / (len(tokens[i]) + len(tokens[best]) - common))
    return order


def mmr(hits: DataFrame, lambda_: float = LAMBDA, k: int | None = None, score: str = "score", keep: tuple[str, ...] = ()) -> DataFrame:
    """Maximal marginal relevance: (qid, id, mmr_rank, *keep).

    hits(qid, id, position, tokens, score) must be cut to a top-k before. The first is the best; each next one maximises
    lambda * score - (1 - lambda) * its greatest Jaccard similarity to those chosen, the first in ``position`` winning
    ties; the similarity to an empty set is 0. The choice is sequential, so each query's short list goes through one Arrow
    call together with those of many other queries (as a fold of JVM functions it took ten times as long). Columns in
    ``keep`` stay in the JVM beside it.
    """
    @F.arrow_udf("array<int>")
    def order(scores: pa.Array, tokens: pa.Array) -> pa.Array:
        rows = zip(scores.to_pylist(), tokens.to_pylist())
        return pa.array([mmr_order(s, [set(x) for x in t], lambda_, len(s) if k is None else k) for s, t in rows], type=pa.list_(pa.int32()))

    hit = F.struct(F.col("position").alias("p"), F.col("id").alias("id"), F.col(score).cast("double").alias("s"), F.transform("tokens", lambda x: F.xxhash64(x)).alias("t"), *(F.col(c).alias(c) for c in keep if c != "id"))
    lists = hits.groupBy("qid").agg(F.sort_array(F.collect_list(hit)).alias("h")).withColumn("order", order(F.col("h.s"), F.col("h.t")))
    chosen = lists.select("qid", "h", F.posexplode("order").alias("i", "at")).select("qid", "i", F.get("h", F.col("at")).alias("x"))
    return chosen.select("qid", F.col("x.id").alias("id"), (F.col("i") + 1).cast("long").alias("mmr_rank"), *(F.col(f"x.{c}").alias(c) for c in keep if c != "id"))
