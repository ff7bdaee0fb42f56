"""Ranking quality: per-query and mean recall, precision, reciprocal rank, nDCG and hit rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.sparse import DIGITS


def is_relevant(source: Column | str, labels: Column | str) -> Column:
    """Whether the lower-cased source holds one of the lower-cased labels; empty ones hold nothing."""
    low = F.lower(F.coalesce(source, F.lit("")))
    return F.coalesce(F.exists(labels, lambda x: x.isNotNull() & (x != "") & F.contains(low, F.lower(x))), F.lit(False))


def flagged(hits: DataFrame, cases: DataFrame) -> DataFrame:
    """(qid, rank, relevant) of hits(qid, rank, source) by cases(qid, relevant)."""
    return hits.join(cases.select("qid", F.col("relevant").alias("labels")), "qid").select("qid", "rank", is_relevant("source", "labels").alias("relevant"))


def per_query(flags: DataFrame, cases: DataFrame, k: int) -> DataFrame:
    """One row per case: recall, precision, reciprocal rank, nDCG at k and hit.

    Recall's denominator is the relevant hits that were returned; the ideal order of nDCG sorts the returned flags.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    rel = F.col("relevant").cast("double")
    gain = rel / F.log2(F.col("rank") + 1)
    within = F.col("rank") <= k
    agg = flags.groupBy("qid").agg(
        F.sum(rel).alias("found"), F.sum(F.when(within, rel).otherwise(0.0)).alias("top"), F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"), F.sum(F.when(within, gain).otherwise(0.0)).alias("dcg")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.greatest(F.lit(1), F.col("found").cast("int")))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1))
    r = cases.select("qid").join(agg, "qid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return r.select(
        "qid",
        F.round(zero(F.try_divide("top", "found")), DIGITS).alias("recall"),
        F.round(zero(F.col("top")) / k, DIGITS).alias("precision"),
        F.round(zero(F.lit(1.0) / F.col("first")), DIGITS).alias("reciprocal_rank"),
        F.round(F.when(zero(F.col("found")) > 0, F.col("dcg") / ideal).otherwise(0.0), DIGITS).alias("ndcg"),
        (zero(F.col("found")) > 0).alias("hit"),
    )


def summary(per_query_: DataFrame) -> DataFrame:
    """Means over all cases; zeros where there are none."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), DIGITS)
    return per_query_.agg(
        F.count("*").alias("cases"), mean("recall").alias("recall"), mean("precision").alias("precision"), mean("reciprocal_rank").alias("mrr"), mean("ndcg").alias("ndcg"), mean(F.col("hit").cast("double")).alias("hit_rate")
    )


#: Value ranges that a group is cut into, so that a large group is ranked in many tasks.
RANGES = 64


def nearest_rank(df: DataFrame, group: str, value: str, percents: list[int]) -> DataFrame:
    """Percentiles by rank: the value at position round(p / 100 * (n - 1)), halves to the even number, per group.

    Equal values are counted before they are shuffled. The values of a group are cut into ranges at its approximate quantiles
    and ranked range by range, after the counts of the ranges before; the result is exact whatever the quantiles are.
    """
    rows = df.select(F.col(group).alias("_of"), F.col(value).alias("v")).where("v is not null")
    edges = F.percentile_approx("v", [i / RANGES for i in range(1, RANGES)], 1000)
    whole = rows.groupBy("_of").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.max("v").alias("most"), edges.alias("edges"))
    counts = rows.groupBy("_of", "v").agg(F.count("*").alias("c"))
    placed = counts.alias("a").join(whole.select("_of", "edges").alias("b"), F.col("a._of").eqNullSafe(F.col("b._of"))).select("a._of", "v", "c", F.size(F.filter("edges", lambda e: e < F.col("v"))).alias("at"))
    ranges = placed.groupBy("_of", "at").agg(F.sum("c").alias("m")).selectExpr("_of", "at", "sum(m) over (partition by _of order by at) - m as before")
    joined = placed.alias("a").join(ranges.alias("b"), F.col("a._of").eqNullSafe(F.col("b._of")) & (F.col("a.at") == F.col("b.at"))).select("a._of", "a.at", "v", "c", "before")
    ends = joined.selectExpr("_of", "v", "c", "before + sum(c) over (partition by _of, at order by v) as upto")
    full = ends.alias("a").join(whole.select("_of", "n").alias("b"), F.col("a._of").eqNullSafe(F.col("b._of"))).select("a._of", "v", "c", "upto", "n")
    within = lambda p: (F.expr(f"cast(bround({p} / 100 * (n - 1), 0) as bigint)") >= F.col("upto") - F.col("c")) & (F.expr(f"cast(bround({p} / 100 * (n - 1), 0) as bigint)") < F.col("upto"))
    picked = full.groupBy("_of").agg(*(F.max(F.when(within(p), F.col("v"))).alias(f"p{p}") for p in percents))
    out = whole.alias("a").join(picked.alias("b"), F.col("a._of").eqNullSafe(F.col("b._of")))
    return out.select(F.col("a._of").alias(group), "n", "mean", *(f"p{p}" for p in percents), "most")


def label_recall(hits: DataFrame, cases: DataFrame) -> DataFrame:
    """(qid, label_recall): the share of a case's labels that some hit matched; hits(qid, source), cases(qid, relevant)."""
    labels = cases.select("qid", F.explode(F.array_distinct("relevant")).alias("label")).where("label is not null and label <> ''")
    found = labels.join(hits.select("qid", F.lower(F.coalesce("source", F.lit(""))).alias("source")).distinct(), "qid").where(F.contains("source", F.lower("label"))).select("qid", "label").distinct()
    counts = labels.groupBy("qid").agg(F.count("*").alias("labels")).join(found.groupBy("qid").agg(F.count("*").alias("found")), "qid", "left")
    return cases.select("qid").join(counts, "qid", "left").select("qid", F.round(F.coalesce(F.col("found") / F.col("labels"), F.lit(0.0)), DIGITS).alias("label_recall"))
