"""Exact-copy classes: found once, left out of the expensive stages, and put back at the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Members of a class that one block holds: the pairs of a larger class are made block against block, spread over tasks.
BLOCK = 1000


def classes(rows: DataFrame, id_col: str, digest_col: str) -> DataFrame:
    """(digest, rep, copies): the least id and the size of every class of equal digests. Counts before it shuffles."""
    return rows.groupBy(digest_col).agg(F.min(id_col).alias("rep"), F.count("*").alias("copies"))


def members(rows: DataFrame, classes_: DataFrame, id_col: str, digest_col: str) -> DataFrame:
    """(member, rep, copies) of the classes of two and more."""
    several = classes_.where("copies > 1")
    return rows.select(F.col(id_col).alias("member"), digest_col).join(several, digest_col).select("member", "rep", "copies")


def all_pairs(rep_pairs: DataFrame, members_: DataFrame, a: str, b: str, expand: int | None = None) -> DataFrame:
    """Pairs of ids from pairs of representatives: crossed with the members of both classes, plus the pairs inside classes.

    All of them are written whatever the size of a class, so the rows grow with its square. Only where a caller names
    ``expand``, classes above it are written short: just the representative stands in pairs with other classes, and the
    inner pairs are those with the representative.
    """
    blocks = F.ceil(F.col("copies") / BLOCK).cast("int")
    whole = members_ if expand is None else members_.where(F.col("copies") <= expand)
    blocked = whole.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int"))
    large = blocked.where((F.col("copies") > BLOCK) & (F.col("member") == F.col("rep")))

    def widened(df: DataFrame, c: str) -> DataFrame:
        m = blocked.select(F.col("rep").alias(c), F.col("own").alias("block"), F.col("member").alias(f"{c}_member"))
        spread = df.join(large.select(F.col("rep").alias(c), "blocks"), c, "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
        return spread.join(m, [c, "block"], "left").withColumn(c, F.coalesce(f"{c}_member", c)).drop("blocks", "block", f"{c}_member")

    crossed = widened(widened(rep_pairs.select(a, b), a), b)
    spread = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("rep", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "member")
    met = (F.col("x.rep") == F.col("y.rep")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
    once = (F.col("x.i") == F.col("x.j")) | (F.col("x.own") != F.col("y.own"))
    inner = spread.alias("x").join(spread.alias("y"), met & once & (F.col("x.member") < F.col("y.member")))
    pairs = crossed.unionByName(inner.select(F.col("x.member").alias(a), F.col("y.member").alias(b)))
    if expand is not None:
        star = members_.where((F.col("copies") > expand) & (F.col("member") != F.col("rep")))
        pairs = pairs.unionByName(star.select(F.col("rep").alias(a), F.col("member").alias(b)))

    def ordered(f) -> Column:
        return f(a, b)

    return pairs.select(ordered(F.least).alias(a), ordered(F.greatest).alias(b)).distinct()
