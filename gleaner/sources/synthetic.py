"""Documents made up from a seed, for benchmarks: the same table for the same arguments, on any number of machines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.ids import stable_id

WORDS = "index vector query shard replica token ledger cursor batch stream window schema planner filter cache lease quorum segment bucket journal router beacon anchor signal matrix kernel socket packet thread buffer".split()


def corpus(spark: SparkSession, n: int, seed: int = 7, words: list[str] | None = None) -> DataFrame:
    """(doc_id, text, source, metadata) of n documents of 8 to 20 sentences of 8 to 18 words, in paragraphs of four sentences."""
    some = F.array(*map(F.lit, words or WORDS))

    def number(least: int, most: int, *of: Column) -> Column:
        return (F.pmod(F.xxhash64(F.lit(seed), F.col("id"), *of), F.lit(most - least + 1)) + least).cast("int")

    def sentence(s: Column) -> Column:
        chosen = F.transform(F.sequence(F.lit(1), number(8, 18, s)), lambda w: F.get(some, number(0, len(words or WORDS) - 1, s, w)))
        return F.concat(F.initcap(F.get(chosen, F.lit(0))), F.lit(" "), F.array_join(F.slice(chosen, 2, 18), " "), F.lit("."))

    sentences = F.transform(F.sequence(F.lit(1), number(8, 20)), sentence)
    paragraphs = F.transform(F.sequence(F.lit(0), F.floor((F.size("s") - 1) / 4)), lambda p: F.array_join(F.slice("s", (p * 4 + 1).cast("int"), F.lit(4)), " "))
    rows = spark.range(n).withColumn("s", sentences).select("id", F.array_join(paragraphs, "\n\n").alias("text"), F.concat(F.lit("made/"), F.col("id"), F.lit(".md")).alias("source"))
    return rows.select(stable_id("source", "text").alias("doc_id"), "text", "source", F.create_map(F.lit("idx"), F.col("id").cast("string")).alias("metadata"))
