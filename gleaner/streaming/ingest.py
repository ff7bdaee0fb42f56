"""Incremental ingestion: new document files are chunked, batch by batch; an edited document takes the place of its older text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.chunking import ChunkSettings, chunk_documents


def ingest_available(spark: SparkSession, source: str, schema: str, index: str, checkpoint: str, settings: ChunkSettings | None = None) -> None:
    """Reads the Parquet files that came to ``source`` since the last call and appends their chunks to ``index``.

    Each batch is written to a folder of its own number: its chunks, and in a second table the documents it brought, also
    those that have no chunks any more. So a batch that is repeated after a failure replaces itself and changes nothing
    else, and no older batch is rewritten. ``indexed`` reads of every document the chunks of the last batch that brought it.
    A document that comes twice in one batch counts with the greatest of its texts.
    """

    def put(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c not in ("doc_id", "text")]
        one = batch.groupBy("doc_id").agg(F.max_by(F.struct("text", *rest), F.coalesce("text", F.lit(""))).alias("r")).select("doc_id", "r.*")
        one.select("doc_id").write.mode("overwrite").parquet(f"{index}/brought/batch={number}")
        chunk_documents(one, settings).dropDuplicates(["chunk_id"]).write.mode("overwrite").parquet(f"{index}/chunks/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def indexed(spark: SparkSession, index: str) -> DataFrame:
    """The chunks of every document's last batch."""
    number = lambda name: spark.read.parquet(f"{index}/{name}").withColumn("batch", F.col("batch").cast("long"))
    last = number("brought").groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return number("chunks").join(last, ["doc_id", "batch"], "left_semi")
