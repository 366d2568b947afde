"""Incremental ingest of arriving documents into a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.operators import chunking, models
from brindle.sources.store import Store


def prepared(docs: DataFrame, size: int) -> DataFrame:
    """Chunks with vectors: (doc_id, chunk_key, content, vector); blank chunks are left out."""
    from pyspark.sql import functions as F

    cut = chunking.fixed(docs, "doc_id", "text", size).where(F.rlike("content", F.lit("\\S")))
    keyed = cut.select("doc_id", F.concat_ws("-", F.col("doc_id").cast("string"), F.col("chunk_id").cast("string")).alias("chunk_key"), "content")
    return models.embed(keyed, ["doc_id", "chunk_key", "content"], "content")


def ingest(store: Store, docs: DataFrame, size: int) -> int:
    """Inserts the chunks of documents that the store lacks, as one more folder of it. Doing it again changes nothing: a document's chunks are there all or none.

    Of a store keyed by doc_id only the partitions are read that the documents fall in. Many small folders are made one now and then.
    """
    version = store.insert(docs, "doc_id", "text", lambda new: prepared(new, size))
    return max(version, store.compact())


def stream_ingest(spark: SparkSession, store: Store, source: str, schema, checkpoint: str, size: int = 512) -> None:
    """Takes what lies in a folder of Parquet files and was not taken yet, then ends.

    A micro-batch that is replayed after a failure inserts nothing twice, since the store only takes keys it lacks.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(source)
    run = stream.writeStream.foreachBatch(lambda docs, _: ingest(store, docs, size)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
