"""Incremental chunking of a growing folder of documents. An extension; the batch operators are the same."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from lectern.operators.chunking import chunk_documents


def chunk_stream(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str = "doc_id bigint, text string") -> StreamingQuery:
    """Chunk the Parquet files that arrived in ``source`` since the last run into ``target``; ends when all are done.

    Chunking needs no state, so every micro-batch is exact and a restart goes on from the checkpoint."""
    arrived = spark.readStream.schema(schema).parquet(source)
    chunks = chunk_documents(arrived)
    return chunks.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
