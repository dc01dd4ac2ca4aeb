"""Chunking of documents as they arrive: a document is self-contained, so the stream keeps no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestack.functions import text as fn
from lodestack.operators.chunking import pack_sentences


def chunk_stream(spark: SparkSession, folder: str, schema: str = "doc_id long, text string", size: int = 200) -> DataFrame:
    """Fixed-size chunks of the documents in Parquet files that land in a folder."""
    docs = spark.readStream.schema(schema).parquet(folder)
    chunks = docs.select("doc_id", F.posexplode(pack_sentences(fn.sentences_en(F.col("text")), size)).alias("ordinal", "text"))
    return chunks.select("doc_id", "ordinal", fn.chunk_id(F.col("doc_id"), F.col("ordinal")).alias("chunk_id"), fn.strip(F.col("text")).alias("text"))


def write_chunks(chunks: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch of files to a Parquet table, exactly once."""
    return chunks.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
