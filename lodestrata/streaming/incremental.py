"""Chunks and vectors from a stream of texts: Parquet in, Parquet out, each input file once.

The chunker and the hashing embedder keep no state between rows, so a stream runs
them as they are; the checkpoint of the stream makes a rerun pick up only what is
new. This goes beyond indexing a directory, which is a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, embedding


def embedded_stream(spark: SparkSession, source: str, schema: str, text_col: str, id_col: str, dimensions: int = embedding.DIMENSIONS, max_files: int = 100) -> DataFrame:
    """The chunks of *source*'s texts with their vectors, as a streaming DataFrame."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    chunks = chunking.chunk_plain_text(rows, text_col, F.col(id_col).cast("string"), [id_col])
    return embedding.hashing_vectors(chunks, F.col("text"), dimensions)


def run_available(stream: DataFrame, sink: str, checkpoint: str) -> None:
    """Process what is there now, and end."""
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
