"""Incremental ingestion: new documents in a folder are chunked and appended as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from heronry.functions.scalars import document_uri
from heronry.operators.chunking import chunk_text

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def stream_chunks(spark: SparkSession, path: str, per_trigger: int = 64) -> DataFrame:
    """A streaming DataFrame of chunks of the Parquet files that appear under ``path``."""
    docs = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", per_trigger).parquet(path)
    uri = document_uri(F.col("source"), F.col("doc_id"))
    return chunk_text(docs.select("doc_id", uri.alias("uri"), "text"))


def ingest(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append the chunks of all new files to ``out``, each exactly once, then stop."""
    writer = stream_chunks(spark, path).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start()
