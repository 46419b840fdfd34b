"""Micro-batch ingest: files that arrive in a folder are structured and stored, each batch in one commit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.structure import chunks, is_noise
from ..store import Store


def start(spark: SparkSession, folder: str, store: Store, checkpoint: str, max_files: int = 1000) -> StreamingQuery:
    """Text files of ``folder``, all that are there and then no more (``availableNow``). A batch that is run again replaces its documents by name."""
    files = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", max_files).load(folder).select(F.col("_metadata.file_path").alias("document_key"), F.col("value").alias("text"))

    def save(batch: DataFrame, _: int) -> None:
        lines = batch.select("document_key", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("page", F.lit(1)).where(~is_noise(F.col("line"), markdown=True))
        named = batch.select("document_key", F.element_at(F.split("document_key", "/"), -1).alias("filename"), F.array().cast("array<string>").alias("tags"))
        store.save(named, chunks(lines, batch.select("document_key")))

    return files.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
