"""New Markdown files as a stream: each batch's sentences become nodes, and replace those of their documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clauseloom.functions import text as tx
from clauseloom.operators.vectors import Embedder, sentence_nodes


def markdown_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.md").load(path).select(F.input_file_name().alias("clause_id"), F.col("value").alias("text"))


def ingest(stream: DataFrame, index_path: str, checkpoint: str, embed: Embedder | None = None) -> StreamingQuery:
    """Writes each batch under its number; a batch that is repeated after a failure overwrites itself."""
    def write(batch: DataFrame, number: int) -> None:
        docs = batch.select("clause_id", tx.joined(F.split("text", "\n")).alias("text"))
        sentence_nodes(docs, embed).write.mode("overwrite").parquet(f"{index_path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, index_path: str) -> DataFrame:
    """Nodes of each document's last batch."""
    nodes = spark.read.parquet(index_path)
    last = nodes.groupBy("clause_id").agg(F.max("batch").alias("batch"))
    return nodes.join(last, ["clause_id", "batch"], "left_semi")
