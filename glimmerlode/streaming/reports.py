"""Reports as a stream: each micro-batch is scored like a table, since ranked windows need a bounded input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def score_stream(spark: SparkSession, source: str, schema: str, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Start a query that scores new Parquet files of `source` and appends the results to `out`."""
    stream = spark.readStream.schema(schema).parquet(source)
    write = lambda batch, n: score(batch).write.mode("overwrite").parquet(f"{out}/batch={n}")  # noqa: E731  a repeated batch replaces itself
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
