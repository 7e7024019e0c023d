"""Incremental ingestion: new chunk files are processed once, against the cache, in micro-batches (an extension)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from deedloom.sources.cache import ParquetCache


def ingest(
    spark: SparkSession, source: str, schema: str, cache: ParquetCache, compute: Callable[[DataFrame], DataFrame], checkpoint: str
) -> StreamingQuery:
    """Read parquet files as they arrive and compute what the cache lacks; a replayed batch finds its rows cached."""

    def batch(df: DataFrame, _: int) -> None:
        cache.get_or_compute(df.dropDuplicates(list(cache.key)), compute)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
