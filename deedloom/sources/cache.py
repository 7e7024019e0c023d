"""Content-addressed caches kept as parquet: hits by semi join, misses by anti join, corrupt entries as misses."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def document_key(suffix: Column, content: Column, version: str = "v1") -> Column:
    """sha256 over version, lower-case suffix and bytes. Every part is cast to binary: mixed parts would become text."""
    parts = [F.lit(version).cast("binary"), F.lower(suffix).cast("binary"), content.cast("binary")]
    return F.sha2(F.concat(*parts), 256)


def semantic_key(doc: Column, chunk: Column, model: Column, version: Column) -> Column:
    """sha256 over document key, chunk, model and extraction version."""
    return F.sha2(
        F.concat(doc, F.lit(":chunk:"), chunk.cast("string"), F.lit(":model:"), model, F.lit(":extraction_version:"), version),
        256,
    )


def hits(wanted: DataFrame, cached: DataFrame, *key: str) -> DataFrame:
    """The wanted rows that the cache has; null keys never hit."""
    return wanted.join(cached.select(*key), list(key), "left_semi")


def misses(wanted: DataFrame, cached: DataFrame, *key: str) -> DataFrame:
    """The wanted rows that the cache lacks."""
    return wanted.join(cached.select(*key), list(key), "left_anti")


class ParquetCache:
    """A keyed table below one path, to which rows are only ever added. Entries carry a version and the time they were
    computed; those of other versions or with null keys count as missing, and of a key's entries the latest count.

    Nothing is overwritten: a refresh adds newer entries, so a job that dies or runs twice loses nothing. A file that
    can't be read (or lacks the columns) is passed over, its entries are missing and computed again.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: tuple[str, ...], version: str):
        self.spark, self.path, self.schema, self.key, self.version = spark, path, schema, key, version

    def read(self) -> DataFrame:
        """The latest entries of this version; a cache that isn't there yet is empty."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], self.schema)
        kept = T.StructType([f for f in self.schema if f.name != "cache_version"])
        schema = T.StructType([*kept, T.StructField("cache_version", T.StringType()), T.StructField("cached_at", T.LongType())])
        stored = self.spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(self.path)
        whole = " and ".join(f"{k} is not null" for k in self.key)
        entries = stored.where(F.col("cache_version") == self.version).where(whole)
        latest = entries.groupBy(*self.key).agg(F.max(F.coalesce("cached_at", F.lit(0))).alias("_latest"))
        entries = entries.join(latest, list(self.key)).where(F.coalesce("cached_at", F.lit(0)) == F.col("_latest"))
        return entries.select(*self.schema.names)

    def add(self, fresh: DataFrame) -> None:
        """Store entries as the latest of their keys."""
        columns = [n for n in self.schema.names if n != "cache_version"]
        made = fresh.select(*columns).withColumns({"cache_version": F.lit(self.version), "cached_at": F.lit(time.time_ns())})
        made.write.mode("append").parquet(self.path)

    def missing(self, wanted: DataFrame, force_refresh: bool = False) -> DataFrame:
        """The wanted rows that have to be computed, each key once: those without an entry, all with ``force_refresh``.
        Rows with a null key can't be stored and are left out."""
        whole = wanted.where(" and ".join(f"{k} is not null" for k in self.key)).dropDuplicates(list(self.key))
        return whole if force_refresh else misses(whole, self.read(), *self.key)

    def get_or_compute(self, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame], force_refresh: bool = False) -> DataFrame:
        """The entries of the wanted keys, cached ones and computed ones, which are added; with ``force_refresh`` those of
        the wanted keys are computed anew, while all others stay."""
        self.add(compute(self.missing(wanted, force_refresh)))
        return hits(self.read(), wanted, *self.key)


def parse_entries(payload: Column, schema: str) -> Column:
    """A cached JSON payload as a struct; null for anything that isn't valid under the schema."""
    parsed = F.from_json(payload, f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE"})
    return F.when(parsed["_corrupt_record"].isNull(), parsed)
