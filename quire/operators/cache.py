"""Results kept by the hash of their content and of the options that made them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(options: dict) -> str:
    """A short text that changes with the options."""
    return json.dumps(options, sort_keys=True, default=str)


def key_of(content: Column, options: dict | None = None) -> Column:
    """The cache key: the content's SHA-256, joined to the options' where there are any."""
    plain = F.sha2(content, 256)
    return plain if not options else F.sha2(F.concat(plain, F.lit(fingerprint(options))), 256)


def misses(rows: DataFrame, cached: DataFrame, key: str = "cache_key") -> DataFrame:
    """Rows that the cache does not have, one for each key."""
    return rows.join(cached.select(key).distinct(), key, "left_anti").dropDuplicates([key])


def hits(rows: DataFrame, cached: DataFrame, key: str = "cache_key") -> DataFrame:
    """Rows with what the cache has of them; of repeated keys in the cache one is taken."""
    return rows.join(cached.dropDuplicates([key]), key)


class Cache:
    """A Parquet table below a folder, partitioned by the first two characters of the key."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.path).drop("prefix")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise

    def add(self, rows: DataFrame, key: str = "cache_key") -> None:
        rows.withColumn("prefix", F.substring(key, 1, 2)).write.mode("append").partitionBy("prefix").parquet(self.path)
