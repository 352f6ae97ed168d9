"""New files of a landing folder, each processed once.

The windows of the pipeline are windows within a document, not of time, so they run inside
``foreachBatch``; the file source's checkpoint and the hash of the content keep a file from being
processed twice, also under another name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.functions.constants import FORMATS
from quire.pipeline import Engine, Result
from quire.plans import staged
from quire.sources import extract_files, extracted

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def stream_files(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of (path, name, extension, size, sha256, content) of known files."""
    rows = spark.readStream.format("binaryFile").schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).load(path)
    extension = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    rows = rows.filter(extension.isin(*FORMATS))
    return rows.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), extension.alias("extension"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), "content")


def process_new_files(engine: Engine, path: str, done: str, checkpoint: str, sink: Callable[[Result, int], None]) -> StreamingQuery:
    """Run the engine on files that came since the last run, then end.

    ``done`` is a Parquet table of the hashes processed; a batch that is run again after a failure finds
    its own hashes missing, as they are written last, and repeats its work.
    """
    spark = engine.spark

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.dropDuplicates(["sha256"])
        try:
            rows = rows.join(spark.read.parquet(done).select("sha256"), "sha256", "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        files = staged(extract_files(rows), "batch")
        good, bad = extracted(files)
        good = good.withColumn("doc_id", F.xxhash64("path")).withColumn("is_scanned", F.lit(False))
        if engine.rasterizer and engine.ocr:
            pages, bad = engine.scanned(rows, bad)
            good = good.unionByName(pages, allowMissingColumns=True)
        result = engine.html(good.withColumn("doc_id", F.xxhash64("sha256")))
        result.errors = bad.select("path", "error_code", "error_message")
        sink(result, number)
        files.select("sha256").write.mode("append").parquet(done)

    return stream_files(spark, path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
