"""Reading tables, spreading CPU-heavy work and cutting lineage.

``staged`` writes an intermediate result to the shared folder named by
``spark.checkpoint.dir`` and reads it back.  The written table survives the loss
of any executor, is columnar (later readers prune columns) and is computed once
however many branches read it.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_RUN = f"quire-{uuid.uuid4().hex}"
_written: list[tuple[SparkSession, str]] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Repartition a scan that has too few splits to keep the cores busy.

    A table of one small file is a single split; a CPU-bound stage on it would run
    on one core.  Scans with enough splits (every large table) are left alone, so
    nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it; a temporary one only in local mode."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), f"{_RUN}-shared")


def release(spark: SparkSession) -> int:
    """Delete the tables staged so far in this session, once their results are written; returns how many.

    A long session calls this between jobs; what is left goes at exit.
    """
    mine = [x for x in _written if x[0] is spark]
    for item in mine:
        _delete(*item)
        _written.remove(item)
    return len(mine)


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


def staged(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{_RUN}/{label}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session is gone; the folder's owner clears it
            return


def bounded_sample(df: DataFrame, rows: int, *by: str, among: int | None = None) -> DataFrame:
    """At most ``rows`` rows: those whose hash of the columns ``by`` is least.

    The hash's range is cut to the share that is expected to hold them before anything is ordered, so what
    meets in one place is about ``rows``, whatever the size of ``df`` (``among``: its number of rows, if known).
    """
    total = df.count() if among is None else among
    share = min(1.0, 1.3 * rows / max(1, total) + 1e-9)
    h = F.xxhash64(*by)
    limit = int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1
    return df.withColumn("_h", h).filter(F.col("_h") <= F.lit(limit)).orderBy("_h", *by).limit(rows).drop("_h")
