"""Helpers shared by every operator: table access, parallelism and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Enough partitions for Python work on small inputs; large inputs keep the partitions of their scan.

    One small Parquet file is one partition, which would leave all cores but one idle. A scan of a large
    table already has more partitions than cores and isn't shuffled. Streams are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.isStreaming or df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


def small_batches(batches, most_bytes: int = 8_000_000):
    """The same Arrow batches in slices of about ``most_bytes``, so that very long texts don't pile up in a task."""
    for batch in batches:
        n = max(1, batch.num_rows * most_bytes // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or, in local mode only, a temporary one where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lectern-")
        atexit.register(shutil.rmtree, base, True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base


#: Has Spark remove the shuffle files of a query at its end, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_once(df: DataFrame, path: str) -> None:
    """Write ``df`` below ``path``. The shuffle files of the write go with it, since nothing reads them again."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lectern-{uuid.uuid4().hex}"
    write_once(df, path)
    return spark.read.schema(df.schema).parquet(path)


def once_per_key(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row per ``key`` of a table that stores some rows twice with the same content."""
    return df.groupBy(key).agg(*(F.first(c).alias(c) for c in columns))
