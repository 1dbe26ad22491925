"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a
    temporary one set here where none is set and Spark is a single machine's, as in tests."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("a cluster needs spark.checkpoint.dir, a folder that all its machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sluice-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Texts that a Python worker and the JVM hold at once where `written` is told so.
TEXTS = 500
#: Rows that a Python function works on at once, whatever the size of Spark's batches.
PART = 1024


def slices(batches: Iterator[pa.RecordBatch], rows: int = PART) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `rows` rows, so that decoded texts, work space and output stay small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def written(df: DataFrame, what: str, batch: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here, and a lost
    executor costs no more than a reread. Python functions get at most `batch` rows at once while it is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sluice-{what}-{uuid.uuid4().hex}"
    usual = spark.conf.get(BATCH)
    if batch is not None:
        spark.conf.set(BATCH, str(batch if int(usual) <= 0 else min(batch, int(usual))))
    try:
        df.write.parquet(path)
    finally:
        if batch is not None:
            spark.conf.set(BATCH, usual)
    return spark.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of finished steps, which it does
    when the driver's JVM collects its garbage; the last plan that ran is still held,
    so a small one runs first."""
    gc.collect()
    spark.range(1).collect()
    for _ in range(2):
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, modulus: int):
    """crc32 of an id's text, modulo: the rule that holds rows out."""
    return F.crc32(F.col(column).cast("string")) % modulus
