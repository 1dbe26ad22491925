"""Structured Streaming forms of the ingestion: a dedupe ledger, latest state of items,
windowed activity with watermarks, and micro-batches that a retried batch can't double."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from sluice.config import TRANSITIONS
from sluice.sources.mailbox import Mailbox


def files(spark: SparkSession, path: str, schema: str, per_batch: int = 100) -> DataFrame:
    """Landed JSON files as a stream; the checkpoint is the cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).json(path)


def mail(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Each message of a landed mailbox once: its history since the cursor, or its listing where
    the cursor has expired (sources.mailbox), through the ledger of message ids."""
    spark.dataSource.register(Mailbox)
    reader = spark.readStream.format("mailbox")
    return deduplicated((reader.option("since", since) if since else reader).load(path))


def deduplicated(messages: DataFrame, key: str = "message_id", time: str | None = None, delay: str = "30 days") -> DataFrame:
    """Each message once: over all time, or within a watermark where time is given, which
    bounds the state."""
    if time is None:
        return messages.dropDuplicates([key])
    return messages.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def changed(observations: DataFrame) -> DataFrame:
    """Observations whose content an item has not had before."""
    return observations.dropDuplicates(["item_key", "content"])


def activity(messages: DataFrame, time: str = "occurred_at", window: str = "7 days", delay: str = "14 days") -> DataFrame:
    """Messages per week from Monday; late ones count until the watermark passes."""
    weeks = F.window(time, window, startTime="4 days")  # the epoch was a Thursday
    return messages.withWatermark(time, delay).groupBy(weeks.alias("w")).agg(F.count("*").alias("messages")).select(F.col("w.start").cast("date").alias("week"), "messages")


def statuses(signals: DataFrame) -> DataFrame:
    """(application_id, status, changes): the status machine over a stream of (application_id,
    seq, signal), in the order of arrival. State is one status and a counter per record."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, changes = state.get if state.exists else ("Applied", 0)
        for frame in frames:
            for signal in frame.sort_values("seq")["signal"]:
                if signal in TRANSITIONS.get(status, []):
                    status, changes = signal, changes + 1
        state.update((status, changes))
        yield pd.DataFrame({"application_id": [key[0]], "status": [status], "changes": [changes]})

    return signals.groupBy("application_id").applyInPandasWithState(run, "application_id long, status string, changes long", "status string, changes long", "update", GroupStateTimeout.NoTimeout)


def into_versions(stream: DataFrame, root: str, checkpoint: str, step: Callable[[DataFrame, int], DataFrame] | None = None, every: str | None = None) -> StreamingQuery:
    """Writes each micro-batch to a directory named by its id, replacing what a failed
    attempt left: a batch that runs twice counts once. One query per checkpoint keeps
    batches from running beside each other. Without a period it takes what is there."""

    def write(batch: DataFrame, number: int) -> None:
        (step(batch, number) if step else batch).write.mode("overwrite").parquet(f"{root}/batch={number:010d}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


#: Where a batch that is complete is written down, under a root of tables.
COMPLETE = "_complete"


def last_complete(spark: SparkSession, root: str) -> int:
    """The last batch all of whose outputs are there, or -1."""
    try:
        done = spark.read.schema("number long").json(f"{root}/{COMPLETE}")
        return done.agg(F.coalesce(F.max("number"), F.lit(-1))).first()[0]
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return -1
        raise


def rows_of(spark: SparkSession, root: str, name: str, schema: StructType | str, until: int | None = None) -> DataFrame:
    """The rows of a table's complete batches, with the column `batch`. What a batch that failed
    has written isn't read, and what a later one writes isn't either."""
    last = last_complete(spark, root) if until is None else until
    known = [f"{root}/{name}/batch={n:010d}" for n in range(last + 1)]
    whole = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    if not known:
        return spark.createDataFrame([], StructType([*whole.fields]).add("batch", "long"))
    return spark.read.schema(whole).option("basePath", f"{root}/{name}").option("ignoreMissingFiles", True).parquet(*known).withColumn("batch", F.col("batch").cast("long"))


def current(base: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """A table as the complete batches left it: the last row of each key, or else the base's."""
    newest = changes.groupBy(key).agg(F.max_by(F.struct(*base.columns), "batch").alias("r")).select("r.*")
    return base.join(newest.select(key), key, "left_anti").unionByName(newest)


def into_tables(stream: DataFrame, root: str, checkpoint: str, step: Callable[[DataFrame, int], dict[str, DataFrame]]) -> StreamingQuery:
    """One step of several outputs: each micro-batch gives rows of several tables, each written to
    the batch's own directory in place of what a failed attempt left; when all are there the batch is
    written down as complete. Readers (`rows_of`) stop at the last complete batch, so they see all
    outputs of a batch or none, and a batch that runs again after a failure counts once."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        if number <= last_complete(spark, root):
            return  # all outputs are there: only the stream's own mark was lost
        for name, rows in step(batch, number).items():
            rows.write.mode("overwrite").parquet(f"{root}/{name}/batch={number:010d}")
        spark.range(1).select(F.lit(number).alias("number")).coalesce(1).write.mode("overwrite").json(f"{root}/{COMPLETE}/batch={number:010d}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
