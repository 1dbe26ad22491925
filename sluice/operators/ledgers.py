"""Idempotent writes as functions from tables to tables: first or last writer wins,
counters from events, decisions folded from a log, and the status state machine.

Files have no row-level updates, so each gives the new state of a table; `swap` puts it
in place of the old one by a version directory and a pointer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.config import STATUSES, TRANSITIONS
from sluice.operators.components import checkpoint_dir

#: Signals that a task folds at once.
RANGE = 1024


def _row(keys: list[str], *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def insert_if_absent(stored: DataFrame, new: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """stored and the first new row of each key that it lacks."""
    first = new.withColumn("_n", _row(keys, *order)).filter("_n = 1").drop("_n")
    return stored.unionByName(first.join(stored.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], *order: Column, keep: list[str] | None = None) -> DataFrame:
    """The last new row of each key replaces the stored one, but for the columns to keep."""
    last = new.withColumn("_n", _row(keys, *order)).filter("_n = 1").drop("_n")
    if keep:
        old = stored.select(*keys, *[F.col(c).alias(f"_{c}") for c in keep])
        last = last.join(old, keys, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in keep}).select(stored.columns)
    return stored.join(last.select(*keys), keys, "left_anti").unionByName(last)


def processed(messages: DataFrame) -> DataFrame:
    """Ledger of messages: the last result of each."""
    order = F.struct("processed_at", "result")
    return messages.groupBy("message_id").agg(F.max_by("result", order).alias("result"), F.count("*").alias("times"))


def counters(events: DataFrame) -> DataFrame:
    """Counters of each run, from what happened instead of kept numbers."""
    d = F.col("decision")
    return events.groupBy("run_id").agg(F.count("*").alias("seen"), *[F.count_if(d == k).alias(k) for k in ("linked", "created", "needs_review", "unchanged")])


def finished(reports: DataFrame) -> DataFrame:
    """Per run its final status; different ones are a conflict."""
    return reports.groupBy("run_id").agg(F.min("status").alias("status"), (F.count_distinct("status") > 1).alias("conflict"), F.count("*").alias("reports"))


def decisions(log: DataFrame) -> DataFrame:
    """Current decision of each evidence: people's before the resolver's, then the latest."""
    order = (F.when(F.col("decided_by") == "human", 0).otherwise(1), F.desc("decided_at"), F.desc("seq"))
    return log.withColumn("_n", _row(["evidence_id"], *order)).filter("_n = 1").drop("_n")


def cascade_delete(parents: DataFrame, children: dict[str, DataFrame], gone: DataFrame, key: str = "application_id") -> tuple[DataFrame, dict[str, DataFrame]]:
    """Removes records with their children; records that are part of a merge stay."""
    target = parents.filter("merged_into IS NOT NULL").select(F.col("merged_into").alias("id")).distinct()
    free = gone.join(parents.filter("record_state = 'active'").select("id"), "id", "left_semi").join(target, "id", "left_anti")
    return parents.join(free, "id", "left_anti"), {n: c.join(free.select(F.col("id").alias(key)), key, "left_anti") for n, c in children.items()}


def _next_status() -> Column:
    """The status after a signal, by numbers: of each signal, of each status before it."""
    after = [[STATUSES.index(to) if to in TRANSITIONS[status] else k for k, status in enumerate(STATUSES)] for to in STATUSES]
    return F.array(*[F.array(*map(F.lit, row)) for row in after])


def _entered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The status in which each range of a record's signals begins: its maps taken in order."""
    last, status = object(), 0
    for frame in frames:
        out = []
        for key, moves in zip(frame["application_id"].tolist(), frame["moves"]):
            key = None if key != key else key
            if key != last:
                last, status = key, 0
            out.append(status)
            status = int(moves[status])
        yield frame[["application_id", "range"]].assign(status=out)


def fold_status(signals: DataFrame, size: int = RANGE) -> DataFrame:
    """(application_id, seq, from_status, to_status): the changes that a record's signals
    make in the order of their arrival, from Applied on; what would go back is ignored.

    Signals are sorted over the whole table and cut into ranges of a record, at most `size`
    signals each, so that no task holds a record. A record of several ranges has, for each of them, a map
    from every status before it to the status after it; the maps, taken in order, say in which
    status each range begins, and every range gives its own changes then."""
    checkpoint_dir(signals.sparkSession)
    number = F.create_map(*[x for k, name in enumerate(STATUSES) for x in (F.lit(name), F.lit(k))])
    known = signals.select("application_id", F.col("seq").cast("long").alias("seq"), "signal", number[F.col("signal")].alias("to")).filter("to IS NOT NULL")
    order = ["application_id", "seq", "signal"]
    placed = known.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.floor(F.monotonically_increasing_id() / size))
    ranges = placed.groupBy("application_id", "range").agg(F.sort_array(F.collect_list(F.struct("seq", "signal", "to"))).alias("s")).checkpoint()
    same = lambda a, b, *cs: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cs]
    several = ranges.groupBy("application_id").agg(F.count("*").alias("n")).filter("n > 1")
    moves = F.aggregate("s", F.sequence(F.lit(0), F.lit(len(STATUSES) - 1)), lambda m, x: F.transform(m, lambda status: F.get(F.get(F.col("after"), x["to"]), status)))
    maps = ranges.alias("r").join(several.alias("m"), same("r", "m", "application_id"), "left_semi").withColumn("after", _next_status()).select("application_id", "range", moves.alias("moves"))
    kind = ranges.schema["application_id"].dataType.simpleString()
    entered = maps.repartition("application_id").sortWithinPartitions("application_id", "range").mapInPandas(_entered, f"application_id {kind}, range long, status int")
    each = ranges.alias("r").join(entered.alias("e"), same("r", "e", "application_id", "range"), "left").select("r.application_id", "s", F.coalesce("e.status", F.lit(0)).alias("status")).withColumn("after", _next_status())
    change = "array<struct<seq:bigint,from:int,to:int>>"

    def step(acc: Column, x: Column) -> Column:
        to = F.get(F.get(F.col("after"), x["to"]), acc["status"])
        one = F.array(F.struct(x["seq"].alias("seq"), acc["status"].alias("from"), to.alias("to")))
        return F.when(to == acc["status"], acc).otherwise(F.struct(to.alias("status"), F.concat(acc["out"], one).alias("out")))

    made = F.aggregate("s", F.struct(F.col("status"), F.array().cast(change).alias("out")), step)["out"]
    name = F.array(*map(F.lit, STATUSES))
    return each.select("application_id", F.explode(made).alias("c")).select("application_id", "c.seq", F.get(name, F.col("c.from")).alias("from_status"), F.get(name, F.col("c.to")).alias("to_status"))


def merged_dates(existing: DataFrame, late: DataFrame) -> DataFrame:
    """Late messages: the earlier date wins and threads add up, in any order of arrival."""
    both = existing.unionByName(late)
    return both.groupBy("id").agg(F.min("applied_date").alias("applied_date"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("thread_ids")))).alias("thread_ids"))


def observed_changes(observations: DataFrame) -> DataFrame:
    """(item_key, content, first_seen, sightings): each content of an item once; an
    unchanged sighting adds nothing."""
    content = F.sha2(F.concat_ws("\x1f", "item_key", "source_key", "status"), 256)
    return observations.groupBy("item_key", content.alias("content")).agg(F.min("observed_at").alias("first_seen"), F.count("*").alias("sightings"))


def admitted(hits: DataFrame, limit: int, seconds: int) -> DataFrame:
    """Rate limit per key: a hit passes if fewer than `limit` admitted hits lie within the
    window before it. Keys are walked in order of time, in Arrow batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recent: list[int] = []
        key = None
        for frame in frames:
            flags = []
            for k, at in zip(frame["key"], frame["at"]):
                if k != key:
                    key, recent = k, []
                recent = [t for t in recent if t > at - seconds]
                flags.append(len(recent) < limit)
                if flags[-1]:
                    recent.append(at)
            yield frame.assign(admitted=flags)

    dealt = hits.select("key", "at").repartition("key").sortWithinPartitions("key", "at")
    return dealt.mapInPandas(run, "key long, at long, admitted boolean")


def swap(df: DataFrame, root: str, version: int) -> str:
    """Writes a version of a table; readers use the greatest one that is complete, which
    the writer's success mark tells."""
    path = f"{root}/version={version:010d}"
    df.write.mode("error").parquet(path)
    return path
