"""Filtered, ordered and counted reads of records, and lookups between tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.config import STALE_DAYS, TERMINAL
from sluice.operators.predicates import active_record, live, mentions, outcome, stale


@dataclass(frozen=True)
class ApplicationFilter:
    """What a list may be narrowed by; None doesn't filter."""

    as_of: str
    status: str | None = None
    portal: str | None = None
    method: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    search: str | None = None
    stale: bool | None = None
    interviewed: bool | None = None
    outcome: str | None = None
    include_merged: bool = False

    def predicate(self) -> Column:
        hit = F.lit(True) if self.include_merged else active_record()
        for column, value in (("current_status", self.status), ("source_portal", self.portal), ("application_method", self.method)):
            if value is not None:
                hit &= F.col(column) == value
        if self.date_from is not None:
            hit &= F.col("applied_date") >= F.lit(self.date_from).cast("timestamp_ntz")
        if self.date_to is not None:
            hit &= F.col("applied_date") <= F.lit(self.date_to).cast("timestamp_ntz")
        if self.search:
            hit &= mentions(self.search)
        if self.stale is not None:
            hit &= stale(self.as_of, STALE_DAYS) if self.stale else ~stale(self.as_of, STALE_DAYS)
        return hit & outcome(self.outcome)


def filtered(applications: DataFrame, milestones: DataFrame, by: ApplicationFilter) -> DataFrame:
    """Applications that pass; interviewed counts superseded milestones too."""
    found = applications.filter(by.predicate())
    if by.interviewed is not None:
        met = milestones.filter("event_type = 'Interview Attended'").select(F.col("application_id").alias("id"))
        found = found.join(met, "id", "left_semi" if by.interviewed else "left_anti")
    return found


def page(found: DataFrame, *order: Column | str, number: int = 1, size: int = 50) -> DataFrame:
    """One page in a stable order."""
    return found.orderBy(*order).offset((number - 1) * size).limit(size)


def missing_fields(applications: DataFrame) -> DataFrame:
    return applications.filter(active_record() & ~F.col("is_false_positive") & (F.col("company").isNull() | F.col("role").isNull()))


def by_ids(applications: DataFrame, ids: DataFrame, include_merged: bool = False) -> DataFrame:
    return (applications if include_merged else applications.filter(active_record())).join(ids, "id", "left_semi")


def at_companies(applications: DataFrame, names: DataFrame) -> DataFrame:
    """Open applications at any of the companies, whatever the case."""
    wanted = names.select(F.lower("company").alias("name"))
    return applications.filter(active_record() & ~F.col("current_status").isin(TERMINAL)).join(wanted, F.lower("company") == F.col("name"), "left_semi")


def with_prefix(applications: DataFrame, first_word: str) -> DataFrame:
    return applications.filter(active_record() & F.lower("company").startswith(first_word.lower()))


@dataclass(frozen=True)
class EvidenceFilter:
    """A status beats a set of statuses, which beats hiding ignored evidence."""

    status: str | None = None
    statuses: tuple[str, ...] = ()
    source: str | None = None
    application_id: int | None = None
    linked: bool | None = None

    def predicate(self) -> Column:
        state = F.col("status")
        hit = state == self.status if self.status else state.isin(*self.statuses) if self.statuses else state != "ignored"
        if self.source is not None:
            hit &= F.col("source") == self.source
        if self.application_id is not None:
            hit &= F.col("application_id") == self.application_id
        if self.linked is not None:
            hit &= F.col("application_id").isNotNull() if self.linked else F.col("application_id").isNull()
        return hit


def survivors(applications: DataFrame, hops: int = 10) -> DataFrame:
    """(id, survivor): follows merges for at most `hops`; null where that leads nowhere active."""
    state = applications.select(F.col("id").alias("at"), "record_state", "merged_into")
    moved = state.filter("record_state = 'merged'").select("at", "merged_into")
    out = applications.select("id", F.col("id").alias("now"))
    for _ in range(hops):
        ahead = out.join(moved, out.now == moved.at, "left").select("id", "now", "merged_into")
        if ahead.filter(F.col("merged_into").isNotNull()).limit(1).count() == 0:
            break
        out = ahead.select("id", F.coalesce("merged_into", "now").alias("now"))
    ends = state.filter("record_state = 'active'").select(F.col("at").alias("survivor"))
    return out.join(ends, out.now == ends.survivor, "left").select("id", "survivor")


def by_thread(applications: DataFrame, threads: DataFrame) -> DataFrame:
    """(thread_id, application_id): the survivor of the first application of a thread."""
    links = applications.select(F.explode("thread_ids").alias("thread_id"), "id").join(threads, "thread_id", "left_semi").groupBy("thread_id").agg(F.min("id").alias("id"))
    return links.join(survivors(applications), "id").select("thread_id", F.col("survivor").alias("application_id"))


def last_evidence(applications: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, last_evidence_at): null where there is none."""
    newest = evidence.groupBy("application_id").agg(F.max("occurred_at").alias("last_evidence_at"))
    return applications.select("id").join(newest, F.col("id") == newest.application_id, "left").select("id", "last_evidence_at")


def evidence_totals(evidence: DataFrame) -> DataFrame:
    seen = F.col("status") != "ignored"
    return evidence.agg(F.count_if(seen).alias("total"), F.count_if(seen & F.col("application_id").isNull()).alias("unlinked"), F.count_if(F.col("status") == "needs_review").alias("needs_review"))


def grouped_counts(table: DataFrame, columns: list[str]) -> DataFrame:
    """(dimension, value, n) of several columns in one pass over the table."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(c).cast("string"), F.lit("none")).alias("value")) for c in columns]))
    return table.select(cells.alias("c")).groupBy("c.dimension", "c.value").agg(F.count("*").alias("n"))


def taxonomy(applications: DataFrame) -> DataFrame:
    """(kind, value): portals and methods in use."""
    cells = F.explode(F.array(F.struct(F.lit("portal").alias("kind"), F.col("source_portal").alias("value")), F.struct(F.lit("method").alias("kind"), F.col("application_method").alias("value"))))
    return applications.filter(active_record()).select(cells.alias("c")).select("c.*").filter("value <> ''").distinct()


def identities(evidence: DataFrame) -> DataFrame:
    """Per application the sender domains and addresses of its evidence, by who linked it."""
    domain = F.substring_index("sender", "@", -1)
    human = F.col("decided_by") == "human"
    return evidence.filter(F.col("application_id").isNotNull()).groupBy("application_id").agg(
        F.sort_array(F.collect_set(domain)).alias("domains"), F.sort_array(F.collect_set(F.when(human, F.col("sender")))).alias("human_senders"), F.sort_array(F.collect_set(F.when(F.col("decided_by") == "resolver", F.col("sender")))).alias("resolver_senders"),
    )


def collection_metrics(observations: DataFrame) -> DataFrame:
    """One row: sightings processed, distinct items, runs and decisions."""
    d = F.col("decision")
    return observations.agg(
        F.count("*").alias("processed"), F.count_distinct("item_key").alias("items"), F.count_distinct("run_id").alias("runs"), F.count_if(d == "linked").alias("linked"), F.count_if(d == "created").alias("created"),
        F.count_if(d == "needs_review").alias("review"), F.count_if(d == "unchanged").alias("unchanged"), F.coalesce(F.count("evidence_id"), F.lit(0)).alias("with_evidence"),
    )


def latest_items(observations: DataFrame) -> DataFrame:
    """Per item its latest sighting."""
    order = F.struct("observed_at", "id")
    return observations.groupBy("item_key").agg(F.max_by("status", order).alias("status"), F.max("observed_at").alias("seen_at"), F.count("*").alias("sightings"))


def missing_milestones(history: DataFrame, milestones: DataFrame, of: dict[str, str]) -> DataFrame:
    """Milestones that live history implies and no milestone records: (history_id,
    application_id, event_type, occurred_at). Statuses outside the map imply none."""
    kind = F.create_map(*[F.lit(x) for pair in of.items() for x in pair])[F.col("to_status")]
    implied = history.filter(live()).select(F.col("id").alias("history_id"), "application_id", kind.alias("event_type"), F.col("changed_at").alias("occurred_at")).filter("event_type IS NOT NULL")
    return implied.join(milestones.filter("history_id IS NOT NULL").select("history_id"), "history_id", "left_anti")


def newest_by(table: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order."""
    return table.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
