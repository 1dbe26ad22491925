"""Merging of applications: which survives, what it becomes, what it supersedes; and
undoing it. A merge is a function from tables to tables; its snapshot is a table too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.config import DATE_WINDOW_DAYS, MAX_MERGE, ONCE, RANK
from sluice.functions import text as T

#: Fields that make a record rich, and all that a merge may set; those that a table lacks don't count.
FIELDS = ["company", "role", "job_url", "external_job_id", "withdraw_reason", "source_portal", "application_method"]
MERGED = [*FIELDS, "is_false_positive"]
#: Tables of rows that belong to an application (application_id) and move with it.
KINDS = ["evidence", "history", "milestones", "thread_links", "prospects"]


def empty(field: str) -> Column:
    value = F.col(field)
    none = value.isNull() | (value.cast("string") == "")
    return none | value.isin("Direct/Unknown", "Unknown") if field == "source_portal" else none | (value == "Unknown") if field == "application_method" else none


def superseded_history(history: DataFrame, *by: str) -> DataFrame:
    """Rows that repeat an earlier change of the same record: all but the first by time."""
    w = Window.partitionBy(*by, "from_status", "to_status").orderBy("changed_at", "id")
    return history.withColumn("_n", F.row_number().over(w)).filter("_n > 1").drop("_n")


def asked_history(history: DataFrame, milestones: DataFrame, *by: str) -> DataFrame:
    """The history of those records of which a milestone names a row: of no other does it
    matter to milestones which rows are superseded."""
    named = milestones.filter("history_id IS NOT NULL").select(F.col("history_id").alias("id")).distinct()
    asked = history.join(named, "id", "left_semi").select(*[F.col(c).alias(f"_{c}") for c in by]).distinct()
    return history.join(asked, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], "left_semi")


def superseded_milestones(milestones: DataFrame, gone_history: DataFrame, *by: str) -> DataFrame:
    """Milestones of superseded history, and those that repeat an earlier one: of the same
    type where that happens once, else of the same type, round and day."""
    dropped = gone_history.select(F.col("id").alias("history_id"), F.lit(True).alias("_gone")).distinct()
    marked = milestones.join(dropped, "history_id", "left")
    often = ~F.coalesce(F.col("event_type").isin(ONCE), F.lit(False))
    day = F.to_date("occurred_at")
    w = Window.partitionBy(*by, "event_type", F.when(often, F.coalesce("interview_round", F.lit("-"))), F.when(often, day)).orderBy("occurred_at", "id")
    rest = marked.filter("_gone IS NULL").withColumn("_n", F.row_number().over(w)).filter("_n > 1").drop("_n", "_gone")
    return rest.unionByName(marked.filter("_gone").drop("_gone"))


def survivors(groups: DataFrame, applications: DataFrame, evidence: DataFrame) -> DataFrame:
    """(root, survivor): confirmed by a person, then most filled, most evidence, earliest,
    smallest id. groups: (root, id)."""
    counts = evidence.filter("application_id IS NOT NULL").groupBy("application_id").agg(F.count("*").alias("evidence"), F.bool_or(F.col("decided_by") == "human").alias("human"))
    filled = sum(F.when(empty(f), 0).otherwise(1) for f in FIELDS if f in applications.columns)
    a = groups.join(applications.withColumn("filled", filled), "id").join(counts, F.col("id") == counts.application_id, "left")
    order = F.struct(F.when(F.coalesce("human", F.lit(False)), 0).otherwise(1).alias("h"), (-F.col("filled")).alias("f"), (-F.coalesce("evidence", F.lit(0))).alias("e"), F.col("applied_date"), F.col("id"))
    return a.groupBy("root").agg(F.min_by("id", order).alias("survivor"))


def plan(groups: DataFrame, applications: DataFrame, chosen: DataFrame, most: int = MAX_MERGE) -> DataFrame:
    """Per group the merged record, where its fields disagree, warnings, and what blocks the merge.
    The survivor's value is preferred, then the smallest id's that has one; the date is
    the earliest, the status the furthest. A group that is too large has its row too, and is blocked."""
    own_fields = [f for f in MERGED if f in applications.columns]
    asked = groups.groupBy("root").agg(F.count_distinct("id").alias("asked"))
    a = groups.distinct().join(applications, "id").join(chosen, "root").join(asked, "root")
    own = F.struct((F.col("id") != F.col("survivor")).alias("other"), F.col("id"))
    rank = F.coalesce(F.create_map(*[F.lit(x) for pair in RANK.items() for x in pair])[F.col("current_status")], F.lit(-1))
    top = F.struct(rank.alias("r"), (F.col("id") == F.col("survivor")).alias("own"), (-F.col("id")).alias("i"))
    picks = [F.min_by(f, F.when(~empty(f), own)).alias(f) for f in own_fields]

    def differ(f: str, value: Column | None = None) -> Column:
        """Whether there are two values: by the least and the greatest, as counts of distinct ones need each row several times."""
        known = F.when(~empty(f), F.col(f) if value is None else value)
        return F.coalesce(F.min(known) != F.max(known), F.lit(False))

    clash = [F.when(differ(f), f) for f in own_fields]
    days = F.floor(F.timestamp_diff("SECOND", F.min("applied_date"), F.max("applied_date")) / 86400)
    ids = [F.when(differ("external_job_id"), "different job ids")] if "external_job_id" in own_fields else []
    warnings = [*ids, F.when(differ("company", T.company(F.col("company"))), "different companies"), F.when(differ("role", T.role(F.col("role"))), "different roles"), F.when(days > DATE_WINDOW_DAYS[1], "dates months apart")]
    blocking = [F.when(F.count("*") < F.max("asked"), "not found"), F.when(F.count("*") < 2, "too few"), F.when(F.max("asked") > most, "too many"), F.when(F.bool_or(F.col("record_state") != "active"), "already merged")]
    # a blocked group's threads aren't collected: it may be of any size
    threads = F.when(F.col("asked") <= most, F.struct(own.alias("o"), "thread_ids"))
    return a.groupBy("root", "survivor").agg(
        F.min("applied_date").alias("applied_date"), F.max_by("current_status", top).alias("current_status"), *picks, F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(threads)), lambda x: x["thread_ids"]))).alias("thread_ids"),
        F.array_compact(F.array(*clash, F.when(F.min("current_status") != F.max("current_status"), "current_status"))).alias("conflicts"),
        F.array_compact(F.array(*warnings)).alias("warnings"), F.array_compact(F.array(*blocking)).alias("blocking"), F.count("*").alias("n"),
    )


def execute(groups: DataFrame, applications: DataFrame, children: dict[str, DataFrame], planned: DataFrame, operation: int) -> dict[str, DataFrame]:
    """New applications and children (KINDS), and as snapshot_* all that was changed, as it was.
    Groups that something blocks stay as they are. Children of all kinds move to the survivor; history
    and milestones that repeat there are marked as superseded."""
    ready = planned.filter(F.size("blocking") == 0)
    moves = groups.join(ready.select("root", "survivor"), "root").select(F.col("id").alias("from_id"), "survivor").distinct()
    op = F.lit(operation).cast("long")
    merged = moves.filter("from_id <> survivor")
    columns = applications.columns
    fields = [f for f in ["applied_date", "current_status", "thread_ids", *MERGED] if f in columns]
    new = ready.select(F.col("survivor").alias("id"), *[F.col(f).alias(f"_{f}") for f in fields])
    apps = applications.join(new, "id", "left").join(merged.select(F.col("from_id").alias("id"), F.col("survivor").alias("_into")), "id", "left")
    state = {"record_state": F.when(F.col("_into").isNotNull(), "merged").otherwise(F.col("record_state")), "merged_into": F.coalesce("_into", "merged_into")}
    taken = F.col("_applied_date").isNotNull()
    # a field that no record fills stays as the survivor has it
    apps = apps.select(*[state[c].alias(c) if c in state else F.when(taken, F.coalesce(f"_{c}", c)).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in columns])
    out = {"applications": apps, "snapshot_applications": applications.join(moves.select(F.col("from_id").alias("id")), "id", "left_semi")}
    moved = {k: rows.join(moves, rows.application_id == moves.from_id, "left").withColumn("_old", F.col("application_id")).withColumn("application_id", F.coalesce("survivor", "application_id")).drop("from_id") for k, rows in children.items()}
    inside = lambda d: d.filter(F.col("survivor").isNotNull() & F.col("superseded_by").isNull())
    gone = {"history": superseded_history(inside(moved["history"]), "application_id").select("id").distinct()} if "history" in children else {}
    if gone and "milestones" in children:
        gone["milestones"] = superseded_milestones(inside(moved["milestones"]), gone["history"], "application_id").select("id").distinct()
    for kind, rows in children.items():
        now = moved[kind]
        if kind in gone:
            hit = now.join(gone[kind].withColumn("_hit", F.lit(True)), "id", "left")
            out[kind] = hit.select(*[F.coalesce("superseded_by", F.when(F.col("_hit"), op)).alias(c) if c == "superseded_by" else F.col(c) for c in rows.columns])
        else:
            out[kind] = now.select(rows.columns)
        was = [c for c in ("superseded_by",) if c in rows.columns]
        out[f"snapshot_{kind}"] = now.filter(F.col("survivor").isNotNull()).select("id", F.col("_old").alias("application_id"), *was)
    return out


def undo(merged: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables before a merge, from its outcome and snapshot; children that came later
    stay where they are."""

    def back(now: DataFrame, was: DataFrame) -> DataFrame:
        marks = [c for c in was.columns if c != "id"]
        j = now.join(was.select("id", F.lit(True).alias("_was"), *[F.col(c).alias(f"_{c}") for c in marks]).distinct(), "id", "left")
        return j.select(*[F.when(F.col("_was"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in marks else F.col(c) for c in now.columns])

    apps, was = merged["applications"], merged["snapshot_applications"]
    kinds = [k for k in merged if f"snapshot_{k}" in merged and k != "applications"]
    return {"applications": apps.join(was.select("id"), "id", "left_anti").unionByName(was), **{k: back(merged[k], merged[f"snapshot_{k}"]) for k in kinds}}


def undo_conflicts(current: DataFrame, merged: dict[str, DataFrame]) -> DataFrame:
    """(id, reason): records that changed since the merge, so that undoing must be refused."""
    after = merged["applications"].join(merged["snapshot_applications"].select("id"), "id", "left_semi")
    now = current.select("id", F.col("record_state").alias("state"), F.col("merged_into").alias("into"), F.col("current_status").alias("status"))
    j = after.join(now, "id", "left")
    why = F.when(F.col("state").isNull(), "missing").when(~F.col("into").eqNullSafe(F.col("merged_into")) | (F.col("state") != F.col("record_state")), "merged elsewhere").when(F.col("status") != F.col("current_status"), "edited since")
    return j.select("id", why.alias("reason")).filter("reason IS NOT NULL")
