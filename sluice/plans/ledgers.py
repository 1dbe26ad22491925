"""Idempotent writes and folds over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice import views as V
from sluice.config import TRANSITIONS
from sluice.operators import ledgers as K
from sluice.plans.registry import query


@query("SELECT source, external_id, min(id) AS id, count(*) AS offered FROM evidence GROUP BY 1, 2")
def evidence_insert_if_absent(spark, sf):
    e = V.evidence(spark, sf).select("source", "external_id", "id")
    stored = e.filter("id % 2 = 0")
    kept = K.insert_if_absent(stored, e, ["source", "external_id"], F.col("id"))
    offered = e.groupBy("source", "external_id").agg(F.count("*").alias("offered"))
    return kept.join(offered, ["source", "external_id"])


@query("WITH new AS (SELECT user_id AS id, arg_max(event_type, struct_pack(t := ts, i := event_id)) AS last FROM events GROUP BY 1) SELECT o.id, o.company, coalesce(n.last, o.role) AS role, strftime(o.created_at, '%Y-%m-%d') AS created FROM application o LEFT JOIN new n USING (id)")
def application_upsert(spark, sf):
    apps = V.applications(spark, sf).select("id", "company", "role", "created_at")
    ev = V.read(spark, sf, "events").join(apps.select("id", "company"), F.col("user_id") == F.col("id"))
    new = ev.select("id", "company", F.col("event_type").alias("role"), F.col("ts").alias("created_at"), "event_id")
    last = new.groupBy("id", "company").agg(F.max_by("role", F.struct("created_at", "event_id")).alias("role"), F.max("created_at").alias("created_at"))
    return K.upsert(apps, last, ["id"], F.desc("created_at"), keep=["created_at"]).select("id", "company", "role", F.date_format("created_at", "yyyy-MM-dd").alias("created"))


@query("SELECT 'm-' || user_id AS message_id, arg_max(event_type, struct_pack(t := ts, r := event_type)) AS result, count(*) AS times FROM events GROUP BY 1")
def processed_ledger(spark, sf):
    e = V.read(spark, sf, "events").select(F.concat(F.lit("m-"), F.col("user_id").cast("string")).alias("message_id"), F.col("event_type").alias("result"), F.col("ts").alias("processed_at"))
    return K.processed(e)


@query("SELECT run_id, count(*) AS seen, count(*) FILTER (decision = 'linked') AS linked, count(*) FILTER (decision = 'created') AS created, count(*) FILTER (decision = 'needs_review') AS needs_review, count(*) FILTER (decision = 'unchanged') AS unchanged FROM observation GROUP BY 1")
def run_counters(spark, sf):
    return K.counters(V.observations(spark, sf))


@query("SELECT run_id, min(status) AS status, count(DISTINCT status) > 1 AS conflict, count(*) AS reports FROM observation GROUP BY 1")
def run_finish(spark, sf):
    return K.finished(V.observations(spark, sf).select("run_id", "status"))


@query("WITH d AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 4 = 0 THEN 0 ELSE 1 END, ts DESC, event_id DESC) AS n FROM events) SELECT user_id AS evidence_id, event_type AS decision, CASE WHEN event_id % 4 = 0 THEN 'human' ELSE 'resolver' END AS decided_by, event_id AS seq FROM d WHERE n = 1")
def current_decisions(spark, sf):
    log = V.read(spark, sf, "events").select(F.col("user_id").alias("evidence_id"), F.col("event_type").alias("decision"), F.when(V.mod("event_id", 4) == 0, "human").otherwise("resolver").alias("decided_by"), F.col("ts").alias("decided_at"), F.col("event_id").alias("seq"))
    return K.decisions(log).drop("decided_at")


@query("""WITH gone AS (SELECT id FROM application WHERE record_state = 'active' AND current_status = 'Withdrawn' AND id NOT IN (SELECT merged_into FROM application WHERE merged_into IS NOT NULL))
SELECT (SELECT count(*) FROM application WHERE id NOT IN (SELECT id FROM gone)) AS applications, (SELECT count(*) FROM history WHERE application_id NOT IN (SELECT id FROM gone)) AS history""")
def cascading_delete(spark, sf):
    apps = V.applications(spark, sf)
    left, children = K.cascade_delete(apps, {"history": V.history(spark, sf)}, apps.filter("current_status = 'Withdrawn'").select("id"))
    return left.agg(F.count("*").alias("applications")).crossJoin(children["history"].agg(F.count("*").alias("history")))  # one row each


MOVES = ", ".join(f"('{a}', '{b}')" for a, to in TRANSITIONS.items() for b in to)


@query(f"""WITH RECURSIVE sig AS (SELECT application_id, CAST(epoch(changed_at) AS BIGINT) AS seq, to_status AS signal FROM history), move(f, t) AS (VALUES {MOVES}),
walk AS (SELECT DISTINCT application_id, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS from_status, 'Applied' AS to_status FROM sig
  UNION ALL SELECT application_id, seq, from_status, to_status FROM (
    SELECT w.application_id, s.seq, w.to_status AS from_status, s.signal AS to_status, row_number() OVER (PARTITION BY w.application_id ORDER BY s.seq, s.signal) AS n
    FROM walk w JOIN move m ON m.f = w.to_status JOIN sig s ON s.application_id = w.application_id AND s.signal = m.t AND (w.seq IS NULL OR s.seq > w.seq OR (s.seq = w.seq AND s.signal > w.to_status))) WHERE n = 1)
SELECT * FROM walk WHERE seq IS NOT NULL""")
def status_machine(spark, sf):
    signals = V.history(spark, sf).select("application_id", F.unix_seconds(F.col("changed_at").cast("timestamp")).alias("seq"), F.col("to_status").alias("signal"))
    return K.fold_status(signals)


@query("WITH b AS (SELECT id, applied_date, unnest(thread_ids) AS t FROM application UNION ALL SELECT user_id, ts, 'late-' || (event_id % 3) FROM events WHERE user_id IN (SELECT id FROM application)) SELECT id, strftime(min(applied_date), '%Y-%m-%d') AS applied_on, array_to_string(list_sort(list_distinct(list(t))), ',') AS threads FROM b GROUP BY 1")
def late_messages(spark, sf):
    apps = V.applications(spark, sf).filter(F.size("thread_ids") > 0).select("id", "applied_date", "thread_ids")
    known = V.applications(spark, sf).select("id")
    late = V.read(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("ts").alias("applied_date"), F.array(F.concat(F.lit("late-"), V.mod("event_id", 3).cast("string"))).alias("thread_ids")).join(known, "id", "left_semi")
    return K.merged_dates(apps, late).select("id", F.date_format("applied_date", "yyyy-MM-dd").alias("applied_on"), F.array_join("thread_ids", ",").alias("threads"))


@query("SELECT item_key, sha256(item_key || chr(31) || source_key || chr(31) || status) AS content, strftime(min(observed_at), '%Y-%m-%d') AS first_seen, count(*) AS sightings FROM observation GROUP BY 1, 2")
def observed_changes(spark, sf):
    return K.observed_changes(V.observations(spark, sf)).select("item_key", "content", F.date_format("first_seen", "yyyy-MM-dd").alias("first_seen"), "sightings")


@query()
def rate_limited(spark, sf):
    hits = V.read(spark, sf, "events").select(F.col("user_id").alias("key"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    return K.admitted(hits, 3, 86400)
