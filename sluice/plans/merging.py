"""Merges over the test tables: applications of one company and role date by date."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice import views as V
from sluice.operators import merging as M
from sluice.plans.insights import SEEN
from sluice.plans.registry import query


def _groups(spark, sf):
    """Visible applications of one company and role that are open or closed alike."""
    apps = V.applications(spark, sf, updated=False).filter("record_state = 'active' AND NOT is_false_positive")
    roots = apps.groupBy("company", "role").agg(F.min("id").alias("root"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return apps.join(roots, ["company", "role"]).select("root", "id")


GROUPS = f"WITH app AS (SELECT * FROM application WHERE {SEEN}), g AS (SELECT * FROM (SELECT min(id) OVER w AS root, id, count(*) OVER w AS n FROM app WINDOW w AS (PARTITION BY company, role)) WHERE n > 1)\n"


@query("""SELECT count(*) AS rows, count(DISTINCT application_id) AS applications FROM (SELECT *, row_number() OVER (PARTITION BY application_id, from_status, to_status ORDER BY changed_at, id) AS n FROM history) WHERE n > 1""")
def superseded_history(spark, sf):
    return M.superseded_history(V.history(spark, sf), "application_id").agg(F.count("*").alias("rows"), F.count_distinct("application_id").alias("applications"))


@query("""WITH gone AS (SELECT DISTINCT id FROM (SELECT id, row_number() OVER (PARTITION BY application_id, from_status, to_status ORDER BY changed_at, id) AS n FROM history) WHERE n > 1),
e AS (SELECT *, history_id IN (SELECT id FROM gone) AS g FROM milestone),
k AS (SELECT id, row_number() OVER (PARTITION BY application_id, event_type, CASE WHEN event_type IN ('Application Submitted', 'Offer Received', 'Rejected') THEN '' ELSE coalesce(interview_round, '-') || '|' || strftime(occurred_at, '%Y-%m-%d') END ORDER BY occurred_at, id) AS n FROM e WHERE NOT coalesce(g, false))
SELECT id FROM e WHERE g UNION ALL SELECT id FROM k WHERE n > 1""")
def superseded_milestones(spark, sf):
    milestones = V.milestones(spark, sf)
    gone = M.superseded_history(M.asked_history(V.history(spark, sf), milestones, "application_id"), "application_id")
    return M.superseded_milestones(milestones, gone, "application_id").select("id")


SURVIVORS = GROUPS + """, ev AS (SELECT application_id, count(*) AS n, bool_or(decided_by = 'human') AS human FROM evidence WHERE application_id IS NOT NULL GROUP BY 1),
s AS (SELECT g.root, a.*, row_number() OVER (PARTITION BY g.root ORDER BY coalesce(human, false) DESC, (CASE WHEN job_url IS NULL THEN 0 ELSE 1 END) + (CASE WHEN application_method = 'Unknown' THEN 0 ELSE 1 END) DESC, coalesce(ev.n, 0) DESC, applied_date, a.id) AS rn FROM g JOIN app a USING (id) LEFT JOIN ev ON ev.application_id = a.id)
"""


@query(SURVIVORS + "SELECT root, id AS survivor FROM s WHERE rn = 1")
def merge_survivors(spark, sf):
    return M.survivors(_groups(spark, sf), V.applications(spark, sf, updated=False), V.evidence(spark, sf))


def _plan(spark, sf):
    apps, groups = V.applications(spark, sf), _groups(spark, sf)
    return M.plan(groups, apps, M.survivors(groups, apps, V.evidence(spark, sf)))


#: Groups of more than this are blocked: less than the model's own limit, as the test tables' groups are small.
MOST = 4
NORMAL = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


def _plan(spark, sf):
    apps, groups = V.applications(spark, sf, updated=False), _groups(spark, sf)
    return M.plan(groups, apps, M.survivors(groups, apps, V.evidence(spark, sf)), MOST)


@query(SURVIVORS + f""", v AS (SELECT root, id AS survivor FROM s WHERE rn = 1), m AS (SELECT s.*, v.survivor, CASE current_status WHEN 'Applied' THEN 0 WHEN 'Resume Shortlisted' THEN 1 WHEN 'Interview Scheduled' THEN 2 WHEN 'Interview In Progress' THEN 3 WHEN 'Offer' THEN 5 WHEN 'Joined' THEN 6 ELSE 4 END AS rk FROM s JOIN v USING (root))
SELECT root, survivor, strftime(min(applied_date), '%Y-%m-%d') AS applied_on, first(current_status ORDER BY rk DESC, id = survivor DESC, id) AS current_status, first(company ORDER BY id <> survivor, id) AS company,
  first(job_url ORDER BY job_url IS NULL, id <> survivor, id) AS job_url, first(CASE WHEN application_method <> 'Unknown' THEN application_method END ORDER BY application_method = 'Unknown', id <> survivor, id) AS application_method, count(*) AS n,
  concat_ws(',', CASE WHEN count(DISTINCT company) > 1 THEN 'company' END, CASE WHEN count(DISTINCT role) > 1 THEN 'role' END, CASE WHEN count(DISTINCT job_url) > 1 THEN 'job_url' END, CASE WHEN count(DISTINCT source_portal) FILTER (source_portal NOT IN ('Direct/Unknown', 'Unknown')) > 1 THEN 'source_portal' END,
    CASE WHEN count(DISTINCT application_method) FILTER (application_method <> 'Unknown') > 1 THEN 'application_method' END, CASE WHEN count(DISTINCT is_false_positive) > 1 THEN 'is_false_positive' END, CASE WHEN count(DISTINCT current_status) > 1 THEN 'current_status' END) AS conflicts,
  concat_ws(',', CASE WHEN date_diff('day', CAST(min(applied_date) AS DATE), CAST(max(applied_date) AS DATE)) > 180 THEN 'dates months apart' END) AS warnings, CASE WHEN count(*) > {MOST} THEN 'too many' ELSE '' END AS blocking
FROM m GROUP BY 1, 2""")
def merge_plans(spark, sf):
    text = [F.array_join(c, ",").alias(c) for c in ("conflicts", "warnings", "blocking")]
    return _plan(spark, sf).select("root", "survivor", F.date_format("applied_date", "yyyy-MM-dd").alias("applied_on"), "current_status", "company", "job_url", "application_method", "n", *text)


def _children(spark, sf):
    apps, ev = V.applications(spark, sf), V.evidence(spark, sf)
    links = apps.select(F.explode(F.array_distinct("thread_ids")).alias("thread_id"), F.col("id").alias("application_id"))
    links = links.select(F.concat_ws("/", F.col("application_id").cast("string"), "thread_id").alias("id"), "thread_id", "application_id")
    return {"history": V.history(spark, sf), "milestones": V.milestones(spark, sf), "evidence": ev.select("id", "application_id", "external_id"), "thread_links": links, "prospects": V.prospects(spark, sf).select("id", "application_id")}


def _executed(spark, sf):
    apps = V.applications(spark, sf)
    return M.execute(_groups(spark, sf), apps, _children(spark, sf), _plan(spark, sf), 77)


@query(GROUPS + "SELECT CASE WHEN a.record_state = 'merged' THEN 'merged before' WHEN g.id IS NULL THEN 'alone' ELSE 'in a group' END AS kind, count(*) AS n FROM application a LEFT JOIN g USING (id) GROUP BY 1")
def merge_kinds(spark, sf):
    apps = V.applications(spark, sf).join(_groups(spark, sf).select("id", "root"), "id", "left")
    kind = F.when(F.col("record_state") == "merged", "merged before").when(F.col("root").isNull(), "alone").otherwise("in a group")
    return apps.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


READY = SURVIVORS + f", v AS (SELECT root, max(CASE WHEN rn = 1 THEN id END) AS survivor FROM s GROUP BY 1 HAVING count(*) <= {MOST}), moves AS (SELECT s.id AS from_id, v.survivor FROM s JOIN v USING (root))\n"


@query(READY + "SELECT CASE WHEN record_state = 'merged' OR id IN (SELECT from_id FROM moves WHERE from_id <> survivor) THEN 'merged' ELSE 'active' END AS record_state, count(*) AS n FROM application GROUP BY 1")
def merge_executed_states(spark, sf):
    return _executed(spark, sf)["applications"].groupBy("record_state").agg(F.count("*").alias("n"))


@query(READY + """, c AS (SELECT 'evidence' AS kind, application_id FROM evidence UNION ALL SELECT 'history', application_id FROM history UNION ALL SELECT 'milestones', application_id FROM milestone
UNION ALL SELECT 'prospects', application_id FROM prospect UNION ALL SELECT 'thread_links', id FROM (SELECT DISTINCT id, unnest(thread_ids) AS t FROM application))
SELECT kind, count(*) AS rows, count(application_id) AS linked, CAST(count_if(from_id <> survivor) AS BIGINT) AS moved, CAST(sum(coalesce(survivor, application_id)) AS BIGINT) AS ids FROM c LEFT JOIN moves ON application_id = from_id GROUP BY 1""")
def merge_moved_children(spark, sf):
    """Children of every kind: how many moved to a survivor, and where all are."""
    done = _executed(spark, sf)
    survivors = _plan(spark, sf).select(F.col("survivor").alias("application_id"), F.lit(True).alias("stays"))
    parts = None
    for kind in M.KINDS:
        now = done[kind].agg(F.count("*").alias("rows"), F.count("application_id").alias("linked"), F.sum("application_id").alias("ids"))
        was = done[f"snapshot_{kind}"].join(survivors, "application_id", "left").agg(F.count_if(F.col("stays").isNull()).alias("moved"))
        one = now.crossJoin(was).select(F.lit(kind).alias("kind"), "rows", "linked", "moved", "ids")  # one row each
        parts = one if parts is None else parts.unionByName(one)
    return parts


@query("SELECT record_state, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids, CAST(sum(coalesce(merged_into, 0)) AS BIGINT) AS targets FROM application GROUP BY 1")
def merge_undone(spark, sf):
    """A merge and its undoing leave what was there."""
    back = M.undo(_executed(spark, sf))["applications"]
    return back.groupBy("record_state").agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.sum(F.coalesce("merged_into", F.lit(0))).alias("targets"))
