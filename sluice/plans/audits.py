"""Audit queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice import views as V
from sluice.config import EVIDENCE_STATUSES, STATUSES
from sluice.operators import audits as A
from sluice.operators import duplicates as D
from sluice.plans.insights import AS_OF, SEEN
from sluice.plans.registry import query


@query()
def table_digests(spark, sf):
    out = None
    for name in ("orders", "lineitem", "events", "customer"):
        one = A.table_digest(V.read(spark, sf, name)).select(F.lit(name).alias("name"), "rows", "digest")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT 'gone' AS change, count(*) AS n FROM application WHERE is_false_positive HAVING count(*) > 0")
def changed_rows(spark, sf):
    apps = V.applications(spark, sf).select("id", "company", "role", "current_status", "is_false_positive")
    return A.changed_rows(apps, apps.filter("NOT is_false_positive"))


@query(r"""WITH a AS (SELECT * FROM application WHERE record_state = 'active') SELECT count(*) AS active_applications, count(*) FILTER (trim(role) = '') AS empty_role, count(*) FILTER (len(role) > 70 OR regexp_matches(lower(role), '\b(hi|hello|dear|thank|thanks|thank you|your|you|we|our|availability|interest|regarding|please)\b')) AS sentence_like_role, count(*) FILTER (len(thread_ids) = 0) AS without_thread,
  count(job_url) AS with_job_url, (SELECT count(*) FROM (SELECT t FROM (SELECT DISTINCT id, unnest(thread_ids) AS t FROM a) GROUP BY t HAVING count(*) > 1)) AS shared_threads,
  count(*) FILTER (regexp_matches(lower(job_url), '[?&](gh_jid=\d{5,}|jk=[0-9a-f]{12,20}|currentjobid=\d{6,})|linkedin\.com/jobs/view/|lever\.co/|greenhouse\.io/|naukri\.com/')) AS with_external_job_id FROM a""")
def data_quality(spark, sf):
    return A.data_quality(V.applications(spark, sf))


@query("SELECT 'application' AS what, current_status AS value, count(*) AS n FROM application WHERE current_status NOT IN ('Applied') GROUP BY 2 UNION ALL SELECT 'evidence', status, count(*) FROM evidence WHERE status = 'failed' GROUP BY 2")
def outside_domain(spark, sf):
    a = A.outside_domain(V.applications(spark, sf), "current_status", STATUSES[:1]).select(F.lit("application").alias("what"), "value", "n")
    return a.unionByName(A.outside_domain(V.evidence(spark, sf), "status", EVIDENCE_STATUSES).select(F.lit("evidence").alias("what"), "value", "n"))


@query("SELECT application_id, count(*) AS n FROM milestone WHERE application_id NOT IN (SELECT id FROM application) GROUP BY 1")
def orphan_milestones(spark, sf):
    return A.orphans(V.milestones(spark, sf), "application_id", V.applications(spark, sf), "id").groupBy("application_id").agg(F.count("*").alias("n"))


SNAP = f"""WITH a AS (SELECT * FROM application WHERE {SEEN}), m AS (SELECT 'total' AS name, count(*) AS value FROM a UNION ALL SELECT 'offers', count(*) FROM a WHERE current_status IN ('Offer Negotiation', 'Offer', 'Joined')
  UNION ALL SELECT 'interviews', count(*) FROM a WHERE current_status IN ('Interview Scheduled', 'Interview In Progress', 'Offer Negotiation', 'Offer', 'Joined') UNION ALL SELECT 'stale', count(*) FROM a WHERE current_status = 'Applied' AND updated_at < {AS_OF} - INTERVAL 14 DAY
  UNION ALL SELECT 'last_180_days', count(*) FROM a WHERE date_diff('day', CAST(applied_date AS DATE), CAST({AS_OF} AS DATE)) <= 180 UNION ALL SELECT 'status:' || current_status, count(*) FROM a GROUP BY 1 UNION ALL SELECT 'source:' || source_portal, count(*) FROM a GROUP BY 1)
"""


@query(SNAP + "SELECT name, value FROM m")
def analytics_snapshot(spark, sf):
    return A.snapshot(V.applications(spark, sf), V.AS_OF)


@query(SNAP + "SELECT sha256(string_agg(name || '=' || value, chr(10) ORDER BY name || '=' || value)) AS digest FROM m")
def analytics_digest(spark, sf):
    return A.snapshot_digest(A.snapshot(V.applications(spark, sf), V.AS_OF))


@query(SNAP + ", n AS (SELECT name, value + 1 AS value FROM m WHERE name LIKE 'source:%' UNION ALL SELECT name, value FROM m WHERE name = 'total') SELECT coalesce(m.name, n.name) AS name, m.value AS before, n.value AS after FROM m FULL JOIN n ON m.name = n.name WHERE m.value IS DISTINCT FROM n.value")
def analytics_delta(spark, sf):
    m = A.snapshot(V.applications(spark, sf), V.AS_OF)
    changed = m.filter("name LIKE 'source:%'").withColumn("value", F.col("value") + 1).unionByName(m.filter("name = 'total'"))
    return A.delta(m, changed)


@query("SELECT current_status, least(count(*), 20) AS sampled FROM application GROUP BY 1")
def stratified_sample(spark, sf):
    return A.stratified(V.applications(spark, sf), "current_status", "id", 20, 7).groupBy("current_status").agg(F.count("*").alias("sampled"))


BENIGN = [*STATUSES, "version", "license"]
PHRASE = r"([\p{L}\p{N}_#@.-]+ [\p{L}\p{N}_#@.-]+|[\p{L}\p{N}_#@.-]+)"


@query(f"""WITH t AS (SELECT DISTINCT lower(term) AS term FROM (SELECT unnest(regexp_extract_all(text, '{PHRASE}', 1)) AS term FROM benchmark) WHERE len(term) >= 4 AND NOT regexp_full_match(term, '[0-9]+') AND lower(term) NOT IN ({", ".join(f"'{b.lower()}'" for b in BENIGN)})),
hits AS (SELECT DISTINCT conv_id, term FROM conversations JOIN t ON contains(lower(text), term)), mails AS (SELECT DISTINCT conv_id FROM conversations WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}'))
SELECT coalesce(h.conv_id, m.conv_id) AS file, coalesce(n, 0) AS terms, m.conv_id IS NOT NULL AS email FROM (SELECT conv_id, count(*) AS n FROM hits GROUP BY 1) h FULL JOIN mails m ON h.conv_id = m.conv_id""")
def leak_scan(spark, sf):
    """Words and pairs of words of the benchmark that conversations show, at any place."""
    texts = V.read(spark, sf, "conversations").select(F.col("conv_id").alias("file"), "text")
    terms = V.read(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(PHRASE), 1)).alias("term"))
    return A.leak_report(A.leaks(texts, terms, BENIGN))


@query("""SELECT length(term) AS length, count(*) AS terms FROM (SELECT DISTINCT trim(term) AS term FROM (SELECT company AS term FROM application UNION ALL SELECT role FROM application UNION ALL SELECT job_url FROM application
UNION ALL SELECT sender FROM evidence UNION ALL SELECT external_id FROM evidence)) WHERE length(term) >= 4 GROUP BY 1""")
def private_terms(spark, sf):
    tables = [(V.applications(spark, sf), ["company", "role", "job_url"]), (V.evidence(spark, sf), ["sender", "external_id"])]
    return A.stored_terms(tables).groupBy(F.length("term").alias("length")).agg(F.count("*").alias("terms"))


@query("SELECT 'evidence:' || coalesce(link_method, 'none') AS queue, count(*) AS n FROM evidence WHERE status = 'needs_review' GROUP BY 1 UNION ALL SELECT 'observation:' || source_key, count(*) FROM observation WHERE decision = 'needs_review' GROUP BY 1")
def review_workload(spark, sf):
    e = V.evidence(spark, sf).filter("status = 'needs_review'").select(F.lit("evidence").alias("kind"), F.coalesce("link_method", F.lit("none")).alias("category"))
    o = V.observations(spark, sf).filter("decision = 'needs_review'").select(F.lit("observation").alias("kind"), F.col("source_key").alias("category"))
    return A.workload(e.unionByName(o))


@query("""WITH e AS (SELECT DISTINCT CAST(id AS VARCHAR) AS item FROM evidence WHERE status = 'needs_review'), o AS (SELECT DISTINCT CAST(evidence_id AS VARCHAR) AS item FROM observation WHERE decision = 'needs_review' AND evidence_id IS NOT NULL)
SELECT 'evidence' AS kind, 'needs_review' AS category, count(*) AS n FROM e UNION ALL SELECT 'observation', 'needs_review', count(*) FROM o WHERE item NOT IN (SELECT item FROM e)""")
def review_plan(spark, sf):
    state = F.lit("needs_review").alias("category")
    e = V.evidence(spark, sf).filter("status = 'needs_review'").select(F.lit("evidence").alias("kind"), state, F.col("id").cast("string").alias("item"))
    o = V.observations(spark, sf).filter("decision = 'needs_review' AND evidence_id IS NOT NULL").select(F.lit("observation").alias("kind"), state, F.col("evidence_id").cast("string").alias("item"))
    return A.review_plan([e, o]).groupBy("kind", "category").agg(F.count("*").alias("n"))


@query("SELECT source, date_diff('minute', max(occurred_at), TIMESTAMP '2024-01-31') <= 1440 AS fresh FROM evidence GROUP BY 1")
def source_freshness(spark, sf):
    return A.freshness(V.evidence(spark, sf), V.EVENTS_AS_OF, 1440)


@query(f"SELECT id, company, role, source_portal, application_method, current_status, coalesce(job_url, '') AS job_url, strftime(applied_date, '%Y-%m-%dT%H:%M:%S') AS applied_date, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at, strftime(updated_at, '%Y-%m-%dT%H:%M:%S') AS updated_at FROM application WHERE {SEEN}")
def export_rows(spark, sf):
    return A.export_rows(V.applications(spark, sf))
