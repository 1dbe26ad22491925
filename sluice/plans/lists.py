"""List, lookup and count queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice import views as V
from sluice.operators import listing as L
from sluice.operators.predicates import live, outcome, stale, visible
from sluice.plans.insights import AS_OF, SEEN
from sluice.plans.registry import query

#: The milestone that a status implies.
MILESTONE_OF = {"Applied": "Application Submitted", "Resume Shortlisted": "Recruiter Response", "Interview Scheduled": "Interview Scheduled", "Interview In Progress": "Interview Attended", "Offer Negotiation": "Offer Received", "Offer": "Offer Received", "Joined": "Offer Received", "Rejected": "Rejected"}
STAMP = "yyyy-MM-dd HH:mm:ss"


def stamp(column: str, name: str | None = None):
    return F.date_format(column, STAMP).alias(name or column)


BRIEF = ["id", "company", "role", "source_portal", "current_status"]


@query("SELECT id, company, role, source_portal, current_status FROM application WHERE record_state = 'active' ORDER BY id LIMIT 50 OFFSET 50")
def list_page(spark, sf):
    return L.page(L.filtered(V.applications(spark, sf), V.milestones(spark, sf), L.ApplicationFilter(V.AS_OF)), "id", number=2).select(BRIEF)


@query("SELECT count(*) AS n FROM application WHERE record_state = 'active' AND current_status = 'Applied' AND source_portal = 'BUILDING' AND application_method = 'Referral' AND applied_date BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2000-12-31'")
def list_equality_count(spark, sf):
    by = L.ApplicationFilter(V.AS_OF, status="Applied", portal="BUILDING", method="Referral", date_from="1996-01-01", date_to="2000-12-31")
    return L.filtered(V.applications(spark, sf), V.milestones(spark, sf), by).agg(F.count("*").alias("n"))


@query("SELECT id, company, role, source_portal, current_status FROM application WHERE record_state = 'active' AND (company ILIKE '%00001%' OR role ILIKE '%urgent%')")
def list_search(spark, sf):
    apps, events = V.applications(spark, sf), V.milestones(spark, sf)
    one = L.filtered(apps, events, L.ApplicationFilter(V.AS_OF, search="00001")).select(BRIEF)
    return one.unionByName(L.filtered(apps, events, L.ApplicationFilter(V.AS_OF, search="URGENT")).select(BRIEF)).distinct()


@query(f"SELECT current_status = 'Applied' AND updated_at < {AS_OF} - INTERVAL 14 DAY AS is_stale, count(*) AS n FROM application WHERE record_state = 'active' GROUP BY 1")
def list_stale_split(spark, sf):
    apps, events = V.applications(spark, sf), V.milestones(spark, sf)
    parts = [L.filtered(apps, events, L.ApplicationFilter(V.AS_OF, stale=s)).select(F.lit(s).alias("is_stale")) for s in (True, False)]
    return parts[0].unionByName(parts[1]).groupBy("is_stale").agg(F.count("*").alias("n"))


@query("SELECT id, company, role, source_portal, current_status FROM application WHERE record_state = 'active' AND id IN (SELECT application_id FROM milestone WHERE event_type = 'Interview Attended')")
def list_interviewed(spark, sf):
    return L.filtered(V.applications(spark, sf), V.milestones(spark, sf), L.ApplicationFilter(V.AS_OF, interviewed=True)).select(BRIEF)


@query("SELECT count(*) AS n FROM application WHERE record_state = 'active' AND id NOT IN (SELECT application_id FROM milestone WHERE event_type = 'Interview Attended')")
def list_not_interviewed(spark, sf):
    return L.filtered(V.applications(spark, sf), V.milestones(spark, sf), L.ApplicationFilter(V.AS_OF, interviewed=False)).agg(F.count("*").alias("n"))


@query("""SELECT count(*) FILTER (current_status IN ('Offer', 'Joined')) AS offer, count(*) FILTER (current_status = 'Rejected') AS rejected, count(*) FILTER (current_status = 'Withdrawn') AS withdrawn,
  count(*) FILTER (current_status IN ('Applied', 'Resume Shortlisted', 'Interview Scheduled', 'Interview In Progress', 'Offer Negotiation')) AS active, count(*) AS anything FROM application WHERE record_state = 'active'""")
def list_outcomes(spark, sf):
    apps = V.applications(spark, sf).filter("record_state = 'active'")
    return apps.agg(*[F.count_if(outcome(o)).alias(o) for o in ("offer", "rejected", "withdrawn", "active", "anything")])


@query("SELECT id, company, role, source_portal, current_status FROM application WHERE record_state = 'active' AND id IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def lookup_by_ids(spark, sf):
    wanted = V.milestones(spark, sf).filter("event_type = 'Offer Received'").select(F.col("application_id").alias("id"))
    return L.by_ids(V.applications(spark, sf), wanted).select(BRIEF)


@query(f"SELECT count(*) AS n FROM (SELECT *, nullif(company, 'Customer#000000001') AS c FROM application) WHERE {SEEN} AND (c IS NULL OR role IS NULL)")
def missing_field_count(spark, sf):
    return L.missing_fields(V.applications(spark, sf).withColumn("company", F.nullif("company", F.lit("Customer#000000001")))).agg(F.count("*").alias("n"))


@query("SELECT id, status, strftime(received_at, '%Y-%m-%d %H:%M:%S') AS received_at FROM prospect WHERE status = 'new' ORDER BY prospect.received_at DESC, id DESC LIMIT 100")
def prospect_page(spark, sf):
    return V.prospects(spark, sf).filter("status = 'new'").orderBy(F.desc("received_at"), F.desc("id")).limit(100).select("id", "status", stamp("received_at"))


@query("SELECT id, source, status, strftime(occurred_at, '%Y-%m-%d %H:%M:%S') AS occurred_at FROM evidence WHERE status <> 'ignored' AND source = 'gmail' AND application_id IS NULL ORDER BY evidence.occurred_at DESC, id DESC LIMIT 100")
def evidence_page(spark, sf):
    found = V.evidence(spark, sf).filter(L.EvidenceFilter(source="gmail", linked=False).predicate())
    return L.page(found, F.desc("occurred_at"), F.desc("id"), size=100).select("id", "source", "status", stamp("occurred_at"))


@query("SELECT application_id, to_status, count(*) AS n, strftime(max(changed_at), '%Y-%m-%d') AS last FROM history WHERE superseded_by IS NULL AND application_id IN (SELECT id FROM application WHERE record_state = 'active' AND NOT is_false_positive) GROUP BY 1, 2")
def history_of_visible(spark, sf):
    apps = V.applications(spark, sf).filter(visible()).select(F.col("id").alias("application_id"))
    return V.history(spark, sf).filter(live()).join(apps, "application_id", "left_semi").groupBy("application_id", "to_status").agg(F.count("*").alias("n"), F.date_format(F.max("changed_at"), "yyyy-MM-dd").alias("last"))


@query("SELECT id, application_id, event_type, coalesce(interview_round, '') AS interview_round, strftime(occurred_at, '%Y-%m-%d %H:%M:%S') AS occurred_at FROM milestone WHERE superseded_by IS NULL AND application_id = 7")
def milestones_of_one(spark, sf):
    return V.milestones(spark, sf).filter(live() & (F.col("application_id") == 7)).select("id", "application_id", "event_type", F.coalesce("interview_round", F.lit("")).alias("interview_round"), stamp("occurred_at"))


@query("SELECT count(*) FILTER (status <> 'ignored') AS total, count(*) FILTER (status <> 'ignored' AND application_id IS NULL) AS unlinked, count(*) FILTER (status = 'needs_review') AS needs_review FROM evidence")
def evidence_totals(spark, sf):
    return L.evidence_totals(V.evidence(spark, sf))


@query("SELECT 'status' AS dimension, coalesce(status, 'none') AS value, count(*) AS n FROM evidence GROUP BY 2 UNION ALL SELECT 'decided_by', coalesce(decided_by, 'none'), count(*) FROM evidence GROUP BY 2 UNION ALL SELECT 'link_method', coalesce(link_method, 'none'), count(*) FROM evidence GROUP BY 2")
def evidence_decision_counts(spark, sf):
    return L.grouped_counts(V.evidence(spark, sf), ["status", "decided_by", "link_method"])


@query("SELECT DISTINCT 'portal' AS kind, source_portal AS value FROM application WHERE record_state = 'active' AND source_portal <> '' UNION SELECT DISTINCT 'method', application_method FROM application WHERE record_state = 'active' AND application_method <> ''")
def taxonomy(spark, sf):
    return L.taxonomy(V.applications(spark, sf))


@query("""WITH RECURSIVE hop AS (SELECT id, id AS now, 0 AS n FROM application UNION ALL SELECT h.id, a.merged_into, n + 1 FROM hop h JOIN application a ON a.id = h.now WHERE a.record_state = 'merged' AND n < 10),
last AS (SELECT id, arg_max(now, n) AS now FROM hop GROUP BY 1)
SELECT l.id, a.id AS survivor FROM last l LEFT JOIN (SELECT id FROM application WHERE record_state = 'active') a ON a.id = l.now WHERE l.id <> l.now""")
def merged_survivors(spark, sf):
    apps = V.applications(spark, sf)
    gone = apps.filter("record_state = 'merged'").select("id")
    return L.survivors(apps).join(gone, "id", "left_semi")


@query("""WITH t AS (SELECT DISTINCT 't-' || conv_id AS thread_id FROM conversations), x AS (SELECT unnest(thread_ids) AS thread_id, id FROM application), f AS (SELECT thread_id, min(id) AS id FROM x WHERE thread_id IN (SELECT thread_id FROM t) GROUP BY 1)
SELECT thread_id, CASE WHEN a.record_state = 'active' THEN a.id WHEN b.record_state = 'active' THEN b.id WHEN c.record_state = 'active' THEN c.id END AS application_id
FROM f JOIN application a USING (id) LEFT JOIN application b ON b.id = a.merged_into LEFT JOIN application c ON c.id = b.merged_into""")
def threads_to_applications(spark, sf):
    threads = V.read(spark, sf, "conversations").select(F.concat(F.lit("t-"), F.col("conv_id").cast("string")).alias("thread_id")).distinct()
    return L.by_thread(V.applications(spark, sf), threads)


@query("SELECT count(*) AS links, count(DISTINCT thread_id) AS threads, count(DISTINCT id) AS applications FROM (SELECT unnest(thread_ids) AS thread_id, id FROM application WHERE record_state = 'active')")
def thread_index(spark, sf):
    links = V.applications(spark, sf).filter("record_state = 'active'").select("id", F.explode("thread_ids").alias("thread_id"))
    return links.agg(F.count("*").alias("links"), F.count_distinct("thread_id").alias("threads"), F.count_distinct("id").alias("applications"))


@query("SELECT a.id, strftime(max(occurred_at), '%Y-%m-%d %H:%M:%S') AS last_evidence_at FROM application a LEFT JOIN evidence e ON e.application_id = a.id GROUP BY 1")
def last_evidence_at(spark, sf):
    return L.last_evidence(V.applications(spark, sf), V.evidence(spark, sf)).select("id", stamp("last_evidence_at"))


@query("""SELECT application_id, array_to_string(list_sort(list_distinct(list(split_part(sender, '@', 2)))), ',') AS domains,
  coalesce(array_to_string(list_sort(list_distinct(list(sender) FILTER (decided_by = 'human'))), ','), '') AS human_senders,
  coalesce(array_to_string(list_sort(list_distinct(list(sender) FILTER (decided_by = 'resolver'))), ','), '') AS resolver_senders FROM evidence WHERE application_id IS NOT NULL GROUP BY 1""")
def evidence_identities(spark, sf):
    found = L.identities(V.evidence(spark, sf))
    return found.select("application_id", *[F.array_join(c, ",").alias(c) for c in ("domains", "human_senders", "resolver_senders")])


@query("SELECT count(*) AS processed, count(DISTINCT item_key) AS items, count(DISTINCT run_id) AS runs, count(*) FILTER (decision = 'linked') AS linked, count(*) FILTER (decision = 'created') AS created, count(*) FILTER (decision = 'needs_review') AS review, count(*) FILTER (decision = 'unchanged') AS unchanged, count(evidence_id) AS with_evidence FROM observation")
def collection_metrics(spark, sf):
    return L.collection_metrics(V.observations(spark, sf))


@query("SELECT source_key, count(*) AS processed, count(DISTINCT item_key) AS items FROM observation WHERE run_id IN (SELECT s_suppkey % 20 FROM supplier WHERE s_nationkey < 5) GROUP BY 1")
def collector_metrics_by_source(spark, sf):
    runs = V.read(spark, sf, "supplier").filter("s_nationkey < 5").select(V.mod("s_suppkey", 20).alias("run_id"))
    return V.observations(spark, sf).join(runs, "run_id", "left_semi").groupBy("source_key").agg(F.count("*").alias("processed"), F.count_distinct("item_key").alias("items"))


@query("SELECT o.id, o.run_id, o.item_key FROM (SELECT DISTINCT id, run_id, item_key, evidence_id FROM observation WHERE decision = 'needs_review') o JOIN evidence e ON e.id = o.evidence_id WHERE e.status = 'needs_review' ORDER BY o.id DESC, o.run_id DESC, o.item_key DESC LIMIT 100")
def review_observations(spark, sf):
    waiting = V.evidence(spark, sf).filter("status = 'needs_review'").select(F.col("id").alias("evidence_id"))
    seen = V.observations(spark, sf).filter("decision = 'needs_review'").select("id", "run_id", "item_key", "evidence_id").distinct()
    return seen.join(waiting, "evidence_id", "left_semi").orderBy(F.desc("id"), F.desc("run_id"), F.desc("item_key")).limit(100).select("id", "run_id", "item_key")


@query("SELECT item_key, count(*) AS sightings, strftime(max(observed_at), '%Y-%m-%d') AS seen_at FROM observation GROUP BY 1")
def item_latest(spark, sf):
    return L.latest_items(V.observations(spark, sf)).select("item_key", "sightings", F.date_format("seen_at", "yyyy-MM-dd").alias("seen_at"))


@query("SELECT p_brand AS source, count(o.item_key) AS items FROM part LEFT JOIN (SELECT DISTINCT item_key FROM observation) o ON o.item_key = 'item-' || p_partkey GROUP BY 1")
def source_item_counts(spark, sf):
    items = V.observations(spark, sf).select("item_key").distinct()
    parts = V.read(spark, sf, "part").select("p_brand", F.concat(F.lit("item-"), F.col("p_partkey").cast("string")).alias("key"))
    return parts.join(items, parts.key == items.item_key, "left").groupBy(F.col("p_brand").alias("source")).agg(F.count("item_key").alias("items"))


@query("""WITH m AS (SELECT id AS history_id, application_id, changed_at, CASE to_status WHEN 'Applied' THEN 'Application Submitted' WHEN 'Resume Shortlisted' THEN 'Recruiter Response' WHEN 'Joined' THEN 'Offer Received' WHEN 'Interview In Progress' THEN 'Interview Attended' WHEN 'Offer Negotiation' THEN 'Offer Received' WHEN 'Offer' THEN 'Offer Received' WHEN 'Withdrawn' THEN NULL ELSE to_status END AS event_type FROM history WHERE superseded_by IS NULL)
SELECT event_type, count(*) AS n FROM m WHERE event_type IS NOT NULL AND history_id NOT IN (SELECT history_id FROM milestone WHERE history_id IS NOT NULL) GROUP BY 1""")
def missing_milestones(spark, sf):
    return L.missing_milestones(V.history(spark, sf), V.milestones(spark, sf), MILESTONE_OF).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT application_id, count(*) > 0 AS has_attended FROM milestone WHERE event_type = 'Interview Attended' GROUP BY 1")
def milestone_probe(spark, sf):
    return V.milestones(spark, sf).filter("event_type = 'Interview Attended'").groupBy("application_id").agg((F.count("*") > 0).alias("has_attended"))


@query("""WITH w AS (SELECT lower(c_name) AS company, c_custkey % 5 AS k FROM customer WHERE c_nationkey = 3), r AS (SELECT *, row_number() OVER (PARTITION BY lower(company), lower(role) ORDER BY created_at DESC, id DESC) AS rn FROM application WHERE record_state = 'active')
SELECT r.id, r.company, r.role FROM r WHERE rn = 1 AND lower(company) IN (SELECT company FROM w)""")
def match_company_role(spark, sf):
    wanted = V.read(spark, sf, "customer").filter("c_nationkey = 3").select(F.lower("c_name").alias("key"))
    apps = V.applications(spark, sf).filter("record_state = 'active'").withColumns({"key": F.lower("company"), "key2": F.lower("role")}).join(wanted, "key", "left_semi")
    return L.newest_by(apps, ["key", "key2"], F.desc("created_at"), F.desc("id")).select("id", "company", "role")


@query("SELECT id, company, role, source_portal, current_status FROM application WHERE record_state = 'active' AND current_status NOT IN ('Rejected', 'Withdrawn') AND lower(company) IN (SELECT lower(c_name) FROM customer WHERE c_acctbal > 9000)")
def open_at_companies(spark, sf):
    names = V.read(spark, sf, "customer").filter("c_acctbal > 9000").select(F.col("c_name").alias("company"))
    return L.at_companies(V.applications(spark, sf), names).select(BRIEF)


@query("SELECT count(*) AS n FROM application WHERE record_state = 'active' AND starts_with(lower(company), 'customer#0000000')")
def company_prefix(spark, sf):
    return L.with_prefix(V.applications(spark, sf), "Customer#0000000").agg(F.count("*").alias("n"))


@query("SELECT (SELECT count(*) FROM orders) AS applications, (SELECT count(*) FROM events) AS processed")
def table_counts(spark, sf):
    a = V.read(spark, sf, "orders").agg(F.count("*").alias("applications"))
    return a.crossJoin(V.read(spark, sf, "events").agg(F.count("*").alias("processed")))  # one row each


@query("SELECT user_id, ts_s, admitted FROM (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts_s, count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS admitted FROM events) WHERE admitted > 3")
def sliding_hits(spark, sf):
    from pyspark.sql import Window

    hits = V.read(spark, sf, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts_s"))
    w = Window.partitionBy("user_id").orderBy("ts_s").rangeBetween(-86400, 0)
    return hits.withColumn("admitted", F.count("*").over(w)).filter("admitted > 3")
