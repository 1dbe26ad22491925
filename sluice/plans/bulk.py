"""Bulk requests over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice import views as V
from sluice.operators import bulk as B
from sluice.plans.registry import query


def _request(spark, sf):
    """Of every event's user: withdrawn, or offered."""
    users = V.read(spark, sf, "events").select(F.col("user_id").alias("id")).distinct()
    return users.withColumn("status", V.choose(V.mod("id", 2), ["Withdrawn", "Offer"]))


REQUEST = "WITH req AS (SELECT DISTINCT user_id AS id, CASE user_id % 2 WHEN 0 THEN 'Withdrawn' ELSE 'Offer' END AS status FROM events)\n"


@query(REQUEST + "SELECT current_status, count(*) AS n FROM (SELECT coalesce(CASE WHEN record_state = 'active' THEN r.status END, current_status) AS current_status FROM application a LEFT JOIN req r USING (id)) GROUP BY 1")
def bulk_status(spark, sf):
    return B.set_status(V.applications(spark, sf), _request(spark, sf))[0].groupBy("current_status").agg(F.count("*").alias("n"))


@query(REQUEST + "SELECT from_status, to_status, count(*) AS n FROM (SELECT current_status AS from_status, r.status AS to_status FROM application a JOIN req r USING (id) WHERE record_state = 'active' AND current_status <> r.status) GROUP BY ALL")
def bulk_status_history(spark, sf):
    return B.set_status(V.applications(spark, sf), _request(spark, sf))[1].groupBy("from_status", "to_status").agg(F.count("*").alias("n"))


@query(REQUEST + "SELECT id FROM req WHERE id NOT IN (SELECT id FROM application WHERE record_state = 'active')")
def bulk_status_failed(spark, sf):
    return B.set_status(V.applications(spark, sf), _request(spark, sf))[2]


@query("SELECT current_status AS from_status, count(*) AS n FROM application WHERE record_state = 'active' AND current_status NOT IN ('Rejected', 'Withdrawn') AND company IN (SELECT c_name FROM customer WHERE c_nationkey = 7) GROUP BY 1")
def bulk_withdrawn(spark, sf):
    names = V.read(spark, sf, "customer").filter("c_nationkey = 7").select(F.upper("c_name").alias("company"))
    return B.withdraw_at(V.applications(spark, sf), names)[1].groupBy("from_status").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM evidence WHERE status IN ('unprocessed', 'processing') AND id NOT IN (SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY)")
def claimable_evidence(spark, sf):
    claims = V.read(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("claimed_at"))
    return B.refreshed(V.evidence(spark, sf), claims, V.EVENTS_AS_OF, 864000).agg(F.count("*").alias("n"))
