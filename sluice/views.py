"""The record model over the star-schema test tables: each view as a DataFrame and, for
the oracle, as SQL. Orders are applications, line items their status history, events
milestones and prospects, documents evidence, pages postings, conversations threads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The clocks of queries over orders and over events: never the wall clock.
AS_OF, EVENTS_AS_OF = "2001-08-01", "2024-01-31"
METHODS = ["Easy Apply", "Company Site", "Referral", "Email", "Unknown"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def choose(n: Column, values: list[str | None]) -> Column:
    """values[n], as a conditional that stays in generated code."""
    out = F.when(n == 0, F.lit(values[0]))
    for i, v in enumerate(values[1:], 1):
        out = out.when(n == i, F.lit(v))
    return out


def mod(column: str, n: int) -> Column:
    return F.pmod(F.col(column), F.lit(n))


def applications(spark: SparkSession, sf_dir: str, updated: bool = True) -> DataFrame:
    """updated: with updated_at, the latest of an application's line items; no other column needs them."""
    orders, id_ = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    status = (
        F.when(F.col("o_orderstatus") == "O", choose(mod("o_orderkey", 3), ["Applied", "Applied", "Resume Shortlisted"]))
        .when(F.col("o_orderstatus") == "P", choose(mod("o_orderkey", 4), ["Interview Scheduled", "Interview In Progress", "Offer Negotiation", "Offer"]))
        .otherwise(choose(mod("o_orderkey", 3), ["Rejected", "Withdrawn", "Joined"]))
    )
    merged = mod("o_orderkey", 40).isin(7, 8)
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey)
    if updated:
        shipped = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"))
        joined = joined.join(shipped, orders.o_orderkey == shipped.l_orderkey, "left")
    return joined.select(
        id_.alias("id"),
        F.col("c_name").alias("company"),
        F.col("o_orderpriority").alias("role"),
        F.col("c_mktsegment").alias("source_portal"),
        choose(mod("o_orderkey", 5), METHODS).alias("application_method"),
        F.col("o_orderdate").alias("applied_date"),
        (F.col("o_orderdate") + F.make_dt_interval(mod("o_orderkey", 21).cast("int"))).alias("created_at"),
        *([F.coalesce("shipped", "o_orderdate").alias("updated_at")] if updated else []),
        status.alias("current_status"),
        (mod("o_orderkey", 50) == 0).alias("is_false_positive"),
        F.when(merged, "merged").otherwise("active").alias("record_state"),
        F.when(merged, id_ - 1).alias("merged_into"),
        F.when(mod("o_orderkey", 9) < 4, F.format_string("https://jobs.example.com/view/%d", F.floor(id_ / 6))).alias("job_url"),
        F.when(mod("o_orderkey", 7) < 5, F.array(*[F.concat(F.lit("t-"), F.floor(id_ / k).cast("string")) for k in (2, 3)])).otherwise(F.array().cast("array<string>")).alias("thread_ids"),
    )


APPLICATION_SQL = """application AS (
  SELECT o_orderkey AS id, c_name AS company, o_orderpriority AS role, c_mktsegment AS source_portal,
    CASE o_orderkey % 5 WHEN 0 THEN 'Easy Apply' WHEN 1 THEN 'Company Site' WHEN 2 THEN 'Referral' WHEN 3 THEN 'Email' ELSE 'Unknown' END AS application_method,
    o_orderdate AS applied_date, o_orderdate + to_days(CAST(o_orderkey % 21 AS INTEGER)) AS created_at, coalesce(shipped, o_orderdate) AS updated_at,
    CASE o_orderstatus
      WHEN 'O' THEN CASE o_orderkey % 3 WHEN 2 THEN 'Resume Shortlisted' ELSE 'Applied' END
      WHEN 'P' THEN CASE o_orderkey % 4 WHEN 0 THEN 'Interview Scheduled' WHEN 1 THEN 'Interview In Progress' WHEN 2 THEN 'Offer Negotiation' ELSE 'Offer' END
      ELSE CASE o_orderkey % 3 WHEN 0 THEN 'Rejected' WHEN 1 THEN 'Withdrawn' ELSE 'Joined' END END AS current_status,
    o_orderkey % 50 = 0 AS is_false_positive, CASE WHEN o_orderkey % 40 IN (7, 8) THEN 'merged' ELSE 'active' END AS record_state,
    CASE WHEN o_orderkey % 40 IN (7, 8) THEN o_orderkey - 1 END AS merged_into,
    CASE WHEN o_orderkey % 9 < 4 THEN 'https://jobs.example.com/view/' || (o_orderkey // 6) END AS job_url,
    CASE WHEN o_orderkey % 7 < 5 THEN ['t-' || (o_orderkey // 2), 't-' || (o_orderkey // 3)] ELSE [] END AS thread_ids
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1) s ON l_orderkey = o_orderkey)"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status changes. Superseded ones carry the id of a merge."""
    lines = read(spark, sf_dir, "lineitem")
    kind = F.concat("l_returnflag", "l_linestatus")
    to = F.when(kind == "AF", "Resume Shortlisted").when(kind == "AO", "Interview Scheduled").when(kind == "NF", "Interview In Progress").when(kind == "NO", "Applied").when(kind == "RF", "Rejected").otherwise("Offer")
    live = (F.col("l_linenumber") == 1) & (F.col("l_quantity") >= 5)
    return lines.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
        F.col("l_orderkey").alias("application_id"),
        F.when(F.col("l_linestatus") == "F", "Applied").alias("from_status"),
        to.alias("to_status"),
        F.col("l_shipdate").alias("changed_at"),
        F.when(~live, F.lit(1).cast("long")).alias("superseded_by"),
        F.col("l_partkey").alias("message"),
    )


HISTORY_SQL = """history AS (
  SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey AS application_id, CASE WHEN l_linestatus = 'F' THEN 'Applied' END AS from_status,
    CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'Resume Shortlisted' WHEN 'AO' THEN 'Interview Scheduled' WHEN 'NF' THEN 'Interview In Progress' WHEN 'NO' THEN 'Applied' WHEN 'RF' THEN 'Rejected' ELSE 'Offer' END AS to_status,
    l_shipdate AS changed_at, CASE WHEN NOT (l_linenumber = 1 AND l_quantity >= 5) THEN 1 END AS superseded_by, l_partkey AS message
  FROM lineitem)"""


def milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    to = F.when(kind == "click", "Interview Scheduled").when(kind == "view", "Interview Attended").when(kind == "purchase", "Offer Received").when(kind == "error", "Rejected").otherwise("Application Submitted")
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("application_id"),
        to.alias("event_type"),
        F.col("ts").alias("occurred_at"),
        choose(mod("event_id", 3), ["Technical", "HR", None]).alias("interview_round"),
        F.when(mod("event_id", 10) == 0, F.lit(1).cast("long")).alias("superseded_by"),
        F.when(mod("event_id", 4) == 0, F.col("user_id") * 8 + 1).alias("history_id"),
    )


MILESTONE_SQL = """milestone AS (
  SELECT event_id AS id, user_id AS application_id,
    CASE event_type WHEN 'click' THEN 'Interview Scheduled' WHEN 'view' THEN 'Interview Attended' WHEN 'purchase' THEN 'Offer Received' WHEN 'error' THEN 'Rejected' ELSE 'Application Submitted' END AS event_type,
    ts AS occurred_at, CASE event_id % 3 WHEN 0 THEN 'Technical' WHEN 1 THEN 'HR' END AS interview_round,
    CASE WHEN event_id % 10 = 0 THEN 1 END AS superseded_by, CASE WHEN event_id % 4 = 0 THEN user_id * 8 + 1 END AS history_id
  FROM events)"""


def prospects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").filter("event_type = 'signup'").select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("received_at"),
        choose(mod("event_id", 4), ["new", "reviewed", "converted", "dismissed"]).alias("status"),
        F.when(F.col("value") > 60, F.col("user_id")).alias("application_id"),
    )


PROSPECT_SQL = """prospect AS (
  SELECT event_id AS id, ts AS received_at, CASE event_id % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'reviewed' WHEN 2 THEN 'converted' ELSE 'dismissed' END AS status,
    CASE WHEN value > 60 THEN user_id END AS application_id
  FROM events WHERE event_type = 'signup')"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages about applications: events again, with a decision each."""
    ev = read(spark, sf_dir, "events")
    status = choose(mod("event_id", 6), ["unprocessed", "processing", "linked", "needs_review", "ignored", "linked"])
    return ev.select(
        F.col("event_id").alias("id"),
        choose(mod("event_id", 3), ["gmail", "collector", "manual"]).alias("source"),
        F.concat(F.lit("x-"), F.floor(F.col("event_id") / 2).cast("string")).alias("external_id"),
        status.alias("status"),
        F.when(mod("event_id", 6).isin(2, 5), F.col("user_id")).alias("application_id"),
        choose(mod("event_id", 4), ["human", "resolver", "resolver", None]).alias("decided_by"),
        choose(mod("event_id", 5), ["thread", "external_job_id", "company_role", "sender", None]).alias("link_method"),
        (F.col("value") / 120).alias("confidence"),
        F.col("ts").alias("occurred_at"),
        F.concat(F.lit("recruit"), mod("user_id", 7).cast("string"), F.lit("@mail"), mod("event_id", 5).cast("string"), F.lit(".example.com")).alias("sender"),
    )


EVIDENCE_SQL = """evidence AS (
  SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'gmail' WHEN 1 THEN 'collector' ELSE 'manual' END AS source, 'x-' || (event_id // 2) AS external_id,
    CASE event_id % 6 WHEN 0 THEN 'unprocessed' WHEN 1 THEN 'processing' WHEN 3 THEN 'needs_review' WHEN 4 THEN 'ignored' ELSE 'linked' END AS status,
    CASE WHEN event_id % 6 IN (2, 5) THEN user_id END AS application_id, CASE event_id % 4 WHEN 0 THEN 'human' WHEN 3 THEN NULL ELSE 'resolver' END AS decided_by,
    CASE event_id % 5 WHEN 0 THEN 'thread' WHEN 1 THEN 'external_job_id' WHEN 2 THEN 'company_role' WHEN 3 THEN 'sender' END AS link_method,
    value / 120 AS confidence, ts AS occurred_at, 'recruit' || (user_id % 7) || '@mail' || (event_id % 5) || '.example.com' AS sender
  FROM events)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What collectors saw on a site: line items as sightings of a posting in a run."""
    line = read(spark, sf_dir, "lineitem")
    return line.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
        mod("l_suppkey", 20).alias("run_id"),
        F.concat(F.lit("item-"), F.col("l_partkey").cast("string")).alias("item_key"),
        choose(mod("l_suppkey", 4), ["linkedin", "indeed", "naukri", "employer-acme"]).alias("source_key"),
        F.col("l_returnflag").alias("status"),
        F.col("l_shipdate").alias("observed_at"),
        choose(mod("l_linenumber", 4), ["linked", "created", "needs_review", "unchanged"]).alias("decision"),
        F.when(mod("l_linenumber", 4) != 3, F.col("l_orderkey")).alias("evidence_id"),
    )


OBSERVATION_SQL = """observation AS (
  SELECT l_orderkey * 8 + l_linenumber AS id, l_suppkey % 20 AS run_id, 'item-' || l_partkey AS item_key,
    CASE l_suppkey % 4 WHEN 0 THEN 'linkedin' WHEN 1 THEN 'indeed' WHEN 2 THEN 'naukri' ELSE 'employer-acme' END AS source_key,
    l_returnflag AS status, l_shipdate AS observed_at, CASE l_linenumber % 4 WHEN 0 THEN 'linked' WHEN 1 THEN 'created' WHEN 2 THEN 'needs_review' ELSE 'unchanged' END AS decision,
    CASE WHEN l_linenumber % 4 <> 3 THEN l_orderkey END AS evidence_id
  FROM lineitem)"""

VIEWS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "application": (applications, APPLICATION_SQL),
    "history": (history, HISTORY_SQL),
    "milestone": (milestones, MILESTONE_SQL),
    "prospect": (prospects, PROSPECT_SQL),
    "evidence": (evidence, EVIDENCE_SQL),
    "observation": (observations, OBSERVATION_SQL),
}
