"""Requests over many records at once, each with what it could not do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.config import TERMINAL
from sluice.operators.predicates import active_record


def set_status(applications: DataFrame, request: DataFrame, trigger: str = "manual") -> tuple[DataFrame, DataFrame, DataFrame]:
    """New applications, the history rows that this adds, and the ids that failed. The
    request is (id, status); a person may set any status, back ones too."""
    known = request.join(applications.filter(active_record()).select("id", F.col("current_status").alias("from_status")), "id")
    failed = request.join(known.select("id"), "id", "left_anti").select("id")
    new = known.select("id", F.col("status").alias("_s"))
    out = applications.join(new, "id", "left").withColumn("current_status", F.coalesce("_s", "current_status")).drop("_s").select(applications.columns)
    added = known.filter("status <> from_status").select(F.col("id").alias("application_id"), "from_status", F.col("status").alias("to_status"), F.lit(trigger).alias("trigger"))
    return out, added, failed


def withdraw_at(applications: DataFrame, companies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Withdraws what is open at the companies, whatever the case of their names."""
    names = companies.select(F.lower("company").alias("k")).distinct()
    hit = applications.filter(active_record() & ~F.col("current_status").isin(TERMINAL)).join(names, F.lower("company") == F.col("k"), "left_semi")
    out, added, _ = set_status(applications, hit.select("id", F.lit("Withdrawn").alias("status")), "bulk")
    return out, added


def refreshed(evidence: DataFrame, claims: DataFrame, as_of: str, seconds: int = 600) -> DataFrame:
    """Evidence that a worker may claim: not processed, and not claimed in the last seconds."""
    held = claims.filter(F.col("claimed_at") >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(seconds)} SECONDS"))
    return evidence.filter(F.col("status").isin("unprocessed", "processing")).join(held.select("id"), "id", "left_anti")
