"""Observation batches as JSON lines: a strict schema, row checks, and a quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "source_key string, source_item_id string, company string, role string, applied_on date, status string, job_url string, proves_submission boolean, observed_at timestamp, _corrupt_record string"
# What a collector may say of an application.
STATUSES = ["applied", "viewed", "in_review", "shortlisted", "interview", "offer", "rejected", "withdrawn", "closed", "unknown"]
SOURCES = ["linkedin", "naukri", "indeed", "instahyre", "careernet"]
SOURCE = "^employer-[a-z0-9][a-z0-9-]{1,38}$"


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """One row per line; a line that isn't an object of the schema has _corrupt_record."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    return lines.select(F.from_json(column, SCHEMA, options).alias("o")).select("o.*")


def problems(as_of: str) -> Column:
    """The names of the checks that a row fails."""
    now = F.lit(as_of).cast("timestamp")
    at = F.col("observed_at")
    checks = {
        "not an object": F.col("_corrupt_record").isNotNull(),
        "no source": F.col("source_key").isNull() | ~(F.col("source_key").isin(SOURCES) | F.col("source_key").rlike(SOURCE)),
        "no company": F.trim(F.coalesce("company", F.lit(""))) == "",
        "unknown status": F.col("status").isNull() | ~F.col("status").isin(STATUSES),
        "applied after it was seen": F.col("applied_on") > F.to_date(at),
        "seen too early or in the future": at.isNull() | (at < now - F.expr("INTERVAL 400 DAYS")) | (at > now + F.expr("INTERVAL 5 MINUTES")),
        "unknown status proves nothing": (F.col("status") == "unknown") & F.col("proves_submission"),
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))


def split(rows: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad ones with their problems."""
    marked = rows.withColumn("problems", problems(as_of))
    return marked.filter(F.size("problems") == 0).drop("problems", "_corrupt_record"), marked.filter(F.size("problems") > 0)


def item_key() -> Column:
    """The site's own id of an item, or else a fingerprint of what names it."""
    text = lambda c: F.lower(F.coalesce(c, F.lit("")))
    named = F.sha2(F.concat_ws("\x1f", F.col("source_key"), text("company"), text("role"), F.coalesce(F.col("applied_on").cast("string"), F.lit(""))), 256)
    return F.when(F.coalesce("source_item_id", F.lit("")) != "", F.concat_ws(":", "source_key", "source_item_id")).otherwise(named)


def content_hash() -> Column:
    """SHA-256 of an observation's content, whenever it was seen; nulls count as such."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in ("source_key", "source_item_id", "company", "role", "applied_on", "status", "job_url", "proves_submission")]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)
