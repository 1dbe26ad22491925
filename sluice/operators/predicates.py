"""Predicates that most queries share, as Columns."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.config import ACTIVE, OFFERED, STALE_DAYS

OUTCOMES = {"offer": OFFERED, "rejected": ["Rejected"], "withdrawn": ["Withdrawn"], "active": ACTIVE}


def clock(as_of: str | datetime) -> Column:
    return F.lit(str(as_of)).cast("timestamp_ntz")


def days_before(as_of: str | datetime, days: int) -> Column:
    return clock(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")


def active_record() -> Column:
    return F.col("record_state") == "active"


def visible() -> Column:
    """Active and no false positive: what analytics see."""
    return active_record() & ~F.col("is_false_positive")


def live() -> Column:
    """History or milestones that no merge has superseded."""
    return F.col("superseded_by").isNull()


def stale(as_of: str | datetime, days: int = STALE_DAYS) -> Column:
    return (F.col("current_status") == "Applied") & (F.col("updated_at") < days_before(as_of, days))


def outcome(name: str | None) -> Column:
    """Unknown outcomes don't filter."""
    return F.col("current_status").isin(OUTCOMES[name]) if name in OUTCOMES else F.lit(True)


def mentions(text: str) -> Column:
    """Company or role has the text in it, whatever its case; % and _ match anything."""
    return F.col("company").ilike(f"%{text}%") | F.col("role").ilike(f"%{text}%")


def or_unknown(column: str) -> Column:
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("Unknown"))
