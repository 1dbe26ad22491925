"""Reports over applications, their status history, milestones and prospects. Every
report takes its clock as an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.config import CONVERSION_MONTHS, GREEN_RATE, INTERVIEWED, MATURITY_DAYS, MIN_APPLICATIONS, OFFERED, PULSE_WINDOWS, RESPONDED, SHORTLISTED, STATUSES, TERMINAL
from sluice.operators.predicates import clock, days_before, live, or_unknown, stale, visible


def values(like: DataFrame, name: str, of: list[str]) -> DataFrame:
    """A small dimension (name, place) in its order."""
    return like.sparkSession.createDataFrame([(v, i) for i, v in enumerate(of)], f"{name} string, place int")


def reached(history: DataFrame) -> DataFrame:
    """Per application what its live history has reached; one row each, so that a join
    with applications never multiplies them."""
    to = F.col("to_status")
    flag = lambda of: F.bool_or(to.isin(of))
    return history.filter(live()).groupBy("application_id").agg(
        flag(SHORTLISTED).alias("h_short"), flag(INTERVIEWED).alias("h_int"), flag(OFFERED).alias("h_offer"), flag(RESPONDED).alias("h_resp"),
        F.min(F.when(to.isin(RESPONDED), F.col("changed_at"))).alias("first_response"),
    )


def staged(applications: DataFrame, history: DataFrame) -> DataFrame:
    """Visible applications with the stages they ever reached: by current status or history."""
    now = F.col("current_status")
    ever = lambda of, flag: now.isin(of) | F.coalesce(F.col(flag), F.lit(False))
    apps = applications.filter(visible())
    return apps.join(reached(history), apps.id == F.col("application_id"), "left").select(
        apps["*"], "first_response", ever(SHORTLISTED, "h_short").alias("ever_short"), ever(INTERVIEWED, "h_int").alias("ever_int"), ever(OFFERED, "h_offer").alias("ever_offer"), ever(RESPONDED, "h_resp").alias("ever_resp"),
    )


def funnel(applications: DataFrame) -> DataFrame:
    """Applications per current status; every status has a row."""
    counts = applications.filter(visible()).groupBy("current_status").agg(F.count("*").alias("n"))
    return F.broadcast(values(applications, "current_status", STATUSES)).join(counts, "current_status", "left").select("current_status", F.coalesce("n", F.lit(0)).alias("applications"))


def channel_stats(applications: DataFrame, history: DataFrame, field: str) -> DataFrame:
    """Per value of a field: totals by current status, responses by history too, median
    days to the first response, rates and the confidence of the sample."""
    now = F.col("current_status")
    elapsed = F.greatest(F.lit(0.0), F.timestamp_diff("SECOND", "applied_date", "first_response") / F.lit(86400.0))
    n, interviewed = F.col("total"), F.col("interviewed")
    return (
        staged(applications, history).groupBy(or_unknown(field).alias("channel"))
        .agg(F.count("*").alias("total"), F.count_if(now.isin(SHORTLISTED)).alias("shortlisted"), F.count_if(now.isin(INTERVIEWED)).alias("interviewed"), F.count_if(now.isin(OFFERED)).alias("offered"), F.count_if("ever_resp").alias("responded"), F.median(elapsed).alias("median_response_days"))
        .select(
            "*", (interviewed / n).alias("interview_rate"), (F.col("offered") / n).alias("offer_rate"), (F.col("responded") / n).alias("response_rate"), F.try_divide(n.cast("double"), interviewed).alias("applications_per_interview"),
            F.when(n < 15, "low").when(n < 30, "medium").otherwise("high").alias("confidence"),
        )
    )


def channel_flags(stats: DataFrame) -> DataFrame:
    """A flag and a message per channel."""
    n, rate = F.col("total"), F.col("interview_rate")
    percent = F.bround(rate * 100, 0).cast("int")
    few, green, red = n < 15, rate > GREEN_RATE, rate == 0
    return stats.select(
        "channel", F.when(few, "neutral").when(green, "green").when(red, "red").otherwise("neutral").alias("flag"),
        F.when(few, F.format_string("%s has only %d applications — collect at least 15 before changing strategy.", "channel", "total"))
        .when(green, F.format_string("%s is converting at %d%% interview rate — prioritize this channel.", F.col("channel"), percent))
        .when(red, F.format_string("No responses from %s after %d applications — consider reducing volume here.", "channel", "total"))
        .otherwise(F.format_string("%s has a %d%% interview rate.", F.col("channel"), percent)).alias("message"),
    )


def stage_and_outcome(as_of: str) -> tuple[Column, Column]:
    now = F.col("current_status")
    stage = F.when(F.col("ever_int"), "Interview").when(F.col("ever_short"), "Shortlisted").otherwise("Applied")
    end = F.when(now == "Rejected", "Rejected").when(now == "Withdrawn", "Withdrawn")
    end = end.when(F.col("ever_int") & F.col("ever_offer"), "Offer / Joined").when(~F.col("ever_int") & ~F.col("ever_short") & stale(as_of), "Stale").otherwise("Active")
    return stage, end


def flow_cells(applications: DataFrame, history: DataFrame, as_of: str) -> DataFrame:
    """(stage, outcome, applications, offered): the furthest broad stage against the
    outcome; offered counts those that ever had an offer."""
    stage, end = stage_and_outcome(as_of)
    return staged(applications, history).select(stage.alias("stage"), end.alias("outcome"), "ever_offer").groupBy("stage", "outcome").agg(F.count("*").alias("applications"), F.count_if("ever_offer").alias("offered"))


def _cell(stage: str | None, outcome: str | None) -> Column:
    hit = F.lit(True)
    if stage:
        hit &= F.col("stage") == stage
    if outcome:
        hit &= F.col("outcome") == outcome
    return F.coalesce(F.sum(F.when(hit, F.col("applications"))), F.lit(0))


def flow_totals(cells: DataFrame) -> DataFrame:
    """One row of all counters. An application that was offered and then rejected or
    withdrawn counts as offered and as that, so stage totals can exceed the number of
    applications; `interview_distinct` and `shortlisted_distinct` count each once."""
    offered = F.coalesce(F.sum("offered"), F.lit(0))
    one = cells.agg(
        _cell(None, None).alias("total"), offered.alias("offered"),
        *[_cell(s, o).alias(f"{s}_{o}".lower().replace(" / joined", "")) for s in ("Applied", "Shortlisted", "Interview") for o in ("Rejected", "Withdrawn", "Active", "Stale")],
        _cell("Interview", None).alias("interview_distinct"), (_cell("Interview", None) + _cell("Shortlisted", None)).alias("shortlisted_distinct"),
    )
    one = one.withColumn("interview_total", F.expr("offered + interview_rejected + interview_withdrawn + interview_active"))
    return one.withColumn("shortlisted_total", F.expr("interview_total + shortlisted_rejected + shortlisted_withdrawn + shortlisted_active"))


# Links of the flow chart and the counter of each.
LINKS = [
    ("Applied", "Shortlisted", "shortlisted_total"), ("Applied", "Rejected", "applied_rejected"), ("Applied", "Withdrawn", "applied_withdrawn"), ("Applied", "Active", "applied_active"), ("Applied", "Stale", "applied_stale"),
    ("Shortlisted", "Interview", "interview_total"), ("Shortlisted", "Rejected", "shortlisted_rejected"), ("Shortlisted", "Withdrawn", "shortlisted_withdrawn"), ("Shortlisted", "Active", "shortlisted_active"),
    ("Interview", "Offer / Joined", "offered"), ("Interview", "Rejected", "interview_rejected"), ("Interview", "Withdrawn", "interview_withdrawn"), ("Interview", "Active", "interview_active"),
]
NODES = [
    ("Applied", "total"), ("Shortlisted", "shortlisted_total"), ("Interview", "interview_total"), ("Offer / Joined", "offered"), ("Rejected", "applied_rejected + shortlisted_rejected + interview_rejected"),
    ("Withdrawn", "applied_withdrawn + shortlisted_withdrawn + interview_withdrawn"), ("Active", "applied_active + shortlisted_active + interview_active"), ("Stale", "applied_stale"),
]


def flow_links(totals: DataFrame) -> DataFrame:
    """(source, target, value) where value isn't 0."""
    rows = ", ".join(f"'{a}', '{b}', {c}" for a, b, c in LINKS)
    return totals.select(F.expr(f"stack({len(LINKS)}, {rows}) AS (source, target, value)")).filter("value <> 0")


def flow_nodes(totals: DataFrame) -> DataFrame:
    rows = ", ".join(f"'{a}', {c}" for a, c in NODES)
    return totals.select(F.expr(f"stack({len(NODES)}, {rows}) AS (node, applications)"))


def search_pulse(applications: DataFrame, history: DataFrame, as_of: str, window_days: int = 28, maturity_days: int = MATURITY_DAYS) -> DataFrame:
    """One row: recent activity, and a cohort of the same length that has matured."""
    if window_days not in PULSE_WINDOWS:
        raise ValueError(f"window_days must be one of {PULSE_WINDOWS}")
    applied, created = F.col("applied_date"), F.col("created_at")
    start = days_before(as_of, window_days)
    recent, captured = applied.between(start, clock(as_of)), created.between(start, clock(as_of))
    matured = (applied >= days_before(as_of, window_days + maturity_days)) & (applied < days_before(as_of, maturity_days))
    counts = staged(applications, history).agg(
        F.count_if(recent).alias("recent_applications"), F.count_if(captured).alias("recent_captured"), F.count_if(recent & F.col("ever_int")).alias("recent_interviews"), F.count_if(recent & F.col("ever_offer")).alias("recent_offers"),
        F.count_if(captured & (F.datediff(created, applied) > 7)).alias("late_imports"), F.count_if(matured).alias("matured_applications"), F.count_if(matured & F.col("ever_resp")).alias("responses"),
        F.count_if(matured & F.col("ever_short")).alias("shortlisted"), F.count_if(matured & F.col("ever_int")).alias("interviewed"), F.count_if(matured & F.col("ever_offer")).alias("offered"),
    )
    rate = lambda c: F.try_divide(F.col(c).cast("double"), "matured_applications").alias(f"{c}_rate")
    return counts.select("*", rate("responses"), rate("shortlisted"), rate("interviewed"), rate("offered"))


def weekly_activity(applications: DataFrame, as_of: str, weeks: int = 12) -> DataFrame:
    """Applied and captured per week from Monday; every week has a row."""
    this = F.date_trunc("week", clock(as_of)).cast("date")
    calendar = applications.sparkSession.range(weeks).select(F.date_add(this, (F.col("id") - (weeks - 1)).cast("int") * 7).alias("week"))
    seen = applications.filter(visible()).select(F.explode(F.array(F.struct(F.col("applied_date").alias("at"), F.lit(1).alias("applied"), F.lit(0).alias("captured")), F.struct(F.col("created_at").alias("at"), F.lit(0).alias("applied"), F.lit(1).alias("captured")))).alias("e"))
    counts = seen.filter(F.col("e.at") >= days_before(as_of, 7 * weeks + 7)).groupBy(F.date_trunc("week", "e.at").cast("date").alias("week")).agg(F.sum("e.applied").alias("a"), F.sum("e.captured").alias("c"))
    return calendar.join(F.broadcast(counts), "week", "left").select("week", F.coalesce("a", F.lit(0)).alias("applied"), F.coalesce("c", F.lit(0)).alias("captured"))


def attended(applications: DataFrame, milestones: DataFrame, as_of: str, months: int) -> DataFrame:
    """Live attended interviews of visible applications within months of 30 days."""
    if months not in CONVERSION_MONTHS:
        raise ValueError(f"months must be one of {CONVERSION_MONTHS}")
    recent = milestones.filter(live() & (F.col("event_type") == "Interview Attended") & (F.col("occurred_at") >= days_before(as_of, 30 * months)))
    return recent.join(applications.filter(visible()).select(F.col("id").alias("application_id")), "application_id", "left_semi")


def interviewed_applications(applications: DataFrame, milestones: DataFrame, as_of: str, months: int) -> DataFrame:
    apps = applications.filter(visible())
    return apps.join(attended(applications, milestones, as_of, months).select(F.col("application_id").alias("id")), "id", "left_semi")


def conversion(applications: DataFrame, milestones: DataFrame, prospects: DataFrame, as_of: str, months: int = 6) -> DataFrame:
    """One row: attended interviews, outcomes of those interviewed, and how prospects fared."""
    now = F.col("current_status")
    events = attended(applications, milestones, as_of, months)
    apps = applications.filter(visible()).select("id", "current_status")
    by_app = events.groupBy(F.col("application_id").alias("id")).agg(F.count("*").alias("attended"))
    outcomes = by_app.join(apps, "id").agg(
        F.coalesce(F.sum("attended"), F.lit(0)).alias("attended_events"), F.count("*").alias("interviewed_applications"), F.count_if(now.isin(OFFERED)).alias("offers"), F.count_if(now == "Rejected").alias("rejections"),
        F.count_if(now == "Withdrawn").alias("withdrawals"), F.count_if(~now.isin(*OFFERED, *TERMINAL)).alias("active"),
    )
    recent = prospects.filter(F.col("received_at") >= days_before(as_of, 30 * months)).select(F.col("application_id").alias("id"))
    funnel_ = recent.join(apps, "id", "left").join(by_app.withColumn("met", F.lit(True)), "id", "left").agg(
        F.count("*").alias("received"), F.count("current_status").alias("converted"), F.count_if(now.isNotNull() & F.col("met")).alias("converted_to_interview"), F.count_if(now.isin(OFFERED)).alias("converted_to_offer"),
    )
    return outcomes.crossJoin(funnel_)  # one row each


def interview_breakdown(applications: DataFrame, milestones: DataFrame, as_of: str, field: str, months: int = 6) -> DataFrame:
    now = F.col("current_status")
    return interviewed_applications(applications, milestones, as_of, months).groupBy(or_unknown(field).alias("name")).agg(
        F.count("*").alias("interviewed_applications"), F.count_if(now.isin(OFFERED)).alias("offers"), F.count_if(now == "Rejected").alias("rejections"), (F.count_if(now.isin(OFFERED)) / F.count("*")).alias("offer_rate"),
    )


def rejection_totals(applications: DataFrame) -> DataFrame:
    """Resolved counts offers too."""
    now = F.col("current_status")
    one = applications.filter(visible()).agg(F.count("*").alias("total"), F.count_if(now == "Rejected").alias("rejected"), F.count_if(now == "Withdrawn").alias("withdrawn"), F.count_if(now.isin(OFFERED)).alias("offered"))
    resolved = F.expr("rejected + withdrawn + offered")
    rate = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    return one.select("total", "rejected", "withdrawn", resolved.alias("resolved"), rate(F.col("rejected"), resolved).alias("rejection_rate"), rate(F.col("withdrawn"), F.col("total")).alias("withdrawal_rate"), rate(F.expr("rejected + withdrawn"), resolved).alias("non_offer_rate"), (F.expr("rejected + withdrawn") < 3).alias("insufficient_data"))


def rejection_stages(applications: DataFrame, history: DataFrame) -> DataFrame:
    """How far rejected and withdrawn applications got; every pair has a row."""
    stage = F.when(F.col("ever_int"), "Interview").when(F.col("ever_short"), "Shortlisted").otherwise("Applied")
    counts = staged(applications, history).filter(F.col("current_status").isin(TERMINAL)).groupBy(F.col("current_status").alias("outcome"), stage.alias("stage")).agg(F.count("*").alias("n"))
    grid = applications.sparkSession.createDataFrame([(o, s) for o in TERMINAL for s in ("Applied", "Shortlisted", "Interview")], "outcome string, stage string")
    return grid.join(F.broadcast(counts), ["outcome", "stage"], "left").select("outcome", "stage", F.coalesce("n", F.lit(0)).alias("applications"))


def rejection_portals(applications: DataFrame) -> DataFrame:
    """Per portal, without offers among the resolved; most applications first."""
    now = F.col("current_status")
    by = applications.filter(visible()).groupBy(F.col("source_portal").alias("portal")).agg(F.count("*").alias("total"), F.count_if(now == "Rejected").alias("rejected"), F.count_if(now == "Withdrawn").alias("withdrawn"), F.min("id").alias("first_id"))
    return by.select("*", F.try_divide(F.col("rejected").cast("double"), F.expr("rejected + withdrawn")).alias("rejection_rate")).orderBy(F.desc("total"), "first_id")


def rejection_trend(applications: DataFrame, as_of: str, months: int = 6) -> DataFrame:
    """Rejected and withdrawn by month of the last update; every month has a row."""
    now = F.col("current_status")
    first = F.trunc(clock(as_of).cast("date"), "month")
    calendar = applications.sparkSession.range(months).select(F.add_months(first, (F.col("id") - (months - 1)).cast("int")).alias("at")).select(F.date_format("at", "yyyy-MM").alias("month"), F.date_format("at", "MMM yyyy").alias("label"))
    counts = applications.filter(visible() & now.isin(TERMINAL) & (F.col("updated_at") >= F.add_months(first, 1 - months))).groupBy(F.date_format("updated_at", "yyyy-MM").alias("month")).agg(F.count_if(now == "Rejected").alias("r"), F.count_if(now == "Withdrawn").alias("w"))
    return calendar.join(F.broadcast(counts), "month", "left").select("month", "label", F.coalesce("r", F.lit(0)).alias("rejected"), F.coalesce("w", F.lit(0)).alias("withdrawn"))


def report(applications: DataFrame, history: DataFrame) -> dict[str, DataFrame | bool]:
    """All parts of the report; with too few applications only that is said."""
    enough = applications.filter(visible()).limit(MIN_APPLICATIONS).count() >= MIN_APPLICATIONS
    stats = channel_stats(applications, history, "source_portal")
    return {"insufficient_data": not enough, "funnel": funnel(applications), "channels": stats, "methods": channel_stats(applications, history, "application_method"), "insights": channel_flags(stats)} if enough else {"insufficient_data": True, "funnel": funnel(applications)}
