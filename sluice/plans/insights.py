"""Report queries over the test tables."""

from __future__ import annotations

from sluice import views as V
from sluice.operators import insights as I
from sluice.operators.predicates import stale, visible
from sluice.plans.registry import query

SHORT = "('Resume Shortlisted', 'Interview Scheduled', 'Interview In Progress', 'Offer Negotiation', 'Offer', 'Joined')"
INTER = "('Interview Scheduled', 'Interview In Progress', 'Offer Negotiation', 'Offer', 'Joined')"
OFFER = "('Offer', 'Joined')"
SEEN = "record_state = 'active' AND NOT is_false_positive"
AS_OF = f"TIMESTAMP '{V.AS_OF} 00:00:00'"
EV_AS_OF = f"TIMESTAMP '{V.EVENTS_AS_OF} 00:00:00'"

STAGED = f"""WITH app AS (SELECT * FROM application WHERE {SEEN}),
hit AS (SELECT id, current_status AS status FROM app UNION SELECT application_id, to_status FROM history WHERE superseded_by IS NULL),
staged AS (SELECT a.*, bool_or(status IN {SHORT}) OVER w AS ever_short, bool_or(status IN {INTER}) OVER w AS ever_int, bool_or(status IN {OFFER}) OVER w AS ever_offer,
    bool_or(status IN {SHORT} OR status = 'Rejected') OVER w AS ever_resp, row_number() OVER (PARTITION BY a.id ORDER BY status) AS rn
  FROM app a JOIN hit ON hit.id = a.id WINDOW w AS (PARTITION BY a.id)),
st AS (SELECT * FROM staged WHERE rn = 1)
"""
CELLS = STAGED + f""", cells AS (SELECT CASE WHEN ever_int THEN 'Interview' WHEN ever_short THEN 'Shortlisted' ELSE 'Applied' END AS stage,
    CASE WHEN current_status IN ('Rejected', 'Withdrawn') THEN current_status WHEN ever_int AND ever_offer THEN 'Offer / Joined'
      WHEN NOT ever_int AND NOT ever_short AND current_status = 'Applied' AND updated_at < {AS_OF} - INTERVAL 14 DAY THEN 'Stale' ELSE 'Active' END AS outcome, ever_offer FROM st)
"""


def _flow(spark, sf):
    return I.flow_cells(V.applications(spark, sf), V.history(spark, sf), V.AS_OF)


@query(CELLS + "SELECT stage, outcome, count(*) AS applications, count(*) FILTER (ever_offer) AS offered FROM cells GROUP BY ALL")
def flow_stage_outcome(spark, sf):
    return _flow(spark, sf)


TOTALS = CELLS + """, c AS (SELECT count(*) AS total, count(*) FILTER (ever_offer) AS offered,
  count(*) FILTER (stage = 'Applied' AND outcome = 'Rejected') AS a_r, count(*) FILTER (stage = 'Applied' AND outcome = 'Withdrawn') AS a_w, count(*) FILTER (stage = 'Applied' AND outcome = 'Active') AS a_a, count(*) FILTER (stage = 'Applied' AND outcome = 'Stale') AS a_s,
  count(*) FILTER (stage = 'Shortlisted' AND outcome = 'Rejected') AS s_r, count(*) FILTER (stage = 'Shortlisted' AND outcome = 'Withdrawn') AS s_w, count(*) FILTER (stage = 'Shortlisted' AND outcome = 'Active') AS s_a,
  count(*) FILTER (stage = 'Interview' AND outcome = 'Rejected') AS i_r, count(*) FILTER (stage = 'Interview' AND outcome = 'Withdrawn') AS i_w, count(*) FILTER (stage = 'Interview' AND outcome = 'Active') AS i_a FROM cells),
t AS (SELECT *, offered + i_r + i_w + i_a AS i_t, offered + i_r + i_w + i_a + s_r + s_w + s_a AS s_t FROM c)
"""


@query(TOTALS + """SELECT * FROM (SELECT 'Applied' AS source, 'Shortlisted' AS target, s_t AS value FROM t UNION ALL SELECT 'Applied', 'Rejected', a_r FROM t UNION ALL SELECT 'Applied', 'Withdrawn', a_w FROM t
  UNION ALL SELECT 'Applied', 'Active', a_a FROM t UNION ALL SELECT 'Applied', 'Stale', a_s FROM t UNION ALL SELECT 'Shortlisted', 'Interview', i_t FROM t UNION ALL SELECT 'Shortlisted', 'Rejected', s_r FROM t
  UNION ALL SELECT 'Shortlisted', 'Withdrawn', s_w FROM t UNION ALL SELECT 'Shortlisted', 'Active', s_a FROM t UNION ALL SELECT 'Interview', 'Offer / Joined', offered FROM t UNION ALL SELECT 'Interview', 'Rejected', i_r FROM t
  UNION ALL SELECT 'Interview', 'Withdrawn', i_w FROM t UNION ALL SELECT 'Interview', 'Active', i_a FROM t) WHERE value <> 0""")
def flow_links(spark, sf):
    return I.flow_links(I.flow_totals(_flow(spark, sf)))


@query(TOTALS + """SELECT 'Applied' AS node, total AS applications FROM t UNION ALL SELECT 'Shortlisted', s_t FROM t UNION ALL SELECT 'Interview', i_t FROM t UNION ALL SELECT 'Offer / Joined', offered FROM t
  UNION ALL SELECT 'Rejected', a_r + s_r + i_r FROM t UNION ALL SELECT 'Withdrawn', a_w + s_w + i_w FROM t UNION ALL SELECT 'Active', a_a + s_a + i_a FROM t UNION ALL SELECT 'Stale', a_s FROM t""")
def flow_nodes(spark, sf):
    return I.flow_nodes(I.flow_totals(_flow(spark, sf)))


@query(TOTALS + """SELECT total, offered, i_t AS interview_total, s_t AS shortlisted_total, (SELECT count(*) FROM cells WHERE stage = 'Interview') AS interview_distinct,
  (SELECT count(*) FROM cells WHERE stage <> 'Applied') AS shortlisted_distinct, i_t / total AS interview_rate, offered / total AS offer_rate FROM t""")
def flow_kpis(spark, sf):
    from pyspark.sql import functions as F

    t = I.flow_totals(_flow(spark, sf))
    return t.select("total", "offered", "interview_total", "shortlisted_total", "interview_distinct", "shortlisted_distinct", (F.col("interview_total") / F.col("total")).alias("interview_rate"), (F.col("offered") / F.col("total")).alias("offer_rate"))


@query(f"SELECT s.status AS current_status, count(a.id) AS applications FROM (SELECT unnest(['Applied', 'Resume Shortlisted', 'Interview Scheduled', 'Interview In Progress', 'Offer Negotiation', 'Offer', 'Joined', 'Rejected', 'Withdrawn']) AS status) s LEFT JOIN (SELECT id, current_status FROM application WHERE {SEEN}) a ON a.current_status = s.status GROUP BY 1")
def funnel_counts(spark, sf):
    return I.funnel(V.applications(spark, sf))


def _channel_sql(field: str) -> str:
    return STAGED + f""", first AS (SELECT application_id, min(changed_at) AS replied FROM history WHERE superseded_by IS NULL AND (to_status IN {SHORT} OR to_status = 'Rejected') GROUP BY 1)
SELECT coalesce(nullif({field}, ''), 'Unknown') AS channel, count(*) AS total, count(*) FILTER (current_status IN {SHORT}) AS shortlisted, count(*) FILTER (current_status IN {INTER}) AS interviewed, count(*) FILTER (current_status IN {OFFER}) AS offered,
  count(*) FILTER (ever_resp) AS responded, median(greatest(0.0, date_diff('second', applied_date, replied) / 86400.0)) AS median_response_days,
  count(*) FILTER (current_status IN {INTER}) / count(*) AS interview_rate, count(*) FILTER (current_status IN {OFFER}) / count(*) AS offer_rate, count(*) FILTER (ever_resp) / count(*) AS response_rate,
  count(*) / nullif(count(*) FILTER (current_status IN {INTER}), 0) AS applications_per_interview, CASE WHEN count(*) < 15 THEN 'low' WHEN count(*) < 30 THEN 'medium' ELSE 'high' END AS confidence
FROM st LEFT JOIN first ON application_id = st.id GROUP BY 1"""


@query(_channel_sql("source_portal"))
def channel_stats(spark, sf):
    return I.channel_stats(V.applications(spark, sf), V.history(spark, sf), "source_portal")


@query(_channel_sql("application_method"))
def method_stats(spark, sf):
    return I.channel_stats(V.applications(spark, sf), V.history(spark, sf), "application_method")


@query(f"""WITH s AS (SELECT coalesce(nullif(role, ''), 'Unknown') AS channel, count(*) AS n, count(*) FILTER (current_status IN {INTER}) / count(*) AS rate FROM application WHERE {SEEN} GROUP BY 1)
SELECT channel, CASE WHEN n < 15 THEN 'neutral' WHEN rate > 0.2 THEN 'green' WHEN rate = 0 THEN 'red' ELSE 'neutral' END AS flag,
  CASE WHEN n < 15 THEN channel || ' has only ' || n || ' applications — collect at least 15 before changing strategy.' WHEN rate > 0.2 THEN channel || ' is converting at ' || CAST(round_even(rate * 100, 0) AS INTEGER) || '% interview rate — prioritize this channel.'
    WHEN rate = 0 THEN 'No responses from ' || channel || ' after ' || n || ' applications — consider reducing volume here.' ELSE channel || ' has a ' || CAST(round_even(rate * 100, 0) AS INTEGER) || '% interview rate.' END AS message FROM s""")
def channel_flags(spark, sf):
    return I.channel_flags(I.channel_stats(V.applications(spark, sf), V.history(spark, sf), "role"))


def _pulse_sql(window: int) -> str:
    return STAGED + f""", p AS (SELECT *, applied_date BETWEEN {AS_OF} - INTERVAL {window} DAY AND {AS_OF} AS recent, created_at BETWEEN {AS_OF} - INTERVAL {window} DAY AND {AS_OF} AS captured,
  applied_date >= {AS_OF} - INTERVAL {window + 14} DAY AND applied_date < {AS_OF} - INTERVAL 14 DAY AS matured FROM st),
c AS (SELECT count(*) FILTER (recent) AS recent_applications, count(*) FILTER (captured) AS recent_captured, count(*) FILTER (recent AND ever_int) AS recent_interviews, count(*) FILTER (recent AND ever_offer) AS recent_offers,
  count(*) FILTER (captured AND date_diff('day', CAST(applied_date AS DATE), CAST(created_at AS DATE)) > 7) AS late_imports, count(*) FILTER (matured) AS matured_applications, count(*) FILTER (matured AND ever_resp) AS responses,
  count(*) FILTER (matured AND ever_short) AS shortlisted, count(*) FILTER (matured AND ever_int) AS interviewed, count(*) FILTER (matured AND ever_offer) AS offered FROM p)
SELECT *, responses / nullif(matured_applications, 0) AS responses_rate, shortlisted / nullif(matured_applications, 0) AS shortlisted_rate, interviewed / nullif(matured_applications, 0) AS interviewed_rate, offered / nullif(matured_applications, 0) AS offered_rate FROM c"""


@query(_pulse_sql(28))
def search_pulse_28(spark, sf):
    return I.search_pulse(V.applications(spark, sf), V.history(spark, sf), V.AS_OF, 28)


@query(_pulse_sql(90))
def search_pulse_90(spark, sf):
    return I.search_pulse(V.applications(spark, sf), V.history(spark, sf), V.AS_OF, 90)


@query(f"""WITH w AS (SELECT CAST(date_trunc('week', {AS_OF}) AS DATE) - CAST(7 * i AS INTEGER) AS week FROM range(12) r(i)), app AS (SELECT * FROM application WHERE {SEEN})
SELECT week, (SELECT count(*) FROM app WHERE CAST(applied_date AS DATE) >= week AND CAST(applied_date AS DATE) < week + 7) AS applied, (SELECT count(*) FROM app WHERE CAST(created_at AS DATE) >= week AND CAST(created_at AS DATE) < week + 7) AS captured FROM w""")
def weekly_activity_dense(spark, sf):
    return I.weekly_activity(V.applications(spark, sf), V.AS_OF)


MET = f"""WITH app AS (SELECT * FROM application WHERE {SEEN}),
ev AS (SELECT * FROM milestone WHERE superseded_by IS NULL AND event_type = 'Interview Attended' AND occurred_at >= {EV_AS_OF} - INTERVAL 180 DAY AND application_id IN (SELECT id FROM app)),
met AS (SELECT * FROM app WHERE id IN (SELECT application_id FROM ev))
"""


@query(MET + f""", pr AS (SELECT p.*, a.id AS app, a.current_status FROM (SELECT * FROM prospect WHERE received_at >= {EV_AS_OF} - INTERVAL 180 DAY) p LEFT JOIN app a ON a.id = p.application_id)
SELECT (SELECT count(*) FROM ev) AS attended_events, (SELECT count(*) FROM met) AS interviewed_applications, (SELECT count(*) FROM met WHERE current_status IN {OFFER}) AS offers, (SELECT count(*) FROM met WHERE current_status = 'Rejected') AS rejections,
  (SELECT count(*) FROM met WHERE current_status = 'Withdrawn') AS withdrawals, (SELECT count(*) FROM met WHERE current_status NOT IN ('Offer', 'Joined', 'Rejected', 'Withdrawn')) AS active,
  count(*) AS received, count(app) AS converted, count(*) FILTER (app IN (SELECT id FROM met)) AS converted_to_interview, count(*) FILTER (current_status IN {OFFER}) AS converted_to_offer FROM pr""")
def conversion(spark, sf):
    return I.conversion(V.applications(spark, sf), V.milestones(spark, sf), V.prospects(spark, sf), V.EVENTS_AS_OF)


def _breakdown_sql(field: str) -> str:
    return MET + f"SELECT coalesce(nullif({field}, ''), 'Unknown') AS name, count(*) AS interviewed_applications, count(*) FILTER (current_status IN {OFFER}) AS offers, count(*) FILTER (current_status = 'Rejected') AS rejections, count(*) FILTER (current_status IN {OFFER}) / count(*) AS offer_rate FROM met GROUP BY 1"


@query(_breakdown_sql("source_portal"))
def conversion_by_source(spark, sf):
    return I.interview_breakdown(V.applications(spark, sf), V.milestones(spark, sf), V.EVENTS_AS_OF, "source_portal")


@query(_breakdown_sql("application_method"))
def conversion_by_method(spark, sf):
    return I.interview_breakdown(V.applications(spark, sf), V.milestones(spark, sf), V.EVENTS_AS_OF, "application_method")


@query(f"""WITH c AS (SELECT count(*) AS total, count(*) FILTER (current_status = 'Rejected') AS rejected, count(*) FILTER (current_status = 'Withdrawn') AS withdrawn, count(*) FILTER (current_status IN {OFFER}) AS offered FROM application WHERE {SEEN})
SELECT total, rejected, withdrawn, rejected + withdrawn + offered AS resolved, coalesce(rejected / nullif(rejected + withdrawn + offered, 0), 0) AS rejection_rate, coalesce(withdrawn / nullif(total, 0), 0) AS withdrawal_rate,
  coalesce((rejected + withdrawn) / nullif(rejected + withdrawn + offered, 0), 0) AS non_offer_rate, rejected + withdrawn < 3 AS insufficient_data FROM c""")
def rejection_totals(spark, sf):
    return I.rejection_totals(V.applications(spark, sf))


@query(STAGED + """SELECT g.outcome, g.stage, count(b.id) AS applications FROM (SELECT * FROM (VALUES ('Rejected'), ('Withdrawn')) o(outcome), (VALUES ('Applied'), ('Shortlisted'), ('Interview')) s(stage)) g
LEFT JOIN (SELECT id, current_status, CASE WHEN ever_int THEN 'Interview' WHEN ever_short THEN 'Shortlisted' ELSE 'Applied' END AS stage FROM st) b ON b.current_status = g.outcome AND b.stage = g.stage GROUP BY 1, 2""")
def rejection_stages(spark, sf):
    return I.rejection_stages(V.applications(spark, sf), V.history(spark, sf))


@query(f"SELECT source_portal AS portal, count(*) AS total, count(*) FILTER (current_status = 'Rejected') AS rejected, count(*) FILTER (current_status = 'Withdrawn') AS withdrawn, min(id) AS first_id, count(*) FILTER (current_status = 'Rejected') / nullif(count(*) FILTER (current_status IN ('Rejected', 'Withdrawn')), 0) AS rejection_rate FROM application WHERE {SEEN} GROUP BY 1")
def rejection_portals(spark, sf):
    return I.rejection_portals(V.applications(spark, sf))


@query(f"""WITH m AS (SELECT CAST(date_trunc('month', {AS_OF}) AS DATE) - to_months(CAST(i AS INTEGER)) AS first FROM range(6) r(i))
SELECT strftime(first, '%Y-%m') AS month, strftime(first, '%b %Y') AS label, count(a.id) FILTER (current_status = 'Rejected') AS rejected, count(a.id) FILTER (current_status = 'Withdrawn') AS withdrawn
FROM m LEFT JOIN (SELECT * FROM application WHERE {SEEN} AND current_status IN ('Rejected', 'Withdrawn')) a ON strftime(updated_at, '%Y-%m') = strftime(first, '%Y-%m') GROUP BY 1, 2""")
def rejection_trend(spark, sf):
    return I.rejection_trend(V.applications(spark, sf), V.AS_OF)


@query(f"SELECT count(*) AS n, strftime(min(updated_at), '%Y-%m-%d') AS oldest FROM application WHERE {SEEN} AND current_status = 'Applied' AND updated_at < {AS_OF} - INTERVAL 14 DAY")
def stale_count(spark, sf):
    from pyspark.sql import functions as F

    return V.applications(spark, sf).filter(visible() & stale(V.AS_OF)).agg(F.count("*").alias("n"), F.date_format(F.min("updated_at"), "yyyy-MM-dd").alias("oldest"))
