"""Resolution of messages over the test tables: every order also sends a message."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice import views as V
from sluice.functions import text as T
from sluice.operators import duplicates as D
from sluice.operators import listing as L
from sluice.operators import replay as P
from sluice.operators import resolving as R
from sluice.plans.registry import query


def _applications(spark, sf):
    return D.identity(V.applications(spark, sf, updated=False), ascii_only=True, carry=("thread_ids",))


def _messages(spark, sf):
    """From every order a message ten days later, of its company and the role of the day."""
    k = F.col("o_orderkey")
    orders = V.read(spark, sf, "orders").join(V.read(spark, sf, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    none = F.lit(None).cast("string")
    return orders.select(
        k.alias("evidence_id"), (F.col("o_orderdate") + F.expr("INTERVAL 10 DAYS")).alias("occurred_at"), V.choose(V.mod("o_orderkey", 3), ["acknowledgement", "status_update", "follow_up"]).alias("kind"),
        F.when(V.mod("o_orderkey", 11) == 0, F.concat(F.lit("t-"), F.floor(k / 2).cast("string"))).alias("thread_id"), none.alias("job_id"), none.alias("job_source"),
        F.when(V.mod("o_orderkey", 13) == 0, F.format_string("https://jobs.example.com/view/%d", F.floor(k / 6))).alias("url"), none.alias("sender"), none.alias("domain"), (V.mod("o_orderkey", 17) == 0).alias("freemail"),
        F.regexp_replace(F.lower("c_name"), "[^a-z0-9]+", " ").alias("company"), F.when(V.mod("o_orderkey", 4) < 3, F.trim(F.regexp_replace(F.lower("o_orderpriority"), "[^a-z0-9]+", " "))).otherwise("").alias("role"),
        F.lit("other").alias("source"), (V.mod("o_orderkey", 19) == 0).alias("forwarded"), (V.mod("o_orderkey", 5) != 0).alias("confident"),
    )


def _links(spark, sf):
    return L.identities(V.evidence(spark, sf))


@query()
def resolved_messages(spark, sf):
    found = R.resolve(_messages(spark, sf), _applications(spark, sf), _links(spark, sf))
    return found.select("evidence_id", "outcome", "reason", "application_id", "confidence", "link_method", F.size("candidates").alias("candidates"))


@query("""WITH a AS (SELECT id, trim(regexp_replace(lower(company), '[^a-z0-9]+', ' ', 'g')) AS company FROM application WHERE record_state = 'active'),
c AS (SELECT company, id, row_number() OVER (PARTITION BY company ORDER BY id) AS n FROM a),
m AS (SELECT o_orderkey AS evidence_id, regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g') AS company FROM orders JOIN customer ON o_custkey = c_custkey),
w AS (SELECT split_part(company, ' ', 1) AS word, id, row_number() OVER (PARTITION BY split_part(company, ' ', 1) ORDER BY id) AS n FROM a),
p AS (SELECT evidence_id, id, 4 AS tier FROM m JOIN c USING (company) WHERE n <= 50 UNION ALL SELECT evidence_id, id, 5 FROM m JOIN w ON w.word = split_part(m.company, ' ', 1) WHERE n <= 25),
o AS (SELECT evidence_id, id, min(tier) AS tier FROM p GROUP BY 1, 2), r AS (SELECT evidence_id, id, row_number() OVER (PARTITION BY evidence_id ORDER BY tier, id) AS n FROM o)
SELECT evidence_id, count(*) AS candidates, CAST(sum(id) AS BIGINT) AS ids FROM r WHERE n <= 25 GROUP BY 1""")
def candidates_by_company(spark, sf):
    none = F.lit(None).cast("string")
    messages = _messages(spark, sf).withColumns({"thread_id": none, "url": none})
    empty = _links(spark, sf).limit(0)
    return R.candidates(messages, _applications(spark, sf), empty).groupBy("evidence_id").agg(F.count("*").alias("candidates"), F.sum("id").alias("ids"))


@query()
def replayed_messages(spark, sf):
    """Every message after those before it: a second acknowledgement links to what the first created."""
    return P.replay(_messages(spark, sf), _applications(spark, sf), _links(spark, sf))


@query()
def resolution_reasons(spark, sf):
    found = R.resolve(_messages(spark, sf), _applications(spark, sf), _links(spark, sf))
    return found.groupBy("outcome", "reason").agg(F.count("*").alias("n"))


@query()
def verified_links(spark, sf):
    messages, apps = _messages(spark, sf), _applications(spark, sf)
    every = V.applications(spark, sf, updated=False)
    targets = D.identity(every, ascii_only=True, active_only=False).drop("source").join(every.select("id", "record_state", "merged_into", T.source_key(F.col("source_portal")).alias("source")), "id")
    return R.verified(messages, targets, R.resolve(messages, apps, _links(spark, sf)))
