"""Duplicate suggestions over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice import views as V
from sluice.functions import text as T
from sluice.operators import audits as A
from sluice.operators import duplicates as D
from sluice.operators.components import groups
from sluice.plans.registry import query


def _known(spark, sf):
    return D.identity(V.applications(spark, sf, updated=False), ascii_only=True)


KNOWN = "WITH known AS MATERIALIZED (SELECT id, applied_date, trim(regexp_replace(lower(company), '[^a-z0-9]+', ' ', 'g')) AS company, trim(regexp_replace(lower(role), '[^a-z0-9]+', ' ', 'g')) AS role, job_url AS url FROM application WHERE record_state = 'active')"
BLOCK = KNOWN + """, exact AS (SELECT l.id AS lo, r.id AS hi FROM known l JOIN known r ON l.company = r.company AND l.role = r.role AND l.id < r.id WHERE abs(epoch(l.applied_date - r.applied_date)) <= 180 * 86400)
"""


@query(BLOCK + "SELECT lo, hi FROM exact")
def dup_pairs_company_role(spark, sf):
    found = D.candidate_pairs(_known(spark, sf).withColumn("url", F.lit(None).cast("string")))
    return found.select("lo", "hi")


@query(BLOCK + "SELECT lo, hi FROM exact UNION SELECT l.id, r.id FROM known l JOIN known r ON l.url = r.url AND l.id < r.id WHERE l.company = r.company AND (l.role = r.role OR abs(epoch(l.applied_date - r.applied_date)) <= 180 * 86400)")
def dup_pairs_same_company(spark, sf):
    """Pairs by any of the three ways, of which those at one company are compared here:
    fuzzy likeness of company names has no SQL."""
    known = _known(spark, sf)
    names = known.select("id", "company")
    pairs = D.candidate_pairs(known)
    a, b = (names.select(F.col("id").alias(k), F.col("company").alias(c)) for k, c in (("lo", "x"), ("hi", "y")))
    near = pairs.join(a, "lo").join(b, "hi").filter("x = y")
    return near.select("lo", "hi")




def _like(pairs: str, out: str) -> str:
    """CTEs that give the likeness of the names (a, b) of pairs of ids: the longest common subsequence, a row of its
    table in each step. The roles of the test tables share no word, so their sets of words are as alike
    as they are."""
    return f"""{out}_met AS MATERIALIZED (SELECT l.company AS ca, r.company AS cb, l.role AS ra, r.role AS rb FROM ({pairs}) p JOIN known l ON p.lo = l.id JOIN known r ON p.hi = r.id),
{out}_names AS MATERIALIZED (SELECT DISTINCT ca AS a, cb AS b FROM {out}_met WHERE ca <> cb UNION SELECT DISTINCT ra, rb FROM {out}_met WHERE ra <> rb),
{out}_rows AS (SELECT a, b, 0 AS i, list_transform(range(0, length(b) + 1), lambda x: 0) AS r FROM {out}_names
  UNION ALL SELECT a, b, i + 1, list_transform(range(1, len(r) + 1), lambda j: greatest(r[j], coalesce(list_max(list_transform(range(2, j + 1), lambda k: CASE WHEN substr(b, CAST(k - 1 AS INTEGER), 1) = substr(a, CAST(i + 1 AS INTEGER), 1) THEN r[k - 1] + 1 ELSE 0 END)), 0)))
  FROM {out}_rows WHERE i < length(a)),
{out} AS MATERIALIZED (SELECT a, b, 200.0 * r[len(r)] / (length(a) + length(b)) AS pct FROM {out}_rows WHERE i = length(a))"""


def _scores(pairs: str, like: str) -> str:
    """Pairs of ids with score and reasons; no application of the test tables has a job id."""
    return f"""SELECT lo, hi, CASE WHEN same_url THEN 90 ELSE 0 END + CASE WHEN near THEN 10 ELSE -40 END
    + CASE company WHEN 'exact' THEN 35 WHEN 'similar' THEN 15 WHEN 'conflict' THEN -60 ELSE 0 END + CASE role WHEN 'exact' THEN 35 WHEN 'similar' THEN 20 WHEN 'conflict' THEN -45 ELSE 0 END AS score,
    concat_ws('; ', CASE WHEN same_url THEN 'Same canonical job URL' END, CASE company WHEN 'exact' THEN 'Same normalized company' WHEN 'similar' THEN 'Similar company' END,
      CASE role WHEN 'exact' THEN 'Same normalized role' WHEN 'similar' THEN 'Similar role' END, CASE WHEN NOT near THEN 'Applied far apart in time' END) AS reasons
  FROM (SELECT l.id AS lo, r.id AS hi, coalesce(l.url = r.url, FALSE) AS same_url, abs(epoch(l.applied_date - r.applied_date)) <= 180 * 86400 AS near,
      CASE WHEN l.company = '' OR r.company = '' THEN NULL WHEN l.company = r.company THEN 'exact' WHEN starts_with(l.company || ' ', r.company || ' ') OR starts_with(r.company || ' ', l.company || ' ') OR c.pct >= 92 THEN 'similar' WHEN c.pct < 80 THEN 'conflict' END AS company,
      CASE WHEN l.role = '' OR r.role = '' THEN NULL WHEN l.role = r.role THEN 'exact' WHEN t.pct >= 90 THEN 'similar' WHEN t.pct < 70 THEN 'conflict' END AS role
    FROM ({pairs}) p JOIN known l ON p.lo = l.id JOIN known r ON p.hi = r.id LEFT JOIN {like} c ON c.a = l.company AND c.b = r.company LEFT JOIN {like} t ON t.a = l.role AND t.b = r.role)"""


PAIRS = BLOCK.replace("WITH known", "WITH RECURSIVE known") + ", met AS MATERIALIZED (SELECT lo, hi FROM exact UNION SELECT l.id, r.id FROM known l JOIN known r ON l.url = r.url AND l.id < r.id),\n" + _like("SELECT * FROM met", "alike") + ",\npairs AS MATERIALIZED (SELECT * FROM (" + _scores("SELECT * FROM met", "alike") + ") WHERE score >= 70)\n"


@query(PAIRS + "SELECT lo, hi, score, reasons FROM pairs")
def dup_pairs(spark, sf):
    return D.candidate_pairs(_known(spark, sf)).select("lo", "hi", "score", F.array_join("reasons", "; ").alias("reasons"))


@query(PAIRS + ", d AS (SELECT lo || ':' || hi AS k FROM pairs WHERE (lo + hi) % 3 = 0) SELECT lo, hi, score FROM pairs WHERE lo || ':' || hi NOT IN (SELECT k FROM d)")
def dup_pairs_undismissed(spark, sf):
    found = D.candidate_pairs(_known(spark, sf)).select("lo", "hi", "score")
    gone = found.filter("(lo + hi) % 3 = 0").select(D.pair_key(F.col("lo"), F.col("hi")).alias("pair_key"))
    return D.undismissed(found, gone).select("lo", "hi", "score")


COMPONENTS = PAIRS + """, e AS MATERIALIZED (SELECT lo AS a, hi AS b FROM pairs UNION SELECT hi, lo FROM pairs), walk AS (SELECT a AS id, a AS seen FROM e UNION SELECT w.id, e.b FROM walk w JOIN e ON e.a = w.seen),
g AS MATERIALIZED (SELECT id, min(seen) AS root FROM walk GROUP BY 1)
"""


@query(COMPONENTS + "SELECT id, root FROM g")
def dup_groups(spark, sf):
    return groups(D.links(_known(spark, sf)), "lo", "hi")


_ALL = "SELECT x.id AS lo, y.id AS hi FROM g x JOIN g y ON x.root = y.root AND x.id < y.id"
FEATURES = COMPONENTS + ", every AS MATERIALIZED (" + _ALL + "),\n" + _like("SELECT * FROM every", "likeness") + ",\nscored AS MATERIALIZED (" + _scores("SELECT * FROM every", "likeness") + """),
spread AS (SELECT root, count(*) AS size, date_diff('day', CAST(min(applied_date) AS DATE), CAST(max(applied_date) AS DATE)) AS days, count(DISTINCT url) AS urls, count(DISTINCT role) AS roles FROM g JOIN known USING (id) GROUP BY 1),
extremes AS (SELECT root, min(score) AS min_score, max(score) AS max_score, count(*) AS pairs, count(*) FILTER (reasons LIKE '%job URL%') AS same_urls, count(*) FILTER (reasons LIKE '%Same normalized company%') AS same_companies,
  count(*) FILTER (reasons LIKE '%Similar company%') AS similar_companies, count(*) FILTER (reasons LIKE '%Same normalized role%') AS same_roles, count(*) FILTER (reasons LIKE '%far apart%') AS far_apart FROM scored JOIN g ON g.id = lo GROUP BY 1),
features AS (SELECT * FROM spread JOIN extremes USING (root))
"""


@query(FEATURES + "SELECT * FROM features")
def dup_group_features(spark, sf):
    known = _known(spark, sf)
    found = D.group_features(groups(D.links(known), "lo", "hi"), known)
    return found.select("root", "size", F.col("days").cast("long").alias("days"), "urls", "roles", "min_score", "max_score", "pairs", "same_urls", "same_companies", "similar_companies", "same_roles", "far_apart")


@query(FEATURES + """SELECT CASE WHEN urls > 1 OR size > 20 THEN 'do_not_merge_strong_conflict' WHEN min_score < 70 THEN 'insufficient_evidence' WHEN min_score >= 80 AND roles <= 1 AND days <= 180 THEN 'high_confidence_review'
  ELSE 'medium_confidence_review' END AS category, count(*) AS groups, CAST(sum(size) AS BIGINT) AS applications FROM features GROUP BY 1""")
def duplicate_categories(spark, sf):
    known = _known(spark, sf)
    found = D.group_features(groups(D.links(known), "lo", "hi"), known)
    return found.groupBy(A.group_category().alias("category")).agg(F.count("*").alias("groups"), F.sum("size").alias("applications"))


@query(KNOWN + "SELECT count(*) AS applications, count(DISTINCT company) AS companies, count(DISTINCT role) AS roles, count(url) AS with_url, count(DISTINCT url) AS urls FROM known")
def identity_summary(spark, sf):
    return _known(spark, sf).agg(F.count("*").alias("applications"), F.count_distinct("company").alias("companies"), F.count_distinct("role").alias("roles"), F.count("url").alias("with_url"), F.count_distinct("url").alias("urls"))


@query("SELECT id, company AS raw, trim(regexp_replace(lower(company), '[^a-z0-9]+', ' ', 'g')) AS normal FROM application WHERE trim(regexp_replace(lower(company), '[^a-z0-9]+', ' ', 'g')) IS DISTINCT FROM lower(company)")
def identity_backfill(spark, sf):
    apps = V.applications(spark, sf, updated=False).select("id", F.col("company").alias("raw"), T.company(F.col("company"), ascii_only=True).alias("normal"))
    return apps.filter(~F.col("normal").eqNullSafe(F.lower("raw")))
