"""Text functions over the test tables. SQL covers what is ASCII; the rest is held
against golden values in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice import views as V
from sluice.functions import text as T
from sluice.plans.registry import query

ENDING = "|".join(T.LEGAL)
PLAIN = "trim(regexp_replace(regexp_replace(replace(lower({0}), '&', ' and '), '[^a-z0-9]+', ' ', 'g'), ' +', ' ', 'g'))"


def _names(spark, sf):
    """Supplier names with endings, to be taken off again."""
    s = V.read(spark, sf, "supplier")
    end = V.choose(V.mod("s_suppkey", 5), [" Pvt. Ltd.", " GmbH", " & Sons Inc", " Technologies Private Limited", ""])
    return s.select("s_suppkey", F.concat("s_name", end).alias("name"))


NAMES = "SELECT s_suppkey, s_name || CASE s_suppkey % 5 WHEN 0 THEN ' Pvt. Ltd.' WHEN 1 THEN ' GmbH' WHEN 2 THEN ' & Sons Inc' WHEN 3 THEN ' Technologies Private Limited' ELSE '' END AS name FROM supplier"


@query(f"SELECT s_suppkey, regexp_replace({PLAIN.format('name')}, '^(.+?)(?: (?:{ENDING}))+$', '\\1') AS company FROM ({NAMES})")
def normal_companies(spark, sf):
    return _names(spark, sf).select("s_suppkey", T.company(F.col("name"), ascii_only=True).alias("company"))


@query(f"SELECT p_partkey, array_to_string(list_transform(string_split({PLAIN.format('p_name')}, ' '), lambda x: CASE x WHEN 'sr' THEN 'senior' WHEN 'snr' THEN 'senior' WHEN 'jr' THEN 'junior' WHEN 'mgr' THEN 'manager' WHEN 'engg' THEN 'engineering' ELSE x END), ' ') AS role FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Sr. ' WHEN 1 THEN 'jr ' ELSE '' END || p_name AS p_name FROM part)")
def normal_roles(spark, sf):
    parts = V.read(spark, sf, "part").select("p_partkey", F.concat(V.choose(V.mod("p_partkey", 3), ["Sr. ", "jr ", ""]), "p_name").alias("name"))
    return parts.select("p_partkey", T.role(F.col("name"), ascii_only=True).alias("role"))


@query("""WITH p AS (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS u FROM pages),
q AS (SELECT page_id, lower(regexp_extract(u, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1)) AS scheme, regexp_replace(lower(regexp_extract(u, '^[^:/?]+://([^/?]*)', 1)), '^www\\.', '') AS host, regexp_replace(regexp_extract(u, '^[^:/?]+://[^/?]*([^?]*)', 1), '/+$', '') AS path, regexp_extract(u, '\\?(.*)$', 1) AS query FROM p),
k AS (SELECT *, array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: regexp_matches(x, '^[^=]+=.') AND NOT starts_with(lower(split_part(x, '=', 1)), 'utm_') AND lower(split_part(x, '=', 1)) NOT IN (""" + ", ".join(f"'{t}'" for t in T.TRACKING) + """))), '&') AS tail FROM q)
SELECT page_id, CASE WHEN scheme IN ('http', 'https') THEN 'https' ELSE scheme END || '://' || host || path || CASE WHEN tail <> '' THEN '?' || tail ELSE '' END AS url FROM k""")
def canonical_urls(spark, sf):
    return V.read(spark, sf, "pages").select("page_id", T.job_url(F.col("url")).alias("url"))


@query()
def canonical_urls_exact(spark, sf):
    return V.read(spark, sf, "pages").select("page_id", T.job_url_exact("url").alias("url"))


@query("""WITH u AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'https://linkedin.com/jobs/view/engineer-' || (1000000 + o_orderkey) WHEN 1 THEN 'https://in.indeed.com/viewjob?jk=' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 16) WHEN 2 THEN 'https://boards.greenhouse.io/acme/jobs/' || (100000 + o_orderkey) ELSE 'https://example.com/x' END AS url FROM orders)
SELECT id, CASE id % 4 WHEN 0 THEN 'linkedin' WHEN 1 THEN 'indeed' WHEN 2 THEN 'company_portal' END AS source, CASE id % 4 WHEN 1 THEN regexp_extract(url, 'jk=([0-9a-f]+)', 1) WHEN 3 THEN NULL ELSE regexp_extract(url, '(\\d+)$', 1) END AS job_id FROM u""")
def job_ids_from_urls(spark, sf):
    k = F.col("o_orderkey")
    u = V.choose(V.mod("o_orderkey", 4), ["a", "b", "c", "d"])
    url = F.when(u == "a", F.format_string("https://linkedin.com/jobs/view/engineer-%d", k + 1000000)).when(u == "b", F.concat(F.lit("https://in.indeed.com/viewjob?jk="), F.substring(F.md5(k.cast("string")), 1, 16))).when(u == "c", F.format_string("https://boards.greenhouse.io/acme/jobs/%d", k + 100000)).otherwise("https://example.com/x")
    found = V.read(spark, sf, "orders").select(k.alias("id"), T.job_id_from_url(url).alias("j"))
    return found.select("id", "j.source", "j.job_id")


@query("""SELECT sender, split_part(sender, '@', 2) AS domain, array_to_string(list_slice(string_split(split_part(sender, '@', 2), '.'), 2, 3), '.') AS registrable, sender AS personal, count(*) AS n FROM evidence GROUP BY ALL""")
def sender_identities(spark, sf):
    e = V.evidence(spark, sf).withColumn("full", F.concat(F.lit("Recruiter <"), F.upper("sender"), F.lit(">")))
    return e.groupBy("sender", T.sender_domain(F.col("full")).alias("domain"), T.registrable(T.sender_domain(F.col("full"))).alias("registrable"), T.personal_sender(F.col("full")).alias("personal")).agg(F.count("*").alias("n"))


@query("SELECT source_portal, 'other' AS source, count(*) AS n FROM application GROUP BY ALL UNION ALL SELECT 'Company Portal', 'company_portal', count(*) FROM orders UNION ALL SELECT 'Angel-List', 'wellfound', count(*) FROM orders")
def source_keys(spark, sf):
    seen = V.applications(spark, sf).select("source_portal")
    extra = V.read(spark, sf, "orders").select(F.explode(F.array(F.lit("Company Portal"), F.lit("Angel-List"))).alias("source_portal"))
    return seen.unionByName(extra).groupBy("source_portal", T.source_key(F.col("source_portal")).alias("source")).agg(F.count("*").alias("n"))


@query("""SELECT id, CASE WHEN external_id <> '' AND id % 2 = 0 THEN sha256('evidence-v1' || chr(31) || 'email' || chr(31) || source || chr(31) || 'ext' || chr(31) || external_id)
  ELSE sha256('evidence-v1' || chr(31) || 'email' || chr(31) || source || chr(31) || 'fields' || chr(31) || 't-' || id || chr(31) || sender || chr(31) || '' || chr(31) || 'about a job' || chr(31) || strftime(occurred_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' || chr(31) || 'a b') END AS fingerprint FROM evidence""")
def evidence_fingerprints(spark, sf):
    e = V.evidence(spark, sf)
    ext = F.when(V.mod("id", 2) == 0, F.col("external_id"))
    return e.select("id", T.evidence_fingerprint(F.lit("email"), F.col("source"), ext, F.concat(F.lit("t-"), F.col("id").cast("string")), F.col("sender"), F.lit(None).cast("string"), F.lit("Re: FW[2]:  About a  JOB"), F.col("occurred_at"), F.lit(" a\n b ")).alias("fingerprint"))


KEYWORDS = " ".join(f"WHEN regexp_matches(lower(text), '{'|'.join(words)}') THEN '{status}'" for status, words in T.STATUS_WORDS)


@query(f"SELECT conv_id, turn, coalesce(CASE {KEYWORDS} END, 'none') AS signal FROM (SELECT conv_id, turn, text || CASE (conv_id + turn) % 4 WHEN 0 THEN ' We regret to inform you' WHEN 1 THEN ' You are NOT shortlisted' WHEN 2 THEN ' your offer letter' ELSE '' END AS text FROM conversations)")
def status_signals(spark, sf):
    c = V.read(spark, sf, "conversations")
    tail = V.choose(F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4)), [" We regret to inform you", " You are NOT shortlisted", " your offer letter", ""])
    return c.select("conv_id", "turn", F.coalesce(T.ordered_keywords(F.concat("text", tail), T.STATUS_WORDS), F.lit("none")).alias("signal"))


@query("SELECT doc_id, regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}') AS had_address, false AS has_address FROM documents")
def redacted_documents(spark, sf):
    d = V.read(spark, sf, "documents").select("doc_id", "text", T.redact(F.col("text")).alias("clean"))
    return d.select("doc_id", F.col("text").rlike(T.EMAIL_PATTERN).alias("had_address"), F.col("clean").rlike(T.EMAIL_PATTERN).alias("has_address"))


@query("""SELECT CASE WHEN confidence IS NULL THEN 'none' WHEN confidence < 0.33 THEN '0.00-0.32' WHEN confidence < 0.67 THEN '0.33-0.66' WHEN confidence < 0.9 THEN '0.67-0.89' ELSE '0.90-1.00' END AS confidence,
  CASE WHEN floor(epoch(TIMESTAMP '2024-01-31' - occurred_at) / 86400) < 7 THEN '0-6d' WHEN floor(epoch(TIMESTAMP '2024-01-31' - occurred_at) / 86400) < 30 THEN '7-29d' ELSE '30-89d' END AS age, count(*) AS n FROM evidence GROUP BY ALL""")
def evidence_bands(spark, sf):
    e = V.evidence(spark, sf)
    as_of = F.lit(V.EVENTS_AS_OF).cast("timestamp_ntz")
    return e.groupBy(T.confidence_band(F.col("confidence")).alias("confidence"), T.age_band(F.col("occurred_at"), as_of).alias("age")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS id, 'APP-' || substr(sha256('seed' || chr(31) || 'application' || chr(31) || o_orderkey), 1, 10) AS label FROM orders")
def pseudonyms(spark, sf):
    return V.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), T.pseudonym("APP", "application", "seed", F.col("o_orderkey")).alias("label"))


@query("""SELECT o_orderkey AS id, strftime(CASE o_orderkey % 4 WHEN 0 THEN DATE '2001-08-01' - CAST(o_orderkey % 30 AS INTEGER) WHEN 1 THEN CAST(o_orderdate AS DATE) WHEN 2 THEN CAST(o_orderdate AS DATE) ELSE DATE '2001-07-31' END, '%Y-%m-%d') AS applied FROM orders""")
def applied_dates(spark, sf):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    written = F.when(V.mod("o_orderkey", 4) == 0, F.format_string("Applied %d days ago", F.pmod(k, F.lit(30)))).when(V.mod("o_orderkey", 4) == 1, F.concat(F.lit("Applied on "), F.date_format(d, "d MMM yyyy"))).when(V.mod("o_orderkey", 4) == 2, F.date_format(d, "MMM dd, yyyy")).otherwise("yesterday")
    return V.read(spark, sf, "orders").select(k.alias("id"), F.date_format(T.applied_on(written, F.lit(V.AS_OF).cast("date")), "yyyy-MM-dd").alias("applied"))
