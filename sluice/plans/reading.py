"""Sources over the test tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice import views as V
from sluice.plans.registry import query
from sluice.sources import batches, mail, observations, pastes, prospects, rules, tables

RULES = [{"portal": "mail0", "domains": ["mail0.example.com"], "subjects": ["click"]}, {"portal": "any", "domains": ["example.com"]}, {"portal": "fallback", "subjects": ["purchase"]}]


def _mail(spark, sf):
    """Events as landed mail: a message each with headers and two parts."""
    e = V.evidence(spark, sf).join(V.read(spark, sf, "events").select(F.col("event_id").alias("id"), "event_type"), "id")
    head = F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in (("From", F.concat(F.lit("R <"), "sender", F.lit(">"))), ("subject", F.concat(F.lit("Re: "), "event_type")), ("Date", F.concat(F.date_format("occurred_at", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0000"))))])
    part = lambda kind, text: F.struct(F.lit(kind).alias("mimeType"), F.struct(F.base64(F.encode(text, "UTF-8")).alias("data")).alias("body"))
    payload = F.struct(F.lit("multipart/mixed").alias("mimeType"), head.alias("headers"), F.array(part("text/html", F.lit("<p>")), part("text/plain", F.concat(F.lit("body of "), F.col("id").cast("string")))).alias("parts"))
    return e.select(F.to_json(F.struct(F.col("id").cast("string").alias("id"), F.concat(F.lit("t"), F.col("application_id").cast("string")).alias("threadId"), payload.alias("payload"))).alias("value"))


@query("SELECT CAST(e.id AS VARCHAR) AS message_id, 'R <' || sender || '>' AS sender, 'Re: ' || event_type AS subject, strftime(occurred_at, '%Y-%m-%d %H:%M:%S') AS date, 'body of ' || e.id AS body_text FROM evidence e JOIN events ON event_id = e.id")
def mail_decoded(spark, sf):
    d = mail.decode(_mail(spark, sf))
    return d.select("message_id", "sender", "subject", F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"), "body_text")


@query("SELECT CASE WHEN split_part(sender, '@', 2) = 'mail0.example.com' AND event_type = 'click' THEN 'mail0' ELSE 'any' END AS portal, count(*) AS n FROM evidence e JOIN events ON event_id = e.id GROUP BY 1")
def mail_portals(spark, sf):
    return rules.match(mail.decode(_mail(spark, sf)), RULES).groupBy("portal").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM evidence e JOIN events ON event_id = e.id WHERE NOT starts_with(sender, 'recruit0@') AND NOT (starts_with(sender, 'recruit1@') AND event_type = 'error')")
def mail_unsuppressed(spark, sf):
    kept = rules.unsuppressed(mail.decode(_mail(spark, sf)), [{"sender": "recruit0@"}, {"sender": "recruit1@", "subject": "error"}, {"sender": "((bad"}])
    return kept.agg(F.count("*").alias("n"))


def _lines(spark, sf):
    o = V.observations(spark, sf)
    row = F.to_json(F.struct("source_key", F.col("item_key").alias("source_item_id"), F.when(F.pmod("id", F.lit(10)) > 0, "Acme").alias("company"), V.choose(V.mod("id", 3), ["applied", "offer", "odd"]).alias("status"), F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("observed_at")))
    return o.select(F.when(F.pmod("id", F.lit(101)) == 0, F.lit("not json")).otherwise(row).alias("value"))


@query("""WITH o AS (SELECT *, id % 101 = 0 AS junk, id % 10 = 0 AS nameless, id % 3 = 2 AS odd, observed_at < TIMESTAMP '2001-08-01' - INTERVAL 400 DAY OR observed_at > TIMESTAMP '2001-08-01 00:05:00' AS late FROM observation)
SELECT count(*) FILTER (NOT junk AND NOT nameless AND NOT odd AND NOT late) AS good, count(*) FILTER (junk OR nameless OR odd OR late) AS bad, count(*) FILTER (junk) AS not_json FROM o""")
def observation_checks(spark, sf):
    rows = observations.parse(_lines(spark, sf))
    bad = F.size(observations.problems(V.AS_OF)) > 0
    return rows.agg(F.count_if(~bad).alias("good"), F.count_if(bad).alias("bad"), F.count_if(F.col("_corrupt_record").isNotNull()).alias("not_json"))


@query("""WITH o AS (SELECT id // 8 AS line, id % 10 = 0 AS more, count(*) OVER (PARTITION BY id // 8, source_key, item_key) > 1 AS doubled FROM observation)
SELECT max(more OR doubled) OVER (PARTITION BY line) AS refused, concat_ws(', ', CASE WHEN more THEN 'more fields' END, CASE WHEN doubled THEN 'a doubled id' END) AS reasons FROM o""".replace("SELECT max", "SELECT refused, reasons, count(*) AS n FROM (SELECT max") + ") GROUP BY 1, 2")
def strict_batches(spark, sf):
    """The sightings of an order as a batch; some say more than the contract names."""
    o = V.observations(spark, sf)
    named = F.collect_list(F.struct("source_key", F.col("item_key").alias("source_item_id"), F.when(F.pmod("id", F.lit(10)) == 0, "x").alias("note")))
    each = {"company": "Acme", "status": "applied", "proves_submission": True, "extraction": "verified", "observed_at": "2001-07-31T10:00:00Z", "adapter_version": "1.0"}
    rows = F.transform("named", lambda x: F.struct(*[x[n].alias(n) for n in ("source_key", "source_item_id")], *[F.lit(v).alias(n) for n, v in each.items()], x["note"].alias("note")))
    head = '{"batch_key": "batch-0001", "sent_at": "2001-08-01T00:00:00Z", "observations": '
    lines = o.groupBy(F.floor(F.col("id") / 8).alias("order")).agg(named.alias("named")).select(F.concat(F.lit(head), F.to_json(rows), F.lit("}")).alias("value"))  # an order has a few lines
    return batches.read(lines, f"{V.AS_OF} 00:00:00").groupBy("refused", F.array_join("problems", ", ").alias("reasons")).agg(F.count("*").alias("n"))


SUBJECTS = ["Interview tips", "Schedule a CALL", "We are hiring for you", "Top job picks, hiring for all", ""]
_KIND = "CASE WHEN regexp_matches(said, '{}') THEN NULL ".format(prospects.whole_words(prospects.DIGESTS)) + " ".join(f"WHEN regexp_matches(said, '{prospects.whole_words(p)}') THEN '{k}'" for k, p in prospects.PHRASES.items()) + " END"


@query(f"""WITH m AS (SELECT conv_id, turn, lower(CASE conv_id % 5 WHEN 0 THEN '{SUBJECTS[0]}' WHEN 1 THEN '{SUBJECTS[1]}' WHEN 2 THEN '{SUBJECTS[2]}' WHEN 3 THEN '{SUBJECTS[3]}' ELSE '' END || ' ' || text) AS said FROM conversations WHERE turn % 3 <> 1)
SELECT conv_id, turn, category FROM (SELECT conv_id, turn, {_KIND} AS category FROM m) WHERE category IS NOT NULL""")
def mail_prospects(spark, sf):
    """Turns as mail, two in three from the job network."""
    c = V.read(spark, sf, "conversations")
    sender = V.choose(V.mod("turn", 3), ["Li <x@linkedin.com>", "x@example.com", "x@e.linkedin.com"])
    mails = c.select(F.concat_ws("/", "conv_id", "turn").alias("message_id"), F.col("conv_id").cast("string").alias("thread_id"), sender.alias("sender"), V.choose(V.mod("conv_id", 5), SUBJECTS).alias("subject"), F.col("text").alias("snippet"))
    found = prospects.prospects(mails)
    return found.select(F.substring_index("message_id", "/", 1).cast("long").alias("conv_id"), F.substring_index("message_id", "/", -1).cast("long").alias("turn"), "category")


@query(f"""SELECT o_orderkey AS paste_id, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE c_name END AS company, CASE o_orderkey % 4 WHEN 2 THEN 'Clerk' ELSE o_orderpriority END AS role,
  CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE strftime(DATE '{V.AS_OF}' - CAST(o_orderkey % 9 + 1 AS INTEGER) * CASE o_orderkey % 4 WHEN 0 THEN 7 WHEN 1 THEN 1 ELSE 30 END, '%Y-%m-%d') END AS applied_on FROM orders JOIN customer ON c_custkey = o_custkey""")
def pasted_entries(spark, sf):
    """Each order as it would be pasted, in four layouts, between noise, places and blank lines."""
    a = V.read(spark, sf, "orders").join(V.read(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    n = F.concat(F.lit("Applied "), (V.mod("o_orderkey", 9) + 1).cast("string"))
    lines = lambda *parts: F.concat_ws("\n", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    layouts = [
        lines("", F.concat("c_name", F.lit(" Ltd.")), "", F.col("o_orderpriority"), "Add note", "Pune, India", F.concat(n, F.lit("w ago"))),
        lines("Easy Apply", F.col("o_orderpriority"), F.concat(F.lit("Remote · "), "c_name", F.lit(" · Pune")), F.concat(n, F.lit(" days ago"))),
        lines(F.concat(F.lit("Clerk at "), "c_name"), "(Reposted 1w ago)", F.concat(n, F.lit("mo ago"))),
        lines("  ", F.col("o_orderpriority"), "12 applicants", "Archived"),
    ]
    found = pastes.pasted(a.select(F.col("o_orderkey").alias("paste_id"), F.coalesce(*[F.when(V.mod("o_orderkey", 4) == k, t) for k, t in enumerate(layouts)]).alias("text")), F.lit(V.AS_OF).cast("date"))
    return found.select("paste_id", "company", "role", F.date_format("applied_on", "yyyy-MM-dd").alias("applied_on"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'Offer' WHEN 1 THEN 'Applied' ELSE 'Rejected' END AS status, CASE WHEN o_orderkey % 2 = 0 THEN 'Direct/Consultancy' ELSE c_mktsegment END AS portal, strftime(o_orderdate, '%Y-%m-%d') AS applied_on FROM orders JOIN customer ON c_custkey = o_custkey")
def sheet_rows(spark, sf):
    a = V.read(spark, sf, "orders").join(V.read(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    rows = a.select(F.col("o_orderkey").cast("string").alias("company"), F.lit("x").alias("role"), F.when(V.mod("o_orderkey", 2) == 1, F.col("c_mktsegment")).alias("portal"), V.choose(V.mod("o_orderkey", 3), [" OFFER", "whatever", "rejected"]).alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("applied"))
    return tables.sheet(rows).select(F.col("company").cast("long").alias("id"), "status", "portal", F.date_format("applied_on", "yyyy-MM-dd").alias("applied_on"))


@query("WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1)) AS href FROM pages) SELECT page_id, count(*) AS links, count(DISTINCT href) AS targets FROM l GROUP BY 1")
def page_links(spark, sf):
    return tables.page_links(V.read(spark, sf, "pages")).groupBy("page_id").agg(F.count("*").alias("links"), F.count_distinct("href").alias("targets"))


@query("SELECT 'list' AS state, count(*) AS n FROM pages")
def page_states(spark, sf):
    p = V.read(spark, sf, "pages")
    return p.groupBy(tables.page_state(F.col("html"), F.col("url")).alias("state")).agg(F.count("*").alias("n"))
