"""Checks and digests of the tables: quality of fields, domains, links between tables,
leaks of private text, samples and what changed between two snapshots."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.config import AUDIT_OFFERED, DATE_WINDOW_DAYS, INTERVIEWED, MAX_MERGE, Thresholds
from sluice.functions import text as T
from sluice.operators.components import checkpoint_dir
from sluice.operators.predicates import active_record, clock, stale

#: Least length of a private term, and the bytes of terms that one automaton may hold.
LEAST, TERM_BYTES = 4, 32 << 20
# Words of messages, which a job title doesn't have.
MESSAGE_WORDS = ["hi", "hello", "dear", "thank", "thanks", "thank you", "your", "you", "we", "our", "availability", "interest", "regarding", "please"]
SENTENCE = r"(?i)\b(" + "|".join(MESSAGE_WORDS) + r")\b"


def table_digest(df: DataFrame) -> DataFrame:
    """(rows, digest): equal for equal rows in any order; sums of hashes, so partial sums
    in the tasks do."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))


def changed_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """(change, n): rows that only one of two tables has, repeats counted."""
    gone, new = before.exceptAll(after), after.exceptAll(before)
    return gone.select(F.lit("gone").alias("change")).unionByName(new.select(F.lit("new").alias("change"))).groupBy("change").agg(F.count("*").alias("n"))


def delta(before: DataFrame, after: DataFrame, key: str = "name", value: str = "value") -> DataFrame:
    """Metrics that differ between two snapshots."""
    j = before.select(key, F.col(value).alias("before")).join(after.select(key, F.col(value).alias("after")), key, "full")
    return j.filter(~F.col("before").eqNullSafe(F.col("after")))


def _job_id(apps: DataFrame) -> Column:
    """The job id of a record: its own, else that of its URL."""
    known = T.job_id_from_url(T.job_url(F.col("job_url")))["job_id"]
    return F.coalesce(T.job_id(F.col("external_job_id")), known) if "external_job_id" in apps.columns else known


def data_quality(applications: DataFrame) -> DataFrame:
    """One row of counts over active applications."""
    apps = applications.filter(active_record())
    role = F.coalesce("role", F.lit(""))
    shared = apps.select("id", F.explode(F.array_distinct("thread_ids")).alias("t")).groupBy("t").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("shared_threads"))
    one = apps.agg(F.count("*").alias("active_applications"), F.count_if(F.trim(role) == "").alias("empty_role"), F.count_if(role.rlike(SENTENCE) | (F.length(role) > 70)).alias("sentence_like_role"), F.count_if(F.size("thread_ids") == 0).alias("without_thread"), F.count_if(F.col("job_url") != "").alias("with_job_url"), F.count(_job_id(apps)).alias("with_external_job_id"))
    return one.crossJoin(shared)  # one row each


def outside_domain(df: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """(value, n) of what the domain doesn't hold."""
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(domain)).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Children whose parent isn't there; a null key has none to miss."""
    return child.filter(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def snapshot(applications: DataFrame, as_of: str) -> DataFrame:
    """(name, value) in the order of names. Offers include negotiations here."""
    now = F.col("current_status")
    apps = applications.filter(active_record() & ~F.col("is_false_positive"))
    one = apps.agg(F.count("*").alias("total"), F.count_if(now.isin(AUDIT_OFFERED)).alias("offers"), F.count_if(now.isin(INTERVIEWED)).alias("interviews"), F.count_if(stale(as_of)).alias("stale"), F.count_if(F.datediff(clock(as_of), "applied_date") <= 180).alias("last_180_days"))
    fixed = one.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in one.columns]), F.array(*one.columns))).alias("name", "value"))
    cells = F.explode(F.array(F.concat(F.lit("status:"), now), F.concat(F.lit("source:"), F.col("source_portal"))))
    return fixed.unionByName(apps.select(cells.alias("name")).groupBy("name").agg(F.count("*").alias("value")))


def snapshot_digest(metrics: DataFrame) -> DataFrame:
    """SHA-256 of the sorted metrics: a snapshot is a few dozen rows."""
    row = F.concat("name", F.lit("="), F.col("value").cast("string"))
    return metrics.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(row)), "\n"), 256).alias("digest"))


def stratified(df: DataFrame, key: str, id_col: str, n: int, seed: int) -> DataFrame:
    """At most n rows of each key, by a seeded hash."""
    w = Window.partitionBy(key).orderBy(F.xxhash64(F.lit(seed), F.col(id_col)), id_col)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def stored_terms(tables: list[tuple[DataFrame, list[str]]], least: int = LEAST) -> DataFrame:
    """(term): distinct texts of private columns, at least so long."""
    parts = [df.select(F.explode(F.array(*[F.trim(F.col(c).cast("string")) for c in columns])).alias("term")) for df, columns in tables]
    return reduce(DataFrame.unionByName, parts).filter(F.length("term") >= least).distinct()


def _matches(texts: DataFrame, terms: list[str]) -> DataFrame:
    """(file, term, email) of the terms in each text, overlapping ones too, and once with no term
    where a text holds an address. A task builds its automaton once; texts stay where they are."""
    sent = texts.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for k, term in enumerate(sent.value):
            automaton.add_word(term, k)
        automaton.make_automaton()
        for batch in batches:
            at, found, address = [], [], []
            for row, (text, email) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                here: list[int | None] = [*({k for _, k in automaton.iter(text)} if text and sent.value else ())]
                if email:
                    here.append(None)
                at += [row] * len(here)
                found += [None if k is None else sent.value[k] for k in here]
                address += [k is None for k in here]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string()), pa.array(address, pa.bool_())], names=["file", "term", "email"])

    return texts.mapInArrow(run, f"file {texts.schema['file'].dataType.simpleString()}, term string, email boolean")


def leaks(texts: DataFrame, terms: DataFrame, benign: list[str] | None = None, least: int = LEAST, budget: int = TERM_BYTES) -> DataFrame:
    """(file, term, email): private terms that a file's texts contain, as they stand in any
    place, by an automaton of all terms; and a row of no term where a file holds an e-mail address.
    Numbers and `benign` words are no terms; case doesn't count.

    The terms' size is measured first. Up to `budget` bytes they are one automaton; beyond it
    they are dealt by hash to as many as they need, one pass over the texts each."""
    rows = texts.select("file", F.lower("text").alias("text"), F.coalesce(F.col("text").rlike(T.EMAIL_PATTERN), F.lit(False)).alias("email"))
    low = F.lower("term")
    good = terms.filter((F.length("term") >= least) & ~F.col("term").rlike(r"^\d+$")).select(low.alias("term")).distinct()
    if benign:
        good = good.filter(~F.col("term").isin(*{b.lower() for b in benign}))
    size = good.agg(F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()[0]
    parts = max(1, -(-size // budget))
    if parts > 1:
        checkpoint_dir(texts.sparkSession)
    found = None
    for part in range(parts):
        some = good if parts == 1 else good.filter(F.pmod(F.xxhash64("term"), F.lit(parts)) == part)
        one = _matches(rows if part == 0 else rows.withColumn("email", F.lit(False)), [r.term for r in some.collect()]).distinct()
        one = one if parts == 1 else one.checkpoint()
        found = one if found is None else found.unionByName(one)
    return found


def leak_report(found: DataFrame) -> DataFrame:
    """Per file with any: how many stored values it shows, and whether an address."""
    return found.groupBy("file").agg(F.count_distinct("term").alias("terms"), F.max("email").alias("email"))


def workload(items: DataFrame) -> DataFrame:
    return items.groupBy(F.concat_ws(":", "kind", "category").alias("queue")).agg(F.count("*").alias("n"))


def review_plan(kinds: list[DataFrame]) -> DataFrame:
    """Items of several kinds in the order of their priority, each pair once."""
    all_ = None
    for rank, items in enumerate(kinds):
        part = items.select("kind", "category", "item", F.lit(rank).alias("rank"))
        all_ = part if all_ is None else all_.unionByName(part)
    w = Window.partitionBy("item").orderBy("rank", "kind")
    return all_.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def group_category(features: str = "") -> Column:
    """Category of a duplicate group by the columns of duplicates.group_features."""
    f = lambda c: F.col(f"{features}{c}")
    strong = f("conflicting_ids") | (f("urls") > 1) | (f("size") > MAX_MERGE)
    sure = (f("min_score") >= Thresholds().auto_link) & (f("roles") <= 1) & (f("days") <= DATE_WINDOW_DAYS[1])
    return F.when(strong, "do_not_merge_strong_conflict").when(f("min_score") < Thresholds().duplicate, "insufficient_evidence").when(sure, "high_confidence_review").otherwise("medium_confidence_review")


def freshness(state: DataFrame, as_of: str, minutes: int = 15) -> DataFrame:
    """Per source whether it was seen within the minutes before."""
    return state.groupBy("source").agg(F.max("occurred_at").alias("at")).select("source", (F.timestamp_diff("MINUTE", "at", clock(as_of)) <= minutes).alias("fresh"))


def export_rows(applications: DataFrame) -> DataFrame:
    """The columns of an export: dates as text, nothing null, no false positives."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    day = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")).alias(c)
    return applications.filter(active_record() & ~F.col("is_false_positive")).select("id", *[text(c) for c in ("company", "role", "source_portal", "application_method", "current_status", "job_url")], *[day(c) for c in ("applied_date", "created_at", "updated_at")])
