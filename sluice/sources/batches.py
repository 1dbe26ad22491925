"""Batches of observations as JSON: a contract that lets nothing more through than it names.

Each line is a batch {batch_key, sent_at, observations: [...]}. Lines are read as VARIANT, so that
fields that no schema has are seen, and lie in quarantine with the reason in place of being dropped unseen.
A batch that breaks a limit of its own (its fields, key, time, size, or number of observations)
is refused whole, and so is one in which any observation is bad, as its sender must send it again; `problems`
names the batch's and the observation's faults. Counts within a batch are windows over its
observations.

`accepted` and `quarantine` split the observations of `read`. Lines that are no object are quarantined
as such; a null line is one of them. An empty table has no rows in either."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.sources.observations import SOURCE, SOURCES, STATUSES

# The contract's fields and limits.
BATCH_FIELDS = ["batch_key", "sent_at", "observations"]
FIELDS = ["source_key", "source_item_id", "company", "role", "applied_on", "status", "raw_status", "job_url", "proves_submission", "extraction", "observed_at", "adapter_version"]
NEEDED = ["source_key", "company", "status", "proves_submission", "extraction", "observed_at", "adapter_version"]
LENGTHS = {"source_key": (2, 48), "company": (1, 200), "role": (0, 300), "raw_status": (0, 80), "job_url": (0, 2048)}
PATTERNS = {"source_item_id": "^[A-Za-z0-9._:~-]{1,128}$", "adapter_version": "^[A-Za-z0-9._/+-]{1,40}$"}
EXTRACTIONS = ["verified", "unverified", "fallback", "heuristic"]
MOST_ROWS, MOST_BYTES, REPLAY_SECONDS, OLDEST_DAYS = 100, 256 * 1024, 900, 400
#: What a batch is read as for the names of its fields: no value is copied or written as text.
NAMES = "map<string,struct<none:string>>"
# Hosts of the jobs that a browser's import may name, by source.
HOSTS = {"linkedin": ["linkedin.com", "www.linkedin.com"], "indeed": ["indeed.com", "www.indeed.com", "in.indeed.com"]}


def _more(keys: Column, names: list[str]) -> Column:
    return F.size(F.array_except(keys, F.array(*map(F.lit, names)))) > 0


def _bits(faults: dict[str, Column], from_: int = 0) -> Column:
    """A bit for each fault, from the given one on."""
    return reduce(Column.__add__, [F.when(F.coalesce(bad, F.lit(False)), F.lit(1 << k)).otherwise(0) for k, bad in enumerate(faults.values(), from_)])


def _named(bits: Column, names: list[str], from_: int = 0) -> Column:
    """The names of the bits; array_except, unlike a filter, is in generated code with what it is of."""
    hits = [F.when(bits.bitwiseAND(F.lit(1 << k)) != 0, F.lit(name)) for k, name in enumerate(names, from_)]
    return F.array_except(F.array(*hits), F.array(F.lit(None).cast("string")))


def _on_hosts(hosts: dict[str, list[str]], host: Column) -> Column:
    out = F.lit(False)
    for source, names in hosts.items():
        out = out | ((F.col("source_key") == source) & host.isin(names))
    return out


def read(lines: DataFrame, as_of: str, column: str = "value", hosts: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per observation, and one for a batch that has none: batch_key, place, the contract's
    fields, and `problems` (of the batch and of the row). hosts limits job URLs to a source's
    hosts, and to these sources, as for imports from a browser."""
    now = F.lit(as_of).cast("timestamp")
    parsed = lines.select(F.monotonically_increasing_id().alias("line"), F.octet_length(column).alias("bytes"), F.try_parse_json(F.col(column)).alias("v"))
    v, f = F.col("v"), F.col
    get = lambda path, kind: F.try_variant_get(v, f"$.{path}", kind)
    # all of a batch's observations in two steps; an element that is no object is null in both
    rows = F.arrays_zip(get("observations", "array<map<string,string>>").alias("said"), get("observations", "array<struct<proves_submission:boolean>>").alias("yes"))
    batch = parsed.select("line", "bytes", F.map_keys(v.try_cast(NAMES)).alias("keys"), get("batch_key", "string").alias("batch_key"), get("sent_at", "string").try_cast("timestamp").alias("sent"), rows.alias("rows"))
    of_batch = {
        "not an object": f("keys").isNull(),
        "batch has more fields": _more(f("keys"), BATCH_FIELDS),
        "batch is too long": f("bytes") > MOST_BYTES,
        "no batch key": f("keys").isNotNull() & ~F.coalesce(f("batch_key").rlike("^[A-Za-z0-9_-]{8,100}$"), F.lit(False)),
        "sent at no time": f("keys").isNotNull() & f("sent").isNull(),
        "sent too long ago": f("sent") < now - F.make_dt_interval(secs=F.lit(REPLAY_SECONDS)),
        "no observations": f("keys").isNotNull() & (F.coalesce(F.size("rows"), F.lit(0)) < 1),
        "too many observations": F.size("rows") > MOST_ROWS,
    }
    judged = batch.select("line", "batch_key", _bits(of_batch).alias("bits"), "rows")
    each = judged.select("line", "batch_key", "bits", F.posexplode_outer("rows").alias("place", "o"))
    said = lambda name: f("o")["said"][name]
    kinds = {"applied_on": "date", "observed_at": "timestamp"}
    typed = {n: f("o")["yes"][n] if n == "proves_submission" else said(n).try_cast(kinds[n]) if n in kinds else said(n) for n in FIELDS}
    unread = reduce(Column.__or__, [said(n).isNotNull() & typed[n].isNull() for n in [*kinds, "proves_submission"]])
    missing = reduce(Column.__or__, [said(n).isNull() for n in NEEDED])
    whole = each.select("line", "batch_key", "bits", "place", f("place").isNotNull().alias("here"), F.map_keys(f("o")["said"]).alias("keys"), said("observed_at").rlike(r"(Z|[+-]\d{2}:?\d{2})$").alias("zoned"), unread.alias("unread"), missing.alias("missing"), *[c.alias(n) for n, c in typed.items()])
    host = F.lower(F.regexp_extract("job_url", r"^https://([^/?#:@]+)", 1))
    allowed = _on_hosts(hosts, host) if hosts is not None else F.lit(True)
    some = lambda faults: reduce(Column.__or__, [F.coalesce(x, F.lit(False)) for x in faults])
    of_row = {
        "not an object": f("here") & f("keys").isNull(),
        "more fields": _more(f("keys"), FIELDS),
        "a field is missing": f("here") & f("missing"),
        "a field can't be read": f("unread"),
        "unknown source": ~(f("source_key").isin(SOURCES) | f("source_key").rlike(SOURCE)),
        "unknown status": ~f("status").isin(STATUSES),
        "unknown extraction": ~f("extraction").isin(EXTRACTIONS),
        "a text is too short or too long": some([*[~F.length(n).between(*span) for n, span in LENGTHS.items()], F.trim("company") == ""]),
        "a text has other signs": some([~f(n).rlike(p) for n, p in PATTERNS.items()]),
        "no https URL": f("job_url").isNotNull() & (host == ""),
        "a foreign host": f("here") & ~F.coalesce(allowed, F.lit(False)),
        "a doubled id": F.lit(False),  # as the windows say
        "seen at no zone's time": f("observed_at").isNotNull() & ~f("zoned"),
        "seen too early or in the future": ~f("observed_at").between(now - F.make_dt_interval(days=F.lit(OLDEST_DAYS)), now + F.make_dt_interval(mins=F.lit(5))),
        "applied after it was seen": f("applied_on") > F.to_date("observed_at"),
        "an unknown status proves nothing": (f("status") == "unknown") & f("proves_submission"),
    }
    at = len(of_batch)
    doubled = at + list(of_row).index("a doubled id")
    marked = whole.select("line", "batch_key", "place", *FIELDS, (f("bits") + _bits(of_row, at)).alias("bits"))
    # a batch was one row, so its observations are few enough for one place; nothing is parsed twice for a join
    same = Window.partitionBy("line", "source_key", "source_item_id")
    times = F.when(f("source_item_id").isNotNull(), F.count("*").over(same))
    counted = marked.repartition("line").withColumn("bits", f("bits") + F.when(times > 1, F.lit(1 << doubled)).otherwise(0))
    bad = counted.withColumn("worst", F.max("bits").over(Window.partitionBy("line")))
    problems = F.when(f("bits") == 0, F.array().cast("array<string>")).otherwise(F.concat(_named(f("bits"), list(of_batch)), _named(f("bits"), list(of_row), at)))
    return bad.select("line", "batch_key", "place", *FIELDS, problems.alias("problems"), (f("worst") > 0).alias("refused"))


def accepted(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.col("refused")).drop("problems", "refused")


def quarantine(rows: DataFrame) -> DataFrame:
    """Observations of refused batches, each with its own faults and the batch's: none of its own
    where another one is at fault."""
    return rows.filter("refused")
