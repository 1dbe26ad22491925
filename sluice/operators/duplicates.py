"""Suggested duplicates among applications. A pair of `duplicate` points or more agrees in
job id and source, in URL, or in company and role: three equal joins find all of them
(the weights leave no other way), and only what they find is scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.config import DATE_WINDOW_DAYS, WEIGHTS, Thresholds
from sluice.functions import fuzzy
from sluice.functions import text as T
from sluice.operators.components import checkpoint_dir
from sluice.operators.predicates import active_record

#: Seconds between two dates that are near.
WINDOW = DATE_WINDOW_DAYS[1] * 86400
#: What makes an identity but for its date.
CLASS = ["company", "role", "url", "job_id", "source"]

assert WEIGHTS["company_exact"] + WEIGHTS["role_similar"] + WEIGHTS["date_in_window"] < Thresholds().duplicate
assert WEIGHTS["company_similar"] + WEIGHTS["role_exact"] + WEIGHTS["date_in_window"] < Thresholds().duplicate


def identity(applications: DataFrame, ascii_only: bool = False, active_only: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """What pairs are compared by: normal forms, canonical URL, job id and its source, and
    the source of the portal; further columns are carried along."""
    url = T.job_url(F.col("job_url"))
    cols = applications.columns
    stored = T.job_id(F.col("external_job_id")) if "external_job_id" in cols else F.lit(None).cast("string")
    base = (applications.filter(active_record()) if active_only else applications).select("id", "applied_date", T.company(F.col("company"), ascii_only).alias("company"), T.role(F.col("role"), ascii_only).alias("role"), url.alias("url"), stored.alias("stored"), T.source_key(F.col("source_portal")).alias("portal"), "current_status", *carry)
    found = base.withColumn("known", T.job_id_from_url(F.col("url")))
    return found.select("id", "applied_date", "company", "role", "url", F.coalesce("stored", "known.job_id").alias("job_id"), F.coalesce("known.source", "portal").alias("source"), "portal", "current_status", *carry)


def _w(name: str) -> Column:
    return F.lit(WEIGHTS[name])


def _part(cond: Column, name: str) -> Column:
    return F.when(cond, _w(name)).otherwise(0)


def class_score(l: str = "l", r: str = "r", fuzzily: bool = True) -> tuple[Column, list[Column]]:
    """Score of a pair of identities but for their dates, and its reasons (null where not)."""
    a, b = (lambda c, s=s: F.col(f"{s}.{c}") for s in (l, r))
    same_source = F.coalesce(a("job_id").isNotNull() & b("job_id").isNotNull() & (a("source") == b("source")), F.lit(False))
    same_id, same_url = same_source & (a("job_id") == b("job_id")), F.coalesce(a("url") == b("url"), F.lit(False))
    if fuzzily:
        company, role = fuzzy.company_relation(a("company"), b("company")), fuzzy.role_relation(a("role"), b("role"))
    else:
        exact = lambda c: F.when((a(c) == b(c)) & (a(c) != ""), "exact")
        company, role = exact("company"), exact("role")
    score = _part(same_id, "same_external_job_id") + _part(same_source & ~same_id, "external_job_id_conflict") + _part(same_url, "same_canonical_job_url")
    for kind, relation in (("company", company), ("role", role)):
        score += F.when(relation == "exact", _w(f"{kind}_exact")).when(relation == "similar", _w(f"{kind}_similar")).when(relation == "conflict", _w(f"{kind}_conflict")).otherwise(0)
    return score, [
        F.when(same_id, "Same job ID on the same source"), F.when(same_source & ~same_id, "Different job IDs on the same source"), F.when(same_url, "Same canonical job URL"),
        F.when(company == "exact", "Same normalized company").when(company == "similar", "Similar company"), F.when(role == "exact", "Same normalized role").when(role == "similar", "Similar role"),
    ]


def pair_score(l: str = "l", r: str = "r", fuzzily: bool = True) -> tuple[Column, Column]:
    """Score and reasons of a pair of identities."""
    score, reasons = class_score(l, r, fuzzily)
    near = F.abs(F.timestamp_diff("SECOND", F.col(f"{l}.applied_date"), F.col(f"{r}.applied_date"))) <= WINDOW
    score += F.when(near, _w("date_in_window")).otherwise(_w("date_out_of_window"))
    return score, F.array_compact(F.array(*reasons, F.when(~near, "Applied far apart in time")))


def _scored(pairs: DataFrame, fuzzily: bool) -> DataFrame:
    score, why = pair_score(fuzzily=fuzzily)
    return pairs.select(F.col("l.id").alias("lo"), F.col("r.id").alias("hi"), score.alias("score"), why.alias("reasons"))


def candidate_pairs(known: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """(lo, hi, score, reasons) of all pairs that reach the threshold. Company and role
    are exact within their own block, so no Python runs there; that block is joined by
    stretches of the date window and their neighbours too, as one company and role may
    hold any number of records."""
    l, r = known.alias("l"), known.alias("r")
    apart = F.col("l.id") < F.col("r.id")
    equal = lambda *cs: [F.col(f"l.{c}") == F.col(f"r.{c}") for c in cs]
    near = F.abs(F.datediff("l.applied_date", "r.applied_date")) <= DATE_WINDOW_DAYS[1]
    named = known.filter("company <> '' AND role <> ''").withColumn("stretch", F.floor(F.unix_date(F.to_date("applied_date")) / DATE_WINDOW_DAYS[1]))
    around = named.withColumn("stretch", F.explode(F.sequence(F.col("stretch") - 1, F.col("stretch") + 1)))
    text = around.alias("l").join(named.alias("r"), [*equal("company", "role", "stretch"), apart, near])
    ids = l.filter("job_id IS NOT NULL").join(r, [*equal("job_id", "source"), apart])
    urls = l.filter("url IS NOT NULL").join(r, [*equal("url"), apart])
    found = _scored(text, False).unionByName(_scored(ids, True)).unionByName(_scored(urls, True))
    return found.groupBy("lo", "hi").agg(F.max_by("score", F.size("reasons")).alias("score"), F.max_by("reasons", F.size("reasons")).alias("reasons")).filter(F.col("score") >= thresholds.duplicate)


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws(":", F.least(a, b), F.greatest(a, b))


def undismissed(pairs: DataFrame, dismissed: DataFrame) -> DataFrame:
    """Pairs whose key (pair_key) nobody has dismissed."""
    return pairs.withColumn("pair_key", pair_key(F.col("lo"), F.col("hi"))).join(dismissed.select("pair_key"), "pair_key", "left_anti")


def _link(one: Column, other: Column, seconds: int | None = WINDOW) -> Column:
    """The link of a row with a neighbour, where there is one and it is near enough."""
    near = other.isNotNull() if seconds is None else other.isNotNull() & (F.abs(F.timestamp_diff("SECOND", one["at"], other["at"])) <= seconds)
    return F.when(near, F.struct(F.least(one["id"], other["id"]).alias("lo"), F.greatest(one["id"], other["id"]).alias("hi")))


def _swept(nodes: DataFrame, *groups_: str) -> DataFrame:
    """Links of every row with its neighbours by date within the groups: the next of its own job
    id, those without a job id before and after it, and those of another source before and after it.
    Every pair of the window whose job ids don't conflict is joined by a way of such links."""
    me = F.struct(F.col("applied_date").alias("at"), "id")
    by = [*groups_]
    order = ["applied_date", "id"]
    free = F.when(F.col("job_id").isNull() | F.col("source").isNull(), me)
    named = F.when(free.isNull(), F.col("source"))
    rows = nodes.withColumns({"me": me, "free": free, "named": named, "taken": named.isNotNull()})
    links = []
    for back in (False, True):
        keys = [F.desc(c) for c in order] if back else [F.asc(c) for c in order]
        w = Window.partitionBy(*by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
        links.append(F.last("free", True).over(w))
        # the last of another source is the last of the run of sources before one's own
        of_taken = Window.partitionBy(*by, "taken").orderBy(*keys)
        before = F.when(F.lag("named").over(of_taken) != F.col("named"), F.lag("me").over(of_taken))
        rows = rows.withColumn(f"turn{back:d}", F.when(F.col("taken"), before))
        links.append(F.when(F.col("taken"), F.last(f"turn{back:d}", True).over(of_taken)))
    own = Window.partitionBy(*by, "source", "job_id").orderBy(*order)
    links.append(F.when(F.col("taken"), F.lag("me").over(own)))
    made = rows.select("me", F.array(*links).alias("others")).select("me", F.explode("others").alias("other"))
    return made.select(_link(F.col("me"), F.col("other")).alias("link")).filter("link IS NOT NULL").select("link.lo", "link.hi").distinct()


def text_links(known: DataFrame) -> DataFrame:
    """(lo, hi): at most a few links a record that join all records of one company and role
    whose dates are near and whose job ids don't conflict, as all such pairs would.

    Records are sorted over the whole table and swept in ranges, so one company and role is
    no single task; a company and role in several ranges is swept once more by what each
    range's first and last of each job id are."""
    checkpoint_dir(known.sparkSession)
    order = ["company", "role", "applied_date", "id"]
    named = known.filter("company <> '' AND role <> '' AND applied_date IS NOT NULL").select(*order, "job_id", "source")
    placed = named.repartitionByRange(*order).withColumn("range", F.spark_partition_id()).checkpoint()
    inside = _swept(placed, "company", "role", "range")
    several = placed.groupBy("company", "role").agg((F.min("range") < F.max("range")).alias("several")).filter("several").drop("several")
    node = F.struct("applied_date", "id")
    ends = placed.join(several, ["company", "role"], "left_semi").groupBy("company", "role", "range", "job_id", "source").agg(F.min(node).alias("a"), F.max(node).alias("b"))
    edge = ends.select("company", "role", "job_id", "source", F.explode(F.array_distinct(F.array("a", "b"))).alias("n")).select("company", "role", "job_id", "source", "n.applied_date", "n.id")
    return inside.unionByName(_swept(edge, "company", "role"))


def class_pairs(known: DataFrame, keys: list[str]) -> DataFrame:
    """(cl, cr, base): pairs of classes of identities with equal keys, a class with itself too where
    it has several records, and their score but for the dates. A key's classes are few where its
    records are many: they differ by company, role, URL, job id or source."""
    l, r = known.alias("l"), known.alias("r")
    both = l.join(r, [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys] + [(F.col("l.cid") < F.col("r.cid")) | ((F.col("l.cid") == F.col("r.cid")) & (F.col("l.n") > 1))])
    base, reasons = class_score()
    return both.select(*[F.col(f"l.{k}").alias(k) for k in keys], F.col("l.cid").alias("cl"), F.col("r.cid").alias("cr"), F.col("l.least").alias("al"), F.col("r.least").alias("ar"), (F.col("l.n") * F.when(F.col("l.cid") == F.col("r.cid"), (F.col("l.n") - 1) / 2).otherwise(F.col("r.n"))).cast("long").alias("pairs"), base.alias("base"), F.array_compact(F.array(*reasons)).alias("reasons"))


def classed(known: DataFrame) -> DataFrame:
    """known with cid, a digest of what but the date identifies a record."""
    return known.withColumn("cid", F.md5(F.to_json(F.struct(*CLASS), {"ignoreNullFields": "false"})))


def classes_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key and class of classed rows."""
    return rows.groupBy(*dict.fromkeys([*keys, "cid", *CLASS])).agg(F.count("*").alias("n"), F.min("id").alias("least"), F.min("applied_date").alias("from_date"), F.max("applied_date").alias("to_date"))


def between(pairs: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cl, cr, one, other): for each pair of classes every record with its nearest
    neighbours by date on the other side (for a class with itself, the one before it)."""
    side = lambda c, n: pairs.select(*keys, "cl", "cr", F.col(c).alias("cid"), F.lit(n).alias("side"))
    sides = side("cl", 0).unionByName(side("cr", 1).filter("cl <> cr"))
    node = F.struct(F.col("applied_date").alias("at"), "id")
    members = sides.join(rows.select(*keys, "cid", "id", "applied_date"), [*keys, "cid"]).withColumn("me", node)
    w = Window.partitionBy(*keys, "cl", "cr").orderBy("applied_date", "id")
    left, right = F.when(F.col("side") == 0, F.col("me")), F.when(F.col("side") == 1, F.col("me"))
    before = F.when(F.col("cl") == F.col("cr"), F.lag("me").over(w)).when(F.col("side") == 0, F.last(right, True).over(w)).otherwise(F.last(left, True).over(w))
    met = members.withColumn("other", before).select(*keys, "cl", "cr", "me", "side", "other")
    down = Window.partitionBy(*keys, "cl", "cr").orderBy(F.desc("me"))
    after = F.when(F.col("cl") < F.col("cr"), F.when(F.col("side") == 0, F.last(right, True).over(down)).otherwise(F.last(left, True).over(down)))
    both = met.withColumn("others", F.array("other", after))
    return both.select(*keys, "cl", "cr", F.col("me").alias("one"), F.explode("others").alias("other")).filter("other IS NOT NULL")


def class_links(known: DataFrame, keys: list[str], thresholds: Thresholds) -> DataFrame:
    """(lo, hi) that join what the pairs of equal keys would: by classes where the dates don't
    matter, and by neighbours in time where they do."""
    rows = classed(known.filter(" AND ".join(f"{k} IS NOT NULL" for k in keys)))
    pairs = class_pairs(classes_of(rows, keys), keys).checkpoint()
    far, near = F.col("base") + _w("date_out_of_window"), F.col("base") + _w("date_in_window")
    always = pairs.filter(far >= thresholds.duplicate)
    heads = always.filter("cl = cr").select(*keys, F.col("cl").alias("cid"), F.col("al").alias("lo"))
    stars = rows.join(heads, [*keys, "cid"]).select("lo", F.col("id").alias("hi"))
    across = always.filter("cl <> cr").select(F.least("al", "ar").alias("lo"), F.greatest("al", "ar").alias("hi"))
    at_times = pairs.filter((far < thresholds.duplicate) & (near >= thresholds.duplicate))
    swept = between(at_times, rows, keys).select(_link(F.col("one"), F.col("other")).alias("link")).filter("link IS NOT NULL").select("link.lo", "link.hi")
    return stars.unionByName(across).unionByName(swept).filter("lo <> hi")


def links(known: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """(lo, hi) that join the same groups as all candidate_pairs, without making all pairs."""
    checkpoint_dir(known.sparkSession)
    known = known.checkpoint()  # three ways read it, and links are read twice
    named = WEIGHTS["company_exact"] + WEIGHTS["role_exact"] + WEIGHTS["date_in_window"] >= thresholds.duplicate
    by_keys = class_links(known, ["job_id", "source"], thresholds).unionByName(class_links(known, ["url"], thresholds))
    return (by_keys.unionByName(text_links(known)) if named else by_keys).distinct().checkpoint()


def group_features(members: DataFrame, known: DataFrame) -> DataFrame:
    """Per group (id, root) of duplicates: size, span of days, distinct URLs and roles, whether job ids
    of one source conflict, and over ALL pairs of the group the least and greatest score, how many there are and
    how many have each reason. The extremes come from pairs of identity classes (`class_pairs`), of which a group
    has few where it has many records; dates matter by their extremes and by neighbours."""
    checkpoint_dir(known.sparkSession)
    rows = classed(members.join(known, "id")).checkpoint()
    classes = classes_of(rows, ["root"])  # all that follows but for the dates' neighbours reads these
    conflict = classes.groupBy("root", "source").agg((F.col("source").isNotNull() & (F.min("job_id") != F.max("job_id"))).alias("c")).groupBy("root").agg(F.coalesce(F.max("c"), F.lit(False)).alias("conflicting_ids"))
    spread = classes.groupBy("root").agg(F.sum("n").alias("size"), F.floor(F.timestamp_diff("SECOND", F.min("from_date"), F.max("to_date")) / 86400).cast("int").alias("days"), F.count_distinct("url").alias("urls"), F.count_distinct(F.when(F.col("role") != "", F.col("role"))).alias("roles"))
    pairs = class_pairs(classes, ["root"])
    dates = classes.select("root", "cid", "from_date", "to_date")
    l, r = (dates.select("root", F.col("cid").alias(c), F.col("from_date").alias(f"{c}f"), F.col("to_date").alias(f"{c}t")) for c in ("cl", "cr"))
    spans = pairs.join(l, ["root", "cl"]).join(r, ["root", "cr"]).checkpoint()
    widest = F.greatest(F.timestamp_diff("SECOND", "crf", "clt"), F.timestamp_diff("SECOND", "clf", "crt"))
    apart = spans.filter(widest > WINDOW).select("root", "cl", "cr")  # of the others every pair is near
    nearest = between(apart, rows, ["root"]).groupBy("root", "cl", "cr").agg(F.min(F.abs(F.timestamp_diff("SECOND", F.col("one.at"), F.col("other.at")))).alias("nearest"))
    at = lambda seconds: F.when(seconds <= WINDOW, _w("date_in_window")).otherwise(_w("date_out_of_window"))
    has = lambda why: F.sum(F.when(F.array_contains("reasons", why), F.col("pairs")).otherwise(0))
    scored = spans.join(nearest, ["root", "cl", "cr"], "left").groupBy("root").agg(
        F.min(F.col("base") + at(widest)).alias("min_score"), F.max(F.col("base") + at(F.coalesce("nearest", widest))).alias("max_score"), F.sum("pairs").alias("pairs"),
        *[has(why).alias(name) for name, why in REASONS.items()],
    )
    seconds = F.unix_micros(F.col("applied_date").cast("timestamp"))
    early = Window.partitionBy("root").orderBy(seconds).rangeBetween(Window.unboundedPreceding, -((WINDOW + 1) * 1_000_000))
    far = rows.withColumn("n", F.count("*").over(early)).groupBy("root").agg(F.sum("n").alias("far_apart"))
    return spread.join(conflict, "root").join(scored, "root").join(far, "root")


#: Columns that count a group's pairs by reason.
REASONS = {
    "same_ids": "Same job ID on the same source", "different_ids": "Different job IDs on the same source", "same_urls": "Same canonical job URL", "same_companies": "Same normalized company", "similar_companies": "Similar company",
    "same_roles": "Same normalized role", "similar_roles": "Similar role",
}
