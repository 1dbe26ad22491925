"""Lists of jobs pasted as text: a line automaton as windows over classified lines.

A line is the first of these that it is: an end (with a date: "Applied 3d ago", or a status word),
noise, a bullet line ("Company · Place"), a place, or content. An entry is what stands
before an end; what is left after the last end is an entry too. Blank lines stand anywhere and don't
count. Where an entry has a bullet line, its first part that is neither noise nor a place is the company and
the first content line the role; else "Role at Company" on the first content line; else company
and role are the first two content lines, and a single one is a role. Legal forms at the end of a
company are cut off.

Lines are classified on their own and numbered by a running count of ends, and an entry is a
partial aggregate of its lines: no entry or paste is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Lines that say nothing of a job, whole and by how they begin.
NOISE = [
    "add note", "easy apply", "promoted", "actively recruiting", "be an early applicant", "saved", "new", "viewed", "see all jobs", "show more", "show all", "load more",
    "jobs", "applied jobs", "my jobs", "linkedin", "all filters", "date posted", "experience level", "company", "job type", "remote", "easy apply filter",
]
NOISE_STARTS = ["promoted", "easy apply", "be an early", "actively recruit", r"reposted\s+\d", "show more", "see all", "load more", r"got it\.", "we will", "following"]
COUNTED = ["applicant", "view", "people", "connection", "follower", "over"]
# Lines that end an entry, besides a date.
ENDS = ["Archived", "Interviewing", r"Interview\s+in\s+progress", r"In\s+progress", "Withdrawn", "Closed", "Saved"]
# Words of places, words of job titles, legal forms.
PLACES = [
    "hybrid", "on-site", "onsite", "on site", "india", "usa", "u.s.a.", "u.s.", "uk", "u.k.", "canada", "australia", "bengaluru", "bangalore", "mumbai", "delhi", "new delhi", "chennai",
    "hyderabad", "pune", "noida", "gurugram", "gurgaon", "kolkata", "new york", "san francisco", "seattle", "austin", "chicago", "boston", "london", "singapore", "dubai", "toronto", "sydney",
    "berlin", "amsterdam", "california", "texas", "washington", "nyc", "sf", "bay area", "greater", "metropolitan", "worldwide", "global", "work from home",
]
TITLES = [
    "engineer", "engineering", "manager", "management", "director", "lead", "senior", "junior", "principal", "staff", "analyst", "developer", "designer", "architect", "consultant", "specialist",
    "officer", "head", "vp", "president", "associate", "product", "software", "data", "platform", "backend", "frontend", "fullstack", "ml", "ai", "devops", "sre", "qa", "tech", "technical",
    "research", "scientist",
]
FORMS = ["Inc", "LLC", "Ltd", "Corp", "Limited", "GmbH", "Pvt"]
ENDING = r"(?i)\s*,?\s*\b(Inc\.?|LLC|Ltd\.?|Corp\.?|Limited|GmbH|S\.A\.|AG|Pvt\.?)\s*$"
AGO = r"(?i)Applied\s+(?:(\d+)\s*(h|hr|hour|d|day|w|week|mo|month)s?\s*ago|(today|yesterday))"


def _one_of(words: list[str]) -> str:
    return "|".join(words)


def _words(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(r"(\w+)"), F.lit(1))


def _any(line: Column, words: list[str]) -> Column:
    return F.arrays_overlap(_words(line), F.array(*map(F.lit, words)))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def noise(line: Column) -> Column:
    low = F.lower(line)
    starts = low.rlike(rf"^(?:{_one_of(NOISE_STARTS)})") | low.rlike(rf"^\d+[+\s]*(?:{_one_of(COUNTED)})")
    return low.isin(*NOISE) | starts | line.rlike(r"^\(.+\)$") | (F.length(line) <= 2) | line.rlike(r"^\d+$")


def place(line: Column) -> Column:
    """A place by its words, or "City, State" of short parts that hold no title and no legal form."""
    parts = F.transform(F.split(line, ","), strip)
    low = F.lower(line)
    named = F.exists(F.array(*map(F.lit, PLACES)), lambda word: low.contains(word))
    brief = F.forall(parts, lambda p: F.size(F.filter(F.split(p, r"\s+"), lambda w: w != "")).between(1, 4))
    city = brief & ~line.rlike(rf"(?i)\b(?:{_one_of(FORMS)})\b") & ~_any(line, TITLES)
    listed = line.contains(",") & F.forall(parts, lambda p: F.length(p) < 40) & (named | city)
    return listed | (_any(line, PLACES) & (F.length(line) < 60))


def days_ago(line: Column) -> Column:
    """Days since the date that a line gives, null where it gives none."""
    n, unit, word = (F.regexp_extract(line, AGO, k) for k in (1, 2, 3))
    each = F.when(F.lower(unit).isin("h", "hr", "hour"), 0).when(F.lower(unit).isin("d", "day"), 1).when(F.lower(unit).isin("w", "week"), 7).otherwise(30)
    return F.when(F.lower(word) == "today", 0).when(F.lower(word) == "yesterday", 1).when(n != "", n.try_cast("int") * each)


def pasted(texts: DataFrame, today: Column, key: str = "paste_id", column: str = "text") -> DataFrame:
    """(key, n, company, role, applied_on): the entries of each paste in their order. Null and empty
    texts have none; a count of days that no date can hold gives no date."""
    split = texts.select(F.col(key).alias("k"), F.posexplode(F.split(F.coalesce(F.col(column), F.lit("")), "\n")).alias("pos", "raw"))
    lines = split.select("k", "pos", strip(F.col("raw")).alias("line")).filter("line <> ''")
    line = F.col("line")
    dated = line.rlike(AGO)
    end = dated | line.rlike(rf"(?i)^(?:{_one_of(ENDS)})$")
    kind = F.when(end, "end").when(noise(line), "noise").when(line.contains("·"), "bullet").when(place(line), "place").otherwise("content")
    before = Window.partitionBy("k").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    marked = lines.withColumn("kind", kind).withColumn("n", F.coalesce(F.sum((F.col("kind") == "end").cast("int")).over(before), F.lit(0)))
    of = Window.partitionBy("k", "n", "kind").orderBy("pos")
    placed = marked.filter("kind IN ('end', 'bullet', 'content')").withColumn("nth", F.row_number().over(of))
    parts = F.filter(F.transform(F.split("line", "·"), strip), lambda p: (p != "") & ~noise(p) & ~place(p))
    named = F.when(F.col("kind") == "bullet", F.get(parts, F.lit(0)))
    nth = lambda k: F.max(F.when((F.col("kind") == "content") & (F.col("nth") == k), F.col("line")))
    entry = placed.withColumn("named", named).groupBy("k", "n").agg(
        nth(1).alias("first"), nth(2).alias("second"), F.min_by("named", F.when(F.col("named").isNotNull(), F.col("pos"))).alias("bullet"), F.max(F.when(F.col("kind") == "end", F.col("line"))).alias("last"),
    )
    at = r"(?i)^(.+?)\s+at\s+(.+)$"
    left, right = (F.regexp_extract("first", at, g) for g in (1, 2))
    single = F.col("bullet").isNull() & (F.length(left) > 2) & (F.length(right) > 2)
    two = F.col("bullet").isNull() & ~F.coalesce(single, F.lit(False)) & F.col("second").isNotNull()
    company = F.coalesce("bullet", F.when(single, strip(right)), F.when(two, F.col("first")))
    role = F.when(single, strip(left)).when(two, F.col("second")).otherwise(F.col("first"))
    days = days_ago(F.col("last"))
    when = F.when(days <= 1_000_000, F.date_sub(today, days))
    found = entry.select(F.col("k").alias(key), "n", F.nullif(strip(F.regexp_replace(company, ENDING, "")), F.lit("")).alias("company"), role.alias("role"), when.alias("applied_on"))
    return found.filter("company IS NOT NULL OR role IS NOT NULL")
