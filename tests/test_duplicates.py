"""Links and group features of duplicates against all pairs, scored one by one."""

import itertools
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sluice.config import WEIGHTS
from sluice.operators import audits as A
from sluice.operators import duplicates as D
from sluice.operators.components import groups
from sluice.operators.replay import company_relation, role_relation

SCHEMA = "id long, applied_date timestamp_ntz, company string, role string, url string, job_id string, source string"
DAY = datetime(2024, 1, 1)


def compare(a, b):
    score, why = 0, []
    if a["job_id"] and b["job_id"] and a["source"] is not None and a["source"] == b["source"]:
        same = a["job_id"] == b["job_id"]
        score += WEIGHTS["same_external_job_id" if same else "external_job_id_conflict"]
        why.append("same_ids" if same else "different_ids")
    if a["url"] and a["url"] == b["url"]:
        score += WEIGHTS["same_canonical_job_url"]
        why.append("same_urls")
    for kind, relation, names in (("company", company_relation(a["company"], b["company"]), ("same_companies", "similar_companies")), ("role", role_relation(a["role"], b["role"]), ("same_roles", "similar_roles"))):
        if relation:
            score += WEIGHTS[f"{kind}_{relation}"]
            if relation != "conflict":
                why.append(names[relation == "similar"])
    near = abs(int((a["applied_date"] - b["applied_date"]).total_seconds())) <= D.WINDOW
    score += WEIGHTS["date_in_window" if near else "date_out_of_window"]
    return score, why + ([] if near else ["far_apart"])


def all_pairs(rows):
    up = {a["id"]: a["id"] for a in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    linked = set()
    for a, b in itertools.combinations(sorted(rows, key=lambda a: a["id"]), 2):
        if compare(a, b)[0] >= 70:
            linked.add((a["id"], b["id"]))
            x, y = sorted((root(a["id"]), root(b["id"])))
            up[y] = x
    members = {i for pair in linked for i in pair}
    return linked, {i: root(i) for i in members}


def cases(seed, n=140):
    rng = random.Random(seed)
    pick = lambda *xs: rng.choice(xs)
    rows = []
    for i in range(n):
        hot = i % 3 == 0
        rows.append(dict(id=i, applied_date=DAY + timedelta(days=rng.randint(0, 1500), seconds=pick(0, 1)), company="acme" if hot else pick("acme", "acme labs", "globex", ""), role="engineer" if hot else pick("engineer", "senior engineer", "cook"), url=pick(None, None, None, f"u{rng.randint(0, 9)}"), job_id=pick(None, f"j{rng.randint(0, 3)}"), source=pick("linkedin", "indeed", None)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA)


@pytest.mark.parametrize("seed", range(4))
def test_links_join_what_all_pairs_join(spark, seed):
    rows = cases(seed)
    known = frame(spark, rows)
    linked, want = all_pairs(rows)
    assert {(r.lo, r.hi) for r in D.candidate_pairs(known).collect()} == linked
    found = D.links(known)
    assert {r.id: r.root for r in groups(found, "lo", "hi").collect()} == want
    assert found.count() < 6 * len(rows)


def test_features_are_of_all_pairs(spark):
    rows = cases(11)
    known = frame(spark, rows)
    members = groups(D.links(known), "lo", "hi")
    by_id, of = {r["id"]: r for r in rows}, {}
    for r in members.collect():
        of.setdefault(r.root, []).append(by_id[r.id])
    for r in D.group_features(members, known).collect():
        group = of[r.root]
        scores = [compare(a, b) for a, b in itertools.combinations(group, 2)]
        why = Counter(w for _, ws in scores for w in ws)
        assert (r["size"], r.min_score, r.max_score, r.pairs, r.far_apart) == (len(group), min(s for s, _ in scores), max(s for s, _ in scores), len(scores), why["far_apart"])
        assert {n: r[n] for n in D.REASONS} == {n: why[n] for n in D.REASONS}
        assert r.conflicting_ids == (why["different_ids"] > 0)


def test_a_chain_with_a_low_end_is_insufficient(spark):
    rows = [dict(id=i, applied_date=DAY + timedelta(days=150 * i), company="acme", role="engineer", url=None, job_id=None, source="other") for i in range(3)]
    rows += [dict(rows[0], id=10 + i, company="globex", applied_date=DAY, job_id=f"j{i}" if i < 2 else None, source="linkedin") for i in range(3)]
    rows += [dict(rows[0], id=100 + i, company="initech", applied_date=DAY) for i in range(21)]
    rows += [dict(rows[0], id=200 + i, company="stark", applied_date=DAY) for i in range(2)]
    known = frame(spark, rows)
    found = {r.root: r.category for r in D.group_features(groups(D.links(known), "lo", "hi"), known).withColumn("category", A.group_category()).collect()}
    assert found == {0: "insufficient_evidence", 10: "do_not_merge_strong_conflict", 100: "do_not_merge_strong_conflict", 200: "high_confidence_review"}


def test_a_hot_company_and_role(spark):
    """A third of all records of one company and role: links grow with the records."""
    n = 30_000
    i = F.col("id")
    known = spark.range(n).select("id", (F.lit(DAY) + F.make_dt_interval((i % 4000).cast("int"))).cast("timestamp_ntz").alias("applied_date"), F.when(i % 3 == 0, "acme").otherwise(F.concat(F.lit("co "), i.cast("string"))).alias("company"), F.lit("engineer").alias("role"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("job_id"), F.lit("other").alias("source"))
    links = D.links(known.repartition(7)).cache()
    assert links.count() <= 2 * n / 3
    assert [tuple(r) for r in groups(links, "lo", "hi").groupBy("root").count().collect()] == [(0, n // 3)]
