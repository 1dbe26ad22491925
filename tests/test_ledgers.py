import pytest
from pyspark.sql import functions as F

from sluice.config import TRANSITIONS
from sluice.operators import ledgers as K
from sluice.operators.components import groups


def walk(signals):
    status, out = "Applied", []
    for seq, signal in sorted(signals):
        if signal in TRANSITIONS[status]:
            out.append((seq, status, signal))
            status = signal
    return out


def test_status_machine_against_a_plain_walk(spark):
    import random

    rng = random.Random(5)
    rows = [(a, n, rng.choice([*TRANSITIONS, None])) for a in range(40) for n in range(rng.randint(0, 12))]
    df = spark.createDataFrame(rows, "application_id long, seq long, signal string")
    got = sorted((r.application_id, r.seq, r.from_status, r.to_status) for r in K.fold_status(df).collect())
    want = sorted((a, *c) for a in range(40) for c in walk([(n, s) for x, n, s in rows if x == a and s]))
    assert got == want


@pytest.mark.parametrize("size", [1, 3])
def test_ranges_of_a_record(spark, size):
    import random

    rng = random.Random(size)
    rows = [(a, rng.randint(0, 30), rng.choice([*TRANSITIONS, None, "else"])) for a in (1, 2, None) for _ in range(40)]
    got = sorted(((r.application_id or 0, r.seq, r.from_status, r.to_status) for r in K.fold_status(spark.createDataFrame(rows, "application_id long, seq long, signal string"), size).collect()))
    assert got == sorted((a or 0, *c) for a in (1, 2, None) for c in walk([(n, s) for x, n, s in rows if x == a and s]))


def test_status_machine_with_a_record_of_a_million_signals(spark):
    """Most of them would go back; no range holds more than its share."""
    names = F.array(*map(F.lit, ["Applied", "Resume Shortlisted"]))
    late = F.when(F.col("id") == 700_000, "Interview Scheduled").when(F.col("id") == 999_998, "Rejected")
    signals = spark.range(1_000_000).select(F.lit(7).alias("application_id"), F.col("id").alias("seq"), F.coalesce(late, F.get(names, (F.col("id") % 2).cast("int"))).alias("signal"))
    signals = signals.unionByName(spark.createDataFrame([(8, 5, "Offer")], signals.schema))
    got = sorted(map(tuple, K.fold_status(signals).collect()))
    assert got == [(7, 1, "Applied", "Resume Shortlisted"), (7, 700_000, "Resume Shortlisted", "Interview Scheduled"), (7, 999_998, "Interview Scheduled", "Rejected"), (8, 5, "Applied", "Offer")]


def test_rate_limit(spark):
    hits = spark.createDataFrame([(1, t) for t in (0, 1, 2, 3, 11, 12)] + [(2, 0)], "key long, at long")
    got = sorted((r.key, r.at, r.admitted) for r in K.admitted(hits, 2, 10).collect())
    assert got == [(1, 0, True), (1, 1, True), (1, 2, False), (1, 3, False), (1, 11, True), (1, 12, True), (2, 0, True)]


def test_first_and_last_writer(spark):
    old = spark.createDataFrame([(1, "a", 0)], "k long, v string, t int")
    new = spark.createDataFrame([(1, "b", 1), (2, "c", 2), (2, "d", 3)], "k long, v string, t int")
    assert sorted(map(tuple, K.insert_if_absent(old, new, ["k"], F.col("t")).collect())) == [(1, "a", 0), (2, "c", 2)]
    assert sorted(map(tuple, K.upsert(old, new, ["k"], F.desc("t"), keep=["t"]).collect())) == [(1, "b", 0), (2, "d", 3)]


def test_groups_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (101, 102)], "a long, b long")
    got = {r.id: r.root for r in groups(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
