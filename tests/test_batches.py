"""Strict batches: what they don't name lies in quarantine with the reason."""

import json

import pytest

from sluice.sources import batches

AS_OF = "2026-05-20 12:00:00"


def observation(i=1, **more):
    row = {"source_key": "linkedin", "source_item_id": f"job-{i}", "company": "Acme", "role": "Cook", "applied_on": "2026-05-01", "status": "applied", "job_url": f"https://www.linkedin.com/jobs/view/{i}", "proves_submission": True, "extraction": "verified", "observed_at": "2026-05-20T11:59:00Z", "adapter_version": "1.0"}
    return {k: v for k, v in {**row, **more}.items() if v != "-"}


def batch(*rows, **more):
    return json.dumps({"batch_key": "batch-0001", "sent_at": "2026-05-20T11:59:30Z", "observations": [*rows], **more})


def read(spark, lines, **options):
    return batches.read(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1), AS_OF, **options)


ROWS = {
    "more fields": observation(email="a@b.cd"),
    "a field is missing": observation(company="-"),
    "a field can't be read": observation(applied_on="soon"),
    "unknown source": observation(source_key="elsewhere"),
    "unknown status": observation(status="hired"),
    "unknown extraction": observation(extraction="guess"),
    "a text is too short or too long": observation(company="x" * 201),
    "a text has other signs": observation(source_item_id="a b"),
    "no https URL": observation(job_url="http://www.linkedin.com/jobs"),
    "seen at no zone's time": observation(observed_at="2026-05-20T11:59:00"),
    "seen too early or in the future": observation(observed_at="2026-05-20T12:06:00Z"),
    "applied after it was seen": observation(applied_on="2026-05-21"),
    "an unknown status proves nothing": observation(status="unknown"),
    "not an object": [1, 2],
}
BATCHES = {
    "not an object": "no json",
    "batch has more fields": batch(observation(), note="x"),
    "batch is too long": batch(observation(role="x" * 290), **{"batch_key": "batch-0001" + " " * 262_144}),
    "no batch key": batch(observation(), batch_key="short"),
    "sent at no time": batch(observation(), sent_at="x"),
    "sent too long ago": batch(observation(), sent_at="2026-05-20T11:40:00Z"),
    "no observations": batch(),
    "too many observations": batch(*[observation(i) for i in range(101)]),
}


def test_good_batches_pass(spark):
    lines = [batch(observation(1), observation(2, role=None, job_url=None, source_key="employer-acme", status="unknown", proves_submission=False)), batch(*[observation(i) for i in range(100)])]
    rows = read(spark, lines)
    assert [r.problems for r in rows.collect() if r.problems] == []
    assert batches.accepted(rows).count() == 102 and batches.quarantine(rows).count() == 0
    first = batches.accepted(rows).filter("line = 0 AND place = 1").first()
    assert (first.source_key, first.role, str(first.applied_on), first.proves_submission) == ("employer-acme", None, "2026-05-01", False)


def test_faults_of_rows(spark):
    """A batch with a bad observation is refused whole; only the bad one has a reason."""
    found = read(spark, [batch(observation(99), bad) for bad in ROWS.values()]).collect()
    for line, reason in enumerate(ROWS):
        good, bad = sorted((r for r in found if r.line == line), key=lambda r: r.place)
        assert reason in bad.problems, (reason, bad.problems)
        assert good.problems == [] and good.refused and bad.refused


@pytest.mark.parametrize("reason", list(BATCHES))
def test_faults_of_batches(spark, reason):
    rows = read(spark, [BATCHES[reason], batch(observation(5))])
    assert all(reason in r.problems and r.refused for r in rows.filter("line = 0").collect()) and rows.filter("line = 0").count() > 0
    assert [r.source_item_id for r in batches.accepted(rows).collect()] == ["job-5"]


def test_doubled_ids_and_foreign_hosts(spark):
    lines = [batch(observation(1), observation(2), observation(1)), batch(observation(1)), batch(observation(3, job_url="https://evil.example/jobs/3")), batch(observation(4, source_key="naukri")), None]
    rows = read(spark, lines, hosts=batches.HOSTS).collect()
    by = {(r.line, r.place): r.problems for r in rows}
    assert by[0, 0] == by[0, 2] == ["a doubled id"] and by[0, 1] == [] and by[1, 0] == []
    assert by[2, 0] == by[3, 0] == ["a foreign host"] and by[4, None] == ["not an object"]
    assert {r.line for r in rows if not r.refused} == {1}
    assert read(spark, lines).filter("line = 2").first().problems == []


def test_lines_are_parsed_once(spark):
    """Counts and refusals come from windows: no join reads and parses the lines again."""
    lines = spark.createDataFrame([('{"batch_key": "batch-0001", "sent_at": "2001-08-01T00:00:00Z", "observations": [{"source_item_id": "a"}, {"source_item_id": "a"}, {}]}',), (None,)], "value string")
    rows = batches.read(lines, "2001-08-01 00:00:00")
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()
    found = sorted((r.place if r.place is not None else -1, "a doubled id" in r.problems, r.refused) for r in rows.collect())
    assert [x[:2] for x in found] == [(-1, False), (0, True), (1, True), (2, False)]


def test_odd_values_and_steps(spark):
    """Values of other kinds keep their meaning, and a batch's observations are read in two steps of generated code."""
    lines = [batch(observation(1, role={"a": [1]}, proves_submission="yes"), observation(2, proves_submission=1, company=5), observation(3, proves_submission=[True], observed_at=7), None, 3, observation(4, source_item_id=None)), batch(observation(5)), '{"observations": {}, "a": 1}']
    rows = read(spark, lines)
    found = {(r.line, r.place): r for r in rows.collect()}
    assert (found[0, 0].role, found[0, 0].proves_submission, found[0, 0].problems) == ('{"a":[1]}', True, [])
    assert (found[0, 1].company, found[0, 1].proves_submission, found[0, 1].problems) == ("5", True, [])
    assert found[0, 2].proves_submission is None and found[0, 2].problems == ["a field can't be read"]
    assert found[0, 3].problems == found[0, 4].problems == ["not an object", "a field is missing"] and found[0, 5].problems == []
    assert found[1, 0].refused is False and found[0, 0].refused and found[2, None].problems == ["batch has more fields", "no batch key", "sent at no time", "no observations"]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("$.observations") == 2 and "lambda" not in plan
    steps = rows._jdf.queryExecution().debug().codegenToSeq()
    assert all(steps.apply(i)._3().maxMethodCodeSize() < 8000 for i in range(steps.size()))  # the JVM compiles no larger method
