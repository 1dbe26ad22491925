"""Merges: plans with what blocks and warns, children of all kinds, undoing, and one step over
all tables that a failure between outputs leaves undone."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sluice.operators import merging as M
from sluice.streaming import ingest

DAY = datetime(2024, 6, 1)
APPS = "id long, company string, role string, job_url string, external_job_id string, withdraw_reason string, source_portal string, application_method string, is_false_positive boolean, applied_date timestamp_ntz, current_status string, record_state string, merged_into long, thread_ids array<string>"
CHILDREN = {
    "evidence": "id long, application_id long, external_id string",
    "history": "id long, application_id long, from_status string, to_status string, changed_at timestamp_ntz, superseded_by long",
    "milestones": "id long, application_id long, event_type string, occurred_at timestamp_ntz, interview_round string, history_id long, superseded_by long",
    "thread_links": "id long, application_id long, thread_id string",
    "prospects": "id long, application_id long, title string",
}


def app(i, company="Acme", role="Engineer", days=10, status="Applied", **more):
    row = dict(id=i, company=company, role=role, job_url=None, external_job_id=None, withdraw_reason=None, source_portal="LinkedIn", application_method="Unknown", is_false_positive=False, applied_date=DAY - timedelta(days=days), current_status=status, record_state="active", merged_into=None, thread_ids=[f"t{i}"])
    return tuple({**row, **more}.values())


def tables(spark, apps):
    ids = [a[0] for a in apps]
    at = lambda n: DAY + timedelta(days=n)
    rows = {
        "evidence": [(10 * i, i, f"ev-{i}") for i in ids],
        "history": [(10 * i, i, None, "Applied", at(i), None) for i in ids],
        "milestones": [r for i in ids for r in ((10 * i, i, "Application Submitted", at(i), None, 10 * i, None), (10 * i + 1, i, "Interview Scheduled", at(5), "HR", None, None))],
        "thread_links": [(10 * i, i, f"t{i}") for i in ids],
        "prospects": [(10 * i, i, f"p{i}") for i in ids],
    }
    return spark.createDataFrame(apps, APPS), {k: spark.createDataFrame(v, CHILDREN[k]) for k, v in rows.items()}


def planned(spark, groups, apps, confirmed=(), most=20):
    g = spark.createDataFrame(groups, "root long, id long")
    ev = spark.createDataFrame([(i, "human") for i in confirmed] or [(-1, "human")], "application_id long, decided_by string")
    return g, M.plan(g, apps, M.survivors(g, apps, ev), most)


def test_conflicts_and_warnings(spark):
    apps, _ = tables(spark, [
        app(1, external_job_id="7", withdraw_reason="late"), app(2, "Globex", "Analyst", days=300, external_job_id="8", withdraw_reason="pay", is_false_positive=True, source_portal="Naukri", status="Offer"),
        app(3, "Acme Pvt Ltd", days=5), app(4, days=5, job_url="u"),
    ])
    found = {r.root: r for r in planned(spark, [(1, 1), (1, 2), (3, 3), (3, 4)], apps)[1].collect()}
    assert set(found[1].conflicts) == {"company", "role", "external_job_id", "withdraw_reason", "source_portal", "is_false_positive", "current_status"}
    assert found[1].warnings == ["different job ids", "different companies", "different roles", "dates months apart"]
    assert (found[1].survivor, found[1].company, found[1].current_status, found[1].applied_date) == (2, "Globex", "Offer", DAY - timedelta(days=300))
    assert (found[3].survivor, found[3].job_url, found[3].warnings, found[3].conflicts) == (4, "u", [], ["company"])


def test_what_blocks(spark):
    apps, _ = tables(spark, [app(i) for i in range(1, 25)] + [app(30, record_state="merged", merged_into=1), app(31)])
    groups = [(1, i) for i in range(1, 23)] + [(23, 23)] + [(30, 30), (30, 31)] + [(24, 24), (24, 999), (24, 24)]
    found = {r.root: r.blocking for r in planned(spark, groups, apps)[1].collect()}
    assert found == {1: ["too many"], 23: ["too few"], 30: ["already merged"], 24: ["not found", "too few"]}


def state(rows):
    return sorted(tuple(map(str, r)) for r in rows.collect())


def test_all_kinds_move_and_come_back(spark):
    apps, children = tables(spark, [app(1, days=20), app(2, days=10), app(3, "Globex")])
    groups, plan = planned(spark, [(1, 1), (1, 2)], apps)
    done = M.execute(groups, apps, children, plan, 77)
    rows = {r.id: r for r in done["applications"].collect()}
    assert (rows[2].record_state, rows[2].merged_into, rows[3].record_state) == ("merged", 1, "active")
    assert set(rows[1].thread_ids) == {"t1", "t2"} and rows[1].applied_date == DAY - timedelta(days=20)
    for kind in M.KINDS:
        assert {r.application_id for r in done[kind].collect()} == {1, 3}, kind
    assert {r.id for r in done["history"].filter("superseded_by = 77").collect()} == {20}
    assert {r.id for r in done["milestones"].filter("superseded_by = 77").collect()} == {20, 21}
    later = spark.createDataFrame([(99, 1, "ev-later")], CHILDREN["evidence"])
    back = M.undo({**done, "evidence": done["evidence"].unionByName(later)})
    assert state(back["applications"]) == state(apps) and state(back["evidence"]) == state(children["evidence"].unionByName(later))
    for kind in set(M.KINDS) - {"evidence"}:
        assert state(back[kind]) == state(children[kind])


def test_one_step_over_all_tables(spark, tmp_path):
    apps, children = tables(spark, [app(i, days=30 - i) for i in range(1, 7)])
    base = {"applications": apps, **children}
    root, mark, src = str(tmp_path / "tables"), str(tmp_path / "mark"), tmp_path / "in"
    src.mkdir()
    fail = {"at": "milestones"}

    def now(name):
        return ingest.current(base[name], ingest.rows_of(spark, root, name, base[name].schema))

    def step(batch, number):
        groups = batch.select("root", "id")
        members = groups.select("id").distinct()
        some = now("applications").join(members, "id", "left_semi")
        mine = {k: now(k).join(members.withColumnRenamed("id", "application_id"), "application_id", "left_semi").select(base[k].columns) for k in M.KINDS}
        ev = spark.createDataFrame([(-1, "human")], "application_id long, decided_by string")
        done = M.execute(groups, some, mine, M.plan(groups, some, M.survivors(groups, some, ev)), number)
        if fail["at"]:
            done[fail["at"]] = done[fail["at"]].filter(F.raise_error(F.lit("lost")).cast("boolean"))
        return done

    def run(name, groups):
        (src / name).write_text("\n".join(json.dumps({"root": r, "id": i}) for r, i in groups))
        stream = spark.readStream.schema("root long, id long").json(str(src))
        ingest.into_tables(stream, root, mark, step).awaitTermination(120)

    before = {k: state(now(k)) for k in base}
    with pytest.raises(Exception, match="lost"):
        run("a.json", [(1, 1), (1, 2)])
    assert (tmp_path / "tables" / "applications").exists()  # some outputs were written
    assert ingest.last_complete(spark, root) == -1 and {k: state(now(k)) for k in base} == before
    fail["at"] = None
    run("b.json", [(3, 3), (3, 4)])
    assert ingest.last_complete(spark, root) == 1
    found = {r.id: (r.record_state, r.merged_into) for r in now("applications").collect()}
    assert found == {1: ("active", None), 2: ("merged", 1), 3: ("active", None), 4: ("merged", 3), 5: ("active", None), 6: ("active", None)}
    for kind in M.KINDS:
        rows = now(kind).collect()
        assert len(rows) == len(before[kind]) and {r.application_id for r in rows} == {1, 3, 5, 6}
    fail["at"] = "snapshot_prospects"
    with pytest.raises(Exception, match="lost"):
        run("c.json", [(5, 5), (5, 6)])
    assert {r.id: r.record_state for r in now("applications").collect()}[6] == "active"
    # undoing from what the complete batches have kept
    was = ingest.rows_of(spark, root, "snapshot_applications", apps.schema).filter("batch = 0").drop("batch")
    assert state(was) == state(apps.filter("id IN (1, 2)"))


def test_a_plan_reads_each_row_once(spark):
    """Whether a group's values differ takes no copy of a row for each field."""
    apps = spark.createDataFrame([app(1, job_url="https://a"), app(2, role="Cook"), app(3, job_url="https://b")], APPS)
    groups = spark.createDataFrame([(1, i) for i in (1, 2, 3)], "root long, id long")
    planned = M.plan(groups, apps, spark.createDataFrame([(1, 1)], "root long, survivor long"))
    assert planned.collect()[0].conflicts == ["role", "job_url"]
    assert planned._jdf.queryExecution().optimizedPlan().toString().count("Expand") == 0


def test_milestones_need_the_history_that_they_name(spark):
    """Rows of records that no milestone names aren't sorted; what is superseded stays the same."""
    day = lambda n: DAY + timedelta(days=n)
    history = spark.createDataFrame([(i, a, "Applied", "Offer", day(i), None) for i, a in ((1, 10), (2, 10), (3, 20), (4, 20), (5, None), (6, None), (7, 30), (8, 30))], CHILDREN["history"])
    rows = [(1, 10, "Offer Received", day(1), None, 2, None), (2, None, "Interview Scheduled", day(2), "HR", 6, None), (3, 30, "Interview Scheduled", day(3), "HR", None, None), (4, 30, "Interview Scheduled", day(3), "HR", 7, None), (5, 30, "Interview Scheduled", day(4), "HR", None, None)]
    milestones = spark.createDataFrame(rows, CHILDREN["milestones"])
    asked = M.asked_history(history, milestones, "application_id")
    assert {r.id for r in asked.collect()} == {1, 2, 5, 6, 7, 8}
    by = [{r.id for r in M.superseded_milestones(milestones, M.superseded_history(h, "application_id"), "application_id").collect()} for h in (history, asked)]
    assert by == [{1, 2, 4}] * 2
