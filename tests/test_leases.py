"""Claims in a stream: they lapse, and no piece of evidence is decided twice."""

import json
from datetime import datetime, timedelta

from sluice.streaming import leases

DAY = datetime(2026, 5, 1)


def at(seconds):
    return DAY + timedelta(seconds=seconds)


def test_a_lease():
    one = leases.Lease()
    assert not one.step(at(0), "a", "decide")
    assert one.step(at(0), "a", "claim") and not one.step(at(599), "b", "claim") and not one.step(at(599), "b", "decide")
    assert one.step(at(600), "b", "claim")  # lapsed
    assert not one.step(at(601), "a", "decide") and one.step(at(601), "b", "claim")  # renewed
    assert one.step(at(1200), "b", "decide") and not one.step(at(1201), "b", "decide") and not one.step(at(9999), "a", "claim")


def test_claims_lapse_in_a_stream_and_nothing_is_decided_twice(spark, tmp_path):
    batches = [
        [(1, 0, "a", "claim"), (1, 10, "b", "claim"), (2, 0, "a", "claim"), (2, 20, "a", "decide"), (3, 0, "a", "claim")],
        [(1, 300, "b", "claim"), (2, 400, "b", "claim"), (2, 400, "b", "decide")],
        [(1, 700, "b", "claim"), (1, 710, "a", "decide"), (1, 720, "b", "decide"), (9, 5000, "z", "claim")],
        [(1, 5100, "a", "claim"), (1, 5101, "a", "decide"), (2, 5102, "c", "decide"), (3, 5103, "c", "claim"), (3, 5104, "c", "decide"), (9, 9000, "z", "claim")],
    ]
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for n, rows in enumerate(batches):
            (src / f"{n}.json").write_text("\n".join(json.dumps({"evidence_id": e, "at": at(t).isoformat(), "worker": w, "action": a}) for e, t, w, a in rows))
            stream = leases.granted(spark.readStream.schema("evidence_id long, at timestamp, worker string, action string").json(str(src)))
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    found = spark.read.parquet(out).collect()
    assert len(found) == sum(map(len, batches))
    yes = {(r.evidence_id, int((r.at - DAY).total_seconds()), r.worker, r.action) for r in found if r.granted}
    assert yes == {
        (1, 0, "a", "claim"), (2, 0, "a", "claim"), (2, 20, "a", "decide"), (3, 0, "a", "claim"), (1, 700, "b", "claim"), (1, 720, "b", "decide"), (9, 5000, "z", "claim"),
        (3, 5103, "c", "claim"), (3, 5104, "c", "decide"), (9, 9000, "z", "claim"),
    }
    decided = [e for e, _, _, a in yes if a == "decide"]
    assert len(decided) == len(set(decided))
