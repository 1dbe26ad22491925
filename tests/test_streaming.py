import json

from pyspark.sql import functions as F

from sluice.operators import ledgers
from sluice.streaming import ingest


def land(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(json.dumps(r) for r in rows))


def test_ledger_counts_each_message_once_over_restarts(spark, tmp_path):
    src, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    land(src, "a.json", [{"message_id": "1", "v": 1}, {"message_id": "2", "v": 2}, {"message_id": "1", "v": 3}])

    def run():
        stream = ingest.deduplicated(ingest.files(spark, str(src), "message_id string, v long"))
        ingest.into_versions(stream, out, mark).awaitTermination(120)

    run()
    land(src, "b.json", [{"message_id": "2", "v": 9}, {"message_id": "3", "v": 4}])
    run()
    assert sorted(r.message_id for r in spark.read.parquet(out).collect()) == ["1", "2", "3"]


def test_status_stream_ends_as_the_batch_fold(spark, tmp_path):
    src, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    signals = [{"application_id": a, "seq": n, "signal": s} for a in range(4) for n, s in enumerate(["Interview Scheduled", "Resume Shortlisted", "Offer", "Joined"][: a + 1])]
    land(src, "a.json", signals[:5])
    land(src, "b.json", signals[5:])
    stream = ingest.statuses(ingest.files(spark, str(src), "application_id long, seq long, signal string"))
    q = stream.writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", mark).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.application_id: r.status for r in spark.read.parquet(out).orderBy("batch").collect()}
    df = spark.createDataFrame([tuple(s.values()) for s in signals], "application_id long, seq long, signal string")
    batch = ledgers.fold_status(df).groupBy("application_id").agg(F.max_by("to_status", "seq").alias("s")).collect()
    assert got == {r.application_id: r.s for r in batch}


def test_weeks_start_on_monday(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-07",), ("2024-01-08",)], "d string").select(F.col("d").cast("timestamp").alias("occurred_at"))
    assert sorted((str(r.week), r.messages) for r in ingest.activity(df).collect()) == [("2024-01-01", 2), ("2024-01-08", 1)]
