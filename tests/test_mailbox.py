"""The mailbox source: cursor, expiry, restart, and no message lost or doubled."""

import json

import pytest

from sluice.sources.mailbox import Folder, Mailbox
from sluice.streaming import ingest


def mail(n, **more):
    return {"history_id": n, "message_id": f"m{n}", "thread_id": f"t{n // 3}", "occurred_at": f"2024-0{1 + n // 20}-{1 + n % 20:02d}T10:00:00", "sender": "a@b.cd", "subject": "s", "body_text": f"text {n}", **more}


def put(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))


def history(box, first, last):
    put(box / "history" / f"{first}-{last}.jsonl", [mail(n) for n in range(first, last + 1)])


def listing(box, last):
    for page in (0, 1):
        put(box / "snapshot" / f"{last}-{page}.jsonl", [mail(n) for n in range(1, last + 1) if n % 2 == page])


def test_a_cursor_that_expires_loses_and_doubles_nothing(spark, tmp_path):
    box, out, mark = tmp_path / "box", str(tmp_path / "out"), str(tmp_path / "mark")
    listing(box, 10)

    def run():
        ingest.into_versions(ingest.mail(spark, str(box)), out, mark).awaitTermination(120)
        return sorted(r.message_id for r in spark.read.parquet(out).collect())

    want = lambda n: sorted(f"m{k}" for k in range(1, n + 1))
    assert run() == want(10)  # no cursor: the listing
    history(box, 11, 14)
    history(box, 15, 16)
    assert run() == want(16)  # what was added since
    assert run() == want(16)  # nothing new
    history(box, 17, 20)
    for old in ("11-14", "15-16", "17-20"):
        (box / "history" / f"{old}.jsonl").unlink()
    history(box, 23, 25)
    with pytest.raises(ValueError, match="lost"):
        Folder(str(box)).pieces(16, 25)
    listing(box, 22)
    assert run() == want(25)  # the cursor 16 has expired: the listing of 22, then 23 to 25
    history(box, 26, 26)
    assert run() == want(26)


def test_batches_read_only_what_they_need(tmp_path):
    box = tmp_path / "box"
    listing(box, 4)
    for a, b in ((5, 6), (7, 9), (10, 10)):
        history(box, a, b)
    folder = Folder(str(box))
    names = lambda after, until: [(p.path.rsplit("/", 1)[1], p.after, p.until) for p in folder.pieces(after, until)]
    assert folder.latest() == 10
    assert names(6, 9) == [("7-9.jsonl", 6, 9)]
    assert names(5, 7) == [("5-6.jsonl", 5, 7), ("7-9.jsonl", 5, 7)]
    assert names(10, 10) == []
    assert names(0, 10) == [("4-0.jsonl", -1, 10), ("4-1.jsonl", -1, 10), ("5-6.jsonl", 4, 10), ("7-9.jsonl", 4, 10), ("10-10.jsonl", 4, 10)]
    assert [r[0] for p in folder.pieces(5, 7) for r in folder.rows(p, None)] == [6, 7]


def test_the_listing_in_batch(spark, tmp_path):
    listing(tmp_path, 30)
    spark.dataSource.register(Mailbox)
    whole = spark.read.format("mailbox").load(str(tmp_path))
    assert whole.count() == 30 and whole.schema.simpleString().startswith("struct<history_id:bigint,message_id:string")
    late = spark.read.format("mailbox").option("since", "2024-02-01").load(str(tmp_path))
    assert sorted(r.history_id for r in late.collect()) == [*range(20, 31)]
    assert spark.read.format("mailbox").load(str(tmp_path / "none")).count() == 0
