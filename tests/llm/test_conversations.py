"""Repair of conversations against a search over all edits, and against its SQL."""

import hashlib
import itertools
import re
import zlib

import duckdb
import pytest

from sluice.llm import conversations

BLANK = " \t\n\x0b\x0c\r"


def brute(rows):
    """(cost, audit, repaired) of the cheapest edits of (role, text) rows, over all edits."""
    seen, options = set(), []
    for role, text in rows:
        end = text.rstrip(BLANK)
        goes = not end or (role, text) in seen
        seen.add((role, text))
        more = 5 if end and not goes and end[-1] not in ".!?" else 0
        here = [(2, "D", None)]
        if not goes:
            here += [(more, "K", (role, text)), (1 + more, "R", ("user", text)), (1 + more, "R", ("assistant", text))]
        options.append(here)
    gaps = [(0, "", ())] + [(5 * len(x), "I" * len(x), tuple((r, "") for r in x)) for n in (1, 2) for x in itertools.product(("user", "assistant"), repeat=n)]
    best = None
    for edits in itertools.product(*options):
        if best and sum(e[0] for e in edits) > best[0]:
            continue
        for inserted in itertools.product(gaps, repeat=len(rows) + 1):
            cost = sum(e[0] for e in edits) + sum(g[0] for g in inserted)
            if best and cost > best[0]:
                continue
            out = [*inserted[0][2]]
            for e, g in zip(edits, inserted[1:], strict=True):
                out += [*([e[2]] if e[2] else []), *g[2]]
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)):
                audit = inserted[0][1] + "".join(e[1] + g[1] for e, g in zip(edits, inserted[1:], strict=True))
                best = min(best, (cost, audit, out)) if best else (cost, audit, out)
    return best


CASES = {
    1: [("user", "Hi."), ("assistant", "Yes.")],
    2: [("system", "Be good."), ("user", "a?"), ("assistant", "b.")],
    3: [("user", "open"), ("assistant", "b.")],
    4: [("assistant", "b."), ("user", "c.")],
    5: [("user", "a."), ("user", "a."), ("assistant", "b.")],
    6: [("user", "a."), ("system", "s."), ("assistant", "b.")],
    7: [("user", "a.")],
    8: [("system", "s.")],
    9: [("user", " \t"), ("assistant", "b.")],
    10: [("tool", "x."), ("user", "y."), ("user", "z.")],
    11: [("system", "s."), ("system", "t."), ("user", "u.")],
    12: [("", "x."), ("User", "y!"), ("assistant", "no end")],
    13: [("assistant", "b."), ("assistant", "c."), ("assistant", "d.")],
    14: [("user", "cut"), ("assistant", "cut too"), ("user", "fine.")],
}


@pytest.fixture(scope="module")
def repaired(spark):
    rows = [(c, i, role, text, "x", 1) for c, turns in CASES.items() for i, (role, text) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, absent string, place int")
    return {r.conv_id: r for r in conversations.repair(df).collect()}


@pytest.mark.parametrize("case", list(CASES))
def test_cheapest_of_all_edits(repaired, case):
    cost, audit, out = brute(CASES[case])
    r = repaired[case]
    assert (r.cost, r.audit, [(t.role, t.text) for t in r.repaired]) == (cost, audit, out)


def test_random_conversations(spark):
    import random

    rng = random.Random(5)
    cases = {c: [(rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b!", "cut", ""])) for _ in range(rng.randint(1, 3))] for c in range(40)}
    df = spark.createDataFrame([(c, i, *t) for c, turns in cases.items() for i, t in enumerate(turns)], "conv_id long, turn long, role string, text string")
    for r in conversations.repair(df).collect():
        assert (r.cost, r.audit, [(t.role, t.text) for t in r.repaired]) == brute(cases[r.conv_id])


def test_blocks_join_as_one_fold(spark, monkeypatch):
    roles = ["user", "assistant", "assistant", "system", "user", "user", "assistant"]
    rows = [(1, i, roles[i % 7], f"{i}" + ("." if i % 5 else ""), None) for i in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, extra string")
    found = []
    for size in (1, 7, 1000):
        monkeypatch.setattr(conversations, "BLOCK", size)
        found.append(conversations.repair(df).collect())
    assert found[0] == found[1] == found[2]


def test_nulls_ties_and_facts(spark):
    rows = [
        (None, None, None, "x."), (None, 3, "user", None), (None, 3, "user", "a."), (7, 1, "user", "a."), (7, 1, "user", "a."), (7, 9, "assistant", "b"), (8, None, "user", "a."),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r for r in conversations.repair(df).collect()}
    assert (found[None].blank, found[None].gaps, found[None].illegal) == (1, 0, 2)
    assert (found[7].gaps, found[7].duplicate, found[7].truncated, found[7].illegal, found[7].audit) == (7, 1, 1, 1, "DDD")
    assert (found[8].gaps, found[8].cost, found[8].audit, found[8].repaired) == (0, 2, "D", [])
    assert conversations.repair(df.limit(0)).collect() == []


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(40) for t in range(6)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = {1: "", 2: text.translate(dict.fromkeys(map(ord, ".!?")))}.get(kind, text)
        want += [(c, t, "user" if kind == 4 else role, text, kind == 0)] * (2 if kind == 3 else 1)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in conversations.damaged(df).collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_equals_sql(spark, sf):
    path = f"/root/testdata/{sf}/conversations.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}'")
    found = sorted(tuple(r) for r in conversations.repair_damaged(spark.read.parquet(path)).collect())
    assert found == sorted(con.execute(conversations.REPAIR_SQL).fetchall())


def test_every_turn_dropped(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "a.")], "conv_id long, turn long, role string, text string")
    empty = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in conversations.repair_damaged(df).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", empty)]
