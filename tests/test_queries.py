"""Every query of the record engine against its SQL, over the smallest tables."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from sluice.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, list | tuple):
        return str([plain(x) for x in v])
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


#: Queries that SQL can't express, and the tests that hold them against plain versions.
ELSEWHERE = {
    "canonical_urls_exact": "test_text.py", "resolved_messages": "test_replay.py", "replayed_messages": "test_replay.py", "resolution_reasons": "test_replay.py", "verified_links": "test_resolving.py",
    "rate_limited": "test_ledgers.py", "table_digests": "test_audits.py",
}


def test_every_query_is_held_against_something():
    assert set(registry.QUERIES) - set(registry.ORACLE_SQL) == set(ELSEWHERE)
    here = Path(__file__).parent
    assert all((here / file).exists() for file in ELSEWHERE.values())


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())
