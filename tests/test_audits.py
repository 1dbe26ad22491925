"""Digests of tables: equal for equal rows in any order, changed by any change of a row."""

from sluice.operators import audits as A


def test_table_digest(spark):
    rows = [(i, f"t{i % 3}", None if i % 4 else 1.5) for i in range(50)] + [(1, "t1", None)]
    schema = "id long, text string, value double"
    digest = lambda some: tuple(A.table_digest(spark.createDataFrame(some, schema)).first())
    first = digest(rows)
    assert first == digest(rows[::-1]) and first[0] == 51
    assert tuple(A.table_digest(spark.createDataFrame(rows, schema).repartition(5)).first()) == first
    for changed in (rows[:-1], [*rows, rows[0]], [(0, "T0", 1.5), *rows[1:]], [(0, None, 1.5), *rows[1:]], [(0, "t0", None), *rows[1:]]):
        assert digest(changed) != first
    assert digest([])[0] == 0
