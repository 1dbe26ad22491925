import pytest

from sluice.operators import snapshots as S


def test_copy_check_restore_and_prune(spark, tmp_path):
    root = str(tmp_path / "copies")
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "id long, v string")
    at = S.create({"t": df, "e": df.limit(0)}, root, "2026-01-01")
    assert S.problems(spark, at) == []
    assert sorted(map(str, S.restore(spark, at)["t"].collect())) == sorted(map(str, df.collect()))
    df.filter("id = 1").write.mode("overwrite").parquet(f"{at}/t")
    with pytest.raises(ValueError, match="t: 3 rows"):
        S.restore(spark, at)
    S.create({"t": df}, root, "2026-01-02")
    assert S.prune(spark, root, 1) == ["2026-01-01"]
    with pytest.raises(ValueError):
        S.create({"t": df}, root, "../x")


def test_export(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x,y")], "id long, v string")
    S.export(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert sorted((r.id, r.v or "") for r in back.collect()) == [("1", ""), ("2", "x,y")]
