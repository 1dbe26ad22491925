"""Copies of tables with a manifest of rows and digests: made, checked, restored, pruned.
All paths go through Spark's own file system, so any store that it reads will do."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators.audits import table_digest


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def create(tables: dict[str, DataFrame], root: str, label: str) -> str:
    """Writes the tables and, last, their manifest: a copy without one is not complete."""
    if not re.fullmatch(r"[A-Za-z0-9._-]{1,64}", label):
        raise ValueError("a label is letters, digits, dots, dashes and underscores")
    at = f"{root}/{label}"
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        df.write.mode("error").parquet(f"{at}/{name}")
        d = table_digest(spark.read.parquet(f"{at}/{name}")).first()
        rows.append({"name": name, "rows": d["rows"], "digest": d["digest"]})
    spark.createDataFrame([(json.dumps(r),) for r in rows], "value string").coalesce(1).write.mode("error").text(f"{at}/_manifest")
    return at


def manifest(spark: SparkSession, at: str) -> dict[str, tuple[int, str]]:
    return {(d := json.loads(r.value))["name"]: (d["rows"], d["digest"]) for r in spark.read.text(f"{at}/_manifest").collect()}


def problems(spark: SparkSession, at: str) -> list[str]:
    """What of a copy doesn't agree with its manifest."""
    out = []
    for name, (rows, digest) in manifest(spark, at).items():
        found = table_digest(spark.read.parquet(f"{at}/{name}")).first()
        if (found["rows"], found["digest"]) != (rows, digest):
            out.append(f"{name}: {rows} rows in the manifest, {found['rows']} in the copy" if found["rows"] != rows else f"{name}: another digest")
    return out


def restore(spark: SparkSession, at: str) -> dict[str, DataFrame]:
    """The tables of a copy that is whole; refused otherwise."""
    if bad := problems(spark, at):
        raise ValueError("; ".join(bad))
    return {name: spark.read.parquet(f"{at}/{name}") for name in manifest(spark, at)}


def prune(spark: SparkSession, root: str, keep: int) -> list[str]:
    """Removes all copies but the last `keep` by name; returns what went."""
    fs, p = _fs(spark, root)
    names = sorted((s.getPath().getName() for s in fs.listStatus(p)), reverse=True)
    gone = names[max(1, keep) :]
    for name in gone:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}"), True)
    return gone


def export(df: DataFrame, path: str, kind: str = "csv") -> None:
    """CSV with a header, or JSON lines; one file per partition."""
    writer = df.select([F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns]).write.mode("error")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)
