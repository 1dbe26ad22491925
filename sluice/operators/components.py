"""Connected groups of a table of links, by min-label propagation with checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> None:
    """Uses the shared folder that the cluster names; sets one only on a single machine
    where none is set, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if spark.sparkContext.getCheckpointDir() is None:
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("a cluster needs spark.checkpoint.dir, a folder that all its machines share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="sluice-"))


def groups(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) of every linked id; root is the smallest id of its group. Each round
    takes the least root among neighbours, then jumps to that root's own root, so long
    chains halve; lineage is cut by a checkpoint each round."""
    spark = links.sparkSession
    checkpoint_dir(spark)
    one = links.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y")
    both = one.union(one.select("y", "x")).distinct().checkpoint()
    state = both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("root")).checkpoint()
    while True:
        theirs = state.select(F.col("x").alias("y"), F.col("root").alias("r"))
        met = both.join(theirs, "y").groupBy("x").agg(F.min("r").alias("r"))
        nearer = state.join(met, "x").select("x", F.least("root", "r").alias("root"))
        jump = nearer.select(F.col("x").alias("root"), F.col("root").alias("up"))
        new = nearer.join(jump, "root").select("x", F.least("root", "up").alias("root")).checkpoint()
        changed = new.join(state.withColumnRenamed("root", "old"), "x").filter("root <> old").limit(1).count()
        state = new
        if not changed:
            return state.select(F.col("x").alias("id"), "root")
