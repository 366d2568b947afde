"""What several operators of this package need: scratch tables and components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.session import prepare, scratch_dir, spread

__all__ = ["components", "prepare", "scratch_dir", "table", "written"]


def written(df: DataFrame) -> DataFrame:
    """The same rows, cut from their lineage by a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in ("documents", "pages") else rows


def components(edges: DataFrame) -> DataFrame:
    """Connected components: (node, component) for every node on an edge of (a, b).

    Each round hooks every root to the smallest label next to it and then jumps pointers, so
    that chains halve; the rounds stop when no label changes. Labels are the smallest node of a
    component in the end. Only aggregates reach the driver: one count a round.
    """
    spark = edges.sparkSession
    both = written(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        .select("e.a", "e.b")
        .distinct()
    )
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("near")), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("near").alias("near"))
        )
        new = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("least"))
        # The label's own label may have fallen too: the root takes the least that any member saw.
        hook = new.groupBy("label").agg(F.min("least").alias("hook"))
        jumped = written(
            new.join(hook, "label").select("node", F.least("least", "hook").alias("label"), (F.least("least", "hook") < F.col("label")).alias("moved"))
        )
        moved = jumped.where("moved").limit(1).count()
        labels = jumped.select("node", "label")
        if not moved:
            return labels.select("node", F.col("label").alias("component"))
