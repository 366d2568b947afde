"""Token use and its cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTERS = ("input_tokens", "output_tokens", "read_tokens", "written_tokens")
FREE_PROVIDER = "ollama"


def totals(ledger: DataFrame, *keys: str) -> DataFrame:
    return ledger.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in COUNTERS))


def with_prices(ledger: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds prices by model, else by provider/model; local models are free; without an input or output price there is none.

    Unknown prices of the cache are 0. The table is a short list of models.
    """
    known = prices.where("p_in is not null and p_out is not null").select("name", F.struct("p_in", "p_out", F.coalesce("p_written", F.lit(0.0)).alias("p_written"), F.coalesce("p_read", F.lit(0.0)).alias("p_read")).alias("price"))
    by_model = known.select(F.col("name").alias("model"), F.col("price").alias("_a"))
    by_both = known.select(F.col("name").alias("_both"), F.col("price").alias("_b"))
    rows = ledger.withColumn("_both", F.concat_ws("/", "provider", "model")).join(by_model, "model", "left").join(by_both, "_both", "left")
    free = F.struct(*(F.lit(0.0).alias(c) for c in ("p_in", "p_out", "p_written", "p_read")))
    return rows.withColumn("price", F.when(F.col("provider") == FREE_PROVIDER, free).otherwise(F.coalesce("_a", "_b"))).drop("_a", "_b", "_both")


def cost() -> Column:
    plain = F.greatest(F.col("input_tokens") - F.col("written_tokens") - F.col("read_tokens"), F.lit(0))
    return plain * F.col("price.p_in") + F.col("written_tokens") * F.col("price.p_written") + F.col("read_tokens") * F.col("price.p_read") + F.col("output_tokens") * F.col("price.p_out")


def cents() -> Column:
    """Whole cents of one request, cut; small enough errors of floats are forgiven before the cut."""
    return F.floor(F.round(cost() * 100, 9)).cast("bigint")
