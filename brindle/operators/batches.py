"""Asynchronous embedding batches: cache, overlaps, outcomes, retries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["hash", "provider", "model"]


def known_results(results: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results with their batch item, and results of unknown ids."""
    own = items.withColumnRenamed("library_key", "id")
    return results.join(own, ["batch", "id"]), results.join(own, ["batch", "id"], "left_anti")


def uncached(items: DataFrame, cache: DataFrame) -> DataFrame:
    """Items whose text, provider and model the cache does not have together."""
    return items.join(cache.select(*KEY).distinct(), KEY, "left_anti").select(*items.columns)


def split_pending(new: DataFrame, pending: DataFrame) -> DataFrame:
    """Adds is_pending: the same text waits at the same provider and model."""
    waiting = pending.select(*KEY).distinct().withColumn("_waiting", F.lit(True))
    return new.join(waiting, KEY, "left").withColumn("is_pending", F.coalesce("_waiting", F.lit(False))).drop("_waiting")


def subsumed(pending: DataFrame, new: DataFrame) -> DataFrame:
    """Batches all of whose keys are new keys, if there are more new keys than that."""
    keys = new.select("hash").distinct()
    total = keys.agg(F.count("*").alias("n_new"))
    own = pending.select("batch", "hash").distinct().join(keys.withColumn("_hit", F.lit(1)), "hash", "left")
    sizes = own.groupBy("batch").agg(F.count("*").alias("n_keys"), F.coalesce(F.sum("_hit"), F.lit(0)).alias("n_hit"))
    return sizes.crossJoin(F.broadcast(total)).where("n_hit = n_keys and n_keys < n_new").select("batch", "n_keys")


def outcomes(results: DataFrame, items: DataFrame) -> DataFrame:
    """(batch, outcome, n_failed, errors): the first three errors by id; a count of results unlike that of items is an error."""
    sizes = items.groupBy("batch").agg(F.count("*").alias("n_items"))
    failed = F.col("error").isNotNull()
    # Only the first errors are kept of each batch, whatever its size.
    rank = F.row_number().over(Window.partitionBy("batch", failed).orderBy("id"))
    first = results.where(failed).withColumn("_rank", rank).where("_rank <= 3").groupBy("batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "error"))), lambda x: x["error"]).alias("errors"))
    done = results.groupBy("batch").agg(F.count("*").alias("n_results"), F.sum(failed.cast("int")).cast("bigint").alias("n_failed"))
    both = sizes.join(done, "batch", "full_outer").join(first, "batch", "left")
    outcome = (
        F.when(~F.col("n_items").eqNullSafe(F.col("n_results")), "mismatch").when(F.col("n_failed") == F.col("n_items"), "all failed").when(F.col("n_failed") == 0, "all succeeded").otherwise("partial")
    )
    return both.select("batch", outcome.alias("outcome"), F.coalesce("n_failed", F.lit(0)).cast("bigint").alias("n_failed"), F.coalesce("errors", F.array().cast("array<string>")).alias("errors"))


def merged_cache(cache: DataFrame, items: DataFrame, inserted: DataFrame, seq: int, provider: str, model: str) -> DataFrame:
    """The hash cache after a batch: newly inserted texts take the batch's entry, and others of the batch a higher number if provider and model agree."""
    batch = items.select("hash").distinct().withColumn("_in", F.lit(True))
    new = inserted.select("hash").distinct().withColumn("_new", F.lit(True))
    rows = cache.join(batch, "hash", "left").join(new, "hash", "full_outer")
    same = (F.col("provider") == provider) & (F.col("model") == model)
    fresh = F.col("_new").isNotNull()
    bumped = F.when(F.col("_in").isNotNull() & same & (F.col("seq") < seq), F.lit(seq)).otherwise(F.col("seq"))
    return rows.select("hash", F.when(fresh, provider).otherwise(F.col("provider")).alias("provider"), F.when(fresh, model).otherwise(F.col("model")).alias("model"), F.when(fresh, F.lit(seq)).otherwise(bumped).cast("bigint").alias("seq"))


def latest(parts: list[DataFrame], key: str) -> DataFrame:
    """Union of cache parts in which, for a key, the last part that has it counts."""
    rows = None
    for order, part in enumerate(parts):
        part = part.withColumn("_order", F.lit(order))
        rows = part if rows is None else rows.unionByName(part)
    columns = [c for c in rows.columns if c not in (key, "_order")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct("_order", *columns)).alias("v")).select(key, *(f"v.{c}" for c in columns))


def retry_set(items: DataFrame, results: DataFrame) -> DataFrame:
    failed = results.where("error is not null").select("batch", F.col("id").alias("library_key"))
    return items.join(failed, ["batch", "library_key"], "left_semi").select(*items.columns)


def next_sequence(numbers: DataFrame, column: str) -> DataFrame:
    return numbers.agg((F.coalesce(F.max(column), F.lit(0)) + 1).cast("bigint").alias("next_seq"))
