"""Checks of a store and rules that name what is wrong with it."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.sources.files import present, size_of
from brindle.sources.store import Store

ZERO = 1e-8
INDEX_FROM = 10_000
REPORT = "directory_exists boolean, n_bytes bigint, accessible boolean, n_rows bigint, n_zero bigint, n_wrong bigint, n_empty bigint, indexes array<string>, stored_version bigint, live_version bigint, errors map<string, string>"


def squared_norm(vector: str) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0)) * F.coalesce(x.cast("double"), F.lit(0.0)))


def zero_vectors(rows: DataFrame, vector: str = "vector") -> DataFrame:
    return rows.where(squared_norm(vector) <= ZERO)


def wrong_dimension(rows: DataFrame, dimension: int, vector: str = "vector") -> DataFrame:
    return rows.where(F.col(vector).isNull() | (F.size(vector) != dimension))


def check(rows: DataFrame, dimension: int, vector: str = "vector") -> DataFrame:
    """One row from one pass: rows, zero vectors, vectors of another dimension, empty texts."""
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("bigint")
    return rows.agg(F.count("*").alias("n_rows"), count(squared_norm(vector) <= ZERO).alias("n_zero"), count(F.col(vector).isNull() | (F.size(vector) != dimension)).alias("n_wrong"), count(F.col("text") == "").alias("n_empty"))


def report(store: Store, dimension: int, indexes: dict[str, str] | None = None, vector: str = "vector") -> DataFrame:
    """One row of all checks of a store; ``indexes`` are folders of indexes by name.

    A check that fails is null and has its reason in ``errors``; those that need what it lacks are left out, as all are without a folder.
    Only figures reach the driver.
    """
    spark, errors = store.spark, {}

    def tried(name: str, ask: Callable[[], object]):
        try:
            return ask()
        except (PySparkException, Py4JError, ValueError, OSError) as error:
            errors[name] = f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}"
            return None

    exists = present(spark, store.path)
    figures, listed, stored, live, size, parts = None, None, None, None, None, None
    if exists:
        size = tried("size", lambda: size_of(spark, store.path))
        last = tried("table", store.last)
        parts = tried("table", lambda: store.read().columns) if last else None
        listed = tried("indexes", lambda: sorted(n for n, path in (indexes or {}).items() if present(spark, path)))
        if parts:
            figures = tried("rows", lambda: check(store.read(), dimension, vector).first())
            stored = tried("version", lambda: store.metadata().agg(F.max_by("data_version", "version")).first()[0])
            live = tried("version", store.version)
    counts = list(figures) if figures else [None] * 4
    row = (exists, size, None if not exists else parts is not None, *counts, listed, stored, live, errors)
    return spark.createDataFrame([row], REPORT)


def doctor(found: DataFrame) -> DataFrame:
    """(symptom, help) rows for what a report found."""
    failed = lambda name: F.map_contains_key("errors", F.lit(name))
    rules = [
        (~F.col("directory_exists"), "no store", "look for another folder, or run an ingest"),
        (F.col("directory_exists") & ~F.col("accessible"), "the table cannot be read", "see that the folder holds a store; bring it back from a copy"),
        (failed("rows"), "rows cannot be counted", "try again; if it stays, files are missing or damaged"),
        (F.col("n_rows") == 0, "empty store", "run an ingest"),
        (F.col("n_zero") > 0, "zero vectors", "run a repair"),
        (F.col("n_wrong") > 0, "vectors of another dimension", "embed again"),
        ((F.col("n_rows") > INDEX_FROM) & (F.size("indexes") == 0), "no index", "build an index"),
        (failed("indexes"), "indexes cannot be listed", "try again; if it stays, build them anew"),
        (F.col("stored_version") != F.col("live_version"), "versions differ", "see who else writes to the store"),
    ]
    arms = F.array(*(F.when(rule, F.struct(F.lit(a).alias("symptom"), F.lit(b).alias("help"))) for rule, a, b in rules))
    return found.select(F.explode(F.array_compact(arms)).alias("r")).select("r.symptom", "r.help")
