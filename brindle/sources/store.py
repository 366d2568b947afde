"""A store of versioned snapshots in Parquet: folders of rows, and a small file for each version that lists its folders.

Readers take the newest version that has a file, so that a write that breaks off is never seen. Rows are written first, each time to a
folder of a new name, and the file last; it is made only if no other writer has made that version. Inserts add a folder and
deletions write anew only the folders that hold deleted rows, so that the work is that of the change, not of the store.

With ``keyed_by`` every folder is parted by a hash of that column. An insert by that key then reads the keys of those partitions alone that its own keys fall in.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import library
from brindle.sources.files import children, place, present, remove

METADATA = "version bigint, provider string, model string, data_version bigint, parts array<string>"
#: How often a change is tried again after other writers came first, and folders of a version from which ``compact`` has something to do.
TRIES, MANY_PARTS = 5, 64
#: Partitions of a keyed store's folders, and the columns that have their numbers and the folders' names.
BUCKETS, BUCKET, PART = 64, "_bucket", "_part"


class Conflict(RuntimeError):
    """Another writer made this version first."""


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    path: str
    provider: str = "hashed"
    model: str = "bag-64"
    keyed_by: str | None = None

    def metadata(self) -> DataFrame:
        try:
            return self.spark.read.schema(METADATA).json(f"{self.path}/metadata").where("version is not null")
        except AnalysisException:
            return self.spark.createDataFrame([], METADATA)

    def last(self) -> tuple[int, list[str]]:
        """Newest version and its folders, from its file alone; 0 and none where there is no store."""
        files, where = place(self.spark, f"{self.path}/metadata")
        if not files.exists(where):
            return 0, []
        names = sorted((f.getPath().getName() for f in files.listStatus(where)), reverse=True)
        for name in (n for n in names if n.endswith(".json") and not n.startswith(("_", "."))):
            row = self.spark.read.schema(METADATA).json(f"{self.path}/metadata/{name}").where("version is not null").first()
            if row:
                return row["version"], row["parts"]
        return 0, []

    def version(self) -> int:
        return self.last()[0]

    def exists(self) -> bool:
        return self.version() > 0

    def read(self, *columns: str) -> DataFrame:
        return self._rows(self.last()[1], *columns)

    def _rows(self, parts: list[str], *columns: str, buckets: list[int] | None = None) -> DataFrame:
        if not parts:
            raise ValueError(f"no store at {self.path}")
        read = self.spark.read.option("basePath", f"{self.path}/data") if self.keyed_by else self.spark.read
        rows = read.parquet(*(f"{self.path}/{p}" for p in parts))
        if buckets is not None:
            rows = rows.where(F.col(BUCKET).isin(buckets))
        return rows.select(*columns) if columns else rows.drop(BUCKET, PART)

    def _write(self, rows: DataFrame) -> str:
        part = f"data/{PART}={uuid.uuid4().hex}" if self.keyed_by else f"data/{uuid.uuid4().hex}"
        if self.keyed_by:
            placed = rows.withColumn(BUCKET, bucket_of(self.keyed_by))
            placed.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{part}")
        else:
            rows.write.parquet(f"{self.path}/{part}")
        return part

    def held(self, new: DataFrame, key: str, parts: list[str] | None = None) -> DataFrame:
        """Keys that the store has, at least those among the keys of ``new``: of a store keyed by them from the partitions that these fall in, of which there are at most ``BUCKETS``."""
        touched = [r[0] for r in new.select(bucket_of(key)).distinct().collect()] if key == self.keyed_by else None
        return self._rows(self.last()[1] if parts is None else parts, key, buckets=touched)

    def _publish(self, version: int, parts: list[str]) -> int:
        """Makes the file of a version, for the first writer only."""
        row = {"version": version, "provider": self.provider, "model": self.model, "data_version": version, "parts": parts}
        files, where = place(self.spark, f"{self.path}/metadata/{version:012d}.json")
        try:
            out = files.create(where, False)
        except Py4JJavaError as error:
            if files.exists(where):
                raise Conflict(f"version {version} of {self.path} was made by another writer") from error
            raise
        out.write((json.dumps(row) + "\n").encode())
        out.close()
        return version

    def _change(self, change: Callable[[list[str]], list[str] | None]) -> int:
        """Applies a change to the newest version's folders, on the next newest where another writer came first."""
        for attempt in range(TRIES):
            version, parts = self.last()
            new = change(parts)
            if new is None:
                return version
            try:
                return self._publish(version + 1, new)
            except Conflict:
                if attempt + 1 == TRIES:
                    raise
        return version

    def commit(self, rows: DataFrame) -> int:
        """A version of these rows alone."""
        part = self._write(rows)
        return self._change(lambda _: [part])

    def insert(self, new: DataFrame, key: str | None, order: str, make: Callable[[DataFrame], DataFrame] | None = None) -> int:
        """Inserts what is missing by key; an empty input changes nothing. Without a key the new rows are the store.

        With ``make`` what is missing is turned to the store's rows, several to a key perhaps: a key is then wholly there or not at all.
        """
        if new.isEmpty():
            return self.version()
        made = make or (lambda rows: rows)

        def change(parts: list[str]) -> list[str] | None:
            if not parts or key is None:
                return [self._write(made(library.keep_first(new, key, order) if key else new))]
            columns = self._rows(parts).columns
            part = self._write(made(library.missing(self.held(new, key, parts), new, key, order)).select(*columns))
            # A keyed folder without rows has no partition, and is left out.
            return [*parts, part] if not self.keyed_by or children(self.spark, f"{self.path}/{part}", f"{BUCKET}=") else None

        return self._change(change)

    def delete(self, keys: DataFrame, column: str) -> int:
        if keys.isEmpty():
            return self.version()

        def change(parts: list[str]) -> list[str] | None:
            rows = self._rows(parts)
            if column not in rows.columns:
                raise ValueError(f"no column {column}")
            wanted = keys.select(column).distinct()
            part = F.regexp_extract("_metadata.file_path", f"/(data/[^/]+)/(?:{BUCKET}=[0-9]+/)?[^/]*$", 1)
            # At most one row a folder reaches the driver.
            held = {r[0] for r in rows.select(column, part.alias("_part")).join(wanted, column, "left_semi").select("_part").distinct().collect()}
            touched = [p for p in parts if p in held]
            if not touched:
                return [*parts]
            rest, part = [p for p in parts if p not in held], self._write(library.delete_keys(self._rows(touched), wanted, column))
            empty = self.keyed_by and not children(self.spark, f"{self.path}/{part}", f"{BUCKET}=")
            return rest if empty and rest else [*rest, part]

        return self._change(change)

    def compact(self, many: int = MANY_PARTS) -> int:
        """The same rows in one folder, where a version has at least ``many``, as after many small inserts."""
        return self._change(lambda parts: [self._write(self._rows(parts))] if len(parts) >= many else None)

    def stats(self) -> DataFrame:
        """(n_rows, version, provider, model) of the newest version; none is an error."""
        if not self.exists():
            raise ValueError(f"no metadata at {self.path}")
        last = self.metadata().agg(F.max_by(F.struct("version", "provider", "model"), "version").alias("m"))
        return self.read().agg(F.count("*").alias("n_rows")).crossJoin(F.broadcast(last)).select("n_rows", "m.version", "m.provider", "m.model")


def bucket_of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias(BUCKET)


def stage(rows: DataFrame, path: str) -> DataFrame:
    """Keeps a batch before the store is written, so that a failed write can be replayed."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.parquet(path)


def replay(store: Store, staged: str, key: str, order: str) -> int:
    """Inserts a staged batch and deletes it once it is stored. A batch that is gone was stored already; one that stays after a failure may be replayed: what is stored is left alone."""
    if not present(store.spark, staged):
        return store.version()
    version = store.insert(store.spark.read.parquet(staged), key, order)
    remove(store.spark, staged)
    return version
