"""A data source for library files: SQLite files of attribute tables, read by Spark in parts, with filters that SQLite itself applies.

    register(spark)
    spark.read.format("library_files").option("table", "items").load("/mnt/library")

A folder's files are read beside each other, and a large one in ranges of its row ids. What cannot be read is a row with ``_error``: a damaged file, or one without the table, one
row; a value that is not of its column's type, that row. Files must be in a folder that all machines mount, as SQLite opens them by name.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Columns of the tables of a library file that are read.
TABLES = {
    "items": "itemID bigint, key string, itemTypeID bigint",
    "itemData": "itemID bigint, fieldID bigint, valueID string",
    "itemDataValues": "valueID string, value string",
    "fields": "fieldID bigint, fieldName string",
    "itemTypes": "itemTypeID bigint, typeName string",
    "itemAttachments": "itemID bigint, parentItemID bigint, path string, contentType string",
    "itemCreators": "itemID bigint, creatorID bigint, orderIndex bigint",
    "creators": "creatorID bigint, firstName string, lastName string",
}
FILE, ERROR = "_file", "_error"
#: Row ids of a partition, and rows of a batch.
PART_ROWS, BATCH_ROWS = 250_000, 10_000
SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


@dataclass(frozen=True)
class Part(InputPartition):
    file: str
    first: int | None = None
    last: int | None = None
    error: str | None = None


def opened(file: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{file}?mode=ro", uri=True)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class LibraryReader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: StructType, part_rows: int) -> None:
        self.path, self.table, self.part_rows = path.removeprefix("file://"), table, part_rows
        self.arrow = to_arrow_schema(schema)
        self.columns = [n for n in schema.names if n not in (FILE, ERROR)]
        self.where: list[str] = []
        self.values: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  the interface's name
        """Comparisons with a value, membership and tests for null go to SQLite; Spark applies the others."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column not in self.columns:
                yield f
            elif type(f) in SIGNS and isinstance(f.value, (int, str, float)):
                self.where.append(f"{quoted(column)} {SIGNS[type(f)]} ?")
                self.values.append(f.value)
            elif isinstance(f, In) and len(f.value) <= 500:
                self.where.append(f"{quoted(column)} IN ({', '.join('?' * len(f.value))})")
                self.values += list(f.value)
            elif isinstance(f, (IsNull, IsNotNull)):
                self.where.append(f"{quoted(column)} IS {'NOT ' * isinstance(f, IsNotNull)}NULL")
            else:
                yield f

    def partitions(self) -> list[Part]:
        """Ranges of row ids of each file; their ends are looked up, the rows are not."""
        names = [self.path] if os.path.isfile(self.path) else sorted(os.path.join(self.path, n) for n in os.listdir(self.path) if n.endswith(".sqlite"))
        out = []
        for file in names:
            try:
                con = opened(file)
                least, most = con.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
                con.close()
                if least is not None:
                    out += [Part(file, a, min(most, a + self.part_rows - 1)) for a in range(least, most + 1, self.part_rows)]
            except sqlite3.Error as error:
                out.append(Part(file, error=f"{type(error).__name__}: {error}"))
        return out

    def _batch(self, rows: list[tuple], file: str) -> pa.RecordBatch:
        kinds = [self.arrow.field(c).type for c in self.columns]
        try:
            held, errors = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [None] * len(rows)
        except (pa.ArrowInvalid, pa.ArrowTypeError, OverflowError):
            good, errors = [], []
            for row in rows:
                try:
                    good.append([pa.scalar(v, k).as_py() for v, k in zip(row, kinds, strict=True)])
                    errors.append(None)
                except (pa.ArrowInvalid, pa.ArrowTypeError, OverflowError) as error:
                    good.append([None] * len(kinds))
                    errors.append(f"{type(error).__name__}: {error}")
            held = [pa.array(c, k) for c, k in zip(zip(*good, strict=True), kinds, strict=True)]
        by_name = dict(zip(self.columns, held, strict=True)) | {FILE: pa.array([file] * len(rows)), ERROR: pa.array(errors, pa.string())}
        return pa.RecordBatch.from_arrays([by_name[n] for n in self.arrow.names], schema=self.arrow)

    def _failed(self, file: str, error: str) -> pa.RecordBatch:
        own = {FILE: file, ERROR: error}
        return pa.RecordBatch.from_arrays([pa.array([own.get(f.name)], f.type) for f in self.arrow], schema=self.arrow)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition.error:
            yield self._failed(partition.file, partition.error)
            return
        where = " AND ".join(["rowid BETWEEN ? AND ?", *self.where])
        try:
            con = opened(partition.file)
            found = con.execute(f"SELECT {', '.join(map(quoted, self.columns))} FROM {quoted(self.table)} WHERE {where}", [partition.first, partition.last, *self.values])
            while rows := found.fetchmany(BATCH_ROWS):
                yield self._batch(rows, partition.file)
            con.close()
        except sqlite3.Error as error:
            yield self._failed(partition.file, f"{type(error).__name__}: {error}")


class LibraryFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "library_files"

    def schema(self) -> str:
        return f"{TABLES[self.options['table']]}, {FILE} string, {ERROR} string"

    def reader(self, schema: StructType) -> LibraryReader:
        return LibraryReader(self.options["path"], self.options["table"], schema, int(self.options.get("partRows", PART_ROWS)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LibraryFiles)


def library_tables(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables of the library files under a folder, without what cannot be read, and (table, file, error) of that."""
    register(spark)
    read = {t: spark.read.format("library_files").option("table", t).load(path) for t in TABLES}
    errors = None
    for table, rows in read.items():
        own = rows.where(f"{ERROR} is not null").selectExpr(f"'{table}' as table", f"{FILE} as file", f"{ERROR} as error")
        errors = own if errors is None else errors.unionByName(own)
    return {t: rows.where(f"{ERROR} is null").drop(FILE, ERROR) for t, rows in read.items()}, errors


def write_library(tables: dict[str, DataFrame], path: str) -> int:
    """Writes tables as library files into a folder, a file a task, and gives their number. A task that runs again writes the same file anew; a file is there in whole or not at all."""
    folder, written = path.removeprefix("file://"), 0
    os.makedirs(folder, exist_ok=True)
    for name, rows in tables.items():
        columns = [c.split()[0] for c in TABLES[name].split(", ")]

        def run(batches: Iterator[pa.RecordBatch], name: str = name, columns: list[str] = columns) -> Iterator[pa.RecordBatch]:
            task = TaskContext.get()
            file = os.path.join(folder, f"{name}-{task.partitionId():06d}.sqlite")
            own = f"{file}.{task.taskAttemptId()}"
            con = sqlite3.connect(own)
            # A file has all tables, as a library has, and rows of one.
            for t, c in TABLES.items():
                con.execute(f"CREATE TABLE {quoted(t)} ({', '.join(map(quoted, (x.split()[0] for x in c.split(', '))))})")
            for batch in batches:
                con.executemany(f"INSERT INTO {quoted(name)} VALUES ({', '.join('?' * len(columns))})", zip(*(c.to_pylist() for c in batch.columns), strict=True))
            con.commit()
            con.close()
            os.replace(own, file)
            yield pa.RecordBatch.from_arrays([pa.array([file])], ["file"])

        written += rows.select(*columns).mapInArrow(run, "file string").count()
    return written
