"""Library metadata: items from attribute tables, new items, merges, deletions, duplicates, authors."""

from __future__ import annotations

import multiprocessing
import resource
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def items(tables: dict[str, DataFrame], types: list[str], field: str = "title", content_type: str = "application/pdf") -> DataFrame:
    """Distinct (key, value, path) of items of the given types, their field's value and each attachment's path and key.

    ``tables``: items(itemID, key, itemTypeID), itemData(itemID, fieldID, valueID), fields(fieldID, fieldName), itemDataValues(valueID, value),
    itemTypes(itemTypeID, typeName), itemAttachments(itemID, parentItemID, path, contentType). Items without an attachment of the type are left out.

    Fields and types are broadcast. The other tables grow with the library, and compress so well that a file's size says little of what a task would hold of them: they are sorted and merged.
    """
    i, d, f, v = tables["items"], tables["itemData"], tables["fields"], tables["itemDataValues"]
    files = tables["itemAttachments"].where(F.col("contentType") == content_type).select(F.col("itemID").alias("fileID"), F.col("parentItemID").alias("itemID"), "path")
    file_keys = i.select(F.col("itemID").alias("fileID"), F.col("key").alias("file_key"))
    named = d.join(F.broadcast(f.where(F.col("fieldName") == field)), "fieldID").join(v.hint("merge"), "valueID").select("itemID", "value")
    own = i.join(F.broadcast(tables["itemTypes"].where(F.col("typeName").isin(*types))), "itemTypeID").select("itemID", "key")
    return own.join(named.hint("merge"), "itemID").join(files.hint("merge"), "itemID").join(file_keys.hint("merge"), "fileID").select("key", "value", "path", "file_key").distinct()


def page(rows: DataFrame, key: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows after the first ``offset`` by key, ``limit`` of them."""
    out = rows.orderBy(key).offset(offset) if offset else rows.orderBy(key)
    return out.limit(limit) if limit is not None else out


def new_items(library: DataFrame, store: DataFrame, keys: tuple[str, ...] = ("library_key", "title")) -> DataFrame:
    """Items that the store lacks, by key and title; what was removed from the library is not noticed."""
    return library.join(store.select(*keys), list(keys), "left_anti").select(*library.columns)


def insert_merge(current: DataFrame | None, new: DataFrame, key: str | None, order: str) -> DataFrame:
    """The store after inserting rows whose key it lacks; rows it has are never changed.

    Of new rows of one key the first by ``order`` counts. Without a key or a store the new rows are the store.
    """
    if current is None or key is None:
        return new
    return current.unionByName(missing(current.select(key), new, key, order).select(*current.columns))


def missing(held: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The first new row of each key that is not held."""
    return keep_first(new, key, order).join(held, key, "left_anti")


def keep_first(rows: DataFrame, by: str, order: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def delete_keys(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    if column not in rows.columns:
        raise ValueError(f"no column {column}")
    return rows.join(keys.select(column).distinct(), column, "left_anti").select(*rows.columns)


def drop_duplicates_by_key(rows: DataFrame, by: str, key: str, order: str) -> DataFrame:
    """Drops, by key, the rows that follow the first of their ``by`` value; a key they share with a kept row takes that with it."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(order))
    later = rows.withColumn("_rank", rank).where("_rank > 1").select(key).distinct()
    return rows.join(later, key, "left_anti").select(*rows.columns)


def duplicates_removed(rows: DataFrame, by: str) -> DataFrame:
    """One row: how many rows a deduplication by a column takes away; null counts as a value."""
    sizes = rows.groupBy(by).agg(F.count("*").alias("n"))
    return sizes.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("n_removed"))


def lookup(rows: DataFrame, column: str, value, order: str) -> DataFrame:
    if column not in rows.columns:
        raise ValueError(f"no column {column}")
    return rows.where(F.col(column) == F.lit(value)).orderBy(order).limit(1)


def lookup_many(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose value is among the keys, each once however often its key is given."""
    return rows.join(keys.select(column), column, "left_semi").select(*rows.columns)


def authors(creators: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """(item, authors): "last, first" in order of (place, name); of the given items only, where there are some."""
    if items is not None:
        creators = creators.join(items.select("item").distinct(), "item", "left_semi")
    name = F.concat_ws(", ", "last_name", "first_name")
    ordered = F.array_sort(F.collect_list(F.struct(F.col("place"), name.alias("name"))))
    return creators.groupBy("item").agg(F.transform(ordered, lambda x: x["name"]).alias("authors"))


def extracted(pages: DataFrame, key: str, path: str, html: str) -> DataFrame:
    """(key, status, text): text of HTML, or the class of the failure, which fails only its row.

    Classes: ``not_html`` for another ending or type, ``bad_path`` for none, ``error`` for a page without a body.
    """
    body = F.regexp_replace(html, "(?s)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    text = F.btrim(F.regexp_replace(F.regexp_replace(body, "<[^>]*>", " "), "[ \\t\\n\\r]+", " "))
    status = F.when(F.col(path).isNull() | (F.instr(path, "://") == 0), "bad_path").when(F.col(path).endswith(".pdf"), "not_html").when(F.col(html).isNull() | (F.instr(html, "<body") == 0), "error").otherwise("ok")
    rows = pages.select(key, status.alias("status"), text.alias("text"))
    return rows.select(key, "status", F.when(F.col("status") == "ok", F.col("text")).alias("text"))


def raw_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content, length) of the files under a folder, read by Spark in partitions of about equal bytes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "content", "length")


class Extractor:
    """Runs a user's extractor in a process of its own, which may die or hang: it is then ended, and another one takes the next file.

    The process is made from this one, so that the extractor need not be importable, and serves one file after the other.
    """

    def __init__(self, extractor: Callable[[bytes], str], seconds: float, most_mb: int | None) -> None:
        self.extractor, self.seconds, self.most_mb = extractor, seconds, most_mb
        self.process, self.pipe = None, None

    def _serve(self, pipe) -> None:
        if self.most_mb:
            resource.setrlimit(resource.RLIMIT_AS, (self.most_mb << 20, self.most_mb << 20))
        while True:
            data = pipe.recv_bytes()
            try:
                answer = ("ok", self.extractor(data), None)
            except Exception as error:  # noqa: BLE001  any failure is the file's
                answer = ("error", None, f"{type(error).__name__}: {error}")
            pipe.send(answer)

    def text_of(self, data: bytes) -> tuple[str, str | None, str | None]:
        """(status, text, error) of a file."""
        if self.process is None:
            made = multiprocessing.get_context("fork")
            self.pipe, other = made.Pipe()
            self.process = made.Process(target=self._serve, args=(other,), daemon=True)
            self.process.start()
            other.close()
        try:
            self.pipe.send_bytes(data)
            if self.pipe.poll(self.seconds):
                return self.pipe.recv()
            error = f"no answer within {self.seconds:g} seconds"
        except (EOFError, OSError):
            self.process.join(1)
            error = f"the process ended with {self.process.exitcode}"
        self.close()
        return "crash", None, error

    def close(self) -> None:
        if self.process is not None:
            self.process.kill()
            self.process.join()
            self.pipe.close()
        self.process, self.pipe = None, None


def extract_with(files: DataFrame, path: str, content: str, extractor: Callable[[bytes], str], ending: str = "pdf", seconds: float = 60.0, most_mb: int | None = None) -> DataFrame:
    """Adds status, text and error by a user's extractor, such as one for PDF. A file's failure is its row's.

    Statuses: ``wrong_type`` for another ending, ``bad_path`` for no path or content, ``error`` for what the extractor raises, ``crash`` where it ends its process, takes more than
    ``seconds`` for a file, or, with ``most_mb``, is killed for its memory; else ``ok``. Only files of the right kind are given to it. Each task runs it in a process beside the worker, so that the job
    goes on whatever it does.
    """
    kind = F.when(F.col(path).isNull() | F.col(content).isNull(), "bad_path").when(F.lower(F.substring_index(path, ".", -1)) != ending, "wrong_type").otherwise("ok")
    at = files.columns.index(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Extractor(extractor, seconds, most_mb)
        try:
            for batch in batches:
                for k in range(batch.num_rows):
                    found = own.text_of(batch.column(at)[k].as_py())
                    yield pa.RecordBatch.from_arrays([*batch.slice(k, 1).columns, *(pa.array([x], pa.string()) for x in found)], [*batch.schema.names, "status", "text", "error"])
        finally:
            own.close()

    none = F.lit(None).cast("string")
    rows = files.withColumn("_kind", kind)
    schema = StructType([*files.schema.fields, *(StructField(c, StringType()) for c in ("status", "text", "error"))])
    done = rows.where("_kind = 'ok'").drop("_kind").mapInArrow(run, schema)
    return done.unionByName(rows.where("_kind <> 'ok'").select(*files.columns, F.col("_kind").alias("status"), none.alias("text"), none.alias("error")))


def ingest_report(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("n"))
