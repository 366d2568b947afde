"""Folders in whatever file system Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.session import scratch_dir


def place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def present(spark: SparkSession, path: str) -> bool:
    files, where = place(spark, path)
    return files.exists(where)


def children(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the folders under a folder whose names are a prefix and a number, ascending; none where there is no such folder."""
    files, where = place(spark, path)
    if not files.exists(where):
        return []
    names = [f.getPath().getName() for f in files.listStatus(where)]
    return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix))


def remove(spark: SparkSession, path: str) -> None:
    files, where = place(spark, path)
    files.delete(where, True)


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of all files under a folder."""
    files, where = place(spark, path)
    return files.getContentSummary(where).getLength()


def kept(rows: DataFrame) -> DataFrame:
    """The same rows as a scratch table, for what is read several times."""
    path = scratch_dir(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
