"""Settings that a session needs before queries with Python workers run."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


#: Bytes of a batch of rows on its way to a Python worker, about.
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package also where the driver was started elsewhere, and bounds the batches that they get.

    On a cluster the package comes with the job, as by --py-files. A batch is bounded in bytes, since 10,000 rows of texts are much more than as many of numbers; smaller bounds that are set stay.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(":")
    if ROOT not in paths:
        environment["PYTHONPATH"] = ":".join(p for p in [ROOT, *paths] if p)


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a scan of fewer parts than the cluster has cores, dealt to all of these; others as they are. A file of one row group is one task otherwise, whatever is done with its texts."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def scratch_dir(spark: SparkSession) -> str:
    """A new folder name under the folder that the cluster shares, as spark.checkpoint.dir has it.

    Where that is unset, one machine gets a temporary folder; a cluster gets an error, since its machines would not share it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            root = found.get()
        elif spark.sparkContext.master.startswith("local["):
            root = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
            spark.sparkContext.setCheckpointDir(root)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{folder(spark, root)}/{uuid.uuid4().hex}"


def folder(spark: SparkSession, root: str) -> str:
    """Everything that an application writes for its own use is in one folder, which may be deleted when it ends."""
    return f"{root.rstrip('/')}/scratch-{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Deletes the application's scratch tables: for when no result that reads them is needed any more."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if root:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder(spark, root))
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
