"""Files of embedding batches: request lines, result lines and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEMS = "array<struct<file_path: string, library_key: string, title: string, text: string, hash: string>>"
LOG = f"batch_id string, file_id string, provider string, model string, created_at timestamp, items {ITEMS}"
#: Turns of a conversation in one saved line.
RUN = 1000
RESULT = "custom_id string, response struct<body: struct<data: array<struct<embedding: array<float>>>>>, error struct<message: string>, _bad string"


def request_lines(items: DataFrame, id_column: str, text: str) -> DataFrame:
    """One JSON line a text: {custom_id, body: {input: [text]}}."""
    line = F.to_json(F.struct(F.col(id_column).alias("custom_id"), F.struct(F.array(F.col(text)).alias("input")).alias("body")))
    return items.select(line.alias("line"))


def write_requests(items: DataFrame, id_column: str, text: str, path: str, per_file: int = 100_000) -> None:
    request_lines(items, id_column, text).write.option("maxRecordsPerFile", per_file).text(path)


def read_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(succeeded (id, embedding), failed (id, error)); lines that are no such JSON are skipped; the first vector of a line counts, none is an empty one."""
    rows = spark.read.schema(RESULT).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = rows.where("_bad is null and custom_id is not null")
    none = F.array().cast("array<float>")
    good = rows.where("error is null").select(F.col("custom_id").alias("id"), F.coalesce(F.get(F.col("response.body.data"), F.lit(0))["embedding"], none).alias("embedding"))
    return good, rows.where("error is not null").select(F.col("custom_id").alias("id"), F.col("error.message").alias("error"))


def write_logs(items: DataFrame, path: str) -> None:
    """A folder log=batch_<n>.log for each batch of (batch, provider, model, file_path, library_key, title, hash) rows; an item a line, so that no batch is one row."""
    named = F.concat(F.lit("batch-"), F.col("batch").cast("string")).alias("batch_id")
    line = F.to_json(F.struct(named, "provider", "model", F.array(F.struct("file_path", "library_key", "title", "hash")).alias("items")))
    rows = items.select(F.concat(F.lit("batch_"), F.col("batch").cast("string"), F.lit(".log")).alias("log"), line.alias("line"))
    rows.write.mode("append").partitionBy("log").text(path)


def pending(spark: SparkSession, path: str) -> DataFrame:
    """Logs named batch_<n>.log, or in folders named log=batch_<n>.log, newest number first; other names and contents that are no log are left out."""
    rows = spark.read.schema(f"{LOG}, _bad string").option("columnNameOfCorruptRecord", "_bad").option("recursiveFileLookup", "true").json(path)
    named = rows.withColumn("seq", F.regexp_extract("_metadata.file_path", "[/=]batch_([0-9]+)\\.log(?:/[^/]*)?$", 1))
    return named.where("_bad is null and batch_id is not null and seq <> ''").withColumn("seq", F.col("seq").cast("bigint")).drop("_bad").orderBy(F.desc("seq"))


def conversations(spark: SparkSession, path: str) -> DataFrame:
    """Saved conversations, each of one or several lines of JSON, one for a run of its turns; what cannot be read is left out, usage counts as 0 where absent."""
    schema = "conv_id bigint, part bigint, title string, date timestamp, history array<struct<turn: bigint, role: string, text: string>>, usage struct<input: bigint, output: bigint>, _bad string"
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_bad").json(path)
    usage = F.struct(F.coalesce("usage.input", F.lit(0)).alias("input"), F.coalesce("usage.output", F.lit(0)).alias("output"))
    return rows.where("_bad is null and conv_id is not null").drop("_bad").withColumn("usage", usage)


def save_conversations(messages: DataFrame, date, path: str) -> None:
    """Saves each conversation under a name of its own, conversation_<milliseconds>.json by its date; saving again at another date keeps both."""
    rows = saved(messages, date)
    name = F.format_string("conversation_%d.json", F.unix_millis("date"))
    rows.withColumn("save", name).write.mode("append").partitionBy("save").json(path)


def saved(messages: DataFrame, date) -> DataFrame:
    """One row for each run of RUN turns of a conversation, ready to write as JSON, titled by its date."""
    history = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    rows = messages.groupBy("conv_id", F.floor(F.col("turn") / RUN).alias("part")).agg(history.alias("history")).withColumn("date", date)
    return rows.withColumn("title", F.concat(F.lit("Conversation on "), F.date_format("date", "yyyy-MM-dd HH:mm")))
