"""From raw documents to training sequences: quality rules, toxicity, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; it is written as Parquet and read again as the next one's docs.
All but the last give the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.ngram_join import ngram_jaccard_join
from brindle.llm.packing import pack_documents
from brindle.llm.quality_rules import quality_rules
from brindle.llm.queries import tokenizer_path
from brindle.llm.shared import prepare, table, written
from brindle.llm.toxicity import toxicity


#: Documents that go, of which ids and marks alone are broadcast, 24 bytes each; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def whole(docs: DataFrame) -> Column:
    """A document's columns as one, so that none has a name that an operator uses."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality_rules(docs.select("text", "source", whole(docs)), columns=("row",)).where("kept").select("row.*")


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return toxicity(docs.select("doc_id", "text", whole(docs)), table(spark, sf_dir, "labels"), keep=("row",)).where("predicted = 0").select("row.*")


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group stays, once; rows without an id, or a word, are in no group.

    A document is an id with a text, so that of an id with several texts those stay that are no copies. Repeated rows stay once; those without an id all stay.
    """
    prepare(spark)
    found = written(ngram_jaccard_join(docs.select("doc_id", "text"), with_groups=True).select("doc_id", "mark", "group"))
    least = found.where("group is not null").groupBy("group").agg(F.min(F.struct("doc_id", "mark")).alias("m"), F.count("*").alias("members")).where("members > 1").drop("members")
    own = found.where("doc_id is not null").groupBy("doc_id", "mark").agg(F.first("group").alias("group"), F.count("*").alias("n"))
    judged = own.join(least, "group", "left").withColumn("goes", F.coalesce(F.struct("doc_id", "mark") != F.col("m"), F.lit(False)))
    # What goes, and what stays once of several rows: the rest is left alone.
    marked = written(judged.where("goes or n > 1").select("doc_id", "mark", "goes"))
    few = F.broadcast(marked) if marked.count() <= BROADCAST_ROWS else marked
    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), whole(docs))
    alone = rows.join(few, ["doc_id", "mark"], "left_anti").select("row.*")
    again = F.row_number().over(Window.partitionBy("doc_id", "mark").orderBy("doc_id"))
    once = rows.join(few.where("not goes"), ["doc_id", "mark"], "left_semi").withColumn("n", again).where("n = 1").select("row.*")
    return alone.unionByName(once)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return pack_documents(docs.select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"), capacity=2048, end_id=0)


STAGES = [("quality_rules", keep_quality), ("toxicity", keep_civil), ("ngram_jaccard_join", keep_one_of_group), ("best_two_fit", packed)]

#: Trees and tokenizers have no SQL: tests/llm compares run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
