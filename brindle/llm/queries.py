"""Thin queries over the whole tables, one for each operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import sql
from brindle.llm.shared import prepare, table, written

#: Fixed values of the contract: the policy of operator 7.
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.ngram_join import ngram_jaccard_join

    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.byte_bpe import byte_bpe

    return byte_bpe(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), piece_pattern())


def op5_grid_order_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.embedding_join import embedding_near_dedup

    return embedding_near_dedup(table(spark, sf_dir, "embeddings"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), piece_pattern())


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.url_filter import Rule, repeated_addresses, url_filter

    pages = table(spark, sf_dir, "pages")
    return url_filter(pages, [Rule(*r) for r in URL_RULES], repeated_addresses(pages))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.token_store import read_documents, remove, write_store

    store = write_store(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)
    found = written(read_documents(spark, store, with_ids=False))
    remove(spark, store)
    return found


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.warc import archive_pages

    return archive_pages(table(spark, sf_dir, "pages"))


def op10_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), capacity=2048, end_id=0)


def with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with periodic texts among them, as the contract of operator 11 has it: where 10 divides crc32 of the id, the words from a on are the next p words again and again."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h")).select("doc_id", "text", F.when(F.pmod("h", F.lit(10)) == 0, words).alias("w"), F.floor(F.col("h") / 10).alias("g"))
    rows = rows.withColumn("n", F.coalesce(F.size("w"), F.lit(0))).withColumn("a", F.expr("CAST(g % greatest(n, 1) AS INT)")).withColumn("p", F.expr("CAST(1 + (n - a) div (3 + g % 8) AS INT)"))
    turned = F.expr("array_join(concat(slice(w, 1, a), slice(flatten(array_repeat(slice(w, a + 1, p), CAST(ceil((n - a) / p) AS INT))), 1, n - a)), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, turned).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.periodic_runs import periodic_runs

    found = periodic_runs(with_repeats(table(spark, sf_dir, "documents")))
    listed = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.ranked_search import ranked_search

    return ranked_search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.line_dedup import line_dedup

    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_ngram_join, op2_toxicity, op3_quality_rules, op4_byte_bpe, op5_grid_order_join, op6_token_counts, op7_url_filter, op8_token_store, op9_warc, op10_best_two_fit, op11_periodic_runs, op12_ranked_search, op13_line_dedup)}


def prepared(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {name: prepared(f) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": sql.OP1, "op3_quality_rules": sql.OP3, "op5_grid_order_join": sql.OP5, "op7_url_filter": sql.OP7, "op9_warc": sql.OP9, "op11_periodic_runs": sql.OP11, "op12_ranked_search": sql.OP12, "op13_line_dedup": sql.OP13}
