"""Views over the driver's tables that stand in for a library, its store and its logs.

Each has the same definition in SQL, for the queries' own SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.session import spread

#: Tables of texts, which take long a row.
TEXTS = ("documents", "pages")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in TEXTS else rows


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as library items: (doc_id, library_key, title, file_path, text, lang, source)."""
    key = F.col("doc_id").cast("string")
    ending = F.element_at(F.array(F.lit(".txt"), F.lit(".pdf"), F.lit(".PDF")), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    return read(spark, sf_dir, "documents").select(
        "doc_id", key.alias("library_key"), F.substring(F.substring_index("text", "\n", 1), 1, 120).alias("title"), F.concat("source", F.lit("/"), key, ending).alias("file_path"), "text", "lang", "source"
    )


LIB = """lib AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS library_key, substr(split_part(text, chr(10), 1), 1, 120) AS title,
  source || '/' || CAST(doc_id AS VARCHAR) || CASE doc_id % 3 WHEN 0 THEN '.txt' WHEN 1 THEN '.pdf' ELSE '.PDF' END AS file_path, text, lang, source FROM documents)"""

#: What is stored already, and what comes in; German items are in both.
STORED, INCOMING = ("en", "de"), ("de", "fr", "es")


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library(spark, sf_dir).where(F.col("lang").isin(*STORED))


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library(spark, sf_dir).where(F.col("lang").isin(*INCOMING))


STORE = LIB + """, store AS (SELECT * FROM lib WHERE lang IN ('en', 'de')), incoming AS (SELECT * FROM lib WHERE lang IN ('de', 'fr', 'es'))"""


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of pending batches: one batch a source, with provider and model by language."""
    lib = library(spark, sf_dir)
    return lib.select(
        F.regexp_extract("source", "[0-9]+$", 0).cast("bigint").alias("batch"), "library_key", "title", "file_path", "text", F.md5("text").alias("hash"),
        F.when(F.col("lang") == "en", "voyage").otherwise("openai").alias("provider"), F.concat(F.lit("model-"), "lang").alias("model"), "lang",
    )


BATCHES = LIB + """, batches AS (SELECT CAST(regexp_extract(source, '[0-9]+$') AS BIGINT) AS batch, library_key, title, file_path, text, md5(text) AS hash,
  CASE WHEN lang = 'en' THEN 'voyage' ELSE 'openai' END AS provider, 'model-' || lang AS model, lang FROM lib)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of batch items: (batch, id, error); Spanish items failed, and one id in each batch is unknown."""
    items = batches(spark, sf_dir)
    known = items.select("batch", F.col("library_key").alias("id"), F.when(F.col("lang") == "es", F.concat(F.lit("error "), "library_key")).alias("error"))
    unknown = items.select("batch").distinct().select("batch", F.concat(F.lit("unknown-"), F.col("batch").cast("string")).alias("id"), F.lit(None).cast("string").alias("error"))
    return known.unionByName(unknown)


RESULTS = BATCHES + """, results AS (SELECT batch, library_key AS id, CASE WHEN lang = 'es' THEN 'error ' || library_key END AS error FROM batches
  UNION ALL SELECT DISTINCT batch, 'unknown-' || CAST(batch AS VARCHAR), CAST(NULL AS VARCHAR) FROM batches)"""


def hash_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hash, provider, model, seq) of texts met before: those of the stored items, under their sources' numbers."""
    items = batches(spark, sf_dir).where(F.col("lang").isin(*STORED))
    return items.groupBy("hash").agg(F.min("provider").alias("provider"), F.min("model").alias("model"), F.min("batch").alias("seq"))


CACHE = BATCHES + """, cache AS (SELECT hash, min(provider) AS provider, min(model) AS model, min(batch) AS seq FROM batches WHERE lang IN ('en', 'de') GROUP BY hash)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token use of each message: four bytes a token; what assistants say is output, the rest is input."""
    tokens = F.ceil(F.octet_length("text") / 4).cast("bigint")
    said = F.col("role") == "assistant"
    model = F.element_at(F.array(F.lit("small"), F.lit("large"), F.lit("openai/mini")), (F.pmod("conv_id", F.lit(3)) + 1).cast("int"))
    return read(spark, sf_dir, "conversations").select(
        "conv_id", "turn", model.alias("model"), F.element_at(F.array(F.lit("acme"), F.lit("ollama"), F.lit("openai")), (F.pmod("conv_id", F.lit(3)) + 1).cast("int")).alias("provider"),
        F.when(said, 0).otherwise(tokens).cast("bigint").alias("input_tokens"), F.when(said, tokens).otherwise(0).cast("bigint").alias("output_tokens"),
        F.when(F.col("turn") > 1, F.floor(tokens / 2)).otherwise(0).cast("bigint").alias("read_tokens"), F.when(F.col("turn") == 0, F.floor(tokens / 3)).otherwise(0).cast("bigint").alias("written_tokens"),
    )


LEDGER = """sized AS (SELECT *, CAST(ceil(octet_length(encode(text)) / 4) AS BIGINT) AS t FROM conversations),
ledger AS (SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'large' ELSE 'openai/mini' END AS model, CASE conv_id % 3 WHEN 0 THEN 'acme' WHEN 1 THEN 'ollama' ELSE 'openai' END AS provider,
  CASE WHEN role = 'assistant' THEN 0 ELSE t END AS input_tokens, CASE WHEN role = 'assistant' THEN t ELSE 0 END AS output_tokens,
  CASE WHEN turn > 1 THEN t // 2 ELSE 0 END AS read_tokens, CASE WHEN turn = 0 THEN t // 3 ELSE 0 END AS written_tokens FROM sized)"""

#: Prices a token: input, output, cache writing and reading; null where unknown.
PRICES = (("small", 1e-6, 2e-6, None, None), ("acme/large", 3e-6, 15e-6, 3.75e-6, 3e-7), ("openai/mini", 2e-6, 8e-6, 2.5e-6, 2e-7), ("broken", None, 1e-6, None, None))


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, "name string, p_in double, p_out double, p_written double, p_read double")


PRICE_SQL = "prices(name, p_in, p_out, p_written, p_read) AS (VALUES ('small', 1e-6, 2e-6, NULL, NULL), ('acme/large', 3e-6, 15e-6, 3.75e-6, 3e-7), ('openai/mini', 2e-6, 8e-6, 2.5e-6, 2e-7), ('broken', NULL, 1e-6, NULL, NULL))"

#: Tags that stand for type sizes, with size and font.
TAGS = (("title", 24.0, "CMBX"), ("h1", 18.0, "CMBX"), ("p", 10.0, "CMR"), ("b", 10.0, "CMBX"))
PAGE_BYTES = 2000


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in a page's HTML where the type changes: (doc, byte_index, page_number, font_size, font_name)."""
    from pyspark.sql import Window

    names = "|".join(t for t, _, _ in TAGS)
    pieces = F.split(F.regexp_replace("html", f"<({names})(>|\\s[^>]*>)", "\u0001$0"), "\u0001")
    flat = read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc"), F.posexplode(pieces).alias("at", "piece"))
    before = Window.partitionBy("doc").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    flat = flat.select("doc", "at", F.regexp_extract("piece", f"^<({names})", 1).alias("tag"), F.coalesce(F.sum(F.octet_length("piece")).over(before), F.lit(0)).cast("bigint").alias("byte_index"))
    size, font = F.lit(None).cast("double"), F.lit(None).cast("string")
    for tag, s, f in TAGS:
        size, font = F.when(F.col("tag") == tag, s).otherwise(size), F.when(F.col("tag") == tag, f).otherwise(font)
    return flat.where("at > 0").select("doc", "byte_index", F.floor(F.col("byte_index") / PAGE_BYTES).cast("bigint").alias("page_number"), size.alias("font_size"), font.alias("font_name"))


def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, text, length in bytes, page_count) of each page."""
    size = F.octet_length("html").cast("bigint")
    return read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc"), F.col("html").alias("text"), size.alias("n_bytes"), (F.floor(size / PAGE_BYTES) + 1).cast("bigint").alias("page_count"))


MARKERS = """pieces AS (SELECT page_id AS doc, unnest(string_split(regexp_replace(html, '<(title|h1|p|b)(>|\\s[^>]*>)', chr(1) || '\\0', 'g'), chr(1))) AS piece,
    generate_subscripts(string_split(regexp_replace(html, '<(title|h1|p|b)(>|\\s[^>]*>)', chr(1) || '\\0', 'g'), chr(1)), 1) AS pos FROM pages),
placed AS (SELECT doc, pos, regexp_extract(piece, '^<(title|h1|p|b)', 1) AS tag, CAST(coalesce(sum(octet_length(encode(piece))) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_index FROM pieces),
markers AS (SELECT doc, byte_index, byte_index // 2000 AS page_number, CASE tag WHEN 'title' THEN 24.0 WHEN 'h1' THEN 18.0 ELSE 10.0 END::DOUBLE AS font_size, CASE tag WHEN 'p' THEN 'CMR' ELSE 'CMBX' END AS font_name FROM placed WHERE pos > 1),
paged AS (SELECT page_id AS doc, html AS text, CAST(octet_length(encode(html)) AS BIGINT) AS n_bytes, CAST(octet_length(encode(html)) // 2000 + 1 AS BIGINT) AS page_count FROM pages)"""


def vectors_with_zeros(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as (id, vector, text), and a zero vector for each label; the least label's has an empty text."""
    rows = read(spark, sf_dir, "embeddings")
    own = rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.concat(F.lit("text "), F.col("vec_id").cast("string")).alias("text"))
    wide = rows.groupBy("label").agg(F.max(F.size("embedding")).alias("n"))
    zero = wide.select((-1 - F.col("label")).cast("bigint").alias("id"), F.array_repeat(F.lit(0.0).cast("float"), F.col("n")).alias("vector"), F.when(F.col("label") == 0, "").otherwise(F.concat(F.lit("zero "), F.col("label").cast("string"))).alias("text"))
    return own.unionByName(zero)


VECTORS = """vec0 AS (SELECT vec_id AS id, CAST(embedding AS FLOAT[]) AS vector, 'text ' || CAST(vec_id AS VARCHAR) AS text FROM embeddings
  UNION ALL SELECT CAST(-1 - label AS BIGINT), list_transform(range(max(len(embedding))), lambda i: CAST(0 AS FLOAT)), CASE WHEN label = 0 THEN '' ELSE 'zero ' || CAST(label AS VARCHAR) END FROM embeddings GROUP BY label)"""
