"""Batches and cache: queries S7 to S10, J4 to J7, G7, G10, D2, D3, C8, C9, C12, V6's hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators import batches
from brindle.plans.catalog import query
from brindle.session import scratch_dir
from brindle.sources import batch_files, views
from brindle.sources.views import BATCHES, CACHE, LIB, RESULTS

SEQ, PROVIDER, MODEL = 100, "openai", "model-de"


@query("q_content_hash", f"WITH {LIB} SELECT library_key, md5(text) AS hash FROM lib")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.library(spark, sf_dir).select("library_key", F.md5("text").alias("hash"))


@query("q_batch_request", f"WITH {LIB} SELECT library_key AS custom_id, md5(text) AS input_md5, 1 AS n_inputs FROM lib")
def batch_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request lines, written and parsed again."""
    path = scratch_dir(spark) + "/requests"
    batch_files.write_requests(views.library(spark, sf_dir), "library_key", "text", path)
    parsed = spark.read.schema("custom_id string, body struct<input: array<string>>").json(path)
    return parsed.select("custom_id", F.md5(F.col("body.input")[0]).alias("input_md5"), F.size("body.input").alias("n_inputs"))


@query("q_batch_results", "SELECT CAST(vec_id AS VARCHAR) AS id, CASE WHEN label % 2 = 0 THEN len(embedding) END AS n, CASE WHEN label % 2 = 1 THEN 'label ' || CAST(label AS VARCHAR) END AS error FROM embeddings")
def batch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result lines written from all embeddings, those of odd labels as failures, with a broken line each; then read."""
    odd = F.pmod("label", F.lit(2)) == 1
    body = F.struct(F.struct(F.array(F.struct("embedding")).alias("data")).alias("body"))
    line = F.to_json(F.struct(F.col("vec_id").cast("string").alias("custom_id"), F.when(~odd, body).alias("response"), F.when(odd, F.struct(F.concat(F.lit("label "), F.col("label").cast("string")).alias("message"))).alias("error")))
    path = scratch_dir(spark) + "/results"
    views.read(spark, sf_dir, "embeddings").select(F.explode(F.array(line, F.lit('{"custom_id": '))).alias("line")).write.text(path)
    good, bad = batch_files.read_results(spark, path)
    return good.select("id", F.size("embedding").alias("n"), F.lit(None).cast("string").alias("error")).unionByName(bad.select("id", F.lit(None).cast("int").alias("n"), "error"))


@query("q_pending_batches", f"WITH {BATCHES} SELECT batch AS seq, 'batch-' || CAST(batch AS VARCHAR) AS batch_id, count(*) AS n_items FROM batches GROUP BY batch")
def pending_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of all batches, one folder each, written and read again."""
    path = scratch_dir(spark) + "/logs"
    batch_files.write_logs(views.batches(spark, sf_dir), path)
    return batch_files.pending(spark, path).groupBy("seq", "batch_id").agg(F.sum(F.size("items")).cast("bigint").alias("n_items")).orderBy(F.desc("seq"))


@query("q_next_seq", f"WITH {BATCHES} SELECT max(batch) + 1 AS next_seq FROM batches")
def next_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.next_sequence(views.batches(spark, sf_dir), "batch")


@query("q_reconcile_join", f"WITH {RESULTS} SELECT r.batch, r.id, b.title, b.hash FROM results r LEFT JOIN batches b ON b.batch = r.batch AND b.library_key = r.id")
def reconcile_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results with their items; those of unknown ids have nulls."""
    known, unknown = batches.known_results(views.results(spark, sf_dir), views.batches(spark, sf_dir))
    none = F.lit(None).cast("string")
    return known.select("batch", "id", "title", "hash").unionByName(unknown.select("batch", "id", none.alias("title"), none.alias("hash")))


@query("q_cache_filter", f"WITH {CACHE} SELECT library_key, hash FROM batches b WHERE NOT EXISTS (SELECT 1 FROM cache c WHERE c.hash = b.hash AND c.provider = b.provider AND c.model = b.model)")
def cache_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.uncached(views.batches(spark, sf_dir), views.hash_cache(spark, sf_dir)).select("library_key", "hash")


@query("q_pending_overlap", f"WITH {BATCHES} SELECT n.library_key, EXISTS (SELECT 1 FROM batches p WHERE p.lang IN ('en', 'de') AND p.hash = n.hash AND p.provider = n.provider AND p.model = n.model) AS is_pending FROM batches n WHERE n.lang IN ('de', 'fr', 'es')")
def pending_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.batches(spark, sf_dir)
    return batches.split_pending(rows.where(F.col("lang").isin(*views.INCOMING)), rows.where(F.col("lang").isin(*views.STORED))).select("library_key", "is_pending")


@query(
    "q_subsumed_batches",
    f"""WITH {BATCHES}, new AS (SELECT DISTINCT hash FROM batches WHERE lang IN ('de', 'fr', 'es')), pending AS (SELECT DISTINCT batch * 4 + CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END AS batch, hash FROM batches)
  SELECT batch, count(*) AS n_keys FROM pending GROUP BY batch HAVING bool_and(hash IN (SELECT hash FROM new)) AND count(*) < (SELECT count(*) FROM new)""",
)
def subsumed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending batches here are of one source and language."""
    rows = views.batches(spark, sf_dir)
    number = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).when(F.col("lang") == "fr", 2).otherwise(3)
    return batches.subsumed(rows.withColumn("batch", F.col("batch") * 4 + number), rows.where(F.col("lang").isin(*views.INCOMING)))


@query(
    "q_batch_outcome",
    f"""WITH {RESULTS}, kept AS (SELECT * FROM results WHERE batch % 2 = 0 OR error IS NOT NULL OR id NOT LIKE 'unknown%'),
  sizes AS (SELECT batch, count(*) AS n_items FROM batches GROUP BY 1),
  done AS (SELECT batch, count(*) AS n_results, sum(CASE WHEN error IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS n_failed, coalesce((list(error ORDER BY id) FILTER (WHERE error IS NOT NULL))[1:3], []) AS errors FROM kept GROUP BY 1)
  SELECT batch, CASE WHEN n_items <> n_results THEN 'mismatch' WHEN n_failed = n_items THEN 'all failed' WHEN n_failed = 0 THEN 'all succeeded' ELSE 'partial' END AS outcome, n_failed, array_to_string(errors, '|') AS errors FROM sizes JOIN done USING (batch)""",
)
def batch_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of even number still hold the result of an unknown id, so that their counts differ."""
    rows = views.results(spark, sf_dir)
    rows = rows.where((F.pmod("batch", F.lit(2)) == 0) | F.col("error").isNotNull() | ~F.col("id").startswith("unknown"))
    return batches.outcomes(rows, views.batches(spark, sf_dir)).select("batch", "outcome", "n_failed", F.array_join("errors", "|").alias("errors"))


MERGED = f"""WITH {CACHE}, batch AS (SELECT DISTINCT hash FROM batches WHERE lang IN ('de', 'es')), fresh AS (SELECT DISTINCT hash FROM batches WHERE lang = 'es'),
  merged AS (SELECT coalesce(c.hash, f.hash) AS hash, CASE WHEN f.hash IS NOT NULL THEN '{PROVIDER}' ELSE c.provider END AS provider, CASE WHEN f.hash IS NOT NULL THEN '{MODEL}' ELSE c.model END AS model,
    CASE WHEN f.hash IS NOT NULL THEN {SEQ} WHEN c.hash IN (SELECT hash FROM batch) AND c.provider = '{PROVIDER}' AND c.model = '{MODEL}' AND c.seq < {SEQ} THEN {SEQ} ELSE c.seq END AS seq FROM cache c FULL OUTER JOIN fresh f ON c.hash = f.hash)"""


@query("q_hash_cache_merge", MERGED + " SELECT hash, provider, model, CAST(seq AS BIGINT) AS seq FROM merged")
def hash_cache_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of German and Spanish items of which the Spanish are new to the store."""
    rows = views.batches(spark, sf_dir)
    return batches.merged_cache(views.hash_cache(spark, sf_dir), rows.where(F.col("lang").isin("de", "es")), rows.where("lang = 'es'"), SEQ, PROVIDER, MODEL)


@query("q_cache_union", f"WITH {CACHE}, parts AS (SELECT 0 AS o, * FROM cache UNION ALL SELECT 1, hash, '{PROVIDER}', min(model), {SEQ} FROM batches WHERE lang = 'de' GROUP BY hash) SELECT hash, provider, model, CAST(seq AS BIGINT) AS seq FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY o DESC) AS rn FROM parts) WHERE rn = 1")
def cache_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = views.batches(spark, sf_dir).where("lang = 'de'").groupBy("hash").agg(F.min("model").alias("model")).select("hash", F.lit(PROVIDER).alias("provider"), "model", F.lit(SEQ).cast("bigint").alias("seq"))
    return batches.latest([views.hash_cache(spark, sf_dir), new], "hash")


@query("q_retry_set", f"WITH {RESULTS} SELECT batch, library_key, title FROM batches b WHERE EXISTS (SELECT 1 FROM results r WHERE r.batch = b.batch AND r.id = b.library_key AND r.error IS NOT NULL)")
def retry_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.retry_set(views.batches(spark, sf_dir), views.results(spark, sf_dir)).select("batch", "library_key", "title")


@query("q_failed_preview", "SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')[1:10], ' ') AS preview FROM documents")
def failed_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.read(spark, sf_dir, "documents").select("doc_id", T.first_words(F.col("text")).alias("preview"))


NOW = "2024-06-15 00:00:00"


@query("q_batch_age", f"SELECT event_id, CASE WHEN epoch(TIMESTAMP '{NOW}') >= floor(epoch(ts)) THEN CAST(epoch(TIMESTAMP '{NOW}') - floor(epoch(ts)) AS BIGINT) END AS age FROM events")
def batch_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds up to a given now; unknown for what lies after it."""
    age = F.unix_timestamp(F.lit(NOW).cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))
    return views.read(spark, sf_dir, "events").select("event_id", F.when(age >= 0, age).alias("age"))
