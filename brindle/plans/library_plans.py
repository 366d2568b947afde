"""Library and store: queries S1 to S6, S12, S13, F1 to F4, F6, J1 to J3, J8, W1, G1, G2, G8, G11, G12, D1, L4, V4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators import health, library
from brindle.operators.text_index import TextIndex
from brindle.plans.catalog import query
from brindle.session import scratch_dir
from brindle.sources import library_files, views
from brindle.sources.store import Store, replay, stage
from brindle.sources.views import LIB, STORE, VECTORS

#: The parts as a library's attribute tables: name, brand and type are fields; every part has a file of either type.
EAV = """parts AS (SELECT p_partkey AS k, p_name, p_brand, p_type FROM part),
items AS (SELECT k AS itemID, 'K' || k AS key, 1 + k % 4 AS itemTypeID FROM parts UNION ALL SELECT -k, 'F' || k, 9 FROM parts),
facts AS (SELECT k, unnest([1, 2, 3]) AS fieldID, unnest([p_name, p_brand, p_type]) AS value FROM parts),
files AS (SELECT -k AS itemID, k AS parentItemID, 'storage:' || p_name || '.pdf' AS path, CASE WHEN k % 5 = 0 THEN 'text/html' ELSE 'application/pdf' END AS contentType FROM parts)"""
TYPES = ["book", "journalArticle", "preprint"]
ALL_TYPES = [*TYPES, "webpage"]


def attribute_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    part = views.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_name", "p_brand", "p_type")
    key = F.col("k").cast("string")
    own = part.select(F.col("k").alias("itemID"), F.concat(F.lit("K"), key).alias("key"), (1 + F.pmod("k", F.lit(4))).alias("itemTypeID"))
    files = part.select((-F.col("k")).alias("itemID"), F.concat(F.lit("F"), key).alias("key"), F.lit(9).cast("bigint").alias("itemTypeID"))
    facts = part.select("k", F.expr("stack(3, 1, p_name, 2, p_brand, 3, p_type) as (fieldID, value)"))
    value_id = F.concat("k", F.lit("-"), "fieldID")
    return {
        "items": own.unionByName(files),
        "itemData": facts.select(F.col("k").alias("itemID"), "fieldID", value_id.alias("valueID")),
        "itemDataValues": facts.select(value_id.alias("valueID"), "value"),
        "fields": spark.createDataFrame([(1, "title"), (2, "publisher"), (3, "series")], "fieldID int, fieldName string"),
        "itemTypes": spark.createDataFrame(list(enumerate(ALL_TYPES, 1)), "itemTypeID bigint, typeName string"),
        "itemAttachments": part.select((-F.col("k")).alias("itemID"), F.col("k").alias("parentItemID"), F.concat(F.lit("storage:"), "p_name", F.lit(".pdf")).alias("path"), F.when(F.pmod("k", F.lit(5)) == 0, "text/html").otherwise("application/pdf").alias("contentType")),
    }


FOUND = f"WITH {EAV}, found AS (SELECT DISTINCT i.key, f.value, a.path, x.key AS file_key FROM items i JOIN facts f ON f.k = i.itemID AND f.fieldID = 1 JOIN files a ON a.parentItemID = i.itemID AND a.contentType = 'application/pdf' JOIN items x ON x.itemID = a.itemID WHERE i.itemTypeID IN (1, 2, 3))"


@query("q_library_items", FOUND + " SELECT * FROM found")
def library_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.items(attribute_tables(spark, sf_dir), TYPES)


@query("q_library_files", FOUND + " SELECT * FROM found")
def library_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same items, out of library files that tasks wrote; the filters of field and type are SQLite's."""
    path = scratch_dir(spark) + "/library"
    library_files.write_library(attribute_tables(spark, sf_dir), path)
    return library.items(library_files.library_tables(spark, path)[0], TYPES)


@query("q_distinct_items", f"WITH {LIB} SELECT DISTINCT title, lang, source FROM lib")
def distinct_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.library(spark, sf_dir).select("title", "lang", "source").distinct()


@query("q_page", FOUND + " SELECT * FROM found ORDER BY key OFFSET 20 LIMIT 100")
def page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.page(library_items(spark, sf_dir), "key", limit=100, offset=20)


@query("q_attachment_path", "SELECT page_id, CASE WHEN instr(url, ':') > 0 THEN regexp_replace(url, '^[^:]*:', '') ELSE url END AS rest, 'root/storage/' || CAST(page_id AS VARCHAR) || '/' || CASE WHEN instr(url, ':') > 0 THEN regexp_replace(url, '^[^:]*:', '') ELSE url END AS path FROM pages")
def attachment_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = T.after_scheme(F.col("url"))
    return views.read(spark, sf_dir, "pages").select("page_id", rest.alias("rest"), F.concat_ws("/", F.lit("root/storage"), F.col("page_id").cast("string"), rest).alias("path"))


@query("q_scan_project", f"WITH {LIB} SELECT library_key, title, file_path FROM lib")
def scan_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.library(spark, sf_dir).select("library_key", "title", "file_path")


HTML_TEXT = "trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))"
EXTRACTED = f"extracted AS (SELECT page_id, CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN 'bad_path' WHEN url LIKE '%.pdf' THEN 'not_html' WHEN html IS NULL OR instr(html, '<body') = 0 THEN 'error' ELSE 'ok' END AS status, {HTML_TEXT} AS t FROM pages)"


@query("q_extract", f"WITH {EXTRACTED} SELECT page_id, status, CASE WHEN status = 'ok' THEN md5(t) END AS text_md5 FROM extracted")
def extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.extracted(views.read(spark, sf_dir, "pages"), "page_id", "url", "html").select("page_id", "status", F.md5("text").alias("text_md5"))


@query("q_ingest_report", f"WITH {EXTRACTED} SELECT status, count(*) AS n FROM extracted GROUP BY 1")
def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.ingest_report(library.extracted(views.read(spark, sf_dir, "pages"), "page_id", "url", "html"))


@query("q_lookup_key", f"WITH {LIB} SELECT library_key, title, file_path FROM lib WHERE library_key = '42'")
def lookup_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.lookup(views.library(spark, sf_dir), "library_key", "42", "doc_id").select("library_key", "title", "file_path")


@query("q_lookup_many", f"WITH {LIB} SELECT library_key, title FROM lib WHERE library_key IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)")
def lookup_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = views.read(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("library_key"))
    return library.lookup_many(views.library(spark, sf_dir), keys, "library_key").select("library_key", "title")


@query("q_nonblank", "SELECT doc_id, line, n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, length(text) AS n FROM documents) WHERE regexp_matches(line, '\\S')")
def nonblank(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = views.read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"), F.char_length("text").cast("bigint").alias("n"))
    return lines.where(F.rlike("line", F.lit("\\S")))


@query("q_ext_filter", f"WITH {LIB} SELECT library_key, file_path FROM lib WHERE lower(split_part(file_path, '.', -1)) = 'pdf'")
def ext_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.library(spark, sf_dir).where(T.extension(F.col("file_path")) == "pdf").select("library_key", "file_path")


@query("q_new_items", f"WITH {STORE} SELECT i.library_key, i.title FROM incoming i WHERE NOT EXISTS (SELECT 1 FROM store s WHERE s.library_key = i.library_key AND s.title = i.title)")
def new_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.new_items(views.incoming(spark, sf_dir), views.stored(spark, sf_dir)).select("library_key", "title")


@query("q_insert_merge", f"WITH {STORE} SELECT library_key, title, lang FROM store UNION ALL SELECT library_key, title, lang FROM incoming WHERE library_key NOT IN (SELECT library_key FROM store)")
def insert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.insert_merge(views.stored(spark, sf_dir), views.incoming(spark, sf_dir), "library_key", "doc_id").select("library_key", "title", "lang")


@query("q_delete_keys", f"WITH {LIB} SELECT library_key, title FROM lib WHERE library_key NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)")
def delete_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = views.read(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("library_key"))
    return library.delete_keys(views.library(spark, sf_dir), keys, "library_key").select("library_key", "title")


@query("q_dedup_keep_first", f"WITH {LIB}, ranked AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY doc_id) AS rn FROM lib) SELECT library_key, title FROM ranked WHERE rn = 1")
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.drop_duplicates_by_key(views.library(spark, sf_dir), "title", "library_key", "doc_id").select("library_key", "title")


@query("q_dup_counts", f"WITH {LIB} SELECT count(*) - count(DISTINCT title) AS n_removed FROM lib")
def dup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.duplicates_removed(views.library(spark, sf_dir), "title")


def creators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("place"), F.col("l_returnflag").alias("last_name"), F.col("l_linestatus").alias("first_name"))


AUTHORS = "authors AS (SELECT l_orderkey AS item, list(concat_ws(', ', l_returnflag, l_linestatus) ORDER BY l_linenumber, concat_ws(', ', l_returnflag, l_linestatus)) AS a FROM lineitem GROUP BY 1)"


@query("q_authors", f"WITH {AUTHORS} SELECT item, array_to_string(a, '; ') AS authors FROM authors")
def authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.authors(creators(spark, sf_dir)).select("item", F.array_join("authors", "; ").alias("authors"))


@query("q_enrich_authors", f"WITH {AUTHORS} SELECT o_orderkey, o_orderpriority, coalesce(array_to_string(a, ', '), 'Unknown') AS authors FROM orders LEFT JOIN authors ON item = o_orderkey")
def enrich_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = views.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    known = library.authors(creators(spark, sf_dir), hits.select(F.col("o_orderkey").alias("item"))).withColumnRenamed("item", "o_orderkey")
    return hits.join(known, "o_orderkey", "left").select("o_orderkey", "o_orderpriority", F.coalesce(F.array_join("authors", ", "), F.lit("Unknown")).alias("authors"))


@query("q_zero_vectors", f"WITH {VECTORS} SELECT id, text FROM vec0 WHERE coalesce(list_sum(list_transform(vector, lambda x: CAST(x AS DOUBLE) * x)), 0) <= 1e-8")
def zero_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.zero_vectors(views.vectors_with_zeros(spark, sf_dir)).select("id", "text")


@query("q_dim_check", f"WITH {VECTORS} SELECT id, len(vector) AS n FROM vec0 WHERE vector IS NULL OR len(vector) <> 64")
def dim_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.wrong_dimension(views.vectors_with_zeros(spark, sf_dir), 64).select("id", F.size("vector").cast("bigint").alias("n"))


CHECKED = f"{VECTORS}, checked AS (SELECT count(*) AS n_rows, sum(CASE WHEN list_sum(list_transform(vector, lambda x: CAST(x AS DOUBLE) * x)) <= 1e-8 THEN 1 ELSE 0 END)::BIGINT AS n_zero, sum(CASE WHEN len(vector) <> 64 THEN 1 ELSE 0 END)::BIGINT AS n_wrong, sum(CASE WHEN text = '' THEN 1 ELSE 0 END)::BIGINT AS n_empty FROM vec0)"


def vector_store(spark: SparkSession, sf_dir: str) -> tuple[Store, dict[str, str]]:
    """A store of vectors, and the folders of its indexes, of which one is there."""
    path = scratch_dir(spark)
    store = Store(spark, f"{path}/store")
    store.commit(views.vectors_with_zeros(spark, sf_dir))
    TextIndex(spark, f"{path}/text", "id").create(store.read("id", "text"), "text")
    return store, {"text": f"{path}/text", "vector": f"{path}/vector"}


@query("q_health", f"WITH {CHECKED} SELECT true AS directory_exists, true AS has_bytes, true AS accessible, checked.*, 'text' AS indexes, 1 AS stored_version, 1 AS live_version, 0 AS n_errors FROM checked")
def health_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, indexes = vector_store(spark, sf_dir)
    found = health.report(store, 64, indexes)
    return found.select("directory_exists", (F.col("n_bytes") > 0).alias("has_bytes"), "accessible", "n_rows", "n_zero", "n_wrong", "n_empty", F.array_join("indexes", ",").alias("indexes"), "stored_version", "live_version", F.size("errors").alias("n_errors"))


@query("q_doctor", f"WITH {CHECKED} SELECT 'zero vectors' AS symptom, 'run a repair' AS help FROM checked WHERE n_zero > 0 UNION ALL SELECT 'empty store', 'run an ingest' FROM checked WHERE n_rows = 0 UNION ALL SELECT 'no index', 'build an index' FROM checked WHERE n_rows > 10000 UNION ALL SELECT 'vectors of another dimension', 'embed again' FROM checked WHERE n_wrong > 0")
def doctor(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, _ = vector_store(spark, sf_dir)
    return health.doctor(health.report(store, 64))


@query("q_store_stats", f"WITH {STORE} SELECT (SELECT count(*) FROM store) + (SELECT count(*) FROM incoming WHERE library_key NOT IN (SELECT library_key FROM store)) AS n_rows, 2 AS version, 'hashed' AS provider, 'bag-64' AS model")
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, scratch_dir(spark))
    store.commit(views.stored(spark, sf_dir))
    store.insert(views.incoming(spark, sf_dir), "library_key", "doc_id")
    return store.stats()


@query("q_stage_replay", f"WITH {STORE} SELECT library_key, title FROM store UNION ALL SELECT library_key, title FROM incoming WHERE library_key NOT IN (SELECT library_key FROM store)")
def stage_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch that is staged and replayed twice is stored once; what is staged goes when it is stored."""
    path = scratch_dir(spark)
    store = Store(spark, f"{path}/store")
    store.commit(views.stored(spark, sf_dir))
    for _ in range(2):
        stage(views.incoming(spark, sf_dir), f"{path}/staged")
        replay(store, f"{path}/staged", "library_key", "doc_id")
    return store.read("library_key", "title")


@query("q_versioned_store", f"WITH {STORE} SELECT library_key, title FROM store WHERE library_key NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)")
def versioned_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, scratch_dir(spark))
    store.commit(views.stored(spark, sf_dir))
    store.delete(views.read(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("library_key")), "library_key")
    return store.read("library_key", "title")
