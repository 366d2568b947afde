"""Sections and chunks: queries W3 to W9, J10, C1 to C7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators import chunking, sections
from brindle.plans.catalog import query
from brindle.sources import views
from brindle.sources.views import LIB, MARKERS

BODY = """runs AS (SELECT doc, page_number, font_size, byte_index, lead(byte_index) OVER (PARTITION BY doc, page_number ORDER BY byte_index) - byte_index AS span FROM markers),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page_number, span DESC, byte_index DESC) AS rn FROM runs WHERE span IS NOT NULL),
body AS (SELECT doc, page_number AS body_page, font_size AS body_size FROM ranked WHERE rn = 1)"""
HEADS = BODY + """, heads AS (SELECT m.doc, byte_index, page_number, font_size FROM markers m JOIN body b ON m.doc = b.doc
  WHERE page_number >= body_page AND (font_size > body_size OR (font_size = body_size AND (font_name LIKE '%BX%' OR font_name LIKE '%B'))))"""
LEVELS = HEADS + """, levels AS (SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY doc ORDER BY font_size DESC) - 1 AS level FROM heads) WHERE level < 4),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY byte_index) - 1 AS section FROM levels)"""
SECTIONS = LEVELS + """, sections AS (SELECT n.*, (SELECT max(p.section) FROM numbered p WHERE p.doc = n.doc AND p.section < n.section AND p.level < n.level) AS parent FROM numbered n)"""
SPANS = SECTIONS + """, spans AS (SELECT s.*, coalesce(lead(byte_index) OVER w, n_bytes) AS end_byte, CASE WHEN lead(page_number) OVER w IS NULL THEN page_count - 1 ELSE greatest(lead(page_number) OVER w - 1, 0) END AS page_end
  FROM sections s JOIN paged p ON s.doc = p.doc WINDOW w AS (PARTITION BY s.doc ORDER BY section))"""
BUDGET = 2048
#: Sections cut as bytes: hexadecimal digits, two a byte.
BODIES = SPANS + f""", bodies AS (SELECT s.doc, section, byte_index, page_number, page_end, decode(unhex(substr(hex(encode(text)), CAST(2 * byte_index + 1 AS BIGINT), CAST(2 * (end_byte - byte_index) AS BIGINT)))) AS body FROM spans s JOIN paged p ON s.doc = p.doc),
cut AS (SELECT doc, section, byte_index, page_number, page_end, pos, substr(body, pos * {BUDGET} + 1, {BUDGET}) AS content FROM (SELECT *, unnest(range(CAST(ceil(length(body) / {BUDGET}) AS BIGINT))) AS pos FROM bodies)),
chunks AS (SELECT doc, section, row_number() OVER (PARTITION BY doc ORDER BY section, pos) AS chunk_id, count(*) OVER (PARTITION BY doc) AS chunk_count, content,
  byte_index + sum(octet_length(encode(content))) OVER (PARTITION BY doc, section ORDER BY pos) AS byte_end, page_number + 1 AS page_start, greatest(page_number + 1, page_end + 1) AS page_end FROM cut)"""


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.sections_of(views.markers(spark, sf_dir))


def chunks(spark: SparkSession, sf_dir: str, size: int = BUDGET) -> DataFrame:
    docs = views.paged(spark, sf_dir)
    return chunking.by_sections(sections.with_spans(found(spark, sf_dir), docs), docs, size)


@query("q_body_font", f"WITH {MARKERS}, {BODY} SELECT doc, body_page, body_size FROM body")
def body_font(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.body_font(views.markers(spark, sf_dir))


@query("q_heading_filter", f"WITH {MARKERS}, {HEADS} SELECT doc, byte_index, page_number, font_size FROM heads")
def heading_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.headings(views.markers(spark, sf_dir))


@query("q_heading_level", f"WITH {MARKERS}, {LEVELS} SELECT doc, byte_index, level FROM levels")
def heading_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.heading_levels(sections.headings(views.markers(spark, sf_dir))).select("doc", "byte_index", "level")


@query("q_section_parent", f"WITH {MARKERS}, {SECTIONS} SELECT doc, section, level, parent FROM sections")
def section_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).select("doc", "section", "level", "parent")


@query("q_section_spans", f"WITH {MARKERS}, {SPANS} SELECT doc, section, byte_index, end_byte, page_number, page_end FROM spans")
def section_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.with_spans(found(spark, sf_dir), views.paged(spark, sf_dir)).select("doc", "section", "byte_index", "end_byte", "page_number", "page_end")


@query("q_chunk_sections", f"WITH {MARKERS}, {BODIES} SELECT doc, section, chunk_id, md5(content) AS content_md5, length(content) AS n_chars FROM chunks")
def chunk_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("doc", "section", "chunk_id", F.md5("content").alias("content_md5"), F.char_length("content").alias("n_chars"))


@query("q_chunk_numbering", f"WITH {MARKERS}, {BODIES} SELECT doc, section, chunk_id, chunk_count, page_start, page_end FROM chunks")
def chunk_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("doc", "section", "chunk_id", "chunk_count", "page_start", "page_end")


@query("q_chunk_bytes", f"WITH {MARKERS}, {BODIES} SELECT doc, chunk_id, CAST(byte_end - octet_length(encode(content)) AS BIGINT) AS byte_start, CAST(byte_end AS BIGINT) AS byte_end FROM chunks")
def chunk_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("doc", "chunk_id", "byte_start", "byte_end")


@query("q_chunk_whole", f"WITH {LIB} SELECT library_key, 1 AS chunk_id, 1 AS chunk_count, md5(text) AS content_md5, 0 AS byte_start, octet_length(encode(text)) AS byte_end FROM lib")
def chunk_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.whole(views.library(spark, sf_dir), "library_key", "text").withColumn("content_md5", F.md5("content")).drop("content")


FIXED = """, cut AS (SELECT library_key, pos + 1 AS chunk_id, substr(text, pos * {n} + 1, {n}) AS content, CAST(ceil(length(text) / {n}) AS BIGINT) AS chunk_count FROM (SELECT *, unnest(range(CAST(ceil(length(text) / {n}) AS BIGINT))) AS pos FROM lib))"""


@query("q_chunk_fixed", f"WITH {LIB}{FIXED.format(n=BUDGET)} SELECT library_key, chunk_id, chunk_count, md5(content) AS content_md5, CAST(sum(octet_length(encode(content))) OVER (PARTITION BY library_key ORDER BY chunk_id) AS BIGINT) AS byte_end FROM cut")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fixed(views.library(spark, sf_dir), "library_key", "text", BUDGET).select("library_key", "chunk_id", "chunk_count", F.md5("content").alias("content_md5"), "byte_end")


STRATEGY = ", ".join(f"('{p}', {'NULL' if n is None else n})" for p, n in chunking.STRATEGIES)


@query(
    "q_chunk_strategy",
    f"""WITH {MARKERS}, {SPANS}, strategies(provider, budget) AS (VALUES {STRATEGY}),
  sized AS (SELECT s.doc, length(decode(unhex(substr(hex(encode(text)), CAST(2 * byte_index + 1 AS BIGINT), CAST(2 * (end_byte - byte_index) AS BIGINT))))) AS n, end_byte - byte_index AS n_bytes FROM spans s JOIN paged p ON s.doc = p.doc)
  SELECT provider, doc, sum(ceil(n / budget))::BIGINT AS n_chunks, sum(ceil(n / budget))::BIGINT AS chunk_count, sum(n_bytes)::BIGINT AS n_bytes FROM sized CROSS JOIN strategies WHERE budget IS NOT NULL AND n > 0 GROUP BY provider, doc
  UNION ALL SELECT provider, doc, 1, 1, n_bytes FROM paged CROSS JOIN strategies WHERE budget IS NULL""",
)
def chunk_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page cut under each provider's strategy."""
    docs = views.paged(spark, sf_dir)
    cut = chunking.by_strategies(sections.with_spans(found(spark, sf_dir), docs), docs)
    return cut.groupBy("provider", "doc").agg(F.count("*").alias("n_chunks"), F.max("chunk_count").cast("bigint").alias("chunk_count"), F.sum(F.octet_length("content")).cast("bigint").alias("n_bytes"))


POSITIONS = """, positions AS (SELECT doc, byte_index + 40 AS position FROM markers UNION ALL SELECT page_id, 0 FROM pages)"""


@query(
    "q_chunk_section",
    f"""WITH {MARKERS}, {SECTIONS}{POSITIONS} SELECT p.doc, p.position, coalesce((SELECT max(s.section) FROM sections s WHERE s.doc = p.doc AND s.byte_index <= p.position), 0) AS section
  FROM positions p WHERE p.doc IN (SELECT doc FROM sections)""",
)
def chunk_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = views.markers(spark, sf_dir).select("doc", (F.col("byte_index") + 40).alias("position"))
    places = places.unionByName(views.paged(spark, sf_dir).select("doc", F.lit(0).cast("bigint").alias("position")))
    return sections.section_of_positions(places, found(spark, sf_dir))


#: Escapes put into texts: every line feed becomes one of the nine, by its line's length.
ESCAPED = "replace(replace(text, '. ', '.\\\\050'), chr(10), '\\\\002')"
REPAIRED = "t"
for _code, _char in T.ESCAPES:
    REPAIRED = f"replace({REPAIRED}, '{_code}', '{_char}')"


@query("q_ligature_repair", f"WITH escaped AS (SELECT doc_id, replace(replace(replace(text, '. ', '.\\050'), ', ', '\\051'), chr(10), '\\002') AS t FROM documents) SELECT doc_id, md5({REPAIRED}) AS text_md5 FROM escaped")
def ligature_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    escaped = F.replace(F.replace(F.replace(F.col("text"), F.lit(". "), F.lit(".\\050")), F.lit(", "), F.lit("\\051")), F.lit("\n"), F.lit("\\002"))
    return views.read(spark, sf_dir, "documents").select("doc_id", F.md5(T.repair_escapes(escaped)).alias("text_md5"))


@query(
    "q_marker_shift",
    f"""WITH {MARKERS}, escaped AS (SELECT m.doc, m.byte_index, encode(replace(p.text, 'the', '\\002')) AS raw FROM markers m JOIN paged p ON m.doc = p.doc),
  heads AS (SELECT doc, byte_index, decode(unhex(substr(hex(raw), 1, CAST(2 * byte_index AS BIGINT)))) AS t FROM (SELECT doc, least(byte_index, octet_length(raw)) AS byte_index, raw FROM escaped) WHERE try(decode(unhex(substr(hex(raw), 1, CAST(2 * byte_index AS BIGINT))))) IS NOT NULL)
  SELECT doc, byte_index, CAST(octet_length(encode({REPAIRED})) AS BIGINT) AS shifted FROM heads""",
)
def marker_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where markers stand after the repair: each escape before one moves it by its change of length."""
    docs = views.paged(spark, sf_dir).select("doc", F.replace(F.col("text"), F.lit("the"), F.lit("\\002")).alias("text"))
    marks = views.markers(spark, sf_dir).select("doc", "byte_index").join(docs, "doc")
    at = F.least(F.col("byte_index"), F.octet_length("text"))
    return T.shift_markers(marks.select("doc", at.alias("byte_index"), "text")).select("doc", "byte_index", "shifted")


INTRO = "CASE lang WHEN 'en' THEN substr(text, 1, 300) || ' INTRODUCTION ' || substr(text, 301) ELSE text END"


@query(
    "q_summary_cut",
    f"""WITH t AS (SELECT doc_id, lang, {INTRO} AS t FROM documents), p AS (SELECT doc_id, lang, t, octet_length(encode(t)) AS n, position('introduction' IN lower(regexp_replace(t, '[^\\x00-\\x7F]', '?', 'g'))) AS c FROM t),
  b AS (SELECT *, CASE WHEN c > 0 THEN octet_length(encode(substr(t, 1, c - 1))) END AS pos FROM p)
  SELECT doc_id, CAST(CASE WHEN pos <= 1000 THEN pos WHEN lang = 'de' THEN 400 WHEN n <= 1000 THEN n ELSE (SELECT max(octet_length(encode(substr(t, 1, k)))) FROM (SELECT unnest(range(200, 1001)) AS k) WHERE octet_length(encode(substr(t, 1, k))) <= 1000) END AS BIGINT) AS cut FROM b""",
)
def summary_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many bytes stand for a document: up to an introduction, which English ones get, or to the second section, which German ones have at 400."""
    text = F.when(F.col("lang") == "en", F.concat(F.substring("text", 1, 300), F.lit(" INTRODUCTION "), F.expr("substring(text, 301)"))).otherwise(F.col("text"))
    # The first two are too close to each other, the third counts.
    sections = F.when(F.col("lang") == "de", F.array(F.lit(50), F.lit(100), F.lit(400))).otherwise(F.array()).cast("array<bigint>")
    docs = views.read(spark, sf_dir, "documents").select("doc_id", text.alias("text"), sections.alias("sections"))
    return docs.select("doc_id", T.summary_end(F.col("text"), F.col("sections")).alias("cut"))


@query(
    "q_mentions",
    """WITH said AS (SELECT conv_id, turn, text || ' @paper.pdf see me@mail.example and @"two words.pdf" @"" @ @' || role || CASE WHEN turn % 2 = 0 THEN ' @"open ' || role ELSE ' x@"' END AS t FROM conversations),
  words AS (SELECT conv_id, turn, t, unnest(regexp_extract_all(t, '(?:^|[ \\t\\n\\x0b\\f\\r])@"([^"]*)"', 1)) AS name FROM said),
  bare AS (SELECT conv_id, turn, unnest(regexp_extract_all(regexp_replace(t, '(^|[ \\t\\n\\x0b\\f\\r])@"[^"]*"', '\\1', 'g'), '(?:^|[ \\t\\n\\x0b\\f\\r])@([^ \\t\\n\\x0b\\f\\r]+)', 1)) AS name FROM said)
  SELECT conv_id, turn, name, count(*) AS n FROM (SELECT conv_id, turn, name FROM words UNION ALL SELECT * FROM bare) WHERE name <> '' GROUP BY ALL""",
)
def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.when(F.pmod("turn", F.lit(2)) == 0, F.concat(F.lit(' @"open '), "role")).otherwise(F.lit(' x@"'))
    text = F.concat("text", F.lit(' @paper.pdf see me@mail.example and @"two words.pdf" @"" @ @'), "role", end)
    rows = views.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(T.mentions(text)).alias("name"))
    return rows.groupBy("conv_id", "turn", "name").agg(F.count("*").alias("n"))
