"""Vectors and search: queries V1 to V13, W2, J9, J12, F5, F7, F8, L1, L2, G3, G6, T1."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions import vectors as V
from brindle.operators import chunking, health, library, models, neighbours, retrieval
from brindle.operators.text_index import TextIndex
from brindle.operators.vector_index import VectorIndex
from brindle.plans.catalog import query
from brindle.plans.chunk_plans import BUDGET, SPANS, chunks, found
from brindle.session import scratch_dir
from brindle.sources import views
from brindle.sources.files import kept
from brindle.sources.store import Store
from brindle.sources.views import LIB, MARKERS, VECTORS
from brindle.streaming.ingest import stream_ingest


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


def digit(k: int) -> str:
    return f"(instr('0123456789abcdef', substr(md5(w), {k}, 1)) - 1)"


def embedding(name: str, table: str, keys: str, text: str) -> str:
    return f"""{name}_counts AS (SELECT {keys}, ({digit(1)} * 256 + {digit(2)} * 16 + {digit(3)}) % 64 AS bucket, count(*) AS n FROM (SELECT {keys}, unnest({words(text)}) AS w FROM {table}) GROUP BY ALL),
{name} AS (SELECT {keys}, bucket, n, n / sqrt(sum(n * n) OVER (PARTITION BY {keys})) AS weight FROM {name}_counts)"""


QUERIES = "queries AS (SELECT item_id AS query, text AS query_text FROM benchmark), " + embedding("asked", "queries", "query", "query_text")
CUT = "cut AS (SELECT doc_id, pos + 1 AS chunk_id, substr(text, pos * 512 + 1, 512) AS content FROM (SELECT *, unnest(range(CAST(ceil(length(text) / 512) AS BIGINT))) AS pos FROM documents)), " + embedding("held", "cut", "doc_id, chunk_id", "content")
NEAR = f"""{QUERIES}, {CUT}, cosines AS (SELECT query, doc_id, chunk_id, sum(a.weight * h.weight) AS score FROM asked a JOIN held h USING (bucket) GROUP BY ALL),
near AS (SELECT * FROM (SELECT query, doc_id, row_number() OVER (PARTITION BY query ORDER BY round(max(score), 9) DESC, doc_id) AS rn FROM cosines GROUP BY query, doc_id) WHERE rn <= 10 AND doc_id IN (SELECT doc_id FROM documents WHERE regexp_matches(text, '\\S')))"""
BM25 = f"""terms AS (SELECT DISTINCT query, unnest({words('query_text')}) AS term FROM queries),
flat AS (SELECT doc_id, unnest({words('text')}) AS term FROM documents), lengths AS (SELECT doc_id, len({words('text')}) AS length FROM documents),
postings AS (SELECT term, doc_id, count(*) AS tf FROM flat WHERE term IN (SELECT term FROM terms) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM postings GROUP BY 1),
totals AS (SELECT count(*) AS n_docs, avg(length) AS avg_length FROM lengths),
gains AS (SELECT n.query, n.doc_id, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_length))) AS score FROM near n JOIN terms USING (query) JOIN postings p ON p.doc_id = n.doc_id AND p.term = terms.term JOIN df ON df.term = p.term JOIN lengths l ON l.doc_id = n.doc_id, totals GROUP BY ALL),
scored AS (SELECT n.query, n.doc_id, round(coalesce(score, 0), 6) AS score FROM near n LEFT JOIN gains USING (query, doc_id)),
hits AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM scored)"""
SEARCH = f"WITH {LIB}, {NEAR}, {BM25}"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("query_text"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.search(asked(spark, sf_dir), views.read(spark, sf_dir, "documents").select("doc_id", "text"))


def known_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with their document and query; the source stands for authors, which other than English items lack."""
    docs = views.library(spark, sf_dir).select("doc_id", "library_key", "title", "text", F.when(F.col("lang") == "en", F.col("source")).alias("authors"))
    return hits(spark, sf_dir).join(docs, "doc_id").join(asked(spark, sf_dir), "query")


AUTHORS = "CASE WHEN lang = 'en' THEN source END"


@query("q_search", SEARCH + f" SELECT query, h.doc_id, rank, score, 'Title: ' || title || chr(10) || 'Authors: ' || coalesce({AUTHORS}, 'Unknown') || chr(10) || 'Item ID: ' || library_key AS hit FROM hits h JOIN lib USING (doc_id)")
def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: documents for every benchmark passage, reranked and shown."""
    return known_hits(spark, sf_dir).select("query", "doc_id", "rank", "score", retrieval.hit_text(F.col("title"), F.col("authors"), F.col("library_key")).alias("hit"))


@query("q_search_kept", SEARCH + " SELECT query, doc_id, rank, score FROM hits")
def search_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents through kept indexes of chunks and words, to which a part of the documents came later."""
    docs = views.read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    index = retrieval.SearchIndex.at(spark, scratch_dir(spark))
    index.create(docs.where("lang <> 'fr'").select("doc_id", "text"), 64)
    index.sync(docs.select("doc_id", "text"))
    return retrieval.search(asked(spark, sf_dir), docs, index=index).select("query", "doc_id", "rank", "score")


@query("q_rerank", SEARCH + " SELECT query, doc_id, score, rank FROM hits")
def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir).select("query", "doc_id", "score", "rank")


@query("q_rerank_apply", SEARCH + ", indexed AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY doc_id) - 1 AS index FROM hits) SELECT query, index, doc_id, rank FROM indexed WHERE index < 8")
def rerank_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order over ten indices, of which only eight are candidates."""
    rows = hits(spark, sf_dir).withColumn("index", F.row_number().over(Window.partitionBy("query").orderBy("doc_id")) - 1)
    return retrieval.apply_order(rows.where("index < 8").select("query", "index", "doc_id"), rows.select("query", "index", "rank")).select("query", "index", "doc_id", "rank")


@query("q_hit_format", f"WITH {LIB} SELECT library_key, 'Title: ' || title || chr(10) || 'Authors: ' || coalesce({AUTHORS}, 'Unknown') || chr(10) || 'Item ID: ' || library_key AS hit FROM lib")
def hit_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.library(spark, sf_dir).select("library_key", retrieval.hit_text(F.col("title"), F.when(F.col("lang") == "en", F.col("source")), F.col("library_key")).alias("hit"))


PROMPT = f"'Question: ' || query_text || chr(10) || 'Title: ' || title || chr(10) || 'Authors: ' || coalesce({AUTHORS}, 'not known') || chr(10) || 'Quote what answers the question from this text:' || chr(10) || text"


@query("q_extraction_prompt", SEARCH + f" SELECT query, h.doc_id, md5({PROMPT}) AS prompt_md5 FROM hits h JOIN lib USING (doc_id) JOIN queries USING (query)")
def extraction_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.prompts(known_hits(spark, sf_dir)).select("query", "doc_id", F.md5("prompt").alias("prompt_md5"))


def echo(prompt: str) -> str:
    """The default generator: a template around the prompt's start."""
    return "Answer to: " + prompt[10:70]


@query(
    "q_generate_map",
    SEARCH + f""", prompts AS (SELECT query, h.doc_id, {PROMPT} AS p FROM hits h JOIN lib USING (doc_id) JOIN queries USING (query))
  SELECT query, doc_id, 'Answer to: ' || substr(p, 11, 60) AS answer, CAST((octet_length(encode(p)) + 3) // 4 + (octet_length(encode('Answer to: ' || substr(p, 11, 60))) + 3) // 4 AS BIGINT) AS tokens FROM prompts""",
)
def generate_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = retrieval.prompts(known_hits(spark, sf_dir)).select("query", "doc_id", "prompt")
    return models.generate_with(rows, "prompt", echo).select("query", "doc_id", "answer", "tokens")


@query("q_search_tokens", SEARCH + """, used AS (SELECT query, sum(octet_length(encode(text))) AS n FROM hits h JOIN lib USING (doc_id) GROUP BY 1), tokens AS (SELECT query, octet_length(encode(query_text)) AS e, octet_length(encode(query_text)) + coalesce(n, 0) AS r FROM queries LEFT JOIN used USING (query))
  SELECT query, CAST(e AS BIGINT) AS embedding_tokens, CAST(r AS BIGINT) AS rerank_tokens, CAST(e // 4 + r // 4 AS BIGINT) AS billed FROM tokens""")
def search_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.search_tokens(asked(spark, sf_dir), known_hits(spark, sf_dir))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each query's hits, with their similarity."""
    pairs = hits(spark, sf_dir).select("query", "doc_id")
    cut = chunking.fixed(views.read(spark, sf_dir, "documents"), "doc_id", "text", retrieval.CHUNK).select("doc_id", "chunk_id", "content")
    return retrieval.scored_passages(pairs, asked(spark, sf_dir), cut)


KEPT = """, marked AS (SELECT *, max(score >= {least}) OVER (PARTITION BY query, doc_id) AS hit, row_number() OVER (PARTITION BY query, doc_id ORDER BY score DESC, chunk_id) AS rk FROM passages),
kept AS (SELECT query, doc_id, chunk_id, score, CASE WHEN hit THEN row_number() OVER (PARTITION BY query, doc_id ORDER BY chunk_id) ELSE rk END AS position FROM marked WHERE score >= {least} OR (NOT hit AND rk <= 8)) SELECT * FROM kept"""


ALL_PASSAGES = SEARCH + ", passages AS (SELECT h.query, h.doc_id, cut.chunk_id, round(coalesce(c.score, 0), 6) AS score FROM hits h JOIN cut ON cut.doc_id = h.doc_id LEFT JOIN cosines c ON c.query = h.query AND c.doc_id = h.doc_id AND c.chunk_id = cut.chunk_id)"


@query("q_doc_passages_all", ALL_PASSAGES + KEPT.format(least=0.7))
def doc_passages_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.threshold_or_top(passages(spark, sf_dir), ["query", "doc_id"], "chunk_id")


@query("q_threshold_or_topk_all", ALL_PASSAGES + KEPT.format(least=0.85))
def threshold_or_topk_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.threshold_or_top(passages(spark, sf_dir), ["query", "doc_id"], "chunk_id", least=0.85)


@query("q_score_threshold_all", ALL_PASSAGES + " SELECT query, doc_id, chunk_id, score FROM passages WHERE score >= 0.7")
def score_threshold_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(spark, sf_dir).where(F.col("score") >= retrieval.LEAST_SCORE).orderBy("query", "doc_id", "chunk_id")


#: Chunks of pages by section, as vectors; an id holds the page and the chunk.
MADE = 1_000_000
PAGE_CHUNKS = (
    SPANS + f""", bodies AS (SELECT s.doc, section, byte_index, decode(unhex(substr(hex(encode(text)), CAST(2 * byte_index + 1 AS BIGINT), CAST(2 * (end_byte - byte_index) AS BIGINT)))) AS body FROM spans s JOIN paged p ON s.doc = p.doc),
parts AS (SELECT doc, section, pos, substr(body, pos * {BUDGET} + 1, {BUDGET}) AS content FROM (SELECT *, unnest(range(CAST(ceil(length(body) / {BUDGET}) AS BIGINT))) AS pos FROM bodies)),
made AS (SELECT doc, section, doc * {MADE} + row_number() OVER (PARTITION BY doc ORDER BY section, pos) AS id, content FROM parts), """
    + embedding("chunked", "made", "id", "content")
)

#: Pages for queries: the best ten by their best chunk; the chunks of these by similarity, kept by the threshold, and ordered by BM25 over all chunks.
PAGE_PASSAGES = (
    f"WITH {MARKERS}, {QUERIES}, {PAGE_CHUNKS}"
    + """, alike AS (SELECT query, id, sum(a.weight * c.weight) AS score FROM asked a JOIN chunked c USING (bucket) GROUP BY ALL),
pairs AS (SELECT query, doc FROM (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY round(max(score), 9) DESC, doc) AS rn FROM alike JOIN made USING (id) GROUP BY query, doc) WHERE rn <= 10),
extracted AS (SELECT page_id AS doc, CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN 'bad_path' WHEN url LIKE '%.pdf' THEN 'not_html' WHEN html IS NULL OR instr(html, '<body') = 0 THEN 'error' ELSE 'ok' END AS error FROM pages),
failed AS (SELECT doc, error FROM extracted WHERE error <> 'ok'),
passages AS (SELECT n.query, n.doc, n.doc AS doc_id, m.id, m.id AS chunk_id, m.section, round(coalesce(c.score, 0), 6) AS score FROM pairs n JOIN made m ON m.doc = n.doc LEFT JOIN alike c ON c.query = n.query AND c.id = m.id WHERE n.doc NOT IN (SELECT doc FROM failed))"""
)
PAGE_KEPT = """, marked AS (SELECT *, max(score >= {least}) OVER (PARTITION BY query, doc) AS hit, row_number() OVER (PARTITION BY query, doc ORDER BY score DESC, id) AS rk FROM passages),
kept AS (SELECT query, doc, id, section, score, CASE WHEN hit THEN row_number() OVER (PARTITION BY query, doc ORDER BY id) ELSE rk END AS position FROM marked WHERE score >= {least} OR (NOT hit AND rk <= 8))"""
RANKED = PAGE_PASSAGES + PAGE_KEPT.format(least=0.7) + f""", terms AS (SELECT DISTINCT query, unnest({words('query_text')}) AS term FROM queries),
flat AS (SELECT id, unnest({words('content')}) AS term FROM made), lengths AS (SELECT id, len({words('content')}) AS length FROM made),
postings AS (SELECT term, id, count(*) AS tf FROM flat WHERE term IN (SELECT term FROM terms) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM postings GROUP BY 1),
totals AS (SELECT count(*) AS n_docs, avg(length) AS avg_length FROM lengths),
gains AS (SELECT k.query, k.id, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_length))) AS gain FROM kept k JOIN terms USING (query) JOIN postings p ON p.id = k.id AND p.term = terms.term JOIN df ON df.term = p.term JOIN lengths l ON l.id = k.id, totals GROUP BY ALL),
reranked AS (SELECT k.query, k.doc, k.id, k.section, k.score, row_number() OVER (PARTITION BY k.query, k.doc ORDER BY round(coalesce(gain, 0), 6) DESC, k.id) AS position, CAST(NULL AS VARCHAR) AS error FROM kept k LEFT JOIN gains g ON g.query = k.query AND g.id = k.id)"""


@dataclass(frozen=True)
class Pages:
    """What the queries over pages share: the pages' chunks, which page is asked which query, and which pages cannot be taken apart."""

    asked: DataFrame
    chunks: DataFrame
    pairs: DataFrame
    failed: DataFrame

    def passages(self) -> DataFrame:
        return retrieval.passages(self.pairs, self.asked, self.chunks, self.failed)


def asked_pages(spark: SparkSession, sf_dir: str) -> Pages:
    """The best ten pages of each query by their best chunk. Those that extraction reports as failures are failures here."""
    held = kept(chunks(spark, sf_dir).select("doc", "section", (F.col("doc") * MADE + F.col("chunk_id")).alias("id"), "content"))
    own = asked(spark, sf_dir)
    near = neighbours.nearest(models.embed(own, ["query"], "query_text"), models.embed(held, ["doc"], "content").select(F.col("doc").alias("id"), "vector"), retrieval.TOP, "cosine")
    status = library.extracted(views.read(spark, sf_dir, "pages"), "page_id", "url", "html").select(F.col("page_id").alias("doc"), "status")
    failed = status.where("status <> 'ok'").select("doc", F.col("status").alias("error"))
    return Pages(own, held, kept(near.select("query", F.col("id").alias("doc"))), kept(failed))


def scored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = asked_pages(spark, sf_dir)
    sound = pages.pairs.join(pages.failed, "doc", "left_anti").select("query", F.col("doc").alias("doc_id"))
    cut = pages.chunks.select(F.col("doc").alias("doc_id"), F.col("id").alias("chunk_id"), "content")
    return retrieval.scored_passages(sound, pages.asked, cut).select("query", F.col("doc_id").alias("doc"), F.col("chunk_id").alias("id"), "score")


@query("q_score_threshold", PAGE_PASSAGES + " SELECT query, doc, id, score FROM passages WHERE score >= 0.7")
def score_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of sections of every page that a query is put to, near enough to it."""
    return scored_pages(spark, sf_dir).where(F.col("score") >= retrieval.LEAST_SCORE)


@query("q_threshold_or_topk", PAGE_PASSAGES + PAGE_KEPT.format(least=0.85) + " SELECT query, doc, id, score, position FROM kept")
def threshold_or_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.threshold_or_top(scored_pages(spark, sf_dir), ["query", "doc"], "id", least=0.85)


@query("q_doc_passages", RANKED + " SELECT * FROM reranked UNION ALL SELECT query, doc, NULL, NULL, NULL, NULL, error FROM pairs JOIN failed USING (doc)")
def doc_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections cut to chunks, those near the query or the best eight, reranked; documents that fail as rows."""
    return asked_pages(spark, sf_dir).passages()


#: Where the text of a passage first stands in its page, the section there, sections' shares, and what is meant by them.
MEANT = RANKED + """, stands AS (SELECT r.query, r.doc, r.id, octet_length(encode(substr(p.text, 1, CAST(instr(p.text, m.content) - 1 AS BIGINT)))) AS pos FROM reranked r JOIN made m ON m.id = r.id JOIN paged p ON p.doc = r.doc),
occurs AS (SELECT query, doc, id, coalesce((SELECT max(s.section) FROM sections s WHERE s.doc = stands.doc AND s.byte_index <= stands.pos), 0) AS section FROM stands),
tally AS (SELECT query, doc, section, count(*) AS n FROM occurs GROUP BY ALL), parts_of AS (SELECT *, n / sum(n) OVER (PARTITION BY query, doc) AS share FROM tally),
meant AS (SELECT DISTINCT h.query, h.doc, CASE WHEN share >= 0.25 AND s.parent IS NOT NULL THEN s.parent ELSE h.section END AS section FROM parts_of h JOIN sections s ON s.doc = h.doc AND s.section = h.section)"""


@query("q_section_histogram", MEANT + " SELECT query, doc, section, n, CAST(share AS DOUBLE) AS share FROM parts_of")
def section_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = asked_pages(spark, sf_dir)
    rows = retrieval.first_occurrences(pages.passages(), pages.chunks, views.paged(spark, sf_dir), found(spark, sf_dir))
    return retrieval.section_shares(rows)


@query(
    "q_hybrid_expand",
    MEANT + """ SELECT m.query, m.doc, m.section, s.byte_index AS "start", s.end_byte AS "end", md5(decode(unhex(substr(hex(encode(text)), CAST(2 * s.byte_index + 1 AS BIGINT), CAST(2 * (s.end_byte - s.byte_index) AS BIGINT))))) AS text_md5
  FROM meant m JOIN spans s ON s.doc = m.doc AND s.section = m.section JOIN paged p ON p.doc = m.doc""",
)
def hybrid_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages widened to sections, each from where its text first stands."""
    pages = asked_pages(spark, sf_dir)
    rows = retrieval.expanded(kept(pages.passages()), pages.chunks, views.paged(spark, sf_dir), kept(found(spark, sf_dir)))
    return rows.select("query", "doc", "section", "start", "end", F.md5("text").alias("text_md5"))


REFINE = "'Question: ' || query_text || chr(10) || 'What the document is about, perhaps: ' || substr(text, 1, 200) || chr(10) || 'Passages found in it:' || chr(10) || passages || chr(10) || 'Give the parts that answer the question, word for word, with ----- between them.' || chr(10)"


@query("q_refine_prompt", RANKED + f", joined AS (SELECT query, r.doc, string_agg(content, chr(10) || '-----' || chr(10) ORDER BY position) AS passages FROM reranked r JOIN made USING (id) GROUP BY ALL) SELECT query, j.doc, md5({REFINE}) AS prompt_md5 FROM joined j JOIN queries USING (query) JOIN paged p ON p.doc = j.doc")
def refine_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    summaries = views.paged(spark, sf_dir).select("doc", F.substring("text", 1, 200).alias("summary"))
    pages = asked_pages(spark, sf_dir)
    rows = retrieval.refine_prompts(pages.passages(), pages.asked, pages.chunks, summaries)
    return rows.select("query", "doc", F.md5("prompt").alias("prompt_md5"))


def quoting(prompt: str) -> str:
    """The default refiner: it gives back the passages of its prompt."""
    return prompt.split("\nPassages found in it:\n", 1)[1].rsplit("\nGive the parts that answer", 1)[0]


@query(
    "q_refine_answers",
    MEANT + f""", bodies_of AS (SELECT m.query, m.doc, m.section, decode(unhex(substr(hex(encode(text)), CAST(2 * s.byte_index + 1 AS BIGINT), CAST(2 * (s.end_byte - s.byte_index) AS BIGINT)))) AS body FROM meant m JOIN spans s ON s.doc = m.doc AND s.section = m.section JOIN paged p ON p.doc = m.doc),
answers AS (SELECT query, doc, string_split(string_agg(body, chr(10) || '-----' || chr(10) ORDER BY section), '-----') AS pieces FROM bodies_of GROUP BY ALL),
stripped AS (SELECT query, doc, list_filter(list_transform(pieces, lambda x: regexp_replace(x, '^{retrieval.WHITE}|{retrieval.WHITE}$', '', 'g')), lambda x: x <> '') AS pieces FROM answers)
SELECT query, doc, CAST(piece AS INTEGER) AS piece, md5(pieces[CAST(piece + 1 AS BIGINT)]) AS text_md5 FROM (SELECT *, unnest(range(len(pieces))) AS piece FROM stripped)""",
)
def refine_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widened sections put to a refiner, and its answers cut to pieces."""
    pages = asked_pages(spark, sf_dir)
    wide = retrieval.expanded(kept(pages.passages()), pages.chunks, views.paged(spark, sf_dir), kept(found(spark, sf_dir)))
    summaries = views.paged(spark, sf_dir).select("doc", F.substring("text", 1, 200).alias("summary"))
    return retrieval.refined(wide, pages.asked, summaries, quoting).select("query", "doc", "piece", F.md5("text").alias("text_md5"))


@query("q_embed", f"WITH {LIB}, {embedding('e', 'lib', 'library_key', 'text')} SELECT library_key, bucket, n, round(weight, 6) AS weight FROM e")
def embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.sparse_embeddings(views.library(spark, sf_dir), ["library_key"], "text").select("library_key", "bucket", "n", V.rounded(F.col("weight")).alias("weight"))


@query("q_embed_cache", f"WITH {LIB}, {embedding('e', 'lib', 'library_key', 'text')} SELECT library_key, count(*) AS n_set, round(max(weight), 6) AS most FROM e GROUP BY 1")
def embed_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = models.embed_distinct(views.library(spark, sf_dir), "library_key", "text")
    return rows.select("library_key", F.size(F.filter("vector", lambda x: x > 0)).cast("bigint").alias("n_set"), V.rounded(F.array_max("vector")).alias("most"))


@query("q_bm25_index", f"WITH flat AS (SELECT doc_id, unnest({words('text')}) AS term FROM documents), p AS (SELECT term, doc_id, count(*) AS tf FROM flat GROUP BY ALL) SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf, max(tf) AS most FROM p GROUP BY 1")
def bm25_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A kept text index; making it again does nothing. What is asked for is in the blocks' heads."""
    index = TextIndex(spark, scratch_dir(spark), "doc_id")
    docs = views.read(spark, sf_dir, "documents")
    if not index.create(docs, "text") or index.create(docs, "text"):
        raise RuntimeError("the index is made once")
    return index.rows().where("term is not null").groupBy("term").agg(F.sum("n").alias("df"), F.sum("total").alias("tf"), F.max("most").alias("most"))


#: The ten best documents of each query by BM25 over a table ``held`` of documents.
BEST = f"""terms AS (SELECT DISTINCT item_id AS query, unnest({words('text')}) AS term FROM benchmark),
flat AS (SELECT doc_id, unnest({words('text')}) AS term FROM held), lengths AS (SELECT doc_id, len({words('text')}) AS length FROM held),
postings AS (SELECT term, doc_id, count(*) AS tf FROM flat WHERE term IN (SELECT term FROM terms) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM postings GROUP BY 1),
totals AS (SELECT count(*) AS n_docs, avg(length) AS avg_length FROM lengths),
sums AS (SELECT query, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_length))), 6) AS score FROM terms JOIN postings p USING (term) JOIN df USING (term) JOIN lengths l USING (doc_id), totals GROUP BY ALL)
SELECT query, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM sums) WHERE rank <= 10"""


@query("q_bm25_search", f"WITH held AS (SELECT * FROM documents), {BEST}")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents of all by the kept index, which skips blocks that cannot matter."""
    index = TextIndex(spark, scratch_dir(spark), "doc_id")
    index.create(views.read(spark, sf_dir, "documents"), "text")
    return index.search(asked(spark, sf_dir), retrieval.TOP)


@query("q_bm25_updated", f"WITH held AS (SELECT * FROM documents WHERE lang <> 'de'), {BEST}")
def bm25_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Like q_bm25_search, over an index of English and German texts to which the others were added and from which the German ones went."""
    index = TextIndex(spark, scratch_dir(spark), "doc_id")
    docs = views.read(spark, sf_dir, "documents")
    index.create(docs.where("lang in ('en', 'de')"), "text")
    index.sync(docs.where("lang <> 'de'"), "text")
    return index.search(asked(spark, sf_dir), retrieval.TOP)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def some_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set of searches: every id that 20 divides."""
    return vectors(spark, sf_dir).where(F.pmod("id", F.lit(20)) == 0).withColumnRenamed("id", "query")


DOUBLES = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


@query("q_normalize", f"WITH {DOUBLES}, n AS (SELECT id, e, sqrt(list_inner_product(e, e)) AS norm FROM v) SELECT id, round(norm, 6) AS norm, round(e[1] / norm, 6) AS first, round(list_sum(list_transform(e, lambda x: abs(x / norm))), 6) AS total FROM n")
def normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select("id", V.norm(F.col("vector")).alias("norm"), V.normalized(F.col("vector")).alias("v"))
    return rows.select("id", F.round("norm", 6).alias("norm"), F.round(F.col("v")[0], 6).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + F.abs(x)), 6).alias("total"))


@query("q_cosine", f"WITH {DOUBLES} SELECT a.id, round(list_cosine_similarity(a.e, b.e), 6) AS cosine FROM v a JOIN v b ON b.id = a.id + 1")
def cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    after = rows.select((F.col("id") - 1).alias("id"), F.col("vector").alias("next"))
    return rows.join(after, "id").select("id", F.round(V.cosine(F.col("vector"), F.col("next")), 6).alias("cosine"))


KNN = f"WITH {DOUBLES}, pairs AS (SELECT q.id AS query, v.id, round(%s, 9) AS score FROM v q JOIN v ON q.id %% 20 = 0), ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM pairs)"


@query("q_knn_exact", KNN % "-(list_inner_product(q.e, q.e) + list_inner_product(v.e, v.e) - 2 * list_inner_product(q.e, v.e))" + " SELECT query, id, rank, round(score, 6) AS score FROM ranked WHERE rank <= 10")
def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(some_vectors(spark, sf_dir), vectors(spark, sf_dir), 10).select("query", "id", "rank", F.round("score", 6).alias("score"))


@query("q_knn_cross", KNN % "list_cosine_similarity(q.e, v.e)" + " SELECT query, id, rank, round(score, 6) AS score FROM ranked WHERE rank <= 50")
def knn_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(some_vectors(spark, sf_dir), vectors(spark, sf_dir), 50, "cosine").select("query", "id", "rank", F.round("score", 6).alias("score"))


LISTS, PROBES = 16, 14


def vector_index(spark: SparkSession, sf_dir: str) -> VectorIndex:
    """A kept index of all vectors; making it again does nothing."""
    index = VectorIndex(spark, scratch_dir(spark))
    if not index.create(vectors(spark, sf_dir), LISTS) or index.create(vectors(spark, sf_dir), LISTS):
        raise RuntimeError("the index is made once")
    return index


@query("q_knn_ivf")
def knn_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate neighbours; these vectors have little structure, so that a recall of 0.9 takes most lists."""
    return vector_index(spark, sf_dir).nearest(some_vectors(spark, sf_dir), 10, PROBES).select("query", "id", "rank")


EXACT = KNN % "-(list_inner_product(q.e, q.e) + list_inner_product(v.e, v.e) - 2 * list_inner_product(q.e, v.e))"
TEN = " SELECT query, id, rank, round(score, 6) AS score FROM ranked WHERE rank <= 10"


@query("q_knn_ivf_all", EXACT + TEN)
def knn_ivf_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through the index with all lists probed: the exact neighbours."""
    return vector_index(spark, sf_dir).nearest(some_vectors(spark, sf_dir), 10, LISTS).select("query", "id", "rank", F.round("score", 6).alias("score"))


@query("q_knn_pruned", EXACT + TEN)
def knn_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact neighbours from those lists alone whose radius lets them hold any."""
    return vector_index(spark, sf_dir).nearest_exact(some_vectors(spark, sf_dir), 10).select("query", "id", "rank", F.round("score", 6).alias("score"))


@query("q_knn_updated", EXACT.replace("FROM v q JOIN v ON", "FROM v q JOIN (SELECT * FROM v WHERE id % 20 <> 7) v ON") + TEN)
def knn_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of four fifths of the vectors, to which the rest came and from which a twentieth went: all lists find what is there now."""
    index, own = VectorIndex(spark, scratch_dir(spark)), vectors(spark, sf_dir)
    index.create(own.where("id % 5 <> 2"), LISTS)
    index.sync(own.where("id % 20 <> 7"))
    return index.nearest(some_vectors(spark, sf_dir), 10, LISTS).select("query", "id", "rank", F.round("score", 6).alias("score"))


@query("q_knn_unsynced", EXACT + TEN)
def knn_unsynced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of four fifths of the vectors; the others are searched beside its lists."""
    index, own = VectorIndex(spark, scratch_dir(spark)), vectors(spark, sf_dir)
    index.create(own.where("id % 5 <> 2"), LISTS)
    return index.nearest(some_vectors(spark, sf_dir), 10, LISTS, corpus=own).select("query", "id", "rank", F.round("score", 6).alias("score"))


@query("q_knn_codes")
def knn_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours by codes of all lists, the best of which are compared by their vectors."""
    return vector_index(spark, sf_dir).nearest_by_codes(some_vectors(spark, sf_dir), 10, LISTS).select("query", "id", "rank")


@query("q_knn_recall", "SELECT count(*) AS n_queries, true AS lists_suffice, true AS codes_suffice FROM embeddings WHERE vec_id % 20 = 0")
def knn_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether fewer lists, and codes, find nine in ten of the exact neighbours of all queries."""
    own, index = some_vectors(spark, sf_dir), vector_index(spark, sf_dir)
    exact = neighbours.nearest(own, vectors(spark, sf_dir), 10).select("query", "id")
    hits = {name: found.select("query", "id", F.lit(1).alias(name)) for name, found in (("lists", index.nearest(own, 10, PROBES)), ("codes", index.nearest_by_codes(own, 10, LISTS)))}
    both = exact.join(hits["lists"], ["query", "id"], "left").join(hits["codes"], ["query", "id"], "left")
    reached = [(F.avg(F.coalesce(name, F.lit(0))) >= 0.9).alias(f"{name}_suffice") for name in hits]
    return both.agg(F.countDistinct("query").alias("n_queries"), *reached)


@query("q_topk", "SELECT user_id, event_id, rn AS rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn <= 3")
def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    return views.read(spark, sf_dir, "events").select("user_id", "event_id", rank.alias("rank")).where("rank <= 3")


@query("q_repair_zero", f"WITH {VECTORS}, zero AS (SELECT * FROM vec0 WHERE list_sum(list_transform(vector, lambda x: CAST(x AS DOUBLE) * x)) <= 1e-8), {embedding('e', 'zero', 'id', 'text')} SELECT id, false AS repaired, len(list_filter(vector, lambda x: x <> 0)) AS n_set FROM vec0 WHERE id NOT IN (SELECT id FROM zero) UNION ALL SELECT id, true, count(*) FROM e JOIN zero z USING (id) WHERE z.text <> '' GROUP BY id")
def repair_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero vectors go; those with a text are embedded again, as a new snapshot."""
    store = Store(spark, scratch_dir(spark))
    rows = views.vectors_with_zeros(spark, sf_dir)
    store.commit(rows.select("id", "text", F.transform("vector", lambda x: x.cast("double")).alias("vector"), F.lit(False).alias("repaired")))
    bad = health.zero_vectors(store.read())
    again = models.embed(bad.where("text <> ''"), ["id", "text"], "text").withColumn("repaired", F.lit(True))
    good = store.read().join(bad.select("id"), "id", "left_anti")
    store.commit(good.select("id", "text", "vector", "repaired").unionByName(again))
    return store.read("id", "repaired", "vector").select("id", "repaired", F.size(F.filter("vector", lambda x: x != 0)).cast("bigint").alias("n_set"))


@query("q_doc_select", f"WITH {LIB} SELECT file_path, library_key FROM lib WHERE file_path IN (SELECT file_path FROM lib WHERE lang = 'fr')")
def doc_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.library(spark, sf_dir)
    return retrieval.documents_asked(docs, docs.where("lang = 'fr'").select("file_path"), "file_path").select("file_path", "library_key")


@query("q_stream_ingest", "SELECT doc_id, count(*) AS n_chunks FROM (SELECT doc_id, substr(text, pos * 512 + 1, 512) AS c FROM (SELECT *, unnest(range(CAST(ceil(length(text) / 512) AS BIGINT))) AS pos FROM documents)) WHERE regexp_matches(c, '\\S') GROUP BY 1")
def stream_ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the stream, into a store."""
    path = scratch_dir(spark)
    store = Store(spark, f"{path}/store", keyed_by="doc_id")
    docs = views.read(spark, sf_dir, "documents").select("doc_id", "text")
    docs.write.parquet(f"{path}/source")
    stream_ingest(spark, store, f"{path}/source", docs.schema, f"{path}/checkpoint")
    return store.read("doc_id").groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
