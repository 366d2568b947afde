"""Search pipelines: documents for queries, passages of documents, passages widened to sections."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions import vectors as V
from brindle.operators import chunking, models, neighbours
from brindle.operators.sections import section_of_positions
from brindle.operators.text_index import TextIndex
from brindle.operators.vector_index import VectorIndex
from brindle.sources.files import kept

#: The least similarity of a passage, how many stay if none has it, and a section's share that widens it.
LEAST_SCORE, FALLBACK, ZOOM_SHARE = 0.7, 8, 0.25
TOP, CHUNK = 10, 512


def chunk_vectors(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """(id, vector) of each document's chunks, several to an id."""
    return models.embed(chunking.fixed(docs, "doc_id", "text", size), ["doc_id"], "content").select(F.col("doc_id").alias("id"), "vector")


def both(*steps: Callable[[], object]) -> list[object]:
    """What independent steps give. Their jobs run beside each other, so that cores are not idle while one plans, or ends with its last tasks."""
    with ThreadPoolExecutor(len(steps)) as pool:
        return [f.result() for f in [pool.submit(step) for step in steps]]


@dataclass(frozen=True)
class SearchIndex:
    """Kept indexes of documents (doc_id, text): their chunks' vectors, and their words."""

    vectors: VectorIndex
    words: TextIndex
    size: int = CHUNK

    @staticmethod
    def at(spark: SparkSession, path: str, size: int = CHUNK) -> SearchIndex:
        return SearchIndex(VectorIndex(spark, f"{path}/vectors"), TextIndex(spark, f"{path}/words", "doc_id"), size)

    def _chunks(self, docs: DataFrame) -> DataFrame:
        # Blank chunks have zero vectors, which are like nothing but near to everything.
        return chunk_vectors(docs, self.size).where(F.exists("vector", lambda x: x != 0))

    def create(self, docs: DataFrame, lists: int) -> bool:
        return any(both(lambda: self.vectors.create(kept(self._chunks(docs)), lists), lambda: self.words.create(docs, "text")))

    def sync(self, docs: DataFrame) -> None:
        """Takes in documents that are not there yet, of which alone chunks are cut and embedded, and lets those go that ``docs`` has no more."""
        held = self.words.documents().select("doc_id")
        new = kept(docs.select("doc_id").distinct().join(held, "doc_id", "left_anti"))
        stay = self.vectors.lists("id").distinct().join(docs.select(F.col("doc_id").alias("id")), "id", "left_semi")
        added = self._chunks(docs.join(new, "doc_id", "left_semi"))
        both(lambda: self.vectors.sync(kept(added.unionByName(stay.withColumn("vector", F.array().cast("array<double>"))))), lambda: self.words.sync(docs, "text"))


def search(queries: DataFrame, docs: DataFrame, k: int = TOP, size: int = CHUNK, index: SearchIndex | None = None) -> DataFrame:
    """(query, doc_id, score, rank): each query's nearest documents by their best chunk, then ordered by BM25.

    Blank documents are dropped after the cut to k, so that fewer may be left. Ties go by id. With a kept index no document is read, but for the
    check for blank ones: neighbours are exact, from the lists that may hold any, and words are counted in the index.
    """
    asked = models.embed(queries.select("query", "query_text"), ["query"], "query_text").select("query", "vector")
    near = index.vectors.nearest_exact(asked, k) if index else neighbours.nearest(asked, chunk_vectors(docs, size), k, "cosine")
    near = near.select("query", F.col("id").alias("doc_id"))
    near = kept(near.join(docs.where(F.rlike("text", F.lit("\\S"))).select("doc_id"), "doc_id", "left_semi"))
    scored = models.bm25(near, queries, docs, "doc_id", "query", "query_text", "text", index.words if index else None)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")))


def hit_text(title, authors, key):
    """Three lines that show a hit."""
    return F.concat(F.lit("Title: "), title, F.lit("\nAuthors: "), F.coalesce(authors, F.lit("Unknown")), F.lit("\nItem ID: "), key)


def threshold_or_top(scored: DataFrame, keys: list[str], order: str, least: float = LEAST_SCORE, top: int = FALLBACK) -> DataFrame:
    """Adds position to the rows that stay: all of at least ``least`` in their order, or, if a group has none, its best ``top`` by score."""
    group = Window.partitionBy(*keys)
    rows = scored.withColumn("_any", F.max(F.col("score") >= least).over(group)).withColumn("_rank", F.row_number().over(group.orderBy(F.desc("score"), order)))
    rows = rows.where((F.col("score") >= least) | (~F.col("_any") & (F.col("_rank") <= top)))
    place = F.when(F.col("_any"), F.row_number().over(group.orderBy(order))).otherwise(F.col("_rank"))
    return rows.withColumn("position", place).drop("_any", "_rank")


def scored_passages(pairs: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query, doc_id, chunk_id, score): similarity of each chunk of a pair's document; ``chunks`` is (doc_id, chunk_id, content)."""
    asked = models.embed(queries.select("query", "query_text"), ["query"], "query_text").select("query", F.col("vector").alias("asked"))
    used = chunks.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    held = models.embed(used, ["doc_id", "chunk_id"], "content").select("doc_id", "chunk_id", "vector")
    return pairs.join(held, "doc_id").join(asked, "query").select("query", "doc_id", "chunk_id", F.round(V.dot(F.col("vector"), F.col("asked")), 6).alias("score"))


def passages(pairs: DataFrame, queries: DataFrame, chunks: DataFrame, failed: DataFrame, least: float = LEAST_SCORE, top: int = FALLBACK) -> DataFrame:
    """(query, doc, id, section, score, position, error): what of each pair's document answers its query.

    ``chunks`` is (doc, section, id, content) with an id for each chunk. Those of at least ``least`` stay, or the best ``top`` of a document that has none, and are then
    ordered by BM25. A document that is in ``failed`` (doc, error) gives its error as a row, and the others go on.
    """
    sound, bad = pairs.join(failed.select("doc"), "doc", "left_anti"), pairs.join(failed, "doc")
    found = scored_passages(sound.select("query", F.col("doc").alias("doc_id")), queries, chunks.select(F.col("doc").alias("doc_id"), F.col("id").alias("chunk_id"), "content"))
    kept = threshold_or_top(found, ["query", "doc_id"], "chunk_id", least, top).select("query", F.col("doc_id").alias("doc"), F.col("chunk_id").alias("id"), "score")
    ranked = models.bm25(kept, queries, chunks, "id", "query", "query_text", "content").withColumnRenamed("score", "_bm25")
    rows = kept.join(ranked, ["query", "id"]).join(chunks.select("id", "section"), "id")
    place = F.row_number().over(Window.partitionBy("query", "doc").orderBy(F.desc("_bm25"), "id"))
    out = rows.select("query", "doc", "id", "section", "score", place.alias("position"), F.lit(None).cast("string").alias("error"))
    empty = {c: F.lit(None).cast(t).alias(c) for c, t in out.dtypes}
    return out.unionByName(bad.select("query", "doc", empty["id"], empty["section"], empty["score"], empty["position"], "error"))


def places_in_text(text: str, passages: list[str]) -> list[int | None]:
    """Where each passage first stands in a text, in bytes of UTF-8, null where it does not; in one pass over the text for all of them."""
    automaton = ahocorasick.Automaton()
    for p in passages:
        if p:
            automaton.add_word(p, p)
    first = {"": 0}
    if len(automaton):
        automaton.make_automaton()
        for end, p in automaton.iter(text):
            if p not in first:
                first[p] = end + 1 - len(p)
                if len(first) > len(automaton):
                    break
    # From characters to bytes, also in one pass.
    at, size, bytes_before = 0, 0, {}
    for place in sorted(set(first.values())):
        size += len(text[at:place].encode("utf-8", "surrogatepass"))
        at, bytes_before[place] = place, size
    return [bytes_before[first[p]] if p in first else None for p in passages]


def first_places(passages: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc, id, position) of passages (doc, id, content): where each first stands in its document (doc, text), in bytes; a passage that stands nowhere is left out.

    A document's passages are brought to its text, which is sent and read once for all of them; they are chunks of it, so that together they are about as long.
    """
    listed = passages.select("doc", "id", "content").distinct().groupBy("doc").agg(F.collect_list(F.struct("id", "content")).alias("passages"))
    kind = dict(passages.dtypes)["id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for doc, text, own in zip(frame["doc"], frame["text"], frame["passages"], strict=True):
                places = places_in_text(text or "", [p["content"] for p in own])
                yield pd.DataFrame([(doc, p["id"], at) for p, at in zip(own, places, strict=True) if at is not None], columns=["doc", "id", "position"])

    rows = listed.join(docs.select("doc", "text"), "doc").select("doc", "text", "passages")
    return rows.mapInPandas(run, f"doc {dict(docs.dtypes)['doc']}, id {kind}, position bigint")


def first_occurrences(found: DataFrame, chunks: DataFrame, docs: DataFrame, sections: DataFrame) -> DataFrame:
    """(query, doc, id, section) of passages: the section of the place where a passage's text first stands in its document, which may come before its own."""
    own = found.where("error is null").select("query", "doc", "id")
    bodies = own.select("doc", "id").distinct().join(chunks.select("id", "content"), "id")
    placed = section_of_positions(first_places(bodies, docs), sections).select("doc", "id", "section")
    return own.join(placed, ["doc", "id"]).select("query", "doc", "id", "section")


def expanded(found: DataFrame, chunks: DataFrame, docs: DataFrame, sections: DataFrame) -> DataFrame:
    """(query, doc, section, start, end, text): passages widened to their sections, or as they are, without a section, where their document has none."""
    placed = first_occurrences(found, chunks, docs, sections)
    wide = widened(section_shares(placed), sections, docs)
    none = F.lit(None)
    same = found.where("error is null").join(wide.select("query", "doc").distinct(), ["query", "doc"], "left_anti").join(chunks.select("id", "content"), "id")
    kinds = dict(wide.dtypes)
    return wide.unionByName(same.select("query", "doc", *(none.cast(kinds[c]).alias(c) for c in ("section", "start", "end")), F.col("content").alias("text")))


def section_shares(hits: DataFrame) -> DataFrame:
    """(query, doc, section, n, share) of hits that have a section."""
    counted = hits.where("section is not null").groupBy("query", "doc", "section").agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("query", "doc")))


def widened(shares: DataFrame, sections: DataFrame, docs: DataFrame, least: float = ZOOM_SHARE) -> DataFrame:
    """(query, doc, section, start, end, text): each hit section, or its parent for a large share, up to the next section of any level.

    Sections that widen to one parent give its text once.
    """
    order = Window.partitionBy("doc").orderBy("section")
    spans = sections.join(docs.select("doc", "n_bytes"), "doc").select("doc", "section", F.col("byte_index").alias("start"), F.coalesce(F.lead("byte_index").over(order), F.col("n_bytes")).alias("end"))
    own = shares.join(sections.select("doc", "section", "parent"), ["doc", "section"])
    meant = own.select("query", "doc", F.when((F.col("share") >= least) & F.col("parent").isNotNull(), F.col("parent")).otherwise(F.col("section")).alias("section")).distinct()
    found = meant.join(spans, ["doc", "section"]).join(docs.select("doc", "text"), "doc")
    body = F.decode(F.substring(F.encode("text", "UTF-8"), F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int")), "UTF-8")
    return found.select("query", "doc", "section", "start", "end", body.alias("text"))


def prompts(hits: DataFrame) -> DataFrame:
    """Adds prompt: what a model is asked about one document for one query."""
    authors = F.coalesce(F.col("authors"), F.lit("not known"))
    return hits.withColumn("prompt", F.concat(F.lit("Question: "), "query_text", F.lit("\nTitle: "), "title", F.lit("\nAuthors: "), authors, F.lit("\nQuote what answers the question from this text:\n"), "text"))


def refine_prompts(found: DataFrame, queries: DataFrame, chunks: DataFrame, summaries: DataFrame) -> DataFrame:
    """(query, doc, prompt): asks a model to refine a document's passages for a query, beside the document's ``summary``."""
    rows = found.where("error is null").join(chunks.select("id", "content"), "id")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("position", "content"))), lambda x: x["content"])
    joined = rows.groupBy("query", "doc").agg(F.array_join(listed, "\n-----\n").alias("passages"))
    return with_refine_prompt(joined, queries, summaries)


#: Fixed: what parts the pieces of a refiner's answer, and what is stripped from their ends.
PIECES = "-----"
WHITE = "[\\t-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"


def refined(wide: DataFrame, queries: DataFrame, summaries: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """(query, doc, piece, text, error): what a model makes of the widened sections (query, doc, section, start, end, text) of each query's document.

    Each document's sections, in their order, are one prompt and one call; the answer is cut at ``PIECES``, and blank pieces are left out. A document whose passages have no
    section is not put to the model: its passages, with a null start, are its pieces, in the order of their texts. A failing call is a row with its error.
    """
    placed, bare = wide.where("section is not null"), wide.where("section is null")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("section", "text"))), lambda x: x["text"])
    joined = placed.groupBy("query", "doc").agg(F.array_join(listed, f"\n{PIECES}\n").alias("passages"))
    asked = with_refine_prompt(joined, queries, summaries)
    answers = models.generate_with(asked, "prompt", model)
    cut = F.filter(F.transform(F.split("answer", PIECES), lambda x: F.regexp_replace(x, f"^{WHITE}|{WHITE}$", "")), lambda x: x != "")
    good = answers.where("error is null").select("query", "doc", F.posexplode(cut).alias("piece", "text"), F.lit(None).cast("string").alias("error"))
    bad = answers.where("error is not null").select("query", "doc", F.lit(None).cast("int").alias("piece"), F.lit(None).cast("string").alias("text"), "error")
    order = F.row_number().over(Window.partitionBy("query", "doc").orderBy("text")) - 1
    same = bare.select("query", "doc", order.alias("piece"), "text", F.lit(None).cast("string").alias("error"))
    return good.unionByName(bad).unionByName(same)


def with_refine_prompt(joined: DataFrame, queries: DataFrame, summaries: DataFrame) -> DataFrame:
    """(query, doc, prompt) from (query, doc, passages)."""
    asked = joined.join(queries.select("query", "query_text"), "query").join(summaries.select("doc", "summary"), "doc")
    text = F.concat(F.lit("Question: "), "query_text", F.lit("\nWhat the document is about, perhaps: "), "summary", F.lit("\nPassages found in it:\n"), "passages", F.lit("\nGive the parts that answer the question, word for word, with ----- between them.\n"))
    return asked.select("query", "doc", text.alias("prompt"))


def search_tokens(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(query, embedding_tokens, rerank_tokens, billed): bytes stand for tokens; bills count four bytes a token, rounded down."""
    own = queries.select("query", F.octet_length("query_text").cast("bigint").alias("embedding_tokens"))
    texts = hits.groupBy("query").agg(F.sum(F.octet_length("text")).cast("bigint").alias("n"))
    rows = own.join(texts, "query", "left").withColumn("rerank_tokens", F.col("embedding_tokens") + F.coalesce("n", F.lit(0)))
    return rows.select("query", "embedding_tokens", "rerank_tokens", (F.expr("embedding_tokens div 4") + F.expr("rerank_tokens div 4")).alias("billed"))


def apply_order(candidates: DataFrame, order: DataFrame) -> DataFrame:
    """Candidates (query, index, ...) by new rank; indices of the order that no candidate has are left out."""
    return candidates.join(order.select("query", "index", "rank"), ["query", "index"])


def documents_asked(docs: DataFrame, names: DataFrame | None, column: str) -> DataFrame:
    """The named documents, or all; a name that is not there is an error for the whole call."""
    if names is None:
        return docs.orderBy(column)
    missing = [r[0] for r in names.join(docs, column, "left_anti").select(column).distinct().limit(5).collect()]
    if missing:
        raise ValueError(f"no such documents: {', '.join(map(str, missing))}")
    return docs.join(names.select(column).distinct(), column, "left_semi")
