"""Cutting documents into chunks. Budgets are in characters, places in bytes of UTF-8."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def whole(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One chunk a document, also of an empty text."""
    return docs.select(key, F.lit(1).alias("chunk_id"), F.lit(1).alias("chunk_count"), F.col(text).alias("content"), F.lit(0).cast("bigint").alias("byte_start"), F.octet_length(text).cast("bigint").alias("byte_end"))


def pieces(text: str, size: int) -> F.Column:
    """Array of a text's pieces of ``size`` characters; none for an empty or null text."""
    # One pass over the text; a substring for each piece would begin at its start again.
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{size}}})"), 1), F.array().cast("array<string>"))


def fixed(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """Pieces of ``size`` characters: numbered from 1, with the document's number of them and byte ranges."""
    cut = docs.select(key, pieces(text, size).alias("pieces"))
    cut = cut.select(key, F.size("pieces").alias("chunk_count"), F.posexplode("pieces").alias("at", "content"))
    return with_bytes(cut.withColumn("chunk_id", F.col("at") + 1), key).select(key, "chunk_id", "chunk_count", "content", "byte_start", "byte_end")


def with_bytes(chunks: DataFrame, key: str) -> DataFrame:
    order = Window.partitionBy(key).orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.octet_length("content")).over(order).cast("bigint")
    return chunks.withColumn("byte_end", end).withColumn("byte_start", F.col("byte_end") - F.octet_length("content"))


def by_sections(spans: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """Pieces of each section: (doc, section, chunk_id, chunk_count, content, byte_start, byte_end, page_start, page_end).

    Text before the first section is in no chunk; numbers run through the document; pages count from 1 and end no earlier than they start.
    Sections are cut as bytes and then read as characters, so that offsets are exact.
    """
    cut = spans.join(docs.select("doc", "text"), "doc")
    body = F.decode(F.substring(F.encode("text", "UTF-8"), F.col("byte_index").cast("int") + 1, (F.col("end_byte") - F.col("byte_index")).cast("int")), "UTF-8")
    flat = cut.select("doc", "section", "byte_index", "page_number", F.col("page_end").alias("last_page"), body.alias("body"))
    flat = flat.select("doc", "section", "byte_index", "page_number", "last_page", F.posexplode(pieces("body", size)).alias("at", "content"))
    doc, own = Window.partitionBy("doc").orderBy("section", "at"), Window.partitionBy("doc", "section").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = (F.col("byte_index") + F.sum(F.octet_length("content")).over(own)).cast("bigint")
    page = F.col("page_number") + 1
    return flat.select(
        "doc", "section", F.row_number().over(doc).alias("chunk_id"), F.count("*").over(Window.partitionBy("doc")).alias("chunk_count"), "content",
        (end - F.octet_length("content")).alias("byte_start"), end.alias("byte_end"), page.alias("page_start"), F.greatest(page, F.col("last_page") + 1).alias("page_end"),
    )


#: The section budget that suits a provider's model, in characters; null is a whole document.
STRATEGIES = (("openai", 7500), ("ollama", 1500), ("voyageai", None), ("gemini", 1500), ("cohere", None), ("zeroentropy", None))


def by_strategies(spans: DataFrame, docs: DataFrame, strategies: tuple[tuple[str, int | None], ...] = STRATEGIES) -> DataFrame:
    """(provider, doc, chunk_id, chunk_count, content): the chunks that suit each provider's model: whole documents, or pieces of their sections.

    Providers of one budget share the cutting.
    """
    out = None
    for size in dict.fromkeys(n for _, n in strategies):
        cut = whole(docs, "doc", "text") if size is None else by_sections(spans, docs, size)
        named = F.explode(F.array(*(F.lit(p) for p, n in strategies if n == size)))
        own = cut.select(named.alias("provider"), "doc", F.col("chunk_id").cast("bigint").alias("chunk_id"), F.col("chunk_count").cast("bigint").alias("chunk_count"), "content")
        out = own if out is None else out.unionByName(own)
    return out
