"""Sections of documents from type sizes: body size, headings, levels, parents, spans, positions.

A document is a key column ``doc``; places are byte offsets into its UTF-8 text. Everything is windows over one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 4


def body_font(markers: DataFrame) -> DataFrame:
    """(doc, body_page, body_size): on the first page of two or more markers, the size of the longest run between two.

    Of equal runs the last counts; what follows the page's last marker is no run.
    """
    page = Window.partitionBy("doc", "page_number").orderBy("byte_index")
    spans = markers.withColumn("span", F.lead("byte_index").over(page) - F.col("byte_index")).where("span is not null")
    best = spans.groupBy("doc", "page_number").agg(F.max_by("font_size", F.struct("span", "byte_index")).alias("body_size"))
    return best.groupBy("doc").agg(F.min("page_number").alias("body_page"), F.min_by("body_size", "page_number").alias("body_size"))


def headings(markers: DataFrame) -> DataFrame:
    """Markers that are headings: larger than the body, or as large and bold; never on pages before the body's."""
    bold = F.col("font_name").contains("BX") | F.col("font_name").endswith("B")
    kept = (F.col("page_number") >= F.col("body_page")) & ((F.col("font_size") > F.col("body_size")) | ((F.col("font_size") == F.col("body_size")) & bold))
    return markers.join(body_font(markers), "doc").where(kept).select("doc", "byte_index", "page_number", "font_size")


def heading_levels(found: DataFrame) -> DataFrame:
    """Adds level: 0 for a document's largest heading size, 1 for the next; those from LEVELS on are dropped."""
    level = F.dense_rank().over(Window.partitionBy("doc").orderBy(F.desc("font_size"))) - 1
    return found.withColumn("level", level).where(F.col("level") < LEVELS)


def numbered(sections: DataFrame) -> DataFrame:
    order = Window.partitionBy("doc").orderBy("byte_index")
    return sections.withColumn("section", F.row_number().over(order) - 1)


def with_parents(sections: DataFrame) -> DataFrame:
    """Adds parent: the nearest earlier section of a smaller level, null for none. No join: the last of each level so far."""
    before = Window.partitionBy("doc").orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
    last = {n: F.last(F.when(F.col("level") == n, F.col("section")), ignorenulls=True).over(before) for n in range(LEVELS - 1)}
    rows = sections.withColumns({f"_last{n}": c for n, c in last.items()})
    parent = F.greatest(*(F.when(F.col("level") > n, F.col(f"_last{n}")) for n in last), F.lit(None).cast("int"))
    return rows.withColumn("parent", parent).drop(*(f"_last{n}" for n in last))


def with_spans(sections: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds end byte and end page: up to the next section, or the end of the document. Pages count from 0."""
    order = Window.partitionBy("doc").orderBy("section")
    rows = sections.join(docs.select("doc", "n_bytes", "page_count"), "doc")
    after = F.lead("page_number").over(order)
    page_end = F.when(after.isNotNull(), F.greatest(after - 1, F.lit(0)))  # greatest() alone would skip the null
    return rows.withColumns({"end_byte": F.coalesce(F.lead("byte_index").over(order), F.col("n_bytes")), "page_end": F.coalesce(page_end, F.col("page_count") - 1)}).drop("n_bytes", "page_count")


def sections_of(markers: DataFrame) -> DataFrame:
    """(doc, section, byte_index, page_number, font_size, level, parent) from markers."""
    return with_parents(numbered(heading_levels(headings(markers))))


def section_of_positions(positions: DataFrame, sections: DataFrame) -> DataFrame:
    """Adds section to (doc, position): the last that begins at or before it; the first where none does.

    One window over both, sorted by place, instead of a range join; documents without sections are left out.
    """
    marks = sections.select("doc", F.col("byte_index").alias("place"), F.lit(0).alias("kind"), "section", *(F.lit(None).cast(t).alias(c) for c, t in positions.dtypes if c != "doc"))
    asked = positions.select("doc", F.col("position").alias("place"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("section"), *(c for c in positions.columns if c != "doc"))
    order = Window.partitionBy("doc").orderBy("place", "kind")
    both = marks.unionByName(asked)
    found = both.withColumn("section", F.coalesce(F.last("section", ignorenulls=True).over(order), F.min("section").over(Window.partitionBy("doc"))))
    return found.where("kind = 1 and section is not null").select(*positions.columns, "section")
