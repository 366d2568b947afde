"""Ranked lexical search, reversed (operator 12): documents stream through an index of the items.

Items are few and documents many, so that the inverted index is over the items' terms, and is broadcast. One pass over the documents counts
them, their terms, and in how many each indexed term is. A second sends each document's counts of indexed terms through the index, adds up
scores of all items that share a term, and keeps the best of each item in a heap of k entries. Tasks give their heaps away, which are merged
in two steps, so that no task reads those of all tasks. Items too many for one index are dealt to blocks, each with passes of its own.

A term is a maximal run of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased. All scores are whole numbers:
floor(1000 ln((2N+2)/(2df+1))) times (1000000000 tf) div (1000 tf + 12 m), with m = 75 + (25 n N) div L, summed over an item's terms with repeats.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.batches import slices, texts_of
from brindle.llm.shared import written

TOP = 20
#: Bytes of items' texts, and items, in one index; scores that are held at once, and postings that are added at once.
INDEX_BYTES, INDEX_ITEMS, CELLS, POSTINGS = 8 << 20, 20_000, 2_000_000, 1_000_000
#: Groups that tasks' heaps are merged in first.
GROUPS = 64

#: What a byte of a text becomes: letters, digits and bytes beyond ASCII stay, A-Z lower-cased; others part terms.
FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


@dataclass(frozen=True)
class ItemIndex:
    """Numbers of terms, and for each the items that hold it with their counts: those of term t are ``starts[t]`` to ``starts[t + 1]``."""

    numbers: dict[bytes, int]
    starts: np.ndarray
    items: np.ndarray
    counts: np.ndarray
    n_items: int

    @staticmethod
    def of(texts: list[bytes]) -> ItemIndex:
        numbers: dict[bytes, int] = {}
        found = [[numbers.setdefault(t, len(numbers)) for t in terms_of(x)] for x in texts]
        flat = np.fromiter(chain.from_iterable(found), np.int64)
        item = np.repeat(np.arange(len(texts)), [len(x) for x in found])
        pairs, counts = np.unique(flat * max(1, len(texts)) + item, return_counts=True)
        terms, items = np.divmod(pairs, max(1, len(texts)))
        return ItemIndex(numbers, np.searchsorted(terms, np.arange(len(numbers) + 1)), items, counts, len(texts))


@dataclass(frozen=True)
class Statistics:
    n_docs: int
    n_terms: int
    weights: np.ndarray


def statistics(docs: DataFrame, text: str, index: Broadcast, n_terms: int) -> Statistics:
    """Of all documents: those that have a term, their terms, and the weight of each indexed term. Tasks give one row for each term they met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = np.zeros(n_terms, np.int64), np.zeros(2, np.int64)
        get = index.value.numbers.get
        for batch in batches:
            for part in slices(batch, 0):
                for body in texts_of(part.column(0)):
                    terms = terms_of(body)
                    total += (bool(terms), len(terms))
                    held[[n for t in set(terms) if (n := get(t)) is not None]] += 1
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-1, -2])), pa.array(np.append(held[some], total))], ["term", "n"])

    found = dict(docs.select(text).mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n")).collect())
    n_docs, length = found.pop(-1, 0), found.pop(-2, 0)
    weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * found.get(t, 0) + 1))) for t in range(n_terms)]
    return Statistics(n_docs, length, np.array(weights, dtype=np.int64))


class Heaps:
    """The best k of each item, by score and then by the least id, as arrays in that order."""

    def __init__(self, n_items: int, k: int) -> None:
        self.k, self.least = k, np.ones(n_items, np.int64)
        self.items, self.scores, self.ids = (np.empty(0, np.int64) for _ in range(3))

    def add(self, items: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        items, scores, ids = np.append(self.items, items), np.append(self.scores, scores), np.append(self.ids, ids)
        order = np.lexsort((ids, -scores, items))
        items = items[order]
        place = np.arange(len(items)) - np.searchsorted(items, items)
        order = order[place < self.k]
        self.items, self.scores, self.ids = items[place < self.k], scores[order], ids[order]
        full = place == self.k - 1
        # What is below an item's last entry cannot enter any more.
        self.least[items[full]] = self.scores[place[place < self.k] == self.k - 1]


def add_scores(scores: np.ndarray, index: ItemIndex, doc: np.ndarray, term: np.ndarray, gain: np.ndarray) -> None:
    """Adds each (document, term) gain to the document's scores of the items that hold the term."""
    sizes = np.diff(index.starts)[term]
    ends = np.cumsum(sizes)
    at = 0
    while at < len(doc):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + POSTINGS, side="right")))
        some = np.repeat(np.arange(at, stop), sizes[at:stop])
        place = index.starts[term[some]] + np.arange(len(some)) - (ends - sizes - (ends[at - 1] if at else 0))[some]
        np.add.at(scores, (doc[some], index.items[place]), gain[some] * index.counts[place])
        at = stop


def best_of_tasks(docs: DataFrame, id_column: str, text: str, index: Broadcast, known: Broadcast, k: int) -> DataFrame:
    """(item, doc_id, score): the heaps of each task; ``item`` is the number of an item in the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, stats = index.value, known.value
        heaps, get = Heaps(own.n_items, k), own.numbers.get
        step = max(1, CELLS // max(1, own.n_items))
        for batch in batches:
            for part in slices(batch.filter(batch.column(0).is_valid()), 1, rows=step):
                ids, bodies = part.column(0).to_numpy(), texts_of(part.column(1))
                lengths, found = [], []
                for body in bodies:
                    terms = terms_of(body)
                    lengths.append(len(terms))
                    found.append([n for t in terms if (n := get(t)) is not None])
                owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
                pairs, tf = np.unique(owner * len(own.numbers) + np.fromiter(chain.from_iterable(found), np.int64, count=len(owner)), return_counts=True)
                if not len(pairs):
                    continue
                doc, term = np.divmod(pairs, len(own.numbers))
                m = 75 + (25 * np.array(lengths, dtype=np.int64) * stats.n_docs) // stats.n_terms
                gain = stats.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
                scores = np.zeros((len(bodies), own.n_items), np.int64)
                add_scores(scores, own, doc, term, gain)
                row, item = np.nonzero(scores >= heaps.least[None, :])
                heaps.add(item, scores[row, item], ids[row])
        yield pa.RecordBatch.from_arrays([pa.array(heaps.items), pa.array(heaps.ids), pa.array(heaps.scores)], ["item", "doc_id", "score"])

    return docs.select(F.col(id_column).cast("bigint").alias("id"), text).mapInArrow(run, "item bigint, doc_id bigint, score bigint")


def merged(heaps: DataFrame, k: int) -> DataFrame:
    """(item, rank, doc_id, score) of the best k of all tasks' heaps, first in groups of tasks and then over these."""
    best = F.row_number().over(Window.partitionBy("item", "group").orderBy(F.desc("score"), "doc_id"))
    some = heaps.withColumn("group", F.pmod(F.spark_partition_id(), F.lit(GROUPS))).withColumn("rank", best).where(F.col("rank") <= k)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    return some.select("item", "doc_id", "score").withColumn("rank", rank).where(F.col("rank") <= k)


def ranked_search(items: DataFrame, docs: DataFrame, item_id: str = "item_id", item_text: str = "text", id_column: str = "doc_id", text: str = "text", k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for each item; equal scores by ascending id.

    A null text has no term; an item without a term has no row. An item with a null id is left out. A document with a null id counts in all statistics and is never
    returned. Repeated rows of either table are items and documents of their own. Document ids are whole numbers. Other columns are not read; where either table is
    empty there is no row.
    """
    spark = docs.sparkSession
    named = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    size = named.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // INDEX_ITEMS), -(-(size["bytes"] or 0) // INDEX_BYTES))
    out = None
    for block in range(blocks):
        # At most INDEX_BYTES of items, about, reach the driver at once.
        own = named.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).toArrow()
        made = ItemIndex.of(texts_of(own["text"].combine_chunks()))
        index = spark.sparkContext.broadcast(made)
        known = spark.sparkContext.broadcast(statistics(docs, text, index, len(made.numbers)))
        ids = spark.createDataFrame(pa.table({"item": pa.array(np.arange(own.num_rows)), "item_id": own["item_id"]}))
        found = merged(written(best_of_tasks(docs, id_column, text, index, known, k)), k).join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out
