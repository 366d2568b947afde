"""Nearest neighbours of many queries at once, exactly; see ``vector_index`` for kept indexes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK, VECTOR_BLOCK = 1024, 8192
#: Scores that a task holds at once: 2 million are 16 MB, with what is made of them some 100. Where blocks meet, fewer: 2 MB, with what is made of them some 10.
SCORES, BLOCK_SCORES = 2_000_000, 250_000
#: Queries that are broadcast: with 1,000 dimensions, 20 MB.
FEW_QUERIES = 2500


def filled(vector: str) -> Column:
    return F.transform(vector, lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))


def matrix(vectors: pa.Array, rows: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def scores(queries: np.ndarray, vectors: np.ndarray, metric: str) -> np.ndarray:
    """Larger is nearer: cosine, or minus the squared distance; to 9 places, so that ties do not hang on the order of sums."""
    if metric == "cosine":
        length = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(vectors, axis=1)[None, :]
        return np.round(np.divide(queries @ vectors.T, length, out=np.zeros((len(queries), len(vectors))), where=length > 0), 9)
    return -np.round((queries**2).sum(axis=1)[:, None] + (vectors**2).sum(axis=1)[None, :] - 2 * queries @ vectors.T, 9)


def best_of_block(names: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, metric: str) -> list[np.ndarray]:
    """[query, id, score] of the best k ids of each query, equals by id; few scores are held at once."""
    order = np.argsort(ids, kind="stable")
    vectors = vectors[order]
    own, starts = np.unique(ids[order], return_index=True)
    few, out = min(k, len(own)), []
    step = max(1, BLOCK_SCORES // len(vectors))
    for at in range(0, len(names), step):
        far = -np.maximum.reduceat(scores(queries[at : at + step], vectors, metric), starts, axis=1)
        last = np.partition(far, few - 1, axis=1)[:, few - 1 : few]
        # What is no number comes last, as the sort has it.
        row, place = np.nonzero(~(far > last))
        value = far[row, place]
        top = np.lexsort((place, value, row))
        top = top[np.arange(len(row)) - np.searchsorted(row, row) < few]
        out.append((names[at + row[top]], own[place[top]], -value[top]))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def best_of_blocks(rows: DataFrame, k: int, metric: str) -> DataFrame:
    """(query, id, score) of the best k ids of each query in each pair of blocks.

    ``rows`` are (qb, vb, is_query, id, vector). An id may have several vectors: its best counts.
    """

    def found(group: pa.Table) -> pa.RecordBatch | None:
        asked = group["is_query"].to_numpy()
        ids = group["id"].to_numpy()
        width = len(group["vector"][0])
        vectors = group["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        queries, order = np.flatnonzero(asked), np.flatnonzero(~asked)
        if not len(queries) or not len(order):
            return None
        found = best_of_block(ids[queries], vectors[queries], ids[order], vectors[order], k, metric)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            if not batch.num_rows:
                continue
            pair = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            edges = np.flatnonzero((pair[:, 1:] != pair[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                key = tuple(pair[:, a].tolist())
                if key != now:
                    if held and (out := found(pa.Table.from_batches(held))):
                        yield out
                    held, now = [], key
                held.append(batch.slice(a, b - a))
        if held and (out := found(pa.Table.from_batches(held))):
            yield out

    return rows.sortWithinPartitions("qb", "vb").mapInArrow(run, "query bigint, id bigint, score double")


def ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def best_of_partitions(asked: DataFrame, held: DataFrame, k: int, metric: str) -> DataFrame:
    """(query, id, score): of each partition of (id, vector) rows the best k ids of each query, of which there are few: all are broadcast."""
    found = asked.toArrow()
    if not found.num_rows:
        return asked.sparkSession.createDataFrame([], "query bigint, id bigint, score double")
    names = found["query"].to_numpy()
    shared = asked.sparkSession.sparkContext.broadcast((names, matrix(found["vector"].combine_chunks(), len(names))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries = shared.value
        step = max(1, min(VECTOR_BLOCK, SCORES // len(names)))
        ids, best = np.empty((len(names), 0), np.int64), np.empty((len(names), 0))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                order = np.argsort(part.column(0).to_numpy(), kind="stable")
                own, starts = np.unique(part.column(0).to_numpy()[order], return_index=True)
                new = np.maximum.reduceat(scores(queries, matrix(part.column(1), part.num_rows)[order], metric), starts, axis=1)
                # Ids ascend here, so that a stable sort breaks ties by id.
                top = np.argsort(-new, axis=1, kind="stable")[:, :k]
                ids, best = np.hstack([ids, own[top]]), np.hstack([best, np.take_along_axis(new, top, axis=1)])
                # An id may be in several batches: its best counts, the others sink.
                order = np.lexsort((-best, ids), axis=1)
                ids, best = np.take_along_axis(ids, order, 1), np.take_along_axis(best, order, 1)
                best[:, 1:][ids[:, 1:] == ids[:, :-1]] = -np.inf
                order = np.lexsort((ids, -best), axis=1)[:, :k]
                ids, best = np.take_along_axis(ids, order, 1), np.take_along_axis(best, order, 1)
        kept = best.ravel() > -np.inf
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, ids.shape[1])[kept]), pa.array(ids.ravel()[kept]), pa.array(best.ravel()[kept])], ["query", "id", "score"])

    return held.select("id", "vector").mapInArrow(run, "query bigint, id bigint, score double").groupBy("query", "id").agg(F.max("score").alias("score"))


def nearest(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "l2", exclude_self: bool = False, few: int = FEW_QUERIES) -> DataFrame:
    """(query, id, score, rank): the k nearest ids of each query, exactly; equals are ordered by id.

    ``queries`` is (query, vector), ``corpus`` is (id, vector), ids are bigint, null elements read as 0, all vectors have one length. Up to ``few`` queries are
    broadcast to the corpus, which stays where it is: each of its partitions passes k rows a query on. Beyond, either side is dealt
    into blocks, so that no task holds more than a block of each; each pair of blocks passes k rows a query on.
    """
    asked, held = queries.select("query", filled("vector").alias("vector")), corpus.select("id", filled("vector").alias("vector"))
    n = asked.count()
    if n <= few:
        found = best_of_partitions(asked, held, k + exclude_self, metric)
    else:
        nq, nv = -(-n // QUERY_BLOCK), max(1, -(-held.count() // VECTOR_BLOCK))
        each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        asked = asked.select(F.pmod(F.xxhash64("query"), F.lit(nq)).cast("int").alias("qb"), each(nv).alias("vb"), F.lit(True).alias("is_query"), F.col("query").alias("id"), "vector")
        held = held.select(F.pmod(F.xxhash64("id"), F.lit(nv)).cast("int").alias("vb"), F.lit(False).alias("is_query"), "id", "vector")
        held = held.select(each(nq).alias("qb"), "vb", "is_query", "id", "vector")
        parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        found = best_of_blocks(asked.unionByName(held).repartition(parts, "qb", "vb"), k + exclude_self, metric)
        found = found.groupBy("query", "id").agg(F.max("score").alias("score"))
    if exclude_self:
        found = found.where("query <> id")
    return ranked(found, k)
