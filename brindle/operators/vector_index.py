"""A kept index of vectors in lists around centres, that finds what was added later.

Centres are fitted once, to a bounded sample. A vector goes to the list of its nearest centre, with its distance to it, and has beside it a code: for each of
``parts`` runs of dimensions the number of the nearest of 256 typical values of what is left of the vector when the centre is taken away. ``create`` writes all vectors as a first segment of lists;
``sync`` adds a segment of what the index lacks and marks what is gone, so that old lists are never written again; ``compact`` makes one segment of many.

Three searches, by distance:

* ``nearest`` reads the lists whose centres are nearest to a query; with all lists it is exact.
* ``nearest_exact`` reads what it must: no vector of a list is nearer than the query's distance to the centre less the list's radius. The k-th
  distance in the nearest lists, which holds for the rest too, leaves those lists that reach into it; and of these the vectors whose distance to the centre allows it.
* ``nearest_by_codes`` compares codes, by tables of each query's distances to the typical values, and takes the exact distances of the best few only.

Rows of the corpus that no segment has yet are searched beside the lists where the corpus is given. A segment counts once its last file is there; one writer at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.operators.neighbours import QUERY_BLOCK, VECTOR_BLOCK, best_of_blocks, filled, matrix, nearest, ranked
from brindle.sources.files import children, kept, present

#: Rows that centres and typical values are fitted to, about; runs of dimensions of a code, and typical values of each.
SAMPLE_ROWS, PARTS, TYPICAL = 50_000, 16, 256
#: Candidates by code for each neighbour asked for; vectors in a file, about; candidate ids that are looked up by value.
RESCORED, FILE_ROWS, LITERALS = 10, 500_000, 2_000
#: How far bounds may be off by rounding.
SLACK = 1e-6
#: Distances that a task holds at once.
CELLS = 250_000


def nearest_value(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The number of the nearest value of each row; a strip of rows meets all values at a time."""
    square, step = (values**2).sum(axis=1), max(1, CELLS // len(values))
    return np.concatenate([np.zeros(0, np.int64), *((square - 2 * rows[at : at + step] @ values.T).argmin(axis=1) for at in range(0, len(rows), step))])


def typical_values(rows: np.ndarray, n: int, seed: int, rounds: int = 12) -> np.ndarray:
    """(n, width) values that rows lie near to, by Lloyd's method from random rows; of fewer distinct rows these."""
    rows = rows.astype(np.float64)
    distinct = np.unique(rows, axis=0)
    if len(distinct) <= n:
        return np.vstack([distinct, np.repeat(distinct[-1:], n - len(distinct), axis=0)])
    rng = np.random.default_rng(seed)
    values = distinct[rng.choice(len(distinct), n, replace=False)]
    for _ in range(rounds):
        place = nearest_value(rows, values)
        size = np.bincount(place, minlength=n)
        sums = np.stack([np.bincount(place, weights=c, minlength=n) for c in rows.T], axis=1)
        values = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], values)
    return values


def cut(width: int, parts: int) -> list[tuple[int, int]]:
    """Runs of dimensions, of sizes as equal as can be."""
    edges = [width * i // parts for i in range(parts + 1)]
    return [(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]


@dataclass(frozen=True)
class Fitted:
    """Centres, and for each run of dimensions its typical values."""

    centres: np.ndarray
    books: list[np.ndarray]

    @property
    def runs(self) -> list[tuple[int, int]]:
        return cut(self.centres.shape[1], len(self.books))

    def placed(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, distance to its centre, code) of each vector."""
        lists = nearest_value(vectors, self.centres)
        rest = vectors - self.centres[lists]
        codes = np.stack([nearest_value(rest[:, x:y], b) for (x, y), b in zip(self.runs, self.books, strict=True)], axis=1)
        return lists, np.sqrt((rest**2).sum(axis=1)), codes.astype(np.uint8)


@dataclass(frozen=True)
class VectorIndex:
    """``fitted`` (list_id, part, value) with centres and typical values, ``lists`` (id, gap, code, vector) by segment and list, ``marks`` (id) of what is gone, ``sizes`` (list_id, n, radius)."""

    spark: SparkSession
    path: str

    def _whole(self, kind: str) -> list[int]:
        return [n for n in children(self.spark, f"{self.path}/{kind}", "segment=") if present(self.spark, f"{self.path}/{kind}/segment={n}/_SUCCESS")]

    def segments(self) -> list[int]:
        """Those that count: whole ones, from the last that ``compact`` made on."""
        done = self._whole("sizes")
        least = max(self._whole("compacted"), default=0)
        return [n for n in done if n >= least]

    def exists(self) -> bool:
        return bool(self.segments())

    def fitted(self) -> Fitted:
        # As many rows as lists and typical values.
        rows = self.spark.read.parquet(f"{self.path}/fitted").orderBy("part", "number").collect()
        books = sorted({r["part"] for r in rows} - {-1})
        of = lambda p: np.array([r["value"] for r in rows if r["part"] == p])
        return Fitted(of(-1), [of(p) for p in books])

    def centres(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/fitted").where("part = -1").select(F.col("number").alias("list_id"), F.col("value").alias("centre"))

    def _read(self, kind: str, *columns: str) -> DataFrame:
        rows = self.spark.read.option("basePath", f"{self.path}/{kind}").parquet(*(f"{self.path}/{kind}/segment={n}" for n in self.segments()))
        return rows.select(*columns) if columns else rows

    def _marks(self) -> DataFrame | None:
        done = self._whole("marks")
        if not done:
            return None
        return self.spark.read.option("basePath", f"{self.path}/marks").parquet(*(f"{self.path}/marks/segment={n}" for n in done)).groupBy(F.col("id").alias("_id")).agg(F.max("segment").alias("_until"))

    def lists(self, *columns: str) -> DataFrame:
        """Rows of all segments that are not gone: those of an id that was marked, in segments before the mark, are."""
        marks = self._marks()
        rows = self._read("lists")
        if marks is not None:
            rows = rows.join(marks, (F.col("id") == F.col("_id")) & (F.col("segment") < F.col("_until")), "left_anti")
        return rows.select(*columns) if columns else rows

    def sizes(self) -> DataFrame:
        """(list_id, n, radius) over all segments; what is gone still counts, so that a radius is never too small."""
        return self._read("sizes").groupBy("list_id").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"))

    def create(self, corpus: DataFrame, lists: int, parts: int = PARTS, sample_rows: int = SAMPLE_ROWS, seed: int = 11) -> bool:
        """Builds the index of (id, vector) rows unless there is one; tells whether it did. A corpus without rows is an error: there is nothing to fit.

        Centres and typical values are fitted to about ``sample_rows``; every row is put into a list.
        """
        if self.exists():
            return False
        rows = corpus.select("id", filled("vector").alias("vector"))
        share = min(1.0, sample_rows / max(1, rows.count()))
        draw = F.pmod(F.xxhash64("id"), F.lit(1 << 53)).cast("double")
        sample = kept(rows.where(draw < share * (1 << 53)))
        if sample.isEmpty():
            raise ValueError("there are no vectors to fit an index to")
        model = KMeans(k=lists, seed=seed, maxIter=10, featuresCol="features").fit(sample.withColumn("features", array_to_vector("vector")))
        centres = np.array(model.clusterCenters())
        shared = self.spark.sparkContext.broadcast(Fitted(centres, []))
        runs = cut(centres.shape[1], parts)

        def rests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors = matrix(batch.column(0), batch.num_rows)
                own = shared.value.centres
                rest = vectors - own[nearest_value(vectors, own)]
                for p, (a, b) in enumerate(runs):
                    offsets = pa.array(np.arange(len(rest) + 1) * (b - a), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rest), p, np.int32)), pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(rest[:, a:b]).ravel()))], ["part", "value"])

        def book(group: pa.Table) -> pa.Table:
            part = group["part"][0].as_py()
            values = typical_values(matrix(group["value"].combine_chunks(), len(group)), TYPICAL, seed + part)
            number = np.arange(len(values), dtype=np.int32)
            return pa.table({"part": np.full_like(number, part), "number": number, "value": pa.array(values.tolist(), pa.list_(pa.float64()))})

        # One run of the bounded sample a group; a table of their own, so that groups are not made by the one task that writes the file.
        schema = "part int, number int, value array<double>"
        dealt = sample.select("vector").mapInArrow(rests, "part int, value array<double>").repartition(len(runs), "part")
        books = kept(dealt.groupBy("part").applyInArrow(book, schema))
        number = np.arange(len(centres), dtype=np.int32)
        middle = self.spark.createDataFrame(pa.table({"part": np.full_like(number, -1), "number": number, "value": pa.array(centres.tolist(), pa.list_(pa.float64()))}), schema)
        middle.unionByName(books).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/fitted")
        self._add(rows, 0)
        return True

    def _add(self, rows: DataFrame, number: int) -> None:
        shared = self.spark.sparkContext.broadcast(self.fitted())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists, gaps, codes = shared.value.placed(matrix(batch.column(1), batch.num_rows))
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), batch.column(0), pa.array(gaps), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(1)], ["list_id", "id", "gap", "code", "vector"])

        placed = kept(rows.select("id", "vector").mapInArrow(run, "list_id int, id bigint, gap double, code binary, vector array<double>"))
        sizes = kept(placed.groupBy("list_id").agg(F.count("*").alias("n"), F.max("gap").alias("radius")))
        # A list is a file, or several of about FILE_ROWS; the rows of a file are in order of id.
        dealt = placed.join(F.broadcast(sizes.select("list_id", F.ceil(F.col("n") / FILE_ROWS).cast("int").alias("files"))), "list_id").withColumn("file", F.pmod(F.xxhash64("id"), "files")).drop("files")
        dealt.repartition("list_id", "file").sortWithinPartitions("list_id", "id").drop("file").write.mode("overwrite").partitionBy("list_id").parquet(f"{self.path}/lists/segment={number}")
        sizes.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/sizes/segment={number}")

    def _next(self) -> int:
        return max([*self._whole("sizes"), *self._whole("marks"), *self._whole("compacted")]) + 1

    def sync(self, corpus: DataFrame) -> tuple[int, int]:
        """(vectors added, vectors marked as gone), so that the index has the ids that the corpus has. Ids alone are compared, and vectors of new ones read."""
        own = self.lists("id")
        gone = kept(own.join(corpus.select("id"), "id", "left_anti"))
        new = kept(corpus.select("id").distinct().join(own, "id", "left_anti"))
        n_gone, n_new = gone.count(), new.count()
        if n_gone:
            gone.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/marks/segment={self._next()}")
        if n_new:
            self._add(corpus.join(new, "id", "left_semi").select("id", filled("vector").alias("vector")), self._next())
        return n_new, n_gone

    def compact(self) -> int:
        """One segment of all rows that are not gone, in place of several; the number of segments that it took in."""
        old = self.segments()
        if len(old) > 1 or self._whole("marks"):
            number = self._next()
            self._add(self.lists("id", "vector"), number)
            self.spark.range(1).write.mode("overwrite").parquet(f"{self.path}/compacted/segment={number}")
        return len(old)

    def _distances(self, queries: DataFrame) -> DataFrame:
        """(query, vector, list_id, d) of each query to each centre; the centres are as many as the lists, a small table."""
        gap = F.sqrt(F.aggregate(F.zip_with("vector", "centre", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
        return queries.select("query", filled("vector").alias("vector")).crossJoin(F.broadcast(self.centres())).select("query", "vector", "list_id", gap.alias("d"))

    def _met(self, asked: DataFrame, k: int) -> DataFrame:
        """(query, id, score): the best k in each list that a query (query, list_id, vector) is put to. Only the folders of such lists are read; a block of queries meets a slice of a list at a time."""
        dealt = self._dealt(asked)
        deal = lambda part: F.xxhash64("list_id", part)
        asked = asked.join(dealt, "list_id").withColumn("block", F.pmod(F.xxhash64("query"), "blocks").cast("int"))
        asked = asked.select(deal("block").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("vb"), F.lit(True).alias("is_query"), F.col("query").alias("id"), "vector")
        held = self.lists("list_id", "id", "vector").join(dealt, "list_id").withColumn("vb", F.pmod(F.xxhash64("id"), "slices").cast("int"))
        held = held.select("list_id", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "vb", "id", "vector").select(deal("block").alias("qb"), "vb", F.lit(False).alias("is_query"), "id", "vector")
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return best_of_blocks(asked.unionByName(held).repartition(parts, "qb", "vb"), k, "l2")

    def _dealt(self, asked: DataFrame) -> DataFrame:
        """(list_id, slices, blocks) of the lists that queries (query, list_id) are put to: into how many slices of vectors and blocks of queries each is dealt. As many rows as lists."""
        blocks = asked.groupBy("list_id").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
        return F.broadcast(kept(self.sizes().join(blocks, "list_id").select("list_id", F.ceil(F.col("n") / VECTOR_BLOCK).cast("int").alias("slices"), "blocks")))

    def _tail(self, queries: DataFrame, corpus: DataFrame | None, k: int) -> DataFrame | None:
        """The nearest of what the corpus has and no segment."""
        if corpus is None:
            return None
        return nearest(queries, corpus.join(self.lists("id"), "id", "left_anti"), k).select("query", "id", "score")

    def _best(self, found: DataFrame, tail: DataFrame | None, k: int) -> DataFrame:
        rows = found if tail is None else found.unionByName(tail)
        return ranked(rows.groupBy("query", "id").agg(F.max("score").alias("score")), k)

    def nearest(self, queries: DataFrame, k: int, probes: int, corpus: DataFrame | None = None) -> DataFrame:
        """(query, id, score, rank) like ``neighbours.nearest`` by distance, over the ``probes`` lists of the nearest centres; all lists give the exact result.

        With a corpus its rows that the index lacks are searched too; what is gone from it is found until ``sync``.
        """
        order = F.row_number().over(Window.partitionBy("query").orderBy("d", "list_id"))
        near = self._distances(queries).withColumn("n", order).where(F.col("n") <= probes)
        return self._best(self._met(near.select("query", "list_id", "vector"), k), self._tail(queries, corpus, k), k)

    def reach(self, queries: DataFrame, k: int) -> DataFrame:
        """(query, vector, list_id, d, n, radius, read, first): the lists in which a query's k nearest may be.

        First come the nearest lists that have k vectors together. The k-th distance there bounds that of all, and a list is read if its radius reaches inside.
        """
        lists = self._distances(queries).join(F.broadcast(self.sizes()), "list_id")
        before = F.coalesce(F.sum("n").over(Window.partitionBy("query").orderBy("d", "list_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        lists = kept(lists.withColumn("first", before < k))
        best = ranked(self._met(lists.where("first").select("query", "list_id", "vector"), k).groupBy("query", "id").agg(F.max("score").alias("score")), k)
        bound = best.where(F.col("rank") == k).select("query", F.sqrt(F.greatest(-F.col("score"), F.lit(0.0))).alias("bound"))
        judged = lists.join(bound, "query", "left")
        return judged.withColumn("read", F.col("first") | F.col("bound").isNull() | (F.col("d") - F.col("radius") <= F.col("bound") + SLACK))

    def nearest_exact(self, queries: DataFrame, k: int, corpus: DataFrame | None = None, with_report: bool = False) -> DataFrame | tuple[DataFrame, DataFrame]:
        """(query, id, score, rank), as ``neighbours.nearest`` by distance gives it, from the lists that ``reach`` leaves. ``with_report`` adds (query, lists, lists_read, vectors, vectors_read)."""
        judged = kept(self.reach(queries, k))
        out = self._best(self._met(judged.where("read").select("query", "list_id", "vector"), k), self._tail(queries, corpus, k), k)
        if not with_report:
            return out
        read = F.col("read").cast("int")
        return out, judged.groupBy("query").agg(F.count("*").alias("lists"), F.sum(read).alias("lists_read"), F.sum("n").alias("vectors"), F.sum(read * F.col("n")).alias("vectors_read"))

    def nearest_by_codes(self, queries: DataFrame, k: int, probes: int, rescored: int = RESCORED, corpus: DataFrame | None = None) -> DataFrame:
        """(query, id, score, rank): of the nearest ``probes`` lists, the ``k * rescored`` best by codes, and of these the nearest k by their vectors.

        A code is one byte a run of dimensions: of 64 dimensions in 16 runs a search reads 24 bytes a vector with its id, not 520. Candidates' vectors are then read
        from their lists, by id where these are few.
        """
        order = F.row_number().over(Window.partitionBy("query").orderBy("d", "list_id"))
        near = kept(self._distances(queries).withColumn("n", order).where(F.col("n") <= probes).select("query", "list_id", "vector"))
        candidates = kept(ranked(self._coded(near, k * rescored), k * rescored).select("query", "id", "list_id"))
        held = self.lists("list_id", "id", "vector")
        wanted = candidates.select("list_id", "id").distinct()
        few = [r["id"] for r in wanted.select("id").limit(LITERALS + 1).collect()]
        if len(few) <= LITERALS:
            held = held.where(F.col("id").isin(few))
        vectors = held.join(wanted, ["list_id", "id"], "left_semi").select("id", F.col("vector").alias("held"))
        square = F.aggregate(F.zip_with("held", "vector", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
        asked = near.select("query", "vector").dropDuplicates(["query"])
        found = candidates.join(vectors, "id").join(asked, "query").select("query", "id", (-F.round(square, 9)).alias("score"))
        return self._best(found, self._tail(queries, corpus, k), k)

    def _coded(self, near: DataFrame, k: int) -> DataFrame:
        """(query, list_id, id, score): of each probed list's slice the best k by codes, for each query put to the list."""
        shared = self.spark.sparkContext.broadcast(self.fitted())
        dealt, none = self._dealt(near), F.lit(None)
        asked = near.join(dealt, "list_id").withColumn("block", F.pmod(F.xxhash64("query"), "blocks").cast("int"))
        asked = asked.select("list_id", "block", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(0).alias("kind"), F.col("query").alias("id"), "vector", none.cast("binary").alias("code"))
        held = self.lists("list_id", "id", "code").join(dealt, "list_id").withColumn("slice", F.pmod(F.xxhash64("id"), "slices").cast("int"))
        held = held.select("list_id", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "slice", F.lit(1).alias("kind"), "id", none.cast("array<double>").alias("vector"), "code")

        def best(group: pa.Table) -> pa.Table:
            own = shared.value
            kind, ids = group["kind"].to_numpy(), group["id"].to_numpy()
            asked, codes = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
            if not len(asked) or not len(codes):
                return pa.table({c: pa.array([], t) for c, t in (("query", pa.int64()), ("list_id", pa.int32()), ("id", pa.int64()), ("score", pa.float64()))})
            list_id = group["list_id"][0].as_py()
            table = np.frombuffer(b"".join(group["code"].take(pa.array(codes)).to_pylist()), np.uint8).reshape(len(codes), -1)
            rest = np.array(group["vector"].take(pa.array(asked)).to_pylist()) - own.centres[list_id]
            few, out = min(k, len(codes)), []
            for q, r in zip(ids[asked], rest, strict=True):
                square = np.zeros(len(codes))
                for p, ((a, b), values) in enumerate(zip(own.runs, own.books, strict=True)):
                    square += ((values - r[a:b]) ** 2).sum(axis=1)[table[:, p]]
                top = np.lexsort((ids[codes], square))[:few]
                out.append((np.full(few, q), ids[codes][top], -square[top]))
            query, found, score = (np.concatenate(x) for x in zip(*out, strict=True))
            return pa.table({"query": query, "list_id": pa.array(np.full(len(query), list_id), pa.int32()), "id": found, "score": score})

        return asked.unionByName(held).groupBy("list_id", "block", "slice").applyInArrow(best, "query bigint, list_id int, id bigint, score double")
