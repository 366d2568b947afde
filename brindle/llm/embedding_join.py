"""Embedding near-duplicates by an epsilon grid order join (operator 5).

Vectors of unit length with a cosine of at least t are no farther apart than epsilon = sqrt(2 - 2 t). They are turned to
their principal axes, and sorted by the cells of a grid of side epsilon on the leading ones. The sorted sequence is
cut into blocks and these into intervals; trees of intervals hold bounding boxes on the leading axes, and of the length that is left on all others. The join descends
from the pair (root, root): a pair of intervals goes on to the pairs of its parts unless their boxes are farther apart than epsilon,
which proves all their vectors to be. Spark descends to pairs of blocks, and a task from each of these to its smallest intervals, which are compared exactly, in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from brindle.llm.shared import components, written

COSINE = 0.95
#: Leading axes of the grid and of the boxes, most and fewest vectors in a block, blocks that small data gets, and intervals that make the next one up.
GRID_AXES, BOX_AXES, BLOCK, LEAST_BLOCK, BLOCKS, FAN = 6, 16, 4096, 64, 8, 8
#: Vectors in the smallest interval, and the share of its pairs from which a pair of blocks is multiplied as a whole.
LEAF, WHOLE = 32, 0.5
#: Products in single precision are off by less than this; what passes is computed again in double.
SLACK = 1e-4


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    """Rows of doubles from a column of equally long arrays."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def unit(rows: np.ndarray) -> np.ndarray:
    # Scaling by the largest component first keeps squares of very large and very small numbers in range.
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def principal_axes(nodes: DataFrame, width: int) -> np.ndarray:
    """All axes, leading first, from sums over all vectors; width squared numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1))
        for batch in batches:
            rows = unit(matrix_of(batch.column(0), width)) if batch.num_rows else np.zeros((0, width))
            rows = np.hstack([rows, np.ones((len(rows), 1))])
            total += rows.T @ rows
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int64()), pa.array(flat)], ["at", "value"])

    sums = nodes.select("vector").mapInArrow(run, "at bigint, value double").groupBy("at").agg(F.sum("value").alias("value"))
    total = np.zeros((width + 1) ** 2)
    for row in sums.collect():
        total[row["at"]] = row["value"]
    total = total.reshape(width + 1, width + 1)
    n = max(total[-1, -1], 1.0)
    mean = total[-1, :-1] / n
    return np.linalg.eigh(total[:-1, :-1] / n - np.outer(mean, mean))[1][:, ::-1]


def placed_on(axes: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Places of unit vectors on the leading axes, and as one more the length that is left on all others."""
    place = vectors @ axes[:, : min(BOX_AXES, axes.shape[1])]
    return np.hstack([place, np.sqrt(np.maximum(0, 1 - (place * place).sum(axis=1, keepdims=True)))])


def in_grid_order(nodes: DataFrame, width: int, axes: np.ndarray, epsilon: float, block: int) -> DataFrame:
    """(block, node, least, weight, vector, place): consecutive blocks of the sequence sorted by grid cells."""
    gridded = min(GRID_AXES, width)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            place = placed_on(axes, unit(matrix_of(batch.column(3), width)))
            cells = np.floor(place[:, :gridded] / epsilon).astype(np.int32)
            lists = [pa.array(list(x), t) for x, t in ((cells, pa.list_(pa.int32())), (place, pa.list_(pa.float64())))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], ["node", "least", "weight", "vector", "cells", "place"])

    kinds = dict(nodes.dtypes)
    cells = [F.col("cells")[i] for i in range(gridded)]
    # Inside a cell the leading coordinates and then the node order the sequence: a crowded cell is cut too.
    order = [*cells, F.col("place")[0], F.col("node")]
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(nodes.select("node", "least", "weight", "vector").mapInArrow(project, f"node bigint, least {kinds['least']}, weight bigint, vector {kinds['vector']}, cells array<int>, place array<double>"))
    ordered = written(placed.repartitionByRange(parts, *order).select(F.spark_partition_id().alias("part"), "*"))
    bases = ordered.groupBy("part").agg(F.count("*").alias("n")).withColumn("base", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    at = F.col("base") + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    # One row a part is broadcast.
    numbered = ordered.join(F.broadcast(bases.select("part", "base")), "part").withColumn("block", F.floor(at / block).cast("bigint"))
    return written(numbered.select("block", "node", "least", "weight", "vector", "place"))


def near_blocks(blocks: DataFrame, axes: int, epsilon: float) -> DataFrame:
    """(a, b), a <= b: pairs of blocks whose boxes are within epsilon, found by descent from the whole sequence."""
    low = [F.min(F.col("place")[i]).alias(f"l{i}") for i in range(axes)]
    high = [F.max(F.col("place")[i]).alias(f"h{i}") for i in range(axes)]
    boxes = written(blocks.groupBy("block").agg(*low, *high))
    last = boxes.agg(F.max("block")).first()[0] or 0
    levels, n = 0, last + 1
    while n > 1:
        levels, n = levels + 1, -(-n // FAN)
    columns = [f"{k}{i}" for k in "lh" for i in range(axes)]
    pairs = boxes.sparkSession.range(1).select(F.col("id").alias("a"), F.col("id").alias("b"))
    for level in range(levels - 1, -1, -1):
        here = boxes.groupBy(F.floor(F.col("block") / FAN**level).cast("bigint").alias("at")).agg(*(F.min(f"l{i}").alias(f"l{i}") for i in range(axes)), *(F.max(f"h{i}").alias(f"h{i}") for i in range(axes)))
        here = here.withColumn("up", F.floor(F.col("at") / FAN).cast("bigint"))
        side = lambda name: here.select(*(F.col(c).alias(f"{name}_{c}") for c in ("at", "up", *columns)))  # noqa: E731, B023
        gap = [F.greatest(F.lit(0.0), F.col(f"x_l{i}") - F.col(f"y_h{i}"), F.col(f"y_l{i}") - F.col(f"x_h{i}")) for i in range(axes)]
        near = sum((g * g for g in gap), F.lit(0.0)) <= epsilon * epsilon + 1e-9
        pairs = pairs.join(side("x"), F.col("a") == F.col("x_up")).join(side("y"), F.col("b") == F.col("y_up")).where((F.col("x_at") <= F.col("y_at")) & near).select(F.col("x_at").alias("a"), F.col("y_at").alias("b"))
    return pairs


def close_pairs(left: np.ndarray, right: np.ndarray, left_place: np.ndarray, right_place: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of pairs of unit rows with at least this cosine, in double precision.

    The product of two places bounds the cosine from above: on the leading axes it is exact, and on all others no more than the product of the lengths left there.
    """
    found, right_place = [], right_place.astype(np.float32).T
    for a in range(0, len(left), 1024):
        i, j = np.nonzero(left_place[a : a + 1024].astype(np.float32) @ right_place >= cosine - SLACK)
        if len(i):
            i = i + a
            keep = np.concatenate([(left[i[k : k + 100_000]] * right[j[k : k + 100_000]]).sum(axis=1) >= cosine for k in range(0, len(i), 100_000)])
            found.append((i[keep], j[keep]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def roots_of(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The first member of each member's component, for links (i, j)."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def boxes_of(place: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Least and greatest places of consecutive intervals, level by level: LEAF rows each, then FAN intervals each, up to one."""
    starts = np.arange(0, len(place), LEAF)
    levels = [(np.minimum.reduceat(place, starts), np.maximum.reduceat(place, starts))]
    while len(levels[-1][0]) > 1:
        low, high = levels[-1]
        starts = np.arange(0, len(low), FAN)
        levels.append((np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)))
    return levels


def near_leaves(left: list, right: list, epsilon: float, same: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of smallest intervals whose boxes are within epsilon, by descent from the pair of the whole: a pair that is farther apart has none below it.

    Of one block with itself (``same``) each pair comes once.
    """
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for level in range(max(len(left), len(right)) - 1, -1, -1):
        (l_low, l_high), (r_low, r_high) = left[min(level, len(left) - 1)], right[min(level, len(right) - 1)]
        near = np.zeros(len(i), dtype=bool)
        for at in range(0, len(i), 50_000):
            x, y = i[at : at + 50_000], j[at : at + 50_000]
            gap = np.maximum(0, np.maximum(l_low[x] - r_high[y], r_low[y] - l_high[x]))
            near[at : at + 50_000] = (gap * gap).sum(axis=1) <= epsilon * epsilon + 1e-9
        if same:
            near &= i <= j
        i, j = i[near], j[near]
        if level:
            (x, m), (y, n) = children(i, left, level), children(j, right, level)
            which = np.repeat(np.arange(len(i)), m * n)
            at = np.arange(len(which)) - np.repeat(np.cumsum(m * n) - m * n, m * n)
            i, j = x[which] + at // n[which], y[which] + at % n[which]
    return i, j


def children(nodes: np.ndarray, tree: list, level: int) -> tuple[np.ndarray, np.ndarray]:
    """First child and number of children of nodes of a level; a tree that is not so high has its root on all levels above."""
    if level >= len(tree):
        return nodes, np.ones(len(nodes), np.int64)
    return nodes * FAN, np.minimum(FAN, len(tree[level - 1][0]) - nodes * FAN)


def linked_pairs(left: np.ndarray, right: np.ndarray | None, axes: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of pairs of unit vectors with at least this cosine: of two blocks, or of one with itself, each pair once."""
    epsilon, same = math.sqrt(2 - 2 * cosine), right is None
    sides = []
    for vectors in (left,) if same else (left, right):
        place = placed_on(axes, vectors)
        cells = np.floor(place[:, :GRID_AXES] / epsilon)
        order = np.lexsort((place[:, 0], *cells.T[::-1]))
        sides.append((order, vectors[order], place[order], boxes_of(place[order])))
    (own, x, x_place, tree), (other, y, y_place, facing) = sides[0], sides[-1]
    i, j = near_leaves(tree, facing, epsilon, same)
    found = []
    if len(i) * (2 if same else 1) > WHOLE * len(tree[0][0]) * len(facing[0][0]):
        found.append(close_pairs(x, y, x_place, y_place, cosine))
    else:
        for leaf in np.unique(i):
            rows = np.concatenate([np.arange(k * LEAF, min((k + 1) * LEAF, len(y))) for k in j[i == leaf]])
            mine = slice(leaf * LEAF, (leaf + 1) * LEAF)
            a, b = close_pairs(x[mine], y[rows], x_place[mine], y_place[rows], cosine)
            found.append((a + leaf * LEAF, rows[b]))
    a, b = (np.concatenate([np.empty(0, np.int64), *(f[k] for f in found)]).astype(np.int64) for k in (0, 1))
    if same:
        a, b = a[a < b], b[a < b]
    return own[a], other[b]


def compare(rows: DataFrame, width: int, axes: np.ndarray, cosine: float) -> DataFrame:
    """(node, least, root, root_least, links) from (a, b, block, node, least, weight, vector): what each pair of blocks shows."""
    shared = rows.sparkSession.sparkContext.broadcast(axes)

    def found(group: list[pa.RecordBatch], a: int, b: int) -> pa.RecordBatch | None:
        whole = pa.Table.from_batches(group).combine_chunks()
        block, node, weight = (whole[c].to_numpy() for c in ("block", "node", "weight"))
        vectors = unit(matrix_of(whole["vector"].combine_chunks(), width))
        if a == b:
            i, j = linked_pairs(vectors, None, shared.value, cosine)
        else:
            first, second = np.flatnonzero(block == a), np.flatnonzero(block == b)
            if not len(first) or not len(second):
                return None
            i, j = linked_pairs(vectors[first], vectors[second], shared.value, cosine)
            i, j = first[i], second[j]
        if not len(i):
            return None
        i, j = np.concatenate([i, j]), np.concatenate([j, i])
        links = np.bincount(i, weights=weight[j], minlength=len(node)).astype(np.int64)
        root, some = roots_of(len(node), i, j), np.unique(i)
        least = whole["least"].combine_chunks()
        at, up = pa.array(some), pa.array(root[some])
        return pa.RecordBatch.from_arrays([pa.array(node[some]), least.take(at), pa.array(node[root[some]]), least.take(up), pa.array(links[some])], ["node", "least", "root", "root_least", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
            for start, stop in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                key = (int(a[start]), int(b[start]))
                if now is not None and key != now and (out := found(group, *now)):
                    yield out
                if key != now:
                    group, now = [], key
                group.append(batch.slice(start, stop - start))
        if now is not None and (out := found(group, *now)):
            yield out

    kind = dict(rows.dtypes)["least"]
    return rows.sortWithinPartitions("a", "b").mapInArrow(run, f"node bigint, least {kind}, root bigint, root_least {kind}, links bigint")


def embedding_near_dedup(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, block: int | None = None) -> DataFrame:
    """(id, n_links, component_id, kept) of each vector.

    Two vectors of one length link if their cosine, in double precision, is at least ``cosine``. Vectors that are null, empty, zero,
    or hold null or non-finite components link with nothing and are kept. Equal vectors are compared once and counted as often as
    they occur; a repeated row is another vector. ``component_id`` is the least id over links; a null id is nobody's component
    and is not kept. ``cosine`` is above 0 and below 1; equal vectors alone link at 1, which is no join. Other columns are not read; an empty table gives no row.
    """
    if not 0 < cosine < 1:
        raise ValueError("the least cosine is between 0 and 1")
    epsilon = math.sqrt(2 - 2 * cosine)
    sound = F.col("vector").isNotNull() & F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False)) & F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector).alias("vector")).withColumn("sound", F.coalesce(sound, F.lit(False)))
    nodes = written(rows.where("sound").groupBy("vector").agg(F.count("*").alias("weight"), F.min("id").alias("least")).withColumn("node", F.monotonically_increasing_id()))
    parts, kind = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), dict(nodes.dtypes)["least"]
    found = vectors.sparkSession.createDataFrame([], f"node bigint, least {kind}, root bigint, root_least {kind}, links bigint")
    # One row for each length that vectors have: usually one.
    for width, n in nodes.groupBy(F.size("vector").alias("n")).count().collect():
        own = nodes.where(F.size("vector") == width)
        axes = principal_axes(own, width)
        # Small data has several blocks too.
        blocks = in_grid_order(own, width, axes, epsilon, block or min(BLOCK, max(LEAST_BLOCK, -(-n // BLOCKS))))
        pairs = written(near_blocks(blocks, min(BOX_AXES, width) + 1, epsilon))
        ends = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
        sent = ends.join(blocks.select("block", "node", "least", "weight", "vector"), "block").select("a", "b", "block", "node", "least", "weight", "vector")
        found = found.unionByName(compare(sent.repartition(parts, "a", "b"), width, axes, cosine))
    found = written(found)
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    # A component is named by its least member, which is the one of the least id: so no join on the component is needed, whose rows may be a third of all.
    named = lambda least, node: F.struct(F.col(least).isNull().alias("none"), F.col(least).alias("least"), F.col(node).alias("node"))
    groups = components(found.select(named("least", "node").alias("a"), named("root_least", "root").alias("b"))).select(F.col("node.node").alias("node"), F.col("component.least").alias("component_id"))
    of_node = nodes.select("node", "vector", "weight", "least").join(counts, "node", "left").join(groups, "node", "left")
    of_node = of_node.select("vector", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    linked = rows.where("sound").join(of_node, "vector").select("id", "n_links", "component_id")
    alone = rows.where("not sound").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return linked.unionByName(alone).select(F.col("id").alias(id_column), "n_links", "component_id", kept.alias("kept"))
