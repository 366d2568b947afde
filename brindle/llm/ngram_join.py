"""N-gram Jaccard join: MinHash LSH forest with exact verification (operator 1).

1. Every text is hashed to its set of five-word shingles. Documents of equal sets form a class; the rest works
   on one representative of each.
2. A forest of tries holds MinHash signatures: a tree's path is a sequence of MinHashes, and a representative stands in the node of each prefix
   of its path. Prefixes are shortened by what they match. The shortest are looked at first: where all nodes that a text shares at this length have few
   members, the prefix stays that short, and all members of these nodes are candidates. A text in a crowded node keeps a longer prefix, in more trees, and so
   on to the longest, whose nodes count whatever their size. Each length has as many trees as a pair just at the threshold needs to meet with the target
   recall, and a pair both of whose texts go on meets again at the next length; the misses of all lengths together stay within the target.
3. Each representative takes a home block: the least member it meets anywhere, split by hash when many share it. For
   each node that spans several blocks, a member is sent to each other block there; a text so travels once per block
   that holds candidates of it, not once per pair or per tree.
4. In each block, or pair of blocks, all similarities are counted exactly, by a sparse product of shingle incidences. Only counts of
   links and a spanning forest of them leave the task. Components of these give the groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.batches import slices, texts_of
from brindle.llm.shared import components, written

SHINGLE, THRESHOLD = 5, 0.8
#: Lengths of prefixes, members of a node that make it crowded for all but the longest, and recall of a pair at the threshold.
DEPTHS, CROWD, RECALL = (2, 4, 6), 8, 0.9995
#: Representatives in a block, and shingles of them, about: at most two blocks of texts meet in one group of rows.
BLOCK, BLOCK_SHINGLES = 2048, 1_000_000
BROADCAST_HOMES = 100_000
#: Bytes of text hashed at once; members of a shingle, and their share of a block, that are multiplied as a dense matrix from; pairs counted at once.
HASHED_BYTES, DENSE, DENSE_SHARE, PAIRS = 2_000_000, 24, 0.125, 250_000
#: Dense shingles, and rows of a matrix of pairs, that are worked on at once.
COLUMNS, STRIP = 512, 256

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True  # fixed: what parts words


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


#: A random 64-bit number for each byte, odd factors, and powers of an odd base with their inverses.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
PLACE = mix(np.arange(11, 11 + SHINGLE, dtype=np.uint64))
BASE = 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, by doubling."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    done, step = 1, base
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(step)
        done, step = done + more, step * step % (1 << 64)
    return out


def shingle_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): all shingles' hashes, with repeats, and where each text's end.

    Words are parted by ASCII white space. A text of one to four words has one shingle of all of them, a text of
    none has no shingle. A word's hash is a polynomial over its bytes; a shingle's hash mixes those of its words by place.
    """
    if not texts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    white = WHITE[data]
    inside = ~white
    starts = np.flatnonzero(inside & np.concatenate(([True], white[:-1])))
    stops = np.flatnonzero(white & np.concatenate(([False], inside[:-1])))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE[data] * powers(BASE, len(data)))))
    words = mix((sums[stops] - sums[starts]) * powers(INVERSE, len(data))[starts] + (stops - starts).astype(np.uint64))
    last_word = np.searchsorted(starts, ends)  # words before each text's end
    first_word = np.concatenate(([0], last_word[:-1]))
    counts = last_word - first_word
    many = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    ends_out = np.cumsum(many)
    # Shingle j of a text starts at its word j; short texts take the words they have.
    total = int(ends_out[-1])
    at = np.arange(total) - np.repeat(ends_out - many, many) + np.repeat(first_word, many)
    most = np.repeat(last_word, many)
    hashes = np.zeros(total, dtype=np.uint64)
    for k in range(SHINGLE):
        there = at + k < most
        word = words[np.minimum(at + k, max(len(words) - 1, 0))] if len(words) else np.zeros(total, np.uint64)
        hashes += np.where(there, mix(word + PLACE[k]), np.uint64(0))
    return mix(hashes), ends_out


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out, start, size = [], 0, 0
    for i, t in enumerate(texts + [b""]):
        size += len(t)
        if i == len(texts) or size > HASHED_BYTES:
            stop = i if i == len(texts) else i + 1
            hashes, ends = shingle_hashes(texts[start:stop])
            a = 0
            for b in ends.tolist():
                out.append(np.unique(hashes[a:b]))
                a = b
            start, size = stop, 0
    return out


def forest(threshold: float, recall: float, depths: tuple[int, ...] = DEPTHS) -> list[tuple[int, int]]:
    """(depth, trees) of each length of prefix: trees enough that a pair at the threshold fails to meet in all with its share of 1 - recall."""
    miss = (1 - recall) / len(depths)
    return [(k, max(1, math.ceil(math.log(miss) / math.log1p(-min(threshold**k, 1 - 1e-12))))) for k in depths]


def signatures(sets: list[np.ndarray], levels: list[tuple[int, int]]) -> list[np.ndarray]:
    """For each length of prefix, the node of each set in each tree; empty sets get what is to be left out.

    A node is the hash of the path to it, so that nodes of longer prefixes lie below those of shorter ones.
    """
    n, trees, deepest = len(sets), max(t for _, t in levels), max(k for k, _ in levels)
    # Trees that only deep prefixes need are walked to their depth; all walk from the root.
    factors = mix(np.arange(1, trees * deepest + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    least = np.zeros((n, trees * deepest), dtype=np.uint64)
    some = np.array([i for i, s in enumerate(sets) if len(s)], dtype=np.int64)
    at = 0
    while at < len(some):
        stop, size = at, 0
        while stop < len(some) and (stop == at or size + len(sets[some[stop]]) <= 16_384):
            size += len(sets[some[stop]])
            stop += 1
        rows = some[at:stop]
        flat = np.concatenate([sets[i] for i in rows])
        bounds = np.concatenate(([0], np.cumsum([len(sets[i]) for i in rows])[:-1]))
        for k in range(trees * deepest):
            least[rows, k] = np.minimum.reduceat(flat * factors[k], bounds)
        at = stop
    least = mix(least).reshape(n, trees, deepest)
    node, out = np.tile(np.arange(1, trees + 1, dtype=np.uint64), (n, 1)), {}
    for k in range(deepest):
        node = mix(node * np.uint64(0x9E3779B97F4A7C15) + least[:, :, k])
        out[k + 1] = node
    return [out[k][:, :t] for k, t in levels]


def set_key(hashes: np.ndarray) -> bytes | None:
    """128 bits that name a set; null for the empty one."""
    import hashlib

    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None


def signed(docs: DataFrame, id_column: str, text: str, levels: list[tuple[int, int]]) -> DataFrame:
    """(id, mark, node, size, level_0, level_1, ..) of each document: its text's hash, its shingle set's name and size, and its nodes in the trees, by length of prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                sets = shingle_sets(texts_of(part.column(2)))
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * x.shape[1], pa.int32()), pa.array(x.astype(np.int64).ravel())) for x in signatures(sets, levels)]
                columns = [part.column(0), part.column(1), pa.array([set_key(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), *lists]
                yield pa.RecordBatch.from_arrays(columns, ["id", "mark", "node", "size", *names])

    names = [f"level_{i}" for i in range(len(levels))]
    kind = docs.select(id_column).dtypes[0][1]
    schema = f"id {kind}, mark bigint, node binary, size bigint, " + ", ".join(f"{n} array<bigint>" for n in names)
    return docs.select(id_column, F.xxhash64(text).alias("mark"), text).mapInArrow(run, schema)


def candidates(classes: DataFrame, levels: int, crowd: int = CROWD) -> DataFrame:
    """(prefix, node, least) of the nodes of the tries whose members are candidates; ``least`` is the least member.

    Level by level, from the shortest prefixes: nodes with few members are taken, and those of a crowded one go on to longer prefixes. Counts
    are partial before they are shuffled, so that a crowded node is no task of its own.
    """
    met, left = None, classes
    for i in range(levels):
        places = left.select("node", F.explode(f"level_{i}").alias("prefix"))
        sizes = places.groupBy("prefix").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1")
        here = written(places.join(sizes, "prefix"))
        if i + 1 < levels:
            left = left.join(here.where(F.col("n") > crowd).select("node").distinct(), "node", "left_semi")
            here = here.where(F.col("n") <= crowd)
        here = here.select("prefix", "node", "least")
        met = here if met is None else met.unionByName(here)
    return met


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of all intersections: within ``left``, or of ``left`` with ``right``.

    Shingles that many members share are multiplied as dense columns, the others add up pair by pair of members.
    """
    sets = left + (right or [])
    n, split = len(sets), len(left) if right is not None else 0
    flat = np.concatenate(sets) if n else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    edge = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1]))) if len(flat) else np.empty(0, np.int64)
    size = np.diff(np.append(edge, len(flat)))
    # Rows are members of the left side, columns those of the right one, or the left again.
    counts = np.zeros((split or n, n - split), dtype=np.float32)
    most = max(DENSE, int(n * DENSE_SHARE))
    dense = np.flatnonzero(size >= most)
    for a in range(0, len(dense), COLUMNS):
        some = dense[a : a + COLUMNS]
        grid = np.zeros((n, len(some)), dtype=np.float32)
        where = np.concatenate([np.arange(edge[i], edge[i] + size[i]) for i in some])
        grid[owner[where], np.repeat(np.arange(len(some)), size[some])] = 1
        counts += grid[: split or n] @ grid[split:].T
    for m in np.unique(size[(size > 1) & (size < most)]).tolist():
        some = edge[size == m]
        i, j = np.triu_indices(m, 1)
        step = max(1, PAIRS // len(i))
        for a in range(0, len(some), step):
            members = owner[some[a : a + step, None] + np.arange(m)]
            # Members ascend within a shingle: the first of a pair is on the left where sides differ.
            x, y = members[:, i].ravel(), members[:, j].ravel()
            if split:
                across = (x < split) & (y >= split)
                x, y = x[across], y[across] - split
            np.add.at(counts, (x, y), 1)
            if not split:
                np.add.at(counts, (y, x), 1)
    return counts


def linked(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Whether each pair's exact similarity is at least the threshold; never a set with itself."""
    shared = overlaps(left, right)
    a = np.array([len(s) for s in left])
    b = a if right is None else np.array([len(s) for s in right])
    out = np.empty(shared.shape, dtype=bool)
    for at in range(0, len(a), STRIP):
        some = shared[at : at + STRIP].astype(np.float64)
        out[at : at + STRIP] = some >= threshold * (a[at : at + STRIP, None] + b[None, :] - some) - 1e-6
    if right is None:
        np.fill_diagonal(out, False)
    return out


def roots_of(matrix: np.ndarray) -> np.ndarray:
    """For a symmetric matrix of links, the first member of each member's component."""
    n = len(matrix)
    root = np.arange(n)
    while True:
        new = root.copy()
        for at in range(0, n, STRIP):
            new[at : at + STRIP] = np.minimum(new[at : at + STRIP], np.where(matrix[at : at + STRIP], root[None, :], n).min(axis=1))
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def verify(members: DataFrame, threshold: float) -> DataFrame:
    """(node, rep, root, root_rep, links) from (group, side, node, rep, weight, text) rows: links that a group of rows shows.

    ``side`` is 0, 1 or null; null for rows of one block, all of whose pairs count, else the pairs across sides count.
    """

    def found(group: list[tuple]) -> Iterator[tuple]:
        held = {}
        for _, side, node, rep, weight, text in group:
            held.setdefault((side or 0, node), (weight, text, side, rep))
        keys = list(held)
        if len(keys) < 2:
            return
        sets = shingle_sets([held[k][1] for k in keys])
        weights = np.array([held[k][0] for k in keys], dtype=np.int64)
        if any(held[k][2] is None for k in keys):
            links = linked(sets, None, threshold)
        else:
            cut = [i for i, k in enumerate(keys) if k[0] == 0], [i for i, k in enumerate(keys) if k[0] == 1]
            if not cut[0] or not cut[1]:
                return
            links = np.zeros((len(keys), len(keys)), dtype=bool)
            links[np.ix_(*cut)] = linked([sets[i] for i in cut[0]], [sets[i] for i in cut[1]], threshold)
            links |= links.T
        root, counts = roots_of(links), np.concatenate([links[at : at + STRIP] @ weights for at in range(0, len(keys), STRIP)])
        for i in np.flatnonzero(links.any(axis=1)):
            own, up = keys[i], keys[root[i]]
            yield own[1], held[own][3], up[1], held[up][3], int(counts[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        out: list[tuple] = []
        rep_type = None

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.binary(), rep_type, pa.binary(), rep_type, pa.int64())
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["node", "rep", "root", "root_rep", "links"])
            out.clear()
            return made

        for batch in batches:
            rep_type = batch.column(3).type
            columns = [c.cast(pa.binary()).to_pylist() if i == 5 else c.to_pylist() for i, c in enumerate(batch.columns)]
            for row in zip(*columns, strict=True):
                if group and group[0][0] != row[0]:
                    out += found(group)
                    group = []
                group.append(row)
            if len(out) > 20_000:
                yield batch_of()
        if group:
            out += found(group)
        if out:
            yield batch_of()

    kind = dict(members.dtypes)["rep"]
    return members.sortWithinPartitions("group").mapInArrow(run, f"node binary, rep {kind}, root binary, root_rep {kind}, links bigint")


def meetings(met: DataFrame, classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(node, group, side): where each candidate's text is sent, so that it meets its candidates: a block, or a pair of blocks of which it is in one.

    A home of n members has n / ``block`` blocks, or more for long texts, and each member goes to all of these.
    """
    homes = met.groupBy("node").agg(F.min("least").alias("home")).join(classes.select("node", "size"), "node")
    sizes = homes.groupBy("home").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    cuts = F.ceil(F.greatest(F.col("n") / block, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    part = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")
    # Most homes are one block. Those of several are at most one in a block's number of members, and are broadcast if few.
    several = written(sizes.select("home", cuts.alias("cuts")).where("cuts > 1"))
    few = F.broadcast(several) if several.count() <= BROADCAST_HOMES else several
    homes = homes.join(few, "home", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    homes = written(homes.select("node", "home", part.alias("part"), F.col("cuts").alias("parts"), F.xxhash64("home", part).alias("block")))
    # All parts of one home meet; other homes meet where a prefix has members of several.
    within = homes.select("node", "home", "part", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p")).select("node", "block", F.xxhash64("home", "p").alias("other"))
    inside = met.join(homes, "node").select("prefix", "node", "home", "block")
    spans = inside.groupBy("prefix").agg(F.min("home").alias("a"), F.max("home").alias("b")).where("a <> b").select("prefix")
    wide = written(inside.join(spans, "prefix"))
    others = wide.select("prefix", F.col("home").alias("other_home"), F.col("block").alias("other")).distinct()
    across = wide.join(others, "prefix").where("home <> other_home").select("node", "block", "other").distinct()
    low, high, same = F.least("block", "other"), F.greatest("block", "other"), F.col("block") == F.col("other")
    return within.unionByName(across).select("node", F.when(same, F.col("block")).otherwise(F.xxhash64(low, high)).alias("group"), F.when(~same, F.when(F.col("block") < F.col("other"), 0).otherwise(1)).alias("side"))


def bodies_of(owners: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, rep, weight, text) of each owner, once however often its row is repeated. The join's own partitioning serves to drop the repeats."""
    return owners.join(docs, ["rep", "mark"]).dropDuplicates(["rep", "mark"]).select("node", "rep", "weight", "text")


def ngram_jaccard_join(docs: DataFrame, id_column: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, crowd: int = CROWD, block: int = BLOCK, with_groups: bool = False) -> DataFrame:
    """(id, class_id, n_links) of every document; ``with_groups`` adds mark, its text's hash, and group, which names the linked rows.

    ``n_links`` is the number of other documents whose sets of five-word shingles have a Jaccard similarity of at least
    ``threshold``; ``class_id`` is the least id reached over such links, its own without any. Texts without a word, null ones too, link with
    nothing. A row with a null id links with nothing and has a null class. Repeated rows count as documents of their own, so that each
    has the others as links. An id may stand on rows of different texts: each row has its own text's links and group. Other columns are not read; an empty table gives no row.
    """
    levels = forest(threshold, recall)
    names = [f"level_{i}" for i in range(len(levels))]
    sign = written(signed(docs.where(F.col(id_column).isNotNull()), id_column, text, levels))
    grouped = sign.where("node is not null").groupBy("node").agg(F.min(F.struct("id", "mark")).alias("rep"), F.count("*").alias("weight"), F.first("size").alias("size"), *(F.first(n).alias(n) for n in names))
    classes = written(grouped.select("node", F.col("rep.id").alias("rep"), F.col("rep.mark").alias("mark"), "weight", "size", *names))
    met = candidates(classes, len(levels), crowd)
    sent = meetings(met, classes, block)
    owners = met.select("node").distinct().join(classes.select("node", "rep", "mark", "weight"), "node")
    # The mark picks the class's own text where its id stands on other texts too.
    bodies = bodies_of(owners, docs.select(F.col(id_column).alias("rep"), F.xxhash64(text).alias("mark"), F.col(text).alias("text")))
    rows = sent.join(bodies, "node").select("group", "side", "node", "rep", "weight", "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = written(verify(rows.repartition(parts, "group"), threshold))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    # A component is named by its least member, which is the one of the least id: no join on the component is needed, whose rows may be a third of all.
    named = lambda rep, node: F.struct(F.col(rep).alias("rep"), F.col(node).alias("node"))
    groups = components(found.select(named("rep", "node").alias("a"), named("root_rep", "root").alias("b"))).select("node.node", F.col("component.rep").alias("class_id"), F.col("component.node").alias("component"))
    of_node = classes.select("node", "rep", "weight").join(counts, "node", "left").join(groups, "node", "left")
    of_node = of_node.select("node", F.coalesce("component", "node").alias("group"), F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    # Rows without a shingle set are not joined: many of them would meet on null.
    more = ["mark", "group"] if with_groups else []
    none, no_group = F.lit(0).cast("bigint").alias("n_links"), F.lit(None).cast("binary").alias("group")
    out = sign.where("node is not null").select("id", "mark", "node").join(of_node, "node").select(F.col("id").alias(id_column), "class_id", "n_links", *more)
    alone = sign.where("node is null").select(F.col("id").alias(id_column), F.col("id").alias("class_id"), none, "mark", no_group)
    nameless = docs.where(F.col(id_column).isNull()).select(id_column, F.col(id_column).alias("class_id"), none, F.xxhash64(text).alias("mark"), no_group)
    return out.unionByName(alone.select(*out.columns)).unionByName(nameless.select(*out.columns))
