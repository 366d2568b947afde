"""Line dedup by a sharded minimal perfect hash (operator 13).

1. A line's key is hashed to 128 bits. Each document gives the hashes of its distinct long lines; counts of documents and the largest
   document id are summed by hash, partially before the shuffle, so that a line of every document is no task of its own.
2. Hashes of lines in enough documents are dealt to shards of some ``SHARD_KEYS``. Each shard gets a minimal perfect hash: levels of bit
   arrays, in each of which the keys that fall on a bit alone are placed and the others go on to the next. A key's slot is the number of
   bits set before its own. Arrays by slot hold the second half of the hash as fingerprint, the count, and the document that keeps the line.
3. Documents probe the arrays where they are: hashes in, counts and keepers out, and lines leave the text. No line is joined. Where all arrays
   together are at most ``BROADCAST_BYTES`` every worker has them. Beyond, probes, which are hashes without text, stream past one shard at a
   time, and what they hit goes back to its document.

A line that is in no shard meets a slot all the same; it is taken for another only where 64 bits of fingerprint agree too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.batches import slices, texts_of
from brindle.llm.shared import written

LEAST_CHARS, LEAST_DOCS = 40, 5
#: Keys of a shard, about; bits of a level for each key that is left; bytes of all arrays up to which they are broadcast.
SHARD_KEYS, ROOM, BROADCAST_BYTES = 16_384, 1.5, 64 << 20
#: Fixed: what is stripped from a line's ends.
WHITE = b" \t\n\x0b\x0c\r"

ODD, M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def long_keys(lines: list[bytes], least_chars: int) -> list[bytes | None]:
    """Each line's key, stripped of ASCII white space and with A-Z lower-cased; null for one of fewer code points."""
    out: list[bytes | None] = []
    for line in lines:
        key = line.strip(WHITE)
        # Up to four bytes a code point: only lengths between need counting.
        enough = len(key) >= least_chars and (len(key) >= 4 * least_chars or len(key.decode("utf-8", "replace")) >= least_chars)
        out.append(key.lower() if enough else None)
    return out


def hashes(keys: list[bytes]) -> np.ndarray:
    """(n, 2) signed 64-bit halves of each key's hash."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), dtype="<i8").reshape(-1, 2)


def level_bits(high: np.ndarray, low: np.ndarray, level: int, sizes: np.ndarray | int) -> np.ndarray:
    """The bit of each key in a level of ``sizes`` bits. Both halves count, so that any two keys part in some level."""
    seed = np.uint64((level + 1) * int(ODD) % (1 << 64))
    x = mix(high.view(np.uint64) + seed) ^ mix(low.view(np.uint64) * M1 + np.uint64(level + 1))
    return (mix(x) % np.asarray(sizes, dtype=np.uint64)).astype(np.int64)


def built(high: np.ndarray, low: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(sizes of levels in bits, all levels' bits as 64-bit words, slot of each key) of distinct keys."""
    sizes, words, left, slots, placed = [], [], np.arange(len(high)), np.empty(len(high), np.int64), 0
    while len(left):
        size = max(1, -(-int(ROOM * len(left)) // 64)) * 64
        at = level_bits(high[left], low[left], len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        slots[left[alone[at]]] = placed + (np.cumsum(alone) - 1)[at[alone[at]]]
        placed += int(alone.sum())
        sizes.append(size)
        words.append(np.packbits(alone, bitorder="little").view("<u8"))
        left = left[~alone[at]]
    return sizes, np.concatenate(words) if words else np.empty(0, np.uint64), slots


@dataclass(frozen=True)
class LineIndex:
    """Arrays of all shards one after the other; ``sizes`` and ``starts`` are in bits, by shard and level."""

    sizes: np.ndarray
    starts: np.ndarray
    words: np.ndarray
    before: np.ndarray
    fingerprints: np.ndarray
    counts: np.ndarray
    keepers: np.ndarray
    shards: int

    @staticmethod
    def of(rows: list[dict], shards: int) -> LineIndex:
        """From rows of ``index_shards``, of which shards without a key have none."""
        levels = max((len(r["sizes"]) for r in rows), default=0)
        sizes = np.zeros((shards, levels), np.int64)
        starts, at = np.zeros((shards, levels), np.int64), 0
        for r in rows:
            for level, size in enumerate(r["sizes"]):
                sizes[r["shard"], level], starts[r["shard"], level] = size, at
                at += size
        words, fingerprints, counts, keepers = (np.concatenate([np.empty(0, t), *(np.frombuffer(r[name], t) for r in rows)]) for name, t in (("words", "<u8"), ("fingerprints", "<i8"), ("counts", "<u4"), ("keepers", "<i8")))
        set_bits = np.bitwise_count(words).astype(np.int64)
        return LineIndex(sizes, starts, words, np.cumsum(set_bits) - set_bits, fingerprints, counts, keepers, shards)

    def find(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, keeper) of each key; a count of 0 for those that are not there."""
        count, keeper = np.zeros(len(high), np.int64), np.zeros(len(high), np.int64)
        left, shard = np.arange(len(high)), high % self.shards
        for level in range(self.sizes.shape[1]):
            left = left[self.sizes[shard[left], level] > 0]
            bit = self.starts[shard[left], level] + level_bits(high[left], low[left], level, self.sizes[shard[left], level])
            word, place = self.words[bit >> 6], (bit & 63).astype(np.uint64)
            hit = (word >> place) & np.uint64(1) == 1
            slot = (self.before[bit >> 6] + np.bitwise_count(word & ((np.uint64(1) << place) - np.uint64(1))))[hit]
            same = self.fingerprints[slot] == low[left[hit]]
            count[left[hit][same]], keeper[left[hit][same]] = self.counts[slot[same]], self.keepers[slot[same]]
            left = left[~hit]
        return count, keeper


def line_counts(docs: DataFrame, id_column: str, text: str, least_chars: int) -> DataFrame:
    """(high, low, n_docs, keeper) of each distinct long line: the documents that hold it, and the largest id of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                keys, owner = [], []
                for i, body in enumerate(texts_of(part.column(1))):
                    own = {k for k in long_keys(body.split(b"\n"), least_chars) if k is not None}
                    keys += own
                    owner += [i] * len(own)
                halves = hashes(keys)
                yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), part.column(0).take(pa.array(owner, pa.int64()))], ["high", "low", "id"])

    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), text).mapInArrow(run, "high bigint, low bigint, id bigint")
    return rows.groupBy("high", "low").agg(F.count("*").alias("n_docs"), F.max("id").alias("keeper"))


def index_shards(counted: DataFrame, shards: int) -> DataFrame:
    """(shard, sizes, words, fingerprints, counts, keepers): the perfect hash and arrays of each shard of (high, low, n_docs, keeper) rows."""

    def build(group: pa.Table) -> pa.Table:
        high, low, n, keeper = (group[c].to_numpy() for c in ("high", "low", "n_docs", "keeper"))
        sizes, words, slots = built(high, low)
        order = np.argsort(slots)
        arrays = (low[order].astype("<i8"), np.minimum(n[order], 0xFFFFFFFF).astype("<u4"), keeper[order].astype("<i8"))
        return pa.table({"shard": pa.array([int(high[0]) % shards], pa.int32()), "sizes": pa.array([sizes], pa.list_(pa.int64())), "words": pa.array([words.tobytes()], pa.binary())} | {name: pa.array([a.tobytes()], pa.binary()) for name, a in zip(("fingerprints", "counts", "keepers"), arrays, strict=True)})

    rows = counted.withColumn("shard", F.pmod("high", F.lit(shards)).cast("int"))
    return rows.groupBy("shard").applyInArrow(build, "shard int, sizes array<bigint>, words binary, fingerprints binary, counts binary, keepers binary")


def without(lines: list[bytes], keys: list[bytes | None], drop: set[bytes]) -> tuple[int, bytes]:
    stay = [line for line, key in zip(lines, keys, strict=True) if key is None or key not in drop]
    return len(lines) - len(stay), b"\n".join(stay)


def probed(docs: DataFrame, id_column: str, text: str, index: LineIndex, least_chars: int, least_docs: int) -> DataFrame:
    """Documents without the lines that the index says another document keeps; every worker has the index."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                lines = [t.split(b"\n") for t in texts_of(part.column(1))]
                keys = [long_keys(x, least_chars) for x in lines]
                own = [list({k for k in x if k is not None}) for x in keys]
                flat, owner = [k for x in own for k in x], np.repeat(np.arange(len(own)), [len(x) for x in own])
                halves = np.ascontiguousarray(hashes(flat).T)
                count, keeper = shared.value.find(halves[0], halves[1])
                ids = part.column(0)
                named, own_id = ids.is_valid().to_numpy(zero_copy_only=False)[owner], ids.fill_null(0).to_numpy()[owner]
                drop: list[set[bytes]] = [set() for _ in lines]
                for k in np.flatnonzero((count >= least_docs) & (~named | (keeper != own_id))).tolist():
                    drop[owner[k]].add(flat[k])
                made = [without(x, k, d) for x, k, d in zip(lines, keys, drop, strict=True)]
                yield pa.RecordBatch.from_arrays([ids, pa.array([len(x) for x in lines], pa.int64()), pa.array([n for n, _ in made], pa.int64()), pa.array([b for _, b in made], pa.binary()).cast(pa.string())], ["id", "n_lines", "n_dropped", "kept"])

    return docs.select(F.col(id_column).cast("bigint").alias("id"), text).mapInArrow(run, "id bigint, n_lines bigint, n_dropped bigint, kept string")


def routed(docs: DataFrame, id_column: str, text: str, shards: DataFrame, n_shards: int, least_chars: int, least_docs: int) -> DataFrame:
    """Like ``probed``, for arrays too large for each worker: probes meet one shard at a time.

    In a task a shard's arrays come first and its probes stream past them; a shard's probes are dealt to as many tasks as there are
    partitions for each shard, each with the shard's arrays, so that a line of a third of all documents is no task of its own.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salts = max(1, -(-parts // n_shards))
    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), F.xxhash64(text).alias("mark"), text)

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                own = [list({k for k in long_keys(t.split(b"\n"), least_chars) if k is not None}) for t in texts_of(part.column(2))]
                halves = hashes([k for x in own for k in x])
                owner = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
                yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), part.column(0).take(owner), part.column(1).take(owner)], ["high", "low", "id", "mark"])

    asked = rows.mapInArrow(probes, "high bigint, low bigint, id bigint, mark bigint").withColumn("shard", F.pmod("high", F.lit(n_shards)).cast("int"))
    asked = asked.select("shard", F.pmod(F.xxhash64("mark", "id"), F.lit(salts)).cast("int").alias("salt"), F.lit(True).alias("probe"), "high", "low", "id", "mark")
    arrays = shards.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(False).alias("probe"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, now = None, None
        for batch in batches:
            key = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)])
            edges = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                part = batch.slice(a, b - a)
                shard, salt, is_probe = (int(x) for x in key[:, a])
                if not is_probe:
                    index, now = LineIndex.of([part.select(["sizes", "words", "fingerprints", "counts", "keepers"]).to_pylist()[0] | {"shard": 0}], 1), (shard, salt)
                elif now == (shard, salt):
                    high, low, ids = part.column(3).to_numpy(), part.column(4).to_numpy(), part.column(5)
                    count, keeper = index.find(high, low)
                    lose = (count >= least_docs) & (~ids.is_valid().to_numpy(zero_copy_only=False) | (keeper != ids.fill_null(0).to_numpy()))
                    yield part.select(["high", "low", "id", "mark"]).filter(pa.array(lose))

    # False sorts before true: arrays come before their probes.
    met = asked.unionByName(arrays, allowMissingColumns=True).repartition(parts, "shard", "salt").sortWithinPartitions("shard", "salt", "probe")
    hits = met.mapInArrow(meet, "high bigint, low bigint, id bigint, mark bigint").groupBy("id", "mark").agg(F.collect_set(F.struct("high", "low")).alias("lost"))
    hits = hits.select(F.col("id").alias("_id"), F.col("mark").alias("_mark"), "lost")
    held = rows.join(hits, F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left").select("id", text, F.col("lost.high").alias("high"), F.col("lost.low").alias("low"))

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                n_lines, made = [], []
                for body, high, low in zip(texts_of(part.column(1)), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    lines = body.split(b"\n")
                    keys = long_keys(lines, least_chars)
                    own = list({k for k in keys if k is not None}) if high else []
                    gone = set(zip(high or [], low or [], strict=True))
                    lost = {k for k, h in zip(own, map(tuple, hashes(own).tolist()), strict=True) if h in gone}
                    n_lines.append(len(lines))
                    made.append(without(lines, keys, lost))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_lines, pa.int64()), pa.array([n for n, _ in made], pa.int64()), pa.array([b for _, b in made], pa.binary()).cast(pa.string())], ["id", "n_lines", "n_dropped", "kept"])

    return held.mapInArrow(drop, "id bigint, n_lines bigint, n_dropped bigint, kept string")


def line_dedup(docs: DataFrame, id_column: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, n_lines, n_dropped, kept): each document without long lines that ``least_docs`` documents hold, but for the one of the largest id.

    Lines are parted by \\n; a null or empty text is one empty line. Lines are equal if their keys are (see ``long_keys``); those of fewer than
    ``least_chars`` code points stay. All copies of a line stay in the document that keeps it. ``kept`` has the lines that stay, as they were, joined by \\n.
    Ids are whole numbers and come as bigint. Each row is a document of its own: repeated rows count each, and all rows of the largest id keep the line. A null id is
    below all others, and a line that only rows without an id hold stays. Other columns are not read; an empty table gives no row.
    """
    counted = written(line_counts(docs, id_column, text, least_chars).where((F.col("n_docs") >= least_docs) & F.col("keeper").isNotNull()))
    n_shards = max(1, -(-counted.count() // SHARD_KEYS))
    shards = written(index_shards(counted, n_shards))
    size = shards.agg(F.sum(F.octet_length("words") + F.octet_length("fingerprints") + F.octet_length("counts") + F.octet_length("keepers"))).first()[0] or 0
    if size <= broadcast_bytes:
        out = probed(docs, id_column, text, LineIndex.of([r.asDict() for r in shards.collect()], n_shards), least_chars, least_docs)
    else:
        out = routed(docs, id_column, text, shards, n_shards, least_chars, least_docs)
    return out.withColumnRenamed("id", id_column)
