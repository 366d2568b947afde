"""Content-addressed store of token ids (operator 8).

Layout under one folder, all written by Spark's Parquet writer, so that any file system of the cluster does:

* a bucketed table of chunks ``(digest, n_ids, payload)``: each distinct chunk once. ``digest`` is the 160-bit BLAKE2b of
  the chunk's ids as little-endian unsigned integers of two bytes each (of four, where an id needs them); ``payload`` is the
  Zstandard frame of the same bytes;
* ``recipes``: ``(part, at, row, id, start, n_tokens, digests, root)`` in ascending id order; ``root`` is the Merkle root of
  the digests, in pairs from the left, an odd one going up unchanged;
* ``manifest``: a tree over the recipes of each part: for each run of RUN roots in order their SHA-256, for each run of these again, with numbers of
  documents and ids, up to one row a part.

Chunks end where a rolling hash of the last 16 ids has MASK_BITS low bits 0, or after MOST ids, so that equal runs
in different documents give equal chunks after the next cut.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from brindle.llm.batches import runs_of_slices, texts_of
from brindle.llm.shared import scratch_dir, written
from brindle.llm.word_ids import encoder, read_vocabulary

WINDOW, MASK_BITS, LEAST, MOST = 16, 9, 64, 4096
#: Digests that a task remembers, and rows that one row of the manifest stands for.
GIVEN, RUN = 200_000, 4096
DIGEST_BYTES = 20
#: Uses of a chunk in a slice, and how many chunks of more uses are broadcast (digests only).
HOT_USES, BROADCAST_HOT = 1000, 10_000


def cuts(ids: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """Where the chunks of each document end, for documents that end at these places of ``ids``; the last is its own end."""
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    # Rolling hash: a sum over the window of mixed ids, each times a power for its distance; windows double.
    rolled, width, power = mixed, 1, 0xD6E8FEB86659FD93
    while width < WINDOW:
        rolled = rolled[width:] + rolled[:-width] * np.uint64(power)
        width, power = 2 * width, power * power % (1 << 64)
    found = np.flatnonzero((rolled >> np.uint64(64 - MASK_BITS)) == 0) + WINDOW
    # A window that begins in the document before, or ends where its document does, says nothing.
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    owner = np.searchsorted(ends, found, side="right")
    owner[owner == len(ends)] -= 1
    found = found[(found - WINDOW >= starts[owner]) & (found < ends[owner])] if len(ends) else found
    edges = np.searchsorted(found, ends)
    hits, out, at = found.tolist(), [], 0
    for start, end, until in zip(starts.tolist(), ends.tolist(), edges.tolist(), strict=True):
        own, last = [], start
        for place in [*hits[at:until], end]:
            while place - last > MOST:
                last += MOST
                own.append(last)
            if place - last >= LEAST or place == end:
                if place > last:
                    own.append(place)
                last = place
        out.append(own)
        at = until
    return out


def merkle(digests: list[bytes]) -> bytes:
    level = list(digests) or [b""]
    while len(level) > 1:
        level = [hashlib.sha256(level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


@dataclass(frozen=True)
class Store:
    path: str
    chunks: str
    id_column: str


def encode_chunks(docs: DataFrame, vocabulary: str, end_id: int, id_column: str, text: str) -> DataFrame:
    """Rows of two kinds: a document's recipe, or a chunk that its task has not yet given, or not lately."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pressed = encoder(shared.value), zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=True)
        # Digests that this task has given; another task's may be lost with it, so that none are kept longer.
        given: set[bytes] = set()
        for parts in runs_of_slices(batches, 1):
            for part, texts in zip(parts, words.encode_slices(texts_of(p.column(1)) for p in parts), strict=True):
                coded = [ids + end for ids in texts]
                sizes = np.array([len(c) // 4 for c in coded], dtype=np.int64)
                ids = np.frombuffer(b"".join(coded), dtype="<u4")
                narrow = ids.astype("<u2") if int(ids.max()) < 65536 else None
                held = ids.tobytes() if narrow is None else narrow.tobytes()
                last, recipes, roots, counts, digests, payloads = 0, [], [], [], [], []
                for ends in cuts(ids, np.cumsum(sizes)):
                    recipe = []
                    for at in ends:
                        if narrow is not None:
                            data = held[2 * last : 2 * at]
                        else:
                            some = ids[last:at]
                            data = (some.astype("<u2") if some.max() < 65536 else some).tobytes()
                        digest = hashlib.blake2b(data, digest_size=DIGEST_BYTES).digest()
                        recipe.append(digest)
                        if digest not in given:
                            given.add(digest)
                            counts.append(at - last)
                            digests.append([digest])
                            payloads.append(pressed.compress(data))
                        last = at
                    recipes.append(recipe)
                    roots.append(merkle(recipe))
                if len(given) > GIVEN:
                    given.clear()
                n, new = len(recipes), len(digests)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([part.column(0), pa.nulls(new, part.column(0).type)]),
                        pa.array(np.arange(n + new) < n),
                        pa.concat_arrays([pa.array(sizes), pa.array(counts, pa.int64())]),
                        pa.array(recipes + digests, pa.list_(pa.binary())),
                        pa.array(roots + [None] * new, pa.binary()),
                        pa.array([None] * n + payloads, pa.binary()),
                    ],
                    [id_column, "is_recipe", "n", "digests", "root", "payload"],
                )

    kind = docs.select(id_column).dtypes[0][1]
    return docs.select(id_column, text).mapInArrow(run, f"{id_column} {kind}, is_recipe boolean, n bigint, digests array<binary>, root binary, payload binary")


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def remove(spark: SparkSession, store: Store) -> None:
    """Deletes a store's chunks and files."""
    spark.sql(f"DROP TABLE IF EXISTS {store.chunks}")
    delete(spark, store.path)


def manifest(recipes: DataFrame) -> DataFrame:
    """(level, part, at, n_documents, n_ids, root): a tree of hashes over each part's recipes in order.

    A row of level 0 stands for RUN recipes, one of the next level for RUN such rows, up to one row a part, so that no group is longer.
    """
    rows = recipes.select("part", "at", F.hex("root").alias("root"), F.lit(1).cast("bigint").alias("n_documents"), F.col("n_tokens").alias("n_ids"))
    longest, level, out = (recipes.agg(F.max("at")).first()[0] or 0) + 1, 0, None
    while out is None or longest > 1:
        roots = F.transform(F.array_sort(F.collect_list(F.struct("at", "root"))), lambda x: x["root"])
        groups = rows.groupBy("part", F.floor(F.col("at") / RUN).alias("up"))
        rows = groups.agg(F.sum("n_documents").alias("n_documents"), F.sum("n_ids").alias("n_ids"), F.sha2(F.array_join(roots, ""), 256).alias("root")).withColumnRenamed("up", "at")
        mine = rows.select(F.lit(level).alias("level"), "part", "at", "n_documents", "n_ids", "root")
        out = mine if out is None else out.unionByName(mine)
        longest, level = -(-longest // RUN), level + 1
    return out


def write_store(docs: DataFrame, vocabulary: str, end_id: int = 1, id_column: str = "doc_id", text: str = "text") -> Store:
    """Encodes every text, appends the end id and stores the ids; null texts are empty ones."""
    spark = docs.sparkSession
    path, name = scratch_dir(spark), f"token_chunks_{uuid.uuid4().hex}"
    # Texts are encoded once, into a staging table that goes when the store is complete.
    encode_chunks(docs, vocabulary, end_id, id_column, text).write.option("compression", "none").parquet(f"{path}/staging")
    staged = spark.read.parquet(f"{path}/staging")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = staged.where("not is_recipe").select(F.col("digests")[0].alias("digest"), F.col("n").alias("n_ids"), "payload")
    unique = chunks.groupBy("digest").agg(F.first("n_ids").alias("n_ids"), F.first("payload").alias("payload"))
    unique.write.format("parquet").option("compression", "none").bucketBy(parts, "digest").saveAsTable(name)
    ordered = (
        staged.where("is_recipe")
        .select(F.monotonically_increasing_id().alias("row"), id_column, F.col("n").alias("n_tokens"), "digests", "root")
        .repartitionByRange(parts, F.col(id_column).asc_nulls_first(), "row")
        .sortWithinPartitions(F.col(id_column).asc_nulls_first(), "row")
        .select(F.spark_partition_id().alias("part"), "*")
    )
    ordered.write.parquet(f"{path}/unplaced")
    unplaced = spark.read.parquet(f"{path}/unplaced")
    order = Window.partitionBy("part").orderBy(F.col(id_column).asc_nulls_first(), "row")
    sums = unplaced.groupBy("part").agg(F.count("*").alias("n_documents"), F.sum("n_tokens").alias("n_ids"))
    # One row a part: the only window over a whole table.
    bases = sums.withColumn("base", F.sum("n_ids").over(Window.orderBy("part")) - F.col("n_ids"))
    placed = unplaced.join(F.broadcast(bases.select("part", "base")), "part").withColumns({"at": F.row_number().over(order).cast("bigint") - 1, "start": F.col("base") + F.sum("n_tokens").over(order) - F.col("n_tokens")})
    placed.select("part", "at", "row", id_column, "start", "n_tokens", "digests", "root").write.parquet(f"{path}/recipes")
    manifest(spark.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")
    for used in ("staging", "unplaced"):
        delete(spark, f"{path}/{used}")
    return Store(path, name, id_column)


def read_documents(spark: SparkSession, store: Store, with_ids: bool = True) -> DataFrame:
    """Puts each document's chunks together again and checks them against recipes and manifest.

    (id, start, n_tokens, ids_crc32), with ``with_ids`` also ids. A chunk that does not hash to its digest, or a
    document whose root differs, fails the job.
    """
    id_column = store.id_column
    recipes, chunks = spark.read.parquet(f"{store.path}/recipes"), spark.table(store.chunks)
    kept = spark.read.parquet(f"{store.path}/manifest").withColumnRenamed("root", "kept_root")
    bad = manifest(recipes).join(kept, ["level", "part", "at"], "full_outer").where("not (root <=> kept_root)").count()
    if bad:
        raise ValueError(f"{bad} rows of the recipes' tree differ from the manifest")
    # Documents of equal ids have equal roots and are put together once.
    uses = written(recipes.groupBy("root").agg(F.first("digests").alias("digests")).select("root", F.posexplode("digests").alias("at", "digest")))
    # A chunk that many documents use is met in slices, so that no task has all its uses.
    hot = written(uses.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") > HOT_USES).select("digest", F.ceil(F.col("n") / HOT_USES).alias("slices")))
    few = F.broadcast(hot) if hot.count() <= BROADCAST_HOT else hot
    marked = uses.join(few, "digest", "left")
    wanted = ["root", "at", "digest", "n_ids", "payload"]
    cold = marked.where("slices is null").join(chunks, "digest", "left").select(*wanted)
    copies = chunks.join(few, "digest").select("digest", "n_ids", "payload", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1)).alias("slice"))
    warm = marked.where("slices is not null").withColumn("slice", F.pmod(F.xxhash64("root"), "slices")).join(copies, ["digest", "slice"], "left").select(*wanted)
    parts = cold.unionByName(warm)
    docs = parts.groupBy("root").agg(F.collect_list(F.struct("at", "digest", "n_ids", "payload")).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        checked: dict[bytes, bytes] = {}

        def ids_of(digest: bytes, n: int | None, payload: bytes | None) -> bytes:
            if payload is None:
                raise ValueError(f"chunk {digest.hex()} is missing")
            raw = open_.decompress(payload)
            if hashlib.blake2b(raw, digest_size=DIGEST_BYTES).digest() != digest:
                raise ValueError(f"chunk {digest.hex()} is damaged")
            return np.frombuffer(raw, dtype="<u2").astype("<u4").tobytes() if len(raw) == 2 * n else raw

        for batch in batches:
            rows, sizes, sums, roots, held = batch.column(0), [], [], [], []
            lists = batch.column(1)
            edges = lists.offsets.to_numpy().tolist()
            at, digests, counts, payloads = (lists.values.field(k).to_pylist() for k in range(4))
            for a, b in zip(edges, edges[1:], strict=False):
                order = sorted(range(a, b), key=at.__getitem__)
                data = []
                for i in order:
                    if digests[i] not in checked:
                        if len(checked) > 5000:
                            checked.clear()
                        checked[digests[i]] = ids_of(digests[i], counts[i], payloads[i])
                    data.append(checked[digests[i]])
                whole = b"".join(data)
                sizes.append(len(whole) // 4)
                sums.append(zlib.crc32(whole))
                roots.append(merkle([digests[i] for i in order]))
                held.append(whole)
            columns = [rows, pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(roots, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(held, pa.binary())] if with_ids else []), ["root", "n_read", "ids_crc32", "read_root"] + ["ids"] * with_ids)

    read = docs.mapInArrow(run, "root binary, n_read bigint, ids_crc32 bigint, read_root binary" + ", ids binary" * with_ids)
    whole = F.when((F.col("n_read") == F.col("n_tokens")) & (F.col("read_root") == F.col("root")), F.col("ids_crc32"))
    checked = F.coalesce(whole, F.raise_error(F.concat(F.lit("document differs from its recipe: row "), F.col("row"))).cast("bigint"))
    out = recipes.select("row", id_column, "start", "n_tokens", "root").join(read, "root", "left")
    return out.select(id_column, "start", "n_tokens", checked.alias("ids_crc32"), *(["ids"] if with_ids else []))
