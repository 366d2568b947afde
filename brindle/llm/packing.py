"""Best-two-fit packing of documents into sequences (operator 10)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.batches import slices, texts_of
from brindle.llm.shared import written
from brindle.llm.word_ids import encoder, read_vocabulary

PIECES_PER_TASK = 100_000


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int, length: int, id_column: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """One row for each piece of at most ``length`` ids of a document and its end id.

    (id, piece, start, length, ids_crc32), with ``ids`` also the ids, unsigned 32-bit little-endian.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(shared.value)
        for batch in batches:
            for part in slices(batch, 1):
                rows, pieces, starts, sizes, sums, held = [], [], [], [], [], []
                for row, coded in enumerate(words.encode(texts_of(part.column(1)))):
                    data = coded + end
                    for piece, at in enumerate(range(0, len(data), 4 * length)):
                        some = data[at : at + 4 * length]
                        rows.append(row)
                        pieces.append(piece)
                        starts.append(at // 4)
                        sizes.append(len(some) // 4)
                        sums.append(zlib.crc32(some))
                        held.append(some)
                columns = [part.column(0).take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())]
                names = [id_column, "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(held, pa.binary())] if ids else []), names + ["ids"] * ids)

    kind = docs.select(id_column).dtypes[0][1]
    schema = f"{id_column} {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * ids
    return docs.select(id_column, text).mapInArrow(run, schema)


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item.

    A bin takes the longest item left and then, again and again, the longest that fits. When none fits,
    its shortest item goes back if two items left over fill that item's place and the gap better; of
    such pairs the fullest is taken. Items of one length are alike and are taken in order.
    """
    stacks: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        stacks.setdefault(int(lengths[i]), []).append(i)
    there = sum(1 << size for size in stacks)  # bit n: an item of length n is left

    def longest(most: int) -> int:
        return (there & ((2 << most) - 1)).bit_length() - 1 if most >= 0 else -1

    def take(size: int) -> int:
        nonlocal there
        item = stacks[size].pop()
        if not stacks[size]:
            there ^= 1 << size
        return item

    bins, offsets, number = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    while there:
        inside, gap = [], capacity
        while (size := longest(gap)) >= 0:
            inside.append((size, take(size)))
            gap -= size
        if gap and inside:
            least, item = inside[-1]  # the last is the shortest
            room, best, pair = gap + least, least, None
            a = longest(room)
            while a >= 0 and 2 * a > best:
                b = longest(min(a, room - a))
                if b == a and len(stacks[a]) < 2:
                    b = longest(a - 1)
                if b >= 0 and a + b > best:
                    best, pair = a + b, (a, b)
                    if best == room:
                        break
                a = longest(a - 1)
            if pair:
                inside.pop()
                inside += [(size, take(size)) for size in pair]
                if not stacks[least]:
                    there |= 1 << least
                stacks[least].append(item)
        at = 0
        for size, item in inside:
            bins[item], offsets[item] = number, at
            at += size
        number += 1
    return bins, offsets


def pack(pieces: DataFrame, capacity: int, pieces_per_task: int = PIECES_PER_TASK) -> DataFrame:
    """Adds (sequence_id, offset) to rows that have a ``length`` of 1 to ``capacity``.

    ``pieces`` must be a table that reads the same each time. Rows are dealt out evenly, whatever their keys,
    to tasks of about ``pieces_per_task``, each of which packs its own: a task loses at most one open sequence.
    """
    tasks = max(1, -(-pieces.count() // pieces_per_task))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        rows = rows.sort_by([(n, "descending" if n == "length" else "ascending") for n in ["length", *(n for n in rows.column_names if n != "length" and not pa.types.is_nested(rows.schema.field(n).type))]]).combine_chunks()
        bins, offsets = best_two_fit(rows["length"].to_numpy(), capacity)
        # Sequences of different tasks get different numbers: the task's number leads.
        rows = rows.append_column("sequence_id", pa.array(bins + (TaskContext.get().partitionId() << 40), pa.int64()))
        yield from rows.append_column("offset", pa.array(offsets, pa.int64())).to_batches(max_chunksize=10_000)

    fields = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes)
    return pieces.repartition(tasks).mapInArrow(run, f"{fields}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Packs every document, with its end id, into sequences of at most ``capacity`` ids.

    Returns (id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece; only documents longer
    than a sequence are cut. Null and empty texts are one id. A null id stays null, repeated rows are packed
    again, other columns are not read, and an empty table gives no row.
    """
    return pack(written(token_pieces(docs, vocabulary, end_id, capacity, id_column, text)), capacity)
