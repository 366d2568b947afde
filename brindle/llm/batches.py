"""What tasks over Arrow batches of texts need: slices bounded in bytes, a bounded cache, ids of numbered parts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows and bytes of text that a task works on at once; a longer text is a slice of its own.
SLICE_ROWS, SLICE_BYTES = 2000, 4 << 20
#: Bytes of batches whose slices are looked up together, about.
RUN_BYTES = 16 << 20
#: Bytes that an entry of a cache takes beside its key and value, about, and the longest key that is kept.
ENTRY_BYTES, LONGEST_KEY = 180, 256


def slices(batch: pa.RecordBatch, column: int, rows: int = SLICE_ROWS, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most ``rows`` rows and about ``most`` bytes in a text column."""
    if batch.num_rows == 0:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, done = 0, 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(ends, done + most, side="right"))
        stop = min(max(stop, start + 1), start + rows, batch.num_rows)
        yield batch.slice(start, stop - start)
        start, done = stop, int(ends[stop - 1])


def runs_of_slices(batches: Iterable[pa.RecordBatch], column: int, most: int = RUN_BYTES) -> Iterator[list[pa.RecordBatch]]:
    """The slices of consecutive batches, in lists of about ``most`` bytes of rows, so that what is done once for many slices is done less often."""
    run, held = [], 0
    for batch in batches:
        for part in slices(batch, column):
            run.append(part)
            held += part.nbytes
            if held >= most:
                yield run
                run, held = [], 0
    if run:
        yield run


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


class Cache:
    """Values by key, both bytes, of about ``budget`` bytes at most.

    Two generations: what was met lately, and what before; an entry that is met again moves up. Callers keep what they have
    found or added themselves, since any of it may go at the next call.
    """

    def __init__(self, budget: int) -> None:
        self.budget, self.used = budget, 0
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def __len__(self) -> int:
        return len(self.young) + len(self.old)

    def find(self, keys: list[bytes]) -> list[bytes | None]:
        found = list(map(self.young.get, keys))
        if self.old:
            again = [(i, held) for i, v in enumerate(found) if v is None and (held := self.old.get(keys[i])) is not None]
            for i, v in again:
                found[i] = v
            self.put([keys[i] for i, _ in again], [v for _, v in again])
        return found

    def put(self, keys: list[bytes], values: list[bytes]) -> None:
        if max(map(len, keys), default=0) > LONGEST_KEY:
            short = [i for i, k in enumerate(keys) if len(k) <= LONGEST_KEY]
            keys, values = [keys[i] for i in short], [values[i] for i in short]
        step = max(1, self.budget // (8 * (ENTRY_BYTES + LONGEST_KEY)))
        for at in range(0, len(keys), step):
            k, v = keys[at : at + step], values[at : at + step]
            self.young.update(zip(k, v, strict=True))
            self.used += sum(map(len, k)) + sum(map(len, v)) + ENTRY_BYTES * len(k)
            if self.used > self.budget // 2:
                self.old, self.young, self.used = self.young, {}, 0

    def ids_of(self, keys: list[bytes], make: Callable[[list[bytes]], list[bytes]]) -> list[bytes]:
        """Values of all keys; ``make`` gives those that are not there, but for the empty key, whose value is empty."""
        found = self.find(keys)
        gaps = [i for i, v in enumerate(found) if v is None and keys[i]]
        missing = [keys[i] for i in gaps]
        new = make(missing)
        for i, v in zip(gaps, new, strict=True):
            found[i] = v
        self.put(missing, new)
        return [v or b"" for v in found]


def pooled(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, sizes): ids (unsigned 32-bit) of all parts in a row, and how many each part has."""
    return np.frombuffer(b"".join(found), dtype="<u4"), np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4


def gathered(pool: np.ndarray, sizes: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``pooled`` of the parts with these numbers, which may repeat: ids are copied from where they stand in the pool."""
    size, start = sizes[number], (np.cumsum(sizes) - sizes)[number]
    ends = np.cumsum(size)
    return pool[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)], size


def ids_of_texts(ids: np.ndarray, sizes: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Ids of each text as bytes, for texts that begin and end at these numbers of parts."""
    ends = np.concatenate(([0], np.cumsum(sizes)))
    held, at = ids.tobytes(), (ends[offsets - offsets[0]] * 4).tolist()
    return [held[a:b] for a, b in zip(at, at[1:], strict=False)]
