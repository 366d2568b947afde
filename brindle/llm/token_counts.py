"""Token counts of the sections of a document by offset-mapped attribution (operator 6).

A document is encoded once, as a whole; encoding its sections one by one would give other tokens at their edges. Each
token's span in the text is known from the lengths of the tokens before it. Spans are joined to sections by binary search on
sections' edges. A token that lies across an edge goes, by rule, to the section with most of its bytes (of equal
shares the earlier), or to the one with its first byte; a token outside of all sections goes to none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from brindle.llm.batches import slices, texts_of
from brindle.llm.byte_bpe import encoder, read_ranks

RULES = ("most", "first")


def attributed(starts: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray, rule: str) -> np.ndarray:
    """Counts of tokens [start, end), which follow each other, for sections [low, high); a section without a byte gets none.

    Sections may overlap and need no order: of sections with equal claims to a token the one that comes first in the array gets it.
    """
    # Only sections that have a byte can get a token.
    real = np.flatnonzero(high > low)
    counts = np.zeros(len(low), dtype=np.int64)
    if not len(real) or not len(starts):
        return counts
    a, b = low[real], high[real]
    if (a[1:] < b[:-1]).any():
        # The best claim to each token so far, and whose it is.
        best, owner = np.zeros(len(starts), dtype=np.int64), np.full(len(starts), -1, dtype=np.int64)
        for i, x, y in zip(real.tolist(), a.tolist(), b.tolist(), strict=True):
            some = slice(int(np.searchsorted(ends, x, side="right")), int(np.searchsorted(starts, y, side="left")))
            claim = np.minimum(ends[some], y) - np.maximum(starts[some], x) if rule == "most" else (starts[some] >= x).astype(np.int64)
            more = claim > best[some]
            best[some][more] = claim[more]
            owner[some][more] = i
        np.add.at(counts, owner[owner >= 0], 1)
        return counts
    first = np.searchsorted(b, starts, side="right")  # the first section that ends after the token's start
    last = np.searchsorted(a, ends, side="left") - 1  # the last that starts before its end
    if rule == "first":
        inside = first < len(a)
        inside[inside] &= a[first[inside]] <= starts[inside]
        np.add.at(counts, real[first[inside]], 1)
        return counts
    one = first == last
    np.add.at(counts, real[first[one]], 1)
    for i in np.flatnonzero(first < last):
        some = np.arange(first[i], last[i] + 1)
        share = np.minimum(b[some], ends[i]) - np.maximum(a[some], starts[i])
        counts[real[some[share.argmax()]]] += 1
    return counts


def given_sections(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, end, known) of each row's sections; a section that is null, or lacks a start or an end, is not known and counts as empty."""
    offsets = column.offsets.to_numpy()
    held = column.values
    known = pc.and_(held.is_valid(), pc.and_(pc.struct_field(held, "start").is_valid(), pc.struct_field(held, "end").is_valid())).to_numpy(zero_copy_only=False)
    start, end = (pc.fill_null(pc.struct_field(held, k), 0).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "end"))
    valid = column.is_valid().to_pylist()
    return [(start[a:b], end[a:b], known[a:b]) if ok else (start[:0], end[:0], known[:0]) for a, b, ok in zip(offsets[:-1].tolist(), offsets[1:].tolist(), valid, strict=True)]


def line_edges(text: bytes) -> np.ndarray:
    """Byte offsets where the lines of a text begin, and its end; a line feed ends its line."""
    feeds = np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 10) + 1
    edges = np.concatenate(([0], feeds, [len(text)]))
    return edges[:-1] if len(feeds) and feeds[-1] == len(text) else edges


def byte_offsets(text: bytes) -> np.ndarray | None:
    """Byte offset of each character and of the end; None where they are the same."""
    if text.isascii():
        return None
    return np.append(np.flatnonzero((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80), len(text))


def token_counts(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text: str = "text", sections: str | None = None, rule: str = "most") -> DataFrame:
    """(id, section, start, end, n_tokens, n_document) for each section of each document.

    ``sections`` names a column array<struct<start: bigint, end: bigint>> of character offsets; without it
    sections are lines, each with its line feed. start and end are in characters, section counts from 0, n_document is the number of the
    document's tokens. Given sections may be in any order and overlap: a token is counted once, for the section that the rule names, of equal claims
    for the first in the array. What lies outside of the text is cut off for counting, while start and end come back as given; a section that ends before
    it starts has no token, nor has a null one or one without start or end, which comes back with nulls. A null or empty text has one empty line; a null or empty
    array of sections gives no row. A null id stays null, repeated rows repeat, other columns are not read, an empty table gives no row.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(shared.value, pattern)
        sizes = np.fromiter(map(len, bpe.decoder), dtype=np.int64, count=len(bpe.decoder))
        for batch in batches:
            for part in slices(batch, 1):
                texts = texts_of(part.column(1))
                given = given_sections(part.column(2)) if sections else None
                lows, highs, counts, knowns, totals = [], [], [], [], []
                for row, (data, ids) in enumerate(zip(texts, bpe.encode(texts), strict=True)):
                    ends = np.cumsum(sizes[np.frombuffer(ids, dtype="<u4")])
                    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
                    places = byte_offsets(data)
                    if given is None:
                        edges = line_edges(data)
                        low, high = edges[:-1], edges[1:]
                        chars = edges if places is None else np.searchsorted(places, edges)
                        lows.append(chars[:-1])
                        highs.append(chars[1:])
                    else:
                        start, end, known = given[row]
                        lows.append(start)
                        highs.append(end)
                        knowns.append(known)
                        most = len(data) if places is None else len(places) - 1
                        low, high = np.clip(start, 0, most), np.where(known, np.clip(end, 0, most), 0)
                        if places is not None:
                            low, high = places[low], places[high]
                    counts.append(attributed(starts, ends, low, high, rule))
                    totals.append(len(ends))
                many = np.array([len(c) for c in counts], dtype=np.int64)
                flat = lambda columns: np.concatenate([np.empty(0, np.int64), *columns]).astype(np.int64)
                unknown = ~np.concatenate(knowns) if given else None
                first = np.repeat(np.cumsum(many) - many, many)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(np.repeat(np.arange(len(many)), many))), pa.array((np.arange(len(first)) - first).astype(np.int32)),
                        pa.array(flat(lows), mask=unknown), pa.array(flat(highs), mask=unknown), pa.array(flat(counts)), pa.array(np.repeat(np.array(totals, dtype=np.int64), many)),
                    ],
                    [id_column, "section", "start", "end", "n_tokens", "n_document"],
                )

    kind = docs.select(id_column).dtypes[0][1]
    columns = [id_column, text, *([sections] if sections else [])]
    return docs.select(*columns).mapInArrow(run, f"{id_column} {kind}, section int, start bigint, end bigint, n_tokens bigint, n_document bigint")
