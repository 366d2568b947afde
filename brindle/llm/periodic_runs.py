"""Periodic run detection over words, by tiles for each octave of periods (operator 11).

A run is a stretch of words with smallest period q, at least four periods long, that keeps its period no further to either side. For a period q the text
agrees with itself q words later over all of a run but its last q words: three periods at least.

1. Tiles. Periods of octave j are from 2^j to 2^(j+1) - 1. A text is cut to tiles of sixteen times 2^j words that overlap by four times 2^j; low octaves share a
   length. A text that fits a tile of its own is solved where it stands, together with others on one tape, between separators that equal nothing. The tiles of longer
   ones are dealt out.
2. A tile is solved alone. Windows of 2^j words, one beside the other, are compared with those q words later for all q of the octave, by hashes that double from
   octave to octave; an agreement of two windows' length holds one in full. At the boundaries of windows that agree, Z values, which count how many words more
   agree to either side, make them whole stretches. A period whose block is a power of a shorter one is left to that one's octave.
3. Fragments of stretches meet by document and period, and those that overlap or touch are stitched to one. What then agrees over three periods is a run.

Words are compared by numbers, stretches by 64-bit hashes of these.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.batches import slices, texts_of

#: Periods of a run, and words, at least.
EXPONENT, LEAST_WORDS = 4, 6
#: Words of a tile of the low octaves; tiles of others have TILE times 2^j words, of which the next tile has OVERLAP times 2^j too.
LOW_WORDS, TILE, OVERLAP = 16_384, 16, 4
#: Bytes of a text from which it is cut to tiles.
LONG_BYTES = 65_536

M1, M2, ODD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
RUN_TYPE = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def least_factors(n: int) -> np.ndarray:
    """The least prime factor of each number below n; 0 and 1 have themselves."""
    out = np.arange(n)
    for p in range(2, int(n**0.5) + 1):
        if out[p] == p:
            some = out[p * p :: p]
            some[some == np.arange(p * p, n, p)] = p
    return out


def is_power(names: np.ndarray, at: np.ndarray, period: np.ndarray, step: int) -> np.ndarray:
    """Whether the block of each period, from a window of ``step`` words that agrees, repeats a shorter one. ``names`` are the windows' hashes.

    A block has the period p, a divisor, if it agrees with itself p words later but for its last p words: two windows cover that.
    """
    out, rest = np.zeros(len(at), dtype=bool), period.copy()
    factors = least_factors(2 * step)
    while (rest > 1).any():
        r = factors[rest]
        p = period // np.maximum(r, 1)
        last = at + np.maximum(period - p - step, 0)
        out |= (rest > 1) & (names[at] == names[np.minimum(at + p, len(names) - 1)]) & (names[last] == names[np.minimum(last + p, len(names) - 1)])
        rest = np.where(rest > 1, rest // np.maximum(r, 1), rest)
    return out


def agreeing(ids: np.ndarray, at: np.ndarray, period: np.ndarray, step: int, way: int) -> np.ndarray:
    """Z values at boundaries: how many words from ``at`` on, at most ``step``, equal those a period later; forwards (1) or backwards (-1)."""
    out = np.empty(len(at), dtype=np.int64)
    rows = max(1, 1_000_000 // step)
    for a in range(0, len(at), rows):
        place = at[a : a + rows, None] + way * np.arange(step)[None, :]
        later = place + period[a : a + rows, None]
        same = (place >= 0) & (later < len(ids))
        same &= ids[np.clip(place, 0, len(ids) - 1)] == ids[np.minimum(later, len(ids) - 1)]
        out[a : a + rows] = np.where(same.all(axis=1), step, same.argmin(axis=1))
    return out


def stretches(ids: np.ndarray, octaves: Iterator[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(period, start, stop) of what agrees with itself a period later: words start to stop - 1 do, and the words beside them do not or are not there.

    ``octaves`` gives ascending octaves with how many of the words, from the first on, each is looked for in. Every stretch of two windows or more is found, and some shorter ones.
    """
    found: list[tuple[np.ndarray, ...]] = []
    names, level = mix(ids.astype(np.uint64) + ODD), 0
    for octave, end in octaves:
        while level < octave:
            half = 1 << level
            names = mix(names[: max(0, len(names) - half)] * ODD + names[half:])
            level += 1
        step = 1 << octave
        names, own = names[: max(0, end - step + 1)], ids[:end]
        # Windows stand at multiples of the step; row k, column c of the table is the window at (k + 1) * step + c: window k a period of step + c later.
        n = len(names) // step
        if n < 2:
            continue
        later = np.zeros(n * step, np.uint64)
        later[: len(names) - step] = names[step : (n + 1) * step]
        window, column = np.divmod(np.flatnonzero(later.reshape(n, step) == names[: n * step : step, None]), step)
        order = np.lexsort((window, column))
        window, column = window[order], column[order]
        first = np.ones(len(window), dtype=bool)
        first[1:] = (column[1:] != column[:-1]) | (window[1:] != window[:-1] + 1)
        last = np.append(first[1:], True) if len(first) else first
        start, stop, period = window[first] * step, (window[last] + 1) * step, column[first] + step
        own_block = ~is_power(names, start, period, step)
        start, stop, period = start[own_block], stop[own_block], period[own_block]
        found.append((period, start - agreeing(own, start - 1, period, step, -1), stop + agreeing(own, stop, period, step, 1)))
    return tuple(np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*found, strict=True) if found else ((), (), ())))


def runs_of_texts(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs of whole texts, given as words, in this order."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    order = np.argsort(-size, kind="stable")
    flat = pa.array([w for i in order for w in texts[i]], pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    # The longest come first, so that the texts in which an octave may have runs are the first of the tape; a separator follows each.
    ends = np.cumsum(size[order] + 1)
    tape = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
    between = np.zeros(len(tape), dtype=bool)
    between[ends - 1] = True
    tape[between], tape[~between] = -1 - np.arange(len(ends)), flat
    long = [(j, int((size >= EXPONENT << j).sum())) for j in range(int(size.max(initial=1)).bit_length())]
    period, start, stop = stretches(tape, ((j, int(ends[n - 1])) for j, n in long if n))
    run = (stop - start >= (EXPONENT - 1) * period) & (stop - start + period >= LEAST_WORDS)
    period, start, length = period[run], start[run], (stop - start + period)[run]
    place = np.searchsorted(ends, start, side="right")
    start = start - (ends - size[order] - 1)[place]
    text = order[place]
    by = np.lexsort((period, start, text))
    return text[by], start[by], length[by], period[by]


def collapsed(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    """The words that no run has after its first period, joined by spaces."""
    if not len(start):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)])


def in_place(docs: DataFrame, kind: str) -> DataFrame:
    """(id, runs, collapsed) of (id, text) rows, all of a slice solved together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                words = [t.split() for t in texts_of(part.column(1))]
                text, start, length, period = runs_of_texts(words)
                edges = np.searchsorted(text, np.arange(len(words) + 1))
                bodies = [collapsed(w, start[a:b], length[a:b], period[a:b]) for w, a, b in zip(words, edges, edges[1:], strict=False)]
                runs = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], fields=list(RUN_TYPE)))
                yield pa.RecordBatch.from_arrays([part.column(0), runs, pa.array(bodies, pa.binary()).cast(pa.string())], ["id", "runs", "collapsed"])

    return docs.select("id", "text").mapInArrow(run, f"id {kind}, runs {RUNS}, collapsed string")


def tiles_of(n: int, low_words: int = LOW_WORDS) -> Iterator[tuple[int, int, int, int]]:
    """(first octave, last octave, start, stop) of the tiles of a text of n words."""
    top = (n // EXPONENT).bit_length() - 1
    low = min(top, (low_words // TILE).bit_length() - 1)
    for first, last in [(0, low), *((j, j) for j in range(low + 1, top + 1))] if top >= 0 else []:
        size, over = max(TILE << last, low_words if last <= low else 0), OVERLAP << last
        start = 0
        while True:
            yield first, last, start, min(n, start + size)
            if start + size >= n:
                break
            start += size - over


def tiles(docs: DataFrame, kind: str) -> DataFrame:
    """(id, mark, first, last, start, whole, words) of the tiles of (id, mark, text) rows; a word is its number in the document, as 32 bits; ``whole`` is the document's number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, body in enumerate(texts_of(batch.column(2))):
                numbers = pa.array(body.split(), pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype("<u4")
                for first, last, start, stop in tiles_of(len(numbers)):
                    own = [pa.array([x], t) for x, t in ((first, pa.int32()), (last, pa.int32()), (start, pa.int64()), (len(numbers), pa.int64()), (numbers[start:stop].tobytes(), pa.binary()))]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), *own], ["id", "mark", "first", "last", "start", "whole", "words"])

    return docs.select("id", "mark", "text").mapInArrow(run, f"id {kind}, mark bigint, first int, last int, start bigint, whole bigint, words binary")


def fragments(dealt: DataFrame, kind: str) -> DataFrame:
    """(id, mark, period, start, stop) of what agrees in each tile; what is closed inside a tile and too short for a run is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                first, last, at, whole, words = (batch.column(i)[k].as_py() for i in range(2, 7))
                ids = np.frombuffer(words, "<u4").astype(np.int64)
                period, start, stop = stretches(ids, ((j, len(ids)) for j in range(first, last + 1)))
                opened = ((start == 0) & (at > 0)) | ((stop + period == len(ids)) & (at + len(ids) < whole))
                some = opened | (stop - start >= (EXPONENT - 1) * period)
                owner = pa.array(np.full(int(some.sum()), k))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), pa.array(period[some]), pa.array(start[some] + at), pa.array(stop[some] + at)], ["id", "mark", "period", "start", "stop"])

    return dealt.mapInArrow(run, f"id {kind}, mark bigint, period bigint, start bigint, stop bigint")


def stitched(found: DataFrame) -> DataFrame:
    """(id, mark, runs): fragments of one document and period that overlap or touch are one, and are a run if three periods agree."""
    order = Window.partitionBy("id", "mark", "period").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = found.withColumn("apart", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("island", F.sum("apart").over(order))
    whole = apart.groupBy("id", "mark", "period", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    length = F.col("stop") - F.col("start") + F.col("period")
    runs = whole.where((length >= EXPONENT * F.col("period")) & (length >= LEAST_WORDS)).select("id", "mark", F.struct("start", "period", length.alias("length")).alias("run"))
    sorted_runs = F.transform(F.array_sort(F.collect_list("run")), lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period")))
    return runs.groupBy("id", "mark").agg(sorted_runs.alias("runs"))


def by_tiles(docs: DataFrame, kind: str) -> DataFrame:
    """(id, runs, collapsed) of (id, text) rows of any length: tiles are dealt out, fragments stitched, and the runs joined to their documents, by id and a hash of the text."""
    marked = docs.select("id", F.xxhash64("text").alias("mark"), "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tiles(marked, kind).repartition(parts, "mark", "last", "start")
    runs = stitched(fragments(dealt, kind)).select(F.col("id").alias("_id"), F.col("mark").alias("_mark"), "runs")
    none = F.array().cast(RUNS)
    held = marked.join(runs, F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left").select("id", "text", F.coalesce("runs", none).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                bodies = []
                for body, own in zip(texts_of(part.column(1)), part.column(2), strict=True):
                    flat = own.values
                    bodies.append(collapsed(body.split(), *(flat.field(c).to_numpy() for c in ("start", "length", "period"))))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(bodies, pa.binary()).cast(pa.string())], ["id", "runs", "collapsed"])

    return held.mapInArrow(run, f"id {kind}, runs {RUNS}, collapsed string")


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text: str = "text", long_bytes: int = LONG_BYTES) -> DataFrame:
    """(id, n_runs, start, length, period, exponent_milli, runs, collapsed) of each document.

    ``runs`` has (start, length, period) of each run in words, by start and then period; the columns before are of the longest one, of equal ones the first, of those the one of
    the least period, and null without a run. ``collapsed`` has the words that no run has after its first period, joined by single spaces. Words are parted by ASCII white
    space. A null text has no word. Null ids and repeated rows stay as they are; other columns are not read; an empty table gives no row.
    """
    kind = docs.select(id_column).dtypes[0][1]
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    long = F.octet_length("text") > long_bytes
    found = in_place(rows.where(~long), kind).unionByName(by_tiles(rows.where(long), kind))
    # The greatest of (length, -start, -period).
    most = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    found = found.withColumn("most", most)
    length, period = F.col("most.length"), -F.col("most.period")
    exponent = F.floor(1000 * length / period).cast("bigint")
    return found.select(F.col("id").alias(id_column), F.size("runs").cast("bigint").alias("n_runs"), (-F.col("most.start")).alias("start"), length.alias("length"), period.alias("period"), exponent.alias("exponent_milli"), "runs", "collapsed")
