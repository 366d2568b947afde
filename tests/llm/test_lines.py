"""Operators 11 to 13."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from brindle.llm import line_dedup, periodic_runs, ranked_search

from .conftest import ODD, words

WHITE = " \t\n\x0b\x0c\r"


def lowered(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def plain_lines(rows: list[tuple], least_docs: int = 5) -> list[tuple]:
    cut = [(i, [(x, k if len(k := lowered(x.strip(WHITE))) >= 40 else None) for x in (t or "").split("\n")]) for i, t in rows]
    holders = defaultdict(list)
    for i, lines in cut:
        for k in {k for _, k in lines if k}:
            holders[k].append(i)
    keeper = {k: max(named) for k, ids in holders.items() if len(ids) >= least_docs and (named := [i for i in ids if i is not None])}
    out = []
    for i, lines in cut:
        stay = [x for x, k in lines if k not in keeper or keeper[k] == i]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def some_lines(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    shared = [" ".join(words(rng, 12)) for _ in range(60)] + ["é" * 39, "É" * 40, "Ünder Forty but many bytes ééééééééé", "x" * 40, "y" * 39]
    spoil = lambda x: rng.choice([x, x.upper(), f"  {x}\t", f"\x0b{x}\r", x + " "])
    rows = [(i, "\n".join(spoil(rng.choice(shared)) for _ in range(rng.randrange(12)))) for i in range(150)]
    return rows + [(7, rows[7][1]), (None, "\n".join(shared)), (None, None), (400, ""), (401, "\n\n"), (402, shared[0] + "\n" + shared[0])]


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_op13(spark, most):
    """With the arrays in every worker, and with probes that are sent to them."""
    rows = some_lines(3)
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, high long, kept string")
    found = sorted((tuple(r) for r in line_dedup.line_dedup(docs, broadcast_bytes=most).collect()), key=repr)
    assert found == plain_lines(rows)
    assert sum(r[2] for r in found) > 300


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_op13_many_shards_and_odd_rows(spark, odd_docs, monkeypatch, most):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 8)
    rows = some_lines(5) + [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    found = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), broadcast_bytes=most).collect()
    assert sorted((tuple(r) for r in found), key=repr) == plain_lines(rows)
    assert line_dedup.line_dedup(odd_docs.limit(0), broadcast_bytes=most).count() == 0


def test_only_rows_without_an_id_hold_a_line(spark):
    rows = [(None, "z" * 50)] * 6
    found = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [tuple(r) for r in found] == [(None, 1, 0, "z" * 50)] * 6


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 50_000])
def test_slots_are_minimal_and_perfect(n):
    rng = np.random.default_rng(n)
    high, low = rng.integers(-(2**63), 2**63, (2, n), dtype=np.int64)
    if n > 2:
        high[1] = high[0]  # halves may be alike, keys may not
    sizes, bits, slots = line_dedup.built(high, low)
    assert sorted(slots.tolist()) == list(range(n))
    assert sum(sizes) <= 5 * n + 64 * len(sizes)
    order = np.argsort(slots)
    row = {"shard": 0, "sizes": sizes, "words": bits.tobytes(), "fingerprints": low[order].tobytes(), "counts": np.arange(n, dtype="<u4")[order].tobytes(), "keepers": (high // 2)[order].tobytes()}
    index = line_dedup.LineIndex.of([row] if n else [], 1)
    count, keeper = index.find(high, low)
    assert (count == np.arange(n)).all() and (keeper == high // 2).all()
    others = rng.integers(-(2**63), 2**63, (2, 1000), dtype=np.int64)
    assert not index.find(others[0], others[1])[0].any()


def plain_search(items: list[tuple], rows: list[tuple], k: int) -> list[tuple]:
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lowered(t or ""))
    found = [(i, Counter(cut(t)), len(cut(t))) for i, t in rows]
    n_docs, length = sum(n > 0 for _, _, n in found), sum(n for _, _, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, counts, n in found:
            score = 0
            for t in cut(text):
                w, tf = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))), counts[t]
                score += w * ((1_000_000_000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // length)))
            if score > 0 and i is not None:
                scores.append((-score, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1) if item is not None]
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 7])
@pytest.mark.parametrize("blocks", [20_000, 9])
def test_op12(spark, monkeypatch, parts, blocks):
    rng = random.Random(parts)
    monkeypatch.setattr(ranked_search, "INDEX_ITEMS", blocks)
    monkeypatch.setattr(ranked_search, "CELLS", 300)
    monkeypatch.setattr(ranked_search, "POSTINGS", 50)
    rows = [(i, " ".join(rng.choice("the of and Zoë straße 12".split() + words(rng, 6, 60)) for _ in range(rng.randrange(40)))) for i in range(300)]
    rows += [(i, rows[5][1]) for i in range(1000, 1040)] + [(5, rows[5][1])] + [(2000 + i, t) for i, t in enumerate(ODD)] + [(None, rows[9][1]), (3000, None)]
    items = [(i, " ".join(rng.choice(("The", "the", "OF!", "zoë", "straße")) + " " + w for w in words(rng, 8, 60))) for i in range(30)]
    items += [(100, None), (101, ""), (102, "nowhere-to-be-found"), (103, rows[5][1]), (103, rows[5][1]), (None, "the"), (104, "the " * 5000), (105, "テスト🎉")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, item string, rank long").repartition(parts)
    asked = spark.createDataFrame([(i, t, 1.0) for i, t in items], "item_id long, text string, score double")
    found = sorted(tuple(r) for r in ranked_search.ranked_search(asked, docs, k=7).collect())
    assert found == plain_search(items, rows, 7)


def test_op12_empty_tables(spark, odd_docs):
    items = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert ranked_search.ranked_search(items, odd_docs.limit(0)).count() == 0
    assert ranked_search.ranked_search(items.limit(0), odd_docs).count() == 0
    assert ranked_search.ranked_search(items, odd_docs.where("doc_id = 0")).count() == 0


def plain_runs(w: list[str]) -> list[tuple]:
    """(start, length, period) of all runs, by counting agreement for every period."""
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] == w[i + q]:
                s = i
                while i + q < n and w[i] == w[i + q]:
                    i += 1
                if i - s + q >= max(6, 4 * q):
                    out.setdefault((s, i - s + q), q)
            else:
                i += 1
    return sorted((s, n, q) for (s, n), q in out.items())


def plain_collapsed(w: list[str], runs: list[tuple]) -> str:
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic_text(rng: random.Random, n: int) -> str:
    """Random words with runs, runs of runs, and broken ones."""
    w: list[str] = []
    while len(w) < n:
        block = words(rng, rng.choice([1, 1, 2, 3, 5, 8, 13, 40]), rng.choice([2, 3, 400]))
        if rng.random() < 0.3:
            block = block * rng.randrange(2, 6) + words(rng, 1)
        part = block * rng.randrange(1, 9)
        w += part[: len(part) - rng.randrange(len(block))] + words(rng, rng.randrange(6))
    return rng.choice([" ", "\n", "\t \x0b"]).join(w[:n])


def of_rows(found) -> list[tuple]:
    return sorted(((r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"], r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) for r in found), key=repr)


def plain_of_rows(rows: list[tuple]) -> list[tuple]:
    out = []
    for i, t in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", t or "") if x]
        runs = plain_runs(w)
        best = min(((-n, s, q) for s, n, q in runs), default=None)
        most = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        out.append((i, runs, plain_collapsed(w, runs), len(runs), *most))
    return sorted(out, key=repr)


@pytest.mark.parametrize("long_bytes", [65_536, 300])
def test_op11(spark, odd_docs, monkeypatch, long_bytes):
    """Whole texts, and texts cut to small tiles, whose fragments are stitched."""
    rng = random.Random(11)
    rows = [(100 + i, periodic_text(rng, rng.choice([3, 6, 20, 100, 700, 1500]))) for i in range(90)]
    rows += [(i, t) for i, t in ((1, "a " * 5), (2, "a " * 6), (3, "a b " * 4), (4, "a b " * 4 + "a"), (5, "x a b a b a b a"), (6, ("a b " * 4 + "c ") * 6), (7, ("a " * 7 + "b ") * 30))] + [rows[3], (None, rows[4][1])]
    rows += [(r["doc_id"], r["text"]) for r in odd_docs.where("length(text) < 4000 or text is null").collect()]
    monkeypatch.setattr(periodic_runs, "LOW_WORDS", 64)
    docs = spark.createDataFrame([(i, t, 1, "x", []) for i, t in rows], "doc_id long, text string, start int, id string, runs array<int>")
    found = periodic_runs.periodic_runs(docs, long_bytes=long_bytes)
    assert of_rows(found.collect()) == plain_of_rows(rows)
    assert periodic_runs.periodic_runs(docs.limit(0), long_bytes=long_bytes).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_stretches_over_small_alphabets(seed):
    rng = random.Random(seed)
    texts = [[b"%d" % rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.choice([0, 1, 5, 30, 200]))] for _ in range(12)]
    texts += [[b"a", b"b"] * 40 + [b"a"] * k for k in range(3)] + [([b"a"] * 9 + [b"b"]) * 12]
    text, start, length, period = periodic_runs.runs_of_texts(texts)
    assert list(zip(text.tolist(), start.tolist(), length.tolist(), period.tolist(), strict=True)) == [(i, *r) for i, t in enumerate(texts) for r in plain_runs(t)]


@pytest.mark.parametrize("n", [0, 1, 3, 4, 100, 4096, 16_384, 16_385, 200_000, 1_000_003])
def test_tiles_overlap_and_cover(n):
    by_octaves = defaultdict(list)
    for first, last, start, stop in periodic_runs.tiles_of(n):
        by_octaves[first, last].append((start, stop))
    assert sorted(j for a, b in by_octaves for j in range(a, b + 1)) == [j for j in range(30) if 4 << j <= n]
    for (_, last), spans in by_octaves.items():
        assert spans[0][0] == 0 and spans[-1][1] == n
        assert all(b[0] <= a[1] - (4 << last) for a, b in zip(spans, spans[1:], strict=False))
    # Tiles carry a text in proportion to its length, for each octave.
    assert sum(b - a for spans in by_octaves.values() for a, b in spans) <= 1.5 * n * len(by_octaves) + 1


def test_long_runs_across_tiles(spark):
    """Runs over many tiles, of short and long periods, in a text of 120,000 words; one word again and again; and a block twice, which is no run."""
    rng = random.Random(2)
    block, small = words(rng, 6000, 10**6), words(rng, 70, 10**6)
    w = words(rng, 500, 10**6) + block * 5 + words(rng, 400, 10**6) + small * 900 + ["one"] * 20_000 + block + block[:999]
    found = periodic_runs.periodic_runs(spark.createDataFrame([(1, " ".join(w)), (2, "same " * 50_000)], "doc_id long, text string")).collect()
    one = next(r for r in found if r["doc_id"] == 1)
    assert [tuple(x) for x in one["runs"]] == [(500, 30_000, 6000), (30_900, 63_000, 70), (93_900, 20_000, 1)]
    assert one["collapsed"] == " ".join(w[:6500] + w[30_500:30_970] + w[93_900:93_901] + w[113_900:])
    two = next(r for r in found if r["doc_id"] == 2)
    assert [tuple(x) for x in two["runs"]] == [(0, 50_000, 1)] and two["collapsed"] == "same"
